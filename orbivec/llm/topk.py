"""Exact top-k inner products by MaxScore: a query's components are its terms, a shard's columns their postings.

In a shard, a component's contribution lies between known bounds, from the shard's smallest and largest value there. A
query's essential components are those with the largest bounds; the others together cannot lift a row over the query's
current k-th score. All rows get their essential sums; the other components are probed group by group, only for rows
whose sum plus what is left to gain still reaches the k-th score. Ties are kept until the end, so results are exact.
Shards stream through the tasks; their lists are merged by query.

Queries go in blocks of a bounded number of components, each block one pass over the vectors; nothing else is held on
the driver. Defined cases: vectors that are null, empty, or hold null or non-finite components, and rows with a null id,
take no part. Vectors of another length than the query's are no candidates of it. A query id given in several rows
is asked with each of them, and its list is the best of all their hits, as in the SQL; its own rows are all those of its
id. Repeated rows count each, as candidates and as queries. Products beyond 2^53 are made in whole numbers.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from orbivec.llm.registry import query, table
from orbivec.llm.texts import col
from orbivec.session import materialise

#: Components of all queries of a block, at most (8 bytes each).
BLOCK_VALUES = 8_000_000
_ROWS, _QUERIES, _GROUP = 2048, 512, 8


def usable(vector: Column) -> Column:
    """Not null or empty, all components present and finite."""
    return F.coalesce((F.size(vector) > 0) & F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))), F.lit(False))


def levels(vectors: np.ndarray, scale: float) -> np.ndarray:
    return np.floor(vectors.astype(np.float64) * scale)


class Best:
    """The k best (score, id) of each query so far."""

    def __init__(self, queries: int, k: int):
        self.k = k
        self.queries, self.scores, self.ids = (np.zeros(0, np.int64) for _ in range(3))
        self.least = np.full(queries, -np.inf)

    def add(self, queries, scores, ids) -> None:
        q, s, i = np.concatenate((self.queries, queries)), np.concatenate((self.scores, scores.astype(np.int64))), np.concatenate((self.ids, ids))
        order = np.lexsort((i, -s, q))
        q, s, i = q[order], s[order], i[order]
        rank = np.arange(len(q)) - np.searchsorted(q, q)
        keep = rank < self.k
        self.queries, self.scores, self.ids = q[keep], s[keep], i[keep]
        last = rank[keep] == self.k - 1
        self.least[self.queries[last]] = self.scores[last]


def scan(asked: np.ndarray, asked_ids: np.ndarray, rows: np.ndarray, row_ids: np.ndarray, best: Best, first: int) -> None:
    """One shard against some queries; ``first`` is their place among all."""
    n, dims = asked.shape
    low, high = rows.min(0), rows.max(0)
    base = np.minimum(asked * low, asked * high)  # what every row has at least
    gain = np.abs(asked) * (high - low)  # what a row can have on top
    order = np.argsort(-gain, axis=1, kind="stable")
    left = np.take_along_axis(gain, order, 1)[:, ::-1].cumsum(1)[:, ::-1]  # to gain from this place of the order on
    least = best.least[first:first + n]
    # Essential: the places of the order whose tail could by itself reach the k-th score.
    essential = np.maximum((left >= (least - base.sum(1))[:, None]).sum(1), 1)
    place = np.argsort(order, axis=1)
    now = place < essential[:, None]
    sums = (asked * now) @ rows.T
    sums[asked_ids[:, None] == row_ids[None, :]] = -np.inf
    done, candidates = now, np.arange(len(row_ids))
    for step in range(1, dims // _GROUP + 2):
        rest = ~done
        bound = sums + (np.where(rest, base + gain, 0).sum(1))[:, None]
        alive = bound >= least[:, None]
        keep = alive.any(0)
        if not keep.any():
            return
        if not keep.all():
            sums, candidates, alive = sums[:, keep], candidates[keep], alive[:, keep]
        if not rest.any():
            break
        now = rest & (place < (essential + step * _GROUP)[:, None])
        sums = np.where(alive, sums + (asked * now) @ rows[candidates].T, -np.inf)
        done = done | now
    if sums.shape[1] > best.k:  # the shard's own k-th score is a bound as well
        least = np.maximum(least, np.partition(sums, sums.shape[1] - best.k, axis=1)[:, -best.k])
    q, c = np.nonzero((sums >= least[:, None]) & (sums > -np.inf))
    best.add(q + first, sums[q, c], row_ids[candidates[c]])


def top_k(vectors: DataFrame, is_query: Column, k: int = 5, vec_id: str = "vec_id", vector: str = "embedding", scale: float = 256.0) -> DataFrame:
    """``(query_id, rank, vec_id, score)``: each query's k rows of highest integer inner product, ties to the smaller id."""
    spark = vectors.sparkSession
    rows = vectors.where(usable(col(vector)) & col(vec_id).isNotNull())
    asked = rows.where(is_query).select(col(vec_id).cast("long").alias("query_id"), col(vector).cast("array<double>").alias("v"))
    asked = materialise(asked.groupBy("query_id", "v").agg(F.count("*").alias("times")), "asked")
    values = asked.agg(F.sum(F.size("v"))).first()[0] or 0
    blocks = values // BLOCK_VALUES + 1
    rows = rows.select(col(vec_id).cast("long").alias("id"), col(vector).cast("array<double>").alias("v"))
    found = []
    for b in range(blocks):
        block = asked.where(F.pmod(F.xxhash64("query_id"), F.lit(blocks)) == b).toPandas() if blocks > 1 else asked.toPandas()
        shared = spark.sparkContext.broadcast(_by_length(block["query_id"].to_numpy(np.int64), list(block["v"]), np.minimum(block["times"].to_numpy(np.int64), k), scale))
        hits = materialise(rows.mapInArrow(_pass(shared, k, scale), "query_id long, vec_id long, score long"), "hits")
        shared.unpersist()
        found.append(hits)
    hits = found[0]
    for more in found[1:]:
        hits = hits.unionAll(more)
    ranked = hits.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")))
    return ranked.where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def _by_length(ids: np.ndarray, vectors: list, times: np.ndarray, scale: float) -> dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]]:
    sizes = np.array([len(v) for v in vectors])
    return {int(n): (ids[sizes == n], levels(np.array([v for v in vectors if len(v) == n]), scale), times[sizes == n]) for n in np.unique(sizes)}


def _pass(shared, k: int, scale: float):
    def run(batches):
        queries = shared.value
        best = {n: Best(len(ids), k) for n, (ids, _, _) in queries.items()}
        waiting: dict[int, list] = {n: [] for n in queries}

        def flush(n):
            ids, rows = (np.concatenate(x) for x in zip(*waiting[n], strict=True))
            waiting[n].clear()
            asked_ids, asked, _ = queries[n]
            if n * max(np.abs(rows).max(), 1) * max(np.abs(asked).max(), 1) >= 2.0**53:
                for row, row_id in zip(rows, ids.tolist(), strict=True):
                    whole = [int(x) for x in row]
                    q = np.flatnonzero(asked_ids != row_id)
                    sums = [sum(int(x) * y for x, y in zip(asked[i], whole, strict=True)) for i in q]
                    best[n].add(q, np.array(sums, np.int64), np.full(len(q), row_id))
                return
            for at in range(0, len(ids), _ROWS):
                for first in range(0, len(asked_ids), _QUERIES):
                    part = slice(first, first + _QUERIES)
                    scan(asked[part], asked_ids[part], rows[at:at + _ROWS], ids[at:at + _ROWS], best[n], first)

        for batch in batches:
            column = batch.column(1)
            ids, sizes = batch.column(0).to_numpy(), np.diff(column.offsets.to_numpy())
            flat, starts = column.values.to_numpy(), column.offsets.to_numpy()[:-1]
            for n in queries:
                own = np.flatnonzero(sizes == n)
                if len(own):
                    waiting[n].append((ids[own], levels(flat[starts[own][:, None] + np.arange(n)], scale)))
                    if sum(len(x[0]) for x in waiting[n]) >= _ROWS:
                        flush(n)
        for n in queries:
            if waiting[n]:
                flush(n)
            own = best[n]
            times = queries[n][2][own.queries]
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(x, times)) for x in (queries[n][0][own.queries], own.ids, own.scores)], names=["query_id", "vec_id", "score"])

    return run


_SQL = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) c FROM embeddings
  WHERE len(embedding) > 0 AND vec_id IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id query_id, v.vec_id, CAST(list_sum(list_transform(list_zip(q.c, v.c), lambda p: p[1] * p[2])) AS BIGINT) score
  FROM v q JOIN v ON q.vec_id % 50 = 0 AND q.vec_id <> v.vec_id AND len(q.c) = len(v.c))
SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS "rank", vec_id, score FROM s
QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) <= 5
"""


@query("op9_maxscore", _SQL)
def op9_maxscore(spark, sf_dir):
    return top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)
