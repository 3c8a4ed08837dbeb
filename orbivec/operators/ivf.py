"""Approximate search over cells of a trained coarse quantiser.

The cells are a data layout: the corpus is written partitioned by
``cluster_id``. A search reads the cells near its queries and compares each
row only with the queries that probe its cell. For one block of queries, rows
are scored where they lie. More queries are joined with the cells in Spark:
the probes are a table, a cell and its askers meet under one key, and large
cells and cells with many askers are dealt over several keys, so that a cell
that holds a third of the corpus, or is asked by a third of the queries, is
work for many tasks.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from orbivec.functions.vectors import score, space_of
from orbivec.operators import kmeans, scan
from orbivec.operators.knn import dense_blocks, knn, search
from orbivec.operators.meet import meet
from orbivec.operators.nearest import Nearest
from orbivec.session import materialise

#: Most bytes of centroids held by a task at a time.
CENTROID_BYTES = 256 * 1024 * 1024
_MAX_NAMED_CELLS = 2_000


def training_sample(df: DataFrame, n: int, seed: int = 42, id_col: str = "_id",
                    vector_col: str = "vector") -> DataFrame:
    """About ``n`` rows drawn by a hash of the id, written once for the many passes of training."""
    rows = df.select(id_col, vector_col).filter(F.col(vector_col).isNotNull())
    total = rows.count()
    if total > n:
        share = int(n / total * 2**32)
        rows = rows.filter(F.pmod(F.xxhash64(F.lit(seed), id_col), F.lit(2**32)) < share)
    return materialise(rows, "training")


def ivf_train(df: DataFrame, nlist: int, sample: int | None = None, seed: int = 42, iterations: int = 20, *,
              id_col: str = "_id", vector_col: str = "vector") -> DataFrame:
    """Cell centres ``(cluster_id int, vector array<double>)`` of a two-level k-means over ``sample`` rows, by default all."""
    rows = df.select(vector_col).filter(F.col(vector_col).isNotNull())
    rows = materialise(rows, "training") if sample is None else training_sample(df, sample, seed, id_col, vector_col)
    return materialise(kmeans.two_level(rows, nlist, seed, iterations, vector_col), "centroids")


def _centroid_blocks(centroids: DataFrame) -> list:
    """Broadcast the centres in blocks of proven size, in id order."""
    spark = centroids.sparkSession
    table = centroids.orderBy("cluster_id").toArrow()
    ids = table.column("cluster_id").to_numpy()
    centers = scan.matrix(table.column("vector"))
    step = max(1, CENTROID_BYTES // max(1, centers.shape[1] * 8))
    return [spark.sparkContext.broadcast((ids[lo:lo + step], centers[lo:lo + step]))
            for lo in range(0, len(ids), step)]


def nearest_rows(x: np.ndarray, blocks) -> np.ndarray:
    """Id of the closest centre (squared L2, lowest id on ties) for every row of ``x``."""
    best, who = np.full(len(x), np.inf), np.zeros(len(x), np.int64)
    for ids, centers in blocks:
        near = scan.Dense(centers, "l2")
        every, bounded = np.arange(len(ids)), np.zeros(len(ids))
        step = max(1, scan._CELLS // len(ids))
        for lo in range(0, len(x), step):
            rows = near.rows(x[lo:lo + step])
            scored = near.scored(every, rows, bounded)
            # Centres that single precision cannot tell from the closest are scored exactly.
            low = scored.block.min(axis=0).astype(np.float64) + 2 * scored.margin.max() + 1e-9
            c, r = np.nonzero(scored.block <= low[None, :])
            d = np.round(near.exact(c, r, rows), 9)
            order = np.lexsort((ids[c], d, r))
            r, at = np.unique(r[order], return_index=True)
            d, c = d[order][at], c[order][at]
            better = d < best[lo + r]
            best[lo + r[better]], who[lo + r[better]] = d[better], ids[c[better]]
    return who


def ivf_assign(df: DataFrame, centroids: DataFrame, vector_col: str = "vector") -> DataFrame:
    """Adds ``cluster_id``, the cell of each row; rows without a vector are left out."""
    blocks = _centroid_blocks(centroids)
    schema = T.StructType(df.schema.fields + [T.StructField("cluster_id", T.IntegerType())])

    def run(batches):
        centers = [b.value for b in blocks]
        for batch in batches:
            if batch.num_rows:
                cell = nearest_rows(scan.matrix(batch.column(vector_col)), centers).astype(np.int32)
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cell)],
                                                 names=[*batch.schema.names, "cluster_id"])

    return df.filter(F.col(vector_col).isNotNull()).mapInArrow(run, schema)


def ivf_write(df: DataFrame, centroids: DataFrame, path: str, vector_col: str = "vector") -> DataFrame:
    """Write the corpus partitioned by cell and read it back.

    The rebalance hint lets Spark split large cells over several tasks and
    put small ones together.
    """
    assigned = ivf_assign(df, centroids, vector_col)
    assigned.hint("rebalance", F.col("cluster_id")).write.partitionBy("cluster_id").parquet(path)
    return df.sparkSession.read.parquet(path)


def probed_scorer(space: str, vector_col: str, read=scan.stored_matrix) -> scan.Scorer:
    """Compares a row only with the queries that probe its cell."""

    def prepare(data):
        near, probes = scan.Dense(data["vectors"], space), data["probes"]

        def blocks(batch, limits):
            cells = batch.column("cluster_id").to_numpy()
            x = near.rows(read(batch.column(vector_col)))
            order = np.argsort(cells, kind="stable")
            found, starts = np.unique(cells[order], return_index=True)
            for cell, lo, hi in zip(found, starts, [*starts[1:], len(cells)]):
                asking = probes.get(int(cell))
                if asking is None:
                    continue
                for part, at in scan.tiles(len(asking), hi - lo, limits[asking], data.get("k", 1)):
                    yield near.scored(asking[part], x, limits, order[lo:hi][at])

        return blocks

    return prepare


def ivf_search(table: DataFrame, centroids: DataFrame, queries: DataFrame, k: int = 100, nprobe: int = 1,
               space: str = "l2", *, where: Column | str | None = None, id_col: str = "_id", vector_col: str = "vector",
               query_id: str = "query_id", query_vector: str = "vector", block_queries: int = scan.BLOCK_QUERIES,
               salts: int | None = None, read=scan.stored_matrix) -> DataFrame:
    """k nearest rows among the ``nprobe`` cells closest to each query.

    ``table`` carries ``cluster_id`` (see :func:`ivf_write`). With ``nprobe``
    equal to the number of cells the result is exact. ``where`` restricts the
    hits before the search; queries with fewer than k hits then probe four
    times as many cells, again and again, until they have k or all cells.
    """
    space = space_of(space)
    options = dict(id_col=id_col, vector_col=vector_col, query_id=query_id, query_vector=query_vector,
                   block_queries=block_queries, salts=salts, read=read)
    if where is None:
        return _probe(table, centroids, queries, k, nprobe, space, **options)
    rows = table.filter(where)
    return widened(lambda asked, n: _probe(rows, centroids, asked, k, n, space, **options),
                   queries.filter(F.col(query_vector).isNotNull()), k, nprobe, centroids.count(), query_id)


def widened(probe, queries: DataFrame, k: int, nprobe: int, nlist: int, query_id: str = "query_id") -> DataFrame:
    """Hits of ``probe(queries, nprobe)``; queries with fewer than k hits ask four times as many cells, until all ``nlist``."""
    hits = materialise(probe(queries, nprobe), "filtered")
    while nprobe < nlist:
        full = hits.groupBy("query_id").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= k)
        short = materialise(queries.join(full, queries[query_id] == full["query_id"], "left_anti"), "short")
        if short.isEmpty():
            break
        nprobe = min(nlist, 4 * nprobe)
        hits = materialise(hits.join(full, "query_id", "left_semi").unionByName(probe(short, nprobe)), "filtered")
    return hits


def _probe(table, centroids, queries, k, nprobe, space, *, id_col, vector_col, query_id, query_vector, block_queries, salts, read):
    salts = scan.merge_salts(table) if salts is None else salts
    query_type = queries.schema[query_id].dataType
    present = queries.filter(F.col(query_vector).isNotNull())
    rows, size = present.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.size(query_vector).cast("bigint")), F.lit(0))).first()
    if rows > block_queries or 8 * size > scan.BLOCK_BYTES:
        probes = probed_cells(centroids, present, nprobe, space, query_id, query_vector, block_queries)
        found = meet(table, present.select(query_id, query_vector).join(probes, query_id), k, space, key="cluster_id", id_col=id_col,
                     vector_col=vector_col, query_id=query_id, query_vector=query_vector, read=read)
    else:
        found = _one_block(table, centroids, present, k, nprobe, space, id_col, vector_col, query_id, query_vector, block_queries, read)
    hits = scan.merge(found, k, id_col, salts)
    return hits.select("query_id", id_col, "distance", score(F.col("distance"), space).alias("score"), "rank")


def probed_cells(centroids: DataFrame, queries: DataFrame, nprobe: int, space: str = "l2", query_id: str = "query_id",
                 query_vector: str = "vector", block_queries: int = scan.BLOCK_QUERIES) -> DataFrame:
    """``(query_id, cluster_id)``: the cells closest to each query, as a written table.

    The centres are broadcast and the queries read where they lie, ``block_queries`` at a time.
    """
    space, blocks = space_of(space), _centroid_blocks(centroids)
    schema = T.StructType([T.StructField(query_id, queries.schema[query_id].dataType), T.StructField("cluster_id", T.IntegerType())])

    def closest(asked):
        near, best = scan.Dense(scan.matrix(asked.column(query_vector)), space), Nearest(asked.num_rows, nprobe)
        for ids, centers in (b.value for b in blocks):
            x, ids = near.rows(centers), ids.astype(np.int64)
            payload = pa.RecordBatch.from_arrays([pa.array(ids.astype(np.int32))], names=["cluster_id"])
            for part in scan.chunks(asked.num_rows, len(x)):
                best.offer(near.scored(part, x, best.limits), ids, payload)
        for q, _, _, cells, _ in best.drain():
            yield pa.RecordBatch.from_arrays([asked.column(query_id).take(pa.array(q)), cells.column(0)], names=schema.names)

    def run(batches):
        for batch in batches:
            for lo in range(0, batch.num_rows, block_queries):
                yield from closest(batch.slice(lo, block_queries))

    asked = queries.filter(F.col(query_vector).isNotNull()).select(query_id, query_vector)
    return materialise(asked.mapInArrow(run, schema), "probes")


def _one_block(table, centroids, queries, k, nprobe, space, id_col, vector_col, query_id, query_vector, block_queries, read):
    """Candidates of one block of queries, scored where the rows of the probed cells lie."""
    query_type = queries.schema[query_id].dataType
    parts = []
    for block in dense_blocks(queries, query_id, query_vector, block_queries):  # one, at most block size x nprobe pairs
        near = search(centroids, iter([block]), scan.dense_scorer(space, "vector"), nprobe, inputs=["vector"],
                      query_type=query_type, id_col="cluster_id", salts=1).select("query_id", "cluster_id").toArrow()
        at = {v: i for i, v in enumerate(block.ids.to_pylist())}
        asking = np.array([at[v] for v in near.column("query_id").to_pylist()], np.int64)
        cells = near.column("cluster_id").to_numpy()
        block.data["probes"] = {int(c): np.sort(asking[cells == c]) for c in np.unique(cells)}
        probed = sorted(block.data["probes"])
        if len(probed) <= _MAX_NAMED_CELLS:  # named cells prune partitions when the scan is planned
            rows = table.filter(F.col("cluster_id").isin(probed))
        else:  # and joined ones when it runs; at most as many ids as there are centres
            named = materialise(table.sparkSession.createDataFrame(pa.table({"cluster_id": pa.array(probed, pa.int32())})), "probed")
            rows = table.join(F.broadcast(named.filter(F.col("cluster_id") >= 0)), "cluster_id", "left_semi")
        parts.append(scan.scan_block(rows, block, probed_scorer(space, vector_col, read), k,
                                     inputs=[vector_col, "cluster_id"], id_col=id_col, query_type=query_type))
    return scan.union_all(parts)


def adaptive_search(table: DataFrame, centroids: DataFrame, queries: DataFrame, k: int = 100, *, threshold: int = 0,
                    nprobe: int = 1, space: str = "l2", **options) -> DataFrame:
    """Exact search while the table has fewer than ``threshold`` rows, else by cells.

    A threshold of 0 always searches by cells, a negative one never does.
    """
    if threshold < 0 or (threshold > 0 and table.count() < threshold):
        return knn(table, queries, k, space, **options)
    return ivf_search(table, centroids, queries, k, nprobe, space, **options)
