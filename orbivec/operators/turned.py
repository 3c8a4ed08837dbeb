"""Searches with the tables' roles turned: pieces of the corpus go to the queries.

Where many blocks of queries ask a corpus of moderate size, a pass for each block costs more than its arithmetic, and hits
of long lists are many times the size of both tables. Here the corpus is broadcast in pieces of known size and every task
takes some of the queries. It compares them with all rows, so its lists are whole: their bounds fall once for the whole
corpus, and hits leave the task in order and with their ranks. Neither candidates nor hits are shuffled.

A task answers a group of queries at a time. When their hits are more than it may hold, it goes on with half of the group
and leaves the other half for the next one, so memory depends neither on the number of queries nor on that of hits.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from orbivec.functions.text import id_order
from orbivec.operators import scan
from orbivec.operators.nearest import Nearest
from orbivec.session import materialise

#: Largest corpus that is sent to the queries, and what one piece of it and all those a worker keeps may have, in bytes.
CORPUS_BYTES, PIECE_BYTES, KEPT_BYTES = 1 << 30, 32 << 20, 192 << 20
#: Queries a task answers together, rows they are compared with before it looks at what it holds, and hits it may hold.
GROUP, ROWS, HELD = 1024, 2048, 2_000_000
#: Queries of one task.
TASK_QUERIES = 2048
_DEAL, _DEALT = "__deal", 1 << 20
_ROW_BYTES = 32  # of a row's id, tie and carried columns


def many(queries: DataFrame, query_id: str, query_vector: str, block_queries: int = scan.BLOCK_QUERIES) -> DataFrame | None:
    """The queries that have a vector, written below the shared folder, or None where blocks of them suffice.

    They are many if even short ones don't fit one pass, and blocks have not been asked to be smaller.
    """
    present = queries.filter(F.col(query_vector).isNotNull()).select(query_id, query_vector)
    if block_queries < scan.BLOCK_QUERIES or present.count() <= max(block_queries, scan.PASS_QUERIES):
        return None
    kept = materialise(present, "queries")
    if not kept.groupBy(query_id).count().filter("count > 1").isEmpty():
        raise ValueError("query ids must be unique")
    low, high = kept.agg(F.min(F.size(query_vector)), F.max(F.size(query_vector))).first()
    if low != high:
        raise ValueError("vectors of different lengths; pass the table through gate() first")
    return kept


class Pieces:
    """The columns of a corpus that a search needs, written once and read back in pieces of known size."""

    def __init__(self, corpus: DataFrame, inputs: list[str], weight: Column, id_col: str = "_id", carry: list[str] = ()):
        id_type = corpus.schema[id_col].dataType
        tie = F.col(id_col).cast("bigint") if isinstance(id_type, T.IntegralType) else id_order(F.col(id_col))
        source = corpus.select(id_col, *carry, tie.alias(scan._TIE), *inputs)
        for name in inputs:
            source = source.filter(F.col(name).isNotNull())
        self.id_col, self.carry = id_col, list(carry)
        self.table = materialise(source.withColumn(_DEAL, (F.rand(7) * _DEALT).cast("int")), "corpus")
        self.size = self.table.agg(F.coalesce(F.sum((weight + _ROW_BYTES).cast("bigint")), F.lit(0))).first()[0]

    @property
    def fit(self) -> bool:
        return self.size <= CORPUS_BYTES

    def shared(self) -> list:
        """A broadcast of each piece; the driver holds one at a time."""
        n, out = max(1, -(-self.size // PIECE_BYTES)), []
        for i in range(n):
            part = self.table.filter(F.col(_DEAL).between(-(-i * _DEALT // n), -(-(i + 1) * _DEALT // n) - 1)).drop(_DEAL).toArrow()
            for batch in part.combine_chunks().to_batches():
                if batch.num_rows:
                    out.append(self.table.sparkSession.sparkContext.broadcast(batch))
        return out


def search(asked: DataFrame, corpus: Pieces, scorer: scan.Scorer, k: int, *, query_id: str, query_vector: str,
           limit: float | None = None, decimals: int = 9) -> DataFrame:
    """``(query_id, id, carry..., distance, rank)`` of the k best rows of every query, within ``limit`` if there is one.

    ``asked`` comes from :func:`many`. The result is a plan: hits are neither written nor held.
    """
    pieces, keep = corpus.shared(), corpus.size <= KEPT_BYTES
    payload_of = [corpus.id_col, *corpus.carry]
    schema = T.StructType([T.StructField("query_id", asked.schema[query_id].dataType), *[corpus.table.schema[c] for c in payload_of],
                           T.StructField("distance", T.DoubleType()), T.StructField("rank", T.IntegerType())])

    def closest(q: np.ndarray) -> Nearest:
        """Lists of as many of the first queries as may be held."""
        best = Nearest(len(q), k, None if limit is None else np.full(len(q), float(limit)), decimals)
        blocks_of = scorer({"vectors": q, "k": k})
        for piece in pieces:
            batch = piece.value
            ties, payload = batch.column(scan._TIE).to_numpy(zero_copy_only=False), batch.select(payload_of)
            for at in range(0, batch.num_rows, ROWS):
                for scored in blocks_of(batch.slice(at, ROWS), best.limits):
                    best.offer(scored, ties[at:at + ROWS], payload.slice(at, ROWS))
                if best.pending > HELD:
                    best.only(best.n)
                    while best.pending > HELD and best.n > 1:
                        best.only(best.n // 2)
                        blocks_of = scorer({"vectors": q[:best.n], "k": k})
            if not keep:
                vars(piece).pop("_value", None)  # read anew by the next group
        return best

    def run(batches):
        size = GROUP
        for queries in batches:
            ids, vectors, lo = queries.column(0), scan.matrix(queries.column(1)), 0
            while lo < len(ids):
                best = closest(vectors[lo:lo + size])
                for q, d, rank, payload in best.ranked():
                    yield pa.RecordBatch.from_arrays([ids.take(pa.array(q + lo)), *payload.columns, pa.array(d), pa.array(rank)], names=schema.names)
                lo += best.n
                size = min(GROUP, 2 * best.n) if best.pending < HELD // 4 else best.n

    cores = asked.sparkSession.sparkContext.defaultParallelism
    dealt = asked.select(query_id, query_vector).repartition(max(4 * cores, -(-asked.count() // TASK_QUERIES)))
    return dealt.mapInArrow(run, schema)
