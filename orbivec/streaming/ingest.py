"""Streams of rows into a vector table, and streams of queries against one."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from orbivec.operators.gate import gate
from orbivec.operators.knn import knn
from orbivec.plans.table import VectorTable


def stream_ingest(stream: DataFrame, root: str, schema: T.StructType, dim: int, *, checkpoint: str,
                  strict: bool = True, id_col: str = "_id", order: str | None = None, rejects: str | None = None,
                  compact_every: int = 0, name: str = "ingest", trigger: dict | None = None) -> StreamingQuery:
    """Check every micro-batch and upsert it by id.

    A batch costs what it holds, not what the table holds; a replayed batch
    replaces itself. ``compact_every`` folds the upserts after that many batches.
    """
    spark = stream.sparkSession

    def write(batch: DataFrame, number: int) -> None:
        accepted, rejected = gate(batch, schema, dim, strict)
        table = VectorTable(spark, root, id_col)
        table.upsert(accepted, order, token=f"{name}-{number}")
        if rejects:
            rejected.write.mode("overwrite").parquet(f"{rejects}/batch={number}")
        if compact_every and (number + 1) % compact_every == 0:
            table.compact()

    return (stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
            .trigger(**(trigger or {"availableNow": True})).start())


def stream_search(stream: DataFrame, corpus: DataFrame, out: str, k: int = 100, space: str = "l2", *,
                  checkpoint: str, query_id: str = "query_id", query_vector: str = "vector",
                  trigger: dict | None = None, **options) -> StreamingQuery:
    """Answer every micro-batch of queries against a static corpus.

    Hits land in ``out/batch=<n>``; a replayed batch replaces its own hits. A
    query repeated inside a batch is answered once.
    """

    def answer(batch: DataFrame, number: int) -> None:
        asked = batch.dropDuplicates([query_id, query_vector])
        hits = knn(corpus, asked, k, space, query_id=query_id, query_vector=query_vector, **options)
        hits.write.mode("overwrite").parquet(f"{out}/batch={number}")

    return (stream.writeStream.foreachBatch(answer).option("checkpointLocation", checkpoint)
            .trigger(**(trigger or {"availableNow": True})).start())
