"""Parquet corpora with stable row positions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Most file offsets that are broadcast; beyond it the join is left to Spark.
MAX_BROADCAST_FILES = 200_000
_MAX_NAMED_FILES = 1_000


def file_offsets(source: DataFrame) -> DataFrame:
    """``(file_path, first_pos)``: rows that precede each file, files in path order.

    Counts come from file metadata; only one row per file is ever sorted.
    """
    counts = source.select(F.col("_metadata.file_path").alias("file_path")).groupBy("file_path").count()
    before = Window.orderBy("file_path").rowsBetween(Window.unboundedPreceding, -1)
    return counts.select("file_path", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("first_pos"))


def with_positions(spark: SparkSession, path: str, limit: int = -1) -> DataFrame:
    """All columns of a Parquet table plus ``pos``, the row's position over all files.

    No sort and no shuffle of rows: position = rows in earlier files + row
    index inside the file. With a ``limit`` only the files holding the first
    rows are opened.
    """
    source = spark.read.parquet(path)
    offsets = file_offsets(source)
    if limit >= 0:
        needed = [r.file_path for r in offsets.filter(F.col("first_pos") < limit)
                  .orderBy("first_pos").limit(_MAX_NAMED_FILES + 1).collect()]
        if 0 < len(needed) <= _MAX_NAMED_FILES:
            source = source.filter(F.col("_metadata.file_path").isin(needed))  # prunes files; same source, same partition columns
    if len(source.inputFiles()) <= MAX_BROADCAST_FILES:
        offsets = F.broadcast(offsets)
    columns = source.columns
    placed = source.select(*columns, F.col("_metadata.file_path").alias("file_path"),
                           F.col("_metadata.row_index").alias("__row"))
    placed = placed.join(offsets, "file_path").select(
        (F.col("first_pos") + F.col("__row")).alias("pos"), *columns)
    return placed if limit < 0 else placed.filter(F.col("pos") < limit)


def read_corpus(spark: SparkSession, path: str, vector_field: str = "emb", columns=("title", "text"),
                limit: int = -1, positions: bool = True) -> DataFrame:
    """``([pos,] _id, <columns>, vector)`` of a Parquet corpus; only these columns are read.

    The id is ``_id``, else ``id``, as a string. ``limit`` keeps the first rows
    in file order; -1, or more than there are, keeps all.
    """
    source = with_positions(spark, path, limit) if positions or limit >= 0 else spark.read.parquet(path)
    names = [n for n in ("_id", "id") if n in source.columns]
    if not names:
        raise ValueError(f"{path} has neither '_id' nor 'id' column")
    pos = ["pos"] if positions else []
    return source.select(*pos, F.col(names[0]).cast("string").alias("_id"), *columns,
                         F.col(vector_field).alias("vector"))
