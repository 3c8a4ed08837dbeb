"""Splitting, capping, batching, repeating and shuffling of positioned tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def cap(df: DataFrame, n: int, pos: str = "pos") -> DataFrame:
    """The first ``n`` rows by position; -1, or more than there are, keeps all."""
    return df if n < 0 else df.filter(F.col(pos) < n)


def contiguous_slice(df: DataFrame, n: int, total: int | None = None, pos: str = "pos") -> DataFrame:
    """Adds ``slice``: ``n`` runs of ``total // n`` rows, the last one also takes the remainder."""
    total = df.count() if total is None else total
    size = total // n
    number = F.least(F.floor(F.col(pos) / F.lit(size)), F.lit(n - 1)) if size else F.lit(n - 1)
    return df.withColumn("slice", number.cast("int"))


def strided_slice(df: DataFrame, n: int, pos: str = "pos") -> DataFrame:
    """Adds ``slice``: row i belongs to slice i mod n."""
    return df.withColumn("slice", F.pmod(F.col(pos), F.lit(n)).cast("int"))


def chunked(df: DataFrame, bulk_size: int, pos: str = "pos", read_size: int | None = None) -> DataFrame:
    """Adds ``chunk_id``: consecutive bulks of ``bulk_size`` rows.

    With ``read_size`` a bulk also ends after every ``read_size`` rows.
    """
    at = F.col(pos)
    if read_size is None:
        return df.withColumn("chunk_id", F.floor(at / F.lit(bulk_size)).cast("bigint"))
    per_read = -(-read_size // bulk_size)
    read, inside = F.floor(at / F.lit(read_size)), at % F.lit(read_size)
    return df.withColumn("chunk_id", (read * per_read + F.floor(inside / F.lit(bulk_size))).cast("bigint"))


def write_batches(df: DataFrame, path: str, bulk_size: int) -> None:
    """Append to a Parquet table in files of at most ``bulk_size`` rows."""
    df.write.mode("append").option("maxRecordsPerFile", bulk_size).parquet(path)


def repeat(queries: DataFrame, times: int = 1) -> DataFrame:
    """Adds ``pass`` 0..times-1: every query once per pass."""
    return queries.withColumn("pass", F.explode(F.sequence(F.lit(0), F.lit(times - 1))))


#: Queries of one hash range of a random order.
RANGE_ROWS = 65_536


def shuffled(queries: DataFrame, passes: int = 1, seed: int = 42, client: int = 0, query_id: str = "query_id",
             bits: int | None = None) -> DataFrame:
    """Adds ``pass`` and ``order``: every pass asks all queries once, in its own seeded order.

    The order is that of a hash, which is uniform, so it is numbered in equal
    hash ranges: count per range, prefix sum over ranges, row number inside one.
    There are 2**bits ranges a pass, by default as many as keep one to some
    ``RANGE_ROWS`` queries; the order does not depend on it.
    """
    if bits is None:
        bits = max(6, (queries.count() // RANGE_ROWS).bit_length())
    mixed = F.xxhash64(F.lit(seed + client), F.col("pass"), F.col(query_id))
    drawn = repeat(queries, passes).withColumn("__hash", mixed)
    drawn = drawn.withColumn("__bucket", F.shiftrightunsigned("__hash", 64 - bits))
    counts = drawn.groupBy("pass", "__bucket").count()
    before = Window.partitionBy("pass").orderBy("__bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select("pass", "__bucket", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("__start"))
    inside = Window.partitionBy("pass", "__bucket").orderBy("__hash", query_id)
    return (drawn.withColumn("__place", F.row_number().over(inside) - 1)
            .join(F.broadcast(starts) if passes << bits <= 1_000_000 else starts, ["pass", "__bucket"])
            .withColumn("order", F.col("__start") + F.col("__place"))
            .drop("__hash", "__bucket", "__start", "__place"))


def last_write(df: DataFrame, id_col: str = "_id", order: str = "pos") -> DataFrame:
    """One row per id: the one with the highest ``order``.

    Spark limits each id to one row per task before the shuffle, so an id
    that holds much of the table does not meet in one task.
    """
    newest = Window.partitionBy(id_col).orderBy(F.col(order).desc())
    return df.withColumn("__n", F.row_number().over(newest)).filter(F.col("__n") == 1).drop("__n")
