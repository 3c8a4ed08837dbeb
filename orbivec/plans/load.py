"""From source rows to a searchable table, and artifacts that are built once."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from orbivec.operators.gate import gate
from orbivec.plans.table import VectorTable
from orbivec.sources.files import exists, is_complete


def build_table(source: DataFrame, root: str, schema: T.StructType, dim: int, *, strict: bool = True,
                id_col: str = "_id", order: str | None = "pos", generate_ids: bool = False,
                rejects: str | None = None, segments: int = 1) -> VectorTable:
    """Check, write and compact a source into a new table at ``root``.

    Rows are written by id (the last one by ``order`` wins) or, with
    ``generate_ids``, under new ids. Rejected rows go to the Parquet directory
    ``rejects`` when one is named. An existing table is an error.
    """
    if exists(root):
        raise FileExistsError(root)
    wanted = schema
    if order and order in source.columns and order not in schema.fieldNames():
        wanted = T.StructType(schema.fields + [source.schema[order]])
    accepted, rejected = gate(source, wanted, dim, strict)
    table = VectorTable(source.sparkSession, root, id_col)
    if generate_ids:
        table.append(accepted)
    else:
        table.upsert(accepted, order if order in accepted.columns else None)
    if rejects:
        rejected.write.parquet(rejects)
    table.compact(segments)
    return table


def ground_truth_or_build(spark: SparkSession, path: str, build: Callable[[], DataFrame]) -> DataFrame:
    """Read the artifact at ``path`` if a finished one exists, else build and write it."""
    if not is_complete(path):
        build().write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def load_ground_truth(spark: SparkSession, path: str) -> DataFrame:
    """Read an artifact that must exist."""
    if not is_complete(path):
        raise FileNotFoundError(f"no finished ground truth at {path}; build it first")
    return spark.read.parquet(path)
