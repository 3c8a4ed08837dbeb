"""Where jobs may put shared intermediate data."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile

from pyspark.sql import DataFrame, SparkSession

_CHECKPOINT_DIR = "spark.checkpoint.dir"
_local_dirs: dict[str, str] = {}  # per application on a local master


def shared_dir(spark: SparkSession) -> str:
    """The folder every executor can reach, as named in ``spark.checkpoint.dir``.

    A machine-local temporary folder is only used on a local master, where it
    is the shared folder; on a cluster a missing setting is an error.
    """
    named = spark.conf.get(_CHECKPOINT_DIR, None)
    if not named:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError(f"set {_CHECKPOINT_DIR} to a folder all executors can reach")
        application = spark.sparkContext.applicationId
        if application not in _local_dirs:
            _local_dirs[application] = tempfile.mkdtemp(prefix="orbivec-")
        named = _local_dirs[application]
    return named.rstrip("/")


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path below the shared folder."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


#: Writer options for tables whose rows hold long lists. A task decodes a row group as a whole, and a group is by default
#: not looked at before its hundredth row.
LONG_ROWS = {"parquet.block.size": str(8 * 1024 * 1024), "parquet.block.size.row.check.min": "1", "parquet.page.size.row.check.min": "1"}


def materialise(df: DataFrame, name: str, **options: str) -> DataFrame:
    """Write ``df`` below the shared folder, with these writer options, and read it back.

    Cuts lineage in storage that outlives any executor, and lets several
    readers use one computation.
    """
    path = scratch_path(df.sparkSession, name)
    df.write.options(**options).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def ship(spark: SparkSession) -> None:
    """Make this package importable in Python workers, wherever the driver was started.

    Not needed when the package is installed on the cluster or passed with ``--py-files``.
    """
    context = spark.sparkContext
    if any(os.path.basename(f) == "orbivec.zip" for f in context.listFiles):
        return
    root = os.path.dirname(os.path.abspath(__file__))
    path = os.path.join(tempfile.mkdtemp(prefix="orbivec-"), "orbivec.zip")
    with zipfile.ZipFile(path, "w") as archive:
        for folder, _, names in os.walk(root):
            for name in names:
                if name.endswith(".py"):
                    full = os.path.join(folder, name)
                    archive.write(full, os.path.relpath(full, os.path.dirname(root)))
    context.addPyFile(path)


#: A table up to this many rows may be spread over all cores by a shuffle.
SPREAD_ROWS = 2_000_000


def spread(df: DataFrame) -> DataFrame:
    """Use all cores for a small table that lies in fewer files than there are cores.

    Larger tables keep their own splits; they are never shuffled for this.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    if len(df.inputFiles()) < cores and df.count() <= SPREAD_ROWS:
        return df.repartition(cores)
    return df
