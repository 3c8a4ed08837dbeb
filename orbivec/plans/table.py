"""A vector table kept by id: upserts, appends and compaction over Parquet directories.

Layout below the root::

    log/                 one row per committed base version
    base/v=<n>/          rows with unique ids
    delta/v=<n>/seq=<m>/token=<t>/   writes since that base, in order

An upsert writes its own rows only. Readers drop base rows whose id was
written again. ``compact`` folds the upserts into a new base and makes it
current by appending to the log, so readers never see a half-written version.
One writer at a time.
"""

from __future__ import annotations

import uuid

from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from orbivec.operators.slices import last_write
from orbivec.sources.files import exists, is_complete, list_files, open_fs

#: Most changed ids that are broadcast to the base scan.
MAX_BROADCAST_IDS = 5_000_000
#: Rows of one shard when the caller does not say how many shards there are.
ROWS_PER_SHARD = 1_000_000

_ORDER = "__order"
_SEQ = "seq"


class VectorTable:
    def __init__(self, spark: SparkSession, root: str, id_col: str = "_id"):
        self.spark, self.root, self.id_col = spark, root.rstrip("/"), id_col

    # -- versions ----------------------------------------------------------

    def version(self) -> int:
        """Number of the current base; 0 before the first compaction or append."""
        if not exists(f"{self.root}/log"):
            return 0
        return self.spark.read.parquet(f"{self.root}/log").agg(F.max("version")).first()[0]

    def _base(self, version: int) -> DataFrame | None:
        path = f"{self.root}/base/v={version}"
        return self.spark.read.parquet(path) if is_complete(path) else None

    def _writes(self, version: int) -> list[tuple[int, str]]:
        """(sequence, token) of every finished write since a base, oldest first."""
        path = f"{self.root}/delta/v={version}"
        if not exists(path):
            return []
        system, inner = open_fs(path)
        found = []
        for f in system.get_file_info(fs.FileSelector(inner, recursive=True)):
            if f.base_name == "_SUCCESS":
                seq, token = f.path.split("/")[-3:-1]
                found.append((int(seq.split("=")[1]), token.split("=")[1]))
        return sorted(found)

    def _deltas(self, version: int) -> DataFrame | None:
        path = f"{self.root}/delta/v={version}"
        found = self._writes(version)
        if not found:
            return None
        return (self.spark.read.option("basePath", path).option("mergeSchema", "true")
                .parquet(*[f"{path}/seq={n}/token={t}" for n, t in found]))

    # -- reading -----------------------------------------------------------

    def read(self) -> DataFrame:
        """The current rows, one per id: the last write wins."""
        version = self.version()
        base, deltas = self._base(version), self._deltas(version)
        if deltas is None:
            if base is None:
                raise FileNotFoundError(self.root)
            return base
        order = F.struct(F.col(_SEQ), F.col(_ORDER))
        newest = last_write(deltas.withColumn("__written", order), self.id_col, "__written")
        newest = newest.drop("__written", _SEQ, "token", _ORDER)
        if base is None:
            return newest
        ids = deltas.select(self.id_col)
        small = deltas.count() <= MAX_BROADCAST_IDS
        kept = base.join(F.broadcast(ids) if small else ids, self.id_col, "left_anti")
        return kept.unionByName(newest, allowMissingColumns=True)

    # -- writing -----------------------------------------------------------

    def upsert(self, rows: DataFrame, order: str | None = None, token: str | None = None) -> None:
        """Write rows by id. Among rows of one id the highest ``order`` wins.

        Repeating a write under the same ``token`` replaces it, so a replayed
        micro-batch changes nothing.
        """
        written = rows.withColumn(_ORDER, F.col(order).cast("bigint") if order else F.lit(0).cast("bigint"))
        self._write(last_write(written, self.id_col, _ORDER), token)

    def append(self, rows: DataFrame, token: str | None = None) -> None:
        """Write rows under new generated ids; existing rows are never replaced."""
        self._write(rows.withColumn(self.id_col, F.uuid()).withColumn(_ORDER, F.lit(0).cast("bigint")), token)

    def _write(self, rows: DataFrame, token: str | None) -> None:
        version = self.version()
        done = self._writes(version)
        sequence = next((n for n, t in done if t == token), done[-1][0] + 1 if done else 0)
        path = f"{self.root}/delta/v={version}/seq={sequence}/token={token or uuid.uuid4().hex}"
        rows.write.mode("overwrite").parquet(path)

    def compact(self, segments: int = 1, shards: int | None = None, cluster_by: str | None = None) -> int:
        """Fold all upserts into a new base of at most ``segments`` files per shard.

        Shards are id ranges of a hash, sized to about a million rows unless
        given, so no task ever writes the whole table. ``cluster_by`` keeps
        rows of one cell together instead; large cells are split by Spark.
        """
        rows, version = self.read(), self.version() + 1
        if cluster_by:
            laid_out = rows.hint("rebalance", F.col(cluster_by))
        else:
            if shards is None:
                shards = max(1, -(-rows.count() // ROWS_PER_SHARD))
            laid_out = rows.repartition(shards * segments, self.id_col)
        laid_out.write.mode("overwrite").parquet(f"{self.root}/base/v={version}")
        self.spark.range(1, numPartitions=1).select(F.lit(version).alias("version"), F.current_timestamp().alias("at")) \
            .write.mode("append").parquet(f"{self.root}/log")
        return version

    def base_files(self) -> int:
        return len([p for p, _ in list_files(f"{self.root}/base/v={self.version()}") if p.endswith(".parquet")])
