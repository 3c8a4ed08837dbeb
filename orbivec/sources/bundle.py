"""A corpus, its queries and their known neighbours, kept as one directory of Parquet tables."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from orbivec.sources.files import is_complete, open_fs

# Tables a bundle must and may have.
REQUIRED = ("train", "test")
OPTIONAL = ("neighbors", "distances", "radial_neighbors")


@dataclass
class Bundle:
    """``tables[name]`` for ``train (pos, vector)``, ``test (query_idx, vector)``,
    ``neighbors (query_idx, ids)``, ``distances (query_idx, distances)``; ``attrs`` is a one-row table."""

    tables: dict[str, DataFrame]
    attrs: DataFrame | None = None

    def __post_init__(self):
        missing = [n for n in REQUIRED if n not in self.tables]
        if missing:
            raise ValueError(f"bundle lacks {missing}")

    def __getitem__(self, name: str) -> DataFrame:
        return self.tables[name]

    def __contains__(self, name: str) -> bool:
        return name in self.tables

    @classmethod
    def read(cls, spark: SparkSession, path: str) -> Bundle:
        root = path.rstrip("/")
        names = _tables(root)
        tables = {n: spark.read.parquet(f"{root}/{n}") for n in names if n != "attrs"}
        attrs = spark.read.parquet(f"{root}/attrs") if "attrs" in names else None
        return cls(tables, attrs)

    def write(self, path: str) -> None:
        root = path.rstrip("/")
        for name, table in self.tables.items():
            table.write.parquet(f"{root}/{name}")
        if self.attrs is not None:
            self.attrs.write.parquet(f"{root}/attrs")


def _tables(root: str) -> list[str]:
    from pyarrow import fs

    system, inner = open_fs(root)
    found = system.get_file_info(fs.FileSelector(inner))
    names = [f.base_name for f in found if f.type == fs.FileType.Directory]
    return [n for n in sorted(names) if is_complete(f"{root}/{n}")]
