"""Fixed-record vector files as a Spark data source.

A record is a little-endian int32 dimension followed by that many elements.
Files are split into record ranges, one Spark partition each; rows carry their
position over all files of a directory, taken in path order.
"""

from __future__ import annotations

import os
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import (
    DataSource,
    DataSourceArrowWriter,
    DataSourceReader,
    InputPartition,
    WriterCommitMessage,
)

from orbivec.functions.vectors import first_k
from orbivec.sources.files import list_files, open_fs

# File extension -> element type of the records.
ELEMENTS = {"fvec": "float", "fvecs": "float", "ivec": "int", "ivecs": "int", "bvec": "uint8", "bvecs": "uint8"}
# Element type -> (type on file, Spark column type, Arrow value type).
TYPES = {
    "float": ("<f4", "array<float>", pa.float32()),
    "int": ("<i4", "array<int>", pa.int32()),
    "uint8": ("u1", "array<smallint>", pa.int16()),
}
_PARTITION_BYTES = 64 * 1024 * 1024
_BATCH_BYTES = 8 * 1024 * 1024
_PROBES = 64


def element_of(path: str, elem: str | None = None) -> str:
    """Element type named by ``elem``, else by the file extension."""
    name = elem or ELEMENTS.get(os.path.splitext(path)[1].lstrip(".").lower())
    if name not in TYPES:
        raise ValueError(f"unknown vector file type: {elem or path}")
    return name


@dataclass
class Records(InputPartition):
    """Records ``[start, stop)`` of one file; ``stop`` of -1 reads rows of any length to the end."""

    path: str
    start: int
    stop: int
    dim: int
    first_pos: int


class VecsSource(DataSource):
    """``spark.read.format("vecs").load(path)`` -> ``(pos bigint, vector array)``.

    Options: ``elem`` (float, int, uint8), ``limit`` (rows; -1 for all),
    ``layout`` (``fixed``, ``ragged``, default by inspection), ``partitionBytes``.
    """

    @classmethod
    def name(cls) -> str:
        return "vecs"

    def _element(self) -> str:
        path = self.options["path"]
        elem = self.options.get("elem")
        if elem or os.path.splitext(path)[1]:
            return element_of(path, elem)
        files = list_files(path)
        if not files:
            raise FileNotFoundError(f"no vector files in {path}")
        return element_of(files[0][0])

    def schema(self) -> str:
        return f"pos bigint, vector {TYPES[self._element()][1]}"

    def reader(self, schema) -> DataSourceReader:
        return VecsReader(self.options, self._element())

    def writer(self, schema, overwrite: bool) -> DataSourceArrowWriter:
        return VecsWriter(self.options, schema, overwrite)


class VecsReader(DataSourceReader):
    def __init__(self, options, elem: str):
        self.path = options["path"]
        self.elem = elem
        self.limit = int(options.get("limit", -1))
        self.layout = options.get("layout", "auto")
        self.bytes = int(options.get("partitionbytes", options.get("partitionBytes", _PARTITION_BYTES)))
        self.width = np.dtype(TYPES[elem][0]).itemsize

    def partitions(self) -> list[InputPartition]:
        found, pos = [], 0
        files = list_files(self.path)
        if len(files) == 1 and files[0][1] < 4 and self.layout != "ragged":
            raise ValueError(f"{self.path}: no dimension header in an empty or corrupt file")
        for path, size in files:
            if size < 4 or 0 <= self.limit <= pos:
                continue
            dim, ragged = self._inspect(path, size)
            if ragged:
                if len(files) > 1:
                    raise ValueError("rows of different lengths in several files are read by sources.ragged.read_ragged")
                return [Records(path, 0, -1, 0, 0)]
            record = 4 + dim * self.width
            count = size // record
            if self.limit >= 0:
                count = min(count, self.limit - pos)
            step = max(1, self.bytes // record)
            for lo in range(0, count, step):
                found.append(Records(path, lo, min(lo + step, count), dim, pos + lo))
            pos += count
        return found or [Records("", 0, 0, 0, 0)]

    def _inspect(self, path: str, size: int) -> tuple[int, bool]:
        """Dimension of the first record, and whether later records differ in length."""
        system, inner = open_fs(path)
        with system.open_input_file(inner) as f:
            dim = int(np.frombuffer(f.read_at(4, 0), "<i4")[0])
            if self.layout != "auto":
                return dim, self.layout == "ragged"
            if dim < 1:
                raise ValueError(f"{path}: dimension {dim} in the first record")
            record = 4 + dim * self.width
            count = size // record
            probes = np.unique(np.linspace(0, max(count - 1, 0), _PROBES).astype(np.int64))
            dims = {int(np.frombuffer(f.read_at(4, int(i) * record), "<i4")[0]) for i in probes if count}
        return dim, len(dims) > 1

    def read(self, part: Records) -> Iterator[pa.RecordBatch]:
        if part.stop == 0:
            return
        if part.stop < 0:
            yield from self._read_ragged(part)
            return
        stored = np.dtype([("dim", "<i4"), ("v", TYPES[self.elem][0], (part.dim,))])
        step = max(1, _BATCH_BYTES // stored.itemsize)
        system, inner = open_fs(part.path)
        with system.open_input_file(inner) as f:
            for lo in range(part.start, part.stop, step):
                n = min(step, part.stop - lo)
                rows = np.frombuffer(f.read_at(n * stored.itemsize, lo * stored.itemsize), stored)
                if (rows["dim"] != part.dim).any():
                    raise ValueError(f"{part.path}: rows differ in length; read with option layout=ragged")
                first = part.first_pos + lo - part.start
                yield self._batch(first, np.ascontiguousarray(rows["v"]).reshape(-1), np.full(len(rows), part.dim))

    def _read_ragged(self, part: Records) -> Iterator[pa.RecordBatch]:
        system, inner = open_fs(part.path)
        pos, values, lengths, held = 0, [], [], 0
        with system.open_input_stream(inner) as f:
            while self.limit < 0 or pos + len(lengths) < self.limit:
                head = f.read(4)
                if len(head) < 4:
                    break
                n = int(np.frombuffer(head, "<i4")[0])
                body = f.read(n * self.width)
                if len(body) < n * self.width:
                    break
                values.append(np.frombuffer(body, TYPES[self.elem][0]))
                lengths.append(n)
                held += len(body)
                if held >= _BATCH_BYTES:
                    yield self._batch(pos, np.concatenate(values), np.array(lengths))
                    pos, values, lengths, held = pos + len(lengths), [], [], 0
        if lengths:
            yield self._batch(pos, np.concatenate(values), np.array(lengths))

    def _batch(self, first: int, flat: np.ndarray, lengths: np.ndarray) -> pa.RecordBatch:
        offsets = np.concatenate(([0], np.cumsum(lengths))).astype(np.int32)
        kind = TYPES[self.elem][2]
        vectors = pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat.astype(kind.to_pandas_dtype())))
        pos = pa.array(np.arange(first, first + len(lengths), dtype=np.int64))
        return pa.RecordBatch.from_arrays([pos, vectors], names=["pos", "vector"])


@dataclass
class Written(WriterCommitMessage):
    temporary: str
    final: str


class VecsWriter(DataSourceArrowWriter):
    """Writes one file per partition; files appear only when the whole job commits."""

    def __init__(self, options, schema, overwrite: bool):
        self.path = options["path"].rstrip("/")
        elem = options.get("elem", "float")
        if elem not in TYPES:
            raise ValueError(f"unknown element type: {elem}")
        self.stored = TYPES[elem][0]
        self.suffix = {"float": "fvecs", "int": "ivecs", "uint8": "bvecs"}[elem]
        if overwrite:
            raise ValueError("vector files are only written to a new directory, in append mode")

    def write(self, batches: Iterator[pa.RecordBatch]) -> WriterCommitMessage:
        from pyspark import TaskContext

        from orbivec.operators.scan import matrix

        task = TaskContext.get()
        name = f"part-{task.partitionId():05d}"
        temporary = f"{self.path}/_{name}-{task.taskAttemptId()}"
        system, inner = open_fs(temporary)
        system.create_dir(inner.rsplit("/", 1)[0], recursive=True)
        with system.open_output_stream(inner) as out:
            for batch in batches:
                x = matrix(batch.column(batch.schema.get_field_index("vector")), np.dtype(self.stored))
                rows = np.empty(len(x), np.dtype([("dim", "<i4"), ("v", self.stored, (x.shape[1],))]))
                rows["dim"], rows["v"] = x.shape[1], x
                out.write(rows.tobytes())
        return Written(temporary, f"{self.path}/{name}.{self.suffix}")

    def commit(self, messages) -> None:
        for m in messages:
            if m is not None:
                system, inner = open_fs(m.temporary)
                system.move(inner, open_fs(m.final)[1])

    def abort(self, messages) -> None:
        for m in messages:
            if m is not None:
                system, inner = open_fs(m.temporary)
                system.delete_file(inner)


def register(spark: SparkSession) -> None:
    """Make the ``vecs`` format known to a session."""
    spark.dataSource.register(VecsSource)


def read_vecs(spark: SparkSession, path: str, elem: str | None = None, limit: int = -1) -> DataFrame:
    """Vectors of a file or directory as ``(pos, vector)``.

    ``limit`` rows are read at most; -1, or more than there are, reads all.
    """
    register(spark)
    reader = spark.read.format("vecs").option("limit", limit)
    return (reader.option("elem", elem) if elem else reader).load(path)


def _any_ragged(path: str) -> bool:
    """Whether a file has rows of several lengths or ends within one, or files differ; full certainty is left to the readers."""
    first, probed, dims = VecsReader({"path": path, "layout": "fixed"}, "int"), VecsReader({"path": path}, "int"), set()
    for name, size in list_files(path):
        if size >= 4:
            dim, _ = first._inspect(name, size)
            if dim < 1 or size % (4 + 4 * dim) or probed._inspect(name, size)[1]:
                return True
            dims.add(dim)
    return len(dims) > 1


def read_ground_truth(spark: SparkSession, path: str, k: int) -> DataFrame:
    """Neighbour ids of an integer vector file as ``(query_idx, rank, doc_id)``, the first ``k`` per row.

    Rows may differ in length, in one or several files; an incomplete last row
    of a file is dropped.
    """
    from orbivec.sources.ragged import read_ragged

    rows = read_ragged(spark, path, "int") if _any_ragged(path) else read_vecs(spark, path, "int")
    at = F.posexplode(first_k(F.col("vector"), k)).alias("place", "doc_id")
    return rows.select(F.col("pos").alias("query_idx"), at).select(
        "query_idx", (F.col("place") + 1).alias("rank"), F.col("doc_id").cast("bigint").alias("doc_id"))
