"""Record files whose rows differ in length, read by many tasks over many files.

Where a record starts is only known from the records before it. So each file
is first walked from header to header by a task of its own, which notes where a
piece of some ``piece_bytes`` begins and how many records it has. This small
table gives every piece its first position over all files, and the pieces are
then read in parallel.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from orbivec.session import materialise
from orbivec.sources.files import exists, list_files, open_fs
from orbivec.sources.vecs import TYPES, element_of

PIECE_BYTES = 64 * 1024 * 1024
_BUFFER = 1024 * 1024
_BATCH_BYTES = 8 * 1024 * 1024
_INDEX = "file int, path string, start long, stop long, n long"


def record_index(spark: SparkSession, path: str, elem: str = "int", piece_bytes: int = PIECE_BYTES) -> DataFrame:
    """``(file, path, start, stop, n, first_pos)``: byte ranges of whole records, with the position of their first.

    Files count in path order. An incomplete last record of a file is dropped;
    files without a whole record have no piece. A negative length is an error
    that names file and byte.
    """
    width = np.dtype(TYPES[elem][0]).itemsize
    files = list_files(path)
    listed = pa.table({"file": pa.array(range(len(files)), pa.int32()), "path": pa.array([f for f, _ in files], pa.string()),
                       "size": pa.array([s for _, s in files], pa.int64())})

    def walk(batches):
        for batch in batches:
            for number, name, size in zip(*(batch.column(c).to_pylist() for c in ("file", "path", "size"))):
                pieces, start, at, n = [], 0, 0, 0
                system, inner = open_fs(name)
                with system.open_input_file(inner) as f:
                    held, first = b"", 0  # bytes of the file from ``first`` on
                    while at + 4 <= size:
                        if not first <= at <= first + len(held) - 4:
                            held, first = f.read_at(min(_BUFFER, size - at), at), at
                        length = int.from_bytes(held[at - first:at - first + 4], "little", signed=True)
                        if length < 0:
                            raise ValueError(f"{name}: length {length} of the record at byte {at}")
                        if at + 4 + length * width > size:
                            break
                        at, n = at + 4 + length * width, n + 1
                        if at - start >= piece_bytes:
                            pieces.append((start, at, n))
                            start, n = at, 0
                if n:
                    pieces.append((start, at, n))
                if pieces:
                    starts, stops, counts = zip(*pieces)
                    yield pa.RecordBatch.from_arrays([pa.array([number] * len(pieces), pa.int32()), pa.array([name] * len(pieces)), pa.array(starts, pa.int64()),
                                                      pa.array(stops, pa.int64()), pa.array(counts, pa.int64())], names=["file", "path", "start", "stop", "n"])

    rows = spark.createDataFrame(listed) if files else spark.createDataFrame([], "file int, path string, size long")
    pieces = materialise(rows.repartition(max(1, len(files)), "file").mapInArrow(walk, _INDEX), "pieces")
    # Positions: sums over files first, then over the pieces of a file.
    files_before = Window.orderBy("file").rowsBetween(Window.unboundedPreceding, -1)
    offsets = pieces.groupBy("file").agg(F.sum("n").alias("n")).select("file", F.coalesce(F.sum("n").over(files_before), F.lit(0)).alias("__file_pos"))
    before = Window.partitionBy("file").orderBy("start").rowsBetween(Window.unboundedPreceding, -1)
    placed = pieces.withColumn("__in_file", F.coalesce(F.sum("n").over(before), F.lit(0)))
    return placed.join(offsets, "file").select("file", "path", "start", "stop", "n", (F.col("__file_pos") + F.col("__in_file")).alias("first_pos"))


def read_ragged(spark: SparkSession, path: str, elem: str | None = None, piece_bytes: int = PIECE_BYTES) -> DataFrame:
    """``(pos, vector)`` of one file or a directory of files; rows may differ in length and be empty.

    A task reads a few pieces at most, however long the files are.
    """
    files = list_files(path)
    elem = elem or element_of(files[0][0] if files else path)
    stored, column, kind = TYPES[elem]
    width = np.dtype(stored).itemsize
    pieces = materialise(record_index(spark, path, elem, piece_bytes), "placed")
    parts = max(1, pieces.count())

    def batch_of(first, values, lengths):
        flat = np.concatenate(values).astype(kind.to_pandas_dtype())
        vectors = pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(lengths))).astype(np.int32)), pa.array(flat))
        return pa.RecordBatch.from_arrays([pa.array(np.arange(first, first + len(lengths), dtype=np.int64)), vectors], names=["pos", "vector"])

    def read(batches):
        for batch in batches:
            for name, start, stop, first in zip(*(batch.column(c).to_pylist() for c in ("path", "start", "stop", "first_pos"))):
                system, inner = open_fs(name)
                with system.open_input_file(inner) as f:
                    f.seek(start)
                    values, lengths, held, at = [], [], 0, start
                    while at < stop:
                        n = int.from_bytes(f.read(4), "little", signed=True)
                        values.append(np.frombuffer(f.read(n * width), stored))
                        lengths.append(n)
                        at, held = at + 4 + n * width, held + 4 + n * width
                        if held >= _BATCH_BYTES:
                            yield batch_of(first, values, lengths)
                            first, values, lengths, held = first + len(lengths), [], [], 0
                    if lengths:
                        yield batch_of(first, values, lengths)

    dealt = pieces.repartition(min(parts, 100_000), "first_pos")
    return dealt.mapInArrow(read, f"pos bigint, vector {column}")


def write_ragged(df: DataFrame, path: str, vector_col: str = "vector", elem: str = "int") -> None:
    """Write the rows of every partition, of any length each, in their order as one record file below ``path``.

    A file gets its name when it is complete; a task that is run again leaves it as it is. NULL lists are written as empty ones.
    """
    stored = TYPES[elem][0]
    suffix = {"float": "fvecs", "int": "ivecs", "uint8": "bvecs"}[elem]

    def write(batches):
        from pyspark import TaskContext

        task = TaskContext.get()
        name = f"part-{task.partitionId():05d}"
        system, temporary = open_fs(f"{path}/_{name}-{task.taskAttemptId()}")
        system.create_dir(temporary.rsplit("/", 1)[0], recursive=True)
        n = 0
        with system.open_output_stream(temporary) as out:
            for batch in batches:
                for row in batch.column(0):
                    values = np.asarray(row.as_py() or [], dtype=stored)
                    out.write(len(values).to_bytes(4, "little") + values.tobytes())
                    n += 1
        final = f"{path}/{name}.{suffix}"
        if exists(final):
            system.delete_file(temporary)
        else:
            system.move(temporary, open_fs(final)[1])
        yield pa.RecordBatch.from_arrays([pa.array([n], pa.int64())], names=["n"])

    df.select(vector_col).mapInArrow(write, "n long").agg(F.sum("n")).collect()
