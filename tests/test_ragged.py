"""Record files of rows of different lengths: index, positions, parallel reads."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from orbivec.operators.slices import shuffled
from orbivec.sources.ragged import read_ragged, record_index, write_ragged
from orbivec.sources.vecs import read_ground_truth

rng = np.random.default_rng(3)


def record(values, kind="<i4"):
    return len(values).to_bytes(4, "little") + np.array(values, kind).tobytes()


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    """Four files: mixed lengths with a torn end, rows of one length, nothing, one very long row between empty ones."""
    path = tmp_path_factory.mktemp("ragged")
    rows = [[list(map(int, rng.integers(0, 99, n))) for n in lengths]
            for lengths in ([0, 3, 1, 7, 2] * 40, [4] * 30, [], [0, 600_000, 0])]
    for i, part in enumerate(rows):
        (path / f"part-{i}.ivecs").write_bytes(b"".join(map(record, part)) + (b"\x09\x00\x00\x00\x01" if i == 0 else b""))
    return str(path), [r for part in rows for r in part]


def test_rows_and_positions_over_several_files(spark, folder):
    path, want = folder
    for piece in (64, 1000, 2**26):
        got = read_ragged(spark, path, piece_bytes=piece).orderBy("pos").collect()
        assert [r.pos for r in got] == list(range(len(want)))
        assert [r.vector for r in got] == want


def test_pieces_hold_whole_records_and_are_read_by_many_tasks(spark, folder):
    path, want = folder
    pieces = record_index(spark, path, piece_bytes=200).orderBy("first_pos").collect()
    assert sum(p.n for p in pieces) == len(want) and len(pieces) > 10
    assert [p.first_pos for p in pieces] == np.cumsum([0] + [p.n for p in pieces[:-1]]).tolist()
    assert max(p.stop - p.start for p in pieces if p.file != 3) < 200 + 32
    assert read_ragged(spark, path, piece_bytes=200).select(F.spark_partition_id()).distinct().count() > 3


def test_truth_over_files(spark, folder):
    path, want = folder
    got = [(r.query_idx, r["rank"], r.doc_id) for r in read_ground_truth(spark, path, 2).orderBy("query_idx", "rank").collect()]
    assert got == [(i, j + 1, v) for i, row in enumerate(want) for j, v in enumerate(row[:2])]


def test_files_of_different_equal_lengths(spark, tmp_path):
    for i, n in enumerate((2, 3)):
        (tmp_path / f"{i}.ivecs").write_bytes(record(range(n)) * 2)
    got = read_ground_truth(spark, str(tmp_path), 9).groupBy("query_idx").count().orderBy("query_idx").collect()
    assert [tuple(r) for r in got] == [(0, 2), (1, 2), (2, 3), (3, 3)]


def test_nothing_to_read_and_bad_lengths(spark, tmp_path):
    (tmp_path / "a.ivecs").write_bytes(b"\x01")
    assert read_ragged(spark, str(tmp_path)).count() == 0
    (tmp_path / "b.ivecs").write_bytes(record([1]) + b"\xff\xff\xff\xff" + b"\0" * 8)
    with pytest.raises(Exception, match="length -1 of the record at byte 8"):
        read_ragged(spark, str(tmp_path)).collect()


def test_written_rows_come_back(spark, tmp_path):
    rows = [(i, None if i == 4 else [float(j) for j in range(i % 5)]) for i in range(20)]
    df = spark.createDataFrame(rows, "i int, vector array<double>").repartitionByRange(3, "i").sortWithinPartitions("i")
    write_ragged(df, f"{tmp_path}/out", elem="float")
    got = read_ragged(spark, f"{tmp_path}/out").orderBy("pos").collect()
    assert [list(r.vector) for r in got] == [v or [] for _, v in rows]


def test_random_order_does_not_depend_on_the_number_of_ranges(spark):
    queries = spark.range(500).withColumnRenamed("id", "query_id")
    few, many = (shuffled(queries, 2, bits=b).select("pass", "query_id", "order") for b in (None, 10))
    assert few.exceptAll(many).count() == 0 and many.filter("pass = 1").agg(F.countDistinct("order"), F.max("order")).first() == (500, 499)
