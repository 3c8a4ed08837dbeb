import numpy as np
import pytest
from pyspark.sql import functions as F

from orbivec.sources.bundle import Bundle
from orbivec.sources.corpus import read_corpus, with_positions
from orbivec.sources.synthetic import (clustered_queries, clustered_vectors, cluster_centers, expected_documents,
                                       expected_queries)
from orbivec.sources.vecs import read_ground_truth, read_vecs, register

from tests.conftest import plan


def records(x, kind):
    x = np.asarray(x)
    out = b""
    for row in x:
        out += np.int32(len(row)).tobytes() + np.asarray(row, kind).tobytes()
    return out


@pytest.mark.parametrize("ext,kind,sql", [("fvecs", "<f4", "array<float>"), ("ivecs", "<i4", "array<int>"),
                                          ("bvecs", "u1", "array<smallint>"), ("fvec", "<f4", "array<float>")])
def test_reads_every_element_type(spark, tmp_path, ext, kind, sql):
    x = np.arange(40).reshape(10, 4) * 6
    path = tmp_path / f"v.{ext}"
    path.write_bytes(records(x, kind))
    df = read_vecs(spark, str(path))
    assert df.schema["vector"].dataType.simpleString() == sql
    assert [(r.pos, list(r.vector)) for r in df.orderBy("pos").collect()] == [(i, list(r)) for i, r in enumerate(x)]


def test_splits_keep_positions(spark, tmp_path):
    x = np.random.default_rng(0).random((100, 3)).astype(np.float32)
    path = tmp_path / "v.fvecs"
    path.write_bytes(records(x, "<f4"))
    register(spark)
    df = spark.read.format("vecs").option("partitionBytes", 160).load(str(path))
    assert df.rdd.getNumPartitions() == 10
    got = df.orderBy("pos").collect()
    assert [r.pos for r in got] == list(range(100))
    assert np.array_equal(np.array([r.vector for r in got], np.float32), x)


def test_truncated_tail_and_limit(spark, tmp_path):
    path = tmp_path / "v.fvecs"
    path.write_bytes(records(np.ones((5, 3)), "<f4") + b"\x03\x00\x00\x00abc")
    assert read_vecs(spark, str(path)).count() == 5
    assert read_vecs(spark, str(path), limit=2).count() == 2
    assert read_vecs(spark, str(path), limit=99).count() == 5


def test_bad_files(spark, tmp_path):
    (tmp_path / "v.txt").write_bytes(b"abcd")
    (tmp_path / "empty.fvecs").write_bytes(b"")
    for name in ("v.txt", "empty.fvecs", "missing.fvecs"):
        with pytest.raises(Exception):
            read_vecs(spark, str(tmp_path / name)).collect()


def test_directory_is_read_in_path_order(spark, tmp_path):
    for name, lo in (("b", 3), ("a", 0)):
        (tmp_path / f"{name}.fvecs").write_bytes(records(np.arange(lo, lo + 3)[:, None], "<f4"))
    got = read_vecs(spark, str(tmp_path)).orderBy("pos").collect()
    assert [r.vector[0] for r in got] == [0, 1, 2, 3, 4, 5]
    assert read_vecs(spark, str(tmp_path), limit=4).count() == 4


def test_ground_truth_of_equal_and_of_different_lengths(spark, tmp_path):
    even, ragged = tmp_path / "e.ivec", tmp_path / "r.ivec"
    even.write_bytes(records([[5, 6, 7], [8, 9, 1]], "<i4"))
    ragged.write_bytes(b"".join(records([row], "<i4") for row in ([5], [6, 7, 8], [], [9, 1])) + b"\x09\x00\x00\x00\x01")
    got = [(r.query_idx, r["rank"], r.doc_id) for r in read_ground_truth(spark, str(even), 2).orderBy("query_idx", "rank").collect()]
    assert got == [(0, 1, 5), (0, 2, 6), (1, 1, 8), (1, 2, 9)]
    got = [(r.query_idx, r["rank"], r.doc_id) for r in read_ground_truth(spark, str(ragged), 2).orderBy("query_idx", "rank").collect()]
    assert got == [(0, 1, 5), (1, 1, 6), (1, 2, 7), (3, 1, 9), (3, 2, 1)]


def test_write_then_read(spark, tmp_path):
    register(spark)
    x = np.random.default_rng(2).random((50, 4)).astype(np.float32)
    rows = spark.createDataFrame([(i, [float(e) for e in v]) for i, v in enumerate(x)], "id bigint, vector array<float>")
    out = str(tmp_path / "out")
    rows.repartitionByRange(4, "id").sortWithinPartitions("id").select("vector").write.format("vecs").mode("append").save(out)
    got = read_vecs(spark, out).orderBy("pos").collect()
    assert np.array_equal(np.array([r.vector for r in got], np.float32), x)


def corpus_files(spark, tmp_path, id_name="_id"):
    rows = spark.range(100).select(
        F.col("id").alias(id_name), F.concat(F.lit("t"), "id").alias("title"), F.lit("words").alias("text"),
        F.array(F.col("id").cast("float")).alias("emb"), F.lit(1).alias("unused"))
    rows.repartitionByRange(5, id_name).sortWithinPartitions(id_name).write.parquet(str(tmp_path / "c"))
    return str(tmp_path / "c")


@pytest.mark.parametrize("id_name", ["_id", "id"])
def test_corpus(spark, tmp_path, id_name):
    path = corpus_files(spark, tmp_path, id_name)
    df = read_corpus(spark, path)
    assert df.columns == ["pos", "_id", "title", "text", "vector"]
    assert [(r.pos, r._id) for r in df.orderBy("pos").collect()] == [(i, str(i)) for i in range(100)]
    first = read_corpus(spark, path, limit=30)
    assert sorted(r.pos for r in first.collect()) == list(range(30))
    assert read_corpus(spark, path, limit=1000).count() == 100


def test_limit_opens_only_the_first_files(spark, tmp_path):
    path = corpus_files(spark, tmp_path)
    adaptive = spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        first = with_positions(spark, path, 10)
        assert sorted(r.pos for r in first.collect()) == list(range(10))
        leaves = first._jdf.queryExecution().executedPlan().collectLeaves()
        scans = [leaf for leaf in (leaves.apply(n) for n in range(leaves.size())) if leaf.metrics().contains("numFiles")]
        files = sorted(leaf.metrics().apply("numFiles").value() for leaf in scans)
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", adaptive)
    assert files[0] == 1 and all(n > 1 for n in files[1:])  # the rows come from one file, the counts from all


def test_corpus_without_id(spark, tmp_path):
    path = corpus_files(spark, tmp_path, "key")
    with pytest.raises(ValueError, match="neither"):
        read_corpus(spark, path)


def test_bundle(spark, tmp_path):
    train = spark.range(3).select(F.col("id").alias("pos"), F.array(F.lit(1.0)).alias("vector"))
    with pytest.raises(ValueError, match="test"):
        Bundle({"train": train})
    attrs = spark.range(1).select(F.lit("l2").alias("space_type"))
    Bundle({"train": train, "test": train, "neighbors": train}, attrs).write(str(tmp_path / "b"))
    back = Bundle.read(spark, str(tmp_path / "b"))
    assert sorted(back.tables) == ["neighbors", "test", "train"] and back.attrs.first().space_type == "l2"
    train.write.parquet(str(tmp_path / "half" / "train"))
    with pytest.raises(ValueError):
        Bundle.read(spark, str(tmp_path / "half"))


def test_synthetic_rows_do_not_depend_on_partitioning(spark):
    make = lambda slices: {r._id: (r.partition_id, tuple(r.vector)) for r in
                           clustered_vectors(spark, 3000, dims=6, centers=20, partitions=3, slices=slices).collect()}
    one, seven = make(1), make(7)
    assert one == seven and len(one) == 3000 and {int(i) for i in one} == set(range(3000))
    assert {p for p, _ in one.values()} == {0, 1, 2, 3}


def test_synthetic_clusters(spark):
    rows = clustered_vectors(spark, 4000, dims=6, centers=20, std=0.5).collect()
    x = np.array([r.vector for r in rows])
    middle = cluster_centers(6, 20)
    assert middle.min() >= 0 and middle.max() < 100
    d = np.linalg.norm(x[:, None] - middle[None], axis=2)
    used = np.bincount(d.argmin(1), minlength=20)
    assert used.min() > 130 and abs((x - middle[d.argmin(1)]).std() - 0.5) < 0.02
    q = np.array([r.vector for r in clustered_queries(spark, 500, dims=6, centers=20).collect()])
    assert np.linalg.norm(q[:, None] - middle[None], axis=2).min(1).max() < 4
    assert not np.allclose(q, x[:500])
    other = clustered_vectors(spark, 10, dims=6, centers=20, seed=7).collect()
    assert not np.allclose([r.vector for r in other], x[:10])


def test_expected_counts():
    assert expected_documents(2, 5, 100) == 1000 and expected_queries(3, 7) == 21
