import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from orbivec.operators import slices
from orbivec.operators.gate import REASON, gate, gate_json
from orbivec.plans.load import build_table, ground_truth_or_build, load_ground_truth
from orbivec.plans.table import VectorTable
from tests.conftest import plan

VECTOR = T.ArrayType(T.FloatType())
MAPPING = T.StructType([T.StructField("_id", T.StringType()), T.StructField("vector", VECTOR)])


def rows(spark, *pairs, schema="_id string, v int"):
    return spark.createDataFrame(list(pairs), schema)


def contents(df):
    return {r._id: r.v for r in df.collect()}


def test_last_write_wins_across_and_within_writes(spark, tmp_path):
    t = VectorTable(spark, str(tmp_path / "t"))
    t.upsert(rows(spark, ("a", 1), ("b", 1)))
    t.upsert(rows(spark, ("b", 2), ("c", 2)))
    assert contents(t.read()) == {"a": 1, "b": 2, "c": 2}
    many = rows(spark, ("a", 5, 0), ("a", 6, 2), ("a", 7, 1), schema="_id string, v int, pos int")
    t.upsert(many, order="pos")
    assert {r._id: r.v for r in t.read().collect()}["a"] == 6


def test_compaction_keeps_contents_and_later_writes(spark, tmp_path):
    t = VectorTable(spark, str(tmp_path / "t"))
    t.upsert(rows(spark, *[(str(i), i) for i in range(50)]))
    t.upsert(rows(spark, ("3", -3)))
    want = contents(t.read())
    assert t.compact(segments=1) == 1
    assert contents(t.read()) == want and t.base_files() == 1
    t.upsert(rows(spark, ("4", -4), ("new", 0)))
    assert contents(t.read()) == {**want, "4": -4, "new": 0}
    t.compact(segments=2, shards=2)
    assert contents(t.read()) == {**want, "4": -4, "new": 0} and t.base_files() <= 4


def test_repeated_token_replaces_its_own_write_only(spark, tmp_path):
    t = VectorTable(spark, str(tmp_path / "t"))
    t.upsert(rows(spark, ("a", 1)), token="s-0")
    t.upsert(rows(spark, ("b", 1)))
    t.upsert(rows(spark, ("a", 2)), token="s-0")
    assert contents(t.read()) == {"a": 2, "b": 1}
    t.upsert(rows(spark, ("b", 3)), token="s-1")
    assert contents(t.read()) == {"a": 2, "b": 3}


def test_append_generates_ids(spark, tmp_path):
    t = VectorTable(spark, str(tmp_path / "t"))
    t.append(spark.range(20).select(F.lit(1).alias("v")))
    t.append(spark.range(20).select(F.lit(1).alias("v")))
    assert t.read().select("_id").distinct().count() == 40


def test_unfinished_base_is_ignored(spark, tmp_path):
    t = VectorTable(spark, str(tmp_path / "t"))
    t.upsert(rows(spark, ("a", 1)))
    rows(spark, ("z", 9)).write.parquet(str(tmp_path / "t/base/v=1"))  # written, never committed to the log
    assert contents(t.read()) == {"a": 1}
    with pytest.raises(FileNotFoundError):
        VectorTable(spark, str(tmp_path / "none")).read()


def test_hot_id_is_cut_before_the_shuffle(spark):
    hot = spark.range(1000).select(F.when(F.col("id") < 400, "hot").otherwise(F.col("id").cast("string")).alias("_id"),
                                   F.col("id").alias("pos"))
    out = slices.last_write(hot)
    assert {r._id: r.pos for r in out.collect()}["hot"] == 399 and out.count() == 601
    assert "WindowGroupLimit" in plan(out)


def test_gate(spark):
    v = F.array(F.lit(1.0), F.lit(2.0)).cast(VECTOR)
    df = spark.range(5).select(
        F.col("id").cast("string").alias("_id"),
        F.when(F.col("id") == 1, F.slice(v, 1, 1)).when(F.col("id") != 2, v).alias("vector"),
        F.when(F.col("id") == 3, 9).alias("partition_id"))
    good, bad = gate(df, MAPPING, 2)
    assert good.columns == ["_id", "vector"] and sorted(r._id for r in good.collect()) == ["0", "4"]
    assert {r._id: r[REASON] for r in bad.collect()} == {
        "1": "wrong dimension", "2": "missing vector", "3": "unknown field partition_id"}
    good, bad = gate(df, MAPPING, 2, strict=False)
    assert good.columns == ["_id", "vector", "partition_id"] and good.count() == 3 and bad.count() == 2


def test_gate_fills_missing_fields(spark):
    wider = T.StructType(MAPPING.fields + [T.StructField("color", T.StringType())])
    df = spark.range(1).select(F.lit("a").alias("_id"), F.array(F.lit(1.0)).alias("vector"))
    good, _ = gate(df, wider, 1)
    assert good.schema["vector"].dataType == VECTOR and good.first().color is None


def test_gate_json(spark):
    lines = ['{"_id": "a", "vector": [1, 2]}', '{"_id": "b", "vector": [1, 2], "partition_id": 3}', "{oops",
             '{"_id": "c", "vector": [1]}', '{"_id": "d"}']
    df = spark.createDataFrame([(line,) for line in lines], "line string")
    good, bad = gate_json(df, "line", MAPPING, 2)
    assert [r._id for r in good.collect()] == ["a"]
    assert sorted(r[REASON] for r in bad.collect()) == ["malformed", "missing vector", "unknown field partition_id", "wrong dimension"]
    good, _ = gate_json(df, "line", MAPPING, 2, strict=False)
    assert {r._id: r.extra for r in good.collect()} == {"a": {}, "b": {"partition_id": "3"}}


def test_gate_json_rejects_values_of_a_wrong_type(spark):
    mapping = T.StructType([T.StructField("_id", T.LongType()), T.StructField("vector", VECTOR), T.StructField("age", T.IntegerType())])
    lines = ['{"_id": 1, "vector": [1, 2], "age": 7}', '{"_id": 2, "vector": [1, 2], "age": "seven"}', '{"_id": "x", "vector": [1, 2]}',
             '{"_id": 4, "vector": [1, 2], "age": null}', '{"_id": 5, "vector": [1, "a"], "age": 1}', '{"_id": 6, "vector": "none"}']
    good, bad = gate_json(spark.createDataFrame([(line,) for line in lines], "line string"), "line", mapping, 2)
    assert sorted(r._id for r in good.collect()) == [1, 4]
    reasons = {r.line: r[REASON] for r in bad.collect()}
    assert reasons[lines[1]] == "invalid value age" and reasons[lines[2]] == "invalid value _id" and len(reasons) == 4


@pytest.mark.parametrize("total,n", [(10, 3), (9, 3), (2, 5), (1, 1)])
def test_contiguous_slices(spark, total, n):
    got = {r.pos: r.slice for r in slices.contiguous_slice(spark.range(total).withColumnRenamed("id", "pos"), n).collect()}
    size = total // n
    want = {p: min(p // size, n - 1) if size else n - 1 for p in range(total)}
    assert got == want


def test_strides_caps_and_bulks(spark):
    df = spark.range(25).withColumnRenamed("id", "pos")
    assert {r.pos: r.slice for r in slices.strided_slice(df, 4).collect()} == {p: p % 4 for p in range(25)}
    assert [slices.cap(df, n).count() for n in (-1, 0, 7, 99)] == [25, 0, 7, 25]
    bulks = slices.chunked(df, 4, read_size=10).groupBy("chunk_id").count().collect()
    assert sorted(r["count"] for r in bulks) == [1, 2, 2, 4, 4, 4, 4, 4]


def test_write_batches(spark, tmp_path):
    slices.write_batches(spark.range(25).coalesce(1), str(tmp_path / "b"), 10)
    assert len(spark.read.parquet(str(tmp_path / "b")).inputFiles()) == 3


def test_shuffled(spark):
    q = spark.range(100).withColumnRenamed("id", "query_id")
    orders = {}
    for client in (0, 1):
        got = slices.shuffled(q, 2, client=client).orderBy("pass", "order").collect()
        for p in (0, 1):
            mine = [(r.order, r.query_id) for r in got if r["pass"] == p]
            assert [o for o, _ in mine] == list(range(100)) and {i for _, i in mine} == set(range(100))
            orders[client, p] = tuple(i for _, i in mine)
    assert len(set(orders.values())) == 4
    again = slices.shuffled(q.repartition(5), 1).orderBy("order").collect()
    assert tuple(r.query_id for r in again) == orders[0, 0]


def test_build_table(spark, tmp_path):
    v = F.array(F.col("id").cast("float"), F.lit(0.0))
    source = spark.range(20).select((F.col("id") % 10).cast("string").alias("_id"), F.col("id").alias("pos"),
                                    F.when(F.col("id") != 13, v).alias("vector"))
    t = build_table(source, str(tmp_path / "t"), MAPPING, 2, rejects=str(tmp_path / "r"))
    got = {r._id: r.vector[0] for r in t.read().collect()}
    assert got == {str(i): (i + 10.0 if i != 3 else 3.0) for i in range(10)}
    assert spark.read.parquet(str(tmp_path / "r")).count() == 1
    with pytest.raises(FileExistsError):
        build_table(source, str(tmp_path / "t"), MAPPING, 2)


def test_ground_truth_is_built_once(spark, tmp_path):
    path, calls = str(tmp_path / "gt"), []

    def build():
        calls.append(1)
        return spark.range(3)

    with pytest.raises(FileNotFoundError):
        load_ground_truth(spark, path)
    assert ground_truth_or_build(spark, path, build).count() == 3
    assert ground_truth_or_build(spark, path, build).count() == 3 and calls == [1]
    assert load_ground_truth(spark, path).count() == 3
