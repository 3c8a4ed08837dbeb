import numpy as np
import pytest
from pyspark.sql import functions as F

from orbivec import distance_to_score, knn, radial
from orbivec.operators import truth as tr
from orbivec.operators.metrics import query_recall, radial_recall, recall, run_metrics
from orbivec.operators.quantiles import exact_quantiles
from orbivec.sources.bundle import Bundle
from tests.brute import hits_of, nearest, table

rng = np.random.default_rng(6)
X = (rng.normal(size=(200, 6)) * rng.integers(1, 4, (200, 1))).astype(np.float32)
Q = rng.normal(size=(25, 6)).astype(np.float32)


@pytest.mark.parametrize("n", [1, 2, 7, 1000])
def test_quantiles_with_a_hot_value(spark, n):
    values = np.round(rng.normal(size=n), 3)
    values[: n // 3] = 0.5
    df = spark.createDataFrame([(float(v),) for v in values] + [(None,)], "v double").repartition(4)
    probs = {"a": 0.0, "b": 0.1, "c": 0.5, "d": 0.999, "e": 1.0}
    got = exact_quantiles(df, "v", probs).first()
    assert np.allclose([got[k] for k in probs], np.quantile(values, list(probs.values())))


def test_quantiles_per_group(spark):
    rows = [(g, float(v)) for g, size in (("a", 500), ("b", 3), ("c", 1)) for v in rng.random(size)]
    got = {r.g: r.m for r in exact_quantiles(spark.createDataFrame(rows, "g string, v double"), "v", {"m": 0.5}, ["g"]).collect()}
    assert got == pytest.approx({g: np.median([v for h, v in rows if h == g]) for g in "abc"})
    assert exact_quantiles(spark.createDataFrame([], "v double"), "v", {"m": 0.5}).first() in (None, (None,))


def positioned(spark):
    rows = table(spark, X).withColumn("pos", F.col("_id")).withColumn("_id", (F.col("_id") % 150).cast("string"))
    return rows.withColumn("text", F.concat(F.lit("t"), "pos"))


def test_sampled_queries(spark):
    q = {r.query_id: r for r in tr.sample_queries(positioned(spark), 170).collect()}
    assert len(q) == 150 and q["5"].text == "t155" and q["25"].text == "t25"
    assert np.linalg.norm(q["5"].vector) == pytest.approx(1.0)
    assert np.allclose(q["5"].vector, X[155] / np.linalg.norm(X[155]))


def test_ground_truth(spark):
    rows = table(spark, X).withColumn("pos", F.col("_id"))
    truth = tr.build_ground_truth(rows, 30, 7)
    unit = X.astype(float) / np.linalg.norm(X.astype(float), axis=1)[:, None]
    want = {i: [w[0] for w in row] for i, row in enumerate(nearest(unit[:30], unit, range(200), 7, "innerproduct"))}
    assert hits_of(truth) == want
    assert all(v[0] == q for q, v in want.items())
    few = table(spark, X[:4]).withColumn("pos", F.col("_id"))
    assert tr.build_ground_truth(few, 10, 100).count() == 16


def test_zero_vector_in_ground_truth(spark):
    x = np.array([[1, 0], [0, 0], [-1, 0]], np.float32)
    truth = tr.build_ground_truth(table(spark, x).withColumn("pos", F.col("_id")), 1, 3)
    assert hits_of(truth) == {0: [0, 1, 2]}


def test_attached_truth(spark):
    queries = table(spark, Q, name="query_id")
    hits = knn(table(spark, X), queries.filter("query_id < 20"), 5)
    got = {r.query_id: r.neighbors for r in tr.attach_truth(queries, hits, 3).collect()}
    want = hits_of(hits)
    assert got == {q: want[q][:3] if q in want else [] for q in range(25)}


def bundle(spark, *keys):
    train = table(spark, X, name="pos")
    test = table(spark, Q, name="query_idx")
    hits = knn(train, test, 10, "l2", id_col="pos", query_id="query_idx")
    tables = {"train": train, "test": test}
    if "neighbors" in keys:
        tables["neighbors"] = tr.as_arrays(hits, "pos").withColumnRenamed("query_id", "query_idx")
    if "distances" in keys:
        tables["distances"] = tr.as_arrays(hits, "pos", "distances", "distance").withColumnRenamed("query_id", "query_idx")
    return Bundle(tables)


def test_auto_threshold(spark):
    radii = [row[-1][1] for row in nearest(Q, X, range(200), 10, "l2")]
    for keys in (("neighbors", "distances"), ("distances",), ("neighbors",)):
        got = tr.auto_threshold(bundle(spark, *keys), "l2").first()
        assert tuple(got) == pytest.approx((min(radii), np.median(radii), max(radii)))
    sampled = tr.auto_threshold(bundle(spark, "neighbors"), "l2", sample=7).first()
    assert sampled.median_radius == pytest.approx(np.median(radii[:7]))
    with pytest.raises(ValueError, match="explicitly"):
        tr.auto_threshold(bundle(spark), "l2")


def test_threshold_note(spark):
    r = spark.range(1).select(*[tr.compare_threshold(F.lit(t), F.lit(1.0)).alias(n) for n, t in (("a", 2.0), ("b", 0.5), ("c", 1.0))]).first()
    assert tuple(r) == ("looser", "tighter", "equal")


def test_radial_truth(spark, tmp_path):
    b = bundle(spark, "distances")
    built = tr.build_radial_truth(b, "l2", width=12)
    built.write(str(tmp_path / "b"))
    back = Bundle.read(spark, str(tmp_path / "b"))
    limit = np.median([row[-1][1] for row in nearest(Q, X, range(200), 10, "l2")])
    a = back.attrs.first()
    assert a.max_distance_threshold == pytest.approx(limit)
    assert a.min_score_threshold == pytest.approx(distance_to_score(limit, "l2")) and a.space_type == "l2"
    want = [[w[0] for w in row][:12] for row in nearest(Q, X, range(200), 10_000, "l2", limit + 1e-9)]
    got = {r.query_idx: r.ids for r in back["radial_neighbors"].collect()}
    assert got == {i: row + [-1] * (12 - len(row)) for i, row in enumerate(want)}
    assert sorted(back.tables) == ["distances", "radial_neighbors", "test", "train"]


def test_neighbour_stats(spark):
    hits = spark.createDataFrame([(0, 1), (0, 2), (0, 3), (1, 5)], "query_id bigint, _id bigint")
    s = tr.neighbour_stats(hits, spark.range(4).withColumnRenamed("id", "query_id")).first()
    assert tuple(s) == (1.0, 0.5, 0, 3, 2)


def ranked(spark, lists):
    return spark.createDataFrame([(q, i, r + 1) for q, ids in lists.items() for r, i in enumerate(ids)],
                                 "query_id bigint, _id bigint, rank int")


def test_recall(spark):
    truth = ranked(spark, {0: [1, 2, 3, 4], 1: [5, 6, 7, 8], 2: [9], 3: [1, 2, 3, 4]})
    hits = ranked(spark, {0: [1, 3, 9, 2], 1: [6, 5, 7, 8], 2: [9, 1]})
    each = {r.query_id: (r.recall_k, r.recall_1) for r in query_recall(hits, truth, 3).collect()}
    assert each == {0: (2 / 3, 1.0), 1: (1.0, 0.0), 2: (1.0, 1.0), 3: (0.0, 0.0)}
    rows = {r.metric: r.value for r in recall(hits, truth, 3).collect()}
    assert rows == pytest.approx({"Mean recall@k": (2 / 3 + 2) / 4, "Mean recall@1": 0.5})


def test_radial_recall(spark):
    truth = spark.createDataFrame([(0, [1, 2, -1]), (1, [3, -1, -1]), (2, [-1, -1, -1]), (3, [-1, -1, -1])], "query_id bigint, ids array<bigint>")
    hits = ranked(spark, {0: [1, 8], 2: [4]})
    queries = spark.range(4).withColumnRenamed("id", "query_id")
    assert radial_recall(hits, truth, queries).first().value == (0.5 + 0 + 0 + 1) / 4
    long = truth.select("query_id", F.explode("ids").alias("_id")).filter("_id <> -1")
    assert radial_recall(hits, long, queries).first().value == 0.375


def test_recall_of_exact_search_is_one(spark):
    corpus, queries = table(spark, X), table(spark, Q, name="query_id")
    hits = radial(corpus, queries, "l2", max_distance=10.0)
    assert radial_recall(hits, hits, queries).first().value == 1.0
    top = knn(corpus, queries, 10)
    assert {r.value for r in recall(top, top, 10).collect()} == {1.0}


def test_run_metrics(spark):
    lat = rng.exponential(size=300)
    rows = [(f"2024-01-01 00:00:{i % 5:02d}", "bulk" if i % 3 else "search", 10, float(v), i % 50 == 0) for i, v in enumerate(lat)]
    df = spark.createDataFrame(rows, "ts string, task string, docs int, latency_ms double, error boolean")
    got = {(r.task, r.metric): (r.value, r.unit) for r in run_metrics(df.withColumn("ts", F.to_timestamp("ts"))).collect()}
    assert len(got) == 22
    for task in ("bulk", "search"):
        mine = [r for r in rows if r[1] == task]
        for name, p in (("50th", 50), ("99.9th", 99.9), ("100th", 100)):
            assert got[task, f"{name} percentile latency"][0] == pytest.approx(np.percentile([r[3] for r in mine], p))
        assert got[task, "error rate"] == (pytest.approx(100 * np.mean([r[4] for r in mine])), "%")
        rates = [10 * sum(r[0] == s for r in mine) for s in {r[0] for r in mine}]
        assert got[task, "Median Throughput"] == (np.median(rates), "docs/s")
        assert got[task, "Max Throughput"][0] == max(rates)
