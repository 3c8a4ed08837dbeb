import numpy as np
import pytest
from pyspark.sql import functions as F

from orbivec import knn, radial
from orbivec.operators.knn import find, one_of
from orbivec.operators.scan import Dense, Scored
from tests.brute import distances, hits_of, nearest, table
from tests.conftest import plan

rng = np.random.default_rng(1)
X = (rng.normal(size=(300, 8)) * rng.integers(1, 4, (300, 1))).astype(np.float32)
Q = rng.normal(size=(40, 8)).astype(np.float32)


@pytest.mark.parametrize("space", ["l2", "innerproduct", "cosine"])
@pytest.mark.parametrize("options", [{}, {"block_queries": 8}, {"salts": 3}])
def test_matches_brute_force(spark, space, options):
    hits = knn(table(spark, X), table(spark, Q, name="query_id"), 7, space, **options)
    want = nearest(Q, X, range(300), 7, space)
    assert hits_of(hits) == {i: [w[0] for w in row] for i, row in enumerate(want)}
    got = {(r.query_id, r._id): r.distance for r in hits.collect()}
    for i, row in enumerate(want):
        for doc, d in row:
            assert got[i, doc] == pytest.approx(d, abs=1e-8)


@pytest.mark.parametrize("parts", [1, 3, 8])
def test_same_hits_for_any_partitioning(spark, parts):
    hits = knn(table(spark, X, parts=parts), table(spark, Q, name="query_id", parts=parts), 5, "l2")
    assert hits_of(hits) == {i: [w[0] for w in row] for i, row in enumerate(nearest(Q, X, range(300), 5, "l2"))}


@pytest.mark.parametrize("k", [1, 3, 50, 1500])
def test_many_copies_tie_by_id(spark, k):
    """A third of the corpus is one vector, which is also the nearest of half the queries."""
    x = np.concatenate([X[:100], np.repeat(X[:1], 700, axis=0), X[100:300]])
    ids = list(np.random.default_rng(3).permutation(len(x)).tolist())
    q = np.concatenate([(np.repeat(X[:1], 5, axis=0) + 0.001).astype(np.float32), Q[:5]])
    hits = knn(table(spark, x, ids, parts=5), table(spark, q, name="query_id"), k, "l2", salts=2)
    assert hits_of(hits) == {i: [w[0] for w in row] for i, row in enumerate(nearest(q, x, ids, k, "l2"))}


def test_string_ids_tie_by_number_then_text(spark):
    x = np.ones((6, 2), np.float32)
    ids = ["10", "9", "b", "a", "100", "2"]
    hits = knn(table(spark, x, ids), table(spark, x[:1], name="query_id"), 6, "l2")
    assert hits_of(hits)[0] == ["2", "9", "10", "100", "a", "b"]


def test_fewer_rows_than_k_and_missing_vectors(spark):
    hits = knn(table(spark, [X[0], None, X[1]]), table(spark, [Q[0], None], name="query_id"), 10, "l2")
    assert {q: sorted(v) for q, v in hits_of(hits).items()} == {0: [0, 2]}


def test_zero_vector_is_never_a_cosine_hit(spark):
    x = np.array([[0, 0], [1, 0], [0, 1]], np.float32)
    assert hits_of(knn(table(spark, x), table(spark, x, name="query_id"), 5, "cosine")) == {1: [1, 2], 2: [2, 1]}


def test_no_queries(spark):
    queries = table(spark, Q, name="query_id").filter("query_id < 0")
    assert knn(table(spark, X), queries, 5).count() == 0


def test_bound_prunes_without_changing_hits(spark):
    corpus = table(spark, X)
    hits = knn(corpus, table(spark, Q, name="query_id"), 7, "l2", bound=corpus.filter("_id % 3 = 0"))
    assert hits_of(hits) == {i: [w[0] for w in row] for i, row in enumerate(nearest(Q, X, range(300), 7, "l2"))}


def filtered(spark):
    return table(spark, X).withColumn("age", (F.col("_id") % 10).cast("int"))


def test_filter_modes(spark):
    corpus, queries = filtered(spark), table(spark, Q, name="query_id")
    full = hits_of(knn(corpus, queries, 10, "l2"))
    inside = [i for i in range(300) if i % 10 < 3]
    want = {i: [w[0] for w in row] for i, row in enumerate(nearest(Q, X[inside], inside, 10, "l2"))}
    assert hits_of(knn(corpus, queries, 10, "l2", where="age < 3")) == want
    assert hits_of(knn(corpus, queries, 10, "l2", where=F.col("age") < 3, filter_mode="script")) == want
    after = {i: [d for d in row if d % 10 < 3] for i, row in full.items()}
    after = {i: row for i, row in after.items() if row}
    for mode in ("post_filter", "boolean"):
        got = knn(corpus, queries, 10, "l2", where="age < 3", filter_mode=mode)
        assert hits_of(got) == after
        assert got.columns == ["query_id", "_id", "distance", "score", "rank"]
    assert hits_of(knn(corpus, queries, 10, "l2", where="age < 3", filter_mode=None)) == full


def test_unknown_filter_mode_and_dimension(spark):
    corpus, queries = table(spark, X), table(spark, Q, name="query_id")
    with pytest.raises(ValueError):
        knn(corpus, queries, 5, where="_id > 3", filter_mode="sometimes")
    with pytest.raises(Exception, match="dimension"):
        knn(corpus, table(spark, Q[:, :5], name="query_id"), 5).collect()
    with pytest.raises(Exception, match="lengths"):
        knn(corpus.withColumn("vector", F.slice("vector", 1, 3 + (F.col("_id") % 2).cast("int"))), queries, 5).collect()
    with pytest.raises(ValueError, match="unique"):
        knn(corpus, queries.unionByName(queries), 5)
    with pytest.raises(ValueError, match="at least 1"):
        knn(corpus, queries, 0)


def test_exactly_one_way_to_ask(spark):
    one_of(k=3)
    for bad in ({}, {"k": 3, "min_score": 0.1}, {"max_distance": 1.0, "min_score": 0.5}):
        with pytest.raises(ValueError):
            one_of(**bad)
    corpus, queries = table(spark, X), table(spark, Q, name="query_id")
    with pytest.raises(ValueError):
        radial(corpus, queries)
    with pytest.raises(ValueError):
        find(corpus, queries, k=3, min_score=0.1)
    assert hits_of(find(corpus, queries, k=3)) == hits_of(knn(corpus, queries, 3))
    assert hits_of(find(corpus, queries, min_score=0.3)) == hits_of(radial(corpus, queries, min_score=0.3))


def test_nested(spark):
    sizes = np.random.default_rng(5).integers(0, 6, 80)
    starts = np.concatenate(([0], np.cumsum(sizes)))
    rows = [(p, [([float(e) for e in X[c]],) for c in range(starts[p], starts[p + 1])] if p % 11 else None) for p in range(80)]
    corpus = spark.createDataFrame(rows, "_id bigint, outer array<struct<inner:array<float>>>").repartition(4)
    corpus = corpus.withColumn("even", F.col("_id") % 2 == 0)
    queries = table(spark, Q, name="query_id")
    d = np.round(distances(Q, X, "l2"), 9)

    def want(parents, k):
        out = {}
        for q in range(len(Q)):
            best = sorted((d[q, starts[p]:starts[p + 1]].min(), p, int(d[q, starts[p]:starts[p + 1]].argmin()))
                          for p in parents if p % 11 and sizes[p])
            out[q] = [(p, c) for _, p, c in best[:k]]
        return out

    def got(hits):
        out = {}
        for r in hits.orderBy("query_id", "rank").collect():
            out.setdefault(r.query_id, []).append((r._id, r.child))
        return out

    everyone, even = want(range(80), 6), want(range(0, 80, 2), 6)
    assert got(knn(corpus, queries, 6, "l2", nested="outer.inner")) == everyone
    assert got(knn(corpus, queries, 6, "l2", nested="outer.inner", where="even")) == even
    for ignored in ("script", "boolean"):
        assert got(knn(corpus, queries, 6, "l2", nested="outer.inner", where="even", filter_mode=ignored)) == everyone
    post = got(knn(corpus, queries, 6, "l2", nested="outer.inner", where="even", filter_mode="post_filter"))
    assert post == {q: kept for q, v in everyone.items() if (kept := [h for h in v if h[0] % 2 == 0])}


@pytest.mark.parametrize("space,limit", [("l2", 12.0), ("innerproduct", -1.0), ("cosine", 0.6)])
def test_radial_by_distance_and_score(spark, space, limit):
    from orbivec import distance_to_score

    corpus, queries = table(spark, X), table(spark, Q, name="query_id")
    want = {i: [w[0] for w in row] for i, row in enumerate(nearest(Q, X, range(300), 10_000, space, limit)) if row}
    assert hits_of(radial(corpus, queries, space, max_distance=limit)) == want
    assert hits_of(radial(corpus, queries, space, min_score=distance_to_score(limit, space))) == want
    capped = hits_of(radial(corpus, queries, space, max_distance=limit, cap=4, salts=3, block_queries=16))
    assert capped == {i: row[:4] for i, row in want.items()}


def test_radial_bound_is_inclusive(spark):
    x = np.array([[0, 0], [0, 1], [0, 2]], np.float32)
    assert hits_of(radial(table(spark, x), table(spark, x[:1], name="query_id"), "l2", max_distance=1.0)) == {0: [0, 1]}
    assert hits_of(radial(table(spark, x), table(spark, x[:1], name="query_id"), "l2", min_score=0.5)) == {0: [0, 1]}


def test_large_lists_are_handed_on(spark, monkeypatch):
    """More kept candidates than a task may hold."""
    import orbivec.operators.nearest as nearest_module

    best = nearest_module.Nearest(3, 50)
    monkeypatch.setattr(nearest_module, "_FLUSH_ROWS", 10)
    best.capacity = 20
    import pyarrow as pa

    ids = np.arange(60)
    block = rng.random((3, 60))
    payload = pa.RecordBatch.from_arrays([pa.array(ids)], names=["_id"])
    out = {0: [], 1: [], 2: []}
    for lo in range(0, 60, 20):
        best.offer(Scored(np.arange(3), np.arange(lo, lo + 20), block[:, lo:lo + 20]), ids, payload)
        if best.overfull():
            for q, d, tie, p, _ in best.drain():
                for a, b in zip(q, p.column(0).to_pylist()):
                    out[a].append(b)
    for q, d, tie, p, _ in best.drain():
        for a, b in zip(q, p.column(0).to_pylist()):
            out[a].append(b)
    for q in range(3):
        assert set(np.argsort(block[q])[:50]) <= set(out[q]) and len(out[q]) == len(set(out[q]))


@pytest.mark.parametrize("space", ["l2", "innerproduct", "cosine"])
@pytest.mark.parametrize("size", [1e-3, 1.0, 1e4, 1e20])
def test_rough_distances_stay_within_their_margin(space, size):
    """Single precision only preselects: its error is covered, and the kept pairs are exact."""
    draw = np.random.default_rng(11)
    q, x = draw.normal(size=(20, 96)) * size, (draw.normal(size=(500, 96)) * size).astype(np.float32)
    x[:100] = x[0] * (1 + 1e-6 * draw.normal(size=(100, 1)))
    near = Dense(q, space)
    rows = near.rows(x)
    want = distances(q, x, space)
    for limits in (np.zeros(20), np.full(20, np.inf)):
        got = near.scored(np.arange(20), rows, limits)
        rough = np.isfinite(limits[0]) and size < 1e10
        assert got.block.dtype == (np.float32 if rough else np.float64)
        assert (np.abs(got.block - want) <= got.margin[:, None]).all()
    qi, ri = np.divmod(np.arange(20 * 500), 500)
    assert np.allclose(near.exact(qi, ri, rows).reshape(20, 500), want, rtol=1e-12, atol=1e-12 * size**2)


@pytest.mark.parametrize("space", ["l2", "innerproduct", "cosine"])
def test_many_batches_with_near_copies(spark, space):
    """Bounds are in force from the second batch on; rows differ by less than single precision tells."""
    draw = np.random.default_rng(12)
    base = draw.normal(size=(50, 32))
    x = np.repeat(base, 40, axis=0) * (1 + 1e-7 * draw.normal(size=(2000, 1)))
    q = base[:10] * 1.5
    old = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "64")
    try:
        rows = spark.createDataFrame([(i, [float(e) for e in v]) for i, v in enumerate(x)], "_id bigint, vector array<double>")
        asked = spark.createDataFrame([(i, [float(e) for e in v]) for i, v in enumerate(q)], "query_id bigint, vector array<double>")
        hits = hits_of(knn(rows.repartition(2), asked, 15, space))
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", old)
    want = nearest(q, x, range(2000), 15, space)
    assert hits == {i: [w[0] for w in row] for i, row in enumerate(want)}


def test_plan_reads_only_what_it_needs(spark, tmp_path):
    filtered(spark).withColumn("other", F.lit("x")).write.parquet(str(tmp_path / "c"))
    corpus = spark.read.parquet(str(tmp_path / "c"))
    text = plan(knn(corpus, table(spark, Q, name="query_id"), 5, "l2", where="age < 3"))
    assert "LessThan(age,3)" in text
    assert "ReadSchema: struct<_id:bigint,vector:array<float>,age:int>" in text
    assert "WindowGroupLimit" in text and "CartesianProduct" not in text and "NestedLoop" not in text
    assert text.count("Exchange") == 2  # one exchange, listed in the tree and in the details


@pytest.mark.parametrize("space", ["l2", "innerproduct", "cosine"])
@pytest.mark.parametrize("bad", [None, float("nan"), float("inf")])
def test_malformed_rows_leave_the_others_alone(spark, space, bad):
    spoilt = F.transform("vector", lambda e, i: F.when(i == 3, F.lit(bad).cast("float")).otherwise(e))
    x = table(spark, X, parts=3).withColumn("vector", F.when(F.col("_id") == 170, spoilt).otherwise(F.col("vector")))
    ids = [i for i in range(300) if i != 170]
    hits = hits_of(knn(x, table(spark, Q, name="query_id"), 7, space))
    assert hits == {i: [w[0] for w in row] for i, row in enumerate(nearest(Q, X[ids], ids, 7, space))}
    near = radial(x, table(spark, Q, name="query_id"), "l2", max_distance=60)
    assert {r._id for r in near.select("_id").distinct().collect()} == set(ids) & {d for row in nearest(Q, X[ids], ids, 299, "l2") for d, dist in row if dist <= 60}


@pytest.mark.parametrize("space", ["l2", "innerproduct", "cosine"])
def test_capped_radius_hands_on_little_more_than_its_hits(spark, space):
    """However many rows are in reach, and however many tasks read them, candidates stay near the cap."""
    import numpy as np

    from orbivec.operators import scan
    from orbivec.operators.knn import dense_blocks
    from tests.brute import hits_of, nearest, table

    rng = np.random.default_rng(8)
    x, q = rng.normal(size=(6000, 6)).astype(np.float32), rng.normal(size=(40, 6)).astype(np.float32)
    x[::3] = x[0]  # a third are copies
    corpus, queries = table(spark, x).repartition(16), table(spark, q, name="query_id")
    block = next(iter(dense_blocks(queries, "query_id", "vector", 100)))
    block.limits = np.full(40, 1e6)
    scorer = scan.dense_scorer(space, "vector")
    block.limits = scan.cut_at(corpus, block, scorer, 50, inputs=["vector"])
    kept = scan.scan_block(corpus, block, scorer, 50, inputs=["vector"], query_type=queries.schema["query_id"].dataType)
    in_bin = 0
    for row in nearest(q, x, range(6000), 6000, space):
        d = np.array([w[1] for w in row])
        in_bin += int((d <= d[49] + abs(d[49]) / 128 + 1e-6).sum())
    assert kept.count() <= in_bin
    want = {i: [w[0] for w in row] for i, row in enumerate(nearest(q, x, range(6000), 50, space))}
    assert hits_of(radial(corpus, queries, space, max_distance=1e6, cap=50)) == want
