"""Many queries, to which the corpus is sent: the same hits as by blocks of queries."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from orbivec.operators import knn as knn_module
from orbivec.operators import quantise as qz
from orbivec.operators import scan, turned
from orbivec.operators.knn import knn, radial
from orbivec.operators.metrics import _id_lists, radial_recall
from orbivec.operators.nearest import _order
from tests.brute import hits_of, nearest, table

RNG = np.random.default_rng(8)
X, Q = RNG.normal(size=(300, 6)).astype(np.float32), RNG.normal(size=(90, 6)).astype(np.float32)
X[7], X[11, 2] = X[3], np.nan  # a copy, a malformed row


@pytest.fixture(autouse=True)
def small(monkeypatch):
    """What counts as many, and as much, is little here; passes by blocks are not allowed."""
    for name, value in {"BLOCK_QUERIES": 20, "PASS_QUERIES": 40}.items():
        monkeypatch.setattr(scan, name, value)
    for name, value in {"PIECE_BYTES": 4000, "KEPT_BYTES": 9000, "GROUP": 16, "ROWS": 32, "HELD": 400, "TASK_QUERIES": 30}.items():
        monkeypatch.setattr(turned, name, value)
    monkeypatch.setattr(knn_module.scan, "in_turn", None)


def brute(k, space, limit=np.inf):
    return {i: [w[0] for w in row] for i, row in enumerate(nearest(Q, X, range(300), k, space, limit)) if row}


@pytest.mark.parametrize("space", ["l2", "innerproduct", "cosine"])
@pytest.mark.parametrize("ids", ["bigint", "string"])
def test_nearest(spark, space, ids):
    got = hits_of(knn(table(spark, X).withColumn("_id", F.col("_id").cast(ids)), table(spark, Q, name="query_id"), 9, space, block_queries=20))
    assert {q: [int(i) for i in v] for q, v in got.items()} == brute(9, space)


@pytest.mark.parametrize("cap", [5, 40, None])
def test_radius(spark, cap):
    """More hits than a task may hold: groups are halved, none is lost and none comes twice."""
    got = hits_of(radial(table(spark, X), table(spark, Q, name="query_id"), "l2", max_distance=9.0, cap=cap, block_queries=20))
    assert got == brute(cap or 300, "l2", 9.0)
    assert max(len(v) for v in got.values()) == (cap or max(len(v) for v in brute(300, "l2", 9.0).values()))


def test_hits_of_a_radius_are_not_shuffled(spark):
    from tests.conftest import plan

    hits = radial(table(spark, X), table(spark, Q, name="query_id"), "l2", max_distance=9.0, block_queries=20)
    assert "hashpartitioning" not in plan(hits) and "Window" not in plan(hits)


def test_filters(spark):
    rows = table(spark, X).withColumn("even", F.col("_id") % 2 == 0)
    asked = table(spark, Q, name="query_id")
    even = [i for i in range(300) if i % 2 == 0]
    assert hits_of(knn(rows, asked, 5, "l2", where="even", block_queries=20)) == {i: [w[0] for w in row] for i, row in enumerate(nearest(Q, X[even], even, 5, "l2"))}
    after = {q: [i for i in v if i % 2 == 0] for q, v in brute(5, "l2").items()}
    assert hits_of(knn(rows, asked, 5, "l2", where="even", filter_mode="boolean", block_queries=20)) == {q: v for q, v in after.items() if v}


@pytest.mark.parametrize("encoder", ["flat", "fp16", "one_bit"])
def test_codes(spark, monkeypatch, encoder):
    rows, asked = table(spark, X[12:]), table(spark, Q, name="query_id")
    codec = qz.train_codec(rows, encoder)
    codes = qz.quantise(rows, codec)
    got = hits_of(qz.code_search(codes, codec, asked, 6, block_queries=20))
    monkeypatch.undo()
    assert got == hits_of(qz.code_search(codes, codec, asked, 6))


def test_checks(spark):
    with pytest.raises(ValueError, match="unique"):
        knn(table(spark, X), table(spark, Q, [i % 80 for i in range(90)], "query_id"), 5, block_queries=20)
    with pytest.raises(ValueError, match="different lengths"):
        knn(table(spark, X), table(spark, [*Q, Q[0][:3]], name="query_id"), 5, block_queries=20)


def test_a_large_corpus_is_scanned(spark, monkeypatch):
    monkeypatch.undo()
    monkeypatch.setattr(scan, "BLOCK_QUERIES", 20)
    monkeypatch.setattr(scan, "PASS_QUERIES", 40)
    monkeypatch.setattr(turned, "CORPUS_BYTES", 1000)
    got = hits_of(knn(table(spark, X), table(spark, Q, name="query_id"), 4, "l2", block_queries=20))
    assert got == brute(4, "l2")


def test_order_is_that_of_a_full_sort():
    """Distances that differ in their last bits only, equal ones, and equal rows, which stay as they came."""
    rng = np.random.default_rng(9)
    for d in (1 + rng.integers(0, 4, 500) * 2.0**-52, np.zeros(500), rng.choice([-1e300, -0.5, 0.0, 5e-324, 1e300], 500), rng.normal(size=500)):
        q, tie, text = rng.integers(0, 9, 500), rng.integers(-2, 2, 500), rng.integers(0, 3, 500)
        assert (_order(q, d, tie, [text]) == np.lexsort((text, tie, d, q))).all()
        assert (_order(q * 0, d, tie, []) == np.lexsort((tie, d))).all()
    assert len(_order(q[:0], d[:0], tie[:0], [])) == 0


def test_pairs_of_a_query_travel_as_lists(spark):
    rows = spark.createDataFrame([(1, "a"), (1, "b"), (1, "a"), (None, "c"), (2, "d"), (2, None)], "query_id long, _id string").coalesce(1)
    assert [(r.query_id, r.ids) for r in _id_lists(rows, "_id").collect()] == [(1, ["a", "b", "a"]), (None, ["c"]), (2, ["d", None])]
    asked = spark.range(4).withColumnRenamed("id", "query_id")
    hits = spark.createDataFrame([(1, "b"), (2, None), (2, "x"), (2, "x"), (0, "y")], "query_id long, _id string")
    assert radial_recall(hits, rows, asked).first().value == (0 + 1 / 2 + 1 / 2 + 1) / 4
