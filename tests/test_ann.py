import numpy as np
import pytest
from pyspark.sql import functions as F

from orbivec import knn
from orbivec.operators import ivf
from orbivec.operators import quantise as qz
from orbivec.operators.metrics import query_recall
from tests.brute import hits_of, nearest, table
from tests.conftest import plan

rng = np.random.default_rng(4)
X = rng.normal(size=(400, 16)).astype(np.float32)
# A third of the rows are near one point.
X[:133] = X[0] + rng.normal(size=(133, 16)).astype(np.float32) * 0.01
Q = rng.normal(size=(30, 16)).astype(np.float32)


@pytest.fixture(scope="module")
def data(spark, tmp_path_factory):
    corpus, queries = table(spark, X), table(spark, Q, name="query_id")
    centroids = ivf.ivf_train(corpus, 8)
    cells = ivf.ivf_write(corpus, centroids, str(tmp_path_factory.mktemp("ivf") / "cells"))
    truth = knn(corpus, queries, 5, "l2").cache()
    return corpus, queries, centroids, cells, truth


def mean_recall(hits, truth):
    return query_recall(hits, truth, 5).agg(F.avg("recall_k")).first()[0]


@pytest.mark.parametrize("space", ["l2", "innerproduct", "cosine"])
def test_all_cells_is_exact(data, space):
    corpus, queries, centroids, cells, _ = data
    want = {i: [w[0] for w in row] for i, row in enumerate(nearest(Q, X, range(400), 5, space))}
    assert hits_of(ivf.ivf_search(cells, centroids, queries, 5, 8, space)) == want
    assert hits_of(ivf.ivf_search(cells, centroids, queries, 5, 99, space, block_queries=7)) == want


def test_more_cells_find_no_less(data):
    _, queries, centroids, cells, truth = data
    found = [mean_recall(ivf.ivf_search(cells, centroids, queries, 5, n), truth) for n in (1, 2, 4, 8)]
    assert found == sorted(found) and found[-1] == 1.0


def test_hits_come_from_probed_cells_only(spark, data):
    _, queries, centroids, cells, _ = data
    cell_of = {r._id: r.cluster_id for r in cells.collect()}
    c = np.array([r.vector for r in centroids.orderBy("cluster_id").collect()])
    probed = {i: {w[0] for w in row} for i, row in enumerate(nearest(Q, c, range(len(c)), 2, "l2"))}
    for q, ids in hits_of(ivf.ivf_search(cells, centroids, queries, 50, 2)).items():
        assert {cell_of[i] for i in ids} <= probed[q]


def test_every_row_in_its_closest_cell(data):
    _, _, centroids, cells, _ = data
    c = np.array([r.vector for r in centroids.orderBy("cluster_id").collect()])
    rows = cells.collect()
    assert sorted(r._id for r in rows) == list(range(400))
    for r in rows:
        assert r.cluster_id == int(((c - np.array(r.vector)) ** 2).sum(1).argmin())


def test_probed_cells_prune_partitions(spark, data):
    _, queries, centroids, cells, _ = data
    text = plan(ivf.ivf_search(cells, centroids, queries.filter("query_id < 2"), 5, 1))
    assert "PartitionFilters: [cluster_id" in text


def test_joined_cells_prune_partitions(spark, data):
    """More than one block of queries: cells and askers are joined, and only the probed partitions are read."""
    _, queries, centroids, cells, _ = data
    from orbivec.operators.meet import meet

    asked = queries.limit(3)
    probes = asked.join(ivf.probed_cells(centroids, asked, 1), "query_id")
    text = plan(meet(cells, probes, 5, "l2", key="cluster_id"))
    assert "dynamicpruning" in text


@pytest.mark.parametrize("rows,asking", [(65_536, 4_096), (10, 3)])
def test_hot_cells_are_dealt_over_parts(data, monkeypatch, rows, asking):
    from orbivec.operators import meet

    monkeypatch.setattr(meet, "ROWS", rows)
    monkeypatch.setattr(meet, "QUERIES", asking)
    _, queries, centroids, cells, _ = data
    want = hits_of(ivf.ivf_search(cells, centroids, queries, 5, 3))
    assert hits_of(ivf.ivf_search(cells, centroids, queries, 5, 3, block_queries=4)) == want


@pytest.mark.parametrize("block", [7, 4096])
def test_filtered_search_finds_k_whenever_there_are_k(data, block):
    corpus, queries, centroids, cells, _ = data
    rare = "_id % 40 = 3"
    found = hits_of(ivf.ivf_search(cells, centroids, queries, 5, 1, where=rare, block_queries=block))
    assert sorted(found) == list(range(30)) and all(len(ids) == 5 and all(i % 40 == 3 for i in ids) for ids in found.values())
    exact = hits_of(ivf.ivf_search(cells, centroids, queries, 50, 1, where=rare, block_queries=block))
    assert exact == hits_of(knn(corpus, queries, 50, "l2", where=rare))  # fewer than k exist: all cells were probed


def test_centres_of_odd_tables(spark):
    empty = table(spark, X).limit(0)
    assert ivf.ivf_train(empty, 4).count() == 0
    few = ivf.ivf_train(table(spark, X[:3]), 8).collect()
    assert sorted(r.cluster_id for r in few) == list(range(8))
    same = ivf.ivf_train(table(spark, np.repeat(X[:1], 50, 0)), 4)
    assert same.count() == 4


def test_centres_cost_no_more_than_twice_those_of_many_starts(data):
    _, _, centroids, _, _ = data
    c = np.array([r.vector for r in centroids.collect()])
    cost = lambda c: ((X[:, None, :] - c[None]) ** 2).sum(2).min(1).sum()
    starts = np.random.default_rng(0)
    from orbivec.operators.kmeans import local

    assert cost(c) <= 1.3 * min(cost(local(X.astype(float), 8, int(s), 30)) for s in starts.integers(0, 1000, 5))


def test_many_probed_cells_are_joined(data, monkeypatch):
    _, queries, centroids, cells, _ = data
    want = hits_of(ivf.ivf_search(cells, centroids, queries, 5, 3))
    monkeypatch.setattr(ivf, "_MAX_NAMED_CELLS", 1)
    assert hits_of(ivf.ivf_search(cells, centroids, queries, 5, 3)) == want


def test_closest_centre_among_near_equal_ones():
    c = rng.normal(size=(40, 16))
    c[20:] = c[:20] * (1 + 1e-9)
    c[39] = c[19]
    blocks = [(np.arange(25), c[:25]), (np.arange(25, 40), c[25:])]
    x = np.concatenate([rng.normal(size=(300, 16)), c])
    want = [min((round(float(((row - m) ** 2).sum()), 9), i) for i, m in enumerate(c))[1] for row in x]
    assert ivf.nearest_rows(x, blocks).tolist() == want


def test_exact_below_the_threshold(data):
    _, queries, centroids, cells, truth = data
    assert hits_of(ivf.adaptive_search(cells, centroids, queries, 5, threshold=1000)) == hits_of(truth)
    assert hits_of(ivf.adaptive_search(cells, centroids, queries, 5, threshold=-1)) == hits_of(truth)
    by_cells = hits_of(ivf.ivf_search(cells, centroids, queries, 5, 1))
    assert hits_of(ivf.adaptive_search(cells, centroids, queries, 5, threshold=0)) == by_cells
    assert hits_of(ivf.adaptive_search(cells, centroids, queries, 5, threshold=100)) == by_cells


@pytest.mark.parametrize("encoder,size", [("flat", 64), ("fp16", 32), ("one_bit", 2), ("pq", 4)])
def test_encoders(data, encoder, size):
    corpus, queries, _, _, truth = data
    codec = qz.train_codec(corpus, encoder, pq_m=4, code_size=4)
    codes = qz.quantise(corpus, codec)
    assert codes.columns == ["_id", "code"] and len(codes.first().code) == size
    found = [mean_recall(qz.rescored(codes, codec, corpus, queries, 5, f), truth) for f in (1, 4, 80)]
    assert found == sorted(found) and found[-1] == 1.0


@pytest.mark.parametrize("space", ["l2", "innerproduct", "cosine"])
def test_product_codes_rank_like_their_decoded_vectors(data, space):
    corpus, queries, *_ = data
    codec = qz.train_codec(corpus, "pq", pq_m=4, code_size=4)
    decoded = codec.decode(codec.encode(X.astype(float)))
    want = nearest(Q, decoded, range(400), 20, space)
    got = {}
    for r in qz.code_search(qz.quantise(corpus, codec), codec, queries, 20, space).collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.distance))
    for q, row in got.items():
        assert np.allclose([d for _, d in sorted(row)], [d for _, d in want[q]], atol=1e-8)


def test_half_precision(spark, data):
    corpus, *_ = data
    got = {r._id: r.vector for r in qz.round_fp16(corpus).collect()}
    assert np.array_equal(np.array([got[i] for i in range(400)], np.float32), X.astype(np.float16).astype(np.float32))
    big = table(spark, np.array([[1e6, -1e6, 1.0]], np.float32))
    assert qz.round_fp16(big, clip=True).first().vector == [65504.0, -65504.0, 1.0]
    with pytest.raises(Exception, match="half-precision"):
        qz.round_fp16(big).collect()


def test_levels_and_candidates():
    assert qz.encoder_for() == ("flat", False) and qz.encoder_for("2x") == ("fp16", False)
    assert qz.encoder_for(mode="on_disk") == ("one_bit", True) and qz.encoder_for("32x") == ("one_bit", False)
    for bad in (("3x", "in_memory"), ("2x", "on_tape")):
        with pytest.raises(ValueError):
            qz.encoder_for(*bad)
    assert qz.candidate_count(10) == 10 and qz.candidate_count(10, 2.55) == 26
    assert qz.candidate_count(10, 2, overquery=3) == 30 and qz.candidate_count(10, 2, ef_search=64) == 64
    with pytest.raises(ValueError):
        qz.Codec("zip")


def test_training_sample_is_bounded_and_repeatable(spark):
    big = table(spark, rng.normal(size=(2000, 4)).astype(np.float32))
    a = ivf.training_sample(big, 200)
    b = ivf.training_sample(big.repartition(7), 200)
    assert 130 < a.count() < 270 and {r._id for r in a.collect()} == {r._id for r in b.collect()}
