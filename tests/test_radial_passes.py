"""Radial searches: passes over the corpus, and what a counting task holds."""

import numpy as np
import pytest

from orbivec.operators import knn as knn_module
from orbivec.operators import scan
from orbivec.operators.knn import radial
from tests.brute import distances, hits_of, nearest, table
from workload import evaluation


def test_small_blocks_share_a_pass(spark, monkeypatch):
    rng = np.random.default_rng(4)
    x, q = rng.normal(size=(200, 5)).astype(np.float32), rng.normal(size=(60, 5)).astype(np.float32)
    monkeypatch.setattr(scan, "BLOCK_QUERIES", 45)
    passes = []
    whole = knn_module.scan.scan_block
    monkeypatch.setattr(knn_module.scan, "scan_block", lambda corpus, block, *a, **o: passes.append(len(block)) or whole(corpus, block, *a, **o))
    got = hits_of(radial(table(spark, x), table(spark, q, name="query_id"), "l2", max_distance=4.0, cap=7, block_queries=6))
    assert got == {i: [w[0] for w in row] for i, row in enumerate(nearest(q, x, range(200), 7, "l2", 4.0)) if row}
    assert sum(passes) == 60 and max(passes) <= 45 and len(passes) <= 3


@pytest.mark.parametrize("space", ["l2", "innerproduct", "cosine"])
def test_a_counting_task_looks_no_further_than_its_cap(space):
    """Limits fall as a task counts, to what its own rows prove, and counts below them are whole."""
    rng = np.random.default_rng(5)
    q, batches = rng.normal(size=(30, 6)), [rng.normal(size=(n, 6)) for n in (40, 900, 900, 900)]
    near, tally, cap = scan.Dense(q, space), scan._Tally(np.full(30, 1e6), 50), 50
    for batch in batches:
        rows = near.rows(batch)
        tally.add(near.scored(np.arange(30), rows, tally.limits), 1e-8)
    tally.compact()
    true = scan.dense_distances(q, np.concatenate(batches), space)
    for i in range(30):
        bins = tally.bins(tally.keys[tally.keys >> 20 == i])
        times = tally.times[tally.keys >> 20 == i]
        assert (true[i] <= tally.limits[i]).sum() >= cap  # never below the cap-th row
        assert cap <= times.sum() <= cap + (scan._bins(true[i]) == bins[-1]).sum() + 2
        assert (np.diff(bins) > 0).all() and times[:-1].sum() < cap


@pytest.fixture()
def crowded(tmp_path, monkeypatch, spark):
    """A folder whose vectors have more neighbours than a radial search keeps unless told otherwise (7 here), and their distances."""
    x = (np.random.default_rng(6).normal(size=(60, 4)) / 3).astype(np.float32)
    spark.createDataFrame([(i, [float(e) for e in v], 0) for i, v in enumerate(x)], "vec_id long, embedding array<float>, label int").write.parquet(f"{tmp_path}/embeddings.parquet")
    monkeypatch.setattr(evaluation, "radial", lambda *a, **o: radial(*a, **({"cap": 7} | o)))
    return str(tmp_path), np.round(distances(x, x, "l2"), 9)


def test_radial_recall_counts_all_neighbours(spark, crowded):
    folder, d = crowded
    assert ((d <= 1.2).sum(1) > 7).any()
    got = evaluation.radial_recall(spark, folder).first()
    assert got.value == pytest.approx(np.mean((d <= 1.2).sum(1) / (d <= 1.4).sum(1)), abs=1e-6)


def test_radial_stats_count_all_neighbours(spark, crowded):
    folder, d = crowded
    n = (d <= 1.4).sum(1) - 1
    got = evaluation.radial_stats(spark, folder).first()
    assert (got.mean_neighbours, got.median_neighbours, got.min_neighbours, got.max_neighbours, got.empty_queries) == (
        pytest.approx(n.mean(), abs=1e-6), np.median(n), n.min(), n.max(), (n == 0).sum())


def test_a_radius_without_a_cap(spark):
    rng = np.random.default_rng(7)
    x, q = rng.normal(size=(150, 4)).astype(np.float32), rng.normal(size=(20, 4)).astype(np.float32)
    got = hits_of(radial(table(spark, x), table(spark, q, name="query_id"), "cosine", max_distance=1.3, cap=None, salts=3, block_queries=7))
    assert got == {i: [w[0] for w in row] for i, row in enumerate(nearest(q, x, range(150), 150, "cosine", 1.3)) if row}
