"""The shared scoring step: how many passes a search takes, and what a task holds while it compares."""

import numpy as np
import pyarrow as pa
import pytest

from orbivec.operators import knn as knn_module
from orbivec.operators import quantise, scan
from orbivec.operators.knn import dense_blocks, knn
from orbivec.operators.nearest import Nearest
from tests.brute import hits_of, nearest, table

rng = np.random.default_rng(21)


def batch(x, name="vector"):
    return pa.RecordBatch.from_arrays([pa.array(x.tolist(), pa.list_(pa.float32()))], names=[name])


def test_full_blocks_of_short_vectors_share_a_pass(spark, monkeypatch):
    x, q = rng.normal(size=(200, 5)).astype(np.float32), rng.normal(size=(60, 5)).astype(np.float32)
    monkeypatch.setattr(scan, "BLOCK_QUERIES", 10)
    monkeypatch.setattr(scan, "PASS_QUERIES", 40, raising=False)
    asked, passes = table(spark, q, name="query_id"), []
    whole = knn_module.scan.scan_block
    monkeypatch.setattr(knn_module.scan, "scan_block", lambda corpus, block, *a, **o: passes.append(len(block)) or whole(corpus, block, *a, **o))
    got = hits_of(knn(table(spark, x), asked, 7, block_queries=10))
    assert got == {i: [w[0] for w in row] for i, row in enumerate(nearest(q, x, range(200), 7, "l2"))}
    assert sum(passes) == 60 and max(passes) <= 40 and len(passes) <= 3
    passes.clear()
    knn(table(spark, x), asked, 7, block_queries=9)  # smaller ones stay as asked for
    assert max(passes) <= 9
    monkeypatch.setattr(scan, "PASS_BYTES", 12 * 5 * 8)  # and long vectors fill fewer
    assert max(len(b) for b in dense_blocks(asked, "query_id", "vector", 10, grow=True)) <= 12


@pytest.mark.parametrize("space", ["l2", "innerproduct", "cosine"])
def test_a_malformed_query_holds_back_no_other(space):
    """Without a bound of its own it kept all queries of its part in double precision."""
    q, x = rng.normal(size=(40, 8)), rng.normal(size=(4000, 8)).astype(np.float32)
    q[7, 2], q[11, 0] = np.nan, np.inf
    best, rows = Nearest(40, 5), batch(x)
    ids = pa.RecordBatch.from_arrays([pa.array(np.arange(4000))], names=["_id"])
    kinds = []
    for scored in scan.dense_scorer(space, "vector")({"vectors": q})(rows, best.limits):
        kinds.append(scored.block.dtype)
        best.offer(scored, np.arange(4000), ids)
        if best.pending > 2 * 40 * 5:
            best._compact()
    assert kinds.count(np.float64) <= 2 and np.float32 in kinds
    got = {i: set() for i in range(40)}
    for i, _, _, payload, _ in best.drain():
        for a, b in zip(i, payload.column(0).to_pylist()):
            got[a].add(b)
    well = [i for i in range(40) if i not in (7, 11)]
    want = nearest(q[well], x, range(4000), 5, space)
    assert {i: got[i] for i in well} == {i: {w[0] for w in row} for i, row in zip(well, want)} and not got[7] and not got[11]


def test_lists_that_fit_are_handed_on_once():
    """A task emits k rows a query, however many rows it reads."""
    q, x = rng.normal(size=(2000, 6)), rng.normal(size=(6000, 6)).astype(np.float32)
    best, handed = Nearest(2000, 10), 0
    score = scan.dense_scorer("l2", "vector")({"vectors": q})
    for lo in range(0, 6000, 1000):
        ids = pa.RecordBatch.from_arrays([pa.array(np.arange(lo, lo + 1000))], names=["_id"])
        for scored in score(batch(x[lo:lo + 1000]), best.limits):
            best.offer(scored, np.arange(lo, lo + 1000), ids)
            if best.overfull():
                handed += sum(len(part[0]) for part in best.drain())
    handed += sum(len(part[0]) for part in best.drain())
    assert handed == 20_000


def test_distances_are_made_a_tile_at_a_time():
    """Not millions in double precision, whatever the scorer."""
    q = rng.normal(size=(1500, 6))
    x = rng.normal(size=(3000, 6)).astype(np.float32)
    codec = quantise.Codec("one_bit", means=np.zeros(6))
    codes = pa.RecordBatch.from_arrays([pa.array([c.tobytes() for c in codec.encode(x)], pa.binary())], names=["code"])
    outer = pa.array([[{"inner": v.tolist()} for v in x[i:i + 5]] for i in range(0, 3000, 5)])
    nested = pa.RecordBatch.from_arrays([outer], names=["outer"])
    for scorer, rows, n in ((scan.dense_scorer("l2", "vector"), batch(x), 3000),
                            (quantise.code_scorer(codec, "l2"), codes, 3000),
                            (scan.nested_scorer("l2", "outer", "inner"), nested, 600)):
        seen = np.zeros((1500, n), int)
        for scored in scorer({"vectors": q})(rows, np.full(1500, np.inf)):
            assert scored.block.shape == (len(scored.queries), len(scored.rows)) and scored.block.size <= 300_000
            seen[np.ix_(scored.queries, scored.rows)] += 1
        assert (seen == 1).all()


@pytest.mark.parametrize("pairs", [4_000_000, 0])
@pytest.mark.parametrize("space", ["l2", "innerproduct", "cosine"])
def test_candidates_are_compared_block_by_block(spark, monkeypatch, space, pairs):
    """No vector is shuffled, and blocks run in turn: a task's share does not grow with the queries."""
    draw = np.random.default_rng(3)
    x = draw.normal(size=(90, 6)).astype(np.float32)
    corpus, asked = table(spark, x), table(spark, x, name="query_id")
    codec = quantise.train_codec(corpus, "one_bit")
    codes = quantise.quantise(corpus, codec)
    monkeypatch.setattr(quantise, "MAX_BROADCAST_PAIRS", pairs)
    want = {i: [w[0] for w in row] for i, row in enumerate(nearest(x, x, range(90), 4, space))}
    shipped = []
    share = scan.QueryBlock.share
    monkeypatch.setattr(scan.QueryBlock, "share", lambda self, spark: shipped.append(self) or share(self, spark))
    monkeypatch.setattr(scan, "BLOCK_QUERIES", 20)
    monkeypatch.setattr(scan, "PASS_QUERIES", 20)
    hits = quantise.rescored(codes, codec, corpus, asked, 4, 30.0, space)  # more candidates than rows: exact
    assert hits_of(hits) == want
    assert len(shipped) >= 10 and max(len(b) for b in shipped) <= 20 and not any(b.shared for b in shipped)
