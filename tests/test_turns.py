"""Searches of several query blocks: what the driver holds at once."""

import numpy as np

from orbivec.operators import scan
from orbivec.operators.bm25 import bm25
from orbivec.operators.knn import knn
from tests.brute import hits_of
from tests.conftest import plan
from tests.test_text import TEXTS, brute, frame


def asked_blocks(monkeypatch):
    blocks = []
    share = scan.QueryBlock.share
    monkeypatch.setattr(scan.QueryBlock, "share", lambda self, spark: blocks.append(self) or share(self, spark))
    return blocks


def test_text_blocks_are_released_in_turn(spark, monkeypatch):
    blocks = asked_blocks(monkeypatch)
    hits = bm25(frame(spark, TEXTS), frame(spark, TEXTS, "query_id"), 9, block_queries=20)
    assert len(blocks) > 5 and not any(b.shared for b in blocks)
    assert "MapInArrow" not in plan(hits)
    assert hits_of(hits) == {q: [i for i, _ in v] for q, v in brute(TEXTS, dict(enumerate(TEXTS)), 9).items()}


def test_vector_blocks_are_released_in_turn(spark, monkeypatch):
    x = np.random.default_rng(5).normal(size=(60, 4))
    rows = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "_id bigint, vector array<double>")
    asked = rows.withColumnRenamed("_id", "query_id")
    want = hits_of(knn(rows, asked, 5))
    blocks = asked_blocks(monkeypatch)
    hits = knn(rows, asked, 5, block_queries=11, bound=rows.filter("_id < 20"))
    assert hits_of(hits) == want
    assert len(blocks) > 5 and not any(b.shared for b in blocks)
    assert "MapInArrow" not in plan(hits)
