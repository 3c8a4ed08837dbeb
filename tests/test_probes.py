"""Cells of many queries."""

import numpy as np
import pytest

from orbivec.operators import ivf
from orbivec.operators.knn import knn
from tests.brute import hits_of
from tests.test_turns import asked_blocks


@pytest.mark.parametrize("space", ["l2", "innerproduct", "cosine"])
def test_probed_cells_are_found_where_the_queries_lie(spark, monkeypatch, space):
    r = np.random.default_rng(6)
    x, c = r.normal(size=(70, 4)), r.normal(size=(9, 4))
    c[7], x[3], x[5, 1] = c[2], 0.0, np.nan  # two equal centres, a zero query, a malformed one
    asked = spark.createDataFrame([(f"q{i}", v.tolist()) for i, v in enumerate(x)] + [("none", None)], "query_id string, vector array<double>").repartition(3)
    centers = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(c)], "cluster_id int, vector array<double>")
    want = hits_of(knn(centers, asked, 3, space, id_col="cluster_id"), "cluster_id") if space != "cosine" else None
    blocks = asked_blocks(monkeypatch)
    monkeypatch.setattr(ivf, "CENTROID_BYTES", 4 * 8 * 4)  # four centres at a time
    got = {}
    for row in ivf.probed_cells(centers, asked, 3, space, block_queries=7).collect():
        got.setdefault(row.query_id, set()).add(row.cluster_id)
    assert not blocks  # no query came through the driver
    if want is None:
        want = hits_of(knn(centers, asked, 3, space, id_col="cluster_id"), "cluster_id")
    assert got == {q: set(v) for q, v in want.items()}
