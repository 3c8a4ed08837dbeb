"""Padded radial truth looks for no more hits than its lists are wide."""

import numpy as np

from orbivec.operators import truth as tr
from orbivec.sources.bundle import Bundle


def test_lists_are_cut_where_hits_are_found(spark, monkeypatch):
    x = np.random.default_rng(2).normal(size=(90, 3))
    rows = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "pos bigint, vector array<double>")
    bundle, asked = Bundle({"train": rows, "test": rows.withColumnRenamed("pos", "query_idx")}), []
    search = tr.radial
    monkeypatch.setattr(tr, "radial", lambda *a, **o: asked.append(o["cap"]) or search(*a, **o))
    built = tr.build_radial_truth(bundle, "l2", 2.0, width=4)
    got = {r.query_idx: list(r.ids) for r in built["radial_neighbors"].collect()}
    assert asked == [4]
    for q, ids in got.items():
        d = ((x - x[q]) ** 2).sum(1)
        near = sorted((round(v, 9), i) for i, v in enumerate(d) if round(v, 9) <= 2.0)
        assert ids == ([i for _, i in near] + [-1] * 4)[:4]
    tr.build_radial_truth(bundle, "l2", 2.0, cap=3, width=6)
    tr.build_radial_truth(bundle, "l2", 2.0, cap=5)
    assert asked == [4, 3, 5]
