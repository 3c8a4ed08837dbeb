import math
import re
from collections import Counter

import numpy as np
import pytest

from orbivec.operators.bm25 import bm25, document_frequencies, term_table
from orbivec.operators.hybrid import hybrid, merge_legs
from orbivec.operators.knn import knn
from tests.brute import hits_of

rng = np.random.default_rng(8)
WORDS = [f"w{i}" for i in range(60)]
TEXTS = [" ".join(rng.choice(WORDS, rng.integers(0, 30), p=np.arange(60, 0, -1) / 1830)) for _ in range(150)]
TEXTS[3], TEXTS[4] = "", None
TEXTS[60:110] = [TEXTS[60]] * 50  # a third of the texts are copies


def toks(t):
    return [w for w in re.split(r"[\W_]+", (t or "").lower()) if w]


def brute(docs, queries, k):
    counts = [Counter(toks(t)) for t in docs]
    n, avg = len(docs), sum(len(toks(t)) for t in docs) / len(docs)
    df = Counter(w for c in counts for w in c)
    out = {}
    for q, text in queries.items():
        scores = []
        for i, c in enumerate(counts):
            s = sum(m * math.log(1 + (n - df[w] + 0.5) / (df[w] + 0.5)) * c[w] * 2.2
                    / (c[w] + 1.2 * (0.25 + 0.75 * sum(c.values()) / avg)) for w, m in Counter(toks(text)).items() if w in c)
            if s > 0:
                scores.append((-round(s, 6), i))
        out[q] = [(i, -s) for s, i in sorted(scores)[:k]]
    return {q: v for q, v in out.items() if v}


def frame(spark, texts, name="_id", parts=3):
    return spark.createDataFrame(list(enumerate(texts)), f"{name} bigint, text string").repartition(parts)


@pytest.mark.parametrize("options", [{}, {"block_queries": 20}, {"salts": 3}])
def test_scores(spark, options):
    hits = bm25(frame(spark, TEXTS), frame(spark, TEXTS, "query_id"), 12, **options).collect()
    want = brute(TEXTS, dict(enumerate(TEXTS)), 12)
    got = {}
    for r in sorted(hits, key=lambda r: (r.query_id, r["rank"])):
        got.setdefault(r.query_id, []).append((r._id, r.score))
    assert {q: [i for i, _ in v] for q, v in got.items()} == {q: [i for i, _ in v] for q, v in want.items()}
    for q in want:
        assert np.allclose([s for _, s in got[q]], [s for _, s in want[q]], atol=2e-6)


def test_rare_and_frequent_terms_take_both_ways(spark, monkeypatch):
    import orbivec.operators.bm25 as module

    queries = {i: t for i, t in enumerate(["w0 w0 w59 w1", "absent", "w58", "w2 w3 w4 W2!"])}
    frame_q = spark.createDataFrame(list(queries.items()), "query_id bigint, text string")
    want = {q: [i for i, _ in v] for q, v in brute(TEXTS, queries, 500).items()}
    for small, held in ((20_000, 0), (0, 0), (0, 1000)):  # counted, looked up in a table, looked up in memory
        monkeypatch.setattr(module, "_SMALL_VOCABULARY", small)
        monkeypatch.setattr(module, "_HELD_TERMS", held)
        assert hits_of(bm25(frame(spark, TEXTS), frame_q, 500)) == want


def test_title_when_there_is_no_text(spark):
    q = spark.createDataFrame([(0, None, "w5"), (1, "", "w6"), (2, "w7", "w5")], "query_id bigint, text string, title string")
    got = hits_of(bm25(frame(spark, TEXTS), q, 10, title_col="title"))
    want = {i: [d for d, _ in v] for i, v in brute(TEXTS, {0: "w5", 1: "w6", 2: "w7"}, 10).items()}
    assert got == want


def test_term_table(spark):
    t = {r._id: (dict(zip(r.terms, r.counts)), r.length) for r in term_table(frame(spark, TEXTS)).collect()}
    assert t == {i: (dict(Counter(toks(x))), len(toks(x))) for i, x in enumerate(TEXTS)}
    df = {r.term: r.df for r in document_frequencies(term_table(frame(spark, TEXTS))).collect()}
    assert df == dict(Counter(w for x in TEXTS for w in set(toks(x))))


def test_merge_by_hand(spark):
    text = spark.createDataFrame([(0, 1, 4.0), (0, 2, 2.0), (0, 3, 3.0), (1, 9, 5.0)], "query_id bigint, _id bigint, score double")
    near = spark.createDataFrame([(0, 2, 1.0), (0, 4, 0.5)], "query_id bigint, _id bigint, score double")
    got = [(r.query_id, r._id, r.score) for r in merge_legs(text, near, 10).orderBy("query_id", "rank").collect()]
    assert got == [(0, 2, 0.7), (0, 1, 0.3), (0, 3, 0.15), (0, 4, 0.0), (1, 9, 0.3)]
    got = [(r._id, r.score) for r in merge_legs(text, near, 1, (1, 1), "l2").filter("query_id = 0").collect()]
    assert got == [(2, round((2 / math.sqrt(29) + 1 / math.sqrt(1.25)) / 2, 9))]
    with pytest.raises(ValueError):
        merge_legs(text, near, 1, technique="max")


def test_modes(spark):
    x = rng.normal(size=(150, 4)).astype(np.float32)
    rows = spark.createDataFrame([(i, t, [float(e) for e in v]) for i, (t, v) in enumerate(zip(TEXTS, x))],
                                 "_id bigint, text string, vector array<float>")
    queries = rows.withColumnRenamed("_id", "query_id").filter("query_id < 20")
    vector = hybrid(rows, queries, 5, mode="vector")
    assert hits_of(vector) == hits_of(knn(rows, queries, 5, "innerproduct"))
    both = hits_of(hybrid(rows, queries, 5, depth=30))
    assert both.keys() == hits_of(vector).keys() and both != hits_of(vector)
    near_only = hits_of(hybrid(rows, queries, 5, weights=(0.0, 1.0)))
    assert {q: v[:4] for q, v in near_only.items()} == {q: v[:4] for q, v in hits_of(vector).items()}
    with pytest.raises(ValueError):
        hybrid(rows, queries, 5, mode="text")
