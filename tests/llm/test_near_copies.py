"""Near copies of the pipeline against all pairs by true Jaccard similarity."""

import numpy as np
import pytest

import corpus_pipeline
from orbivec.llm import superminhash


def edited(rng, text, edits):
    words = text.split()
    for at in rng.choice(len(words), edits, replace=False):
        words[at] = f"new{rng.integers(10**6)}"
    return " ".join(words)


@pytest.mark.parametrize("hubs", [0, 1])
def test_stage_keeps_one_of_each_near_copy(spark, monkeypatch, hubs):
    monkeypatch.setattr(superminhash, "HUBS", hubs)
    rng = np.random.default_rng(3)
    bases = [" ".join(f"w{n}" for n in rng.integers(0, 5000, size)) for size in rng.integers(100, 600, 25)]
    texts = [edited(rng, b, e) if e else b for b in bases for e in (0, 1, 2, 4, 8, 16)] + [None, "", "one two", "One  two"]
    texts += [edited(rng, bases[0], 2) for _ in range(40)]
    sets = [{" ".join(w[i:i + 5]) for i in range(max(1, len(w) - 4))} if (w := (t or "").lower().split()) else set() for t in texts]
    near = [[j for j, b in enumerate(sets) if a == b or (a | b and len(a & b) >= 0.8 * len(a | b))] for a in sets]
    label = list(range(len(texts)))
    for _ in range(10):
        label = [min(label[j] for j in of) for of in near]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert {r.doc_id: r.component_id for r in superminhash.near_copies(docs, linked_empty=True).collect()} == dict(enumerate(label))
    kept = corpus_pipeline.deduplicated(spark, docs, "")
    assert sorted(r.doc_id for r in kept.collect()) == sorted(set(label))
