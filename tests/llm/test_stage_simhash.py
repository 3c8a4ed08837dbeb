"""The pipeline's near-duplicate stage finds copies by SimHash, and checks them on their full sets."""

import itertools

import numpy as np

import corpus_pipeline
from orbivec.llm import simhash, superminhash


def test_stage_uses_fingerprints(spark, monkeypatch):
    rng = np.random.default_rng(9)
    bases = [[f"w{n}" for n in rng.integers(0, 5000, 900)] for _ in range(12)]
    texts = []
    for base in bases:
        texts += [" ".join(base), " ".join([*base[:450], "other", *base[451:]])]
    texts += [None, ""]
    marks = [simhash.simhash(t, 5) for t in texts]
    close = [i for i in range(12) if (marks[2 * i] ^ marks[2 * i + 1]).bit_count() <= simhash.BITS]
    assert close  # SimHash catches some of them
    number = itertools.count()

    def apart(docs, doc_id, text, words, bands, rows, whole=superminhash.prints):
        from pyspark.sql import functions as F

        return whole(docs, doc_id, text, words, bands, rows).withColumn("keys", F.array().cast("array<long>"))

    monkeypatch.setattr(superminhash, "prints", apart)  # no list of SuperMinHash
    docs = spark.createDataFrame([(next(number), t) for t in texts], "doc_id long, text string")
    kept = {r.doc_id for r in corpus_pipeline.deduplicated(spark, docs, "").collect()}
    assert kept == set(range(24)) - {2 * i + 1 for i in close} | {24}


def test_lists_are_checked_on_full_sets(spark):
    """Members of one list that are not alike stay apart, and those alike are linked whatever their hub."""
    words = [f"w{n}" for n in range(200)]
    texts = [" ".join(words), " ".join(words[:190]), " ".join(words[::-1]), " ".join(words[::-1][:190]), "a b c d e"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    lists = docs.selectExpr("1L as key", "doc_id", "xxhash64(text) as version")
    found = superminhash.near_copies(docs, words=5, percent=80, bands=1, rows=320, lists=lists)
    assert {r.doc_id: r.component_id for r in found.collect()} == {0: 0, 1: 0, 2: 2, 3: 2, 4: 4}
