"""Importance resampling, spelling variants and SuperMinHash against brute force, through the registered queries as well."""

import hashlib
import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from orbivec.llm import importance, spelling, superminhash
from orbivec.llm.queries import QUERIES

RNG = np.random.default_rng(11)
WORDS = [f"{a}{b}{c}" for a in ("stra", "kom", "übe", "lin") for b in ("ße", "mi", "xa", "ro") for c in ("n", "ter", "l", "")]


def words(n):
    return " ".join(RNG.choice(WORDS, n))


BASE = words(120)
TEXTS = [None, "", " \n\t", "One", "two Words here", BASE, BASE, BASE.upper(), BASE + " tail", BASE.replace("kommi", "kommu", 1), words(25), words(25), words(6000), "a.b-c\x00d É×é ÷ 1२3",
         " ".join(BASE.split()[:100]) + " " + words(20), words(3), "x" * 70_000, "Xaro " * 40] + [words(int(n)) for n in RNG.integers(1, 60, 40)]


@pytest.fixture(scope="module")
def docs(spark, tmp_path_factory):
    """Nulls, empty and long texts, repeated rows, two texts of one id, no id, and columns that clash with the operators' own."""
    rows = [(n, t, "x", 1, [2]) for n, t in enumerate(TEXTS)] + [(6, BASE, "x", 1, [2]), (6, words(30), "y", 2, None), (None, words(30), "z", 3, []), (None, None, "z", 3, [])]
    return spark.createDataFrame(rows, "doc_id long, text string, node string, version int, keys array<int>").withColumn("word", F.lit("w")).withColumn("n", F.lit(1)).withColumn("score", F.lit(0.5)).withColumn("bucket", F.lit("b"))


@pytest.fixture(scope="module")
def folder(spark, docs, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("tables"))
    docs.write.parquet(f"{path}/documents.parquet")
    bench(spark).write.parquet(f"{path}/benchmark.parquet")
    return path


def bench(spark):
    return spark.createDataFrame([(1, words(30), 5), (2, None, 5), (None, "Straßen kommi", 5)], "item_id long, text string, bucket int")


def rows_of(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def lowered(text):
    return (text or "").translate({n: n + 32 for n in range(65, 91)})


def test_importance_brute_force(spark, docs, folder):
    target = [r.text for r in spark.read.parquet(f"{folder}/benchmark.parquet").collect()]

    def features(text):
        w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lowered(text))
        return len(w), [zlib.crc32(f.encode()) % 10_000 for f in [*w, *(f"{a} {b}" for a, b in zip(w, w[1:]))]]

    s, t = Counter(b for r in docs.collect() for b in features(r.text)[1]), Counter(b for x in target for b in features(x)[1])
    all_s, all_t = sum(s.values()), sum(t.values())
    gain = [math.floor(1000 * math.log((t[b] + 1.0) * (all_s + 10_000) / ((s[b] + 1.0) * (all_t + 10_000)))) for b in range(10_000)]
    want = []
    for r in docs.collect():
        n, f = features(r.text)
        h = int(hashlib.sha256(f"7:{'null' if r.doc_id is None else r.doc_id}".encode()).hexdigest()[:8], 16)
        weight = sum(gain[b] for b in f) // len(f) if f else 0
        want.append([r.doc_id, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), n])
    drawn = sorted((w for w in want if w[4] >= 20), key=lambda w: (-w[3], w[0] is None, w[0] or 0))
    ranks = Counter()
    for place, w in enumerate(drawn[:len(drawn) * 25 // 100], 1):
        ranks[tuple(w[:4]), place] += 1
    got = QUERIES["op11_importance"](spark, folder).collect()
    assert sorted((str(tuple(w[:4])) for w in want)) == sorted(str((r.doc_id, r.n_features, r.weight, r.score)) for r in got)
    assert {(tuple(r)[:4], r["rank"]) for r in got if r["rank"]} == set(ranks)


@pytest.mark.parametrize("run", [1, 2, 3])
def test_runs_of_words_are_composed(run):
    text = " a é " + "y" * 200 + " z a é "
    found = text.split()
    want = [zlib.crc32(" ".join(found[i:i + n]).encode()) for n in range(1, run + 1) for i in range(len(found) - n + 1)]
    assert importance.Dictionary([text]).features(text, run).tolist() == want
    assert importance.Dictionary([" "]).features(" ", run).tolist() == []


def test_spelling_brute_force(spark, docs, folder):
    count = Counter()
    for r in docs.collect():
        for run in re.findall("[A-Za-zÀ-ÿ]+", r.text or ""):
            run = lowered(run)
            h = zlib.crc32(f"{'null' if r.doc_id is None else r.doc_id}:{run}".encode())
            count[run[:h % len(run)] + run[h % len(run) + 1:] if h % 97 == 0 else run] += 1
    count = {w: n for w, n in count.items() if len(w) >= 5 and n >= 3}

    def near(a, b):
        short, long = sorted((a, b), key=len)
        if len(short) == len(long):
            return sum(x != y for x, y in zip(a, b)) == 1
        return len(long) - len(short) == 1 and any(long[:i] + long[i + 1:] == short for i in range(len(long)))

    around = {w: sorted((-count[o], o) for o in count if o != w and near(w, o)) for w in count}
    form = {w: o[0][1] if o and -o[0][0] >= 2 * count[w] else None for w, o in around.items()}

    def root(w):
        return w if form[w] is None else root(form[w])

    want = sorted((w, n, len(around[w]), form[w] or "", count[form[w]] if form[w] else 0, root(w)) for w, n in count.items())
    got = QUERIES["op12_spelling"](spark, folder).collect()
    assert sorted((r.word, r.n, r.n_near, r.form or "", r.form_n or 0, r.root) for r in got) == want
    assert any(form.values()) and any(len(o) > 1 for o in around.values())


def test_no_side_of_a_spelling_join_is_broadcast(spark, docs):
    from tests.conftest import plan

    kept = spark.createDataFrame([("words", 3), ("wordz", 9)], "word string, n long")
    for found in (spelling.near(kept), spelling.variants(docs, 5, 1)):
        made = plan(found)
        assert "Broadcast" not in made and ("SortMergeJoin" in made)


def test_every_single_edit_is_near(spark):
    """Edits at every place of words of every small length, astral letters included."""
    pairs = []
    for size in range(5, 12):
        word = "abcdefghijkl\U00010400"[:size - 1] + "\U00010400"
        pairs += [(word, word[:i] + "ß" + word[i:]) for i in range(size + 1)] + [(word, word[:i] + "ß" + word[i + 1:]) for i in range(size)]
        pairs += [(word, word[:i] + word[i + 1:]) for i in range(size) if size > 5]
    made = spark.createDataFrame([(w, 3) for w in sorted({w for p in pairs for w in p})], "word string, n long")
    found = {frozenset((r.a, r.b)) for r in spelling.near(made).collect()}
    assert {frozenset(p) for p in pairs} <= found


def test_superminhash_brute_force(spark, docs, folder):
    rows = docs.collect()
    sets = [frozenset(" ".join(w[i:i + 4]) for i in range(max(1, len(w) - 3))) if (w := lowered(r.text).encode().split()) and (w := [x.decode() for x in w]) else frozenset() for r in rows]
    near = [[j for j, b in enumerate(sets) if i == j or a and 100 * len(a & b) >= 80 * len(a | b)] for i, a in enumerate(sets)]
    label = list(range(len(rows)))
    for _ in rows:
        label = [min(label[j] for j in of) for of in near]
    ids = [min((rows[j].doc_id for j in range(len(rows)) if label[j] == label[i] and rows[j].doc_id is not None), default=None) for i in range(len(rows))]
    want = sorted(str((r.doc_id, len(s), c, None if r.doc_id is None else r.doc_id == c)) for r, s, c in zip(rows, sets, ids))
    got = QUERIES["op13_superminhash"](spark, folder).collect()
    assert sorted(str((r.doc_id, r.n_shingles, r.component_id, r.kept)) for r in got) == want


def test_signatures_agree_as_sets_do():
    for size in (1, 7, 60, 900, 5000):
        a = np.unique(RNG.integers(0, 2**63, size).astype(np.uint64))
        b = np.concatenate([a[:size * 9 // 10], np.unique(RNG.integers(0, 2**63, size - size * 9 // 10).astype(np.uint64))])
        real = len(np.intersect1d(a, b)) / len(np.union1d(a, b))
        one, two = superminhash.signatures([a, np.sort(b)], 1024)
        assert abs((one == two).mean() - real) < 0.06 and one.max() < 2**64 - 1
    long = np.unique(RNG.integers(0, 2**63, 150_000).astype(np.uint64))  # more than one block
    alone, among = superminhash.signatures([long], 64)[0], superminhash.signatures([a, long, b], 64)[1]
    assert (alone == among).all()


def test_rarest_shingles_find_what_keys_leave_apart(spark):
    """Every alike pair of different labels is among the pairs, and a passage that all share makes none."""
    passage = list(range(70))
    sets = [sorted(passage + RNG.integers(1000, 10**9, 30).tolist()) for _ in range(40)]
    sets += [sorted(set(s[:95]) | {10**10 + n}) for n, s in enumerate(sets[:10])]
    table = [(n, np.array(s, np.uint64).tobytes()) for n, s in enumerate(sets)]
    found = superminhash.rarest(spark.createDataFrame([(n, n) for n, _ in table], "node long, label long"), spark.createDataFrame(table, "node long, grams binary"), 80)
    got = {(r.a, r.b) for r in found.collect()}
    alike = {(i, j) for i in range(50) for j in range(i + 1, 50) if superminhash.alike(np.array(sets[i], np.uint64), np.array(sets[j], np.uint64), 80)}
    assert alike and alike <= got and len(got) <= 2 * len(alike)


def test_empty_tables(spark, docs, tmp_path):
    docs.limit(0).write.parquet(f"{tmp_path}/documents.parquet")
    bench(spark).limit(0).write.parquet(f"{tmp_path}/benchmark.parquet")
    for name in ("op11_importance", "op12_spelling", "op13_superminhash"):
        assert QUERIES[name](spark, str(tmp_path)).collect() == []


def test_empty_target(spark, docs):
    got = importance.resampled(docs, bench(spark).limit(0)).collect()
    assert len(got) == docs.count() and sum(r["rank"] is not None for r in got) > 0
