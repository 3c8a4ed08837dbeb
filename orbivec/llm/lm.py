"""Language-model scores: a log-bilinear model trained by noise-contrastive estimation, over smoothed token counts.

Tokens are counted over all training texts. The most frequent ``CLASSES`` are classes of the neural model, all others
share one. From the classes of the two tokens before, the model predicts a vector, whose products with the classes'
vectors, plus biases, are the scores of what follows. Class trigrams are counted over all training texts and dealt to
shards, frequent ones in several parts of nearly equal weight; each round every shard takes noise-contrastive steps
from the same parameters, and the results are averaged. ``NOISE`` noise words for each real one enter by their
expectation over all classes, so they add no variance. As both context positions add up in the exponent, one matrix product gives the normaliser of every
context, so scoring looks up exactly normalised log-probabilities. A token of the shared class has, within it, its share
of the smoothed counts.

Frequent tokens' counts (``KNOWN`` at most) are looked up in memory; the rest of each text meets the counts in a
join by token, in which no token is frequent. Memory is bounded by these two numbers and one batch of texts.

Defined cases: null texts are empty and have the end token alone; a null id is in the training part; repeated rows count
and are scored each; without training texts every token has probability 1. Other columns are not read.
"""

from __future__ import annotations

from collections import Counter
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orbivec.llm.registry import query, table
from orbivec.llm.texts import col
from orbivec.session import materialise

CLASSES = 511
KNOWN = 65_536
DIMS, NOISE, ROUNDS, SHARDS, BATCH, STEP = 24, 64, 6, 16, 512, 0.05
#: A task hands on what it made from this many tokens at once.
FLUSH = 1_000_000
END = b""  # no word is empty


def tokens_of(text: str | None) -> list[bytes]:
    """Words, lower-cased A-Z, between ASCII white space, then the end."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    words.append(END)
    return words


def counted(texts: DataFrame) -> DataFrame:
    """``(token, n)`` of all texts (their only column)."""

    def run(batches):
        seen: Counter = Counter()

        def flush():
            made = pa.RecordBatch.from_arrays([pa.array(list(seen), pa.binary()), pa.array(list(seen.values()), pa.int64())], names=["token", "n"])
            seen.clear()
            return made

        for batch in batches:
            for t in batch.column(0):
                seen.update(tokens_of(t.as_py()))
                if len(seen) > 300_000:
                    yield flush()
        yield flush()

    return texts.mapInArrow(run, "token binary, n long").groupBy("token").agg(F.sum("n").alias("n"))


def classes_of(found: np.ndarray, classes: int) -> np.ndarray:
    """Class of each token from its rank among the known (-1: not known)."""
    return np.where((found >= 0) & (found < classes), found, classes)


def contexts(ids: np.ndarray, start: int) -> tuple[np.ndarray, np.ndarray]:
    """The class before each token, and the one before that."""
    padded = np.concatenate(([start, start], ids))
    return padded[1:-1], padded[:-2]


def trigrams(texts: DataFrame, rank: dict[bytes, int], classes: int) -> DataFrame:
    """``(key, n)``: how often a class follows two others; key is (second before, before, class) as one number."""
    shared = texts.sparkSession.sparkContext.broadcast({t: r for t, r in rank.items() if r < classes})

    def run(batches):
        get, start = shared.value.get, classes + 1
        for batch in batches:
            keys, have = [], 0

            def flush():
                key, n = np.unique(np.concatenate(keys), return_counts=True)
                return pa.RecordBatch.from_arrays([pa.array(key), pa.array(n)], names=["key", "n"])

            for t in batch.column(0):
                words = tokens_of(t.as_py())
                ids = classes_of(np.fromiter(map(get, words, repeat(-1)), np.int64, len(words)), classes)
                one, two = contexts(ids, start)
                keys.append((two * (classes + 2) + one) * (classes + 2) + ids)
                have += len(ids)
                if have > FLUSH:
                    yield flush()
                    keys, have = [], 0
            if keys:
                yield flush()

    return texts.mapInArrow(run, "key long, n long").groupBy("key").agg(F.sum("n").alias("n"))


def _rows(at: np.ndarray, values: np.ndarray, rows: int) -> np.ndarray:
    """Sums of ``values``' rows by their place."""
    flat = (at[:, None] * values.shape[1] + np.arange(values.shape[1])).ravel()
    return np.bincount(flat, values.ravel(), rows * values.shape[1]).reshape(rows, -1)


class LogBilinear:
    """Parameters: context vectors, a matrix per position, class vectors, biases; all as one flat array too."""

    def __init__(self, classes: int, flat: np.ndarray | None = None, prior: np.ndarray | None = None, seed: int = 1):
        self.classes, rows = classes, classes + 2
        shapes = [(rows, DIMS), (DIMS, DIMS), (DIMS, DIMS), (classes + 1, DIMS), (classes + 1,)]
        sizes = [int(np.prod(s)) for s in shapes]
        if flat is None:
            rng = np.random.default_rng(seed)
            flat = np.concatenate([rng.normal(0, 0.1, sizes[0]), np.eye(DIMS).ravel(), 0.5 * np.eye(DIMS).ravel(), rng.normal(0, 0.1, sizes[3]), np.log(prior)])
        self.flat = np.array(flat, np.float32)
        self.context, self.one, self.two, self.word, self.bias = (p.reshape(s) for p, s in zip(np.split(self.flat, np.cumsum(sizes)[:-1]), shapes, strict=True))

    def step(self, two, one, word, share, noise, memory) -> None:
        """One noise-contrastive step (Adagrad) on a batch; ``share`` is each example's part in it, ``noise`` the classes' expected noise words."""
        r1, r2 = self.context[one], self.context[two]
        h = r1 @ self.one + r2 @ self.two
        at = np.arange(len(word))
        up = 1 / (1 + np.exp(-np.clip(h @ self.word.T + (self.bias - np.log(noise)), -30, 30)))  # chance of being real
        real = 1 - up[at, word]
        up *= -noise
        up[at, word] += real
        up *= share[:, None]
        gh = up @ self.word
        grad = LogBilinear(self.classes, np.zeros(len(self.flat)))
        grad.word += up.T @ h
        grad.bias += up.sum(0)
        grad.context += _rows(np.concatenate((one, two)), np.concatenate((gh @ self.one.T, gh @ self.two.T)), len(self.context))
        grad.one += r1.T @ gh
        grad.two += r2.T @ gh
        memory += grad.flat**2
        self.flat += STEP * grad.flat / np.sqrt(memory)

    def tables(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Scores by (before, class) with bias, by (second before, class), and log normalisers by (before, second before)."""
        context, word = self.context.astype(float), self.word.astype(float)
        one, two = context @ self.one @ word.T + self.bias, context @ self.two @ word.T
        a, b = one.max(1, keepdims=True), two.max(1, keepdims=True)
        return one, two, np.log(np.exp(one - a) @ np.exp(two - b).T) + a + b.T


def train(counts: DataFrame, prior: np.ndarray, classes: int) -> LogBilinear:
    """Rounds of steps by shards of the trigram counts; between rounds, the mean of the shards by their tokens."""
    spark = counts.sparkSession
    counts = materialise(counts, "trigrams")
    total, kinds = counts.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).first()
    mean = total / max(kinds, 1)
    copies = F.ceil(F.col("n") / F.lit(mean)) if total else F.lit(1)
    dealt = counts.select("key", (F.col("n") / copies).alias("weight"), F.explode(F.sequence(F.lit(1), copies.cast("int"))).alias("copy"))  # at most twice the rows
    dealt = materialise(dealt.repartition(SHARDS, "key", "copy").select("key", "weight"), "dealt")
    model = LogBilinear(classes, prior=prior)
    size = len(model.flat)
    noise = (NOISE * prior).astype(np.float32)
    for round_ in range(ROUNDS):
        shared = spark.sparkContext.broadcast(model.flat)

        def run(batches, shared=shared, round_=round_):
            shard = TaskContext.get().partitionId()
            own, rng, memory, tokens = LogBilinear(classes, shared.value), np.random.default_rng([round_, shard]), np.full(size, 1e-6, np.float32), 0.0
            base = classes + 2
            for batch in batches:
                key, weight = batch.column(0).to_numpy(), batch.column(1).to_numpy()
                order = rng.permutation(len(key))
                for at in range(0, len(key), BATCH):
                    k, w = key[order[at:at + BATCH]], weight[order[at:at + BATCH]]
                    own.step(k // (base * base), k // base % base, k % base, (w / (mean * BATCH)).astype(np.float32), noise, memory)
                tokens += float(weight.sum())
            if tokens:
                yield pa.RecordBatch.from_arrays([pa.array([shard]), pa.array([tokens]), pa.array([own.flat.astype(float).tolist()])], names=["shard", "tokens", "flat"])

        parts = sorted(dealt.mapInArrow(run, "shard long, tokens double, flat array<double>").collect(), key=lambda r: r.shard)  # one row of fixed size a shard
        shared.unpersist()
        if parts:
            model = LogBilinear(classes, np.average([p.flat for p in parts], axis=0, weights=[p.tokens for p in parts]))
    return model


def scored(docs: DataFrame, training=None, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row: ``doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score``; scores are log10 probabilities.

    ``training`` is a condition on rows; by default crc32 of the id modulo 5 is not 1.
    """
    spark = docs.sparkSession
    held = F.coalesce(F.crc32(col(doc_id).cast("string")) % 5 == 1, F.lit(False)) if training is None else ~F.coalesce(training, F.lit(True))
    rows = docs.select(col(doc_id).cast("long").alias("doc_id"), held.alias("held_out"), col(text).cast("string").alias("text"))
    learnt = rows.where(~F.col("held_out")).select("text")
    counts = materialise(counted(learnt), "counts")
    total, kinds = counts.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).first()
    top = counts.orderBy(F.desc("n"), "token").limit(KNOWN).toPandas()
    rank = {bytes(t): r for r, t in enumerate(top["token"])}
    classes = min(CLASSES, len(rank))
    denominator = total + 0.5 * (kinds + 1)
    share = (top["n"].to_numpy(float) + 0.5) / denominator
    rest = max(1 - share[:classes].sum(), 1e-300)  # of the shared class
    prior = np.append(share[:classes], max(rest, 1e-9))
    model = train(trigrams(learnt, rank, classes), prior / prior.sum(), classes)
    shared = spark.sparkContext.broadcast((rank, np.log10(share), model.tables()))

    def run(batches):
        ranks, logs, (one_t, two_t, norm) = shared.value
        get, row = ranks.get, TaskContext.get().partitionId() << 40
        for batch in batches:
            at, have, out, rare, times, ends = 0, 0, [], [], [], [0]
            for i, t in enumerate(batch.column(2)):
                words = tokens_of(t.as_py())
                found = np.fromiter(map(get, words, repeat(-1)), np.int64, len(words))
                ids = classes_of(found, classes)
                one, two = contexts(ids, classes + 1)
                neural = float((one_t[one, ids] + two_t[two, ids] - norm[one, two]).sum()) / np.log(10)
                known = found[found >= 0]
                within = float(logs[known[known >= classes]].sum()) - int((ids == classes).sum()) * np.log10(rest)
                more = Counter(words[j] for j in np.flatnonzero(found < 0).tolist())
                rare.extend(more)
                times.extend(more.values())
                ends.append(len(rare))
                out.append((row, len(words), len(known), float(logs[known].sum()), neural + within))
                row, have = row + 1, have + len(words)
                if have > FLUSH or i + 1 == batch.num_rows:
                    made = [pa.array(x, k) for x, k in zip(zip(*out, strict=True), (pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.float64()), strict=True)]
                    lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.StructArray.from_arrays([pa.array(rare, pa.binary()), pa.array(times, pa.int64())], names=["token", "n"]))
                    whose = [batch.column(c).slice(at, len(out)) for c in (0, 1)]
                    yield pa.RecordBatch.from_arrays([made[0], *whose, *made[1:], lists], names=["row", "doc_id", "held_out", "n_tokens", "n_known", "base", "score", "rare"])
                    at, have, out, rare, times, ends = i + 1, 0, [], [], [], [0]

    schema = "row long, doc_id long, held_out boolean, n_tokens long, n_known long, base double, score double, rare array<struct<token:binary,n:long>>"
    made = materialise(rows.mapInArrow(run, schema), "scored")
    rare = made.select("row", F.explode("rare").alias("r")).select("row", "r.token", F.col("r.n").alias("times"))
    p = F.log10((F.coalesce("n", F.lit(0)) + 0.5) / F.lit(denominator))
    sums = rare.join(counts, "token", "left").groupBy("row").agg(F.sum(F.col("times") * p).alias("more"), F.sum(F.when(F.col("n") > 0, F.col("times")).otherwise(0)).alias("more_known"))
    more = F.coalesce("more", F.lit(0.0))
    return made.drop("rare").join(sums, "row", "left").select(
        "doc_id", "held_out", "n_tokens", (F.col("n_known") + F.coalesce("more_known", F.lit(0))).alias("n_known"), F.lit(total).cast("long").alias("train_tokens"),
        (F.col("base") + more).alias("base_score"), (F.col("score") + more).alias("score"))


@query("op6_language_model")
def op6_language_model(spark, sf_dir):
    return scored(table(spark, sf_dir, "documents"))
