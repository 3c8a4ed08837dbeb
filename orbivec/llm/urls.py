"""URL filter: host and path rules, and a character model's log-likelihood ratio for what no rule fits.

Two variable-order Markov models, of accepted and of rejected URLs, are learnt from the URLs that the rules decide: every
character is predicted from up to five before it, each order smoothed towards the next shorter one, so unseen contexts
fall back. The URL's score is the difference of both log-likelihoods per character; the threshold is the one that parts
held-out accepted and rejected URLs best (mean of both rates), and URLs at or above it are allowed.

Counts are exact: an n-gram of up to six bytes is its own key, and the counts are a table that no task holds as a whole.
Distinct judged strings are dealt to chunks of about ``CHUNK``; each chunk's distinct n-grams meet the counts in a join.

Defined cases: a URL that is null or holds no ``://`` has an empty host and path, and is judged as the empty string by
the model. Without accepted or without rejected URLs the model allows all. Repeated rows are judged, and counted, each.
Null ids are in the training part. Other columns are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from orbivec.llm.registry import query, table
from orbivec.llm.texts import col, lower_ascii
from orbivec.session import materialise

ORDER = 5
#: Distinct judged strings that are scored together.
CHUNK = 2000
#: How strongly a context leans on the next shorter one.
WEIGHT = 2.0
HELD_OUT = 5
#: Scores per character as whole hundredths between these limits.
LIMIT = 1000
_START, _END = 2, 3


def parts(url: Column) -> tuple[Column, Column]:
    """Host and path."""
    at = F.instr(url, "://")
    rest = F.coalesce(F.when(at > 0, F.substring(url, at + 3, F.length(url))), F.lit(""))
    return lower_ascii(F.regexp_extract(rest, r"^([^/?#]*)", 1)), F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def ruled(host: Column, path: Column, rules: list[tuple[str, str]]) -> tuple[Column, Column]:
    """The longest fitting rule and its verdict, else nulls. A rule is (verdict, host and path); of equal length the first."""
    rule = verdict = None
    for said, name in sorted(rules, key=lambda r: -len(r[1])):
        h, slash, p = name.partition("/")
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(slash + p)
        rule = F.when(fits, name) if rule is None else rule.when(fits, name)
        verdict = F.when(fits, said) if verdict is None else verdict.when(fits, said)
    nothing = F.lit(None).cast("string")
    return (nothing, nothing) if rule is None else (rule, verdict)


def grams(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Keys of the n-grams that end at each character (one row per length, -1 where it would start before the text), and each text's bounds."""
    joined = np.frombuffer(b"".join(bytes([_START]) + t + bytes([_END]) for t in texts), np.uint8).astype(np.int64)
    ends = np.cumsum([len(t) + 2 for t in texts])
    starts = ends - [len(t) + 2 for t in texts]
    place = np.arange(len(joined)) - np.repeat(starts, ends - starts)
    keys, acc = np.full((ORDER + 1, len(joined)), -1), np.zeros(len(joined), np.int64)
    for n in range(ORDER + 1):
        acc[n:] += joined[:len(joined) - n] << 8 * n
        keys[n] = np.where(place >= n, acc | n << 8 * (ORDER + 1), -1)
    return keys, starts, ends


def counted(rows: DataFrame) -> DataFrame:
    """``(gram, rejected, accepted)``: exact counts of rows ``(text, accepted)``."""

    def run(batches):
        for batch in batches:
            texts, labels = batch.column(0).to_pylist(), np.array(batch.column(1).to_pylist(), bool)
            for accepted in (False, True):
                own = [t.encode("utf-8", "surrogatepass") for t, a in zip(texts, labels, strict=True) if a == accepted]
                if not own:
                    continue
                keys = grams(own)[0]
                key, count = np.unique(keys[keys >= 0], return_counts=True)
                none = np.zeros(len(key), np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(key), *map(pa.array, (none, count) if accepted else (count, none))], names=["gram", "rejected", "accepted"])

    found = rows.mapInArrow(run, "gram long, rejected long, accepted long")
    return found.groupBy("gram").agg(F.sum("rejected").alias("rejected"), F.sum("accepted").alias("accepted"))


def ratios(texts: list[bytes], known: np.ndarray, counts: np.ndarray, totals: np.ndarray) -> np.ndarray:
    """Log-likelihood of accepted less that of rejected, per character (the end counts as one).

    ``counts`` are those of the sorted grams ``known``, by model (0 rejected, 1 accepted); ``totals`` those of all characters.
    """
    keys, starts, ends = grams(texts)
    scored = np.ones(keys.shape[1], bool)
    scored[starts] = False  # the start mark is given
    total = np.zeros(keys.shape[1])
    known, counts = np.append(known, np.iinfo(np.int64).max), np.append(counts, np.zeros((2, 1)), axis=1)
    at = np.searchsorted(known, keys)
    at = np.where(known[at] == keys, at, len(known) - 1)
    for model, sign in ((1, 1.0), (0, -1.0)):
        p = np.full(keys.shape[1], 1 / 256)
        for n in range(ORDER + 1):
            valid = keys[n] >= 0
            seen = np.where(valid, counts[model][at[n]], 0)
            if n:
                context = np.where(valid, counts[model][np.concatenate(([0], at[n - 1][:-1]))], 0)
            else:
                context = np.full(len(p), totals[model])
            p = np.where(valid, (np.minimum(seen, context) + WEIGHT * p) / (context + WEIGHT), p)
        total += sign * np.log(p)
    sums = np.add.reduceat(np.where(scored, total, 0), starts)
    return sums / (ends - starts - 1)


def scores(texts: DataFrame, counts: DataFrame) -> DataFrame:
    """``(judged, score)`` of the distinct strings ``judged``."""
    texts = materialise(texts.select("judged").distinct(), "judged")
    chunks = texts.count() // CHUNK + 1
    chunk = F.pmod(F.xxhash64("judged"), F.lit(chunks))
    single = F.col("gram") < F.lit(1 << 8 * (ORDER + 1))  # one character
    totals = np.array(counts.where(single).agg(*(F.coalesce(F.sum(c), F.lit(0)) for c in ("rejected", "accepted"))).first(), float)

    def own(batches):
        for batch in batches:
            whose, strings = batch.column(0).to_numpy(), batch.column(1).to_pylist()
            for c in np.unique(whose):
                keys = grams([strings[i].encode("utf-8", "surrogatepass") for i in np.flatnonzero(whose == c)])[0]
                key = np.unique(keys[keys >= 0])
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(key), c, np.int64)), pa.array(key)], names=["chunk", "gram"])

    def judged(left: pa.Table, right: pa.Table) -> pa.Table:
        strings = left.column("judged").to_pylist()
        known = right.column("gram").to_numpy()
        order = np.argsort(known)
        found = np.stack([right.column(c).to_numpy()[order] for c in ("rejected", "accepted")]).astype(float)
        made = ratios([t.encode("utf-8", "surrogatepass") for t in strings], known[order], found, totals) if strings else np.zeros(0)
        return pa.table({"judged": pa.array(strings, pa.string()), "score": pa.array(made, pa.float64())})

    dealt = texts.select(chunk.alias("chunk"), "judged").repartition("chunk")
    asked = dealt.sortWithinPartitions("chunk").mapInArrow(own, "chunk long, gram long").distinct()
    met = asked.join(counts, "gram")
    return dealt.groupBy("chunk").cogroup(met.groupBy("chunk")).applyInArrow(judged, "judged string, score double")


def threshold(rows: DataFrame) -> float:
    """The score that parts ``(score, accepted)`` best; of equally good ones that nearest 0."""
    bins = F.least(F.greatest(F.round(F.col("score") * 100), F.lit(-LIMIT)), F.lit(LIMIT)).cast("int").alias("bin")
    found = rows.groupBy(bins, "accepted").agg(F.count("*").alias("n")).collect()  # at most 2 x 2001 rows
    by = np.zeros((2, 2 * LIMIT + 2))
    for r in found:
        by[int(r.accepted), r.bin + LIMIT] += r.n
    if not by.sum(1).all():
        return -float("inf")
    accepted_above = by[1][::-1].cumsum()[::-1] / by[1].sum()
    rejected_below = 1 - by[0][::-1].cumsum()[::-1] / by[0].sum()
    good = accepted_above + rejected_below
    best = np.flatnonzero(good >= good.max() - 1e-12)
    return float((best[np.argmin(np.abs(best - LIMIT))] - LIMIT - 0.5) / 100)


def judge(pages: DataFrame, rules: list[tuple[str, str]], page_id: str = "page_id", url: str = "url") -> DataFrame:
    """``(page_id, host, path, rule, verdict, score)`` of every row."""
    host, path = parts(col(url).cast("string"))
    rows = pages.select(col(page_id).alias("page_id"), host.alias("host"), path.alias("path"))
    rule, verdict = ruled(F.col("host"), F.col("path"), rules)
    rows = rows.select("*", F.concat("host", "path").alias("judged"), rule.alias("rule"), verdict.alias("said"))
    rows = rows.withColumn("held", F.coalesce(F.crc32(F.col("page_id").cast("string")) % HELD_OUT == 0, F.lit(False)))
    labelled = rows.where(F.col("said").isNotNull()).select("judged", (F.col("said") == "allow").alias("accepted"), "held")
    counts = materialise(counted(labelled.where(~F.col("held")).select("judged", "accepted")), "grams")
    found = materialise(scores(rows, counts), "scores")
    least = threshold(labelled.where("held").join(found, "judged").select("score", "accepted"))
    model = F.when(F.col("score") >= least, "allow").otherwise("block")
    return rows.join(found, "judged").select("page_id", "host", "path", "rule", F.coalesce("said", model).alias("verdict"), "score")


#: The rules of the registered query.
RULES = [("allow", "com/"), ("block", "example.com/en/"), ("allow", "www.example.com/en/"), ("block", "net/es/"), ("block", "net/fr/")]


@query("op1_url_filter")
def op1_url_filter(spark, sf_dir):
    return judge(table(spark, sf_dir, "pages"), RULES)
