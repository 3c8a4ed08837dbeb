"""Secret scans: known forms, and a battery of randomness tests with false-discovery control.

Known forms are matched as they are (see ``KINDS``). Besides, every run of sixteen or more characters of the base-64
alphabets is a candidate. Its encoding is the smallest alphabet that holds it, and three tests ask whether it could be
uniform draws from that alphabet: chi-squared of its symbol counts, runs above and below the middle, and correlation of
neighbours; Fisher's sum makes them one p-value, and candidates under ``RANDOM`` are not random. The other way round,
two bounds say how likely ordinary text is to look like it: symbols coincide less than in prose, or letters, capitals
and digits alternate more. The smaller, doubled, is the p-value against ordinary text. Both tests gain with length, so
candidates are controlled within bands of length: Benjamini and Hochberg's step at ``RATE`` over the p-values of all
candidates of a band, counted by bins of a tenth of a decimal order. What passes, and lies in no known form, is added
as ``random``.

Only column expressions are used. What is collected is one cut per band. Defined cases: null texts are empty; repeated
rows are scanned each; an empty table gives no rows; other columns are kept under ``doc``.
"""

from __future__ import annotations

import string
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from orbivec.llm.registry import query, table
from orbivec.llm.texts import col, spans_of, text_of
from orbivec.session import materialise

# The known forms, and how many characters of which group they need.
ASSIGN = r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
KINDS = [("assign", ASSIGN, 2, 12), ("access", r"(AKIA[A-Z0-9]+)", 1, 18), ("hex", r"([0-9a-f]{16,})", 1, 16)]
#: A necessary condition that is quick to look for.
GATES = {"assign": r"(?i:passw|secret|token|api_?key)", "access": "AKIA", "hex": r"[0-9a-f]{16}"}

CANDIDATE = r"[A-Za-z0-9+/_-]{16,}"
#: Alphabets from small to large, with the pattern of strings over them.
ALPHABETS = [("[0-9]+", string.digits), ("[0-9a-f]+", string.digits + "abcdef"), ("[0-9A-F]+", string.digits + "ABCDEF"),
             ("[a-z]+", string.ascii_lowercase), ("[A-Z]+", string.ascii_uppercase), ("[A-Z2-7]+", string.ascii_uppercase + "234567"),
             ("[0-9a-z]+", string.digits + string.ascii_lowercase), ("[0-9A-Z]+", string.digits + string.ascii_uppercase),
             ("[A-Za-z]+", string.ascii_letters), ("[A-Za-z0-9]+", string.digits + string.ascii_letters),
             ("[A-Za-z0-9_-]+", string.digits + string.ascii_letters + "-_"), (".+", string.digits + string.ascii_letters + "+/-_")]
#: From this length on, a band of its own.
BANDS = (16, 24, 40)
RATE, RANDOM = 0.01, 0.001
# Fixed values of prose: chance that two letters are equal, that three are, and that neighbours in a word differ in class.
SAME2, SAME3, CHANGES = 0.0667, 0.0053, 0.08


def _tail(z: Column) -> Column:
    """Upper tail of the normal distribution (logistic approximation)."""
    return 1 / (1 + F.exp(F.least(1.5976 * z + 0.07056 * z * z * z, F.lit(600.0))))


def _tests(token: Column) -> Column:
    """(bin, random): tenths of decimal orders of the p-value against ordinary text, and the p-value of randomness."""
    n = F.length(token).cast("double")
    alphabet = reduce(lambda acc, a: acc.when(token.rlike(f"^{a[0]}$"), F.lit(a[1])), ALPHABETS[1:], F.when(token.rlike(f"^{ALPHABETS[0][0]}$"), F.lit(ALPHABETS[0][1])))
    symbols = F.split(token, "")
    facts = F.struct(n.alias("n"), F.length(alphabet).cast("double").alias("k"), F.transform(symbols, lambda c: (F.call_function("position", c, alphabet) - 1).cast("double")).alias("v"),
                     F.aggregate(F.array_distinct(symbols), F.lit(0.0), lambda a, c: a + F.pow(n - F.length(F.replace(token, c, F.lit(""))), F.lit(2.0))).alias("squares"),
                     F.translate(F.regexp_replace(token, "[+/_-]", ""), string.ascii_lowercase + string.ascii_uppercase + string.digits, "a" * 26 + "A" * 26 + "0" * 10).alias("classes"))

    def battery(f):
        n, k = f.n, f.k
        chi = (k / n * f.squares - n - (k - 1)) / F.sqrt(2 * (k - 1) * (n - 1) / n)
        size = n.cast("int")
        pairs = F.arrays_zip(F.slice(f.v, F.lit(1), size - 1).alias("a"), F.slice(f.v, F.lit(2), size - 1).alias("b"))
        flips = F.aggregate(pairs, F.lit(0.0), lambda acc, p: acc + F.when((p.a * 2 >= k) != (p.b * 2 >= k), 1.0).otherwise(0.0))
        runs = F.abs(flips - (n - 1) / 2) / F.sqrt((n - 1) / 4)
        middle = (k - 1) / 2
        serial = F.aggregate(pairs, F.lit(0.0), lambda acc, p: acc + (p.a - middle) * (p.b - middle)) / (F.sqrt(n - 1) * (k * k - 1) / 12)
        x = -F.log(_tail(chi)) - F.log(2 * _tail(runs)) - F.log(2 * _tail(F.abs(serial)))
        random = F.exp(-x) * (1 + x + x * x / 2)
        same = (f.squares - n) / (n * (n - 1))
        spread = F.sqrt((2 * SAME2 * (1 - SAME2) + 4 * (n - 2) * (SAME3 - SAME2 * SAME2)) / (n * (n - 1)))
        prose = F.log10(_tail((SAME2 - same) / spread))
        m = F.length(f.classes) - 1.0
        changes = (m + 1 - F.length(F.regexp_replace(f.classes, r"(?<=a)[A0]|(?<=A)[a0]|(?<=0)[aA]", ""))) / F.greatest(m, F.lit(1.0))
        rest = 1 - changes
        excess = changes * F.log(F.greatest(changes, F.lit(1e-9)) / CHANGES) + rest * F.log(F.greatest(rest, F.lit(1e-9)) / (1 - CHANGES))
        classes = F.when(changes > CHANGES, -m * excess / 2.302585092994046).otherwise(0.0)
        p = F.least(F.least(prose, classes) + 0.3010299956639812, F.lit(0.0))
        return F.struct(F.least(F.floor(-p * 10), F.lit(600)).cast("int").alias("bin"), random.alias("random"), sum((F.when(n >= b, 1).otherwise(0) for b in BANDS), F.lit(0)).alias("band"))

    return F.transform(F.array(facts), battery)[0]


def _known(text: Column) -> Column:
    """All spans of known forms: array of (start, kind, end), kinds by their place in ``KINDS``."""
    nothing = F.expr("cast(array() as array<struct<start:int,kind:int,end:int>>)")

    def of(n, kind, pattern, group, least):
        spans = F.filter(spans_of(text, F.lit(pattern)), lambda s: F.length(F.regexp_extract(s.found, pattern, group)) >= least)
        spans = F.transform(spans, lambda s: F.struct(s.start.alias("start"), F.lit(n).alias("kind"), s.end.alias("end")))
        return F.when(text.rlike(GATES[kind]), spans).otherwise(nothing)

    return F.concat(*[of(n, *k) for n, k in enumerate(KINDS)])


def cuts(candidates: DataFrame) -> dict[int, int]:
    """The least bin of each band that the step allows, from ``(band, bin)`` of all candidates."""
    from pyspark.sql import Window

    counts = candidates.groupBy("band", "bin").agg(F.count("*").alias("n"))
    above = F.sum("n").over(Window.partitionBy("band").orderBy(F.desc("bin")))  # at most 601 rows a band
    total = F.sum("n").over(Window.partitionBy("band"))
    passed = counts.select("band", "bin", above.alias("above"), total.alias("total")).where(F.col("total") * F.pow(F.lit(10.0), -F.col("bin") / 10) <= RATE * F.col("above"))
    return {r.band: r.bin for r in passed.groupBy("band").agg(F.min("bin").alias("bin")).collect()}


def scan(docs: DataFrame, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """Per row: ``doc`` (its columns, or those of ``keep``), ``base`` and ``added``, sorted arrays of (start, kind, end).

    Kinds are numbers: places in ``KINDS``, and after them ``random``.
    """
    row = F.struct(*[col(c) for c in (docs.columns if keep is None else keep)])
    whole = text_of(text)
    rows = docs.select(row.alias("doc"), whole.alias("text")).select("doc", F.array_sort(_known(F.col("text"))).alias("base"), spans_of(F.col("text"), F.lit(CANDIDATE)).alias("runs"))
    rows = rows.select("doc", "base", F.transform("runs", lambda s: F.struct(s.start.alias("start"), F.lit(len(KINDS)).alias("kind"), s.end.alias("end"), _tests(s.found).alias("is"))).alias("runs"))
    rows = materialise(rows, "candidates")
    least = cuts(rows.select(F.explode("runs").alias("run")).select("run.is.band", "run.is.bin"))
    base = F.col("base")

    def passes(s):
        enough = [(s["is"].band == band) & (s["is"].bin >= cut) for band, cut in least.items()]
        inside = F.exists(base, lambda b: (b.start <= s.start) & (s.end <= b.end))
        return reduce(lambda a, b: a | b, enough, F.lit(False)) & (s["is"].random >= RANDOM) & ~inside

    added = F.transform(F.filter("runs", passes), lambda s: F.struct(s.start.alias("start"), s.kind.alias("kind"), s.end.alias("end")))
    return rows.select("doc", "base", added.alias("added"))


def redacted(docs: DataFrame, text: str = "text", mark: str = "[secret]") -> DataFrame:
    """All rows and columns; every span, overlapping ones as one, is replaced by ``mark``."""
    rows = scan(docs, text)
    whole = F.coalesce(F.col("doc").getField(text).cast("string"), F.lit(""))
    start = F.struct(F.lit(0).alias("at"), F.expr("cast(array() as array<string>)").alias("parts"))

    def step(acc, s):
        piece = F.array(F.substring(whole, acc.at + 1, s.start - acc.at), F.lit(mark))
        return F.struct(F.greatest(acc.at, s.end).alias("at"), F.when(s.start < acc.at, acc.parts).otherwise(F.concat(acc.parts, piece)).alias("parts"))

    clean = F.aggregate(F.array_sort(F.concat("base", "added")), start, step, lambda acc: F.concat(F.array_join(acc.parts, ""), F.substring(whole, acc.at + 1, F.length(whole))))
    made = F.when(F.size(F.concat("base", "added")) == 0, F.col("doc").getField(text)).otherwise(clean)
    return rows.select(F.col("doc").withField(f"`{text}`", made).alias("doc")).select("doc.*")


def _written(spans: Column) -> Column:
    names = F.array(*[F.lit(k[0]) for k in KINDS], F.lit("random"))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s.kind), s.start.cast("string"), s.end.cast("string"))), ",")


@query("op3_secrets")
def op3_secrets(spark, sf_dir):
    found = scan(table(spark, sf_dir, "documents"), keep=["doc_id"])
    kinds = F.transform("base", lambda s: s.kind)
    counts = [(F.size(kinds) - F.size(F.array_remove(kinds, n))).cast("long").alias(f"n_{k[0]}") for n, k in enumerate(KINDS)]
    return found.select("doc.doc_id", *counts, F.sha2(_written(F.col("base")), 256).alias("base_sha256"), _written(F.array_sort(F.concat("base", "added"))).alias("spans"))
