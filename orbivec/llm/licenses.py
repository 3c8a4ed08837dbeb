"""License scans: ordered signature rules over normalised words.

A document is looked at by the rules only if it holds one of their keywords, and a rule only if it holds its own. All
matches of all rules are detections, intervals of words. In order of their start, longest first, a detection is
suppressed if one of its priority or a better one covers it; the rest give the labels and, by their confidences, the
score (1 - product of 1 - confidence over labels). Fixed phrases (``BASE``) are counted besides, and their labels stay.

Only column expressions are used; rows are judged where they lie, nothing is shuffled. Defined cases: null and empty
texts have no words, no labels and score 0; repeated rows are judged each; other columns are kept under ``doc``.
"""

from __future__ import annotations

import json
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from orbivec.llm.license_rules import RULES, Rule
from orbivec.llm.registry import query, table
from orbivec.llm.texts import GAP, col, lower_ascii, spaces_in, spans_of, text_of

# The phrases that are always reported, and their labels.
BASE = [("cc by", "cc-by"), ("general public license", "gpl"), ("all rights reserved", "reserved")]
LEVELS = 5
_DETECTION = "array<struct<start:int,end:int,priority:int,label:string,confidence:double>>"


def normalised(text: Column) -> Column:
    """Words with a space around each: `` a b c ``; one space if there are none."""
    return F.concat(F.lit(" "), F.ltrim(F.concat(F.regexp_replace(lower_ascii(text), GAP, " "), F.lit(" "))))


def squeezed(text: Column) -> Column:
    """``normalised``, with the doubled last space of texts that end in a gap removed."""
    return F.regexp_replace(normalised(text), " +$", " ")


def places(words: Column, pattern: Column) -> Column:
    """Matches of whole words as array of (start, end, found), counted in words. A match's last word's gap is not in it."""
    spans = spans_of(words, F.concat(F.lit("(?<= )(?:"), pattern, F.lit(")(?= )")), spaces_in)
    return F.transform(spans, lambda s: F.struct((s.start - 1).alias("start"), s.end.alias("end")))


def detections(words: Column, rules: list[Rule]) -> Column:
    """All matches of all rules whose keyword is there."""
    table = json.dumps([dict(zip(("priority", "keyword", "pattern", "label", "confidence"), r, strict=True)) for r in rules])
    known = F.from_json(F.lit(table), "array<struct<priority:int,keyword:string,pattern:string,label:string,confidence:double>>")
    near = F.filter(known, lambda r: F.contains(words, r.keyword))
    each = F.transform(near, lambda r: F.transform(places(words, r.pattern), lambda s: F.struct(s.start.alias("start"), s.end.alias("end"), r.priority.alias("priority"), r.label.alias("label"), r.confidence.alias("confidence"))))
    stems = ["licen"]  # in most keywords; of the others, those that hold no shorter one
    for k in sorted({k for _, k, *_ in rules}, key=lambda k: (len(k), k)):
        if not any(s in k for s in stems):
            stems.append(k)
    gate = reduce(lambda a, b: a | b, [F.contains(words, F.lit(s)) for s in stems])
    return F.when(gate, F.flatten(each)).otherwise(F.expr(f"cast(array() as {_DETECTION})"))


def unsuppressed(found: Column) -> Column:
    """Detections that no other of the same or a better priority covers."""
    ordered = F.array_sort(found, lambda a, b: F.when(a.start != b.start, a.start - b.start).when(a.end != b.end, b.end - a.end).when(a.priority != b.priority, a.priority - b.priority)
                           .when(a.label < b.label, -1).when(a.label > b.label, 1).otherwise(0))
    state = F.struct(F.array_repeat(F.lit(-1), LEVELS).alias("reach"), F.expr(f"cast(array() as {_DETECTION})").alias("kept"))

    def step(acc, d):
        covered = F.array_max(F.slice(acc.reach, F.lit(1), d.priority)) >= d.end
        reach = F.transform(acc.reach, lambda r, i: F.when(i + 1 == d.priority, F.greatest(r, d.end)).otherwise(r))
        return F.struct(reach.alias("reach"), F.when(covered, acc.kept).otherwise(F.concat(acc.kept, F.array(d))).alias("kept"))

    return F.aggregate(ordered, state, step, lambda acc: acc.kept)


def scan(docs: DataFrame, rules: list[Rule] = RULES, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """Per row: ``doc`` (its columns, or those of ``keep``), ``n_words``, ``base`` (array of start, label), ``detections``, ``labels``, ``score``."""
    row = F.struct(*[col(c) for c in (docs.columns if keep is None else keep)])
    rows = docs.select(row.alias("doc"), squeezed(text_of(text)).alias("words"))
    nothing = F.expr("cast(array() as array<struct<start:int,label:string>>)")

    def phrase(words, label):
        return F.when(F.contains("words", F.lit(f" {words} ")), F.transform(places(F.col("words"), F.lit(words)), lambda s: F.struct(s.start.alias("start"), F.lit(label).alias("label")))).otherwise(nothing)

    rows = rows.select("doc", (spaces_in(F.col("words")) - 1).cast("long").alias("n_words"), F.concat(*[phrase(*b) for b in BASE]).alias("base"), unsuppressed(detections(F.col("words"), rules)).alias("detections"))
    labels = F.array_sort(F.array_distinct(F.concat(F.transform("base", lambda b: b.label), F.transform("detections", lambda d: d.label))))
    best = F.aggregate("detections", F.expr("cast(map() as map<string,double>)"), lambda acc, d: F.when(F.coalesce(acc[d.label], F.lit(0.0)) >= d.confidence, acc).otherwise(
        F.map_concat(F.map_filter(acc, lambda k, v: k != d.label), F.create_map(d.label, d.confidence))))
    score = 1 - F.aggregate(F.map_values(best), F.lit(1.0), lambda acc, c: acc * (1 - c))
    return rows.select("doc", "n_words", "base", "detections", labels.alias("labels"), score.alias("score"))


@query("op5_licenses")
def op5_licenses(spark, sf_dir):
    found = scan(table(spark, sf_dir, "documents"), keep=["doc_id"])
    starts = F.transform("base", lambda b: b.start)
    return found.select("doc.doc_id", "n_words", F.size("base").cast("long").alias("n_base"), F.array_min(starts).cast("long").alias("first_word"), F.array_max(starts).cast("long").alias("last_word"),
                        F.array_join(F.array_sort(F.array_distinct(F.transform("base", lambda b: b.label))), ",").alias("base_labels"), F.array_join("labels", ",").alias("labels"), "score")
