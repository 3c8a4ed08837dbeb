"""Column expressions on text that several operators share."""

from __future__ import annotations

import string

from pyspark.sql import Column
from pyspark.sql import functions as F

#: One or more characters that stand between words of letters and digits (ASCII classes; all other characters are word characters).
GAP = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def col(name: str) -> Column:
    """The column of exactly this name, whatever characters it holds."""
    return F.col("`" + name.replace("`", "``") + "`")


def text_of(name: str) -> Column:
    """The text, null as empty."""
    return F.coalesce(col(name).cast("string"), F.lit(""))


def lower_ascii(text: Column) -> Column:
    """A-Z lower-cased, every other character as it is."""
    return F.translate(text, string.ascii_uppercase, string.ascii_lowercase)


def words_of(text: Column) -> Column:
    """Lower-cased words, in order."""
    return F.array_remove(F.split(lower_ascii(text), GAP, -1), "")


def spaces_in(text: Column) -> Column:
    return F.length(text) - F.length(F.replace(text, F.lit(" "), F.lit("")))


def spans_of(text: Column, pattern: Column, measure=F.length, block: int = 256) -> Column:
    """Leftmost non-overlapping matches: array of (start, end, found), in code points, end exclusive.

    Matches and the pieces between them alternate, so places follow from their lengths (or what ``measure`` counts).
    Places are added up within blocks and then over blocks, which keeps very many matches cheap.
    """
    found = F.regexp_extract_all(text, pattern, F.lit(0))
    between = F.call_function("split", text, pattern, F.lit(-1))
    nothing = F.expr("cast(array() as array<struct<start:int,end:int,found:string>>)")
    none = F.expr("cast(array() as array<array<struct<start:int,end:int,found:string>>>)")

    def step(acc, x):
        start = acc.at + measure(x["0"])
        end = start + measure(x["1"])
        return F.struct(end.alias("at"), F.concat(acc.spans, F.array(F.struct(start.alias("start"), end.alias("end"), x["1"].alias("found")))).alias("spans"))

    def join(acc, b):
        # An array of one, so that the inner sum is made once.
        inner = F.transform(F.array(F.aggregate(b, F.struct(acc.at.alias("at"), nothing.alias("spans")), step)), lambda i: F.struct(i.at.alias("at"), F.concat(acc.parts, F.array(i.spans)).alias("parts")))
        return inner[0]

    def placed(pairs):
        blocks = F.transform(F.sequence(F.lit(0), F.floor((F.size(pairs) - 1) / block).cast("int")), lambda b: F.slice(pairs, b * block + 1, F.lit(block)))
        return F.aggregate(blocks, F.struct(F.lit(0).alias("at"), none.alias("parts")), join, lambda acc: F.filter(F.flatten(acc.parts), lambda s: s.found.isNotNull()))

    # As above: matches are looked for once, not by every block.
    return F.transform(F.array(F.arrays_zip(between.alias("0"), found.alias("1"))), lambda pairs: F.when(F.size(pairs) > 1, placed(pairs)).otherwise(nothing))[0]
