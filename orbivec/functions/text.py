"""Text, id and label expressions as Spark columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed value: everything that is neither a letter nor a digit separates tokens.
TOKEN_BREAK = r"[^\p{L}\p{N}]+"


def tokens(text: Column) -> Column:
    """Lower-cased tokens of the whole text, duplicates kept, in order."""
    parts = F.split(F.lower(F.coalesce(text, F.lit(""))), TOKEN_BREAK)
    return F.filter(parts, lambda t: t != "")


def matches(text: Column, query: Column) -> Column:
    """Analysed match: any token of ``query`` occurs in ``text``."""
    return F.arrays_overlap(tokens(text), tokens(query))


def count_label(n: Column) -> Column:
    """Whole millions as ``3m``, whole thousands as ``500k``, anything else in digits."""
    millions, thousands = F.lit(1_000_000), F.lit(1_000)
    return (
        F.when((n >= millions) & (n % millions == 0), F.concat((n / millions).cast("bigint").cast("string"), F.lit("m")))
        .when((n >= thousands) & (n % thousands == 0), F.concat((n / thousands).cast("bigint").cast("string"), F.lit("k")))
        .otherwise(n.cast("string"))
    )


def lenient_object(json: Column) -> Column:
    """Top-level JSON object as a string map; malformed or missing input is an empty map."""
    empty = F.create_map().cast("map<string,string>")
    return F.coalesce(F.from_json(json, "map<string,string>"), empty)


def id_string(id_: Column) -> Column:
    return id_.cast("string")


def id_order(id_: Column) -> Column:
    """Numeric order of an id, for ranking ties; non-numeric ids come last."""
    return F.coalesce(id_.try_cast("bigint"), F.lit(2**63 - 1))
