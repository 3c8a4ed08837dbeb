"""Schema and dimension checks that split a table into accepted and rejected rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from orbivec.functions.vectors import well_formed

REASON = "reject_reason"

_INVALID = "__invalid"


def _split(checked: DataFrame, columns: list[str]) -> tuple[DataFrame, DataFrame]:
    accepted = checked.filter(F.col(REASON).isNull()).select(*columns)
    return accepted, checked.filter(F.col(REASON).isNotNull())


def _vector_reason(v: Column, dim: int) -> Column:
    return (F.when(v.isNull(), F.lit("missing vector"))
            .when(F.size(v) != dim, F.lit("wrong dimension"))
            .when(~well_formed(v, dim), F.lit("invalid element")))


def gate(df: DataFrame, schema: T.StructType, dim: int, strict: bool = True,
         vector_col: str = "vector") -> tuple[DataFrame, DataFrame]:
    """Check typed rows against a mapping; returns ``(accepted, rejected with reject_reason)``.

    A strict mapping rejects rows that carry a field it does not know; a
    dynamic one takes such fields over. Missing fields are filled with NULL.
    """
    unknown = [c for c in df.columns if c not in schema.fieldNames()]
    reason = _vector_reason(F.col(vector_col), dim)
    if strict and unknown:
        carries = F.coalesce(*[F.when(F.col(c).isNotNull(), F.lit(f"unknown field {c}")) for c in unknown])
        reason = F.coalesce(carries, reason)
    # What the given columns say against a row is kept before they are cast.
    df = df.withColumn(REASON, reason).withColumn(_INVALID, F.lit(None).cast("string"))
    for f in schema.fields:
        if f.name not in df.columns:
            df = df.withColumn(f.name, F.lit(None).cast(f.dataType))
        elif df.schema[f.name].dataType != f.dataType:
            cast = F.col(f.name).try_cast(f.dataType)
            invalid = F.col(f.name).isNotNull() & cast.isNull()
            df = df.withColumn(_INVALID, F.coalesce(F.col(_INVALID), F.when(invalid, F.lit(f"invalid value {f.name}"))))
            df = df.withColumn(f.name, cast)
    columns = schema.fieldNames() + ([] if strict else unknown)
    return _split(df.withColumn(REASON, F.coalesce(REASON, _INVALID)).drop(_INVALID), columns)


def gate_json(df: DataFrame, json_col: str, schema: T.StructType, dim: int, strict: bool = True,
              vector_col: str = "vector") -> tuple[DataFrame, DataFrame]:
    """The same check for rows that arrive as JSON objects.

    A dynamic mapping keeps the unknown fields as a string map ``extra``. A value that is not of its field's type rejects the row.
    """
    raw = F.from_json(F.col(json_col), "map<string,string>")
    known = F.array(*[F.lit(n) for n in schema.fieldNames()])
    parsed = (df.withColumn("__raw", raw)
              .withColumn("__unknown", F.array_except(F.map_keys("__raw"), known))
              .withColumn("__row", F.from_json(F.col(json_col), schema)))
    vector = F.col(f"__row.{vector_col}")
    reason = F.when(F.col("__raw").isNull(), F.lit("malformed"))
    if strict:
        reason = reason.when(F.size("__unknown") > 0, F.concat(F.lit("unknown field "), F.col("__unknown")[0]))
    given = [n for n in schema.fieldNames() if n != vector_col]
    invalid = [F.when(F.try_element_at("__raw", F.lit(n)).isNotNull() & F.col(f"__row.`{n}`").isNull(), F.lit(f"invalid value {n}")) for n in given]
    checked = parsed.withColumn(REASON, F.coalesce(reason, _vector_reason(vector, dim), *invalid))
    fields = [F.col(f"__row.{n}").alias(n) for n in schema.fieldNames()]
    if not strict:
        fields.append(F.map_filter("__raw", lambda k, _: F.array_contains("__unknown", k)).alias("extra"))
    return (checked.filter(F.col(REASON).isNull()).select(*fields),
            checked.filter(F.col(REASON).isNotNull()).select(json_col, REASON))
