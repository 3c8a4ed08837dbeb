from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from orbivec.functions.vectors import scale
from orbivec.session import ship, spread

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register a query under ``name``, with equivalent SQL when there is one."""

    def add(fn):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            ship(spark)
            return fn(spark, sf_dir)

        QUERIES[name] = run
        if sql is not None:
            ORACLE[name] = sql
        return fn

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spread(spark.read.parquet(f"{sf_dir}/{name}.parquet"))


def corpus(spark: SparkSession, sf_dir: str, scaled: bool = False) -> DataFrame:
    """``(_id, vector)``; scaled vectors have lengths 1 to 3, so that the spaces rank differently."""
    e = table(spark, sf_dir, "embeddings")
    v = F.col("embedding")
    return e.select(F.col("vec_id").alias("_id"), (scale(v, 1 + F.col("vec_id") % 3) if scaled else v).alias("vector"))


def queries_of(rows: DataFrame) -> DataFrame:
    """Every row of a corpus as a query."""
    return rows.withColumnRenamed("_id", "query_id")


def described(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents with the vector of the same number, if there is one."""
    e, d = spark.read.parquet(f"{sf_dir}/embeddings.parquet"), table(spark, sf_dir, "documents")
    return d.join(e, e.vec_id == d.doc_id, "left").select(
        F.col("doc_id").alias("_id"), F.col("embedding").alias("vector"), F.col("lang").alias("color"),
        F.col("source").alias("taste"), F.col("label").alias("age"), "text", F.col("source").alias("title"))


def shown(hits: DataFrame, *extra: str) -> DataFrame:
    """Hits with rounded numbers."""
    return hits.select("query_id", "_id", *extra, r6("distance"), r6("score"), "rank")


def r6(name: str, digits: int = 6):
    """Rounded for comparison. Values are already rounded to three more digits, so some lie exactly
    between two results; a nudge sends these up on every engine."""
    return (F.round(F.col(name) + F.lit(NUDGE[digits]), digits) + F.lit(0.0)).alias(name)


NUDGE = {6: 2e-10, 3: 2e-7}


def sql_r(value: str, digits: int = 6) -> str:
    return f"round({value} + {NUDGE[digits]:.10f}, {digits}) + 0.0"


# --- SQL building blocks ---------------------------------------------------

RAW = "v as (select vec_id, embedding::DOUBLE[] v from embeddings)"
SCALED = "v as (select vec_id, list_transform(embedding, lambda x: x::DOUBLE * (1 + vec_id % 3)) v from embeddings)"
DESCRIBED = """c as (select doc_id vec_id, embedding::DOUBLE[] v, lang color, source taste, label age, text, source title
      from documents left join embeddings on vec_id = doc_id)"""
DISTANCE = {
    "l2": "power(list_distance({a}, {b}), 2)",
    "innerproduct": "-list_inner_product({a}, {b})",
    "cosine": "1 - list_inner_product({a}, {b}) / (sqrt(list_inner_product({a}, {a})) * sqrt(list_inner_product({b}, {b})))",
}
SCORE = {
    "l2": "1 / (1 + d)",
    "cosine": "(2 - d) / 2",
    "innerproduct": "case when d >= 0 then 1 / (1 + d) else 1 - d end",
}


def sql_pairs(space: str, queries: str = "v", rows: str = "v", where: str = "true", columns: str = "") -> str:
    d = DISTANCE[space].format(a="q.v", b="c.v")
    return (f"pairs as (select q.vec_id query_id, c.vec_id _id, round({d}, 9) + 0.0 d{columns} "
            f"from {queries} q, {rows} c where q.v is not null and c.v is not null and {where})")


RANKED = "ranked as (select *, row_number() over (partition by query_id order by d, _id) as rank from pairs)"


def sql_hits(space: str, keep: str, source: str = RAW, extra: str = "", **pairs) -> str:
    return f"""with {source}, {sql_pairs(space, **pairs)}, {RANKED}
select query_id, _id, {extra} {sql_r('d')} as distance, {sql_r(SCORE[space])} as score, rank::INTEGER as rank
from ranked where {keep}"""
