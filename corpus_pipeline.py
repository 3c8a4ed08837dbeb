"""From documents to training sequences, stage by stage: each stage's rows are written and read again by the next."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from orbivec.llm import decontaminate, pack, quality, secrets, simhash, superminhash
from orbivec.session import scratch_path, ship


def well_written(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier rejects go."""
    return quality.accepted(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def deduplicated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies (five words, Jaccard at least 0.8) stays: a row of the smallest id.

    SimHash finds them by fingerprints, its components being lists whose members are checked on their full sets; what two
    bits miss at that similarity comes from the lists of SuperMinHash, checked likewise.
    """
    alike = simhash.near_duplicates(docs, shingle=5)
    lists = alike.select(F.xxhash64(F.lit("simhash"), "component").alias("key"), "doc_id", "version")
    return simhash.one_of_each(docs, found=superminhash.near_copies(docs, words=5, percent=80, linked_empty=True, lists=lists))


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark window go."""
    return decontaminate.clean_documents(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def without_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every secret is replaced by a mark; ``n_chars`` follows the text."""
    clean = secrets.redacted(docs)
    return clean.withColumn("n_chars", F.coalesce(F.length("text"), F.lit(0)).cast("long")) if "n_chars" in docs.columns else clean


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every token of every document left, in sequences of at most 1024."""
    import public_tokenizers

    return pack.pack(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [
    ("quality", well_written),
    ("near_duplicates", deduplicated),
    ("decontamination", decontaminated),
    ("secrets", without_secrets),
    ("packing", packed),
]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage."""
    ship(spark)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        path = scratch_path(spark, f"stage-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
