"""Clustered synthetic vectors whose rows depend only on their id and the seed."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Defaults of the synthetic corpus.
DIMS, CENTERS, SPREAD, PARTITIONS, SEED = 768, 2000, 0.5, 1000, 42
CENTER_RANGE = 100.0
_BLOCK = 512  # ids that share one random stream
_ROWS, _QUERIES = 0, 1


def cluster_centers(dims: int = DIMS, centers: int = CENTERS, seed: int = SEED) -> np.ndarray:
    """The centres, uniform in [0, 100) per dimension."""
    return (np.random.RandomState(seed).rand(centers, dims) * CENTER_RANGE).astype(np.float32)


def clustered_vectors(spark: SparkSession, n: int, dims: int = DIMS, centers: int = CENTERS, std: float = SPREAD,
                      partitions: int = PARTITIONS, seed: int = SEED, slices: int | None = None) -> DataFrame:
    """``(_id string, partition_id int, vector array<float>)``: exactly ``n`` rows around seeded centres.

    Centres are used evenly. ``partition_id`` is uniform in ``[0, partitions]``,
    both ends included. The output does not depend on how Spark splits the ids.
    """
    return _generate(spark, n, dims, centers, std, partitions, seed, slices, _ROWS)


def clustered_queries(spark: SparkSession, n: int, dims: int = DIMS, centers: int = CENTERS, std: float = SPREAD,
                      seed: int = SEED, slices: int | None = None) -> DataFrame:
    """``(query_id string, vector)``: queries around the same centres as the corpus of that seed."""
    rows = _generate(spark, n, dims, centers, std, 0, seed, slices, _QUERIES)
    return rows.select(F.col("_id").alias("query_id"), "vector")


def _generate(spark, n, dims, centers, std, partitions, seed, slices, stream) -> DataFrame:
    ids = spark.range(0, n, 1, slices) if slices else spark.range(n)
    placed = ids.withColumn("center", F.pmod(F.xxhash64(F.lit(seed + stream), "id"), F.lit(centers)))

    def fill(batches):
        middle = cluster_centers(dims, centers, seed)
        held = (None, None, None)  # the block of the last id is the next batch's first
        for batch in batches:
            id_ = batch.column("id").to_numpy()
            if not len(id_):
                continue
            center = batch.column("center").to_numpy()
            noise, part = np.empty((len(id_), dims), np.float32), np.empty(len(id_), np.int32)
            for block in np.unique(id_ // _BLOCK):
                if held[0] != block:
                    rng = np.random.Generator(np.random.Philox(key=[seed * 2 + stream, int(block)]))
                    held = (block, rng.standard_normal((_BLOCK, dims), np.float32),
                            rng.integers(0, partitions, _BLOCK, np.int32, endpoint=True))
                here = id_ // _BLOCK == block
                noise[here], part[here] = held[1][id_[here] % _BLOCK], held[2][id_[here] % _BLOCK]
            vectors = middle[center] + np.float32(std) * noise
            offsets = pa.array(np.arange(0, vectors.size + 1, dims, dtype=np.int32))
            yield pa.RecordBatch.from_arrays(
                [batch.column("id").cast(pa.string()), pa.array(part),
                 pa.ListArray.from_arrays(offsets, pa.array(vectors.reshape(-1)))],
                names=["_id", "partition_id", "vector"])

    return placed.mapInArrow(fill, "_id string, partition_id int, vector array<float>")


def expected_documents(clients: int, iterations: int, bulk_size: int) -> int:
    """Rows a synthetic ingest of this shape produces."""
    return clients * iterations * bulk_size


def expected_queries(clients: int, iterations: int) -> int:
    """Queries a synthetic search of this shape asks."""
    return clients * iterations
