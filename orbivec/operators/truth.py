"""Exact neighbours as a yardstick: sampling queries, building truth, choosing radii."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from orbivec.functions.vectors import RANK_DECIMALS, distance, distance_to_score, normalise, pad, space_of
from orbivec.operators import scan
from orbivec.operators.knn import RADIAL_CAP, dense_blocks, radial, search
from orbivec.operators.quantiles import exact_quantiles
from orbivec.operators.slices import cap, last_write
from orbivec.session import materialise
from orbivec.sources.bundle import Bundle

# Queries sampled from a corpus, neighbours kept for each, queries probed for a radius.
QUERIES, TRUTH_K, PROBES = 1000, 100, 100


def sample_queries(corpus: DataFrame, n: int = QUERIES, id_col: str = "_id", vector_col: str = "vector",
                   pos: str = "pos") -> DataFrame:
    """The first ``n`` rows of a corpus as queries: unit vectors, other columns kept, the last row of each id."""
    rows = last_write(cap(corpus, n, pos), id_col, pos)
    rest = [c for c in rows.columns if c not in (id_col, vector_col, pos)]
    return rows.select(F.col(id_col).alias("query_id"), normalise(F.col(vector_col)).alias("vector"), *rest)


def unit_matrix(column) -> np.ndarray:
    """Rows of a vector column at unit length; zero vectors stay zero."""
    x = scan.matrix(column)
    length = np.sqrt(np.einsum("ij,ij->i", x, x))
    return x / np.where(length > 0, length, 1.0)[:, None]


def build_ground_truth(corpus: DataFrame, n_queries: int = QUERIES, k: int = TRUTH_K, *, id_col: str = "_id",
                       vector_col: str = "vector", pos: str = "pos", queries: DataFrame | None = None,
                       salts: int | None = None) -> DataFrame:
    """``(query_id, rank, id, distance)``: nearest rows by inner product of unit vectors.

    One build with a large ``k`` serves every smaller one. A query is part of
    its corpus and finds itself.
    """
    asked = queries
    if asked is None:
        asked = sample_queries(corpus.select(id_col, vector_col, pos), n_queries, id_col, vector_col, pos)
        asked = materialise(asked, "sampled")
    scorer = scan.dense_scorer("innerproduct", vector_col, read=unit_matrix)
    hits = search(corpus, dense_blocks(asked, "query_id", "vector", scan.BLOCK_QUERIES, grow=True), scorer, k,
                  inputs=[vector_col], query_type=asked.schema["query_id"].dataType, id_col=id_col, salts=salts)
    return hits.select("query_id", "rank", id_col, "distance")


def as_arrays(hits: DataFrame, id_col: str = "_id", name: str = "ids", value: str | None = None) -> DataFrame:
    """One row per query with its ids (or another column) in rank order."""
    pairs = F.sort_array(F.collect_list(F.struct("rank", F.col(value or id_col).alias("v"))))
    return hits.groupBy("query_id").agg(F.transform(pairs, lambda p: p["v"]).alias(name))


def attach_truth(queries: DataFrame, truth: DataFrame, k: int | None = None, id_col: str = "_id",
                 query_id: str = "query_id") -> DataFrame:
    """Queries with ``neighbors``, their true ids; an unknown query has none."""
    ids = as_arrays(truth if k is None else truth.filter(F.col("rank") <= k), id_col, "neighbors")
    joined = queries.join(ids.withColumnRenamed("query_id", query_id), query_id, "left")
    empty = F.array().cast(ids.schema["neighbors"].dataType)
    return joined.withColumn("neighbors", F.coalesce("neighbors", empty))


# --- radius ----------------------------------------------------------------


def radius_summary(radii: DataFrame, column: str = "radius") -> DataFrame:
    """One row ``(min_radius, median_radius, max_radius)``."""
    return exact_quantiles(radii, column, {"min_radius": 0.0, "median_radius": 0.5, "max_radius": 1.0})


def last_radii(bundle: Bundle, space: str, sample: int = PROBES) -> DataFrame:
    """``(query_idx, radius)``: how far the last known neighbour is.

    From the stored distances when the bundle has them, else computed for the
    first ``sample`` queries. A bundle with neither is an error.
    """
    if "distances" in bundle:
        return bundle["distances"].select("query_idx", F.element_at("distances", -1).cast("double").alias("radius"))
    if "neighbors" not in bundle:
        raise ValueError("no distances and no neighbors: give a threshold explicitly")
    last = (bundle["neighbors"].filter(F.col("query_idx") < sample)
            .select("query_idx", F.element_at("ids", -1).alias("pos"))
            .join(bundle["test"].select("query_idx", F.col("vector").alias("__q")), "query_idx"))
    # At most ``sample`` rows meet the corpus.
    found = bundle["train"].select("pos", F.col("vector").alias("__v")).join(F.broadcast(last), "pos")
    radius = F.round(distance(F.col("__q"), F.col("__v"), space_of(space)), RANK_DECIMALS)
    return found.select("query_idx", radius.alias("radius"))


def auto_threshold(bundle: Bundle, space: str, sample: int = PROBES) -> DataFrame:
    """Suggested radius: the median distance of the last known neighbour, with minimum and maximum."""
    return radius_summary(last_radii(bundle, space, sample))


def compare_threshold(threshold: Column, automatic: Column) -> Column:
    """How a chosen radius relates to the suggested one."""
    return (F.when(threshold > automatic, F.lit("looser")).when(threshold < automatic, F.lit("tighter"))
            .otherwise(F.lit("equal")))


def neighbour_counts(hits: DataFrame, queries: DataFrame, query_id: str = "query_id") -> DataFrame:
    """``(query_id, neighbours)`` for every query, also those without a hit."""
    counts = hits.groupBy("query_id").agg(F.count(F.lit(1)).alias("neighbours"))
    asked = queries.select(F.col(query_id).alias("query_id"))
    return asked.join(counts, "query_id", "left").withColumn("neighbours", F.coalesce("neighbours", F.lit(0)))


def neighbour_stats(hits: DataFrame, queries: DataFrame, query_id: str = "query_id") -> DataFrame:
    """One row: mean, median, min and max neighbours per query, and how many queries have none."""
    counts = neighbour_counts(hits, queries, query_id)
    # The median's histogram is as long as there are distinct counts: a query cannot have more neighbours than rows.
    return counts.agg(
        F.avg("neighbours").alias("mean_neighbours"), F.median("neighbours").alias("median_neighbours"),
        F.min("neighbours").alias("min_neighbours"), F.max("neighbours").alias("max_neighbours"),
        F.count_if(F.col("neighbours") == 0).alias("empty_queries"))


def build_radial_truth(bundle: Bundle, space: str, threshold: float | None = None, cap: int = RADIAL_CAP,
                       width: int | None = None) -> Bundle:
    """The bundle with ``radial_neighbors (query_idx, ids)`` and a row of attributes.

    Ids are padded with -1 to ``width`` (default ``cap``); no more hits than that are looked for. Without a threshold
    the suggested radius is used.
    """
    width = width or cap
    if threshold is None:
        threshold = auto_threshold(bundle, space).first()["median_radius"]
    hits = radial(bundle["train"], bundle["test"], space, max_distance=threshold, cap=min(cap, width),
                  id_col="pos", query_id="query_idx")
    truth = attach_truth(bundle["test"].select("query_idx"), hits, id_col="pos", query_id="query_idx")
    table = truth.select("query_idx", pad(F.col("neighbors"), width).alias("ids"))
    attrs = hits.sparkSession.range(1).select(
        F.lit(float(threshold)).alias("max_distance_threshold"),
        F.lit(distance_to_score(threshold, space)).alias("min_score_threshold"), F.lit(space).alias("space_type"))
    return Bundle({**bundle.tables, "radial_neighbors": table}, attrs)
