"""Exact quantiles of groups of any size."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from orbivec.session import materialise


def exact_quantiles(df: DataFrame, value: str, probs: dict[str, float], groups: list[str] = ()) -> DataFrame:
    """Interpolated quantiles per group: ``(groups..., <name> for every entry of probs)``.

    Equal values are counted before they are shuffled, distinct values are laid
    out by range, and ranks follow from the counts per range. No group, however
    large, is held by one task. NULLs are ignored.
    """
    groups = list(groups)
    distinct = df.filter(F.col(value).isNotNull()).groupBy(*groups, F.col(value).cast("double").alias("__v")).count()
    # Written once: the range a value fell into must not change between the two uses below.
    laid = materialise(distinct.repartitionByRange(*groups, "__v").withColumn("__part", F.spark_partition_id()),
                       "ranges")
    sizes = laid.groupBy(*groups, "__part").agg(F.sum("count").alias("__size"))
    everything = Window.partitionBy(*groups)
    before = everything.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    sizes = (sizes.withColumn("__offset", F.coalesce(F.sum("__size").over(before), F.lit(0)))
             .withColumn("__total", F.sum("__size").over(everything)).drop("__size"))
    running = Window.partitionBy(*groups, "__part").orderBy("__v").rowsBetween(Window.unboundedPreceding, 0)
    placed = (laid.withColumn("__upto", F.sum("count").over(running))
              .join(F.broadcast(sizes) if not groups else sizes, [*groups, "__part"])
              .withColumn("__last", F.col("__offset") + F.col("__upto") - 1)
              .withColumn("__first", F.col("__last") - F.col("count") + 1))

    def at(rank):
        return F.max(F.when(rank.between(F.col("__first"), F.col("__last")), F.col("__v")))

    found, out = [], []
    for i, (name, p) in enumerate(probs.items()):
        h = F.lit(float(p)) * (F.col("__total") - 1)
        low = F.floor(h + F.lit(1e-9))
        found += [at(low).alias(f"__l{i}"), at(F.least(low + 1, F.col("__total") - 1)).alias(f"__h{i}"),
                  F.max(F.greatest(h - low, F.lit(0.0))).alias(f"__f{i}")]
        out.append((F.col(f"__l{i}") + F.col(f"__f{i}") * (F.col(f"__h{i}") - F.col(f"__l{i}"))).alias(name))
    return placed.groupBy(*groups).agg(*found).select(*groups, *out)
