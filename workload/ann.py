"""Search by cells and on compressed vectors."""

from __future__ import annotations

from pyspark.sql import functions as F

from orbivec.operators import ivf
from orbivec.operators import quantise as qz
from orbivec.operators import residual
from orbivec.operators.knn import knn
from orbivec.operators.metrics import query_recall
from orbivec.session import materialise, scratch_path
from workload.registry import RAW, SCALED, corpus, queries_of, query, shown, sql_hits, table

NLIST = 16
LABELLED = "c as (select vec_id, embedding::DOUBLE[] v, label age from embeddings)"


def _cells(spark, rows):
    centroids = ivf.ivf_train(rows, NLIST, sample=10_000)
    return ivf.ivf_write(rows, centroids, scratch_path(spark, "cells")), centroids


@query("ivf_full_probe", sql_hits("l2", "rank <= 10", SCALED))
def ivf_full_probe(spark, sf_dir):
    """Every cell probed: equal to exact search."""
    rows = corpus(spark, sf_dir, scaled=True)
    cells, centroids = _cells(spark, rows)
    return shown(ivf.ivf_search(cells, centroids, queries_of(rows), 10, NLIST, "l2"))


@query("ivf_joined", sql_hits("l2", "rank <= 10", SCALED))
def ivf_joined(spark, sf_dir):
    """Many blocks of queries, joined with the cells instead of broadcast."""
    rows = corpus(spark, sf_dir, scaled=True)
    cells, centroids = _cells(spark, rows)
    return shown(ivf.ivf_search(cells, centroids, queries_of(rows), 10, NLIST, "l2", block_queries=90))


@query("ivf_filtered", sql_hits("l2", "rank <= 10", LABELLED, rows="(select * from c where age = 3)", queries="c"))
def ivf_filtered(spark, sf_dir):
    """A filter on the search by cells, all of them probed: equal to exact filtered search."""
    e = table(spark, sf_dir, "embeddings")
    rows = e.select(F.col("vec_id").alias("_id"), F.col("embedding").alias("vector"), F.col("label").alias("age"))
    cells, centroids = _cells(spark, rows)
    return shown(ivf.ivf_search(cells, centroids, queries_of(rows.select("_id", "vector")), 10, NLIST, "l2", where="age = 3"))


@query("ivf_search")
def ivf_search(spark, sf_dir):
    rows = corpus(spark, sf_dir)
    cells, centroids = _cells(spark, rows)
    return shown(ivf.ivf_search(cells, centroids, queries_of(rows), 10, 12, "innerproduct"))


@query("ivf_recall")
def ivf_recall(spark, sf_dir):
    """Mean recall for more and more probed cells."""
    rows = corpus(spark, sf_dir)
    cells, centroids = _cells(spark, rows)
    asked = queries_of(rows)
    truth = materialise(knn(rows, asked, 10, "l2"), "truth")
    out = None
    for nprobe in (1, 4, NLIST):
        hits = ivf.ivf_search(cells, centroids, asked, 10, nprobe, "l2")
        mean = query_recall(hits, truth, 10).agg(F.round(F.avg("recall_k"), 6).alias("recall"))
        mean = mean.select(F.lit(nprobe).alias("nprobe"), "recall")
        out = mean if out is None else out.unionByName(mean)
    return out


@query("ivf_cells", "select count(*) as n_rows, count(distinct vec_id) as n_ids from embeddings")
def ivf_cells(spark, sf_dir):
    """Every row is written to exactly one cell."""
    cells, _ = _cells(spark, corpus(spark, sf_dir))
    sizes = cells.filter(F.col("cluster_id").between(0, NLIST - 1)).groupBy("cluster_id").agg(
        F.count(F.lit(1)).alias("n"), F.count_distinct("_id").alias("ids"))
    return sizes.agg(F.sum("n").alias("n_rows"), F.sum("ids").alias("n_ids"))


@query("adaptive_exact", sql_hits("l2", "rank <= 10"))
def adaptive_exact(spark, sf_dir):
    """A table below the threshold is searched exactly."""
    rows = corpus(spark, sf_dir)
    cells, centroids = _cells(spark, rows)
    return shown(ivf.adaptive_search(cells, centroids, queries_of(rows), 10, threshold=1_000_000_000, space="l2"))


def _rescored(spark, sf_dir, encoder, oversample, overquery=None, ef_search=None, **options):
    rows = corpus(spark, sf_dir)
    codec = qz.train_codec(rows, encoder, **options)
    codes = materialise(qz.quantise(rows, codec), "codes")
    return shown(qz.rescored(codes, codec, rows, queries_of(rows), 10, oversample, "l2", overquery=overquery, ef_search=ef_search))


@query("flat_rescore", sql_hits("l2", "rank <= 10"))
def flat_rescore(spark, sf_dir):
    """Uncompressed codes: equal to exact search."""
    return _rescored(spark, sf_dir, "flat", 2.0)


@query("sq_fp16_rescore", sql_hits("l2", "rank <= 10"))
def sq_fp16_rescore(spark, sf_dir):
    """Half-precision codes with a margin of candidates: equal to exact search on these vectors."""
    return _rescored(spark, sf_dir, "fp16", 3.0, clip=True)


_BITS = f"""{RAW},
e as (select vec_id, unnest(v) x, generate_subscripts(v, 1) i from v), m as (select i, avg(x) m from e group by i),
b as (select vec_id, list(x > m order by i) b from e join m using (i) group by vec_id),
bits as (select q.vec_id query_id, c.vec_id _id,
  list_sum(list_transform(list_zip(q.b, c.b), lambda z: case when z[1] = z[2] then 0 else 1 end))::DOUBLE d from b q, b c)"""


@query("onebit_rescore", sql_hits("l2", "rank <= 10", f"""{_BITS},
near as (select query_id, _id from (select *, row_number() over (partition by query_id order by d, _id) r from bits) where r <= 50)""",
                                  where="(q.vec_id, c.vec_id) in (select (query_id, _id) from near)"))
def onebit_rescore(spark, sf_dir):
    return _rescored(spark, sf_dir, "one_bit", 5.0)


@query("pq_rescore")
def pq_rescore(spark, sf_dir):
    return _rescored(spark, sf_dir, "pq", 5.0, pq_m=8, code_size=6, sample=10_000)


def _overquery_sql(depth):
    return sql_hits("l2", "rank <= 10", f"""{_BITS},
near as (select query_id, _id from (select *, row_number() over (partition by query_id order by d, _id) r from bits) where r <= {depth})""",
                    where="(q.vec_id, c.vec_id) in (select (query_id, _id) from near)")


@query("overquery_rescore", _overquery_sql(30))
def overquery_rescore(spark, sf_dir):
    """Three times as many candidates a search, on one-bit codes."""
    return _rescored(spark, sf_dir, "one_bit", None, overquery=3.0)


@query("ef_search_rescore", _overquery_sql(64))
def ef_search_rescore(spark, sf_dir):
    """The wider of two search breadths, on one-bit codes."""
    return _rescored(spark, sf_dir, "one_bit", 2.0, ef_search=64)


def _coded(spark, rows, space="l2", pq_m=64):
    """Cells of a corpus, and their residual codes, by default of every dimension."""
    cells, centroids = _cells(spark, rows)
    books = residual.train_books(cells, centroids, pq_m=pq_m, code_size=6, sample=10_000)
    return residual.code_cells(cells, centroids, books, scratch_path(spark, "codes"), space), books, cells, centroids


@query("ivfpq_exact", sql_hits("l2", "rank <= 10", SCALED))
def ivfpq_exact(spark, sf_dir):
    """Residual codes with proven bounds, every cell probed: equal to exact search."""
    rows = corpus(spark, sf_dir, scaled=True)
    return shown(residual.residual_search(*_coded(spark, rows), queries_of(rows), 10, NLIST))


@query("ivfpq_innerproduct", sql_hits("innerproduct", "rank <= 10", SCALED))
def ivfpq_innerproduct(spark, sf_dir):
    """The same by inner product, in several blocks of queries."""
    rows = corpus(spark, sf_dir, scaled=True)
    coded = _coded(spark, rows, "innerproduct")
    return shown(residual.residual_search(*coded, queries_of(rows), 10, NLIST, "innerproduct", block_queries=1024))


@query("ivfpq_filtered", sql_hits("l2", "rank <= 10", LABELLED, rows="(select * from c where age = 3)", queries="c"))
def ivfpq_filtered(spark, sf_dir):
    """Cells, codes, a filter and exact re-ranking in one search."""
    e = table(spark, sf_dir, "embeddings")
    rows = e.select(F.col("vec_id").alias("_id"), F.col("embedding").alias("vector"), F.col("label").alias("age"))
    asked = queries_of(rows.select("_id", "vector"))
    return shown(residual.residual_search(*_coded(spark, rows), asked, 10, NLIST, where="age = 3"))


@query("ivfpq_search")
def ivfpq_search(spark, sf_dir):
    """12 of 16 cells, five times as many candidates by codes of an eighth of the vectors' size."""
    rows = corpus(spark, sf_dir)
    coded = _coded(spark, rows, "innerproduct", 32)
    return shown(residual.residual_search(*coded, queries_of(rows), 10, 12, "innerproduct", oversample=5.0))


@query("onebit_hamming", f"""with {_BITS},
ranked as (select *, row_number() over (partition by query_id order by d, _id) as rank from bits)
select query_id, _id, d as distance, rank::INTEGER as rank from ranked where rank <= 10""")
def onebit_hamming(spark, sf_dir):
    """Nearest rows by differing bits."""
    rows = corpus(spark, sf_dir)
    codec = qz.train_codec(rows, "one_bit")
    hits = qz.code_search(qz.quantise(rows, codec), codec, queries_of(rows), 10, "l2")
    return hits.select("query_id", "_id", "distance", "rank")


@query("compression_levels")
def compression_levels(spark, sf_dir):
    """Bytes per vector and recall of each compression level."""
    rows = corpus(spark, sf_dir)
    asked = queries_of(rows)
    truth = materialise(knn(rows, asked, 10, "l2"), "truth")
    out = None
    for level in qz.LEVELS:
        encoder, rescore = qz.encoder_for(level, "on_disk" if level == "32x" else "in_memory")
        codec = qz.train_codec(rows, encoder)
        codes = materialise(qz.quantise(rows, codec), "codes")
        hits = (qz.rescored(codes, codec, rows, asked, 10, 5.0, "l2") if rescore
                else qz.code_search(codes, codec, asked, 10, "l2"))
        size = codes.agg(F.avg(F.length("code")).alias("bytes"))
        mean = query_recall(hits, truth, 10).agg(F.round(F.avg("recall_k"), 6).alias("recall"))
        row = (size.withColumn("level", F.lit(level)).join(mean.withColumn("level", F.lit(level)), "level")
               .select("level", "bytes", "recall"))
        out = row if out is None else out.unionByName(row)
    return out
