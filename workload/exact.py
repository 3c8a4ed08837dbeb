"""Exact, filtered, nested and radial search."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orbivec.functions import text as tx
from orbivec.functions import vectors as vx
from orbivec.operators.knn import knn, radial
from workload.registry import (DESCRIBED, DISTANCE, RANKED, RAW, SCALED, SCORE, corpus, described, queries_of, query, r6, shown,
                               sql_hits, sql_pairs, sql_r, table)

for _space in ("innerproduct", "l2", "cosine"):

    def _knn(spark, sf_dir, space=_space):
        rows = corpus(spark, sf_dir, scaled=True)
        return shown(knn(rows, queries_of(rows), 10, space))

    query({"innerproduct": "knn_ip"}.get(_space, f"knn_{_space}"), sql_hits(_space, "rank <= 10", SCALED))(_knn)


@query("knn_block", sql_hits("l2", "rank <= 10", SCALED))
def knn_block(spark, sf_dir):
    """Several query blocks, a two-step merge and a pruning bound: same hits."""
    rows = corpus(spark, sf_dir, scaled=True)
    bound = rows.sample(0.2, seed=7)
    block = min(4096, max(1, rows.count() // 3))
    return shown(knn(rows, queries_of(rows), 10, "l2", block_queries=block, salts=4, bound=bound))


@query("knn_string_ids", f"""with {SCALED}, {sql_pairs('l2')}, {RANKED}
select query_id::VARCHAR query_id, _id::VARCHAR _id, {sql_r(SCORE['l2'])} as score from ranked where rank <= 10""")
def knn_string_ids(spark, sf_dir):
    """Ids as strings, ties still by number; ids and scores only."""
    rows = corpus(spark, sf_dir, scaled=True).withColumn("_id", tx.id_string(F.col("_id")))
    return knn(rows, queries_of(rows), 10, "l2").select("query_id", "_id", r6("score"))


@query("scores", f"""with {SCALED},
p as (select a.vec_id, {DISTANCE['l2'].format(a='a.v', b='b.v')} l2, {DISTANCE['innerproduct'].format(a='a.v', b='b.v')} ip,
      {DISTANCE['cosine'].format(a='a.v', b='b.v')} cosine, list_inner_product(a.v, b.v) s
      from v a join v b on b.vec_id = a.vec_id + 1)
select vec_id, {sql_r('l2')} l2, {sql_r('ip')} ip, {sql_r('cosine')} cosine, {sql_r('s')} similarity,
  round(1 / (1 + l2), 6) l2_score, round(case when ip >= 0 then 1 / (1 + ip) else 1 - ip end, 6) ip_score,
  round((2 - cosine) / 2, 6) cosine_score, round(case when s > 0 then s + 1 else 1 / (1 - s) end, 6) similarity_score
from p""")
def scores(spark, sf_dir):
    """Every distance and score between each vector and the next one."""
    rows = corpus(spark, sf_dir, scaled=True)
    following = rows.select((F.col("_id") - 1).alias("_id"), F.col("vector").alias("b"))
    a, b = F.col("vector"), F.col("b")
    d = rows.join(following, "_id").select(
        F.col("_id").alias("vec_id"), vx.distance(a, b, "l2").alias("l2"), vx.distance(a, b, "inner_product").alias("ip"),
        vx.distance(a, b, "cosinesimil").alias("cosine"), vx.similarity(a, b).alias("similarity"))
    return d.select(
        "vec_id", *[r6(c) for c in ("l2", "ip", "cosine", "similarity")],
        F.round(vx.score(F.col("l2"), "l2"), 6).alias("l2_score"),
        F.round(vx.score(F.col("ip"), "innerproduct"), 6).alias("ip_score"),
        F.round(vx.score(F.col("cosine"), "cosine"), 6).alias("cosine_score"),
        F.round(vx.similarity_score(F.col("similarity")), 6).alias("similarity_score"))


@query("normalise", f"""with {SCALED}, n as (select vec_id, v, sqrt(list_inner_product(v, v)) n from v)
select vec_id, {sql_r('n')} as length, round(list_inner_product(v, v) / (n * n), 6) as unit_length, round(v[1] / n, 6) + 0.0 as first
from n""")
def normalise(spark, sf_dir):
    rows = corpus(spark, sf_dir, scaled=True)
    u = rows.select(F.col("_id").alias("vec_id"), vx.norm(F.col("vector")).alias("length"),
                    vx.normalise(F.col("vector")).alias("u"))
    return u.select("vec_id", r6("length"), F.round(vx.dot(F.col("u"), F.col("u")), 6).alias("unit_length"),
                    (F.round(F.col("u")[0], 6) + F.lit(0.0)).alias("first"))


WELL_FORMED = SCALED.removesuffix(")") + " where vec_id % 10 not in (3, 7))"


def _malformed(spark, sf_dir):
    """Some vectors with a NULL element, some with a NaN."""
    rows = corpus(spark, sf_dir, scaled=True)
    last = F.col("_id") % 10
    broken = F.transform("vector", lambda x, i: F.when((last == 3) & (i == 5), F.lit(None)).when((last == 7) & (i == 2), F.lit(float("nan"))).otherwise(x))
    return rows.withColumn("vector", broken)


def _in_all_spaces(keep):
    return " union all ".join(f"select '{s}' as space, * from ({sql_hits(s, k, WELL_FORMED)})" for s, k in keep.items())


@query("knn_malformed", _in_all_spaces({s: "rank <= 10" for s in DISTANCE}))
def knn_malformed(spark, sf_dir):
    """Malformed rows are no hits, malformed queries have none, and neither hides others."""
    rows = _malformed(spark, sf_dir)
    return reduce(DataFrame.unionAll, [shown(knn(rows, queries_of(rows), 10, s)).select(F.lit(s).alias("space"), "*") for s in DISTANCE])


_RADII = {"l2": 2.5, "innerproduct": -1.0, "cosine": 0.7}


@query("radial_malformed", _in_all_spaces({s: f"d <= {d} and rank <= 10000" for s, d in _RADII.items()}))
def radial_malformed(spark, sf_dir):
    rows = _malformed(spark, sf_dir)
    return reduce(DataFrame.unionAll, [shown(radial(rows, queries_of(rows), s, max_distance=d)).select(F.lit(s).alias("space"), "*") for s, d in _RADII.items()])


RELAXED, RESTRICTIVE = "age < 8", "age = 3 and color = 'en'"


def _filtered(name, mode, condition, space, before, after):
    sql = sql_hits(space, f"rank <= 10 and {after}", DESCRIBED, queries="c", rows="c", where=before,
                   columns=", c.age, c.color")

    @query(name, sql)
    def run(spark, sf_dir):
        rows = described(spark, sf_dir)
        return shown(knn(rows, queries_of(rows.select("_id", "vector")), 10, space, where=condition, filter_mode=mode))


_filtered("knn_prefilter", "efficient", RELAXED, "innerproduct", "c.age < 8", "true")
_filtered("knn_prefilter_restrictive", "efficient", RESTRICTIVE, "innerproduct", "c.age = 3 and c.color = 'en'", "true")
_filtered("knn_postfilter", "post_filter", RELAXED, "innerproduct", "true", RELAXED)
_filtered("knn_boolean", "boolean", RESTRICTIVE, "innerproduct", "true", RESTRICTIVE)
_filtered("knn_script", "script", RELAXED, "l2", "c.age < 8", "true")


@query("knn_id_set", sql_hits("l2", "rank <= 10", RAW,
                              where="c.vec_id in (select doc_id from labels where quality = 1)"))
def knn_id_set(spark, sf_dir):
    """Only rows whose id another table names."""
    rows = corpus(spark, sf_dir)
    allowed = table(spark, sf_dir, "labels").filter("quality = 1").select(F.col("doc_id").alias("_id"))
    return shown(knn(rows.join(allowed, "_id", "left_semi"), queries_of(rows), 10, "l2"))


@query("knn_text_match", sql_hits(
    "l2", "rank <= 10", DESCRIBED, queries="c", rows="c",
    where=r"list_has_any(string_split_regex(lower(c.text), '[^\p{L}\p{N}]+'), ['the', 'une'])"))
def knn_text_match(spark, sf_dir):
    """Only rows whose text has any of the words."""
    rows = described(spark, sf_dir)
    word = tx.matches(F.col("text"), F.lit("The une"))
    return shown(knn(rows, queries_of(rows.select("_id", "vector")), 10, "l2", where=word))


@query("knn_nested", f"""with {SCALED},
children as (select q.vec_id query_id, c.vec_id // 5 _id, c.vec_id % 5 child, round({DISTANCE['l2'].format(a='q.v', b='c.v')}, 9) + 0.0 d
  from v q, v c),
pairs as (select query_id, _id, min(d) d, arg_min(child, (d, child)) child from children group by query_id, _id), {RANKED}
select query_id, _id, child::INTEGER child, {sql_r('d')} as distance, {sql_r(SCORE['l2'])} as score, rank::INTEGER as rank
from ranked where rank <= 10""")
def knn_nested(spark, sf_dir):
    """Five vectors per parent; a parent is as close as its closest vector."""
    rows = corpus(spark, sf_dir, scaled=True)
    child = F.struct(F.col("_id").alias("vec_id"), F.col("vector").alias("inner"))
    parents = rows.groupBy(F.floor(F.col("_id") / 5).alias("_id")).agg(F.sort_array(F.collect_list(child)).alias("outer"))
    return shown(knn(parents, queries_of(rows), 10, "l2", nested="outer.inner"), "child")


@query("knn_nested_gaps", f"""with {SCALED},
children as (select q.vec_id query_id, c.vec_id // 5 _id, c.vec_id % 5 child, round({DISTANCE['l2'].format(a='q.v', b='c.v')}, 9) + 0.0 d
  from v q, v c where c.vec_id % 3 <> 0 and c.vec_id % 20 >= 5),
pairs as (select query_id, _id, min(d) d, arg_min(child, (d, child)) child from children group by query_id, _id), {RANKED}
select query_id, _id, child::INTEGER child, {sql_r('d')} as distance, {sql_r(SCORE['l2'])} as score, rank::INTEGER as rank
from ranked where rank <= 10""")
def knn_nested_gaps(spark, sf_dir):
    """Children without a vector, NULL children, and parents that have no other are skipped."""
    rows = corpus(spark, sf_dir, scaled=True)
    there = F.when((F.col("_id") % 3 != 0) & (F.col("_id") % 20 >= 5), F.col("vector"))
    child = F.when(F.col("_id") % 6 != 0, F.struct(there.alias("inner")))
    listed = F.sort_array(F.collect_list(F.struct(F.col("_id").alias("n"), child.alias("child"))))
    parents = rows.groupBy(F.floor(F.col("_id") / 5).alias("_id")).agg(F.transform(listed, lambda x: x.child).alias("outer"))
    return shown(knn(parents, queries_of(rows), 10, "l2", nested="outer.inner"), "child")


@query("radial_max_distance", sql_hits("l2", "d <= 1.5 and rank <= 10000"))
def radial_max_distance(spark, sf_dir):
    rows = corpus(spark, sf_dir)
    return shown(radial(rows, queries_of(rows), "l2", max_distance=1.5))


@query("radial_min_score", sql_hits("innerproduct", f"{SCORE['innerproduct']} >= 1.8 and rank <= 10000", SCALED))
def radial_min_score(spark, sf_dir):
    rows = corpus(spark, sf_dir, scaled=True)
    return shown(radial(rows, queries_of(rows), "innerproduct", min_score=1.8))


@query("radial_capped", sql_hits("cosine", "d <= 0.9 and rank <= 20"))
def radial_capped(spark, sf_dir):
    """More rows in reach than the cap: the closest are kept."""
    rows = corpus(spark, sf_dir)
    return shown(radial(rows, queries_of(rows), "cosine", max_distance=0.9, cap=20, salts=4, block_queries=200))


@query("radial_filtered", sql_hits("l2", "d <= 1.6 and rank <= 10000", DESCRIBED, queries="c", rows="c", where="c.age = 3"))
def radial_filtered(spark, sf_dir):
    rows = described(spark, sf_dir)
    return shown(radial(rows, queries_of(rows.select("_id", "vector")), "l2", max_distance=1.6, where="age = 3"))
