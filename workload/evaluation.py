"""Ground truth, radii, recall and run metrics."""

from __future__ import annotations

from pyspark.sql import functions as F

from orbivec.functions import vectors as vx
from orbivec.operators import truth as tr
from orbivec.operators.knn import knn, radial
from orbivec.operators.metrics import radial_recall as mean_radial_recall
from orbivec.operators.metrics import recall, run_metrics as summarise
from orbivec.plans.load import ground_truth_or_build
from orbivec.session import scratch_path
from orbivec.sources.bundle import Bundle
from workload.registry import DISTANCE, RANKED, RAW, SCALED, SCORE, corpus, queries_of, query, r6, sql_pairs, sql_r, table

# Sampling the first 1000 rows as queries is what the operator does.
UNIT = """u as (select vec_id, list_transform(v, lambda x: x / sqrt(list_inner_product(v, v))) v from v),
sampled as (select * from u where vec_id < 1000)"""
TRUTH = f"{SCALED}, {UNIT}, {sql_pairs('innerproduct', queries='sampled', rows='u')}, {RANKED}"


def _positioned(spark, sf_dir):
    """Scaled vectors; their number is their position."""
    return corpus(spark, sf_dir, scaled=True).withColumn("pos", F.col("_id"))


@query("ground_truth", f"with {TRUTH} select query_id, _id, {sql_r('d')} as distance, rank::INTEGER as rank from ranked where rank <= 100")
def ground_truth(spark, sf_dir):
    rows = _positioned(spark, sf_dir)
    built = ground_truth_or_build(spark, scratch_path(spark, "truth"), lambda: tr.build_ground_truth(rows))
    return built.select("query_id", "_id", r6("distance"), "rank")


@query("attached_truth", f"""with {TRUTH}
select v.vec_id query_id, coalesce(string_agg(_id::VARCHAR, ',' order by rank), '') as neighbors
from v left join (select * from ranked where rank <= 10) r on r.query_id = v.vec_id group by v.vec_id""")
def attached_truth(spark, sf_dir):
    """Every row with its ten true neighbours; rows that are not sampled have none."""
    rows = _positioned(spark, sf_dir)
    truth = tr.build_ground_truth(rows)
    asked = tr.attach_truth(rows.select(F.col("_id").alias("query_id")), truth, 10)
    return asked.select("query_id", F.array_join(F.col("neighbors").cast("array<string>"), ",").alias("neighbors"))


@query("recall_at_k", f"""with {TRUTH}, wanted as (select query_id, _id, rank from ranked where rank <= 10),
found as (select q.vec_id query_id, c.vec_id _id,
  row_number() over (partition by q.vec_id order by round({DISTANCE['l2'].format(a='q.v', b='c.v')}, 9), c.vec_id) rank from sampled s join v q using (vec_id), v c),
each as (select w.query_id, count(f._id) / count(*)::DOUBLE r, max(case when w.rank = 1 and f.rank = 1 then 1.0 else 0.0 end) r1
  from wanted w left join (select * from found where rank <= 10) f on f.query_id = w.query_id and f._id = w._id group by w.query_id)
select 'Mean recall@k' as metric, 'search' as task, {sql_r('avg(r)')} as value, '' as unit from each
union all select 'Mean recall@1', 'search', {sql_r('avg(r1)::DOUBLE')}, '' from each""")
def recall_at_k(spark, sf_dir):
    """How far L2 search on vectors of unequal length agrees with the cosine truth."""
    rows = _positioned(spark, sf_dir)
    asked = tr.sample_queries(rows, id_col="_id")
    truth = tr.build_ground_truth(rows, queries=asked)
    raw = queries_of(rows.select("_id", "vector")).join(asked.select("query_id"), "query_id", "left_semi")
    hits = knn(rows, raw, 10, "l2")
    return recall(hits, truth, 10).select("metric", "task", r6("value"), "unit")


def _bundle(spark, sf_dir, *keys):
    rows = corpus(spark, sf_dir)
    train = rows.select(F.col("_id").alias("pos"), "vector")
    test = rows.select(F.col("_id").alias("query_idx"), "vector")
    hits = knn(train, test, 10, "l2", id_col="pos", query_id="query_idx")
    tables = {"train": train, "test": test}
    if "neighbors" in keys:
        tables["neighbors"] = tr.as_arrays(hits, "pos", "ids").withColumnRenamed("query_id", "query_idx")
    if "distances" in keys:
        tables["distances"] = (tr.as_arrays(hits, "pos", "distances", "distance")
                               .withColumnRenamed("query_id", "query_idx"))
    return Bundle(tables)


RADII = ", ".join(f"{sql_r(f + '(d)')} as {n}_radius" for f, n in (("min", "min"), ("median", "median"), ("max", "max")))
TENTH = f"{RAW}, {sql_pairs('l2')}, {RANKED}"


@query("auto_threshold", f"""with {TENTH}
select {RADII} from ranked where rank = 10""")
def auto_threshold(spark, sf_dir):
    """From stored distances; the bundle goes through its directory."""
    path = scratch_path(spark, "bundle")
    _bundle(spark, sf_dir, "neighbors", "distances").write(path)
    return tr.auto_threshold(Bundle.read(spark, path), "l2").select(*[r6(c) for c in ("min_radius", "median_radius", "max_radius")])


@query("auto_threshold_probed", f"""with {TENTH}
select {RADII}
from ranked where rank = 10 and query_id < 100""")
def auto_threshold_probed(spark, sf_dir):
    """From neighbour ids: the first 100 queries are probed, which is what the operator does."""
    found = tr.auto_threshold(_bundle(spark, sf_dir, "neighbors"), "l2")
    return found.select(*[r6(c) for c in ("min_radius", "median_radius", "max_radius")])


@query("threshold_note", f"""with {TENTH}, t as (select median(d) m from ranked where rank = 10)
select query_id, case when d > m then 'looser' when d < m then 'tighter' else 'equal' end as note from ranked, t where rank = 10""")
def threshold_note(spark, sf_dir):
    """Each query's own radius against the suggested one."""
    bundle = _bundle(spark, sf_dir, "distances")
    radii = tr.last_radii(bundle, "l2")
    suggested = tr.auto_threshold(bundle, "l2").first()["median_radius"]
    note = tr.compare_threshold(F.col("radius"), F.lit(suggested))
    return radii.select(F.col("query_idx").alias("query_id"), note.alias("note"))


COUNTS = f"""{RAW}, {sql_pairs('l2')}, counts as (select v.vec_id, count(p._id) n from v left join (select * from pairs where d <= 1.4 and _id <> query_id) p
  on p.query_id = v.vec_id group by v.vec_id)"""


@query("radial_stats", f"""with {COUNTS}
select round(avg(n), 6) as mean_neighbours, median(n)::DOUBLE as median_neighbours, min(n) as min_neighbours, max(n) as max_neighbours,
  count(*) filter (where n = 0) as empty_queries from counts""")
def radial_stats(spark, sf_dir):
    rows = corpus(spark, sf_dir)
    hits = radial(rows, queries_of(rows), "l2", max_distance=1.4, cap=None).filter("_id <> query_id")
    stats = tr.neighbour_stats(hits, queries_of(rows))
    return stats.withColumn("mean_neighbours", F.round("mean_neighbours", 6))


@query("radial_truth", f"""with {RAW}, {sql_pairs('l2')}, {RANKED},
near as (select query_id, _id, rank from ranked where d <= 1.5 and rank <= 10000),
slots as (select vec_id query_id, unnest(range(1, 33)) slot from v)
select s.query_id, s.slot::INTEGER as slot, coalesce(n._id, -1) as _id, 1.5 as max_distance, round(1 / 2.5, 6)::DOUBLE as min_score, 'l2' as space
from slots s left join near n on n.query_id = s.query_id and n.rank = s.slot""")
def radial_truth(spark, sf_dir):
    """Padded neighbour lists, 32 wide, with the thresholds they were built for."""
    built = tr.build_radial_truth(_bundle(spark, sf_dir), "l2", 1.5, width=32)
    a = built.attrs.first()
    slots = built["radial_neighbors"].select("query_idx", F.posexplode("ids").alias("at", "_id"))
    return slots.select(F.col("query_idx").alias("query_id"), (F.col("at") + 1).alias("slot"), "_id",
                        F.lit(a.max_distance_threshold).alias("max_distance"),
                        F.lit(round(a.min_score_threshold, 6)).alias("min_score"), F.lit(a.space_type).alias("space"))


@query("radial_recall", f"""with {RAW}, {sql_pairs('l2')},
truth as (select query_id, count(*) n, count(*) filter (where d <= 1.2) found from pairs where d <= 1.4 group by query_id)
select 'Mean radial recall' as metric, 'radial' as task, {sql_r('avg(found / n::DOUBLE)')} as value, '' as unit from truth""")
def radial_recall(spark, sf_dir):
    """Hits of a tighter radius against the truth of a looser one."""
    rows = corpus(spark, sf_dir)
    asked = queries_of(rows)
    truth = radial(rows, asked, "l2", max_distance=1.4, cap=None)
    hits = radial(rows, asked, "l2", max_distance=1.2, cap=None)
    return mean_radial_recall(hits, truth, asked).select("metric", "task", r6("value"), "unit")


_QUANTILES = {"50th": 0.5, "90th": 0.9, "99th": 0.99, "99.9th": 0.999, "99.99th": 0.9999, "100th": 1.0}
_METRICS = "\nunion all ".join(
    [f"select '{n} Throughput' as metric, task, {sql_r(f + '(rate)::DOUBLE')} as value, 'docs/s' as unit from rates group by task"
     for n, f in (("Min", "min"), ("Mean", "avg"), ("Median", "median"), ("Max", "max"))]
    + [f"select '{n} percentile latency', task, {sql_r(f'quantile_cont(value, {p})')}, 'ms' from s group by task"
       for n, p in _QUANTILES.items()]
    + [f"select 'error rate', task, {sql_r('avg(error)::DOUBLE * 100')}, '%' from s group by task"])


@query("run_metrics", f"""with s as (select ts, event_type task, value, case when value > 300 then 1.0 else 0.0 end error from events),
rates as (select task, count(*) / 3600.0 rate from s group by task, date_trunc('hour', ts))
{_METRICS}""")
def run_metrics(spark, sf_dir):
    """Events as run samples: the type is the task, the value the latency, a value above 300 an error."""
    samples = table(spark, sf_dir, "events").select(
        "ts", F.col("event_type").alias("task"), F.lit(1).alias("docs"), F.col("value").alias("latency_ms"),
        (F.col("value") > 300).alias("error"))
    return summarise(samples, "1 hour").select("metric", "task", r6("value"), "unit")
