"""Reading, checking, splitting and maintaining tables; streams."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import types as T

from orbivec.functions import text as tx
from orbivec.functions import vectors as vx
from orbivec.operators import gate as gates
from orbivec.operators import slices
from orbivec.operators.knn import knn
from orbivec.plans.load import build_table
from orbivec.plans.table import VectorTable
from orbivec.session import scratch_path
from orbivec.sources.corpus import read_corpus, with_positions
from orbivec.sources.ragged import write_ragged
from orbivec.sources.vecs import read_ground_truth, read_vecs, register
from orbivec.streaming.ingest import stream_ingest, stream_search
from workload.registry import RAW, corpus, queries_of, query, r6, shown, sql_hits, table

VECTOR = T.ArrayType(T.FloatType())
MAPPING = T.StructType([T.StructField("_id", T.LongType()), T.StructField("vector", VECTOR),
                        T.StructField("age", T.IntegerType())])

_BATCHES = """a as (select vec_id _id, label, embedding[1] x from embeddings),
b as (select vec_id _id, label + 100 label, embedding[2] x from embeddings where label < 5)"""
_UPSERTED = f"""with {_BATCHES}
select a._id, coalesce(b.label, a.label)::INTEGER as age, round(coalesce(b.x, a.x)::DOUBLE, 6) + 0.0 as x from a left join b using (_id)"""


def _labelled(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings")
    return e.select(F.col("vec_id").alias("_id"), F.col("embedding").alias("vector"), F.col("label").alias("age"))


def _changes(rows):
    """Later writes: other ages, and vectors that start with the second element."""
    moved = F.slice("vector", 2, 63)
    return rows.filter("age < 5").select("_id", moved.alias("vector"), (F.col("age") + 100).cast("int").alias("age"))


def _first(rows):
    return rows.select("_id", "age", (F.round(F.col("vector")[0].cast("double"), 6) + F.lit(0.0)).alias("x"))


@query("upsert", _UPSERTED)
def upsert(spark, sf_dir):
    """A load and a later write of some ids, read without compaction."""
    rows = _labelled(spark, sf_dir)
    t = VectorTable(spark, scratch_path(spark, "table"))
    t.upsert(rows)
    t.compact()
    t.upsert(_changes(rows))
    return _first(t.read())


@query("upsert_order", """select vec_id _id, 2 as age from embeddings""")
def upsert_order(spark, sf_dir):
    """Three writes of every id in one batch: the last one by position stays."""
    rows = _labelled(spark, sf_dir)
    thrice = slices.repeat(rows, 3)
    t = VectorTable(spark, scratch_path(spark, "table"))
    t.upsert(thrice.select("_id", F.col("pass").alias("age"), F.col("pass").alias("pos")), order="pos")
    return t.read().select("_id", "age")


@query("compact", _UPSERTED)
def compact(spark, sf_dir):
    rows = _labelled(spark, sf_dir)
    t = VectorTable(spark, scratch_path(spark, "table"))
    t.upsert(rows)
    t.upsert(_changes(rows))
    t.compact(segments=2, shards=2)
    return _first(t.read())


@query("append", "select label as age, 2 * count(*) as n, 2 * count(*) as ids from embeddings group by label")
def append(spark, sf_dir):
    """Two appends under generated ids: nothing is replaced."""
    rows = _labelled(spark, sf_dir).drop("_id")
    t = VectorTable(spark, scratch_path(spark, "table"))
    t.append(rows)
    t.append(rows)
    return t.read().groupBy("age").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("_id").alias("ids"))


@query("load_table", "select vec_id _id, label::INTEGER as age, round(embedding[1]::DOUBLE, 6) + 0.0 as x from embeddings where label <> 4 and label <> 7")
def load_table(spark, sf_dir):
    """Check, write and compact; rows with a short or missing vector are left out."""
    rows = _labelled(spark, sf_dir)
    bad = F.when(F.col("age") == 4, F.slice("vector", 1, 63)).when(F.col("age") != 7, F.col("vector"))
    rows = rows.withColumn("vector", bad).withColumn("pos", F.col("_id"))
    return _first(build_table(rows, scratch_path(spark, "table"), MAPPING, 64).read())


_REASON = """case when label = 1 then 'unknown field partition_id' when label = 2 then 'missing vector' when label = 3 then 'wrong dimension'
  when label = 4 then 'invalid element' end"""


def _flawed(spark, sf_dir):
    """Good rows and four kinds of bad ones, by label."""
    v, age = F.col("vector"), F.col("age")
    hole = F.transform(v, lambda x, i: F.when(i != 5, x))
    flawed = F.when(age == 2, F.lit(None).cast(VECTOR)).when(age == 3, F.slice(v, 1, 63)).when(age == 4, hole).otherwise(v)
    rows = _labelled(spark, sf_dir)
    return rows.select("_id", flawed.alias("vector"), "age", F.when(age == 1, F.lit(7)).alias("partition_id"))


@query("strict_gate", f"select vec_id _id, coalesce({_REASON}, 'accepted') as verdict from embeddings")
def strict_gate(spark, sf_dir):
    good, bad = gates.gate(_flawed(spark, sf_dir), MAPPING, 64)
    return good.select("_id", F.lit("accepted").alias("verdict")).unionByName(
        bad.select("_id", F.col(gates.REASON).alias("verdict")))


@query("dynamic_gate", """select vec_id _id, case when label = 1 then 7 else -1 end::INTEGER as partition_id from embeddings
where label not in (2, 3, 4)""")
def dynamic_gate(spark, sf_dir):
    """A dynamic mapping takes the unknown field over."""
    good, _ = gates.gate(_flawed(spark, sf_dir), MAPPING, 64, strict=False)
    return good.select("_id", F.coalesce("partition_id", F.lit(-1)).alias("partition_id"))


@query("strict_gate_json", f"select coalesce({_REASON}, 'accepted') as verdict, count(*) as n from embeddings group by 1")
def strict_gate_json(spark, sf_dir):
    """The same rows as JSON objects."""
    lines = _flawed(spark, sf_dir).select(F.to_json(F.struct("*")).alias("line"))
    good, bad = gates.gate_json(lines, "line", MAPPING, 64)
    verdicts = good.select(F.lit("accepted").alias("verdict")).unionByName(bad.select(F.col(gates.REASON).alias("verdict")))
    return verdicts.groupBy("verdict").agg(F.count(F.lit(1)).alias("n"))


@query("gate_json_types", """select case when label = 3 then 'invalid value age' when label = 4 then 'invalid value _id' else 'accepted' end as verdict,
count(*) as n from embeddings group by 1""")
def gate_json_types(spark, sf_dir):
    """Values that are not of their field's type."""
    rows = _labelled(spark, sf_dir)
    age = F.when(F.col("age") == 3, F.lit("three")).otherwise(F.col("age").cast("string"))
    name = F.when(F.col("age") == 4, F.concat(F.lit("x"), F.col("_id"))).otherwise(F.col("_id").cast("string"))
    quoted = [F.when(v.try_cast("long").isNull(), F.concat(F.lit('"'), v, F.lit('"'))).otherwise(v) for v in (name, age)]
    lines = rows.select(F.format_string('{"_id": %s, "vector": %s, "age": %s}', quoted[0], F.to_json("vector"), quoted[1]).alias("line"))
    good, bad = gates.gate_json(lines, "line", MAPPING, 64)
    verdicts = good.select(F.lit("accepted").alias("verdict")).unionByName(bad.select(F.col(gates.REASON).alias("verdict")))
    return verdicts.groupBy("verdict").agg(F.count(F.lit(1)).alias("n"))


@query("positions", "select doc_id, row_number() over (order by doc_id) - 1 as pos from documents")
def positions(spark, sf_dir):
    return with_positions(spark, f"{sf_dir}/documents.parquet").select("doc_id", "pos")


@query("read_corpus", "select row_number() over (order by doc_id) - 1 as pos, doc_id::VARCHAR _id, lang, n_chars as vector from documents limit 300")
def corpus_rows(spark, sf_dir):
    """The first 300 rows in file order, which is what the row cap is for."""
    path = scratch_path(spark, "corpus")
    d = spark.read.parquet(f"{sf_dir}/documents.parquet").withColumnRenamed("doc_id", "id")
    d.repartitionByRange("id").sortWithinPartitions("id").write.parquet(path)
    return read_corpus(spark, path, "n_chars", ("lang",), limit=300)


_N = "(select count(*) from embeddings)"


@query("contiguous_split", f"select vec_id, least(floor(vec_id / ({_N} // 7)), 6)::INTEGER as slice from embeddings")
def contiguous_split(spark, sf_dir):
    rows = corpus(spark, sf_dir).select(F.col("_id").alias("pos"))
    return slices.contiguous_slice(rows, 7).select(F.col("pos").alias("vec_id"), "slice")


@query("strided_split", "select vec_id, (vec_id % 7)::INTEGER as slice from embeddings")
def strided_split(spark, sf_dir):
    rows = corpus(spark, sf_dir).select(F.col("_id").alias("pos"))
    return slices.strided_slice(rows, 7).select(F.col("pos").alias("vec_id"), "slice")


@query("bulks", "select doc_id, doc_id // 64 as bulk, doc_id // 100 * 2 + doc_id % 100 // 64 as bulk_of_read from documents")
def bulks(spark, sf_dir):
    """Bulks of 64 rows, without and with reads of 100 rows that end a bulk."""
    rows = with_positions(spark, f"{sf_dir}/documents.parquet").select("doc_id", "pos")
    plain = slices.chunked(rows, 64).withColumnRenamed("chunk_id", "bulk")
    return slices.chunked(plain, 64, read_size=100).select("doc_id", "bulk", F.col("chunk_id").alias("bulk_of_read"))


@query("repetitions", "select vec_id query_id, p::INTEGER as pass from embeddings, (select unnest(range(3)) p)")
def repetitions(spark, sf_dir):
    return slices.repeat(queries_of(corpus(spark, sf_dir)), 3).select("query_id", "pass")


@query("shuffled_passes", f"""select p::INTEGER as pass, n, n as queries, 0::BIGINT as first, n - 1 as last, n as places
from (select unnest(range(2)) p), (select count(*) n from embeddings)""")
def shuffled_passes(spark, sf_dir):
    """Every pass asks each query once, at places 0 to n-1."""
    drawn = slices.shuffled(queries_of(corpus(spark, sf_dir)).select("query_id"), 2)
    return drawn.groupBy("pass").agg(
        F.count(F.lit(1)).alias("n"), F.count_distinct("query_id").alias("queries"), F.min("order").alias("first"),
        F.max("order").alias("last"), F.count_distinct("order").alias("places"))


@query("count_label", """select doc_id, n_chars::VARCHAR as digits_or_k, (n_chars)::VARCHAR || 'k' as thousands,
  (n_chars)::VARCHAR || 'm' as millions from documents where n_chars % 1000 <> 0
union all select doc_id, (n_chars // 1000)::VARCHAR || 'k', (n_chars // 1000)::VARCHAR || 'm', n_chars::VARCHAR || 'm'
from documents where n_chars % 1000 = 0 and n_chars > 0
union all select doc_id, '0', '0', '0' from documents where n_chars = 0""")
def count_label(spark, sf_dir):
    d, n = table(spark, sf_dir, "documents"), F.col("n_chars")
    return d.select(
        "doc_id", tx.count_label(n).alias("digits_or_k"), tx.count_label(n * 1000).alias("thousands"),
        tx.count_label(n * 1_000_000).alias("millions"))


@query("lenient_json", """select event_id, case when event_id % 3 = 0 then 0 else 1 end::BIGINT as fields,
  case when event_id % 3 <> 0 then json_extract_string(props, '$.k') end as k from events""")
def lenient_json(spark, sf_dir):
    """Every third object is cut short."""
    raw = F.when(F.col("event_id") % 3 == 0, F.expr("left(props, length(props) - 1)")).otherwise(F.col("props"))
    parsed = table(spark, sf_dir, "events").select("event_id", tx.lenient_object(raw).alias("o"))
    return parsed.select("event_id", F.size("o").cast("bigint").alias("fields"), F.try_element_at("o", F.lit("k")).alias("k"))


@query("padded_ids", """select v as vec_id, slot::INTEGER as slot, case when slot <= v % 5 then slot * 10 else -1 end::BIGINT as id
from (select vec_id v, unnest(range(1, 4)) slot from embeddings)""")
def padded_ids(spark, sf_dir):
    """Lists of 0 to 4 ids, cut or filled to 3."""
    ids = F.slice(F.array(*[F.lit(i * 10) for i in range(1, 5)]), F.lit(1), (F.col("_id") % 5).cast("int"))
    rows = corpus(spark, sf_dir).select(F.col("_id").alias("vec_id"), F.posexplode(vx.pad(ids, 3)).alias("at", "id"))
    return rows.select("vec_id", (F.col("at") + 1).alias("slot"), "id")


@query("vecs_roundtrip", """select vec_id as pos, len(embedding)::INTEGER as dim, round(embedding[1]::DOUBLE, 6) + 0.0 as first,
  round(embedding[64]::DOUBLE, 6) + 0.0 as last from embeddings""")
def vecs_roundtrip(spark, sf_dir):
    """Vectors written to record files and read back by position."""
    register(spark)
    path = scratch_path(spark, "vectors")
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet").repartitionByRange(4, "vec_id").sortWithinPartitions("vec_id")
    rows.select(F.col("embedding").alias("vector")).write.format("vecs").mode("append").save(path)
    v = F.col("vector")
    return read_vecs(spark, path).select("pos", F.size(v).alias("dim"), (F.round(v[0].cast("double"), 6) + F.lit(0.0)).alias("first"),
                                         (F.round(v[63].cast("double"), 6) + F.lit(0.0)).alias("last"))


@query("vecs_truth", """select vec_id query_idx, rank::INTEGER as rank, (vec_id + rank * 3)::BIGINT as doc_id
from embeddings, (select unnest(range(1, 6)) rank)""")
def vecs_truth(spark, sf_dir):
    """Integer record files as ground truth, cut to five neighbours."""
    register(spark)
    path = scratch_path(spark, "neighbours")
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet").repartitionByRange(3, "vec_id").sortWithinPartitions("vec_id")
    ids = F.transform(F.sequence(F.lit(1), F.lit(8)), lambda i: (F.col("vec_id") + i * 3).cast("int"))
    rows.select(ids.alias("vector")).write.format("vecs").option("elem", "int").mode("append").save(path)
    return read_ground_truth(spark, path, 5)


@query("vecs_truth_ragged", """with c as (select vec_id, embedding::DOUBLE[] v from embeddings),
pairs as (select q.vec_id query_idx, c.vec_id doc_id, round(power(list_distance(q.v, c.v), 2), 9) + 0.0 d from c q, c),
r as (select *, row_number() over (partition by query_idx order by d, doc_id) as rank from pairs)
select query_idx, rank::INTEGER as rank, doc_id::BIGINT as doc_id from r where rank <= least(query_idx % 7, 5)""")
def vecs_truth_ragged(spark, sf_dir):
    """True neighbours, 0 to 6 for each row, in three files of rows that differ in length, cut to five."""
    path = scratch_path(spark, "neighbours")
    rows = corpus(spark, sf_dir)
    near = knn(rows, rows.withColumnRenamed("_id", "query_id"), 7, "l2").groupBy("query_id").agg(
        F.transform(F.sort_array(F.collect_list(F.struct("rank", "_id"))), lambda h: h["_id"].cast("int")).alias("ids"))
    kept = near.select("query_id", F.slice("ids", F.lit(1), (F.col("query_id") % 7).cast("int")).alias("ids"))
    write_ragged(kept.repartitionByRange(3, "query_id").sortWithinPartitions("query_id"), path, "ids")
    return read_ground_truth(spark, path, 5)


@query("stream_ingest", "select vec_id _id, label::INTEGER as age, round(embedding[1]::DOUBLE, 6) + 0.0 as x from embeddings")
def streamed_table(spark, sf_dir):
    """The table as a stream of files, checked and upserted batch by batch."""
    source, root = scratch_path(spark, "arrivals"), scratch_path(spark, "table")
    rows = _labelled(spark, sf_dir)
    rows.repartition(4).write.parquet(source)
    stream = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 2).parquet(source)
    stream_ingest(stream, root, MAPPING, 64, checkpoint=scratch_path(spark, "progress"), compact_every=2).awaitTermination()
    return _first(VectorTable(spark, root).read())


@query("stream_search", sql_hits("l2", "rank <= 10", RAW))
def streamed_hits(spark, sf_dir):
    """Queries that arrive as a stream of files."""
    source, out = scratch_path(spark, "arrivals"), scratch_path(spark, "hits")
    rows = corpus(spark, sf_dir)
    asked = queries_of(rows)
    asked.repartition(4).write.parquet(source)
    stream = spark.readStream.schema(asked.schema).option("maxFilesPerTrigger", 2).parquet(source)
    stream_search(stream, rows, out, 10, "l2", checkpoint=scratch_path(spark, "progress")).awaitTermination()
    return shown(spark.read.parquet(out))
