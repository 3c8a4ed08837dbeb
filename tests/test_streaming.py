import numpy as np
from pyspark.sql import functions as F
from pyspark.sql import types as T

from orbivec import knn
from orbivec.plans.table import VectorTable
from orbivec.streaming.ingest import stream_ingest, stream_search
from tests.brute import hits_of, table

MAPPING = T.StructType([T.StructField("_id", T.LongType()), T.StructField("vector", T.ArrayType(T.FloatType()))])
X = np.random.default_rng(9).normal(size=(60, 4)).astype(np.float32)


def test_ingest_over_several_runs(spark, tmp_path):
    source, root = str(tmp_path / "in"), str(tmp_path / "t")
    rows = table(spark, X, parts=1)
    schema = rows.schema.add("other", "integer")

    def run():
        stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(source)
        stream_ingest(stream, root, MAPPING, 4, checkpoint=str(tmp_path / "cp"), rejects=str(tmp_path / "rej"),
                      compact_every=3).awaitTermination()
        return {r._id: r.vector for r in VectorTable(spark, root).read().collect()}

    none = F.lit(None).cast("int").alias("other")
    for lo in (0, 20, 40):
        rows.filter(f"_id >= {lo} and _id < {lo + 20}").select("*", none).write.mode("append").parquet(source)
    assert sorted(run()) == list(range(60))
    changed = rows.filter("_id < 5").select("_id", F.transform("vector", lambda x: -x).alias("vector"), none)
    bad = rows.filter("_id = 50").select((F.col("_id") + 100).alias("_id"), "vector", F.lit(1).alias("other"))
    changed.unionByName(bad).coalesce(1).write.mode("append").parquet(source)
    got = run()
    assert sorted(got) == list(range(60))
    assert np.allclose(got[3], -X[3]) and np.allclose(got[30], X[30])
    assert [r._id for r in spark.read.parquet(str(tmp_path / "rej")).collect()] == [150]
    assert run() == got  # nothing new arrived


def test_search_equals_batch(spark, tmp_path):
    source = str(tmp_path / "q")
    corpus, queries = table(spark, X), table(spark, X[:20], name="query_id", parts=1)
    twice = queries.filter("query_id < 10").unionByName(queries.filter("query_id < 3"))
    twice.coalesce(1).write.parquet(source)
    queries.filter("query_id >= 10").coalesce(1).write.mode("append").parquet(source)
    stream = spark.readStream.schema(queries.schema).option("maxFilesPerTrigger", 1).parquet(source)
    stream_search(stream, corpus, str(tmp_path / "out"), 5, "l2", checkpoint=str(tmp_path / "cp")).awaitTermination()
    got = spark.read.parquet(str(tmp_path / "out"))
    assert got.select("batch").distinct().count() == 2
    assert hits_of(got) == hits_of(knn(corpus, queries, 5, "l2"))
