"""Top-k of query ids given in several rows, and of components beyond exact double products, against all products."""

from pyspark.sql import functions as F

from orbivec.llm import topk


def test_every_row_of_a_query_is_asked(spark):
    rows = [(0, [1.0, 0.0]), (0, [-1.0, 0.5]), (0, [-1.0, 0.5]), (1, [0.5, 0.25]), (2, [-0.75, 1.0]), (3, [0.0, -1.0]), (3, [0.0, -1.0]), (4, [2.0**20, 1.0]), (5, [2.0**20 + 1, 2.0]), (50, [2.0**19, 3.0])]
    got = topk.top_k(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), F.col("vec_id") % 50 == 0).collect()
    whole = [(i, [int(x * 256) for x in v]) for i, v in rows]
    for q in (0, 50):
        want = sorted((-sum(x * y for x, y in zip(a, b, strict=True)), j) for i, a in whole if i == q for j, b in whole if j != q)[:5]
        assert [(-r.score, r.vec_id) for r in sorted(got, key=lambda r: r.rank) if r.query_id == q] == want
