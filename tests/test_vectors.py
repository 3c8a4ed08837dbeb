import math

import pytest
from pyspark.sql import functions as F

from orbivec.functions import text as tx
from orbivec.functions import vectors as vx


def one(spark, **columns):
    row = spark.range(1).select(*[c.alias(n) for n, c in columns.items()]).first()
    return row


def arr(*v):
    return F.array(*[F.lit(float(x)) for x in v])


def test_space_names():
    assert {vx.space_of(n) for n in ("l2", "l2_squared")} == {"l2"}
    assert {vx.space_of(n) for n in ("innerproduct", "inner_product")} == {"innerproduct"}
    assert {vx.space_of(n) for n in ("cosine", "cosinesimil")} == {"cosine"}
    with pytest.raises(ValueError):
        vx.space_of("hamming")


def test_distances_and_scores(spark):
    a, b = arr(1, 2), arr(3, 0)
    r = one(spark, l2=vx.distance(a, b, "l2"), ip=vx.distance(a, b, "innerproduct"), cos=vx.distance(a, b, "cosine"),
            sim=vx.similarity(a, b))
    assert (r.l2, r.ip, r.sim) == (8.0, -3.0, 3.0)
    assert r.cos == pytest.approx(1 - 3 / (math.sqrt(5) * 3))
    s = one(spark, l2=vx.score(F.lit(8.0), "l2"), far=vx.score(F.lit(3.0), "innerproduct"),
            near=vx.score(F.lit(-3.0), "innerproduct"), cos=vx.score(F.lit(0.5), "cosine"),
            sim=vx.similarity_score(F.lit(3.0)), dis=vx.similarity_score(F.lit(-3.0)))
    assert (s.l2, s.far, s.near, s.cos) == (1 / 9, 0.25, 4.0, 0.75)
    assert (s.sim, s.dis) == (s.near, s.far)


def test_zero_vector_has_no_cosine_distance_and_stays_zero(spark):
    r = one(spark, d=vx.distance(arr(0, 0), arr(1, 0), "cosine"), n=vx.normalise(arr(0, 0)), u=vx.normalise(arr(3, 4)))
    assert r.d is None and r.n == [0.0, 0.0] and r.u == [0.6, 0.8]


@pytest.mark.parametrize("space", ["l2", "innerproduct", "cosine"])
@pytest.mark.parametrize("d", [-2.0, 0.0, 0.3, 1.7])
def test_threshold_conversion_inverts(space, d):
    if space != "innerproduct" and d < 0:
        return
    assert vx.score_to_distance(vx.distance_to_score(d, space), space) == pytest.approx(d)


def test_threshold_that_accepts_everything():
    assert vx.score_to_distance(0.0, "l2") == math.inf
    assert vx.score_to_distance(-1.0, "innerproduct") == math.inf


def test_nan_score_is_never_enough(spark):
    r = one(spark, nan=vx.at_least(F.lit(float("nan")), 0.5), eq=vx.at_least(F.lit(0.5), 0.5), d=vx.within(F.lit(0.5), 0.5))
    assert (r.nan, r.eq, r.d) == (False, True, True)


def test_pad_and_cut(spark):
    r = one(spark, p=vx.pad(F.array(F.lit(5), F.lit(6)), 4), c=vx.pad(F.array(F.lit(5), F.lit(6)), 1), f=vx.first_k(F.array(F.lit(5), F.lit(6)), 1))
    assert (r.p, r.c, r.f) == ([5, 6, -1, -1], [5], [5])


def test_well_formed(spark):
    hole = F.array(F.lit(1.0), F.lit(None).cast("double"))
    r = one(spark, ok=vx.well_formed(arr(1, 2), 2), short=vx.well_formed(arr(1), 2), hole=vx.well_formed(hole, 2),
            nan=vx.well_formed(arr(1, float("nan")), 2), none=vx.well_formed(F.lit(None).cast("array<double>"), 2))
    assert tuple(r) == (True, False, False, False, False)


def test_text(spark):
    r = one(spark, t=tx.tokens(F.lit("Ça va, l'été_2024!  ÇA")), none=tx.tokens(F.lit(None).cast("string")),
            m=tx.matches(F.lit("a Blue car"), F.lit("BLUE, red")), n=tx.matches(F.lit("bluish"), F.lit("blue")))
    assert r.t == ["ça", "va", "l", "été", "2024", "ça"] and r.none == [] and r.m and not r.n


@pytest.mark.parametrize("n,label", [(500_000, "500k"), (1_000_000, "1m"), (50_000, "50k"), (1_500_000, "1500k"), (1234, "1234"), (0, "0"), (999, "999")])
def test_count_label(spark, n, label):
    assert one(spark, x=tx.count_label(F.lit(n))).x == label


def test_lenient_object(spark):
    rows = spark.createDataFrame([('{"k": 1, "o": {"a": 2}}',), ("{broken",), ("",), (None,)], "j string")
    got = [r.o for r in rows.select(tx.lenient_object(F.col("j")).alias("o")).collect()]
    assert got == [{"k": "1", "o": '{"a":2}'}, {}, {}, {}]
