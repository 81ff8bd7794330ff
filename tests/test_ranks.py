"""Positions, running counts and quantiles by sampled ranges."""

import random

from pyspark.sql import functions as F

from barline.operators import monitoring, quality
from barline.plans.ranks import numbered, quantiles
from barline.sources.derived import bars_series

SF = "/root/testdata/sf0.001"


def test_quantiles_equal_percentile(spark):
    rng = random.Random(4)
    rows = [("a", rng.choice([0.5, 1.0, 1.0, 2.25, 7.0, -3.0])) for _ in range(999)] + [("b", rng.gauss(0, 1)) for _ in range(500)]
    rows += [(None, 1.0), (None, 3.0), ("one", 4.5), ("none", None)]
    df = spark.createDataFrame(rows, "k string, v double").repartition(6)
    shares = {"p0": 0.0, "p1": 0.01, "p50": 0.5, "p95": 0.95, "p100": 1.0}
    got = {tuple(r) for r in quantiles(df, ["k"], "v", shares).collect()}
    want = {tuple(r) for r in df.where("v IS NOT NULL").groupBy("k").agg(
        *[F.expr(f"percentile(v, {q})").alias(n) for n, q in shares.items()]).collect()}
    assert got == want and len(got) == 4


def test_no_buffer_per_key_in_the_plan(spark):
    text = quality.gap_analysis(bars_series(spark, SF))._jdf.queryExecution().executedPlan().toString()
    assert "ObjectHashAggregate" not in text and "percentile" not in text


def test_positions_of_a_hot_group_with_ties(spark):
    df = spark.range(9_000).select(F.when(F.col("id") % 3 == 0, "rare").otherwise("hot").alias("g"), (F.col("id") % 50).alias("v"), "id")
    rows = numbered(df.repartition(7), "g", [F.col("v").desc(), F.col("id")]).collect()
    for g in ("hot", "rare"):
        mine = sorted((r for r in rows if r.g == g), key=lambda r: r.pos)
        assert [r.pos for r in mine] == list(range(len(mine))) and {r.n for r in mine} == {len(mine)}
        assert [(-r.v, r.id) for r in mine] == sorted((-r.v, r.id) for r in mine)


def test_ks_with_ties_against_shares(spark):
    rng = random.Random(5)
    ref = [("x", float(rng.randrange(20))) for _ in range(700)] + [("y", 1.0)] * 30
    cur = [("x", float(rng.randrange(4, 24))) for _ in range(500)] + [("y", 1.0)] * 10
    got = {r.feature: r for r in monitoring.ks_test(spark, spark.createDataFrame(ref, "feature string, value double"),
                                                    spark.createDataFrame(cur, "feature string, value double")).collect()}
    x, y = ([v for f, v in part if f == "x"] for part in (ref, cur))
    want = max(abs(sum(a <= v for a in x) / len(x) - sum(b <= v for b in y) / len(y)) for v in {*x, *y})
    assert abs(got["x"].ks_statistic - want) < 1e-12 and got["y"].ks_statistic == 0 and got["y"].p_value == 1
