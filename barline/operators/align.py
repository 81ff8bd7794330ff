"""Alignment of tables by key and time."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def align_signals(technical: DataFrame, **scores: DataFrame) -> DataFrame:
    """Left equi-joins on (symbol, ts); a missing score is 0."""
    out = technical
    for name, df in scores.items():
        out = out.join(df.select("symbol", "ts", F.col(df.columns[-1]).alias(name)),
                       ["symbol", "ts"], "left")
        out = out.withColumn(name, F.coalesce(F.col(name), F.lit(0.0)))
    return out


def asof_join(left: DataFrame, right: DataFrame, value: str, key: str = "symbol", ts: str = "ts",
              tie: Sequence[str] = (), bucket_seconds: int = 3600) -> DataFrame:
    """Newest ``value`` at or before each left row.

    The union is scanned per (key, time bucket); what a bucket inherits is the last value of the
    nearest earlier bucket that has one, found on one row per bucket.
    """
    cols = left.columns
    bucket = F.floor(F.unix_seconds(F.col(ts)) / bucket_seconds)
    lefts = left.select(*cols, bucket.alias("_b"), F.lit(None).cast("double").alias("_v"),
                        F.lit(1).alias("_side"), *[F.lit(None).cast("bigint").alias(f"_t{i}")
                                                   for i in range(len(tie))])
    rights = right.select(key, ts, bucket.alias("_b"), F.col(value).cast("double").alias("_v"),
                          F.lit(0).alias("_side"),
                          *[F.col(t).cast("bigint").alias(f"_t{i}") for i, t in enumerate(tie)])
    rights = rights.filter(F.col("_v").isNotNull())
    ties = [f"_t{i}" for i in range(len(tie))]
    scan = Window.partitionBy(key, "_b").orderBy(ts, "_side", *ties).rowsBetween(
        Window.unboundedPreceding, 0)
    local = (lefts.unionByName(rights, allowMissingColumns=True)
             .withColumn("_here", F.last("_v", ignorenulls=True).over(scan))
             .filter("_side = 1"))
    closing = rights.groupBy(key, "_b").agg(
        F.max_by("_v", F.struct(ts, *ties)).alias("_close"))
    open_buckets = lefts.select(key, "_b").distinct().join(closing, [key, "_b"], "full_outer")
    earlier = Window.partitionBy(key).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    carried = open_buckets.select(
        key, "_b", F.last("_close", ignorenulls=True).over(earlier).alias("_carry"))
    out = local.join(carried, [key, "_b"], "left")
    return out.select(*cols, F.coalesce("_here", "_carry").alias(value))


def prediction_actual(predictions: DataFrame, actuals: DataFrame) -> DataFrame:
    return predictions.join(actuals, ["signal", "horizon", "ts"])


def align_predictions(predictions: DataFrame, symbols: Sequence[str], value: str = "score") -> DataFrame:
    """One row per time step at which every symbol has a prediction."""
    wide = predictions.groupBy("ts").pivot("symbol", list(symbols)).agg(F.first(value))
    return wide.dropna(subset=list(symbols))


def target_vs_current(targets: DataFrame, holdings: DataFrame, prices: DataFrame) -> DataFrame:
    """Targets with what is held (0 if nothing) and the newest price."""
    held = holdings.groupBy("symbol").agg(F.sum("quantity").alias("current"))
    return (targets.join(held, "symbol", "left").join(prices, "symbol", "left")
            .withColumn("current", F.coalesce("current", F.lit(0)))
            .withColumn("price", F.coalesce("price", F.lit(0.0))))


def pairwise_symbols(returns: DataFrame, value: str = "ret") -> DataFrame:
    """Pairs of symbols at a common time. A time step holds one row per symbol of the universe,
    and the pairs are what a correlation matrix consists of."""
    a = returns.select("ts", F.col("symbol").alias("a"), F.col(value).alias("x"))
    b = returns.select("ts", F.col("symbol").alias("b"), F.col(value).alias("y"))
    return a.join(b, "ts").filter(F.col("a") < F.col("b"))


def expected_days_anti(bars: DataFrame, calendar: DataFrame) -> DataFrame:
    """Trading days of each symbol's span without a bar."""
    have = bars.select("symbol", F.to_date("ts").alias("day"))
    return calendar.join(have, ["symbol", "day"], "left_anti")
