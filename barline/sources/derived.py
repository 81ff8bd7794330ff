"""Bars, trades, logs and score tables derived from the generic star-schema tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from barline.operators.bars import rollup
from barline.operators.features import all_indicators, ml_features
from barline.plans.series import number_rows
from barline.sources.stored import stored


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    for field, kind in df.dtypes:
        if kind == "timestamp_ntz":
            df = df.withColumn(field, F.col(field).cast("timestamp"))
    return df


def line_ticks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """lineitem as trades: price is the unit price, size the quantity."""
    li = table(spark, sf_dir, "lineitem")
    return li.select(
        F.concat_ws("-", "l_returnflag", "l_linestatus").alias("symbol"),
        F.col("l_shipdate").alias("ts"),
        F.try_divide("l_extendedprice", "l_quantity").alias("price"),
        F.col("l_quantity").alias("size"),
        ((F.col("l_orderkey") * 8 + F.col("l_linenumber")) * 1_000_000
         + F.col("l_partkey") % 1_000_000).cast("bigint").alias("seq"))


def bars_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Daily bars with their position ``rn``, the number ``vn`` of their closes and the series length
    ``n``, as a stored table."""
    return stored(spark, sf_dir, "bars_daily", lambda: number_rows(
        rollup(line_ticks(spark, sf_dir), "1Day"), with_total=True, values="close"))


def bars_daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bars_series(spark, sf_dir).drop("rn", "vn", "n")


def event_ticks(spark: SparkSession, sf_dir: str) -> DataFrame:
    ev = table(spark, sf_dir, "events")
    return ev.select(F.col("event_type").alias("symbol"), "ts", F.col("value").alias("price"),
                     F.lit(1.0).alias("size"), F.col("event_id").cast("bigint").alias("seq"))


def bars_intraday(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One bar per event, volume 1."""
    ev = table(spark, sf_dir, "events")
    v = F.col("value")
    return ev.select("event_id", F.col("event_type").alias("symbol"), "ts", v.alias("open"),
                     v.alias("high"), v.alias("low"), v.alias("close"),
                     F.lit(1).cast("bigint").alias("volume"))


def ohlcv(spark: SparkSession, sf_dir: str, timeframe: str) -> DataFrame:
    return rollup(event_ticks(spark, sf_dir), timeframe)


def positions(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    entry = F.col("o_totalprice") / 100
    return o.select(
        F.col("o_orderkey").alias("id"), F.col("o_orderpriority").alias("symbol"),
        (F.col("o_custkey") % 50 + 1).cast("int").alias("quantity"),
        entry.alias("entry_price"),
        (entry * (1 + ((F.col("o_orderkey") % 21) - 10) / 100)).alias("current_price"),
        F.when(F.col("o_custkey") % 3 == 0, "SHORT").otherwise("LONG").alias("position_type"),
        F.col("o_orderdate").alias("entry_time"),
        F.when(F.col("o_orderstatus") == "F", "CLOSED").otherwise("OPEN").alias("status"))


def closes(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").filter("o_orderstatus = 'P'")
    return o.select(
        F.col("o_orderkey").alias("id"),
        (F.col("o_totalprice") / 100 * (1 + ((F.col("o_orderkey") % 13) - 6) / 100))
        .alias("exit_price"),
        F.expr("o_orderdate + INTERVAL '5' DAY").alias("exit_time"))


def signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    ev = table(spark, sf_dir, "events")
    return ev.select(
        F.col("event_id").alias("id"), F.col("event_type").alias("symbol"), "ts",
        F.when(F.col("user_id") % 2 == 0, "CONFLUENCE").otherwise("TECHNICAL").alias("signal_type"),
        F.when(F.col("value") > 15, "LONG").otherwise("SHORT").alias("direction"),
        (F.col("value") / 100).alias("strength"))


def metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    ev = table(spark, sf_dir, "events")
    return ev.select(F.col("event_id").alias("id"), "ts", F.col("event_type").alias("metric_name"),
                     F.col("value").alias("metric_value"), F.col("props").alias("labels"))


def trades_closed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Closed trades: pnl is the order total against the average of its symbol."""
    o = table(spark, sf_dir, "orders")
    mean = o.groupBy("o_orderpriority").agg(F.avg("o_totalprice").alias("_mean"))
    return o.join(mean, "o_orderpriority").select(
        F.col("o_orderkey").alias("id"), F.col("o_orderpriority").alias("symbol"),
        F.col("o_orderdate").alias("ts"), (F.col("o_totalprice") - F.col("_mean")).alias("pnl"))


def indicator_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All indicators of the daily bars, written once per session like any feature store."""
    return stored(spark, sf_dir, "indicators", lambda: all_indicators(bars_series(spark, sf_dir)))


def feature_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The seventy model features of the daily bars, written once per session."""
    return stored(spark, sf_dir, "features", lambda: ml_features(bars_series(spark, sf_dir)))
