"""Structured Streaming twins of the batch jobs.

Rows later than the watermark are dropped here and repaired by the batch ``rollup_refresh``.
"""

from __future__ import annotations

import os
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from barline.functions import timeframe_seconds
from barline.operators.bars import time_order
from barline.operators.risk import ERROR_SECONDS, breaker_days, breaker_level
from barline.operators.tables import last_n, latest_wins
from barline.sources import manifest
from barline.sources.stored import stage

# How late a row may be, per bar size.
LATENESS = {"1Min": "1 hour", "1Hour": "1 day", "1Day": "7 days"}


def drain(query) -> None:
    """Waits for an available-now query; raises what the stream raised."""
    query.awaitTermination()


def stream_bars(ticks: DataFrame, timeframe: str, lateness: str | None = None) -> DataFrame:
    """Bars of a tick stream (symbol, ts, price, size, seq), each once its window is closed."""
    width = f"{timeframe_seconds(timeframe)} seconds"
    order = time_order("ts", "seq")
    out = (ticks.withWatermark("ts", lateness or LATENESS.get(timeframe, "1 day"))
           .groupBy("symbol", F.window("ts", width).alias("w"))
           .agg(F.min_by("price", order).alias("open"), F.max("price").alias("high"),
                F.min("price").alias("low"), F.max_by("price", order).alias("close"),
                F.sum("size").cast("bigint").alias("volume")))
    return out.select("symbol", F.col("w.start").alias("ts"), "open", "high", "low", "close", "volume")


def append_to(df: DataFrame, path: str, checkpoint: str):
    return (df.writeStream.format("parquet").outputMode("append").option("path", path)
            .option("checkpointLocation", checkpoint).trigger(availableNow=True).start())


def stream_metrics(metrics: DataFrame, window: str = "5 minutes", slide: str = "1 minute",
                   lateness: str = "10 minutes") -> DataFrame:
    """Sliding latency and error statistics of (ts, name, value, is_error)."""
    return (metrics.withWatermark("ts", lateness)
            .groupBy("name", F.window("ts", window, slide).alias("w"))
            .agg(F.count(F.lit(1)).alias("n"), F.avg("value").alias("mean"), F.max("value").alias("hi"),
                 F.percentile_approx("value", 0.95, 10000).alias("p95"),
                 F.sum(F.col("is_error").cast("long")).alias("errors"))
            .select("name", F.col("w.start").alias("window_start"), "n", "mean", "hi", "p95", "errors"))


# ---- upserts ---------------------------------------------------------------------------------

def each_batch(df: DataFrame, fn: Callable[[DataFrame, int], None], checkpoint: str, mode="append"):
    return (df.writeStream.outputMode(mode).option("checkpointLocation", checkpoint)
            .foreachBatch(fn).trigger(availableNow=True).start())


def stream_upsert(bars: DataFrame, root: str, checkpoint: str):
    """Writes every micro-batch of bars to a folder of its own and lists it in the table's manifest.

    Every row is kept with its batch and place of arrival, however late it is and whatever was there
    before; ``read_upserted`` merges and ``compact`` folds batches. A retried batch that the manifest has
    already is not listed again, and one that failed before its commit was never seen by a reader.
    """
    return each_batch(bars, upsert_batch(root), checkpoint)


def upsert_batch(root: str) -> Callable[[DataFrame, int], None]:
    def write(batch: DataFrame, batch_id: int) -> None:
        spark, name = batch.sparkSession, f"b-{batch_id:012d}-{os.urandom(6).hex()}"
        if done(manifest.snapshot(spark, root)[1], batch_id):
            return
        (batch.withColumn("batch", F.lit(batch_id).cast("bigint")).withColumn("arrival", F.monotonically_increasing_id())
         .write.parquet(f"{root}/{name}"))
        manifest.commit(spark, root, lambda live: None if done(live, batch_id) else [*live, (name, batch_id)])

    def done(live, batch_id):
        return any(last >= batch_id for _, last in live)  # batches come in order
    return write


def read_upserted(spark: SparkSession, root: str, version: int | None = None) -> DataFrame:
    """Newest prices and volume per (symbol, ts) in a version; vwap and trade_count of the first write stay."""
    return merged(manifest.read(spark, root, version)).drop("batch")


def merged(df: DataFrame) -> DataFrame:
    newest = ["open", "high", "low", "close", "volume"]
    first = [c for c in ("vwap", "trade_count") if c in df.columns]
    arrived = F.struct("batch", "arrival")
    out = df.groupBy("symbol", "ts").agg(
        F.max_by(F.struct(*newest, "batch"), arrived).alias("_new"),
        *([F.min_by(F.struct(*first), arrived).alias("_old")] if first else []))
    return out.select("symbol", "ts", "_new.*", *(["_old.*"] if first else []))


def compact(spark: SparkSession, root: str, before_commit: Callable[[], None] | None = None) -> int:
    """Folds all folders live now into one and commits that in their place; returns the version.

    Batches written meanwhile stay listed beside it: the folded rows count as the last folded batch,
    before all later ones. Readers of older versions go on reading the folders these list.
    """
    version, live = manifest.snapshot(spark, root)
    if len(live) < 2:
        return version
    last = max(batch for _, batch in live)
    name = f"c-{last:012d}-{os.urandom(6).hex()}"
    (merged(manifest.read(spark, root, version)).withColumn("batch", F.lit(last).cast("bigint"))
     .withColumn("arrival", F.lit(0).cast("bigint")).write.parquet(f"{root}/{name}"))
    if before_commit:
        before_commit()
    folded = set(live)

    def change(now):
        # another compaction may have folded some of them already: then this one gives way
        return [f for f in now if f not in folded] + [(name, last)] if folded <= set(now) else None
    return manifest.commit(spark, root, change)


# ---- breaker ---------------------------------------------------------------------------------

def stream_breaker(log: DataFrame, root: str, checkpoint: str, starting_equity: float, seconds: int = ERROR_SECONDS, **rule):
    """Breaker level after each row of a log stream (symbol, ts, id, kind, pnl), by the batch rule.

    No row is walked through. A micro-batch is stored by day; each of its strategies goes on from the end of
    the last day before its first fresh row, kept as one state row per strategy and day, and the batch
    rule's block windows run over the days from there on, stored rows and fresh ones, with the errors of
    the last ``seconds`` before. So rows out of order give new levels to all behind them; ``read_levels`` takes
    the newest. All tables are written per batch: a retried batch replaces itself, only earlier ones count.
    """
    def run(batch: DataFrame, batch_id: int) -> None:
        spark, at = batch.sparkSession, f"batch={batch_id:012d}"
        batch.withColumn("day", F.to_date("ts")).write.mode("overwrite").partitionBy("day").parquet(f"{root}/log/{at}")
        fresh = spark.read.parquet(f"{root}/log/{at}").drop("day")
        first = stage(fresh.groupBy("symbol").agg(F.to_date(F.min("ts")).alias("_from")), "breaker-first")
        rows, carried = fresh.withColumn("_lent", F.lit(False)), None
        earliest = first.agg(F.min("_from")).first()[0]
        if batch_id > 0 and earliest is not None:
            earlier = F.col("batch").cast("bigint") < batch_id
            known = spark.read.parquet(f"{root}/days").filter(earlier).join(first, "symbol").where("day < _from")
            known = latest_wins(known.drop("_from"), ["symbol", "day"], [F.col("batch").cast("bigint")]).drop("batch")
            carried = latest_wins(known, ["symbol"], [F.col("day")])
            day = F.date_sub(F.lit(earliest), 1 + seconds // 86400)  # older folders are not read
            old = spark.read.parquet(f"{root}/log").filter(earlier).where(F.col("day") >= day).join(first, "symbol")
            reach = F.col("_from").cast("timestamp") - F.make_dt_interval(secs=F.lit(seconds))
            old = old.where(F.col("ts") >= reach).withColumn("_lent", F.to_date("ts") < F.col("_from"))
            rows = rows.unionByName(old.select(*rows.columns))
        out = stage(breaker_level(rows, starting_equity, seconds, carried=carried, lent="_lent", **rule), "breaker-levels")
        breaker_days(out).write.mode("overwrite").parquet(f"{root}/days/{at}")
        out.write.mode("overwrite").parquet(f"{root}/levels/{at}")
    return each_batch(log, run, checkpoint)


def read_levels(spark: SparkSession, root: str) -> DataFrame:
    """The newest level of every log row."""
    return latest_wins(spark.read.parquet(f"{root}/levels"), ["symbol", "ts", "id"], [F.col("batch").cast("bigint")]).drop("batch")


# ---- signals ---------------------------------------------------------------------------------

def stream_signals(bars: DataFrame, history: str, out: str, checkpoint: str,
                   score: Callable[[DataFrame], DataFrame], halo: int, bucket_days: int = 180):
    """Scores each micro-batch of bars behind a halo of stored bars per symbol.

    ``score`` is any batch plan over bars; no indicator state lives in the stream. Both tables
    are written per batch, so a retried batch replaces itself, and only earlier batches count
    as history. From a symbol's first fresh bar on all its bars are scored, stored ones too: after
    a late bar the ones behind it get new scores. ``read_signals`` takes the newest.
    """
    def run(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        batch.write.mode("overwrite").parquet(f"{history}/batch={batch_id:012d}")
        fresh = spark.read.parquet(f"{history}/batch={batch_id:012d}").withColumn("_new", F.lit(True))
        rows = fresh
        if batch_id > 0:
            old = spark.read.parquet(history).filter(F.col("batch").cast("bigint") < batch_id)
            # the newest version of each stored bar, unless the batch brings a newer one
            old = latest_wins(old, ["symbol", "ts"], [F.col("batch").cast("bigint")]).drop("batch")
            old = old.join(fresh.select("symbol", "ts"), ["symbol", "ts"], "left_anti")
            old = old.join(fresh.groupBy("symbol").agg(F.min("ts").alias("_first")), "symbol")
            before = old.filter(F.col("ts") < F.col("_first")).drop("_first")
            after = old.filter(F.col("ts") > F.col("_first")).drop("_first").withColumn("_new", F.lit(True))
            bucket = F.floor(F.unix_seconds("ts") / (bucket_days * 86400))
            before = last_n(before, halo, ["symbol"], ["ts"], bucket).withColumn("_new", F.lit(False))
            rows = fresh.unionByName(after).unionByName(before)
        scored = score(rows.drop("_new")).join(rows.filter("_new").select("symbol", "ts"), ["symbol", "ts"], "left_semi")
        scored.write.mode("overwrite").parquet(f"{out}/batch={batch_id:012d}")
    return each_batch(bars, run, checkpoint)


def read_signals(spark: SparkSession, out: str) -> DataFrame:
    """The newest score of every bar."""
    return latest_wins(spark.read.parquet(out), ["symbol", "ts"], [F.col("batch").cast("bigint")]).drop("batch")
