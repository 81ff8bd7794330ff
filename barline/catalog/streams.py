"""Streaming jobs, drained over the stored tables and compared with their batch twins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from barline.catalog.base import BARS, full_sql, register, std_sql
from barline.catalog.risk import LOG, SO
from barline.catalog.tables import ohlcv_sql
from barline.operators import indicators as ind
from barline.session import scratch_path
from barline.sources import manifest
from barline.sources.derived import bars_daily
from barline.streaming import jobs


def event_stream(spark: SparkSession, d: str) -> DataFrame:
    schema = spark.read.parquet(f"{d}/events.parquet").schema
    ev = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(d)
    return ev.withColumn("ts", F.col("ts").cast("timestamp"))


def tick_stream(spark, d):
    return event_stream(spark, d).select(
        F.col("event_type").alias("symbol"), "ts", F.col("value").alias("price"),
        F.lit(1.0).alias("size"), F.col("event_id").cast("bigint").alias("seq"))


def drained(spark, df: DataFrame, name: str) -> DataFrame:
    out, ckpt = scratch_path(spark, name), scratch_path(spark, f"{name}-ckpt")
    jobs.drain(jobs.append_to(df, out, ckpt))
    return spark.read.parquet(out)


@register("stream_bars", f"""SELECT * FROM ({ohlcv_sql('hour')})
WHERE ts + INTERVAL 1 HOUR <= (SELECT max(ts) FROM events) - INTERVAL 1 DAY""", "open high low close")
def stream_bars(spark, d):
    return drained(spark, jobs.stream_bars(tick_stream(spark, d), "1Hour"), "stream_bars")


@register("stream_metrics", """WITH w AS (SELECT event_type AS name, value, event_type = 'error' AS is_error,
  time_bucket(INTERVAL 15 MINUTE, ts, TIMESTAMP '1970-01-01') - k * INTERVAL 15 MINUTE AS window_start FROM events, range(4) t(k))
SELECT name, window_start, count(*) AS n, avg(value) AS mean, max(value) AS hi, quantile_disc(value, 0.95) AS p95,
  count(CASE WHEN is_error THEN 1 END) AS errors FROM w
WHERE window_start + INTERVAL 1 HOUR <= (SELECT max(ts) FROM events) - INTERVAL 2 HOUR GROUP BY 1, 2""", "mean hi p95")
def stream_metrics(spark, d):
    m = event_stream(spark, d).select(F.col("event_type").alias("name"), "ts", "value",
                                      (F.col("event_type") == "error").alias("is_error"))
    return drained(spark, jobs.stream_metrics(m, "1 hour", "15 minutes", "2 hours"), "stream_metrics")


def fed(spark, d, slices, start) -> None:
    """Daily bars arrive in time slices, not in order; after each slice the stream is run. A slice is given
    by shares of the table's own time span, so that all bars come in, and a factor for its closes."""
    path, bars = scratch_path(spark, "bars-in"), bars_daily(spark, d)
    lo, hi = bars.agg(F.unix_seconds(F.min("ts")), F.unix_seconds(F.max("ts"))).first()
    if lo is None:
        bars.write.parquet(path)
        return jobs.drain(start(spark.readStream.schema(bars.schema).parquet(path)))
    at = F.lit(None) if hi == lo else (F.unix_seconds("ts") - lo) / (hi - lo)
    for first, end, scale in slices:
        part = bars.where((at >= first) & ((at < end) | F.lit(end >= 1)) if hi > lo else F.lit(end >= 1))
        part.withColumn("close", F.col("close") * scale).write.mode("append").parquet(path)
        jobs.drain(start(spark.readStream.schema(bars.schema).parquet(path)))


@register("stream_upsert", f"WITH {BARS} SELECT * FROM bars", "open high low close")
def stream_upsert(spark, d):
    """A first value, a wrong rewrite, newer bars, and, while the folders so far are folded, the first
    value once more, very late."""
    root, ckpt = scratch_path(spark, "bars-upserted"), scratch_path(spark, "upsert-ckpt")
    start = lambda feed: jobs.stream_upsert(feed, root, ckpt)
    fed(spark, d, [(0.0, 0.7, 1.0), (0.3, 0.5, 2.0), (0.7, 1.0, 1.0)], start)

    def late():
        # a second feed goes on with higher batch numbers
        bars = bars_daily(spark, d)
        next_batch = 1 + max(last for _, last in manifest.snapshot(spark, root)[1])
        jobs.upsert_batch(root)(bars, next_batch)
        jobs.upsert_batch(root)(bars.withColumn("close", -F.col("close")), next_batch)  # a retry changes nothing
    jobs.compact(spark, root, late)
    return jobs.read_upserted(spark, root)


@register("stream_signals", f"""WITH {BARS}, s AS (SELECT *, {full_sql('avg', 'close', 20)} AS mid, {std_sql('close', 20)} AS sd FROM bars)
SELECT symbol, ts, close, mid + 2 * sd AS bb_upper, CASE WHEN close > mid + 2 * sd THEN 'short' WHEN close < mid - 2 * sd THEN 'long' ELSE 'neutral' END AS direction
FROM s""", "close bb_upper", digits=4)
def stream_signals(spark, d):
    hist, out, ckpt = (scratch_path(spark, f"signals-{k}") for k in ("history", "out", "ckpt"))

    def score(bars):
        b = ind.bollinger(bars)
        return b.select("symbol", "ts", "close", "bb_upper",
                        F.when(F.col("close") > F.col("bb_upper"), "short")
                        .when(F.col("close") < F.col("bb_lower"), "long").otherwise("neutral").alias("direction"))
    slices = [(0.0, 0.6, 1.0), (0.9, 1.0, 1.0), (0.6, 0.9, 1.0)]
    fed(spark, d, slices, lambda feed: jobs.stream_signals(feed, hist, out, ckpt, score, 19))
    return jobs.read_signals(spark, out)


@register("stream_breaker", f"""WITH {LOG}, a AS (SELECT *, count(CASE WHEN kind = 'error' THEN 1 END) OVER (PARTITION BY symbol ORDER BY ts
   RANGE BETWEEN INTERVAL 1 HOUR PRECEDING AND CURRENT ROW) AS errors FROM lg),
b AS (SELECT *, sum(CASE WHEN pnl >= 0 THEN 1 ELSE 0 END) OVER ({SO}) AS isl,
  sum(CASE WHEN pnl < 0 THEN pnl ELSE 0 END) OVER (PARTITION BY symbol, CAST(ts AS DATE) ORDER BY ts, id ROWS UNBOUNDED PRECEDING) AS day_loss FROM a),
c AS (SELECT *, CAST(sum(CASE WHEN pnl < 0 THEN 1 ELSE 0 END) OVER (PARTITION BY symbol, isl ORDER BY ts, id ROWS UNBOUNDED PRECEDING) AS INTEGER) AS loss_streak FROM b),
e AS (SELECT *, max(CASE WHEN errors >= 5 OR loss_streak >= 5 THEN 3 WHEN abs(day_loss) > 500 * 0.1e0 OR loss_streak >= 3 THEN 2 WHEN errors >= 2 THEN 1 ELSE 0 END)
  OVER ({SO}) AS lv FROM c)
SELECT symbol, ts, id, CAST(errors AS INTEGER) AS errors, loss_streak, ['normal', 'warn', 'soft_halt', 'hard_halt'][lv + 1] AS level FROM e""")
def stream_breaker(spark, d):
    ev = event_stream(spark, d)
    log = ev.select(
        F.concat(F.lit("s"), (F.col("user_id") % 5).cast("string")).alias("symbol"), "ts", F.col("event_id").alias("id"),
        F.when(F.col("event_type") == "error", "error").when(F.col("event_type") == "purchase", "trade").otherwise("other").alias("kind"),
        F.when(F.col("event_type") == "purchase", F.col("value") - 12).alias("pnl"))
    root, ckpt = scratch_path(spark, "breaker"), scratch_path(spark, "breaker-ckpt")
    jobs.drain(jobs.stream_breaker(log, root, ckpt, 500.0, seconds=3600))
    return jobs.read_levels(spark, root).select(
        "symbol", "ts", "id", F.col("errors").cast("int").alias("errors"), F.col("loss_streak").cast("int").alias("loss_streak"), "level")
