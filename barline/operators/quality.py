"""Data quality: validation with quarantine, calendars, gaps, profiles, readiness."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barline.functions import ratio
from barline.plans.ranks import quantiles
from barline.plans.series import block_window, core_rows, in_blocks

PRICES = ["open", "high", "low", "close"]

# Holidays (month-day), symbol pattern and its longest length, text time formats.
HOLIDAYS = ["01-01", "07-04", "12-25", "12-31"]
SYMBOL_PATTERN = r"^[A-Z]{1,5}(\.[A-Z]+)?$"
SYMBOL_MAX = 10
TIME_FORMATS = ["yyyy-MM-dd HH:mm:ss", "yyyy-MM-dd'T'HH:mm:ss", "yyyy-MM-dd"]

# Metric, pass mark, warning mark.
THRESHOLDS = [("accuracy", 0.60, None), ("precision", 0.55, None), ("recall", 0.50, None),
              ("f1_score", 0.55, None), ("dsr", 0.95, 0.90), ("cv_mean", 0.60, None)]


def bar_rules() -> dict[str, tuple[str, Column]]:
    """Rule name to (severity, violation). A NULL comparison is no violation of that rule."""
    out = {f"negative_{c}": ("error", F.col(c) < 0) for c in [*PRICES, "volume"]}
    out["high_below_low"] = ("error", F.col("high") < F.col("low"))
    for c in ("open", "close"):
        out[f"{c}_outside_range"] = ("warning",
                                     (F.col(c) < F.col("low")) | (F.col(c) > F.col("high")))
    return out


def check_schema(bars: DataFrame) -> list[str]:
    """Missing columns and wrong types of a bars frame."""
    kinds = dict(bars.dtypes)
    bad = [f"missing {c}" for c in ["ts", *PRICES, "volume"] if c not in kinds]
    bad += [f"{c} is {kinds[c]}" for c in PRICES if c in kinds and kinds[c] not in ("double", "float")]
    if kinds.get("ts") not in (None, "timestamp", "timestamp_ntz"):
        bad.append(f"ts is {kinds['ts']}")
    if kinds.get("volume") not in (None, "bigint", "int", "double"):
        bad.append(f"volume is {kinds['volume']}")
    return bad


def validate_bars(bars: DataFrame) -> DataFrame:
    """Violations per rule over the whole table, in one pass (plus one for duplicate keys)."""
    rules = bar_rules()
    counts = bars.agg(*[F.sum(F.when(v, 1).otherwise(0)).alias(n) for n, (_, v) in rules.items()])
    pairs = ", ".join(f"'{n}', '{s}', {n}" for n, (s, _) in rules.items())
    long = counts.select(F.expr(f"stack({len(rules)}, {pairs})")
                         .alias("rule", "severity", "violations"))
    dup = (bars.groupBy("symbol", "ts").count().filter("count > 1")
           .agg(F.lit("duplicate_key").alias("rule"), F.lit("warning").alias("severity"),
                F.coalesce(F.sum("count"), F.lit(0)).alias("violations")))
    return long.unionByName(dup)


def split_valid(bars: DataFrame) -> DataFrame:
    """``errors`` lists the broken error rules of a row; empty for valid rows."""
    broken = [F.when(v, F.lit(n)) for n, (s, v) in bar_rules().items() if s == "error"]
    return bars.withColumn("errors", F.array_compact(F.array(*broken)))


def clean_keys(raw: DataFrame) -> DataFrame:
    """Normalised symbol and parsed time, or the reason for quarantine."""
    s = F.upper(F.trim("symbol"))
    text = F.trim(F.col("ts").cast("string"))
    parsed = [F.when(text.rlike(p), F.try_to_timestamp(text, F.lit(f))) for f, p in zip(
        TIME_FORMATS, [r"^\d{4}-\d{2}-\d{2} \d", r"^\d{4}-\d{2}-\d{2}T", r"^\d{4}-\d{2}-\d{2}$"])]
    unix = F.when(text.rlike(r"^\d+(\.\d+)?$"),
                  F.timestamp_micros((text.try_cast("double") * 1000000).try_cast("bigint")))
    out = raw.withColumn("clean_symbol", s).withColumn("clean_ts", F.coalesce(*parsed, unix))
    reason = (F.when(F.coalesce(F.length("clean_symbol"), F.lit(0)) == 0, "empty symbol")
              .when(F.length("clean_symbol") > SYMBOL_MAX, "symbol too long")
              .when(~F.col("clean_symbol").rlike(SYMBOL_PATTERN), "bad symbol")
              .when(F.col("clean_ts").isNull(), "bad timestamp"))
    return out.withColumn("reason", reason)


def is_trading_day(day: Column) -> Column:
    return (~F.dayofweek(day).isin(1, 7)) & (~F.date_format(day, "MM-dd").isin(*HOLIDAYS))


def trading_calendar(bars: DataFrame) -> DataFrame:
    """Trading days of each symbol between its first and last bar."""
    span = bars.groupBy("symbol").agg(F.to_date(F.min("ts")).alias("_a"),
                                      F.to_date(F.max("ts")).alias("_b"))
    days = span.select("symbol", F.explode(F.sequence("_a", "_b")).alias("day"))
    return days.filter(is_trading_day(F.col("day")))


def _gaps(bars: DataFrame, block_rows: int | None = None) -> DataFrame:
    df = in_blocks(bars, 1, block_rows=block_rows)
    df = df.withColumn("prev_ts", F.lag("ts").over(block_window()))
    df = df.withColumn("gap_days", (F.unix_micros("ts") - F.unix_micros("prev_ts")) / 86400e6)
    return core_rows(df)


def large_gaps(bars: DataFrame, days: float = 3.0, block_rows: int | None = None) -> DataFrame:
    """Gaps longer than ``days`` with the trading days inside them."""
    g = _gaps(bars, block_rows).filter(F.col("gap_days") > days)
    inside = F.sequence(F.date_add(F.to_date("prev_ts"), 1), F.date_sub(F.to_date("ts"), 1))
    return g.select("symbol", F.col("prev_ts").alias("gap_start"), F.col("ts").alias("gap_end"),
                    F.floor("gap_days").alias("calendar_days"),
                    F.size(F.filter(inside, is_trading_day)).alias("expected_trading_days"))


def gap_analysis(bars: DataFrame, block_rows: int | None = None) -> DataFrame:
    gaps = _gaps(bars, block_rows).select("symbol", "gap_days")
    stats = gaps.groupBy("symbol").agg(
        F.count(F.lit(1)).alias("actual"), F.avg("gap_days").alias("avg_gap"), F.max("gap_days").alias("max_gap"),
        F.count(F.when(F.col("gap_days") > 3, 1)).alias("large_gaps"))
    stats = stats.join(quantiles(gaps, ["symbol"], "gap_days", {"median_gap": 0.5}), "symbol", "left").select(
        "symbol", "actual", "avg_gap", "median_gap", "max_gap", "large_gaps")
    expected = trading_calendar(bars).groupBy("symbol").agg(F.count(F.lit(1)).alias("expected"))
    return (stats.join(expected, "symbol", "left")
            .withColumn("missing", F.col("expected") - F.col("actual"))
            .withColumn("coverage_pct", F.coalesce(ratio("actual", "expected") * 100, F.lit(0.0))))


def quality_profile(bars: DataFrame, block_rows: int | None = None) -> DataFrame:
    df = in_blocks(bars, 1, block_rows=block_rows)
    prev, prev_ts = F.lag("close").over(block_window()), F.lag("ts").over(block_window())
    df = core_rows(df.withColumn("_chg", F.abs(ratio(F.col("close") - prev, prev)))
                   .withColumn("_gap", F.unix_seconds("ts") - F.unix_seconds(prev_ts)))
    n = F.count(F.lit(1))

    def hits(cond):
        return F.sum(F.when(cond, 1).otherwise(0))
    nulls = [hits(F.col(c).isNull()).alias(f"null_{c}") for c in [*PRICES, "volume"]]
    return df.groupBy("symbol").agg(
        n.alias("rows"), *nulls, ratio(hits(F.col("close").isNull()) * 100, n).alias("null_close_pct"),
        hits(F.col("close") <= 0).alias("zero_prices"), hits(F.col("_chg") > 0.5).alias("extreme_changes"),
        F.max("_chg").alias("max_change"), hits(F.col("volume") == 0).alias("zero_volume"),
        hits(F.col("_gap") > 2 * 86400).alias("large_gaps"))


def feature_nulls(features: DataFrame, names: list[str]) -> DataFrame:
    """NULL count and share per feature column."""
    n = features.agg(F.count(F.lit(1)).alias("_n"),
                     *[F.count(F.when(F.col(c).isNull(), 1)).alias(c) for c in names])
    long = n.unpivot(["_n"], names, "feature", "nulls")
    return long.select("feature", "nulls", ratio(F.col("nulls") * 100, "_n").alias("null_pct"))


def readiness_flags(bars: DataFrame, lookback: int = 1260) -> DataFrame:
    df = bars.groupBy("symbol").agg(F.count(F.lit(1)).alias("rows"),
                                    F.datediff(F.max("ts"), F.min("ts")).alias("days"))
    flags = [F.when(F.col("rows") < 100, "insufficient rows")
             .when(F.col("rows") < 252, "limited rows"),
             F.when(F.col("rows") < lookback, "below lookback"),
             F.when(F.col("days") < 365, "under 1 year").when(F.col("days") < 756, "under 3 years")]
    return df.withColumn("flags", F.concat_ws("; ", F.array_compact(F.array(*flags))))


def threshold_assess(metrics: DataFrame) -> DataFrame:
    """Pass, warn or fail per metric of each model, with the overall verdict."""
    spark = metrics.sparkSession
    marks = spark.createDataFrame(THRESHOLDS, "metric string, pass_mark double, warn_mark double")
    df = metrics.join(F.broadcast(marks), "metric")  # six rows
    v = F.col("value")
    df = df.withColumn("status", F.when(v >= F.col("pass_mark"), "PASS")
                       .when(v >= F.col("warn_mark"), "WARNING").otherwise("FAIL"))
    dsr = F.max(F.when(F.col("metric") == "dsr", v))
    overall = df.groupBy("model").agg(F.min(F.col("status") == "PASS").alias("_all"),
                                      dsr.alias("_dsr"))
    overall = overall.select(
        "model", F.when(F.col("_all"), "READY").otherwise("REVIEW").alias("overall"),
        F.when(F.col("_all") & (F.col("_dsr") >= 0.95), "HIGH")
        .when(F.col("_dsr") >= 0.90, "MEDIUM").otherwise("LOW").alias("confidence"))
    return df.select("model", "metric", "value", "status").join(overall, "model")


def model_scorecard(assessed: DataFrame) -> DataFrame:
    """Mean, lowest and highest value per metric over all models, with ready counts."""
    return assessed.groupBy("metric").agg(
        F.avg("value").alias("mean_value"), F.min("value").alias("min_value"),
        F.max("value").alias("max_value"), F.count(F.lit(1)).alias("models"),
        F.count(F.when(F.col("overall") == "READY", 1)).alias("ready"))
