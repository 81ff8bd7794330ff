"""Scans, table maintenance and upserts over the stored tables.

Plain Parquet has no MERGE: an upsert is a plan that yields the new snapshot. Latest-wins is an
aggregate with map-side combine, so a key with very many versions stays cheap.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from barline.functions import ratio, timeframe_seconds
from barline.operators.bars import BAR_COLUMNS, bucket_start, time_order
from barline.sources.stored import stage

# Bar sizes with a stored rollup; anything else reads the daily one.
ROLLUPS = {"1min": "ohlcv_1min", "1hour": "ohlcv_1hour", "1day": "ohlcv_daily",
           "daily": "ohlcv_daily"}


def between(df: DataFrame, start=None, end=None, ts: str = "ts") -> DataFrame:
    """Inclusive time range; each bound optional."""
    if start is not None:
        df = df.filter(F.col(ts) >= F.lit(start).cast("timestamp"))
    if end is not None:
        df = df.filter(F.col(ts) <= F.lit(end).cast("timestamp"))
    return df


def scan_bars(bars: DataFrame, symbol: str, start=None, end=None) -> DataFrame:
    cols = [c for c in BAR_COLUMNS if c != "symbol"]
    return between(bars.filter(F.col("symbol") == symbol), start, end).select(*cols).orderBy("ts")


def scan_ohlcv(tables: dict[str, DataFrame], symbol: str, timeframe: str, start=None,
               end=None) -> DataFrame:
    return scan_bars(tables[ROLLUPS.get(timeframe.lower(), "ohlcv_daily")], symbol, start, end)


def scan_filtered(df: DataFrame, start=None, end=None, **equals) -> DataFrame:
    """Optional equality filters plus a time range, newest first."""
    for column, value in equals.items():
        if value is not None:
            df = df.filter(F.col(column) == value)
    return between(df, start, end).orderBy(F.desc("ts"))


def scan_open_positions(positions: DataFrame) -> DataFrame:
    return positions.filter(F.col("status") == "OPEN")


# Parsed plan nodes other than commands that change something.
COMMAND_NODES = ("ParsedStatement", "InsertIntoStatement", "V2WriteCommand", "MergeIntoTable", "DeleteFromTable",
                 "UpdateTable", "CreateTable", "CreateTableAsSelect", "ReplaceTable", "ReplaceTableAsSelect")


def sql_select(spark: SparkSession, text: str, views: dict[str, DataFrame],
               args: dict | None = None) -> DataFrame:
    """One parameterised query over ``views``. Commands are refused by the type of their parsed
    plan, before anything runs; the views exist only for the time of the call, and a caller's own
    temporary view of the same name is put back after it."""
    plan = spark._jsparkSession.sessionState().sqlParser().parsePlan(text)
    kinds, open_ = [], [plan]
    while open_:
        node = open_.pop()
        kinds.append(node.getClass())
        children = node.children()
        open_ += [children.apply(i) for i in range(children.size())]
    for kind in kinds:
        while kind is not None:
            names = [kind.getSimpleName(), *(i.getSimpleName() for i in kind.getInterfaces())]
            if any(n.endswith("Command") or n in COMMAND_NODES for n in names):
                raise ValueError(f"only queries are allowed, not {names[0]}")
            kind = kind.getSuperclass()
    temporary = {t.name for t in spark.catalog.listTables() if t.isTemporary}
    own = {name: spark.table(name) for name in views if name in temporary}
    for name, df in views.items():
        df.createOrReplaceTempView(name)
    try:
        return spark.sql(text, args=args or {})
    finally:
        for name in views:
            spark.catalog.dropTempView(name)
            if name in own:
                own[name].createOrReplaceTempView(name)


def preview(df: DataFrame, n: int = 100) -> DataFrame:
    return df.limit(n)


def normalize_bars(raw: DataFrame) -> DataFrame:
    """Canonical bar columns from any letter case; a missing volume is 0."""
    by_lower = {c.lower(): c for c in raw.columns}
    ts = by_lower.get("timestamp") or by_lower.get("date") or by_lower.get("ts")
    vol = F.coalesce(F.col(by_lower["volume"]), F.lit(0)) if "volume" in by_lower else F.lit(0)
    return raw.select(*([F.col(by_lower["symbol"]).alias("symbol")] if "symbol" in by_lower else []),
                      F.col(ts).cast("timestamp").alias("ts"),
                      *[F.col(by_lower[c]).cast("double").alias(c)
                        for c in ("open", "high", "low", "close")],
                      vol.cast("bigint").alias("volume"))


def source_fallback(primary: DataFrame, secondary: DataFrame) -> DataFrame:
    """Rows of ``primary``; symbols it lacks come from ``secondary``."""
    have = primary.select("symbol").distinct()
    return primary.unionByName(secondary.join(have, "symbol", "left_anti"))


def coverage_check(bars: DataFrame, lookback: int, share: float = 0.8) -> DataFrame:
    out = bars.groupBy("symbol").agg(F.count(F.lit(1)).alias("bars"))
    return out.withColumn("short", F.col("bars") < lookback * share)


def cache_covers_range(bars: DataFrame, start, end) -> DataFrame:
    out = bars.groupBy("symbol").agg(F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"))
    return out.withColumn("covers", (F.col("first_ts") <= F.lit(start).cast("timestamp"))
                          & (F.col("last_ts") >= F.lit(end).cast("timestamp")))


def lookback_days(lookback: int, timeframe: str) -> int:
    """Calendar days that hold ``lookback`` bars, with a fifth to spare."""
    return int(lookback * timeframe_seconds(timeframe) / 86400 * 1.2)


def lookback_filter(bars: DataFrame, end, lookback: int, timeframe: str = "1Day") -> DataFrame:
    until = F.lit(end).cast("timestamp")
    since = until - F.expr(f"INTERVAL '{lookback_days(lookback, timeframe)}' DAY")
    return bars.filter((F.col("ts") >= since) & (F.col("ts") <= until))


def timeframe_bucket(bars: DataFrame, timeframe: str, tie: str | None = None) -> DataFrame:
    """Bars to coarser bars; ``tie``, a bigint column, decides between bars of one time."""
    order = time_order("ts", tie)
    return (bars.groupBy("symbol", bucket_start("ts", timeframe_seconds(timeframe)).alias("b"))
            .agg(F.min_by("open", order).alias("open"), F.max("high").alias("high"),
                 F.min("low").alias("low"), F.max_by("close", order).alias("close"),
                 F.sum("volume").cast("bigint").alias("volume"))
            .withColumnRenamed("b", "ts").select(*BAR_COLUMNS))


def scan_ticks(df: DataFrame, ddl: str, start=None, end=None) -> DataFrame:
    """Trades or quotes in their declared types, by time."""
    typed = df.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in StructType.fromDDL(ddl)])
    return between(typed, start, end).orderBy("ts")


# ---- upserts ---------------------------------------------------------------------------------

def latest_wins(df: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    rest = [c for c in df.columns if c not in keys]
    return (df.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("_r"))
            .select(*keys, "_r.*"))


def upsert_bars(stored: DataFrame, fresh: DataFrame) -> DataFrame:
    """New prices and volume overwrite; vwap and trade_count of a stored bar are kept."""
    keys = ["symbol", "ts"]
    overwrite = ["open", "high", "low", "close", "volume"]
    keep = ["vwap", "trade_count"]
    n = fresh.select(*keys, *[F.col(c).alias(f"_n_{c}") for c in overwrite + keep],
                     F.lit(True).alias("_new"))
    o = stored.withColumn("_old", F.lit(True))
    merged = o.join(n, keys, "full_outer")
    return merged.select(
        *keys,
        *[F.when(F.col("_new"), F.col(f"_n_{c}")).otherwise(F.col(c)).alias(c) for c in overwrite],
        *[F.when(F.col("_old"), F.col(c)).otherwise(F.col(f"_n_{c}")).alias(c) for c in keep])


def upsert_partitions(spark: SparkSession, path: str, fresh: DataFrame) -> None:
    """Upserts into a bars table stored by ``date``: only the days the new rows touch are read,
    merged and replaced."""
    day = F.to_date("ts")
    fresh = fresh.withColumn("date", day)
    touched = fresh.select("date").distinct()
    old = spark.read.parquet(path).join(touched, "date", "left_semi")
    merged = stage(upsert_bars(old.drop("date"), fresh.drop("date")), "bars-merged")
    (merged.withColumn("date", day).write.mode("overwrite").partitionBy("date")
     .option("partitionOverwriteMode", "dynamic").parquet(path))


def to_long(features: DataFrame, names: Sequence[str], version: str, created_at) -> DataFrame:
    """Wide features to (symbol, ts, feature_name, feature_value) rows without NULLs."""
    typed = features.select("symbol", "ts", *[F.col(n).cast("double").alias(n) for n in names])
    long = typed.unpivot(["symbol", "ts"], list(names), "feature_name", "feature_value")
    return (long.filter(F.col("feature_value").isNotNull())
            .withColumn("feature_version", F.lit(version))
            .withColumn("created_at", F.lit(created_at).cast("timestamp")))


def upsert_features(stored: DataFrame, fresh: DataFrame) -> DataFrame:
    both = stored.withColumn("_p", F.lit(0)).unionByName(fresh.withColumn("_p", F.lit(1)))
    return latest_wins(both, ["symbol", "ts", "feature_name"],
                       [F.col("_p"), F.col("created_at")]).drop("_p")


def features_wide(long: DataFrame, names: Sequence[str]) -> DataFrame:
    return (long.filter(F.col("feature_name").isin(*names))
            .groupBy("symbol", "ts").pivot("feature_name", list(names))
            .agg(F.first("feature_value")).orderBy("symbol", "ts"))


def append_rows(rows: DataFrame, path: str, payload: dict[str, Sequence[str]] | None = None) -> None:
    """Appends; each payload column becomes one JSON text column."""
    for name, cols in (payload or {}).items():
        rows = rows.withColumn(name, F.to_json(F.struct(*cols))).drop(*[c for c in cols if c != name])
    rows.write.mode("append").parquet(path)


def upsert_metric(metrics: DataFrame, tie: str) -> DataFrame:
    """Latest write wins on (ts, metric_name); labels are not part of the key."""
    return latest_wins(metrics, ["ts", "metric_name"], [F.col(tie)])


def rollup_refresh(stored: DataFrame, ticks: DataFrame, timeframe: str, start, end,
                   rollup) -> DataFrame:
    """Recomputes the buckets that lie wholly in [start, end); others stay as stored."""
    s, e = F.lit(start).cast("timestamp"), F.lit(end).cast("timestamp")
    fresh = rollup(ticks.filter((F.col("ts") >= s) & (F.col("ts") < e)), timeframe)
    return stored.filter(~((F.col("ts") >= s) & (F.col("ts") < e))).unionByName(fresh)


def rollup_realtime(stored: DataFrame, ticks: DataFrame, timeframe: str, mark, rollup) -> DataFrame:
    """Materialised buckets before the mark plus live aggregates from it on."""
    m = F.lit(mark).cast("timestamp")
    live = rollup(ticks.filter(F.col("ts") >= m), timeframe)
    return stored.filter(F.col("ts") < m).unionByName(live)


# ---- positions -------------------------------------------------------------------------------

def position_open(orders: DataFrame) -> DataFrame:
    return (orders.withColumn("current_price", F.col("entry_price"))
            .withColumn("status", F.lit("OPEN")))


def position_close(positions: DataFrame, closes: DataFrame) -> DataFrame:
    """Closes (id, exit_price, exit_time) booked on their open positions, in one batch."""
    p = positions.filter(F.col("status") == "OPEN").join(closes, "id")
    move = F.col("exit_price") - F.col("entry_price")
    side = F.when(F.col("position_type") == "LONG", move).otherwise(-move)
    p = p.withColumn("pnl", side * F.col("quantity"))
    return (p.withColumn("pnl_pct",
                         ratio("pnl", F.col("entry_price") * F.col("quantity")) * 100)
            .withColumn("status", F.lit("CLOSED")))


def close_positions(positions: DataFrame, closes: DataFrame) -> DataFrame:
    """The positions table after ``closes``: booked where a close meets an open position, every
    other row as it was."""
    p = positions.join(closes.withColumn("_close", F.lit(True)), "id", "left")
    hit = (F.col("status") == "OPEN") & F.col("_close").isNotNull()
    move = F.col("exit_price") - F.col("entry_price")
    pnl = F.when(F.col("position_type") == "LONG", move).otherwise(-move) * F.col("quantity")
    booked = {"pnl": pnl, "pnl_pct": ratio(pnl, F.col("entry_price") * F.col("quantity")) * 100,
              "exit_price": F.col("exit_price"), "exit_time": F.col("exit_time"), "status": F.lit("CLOSED")}
    return p.withColumns({n: F.when(hit, c).otherwise(F.col(n) if n in positions.columns else F.lit(None))
                          for n, c in booked.items()}).drop("_close")


def union_positions(database: DataFrame, broker: DataFrame) -> DataFrame:
    return database.unionByName(broker, allowMissingColumns=True)


# ---- nested reports --------------------------------------------------------------------------

def read_reports(spark: SparkSession, path: str, schema: str, multi_line: bool = False) -> DataFrame:
    return spark.read.schema(schema).json(path, multiLine=multi_line)


def report_rankings(reports: DataFrame) -> DataFrame:
    """One row per ranking entry of each report."""
    return reports.select("report_id", F.explode("rankings").alias("r")).select("report_id", "r.*")


def report_params(reports: DataFrame) -> DataFrame:
    return reports.select("report_id", F.explode("params").alias("name", "value"))


# ---- ranking, top-k --------------------------------------------------------------------------

def recent(df: DataFrame, n: int = 10, tie: Sequence[str] = ()) -> DataFrame:
    return df.orderBy(F.desc("ts"), *[F.desc(t) for t in tie]).limit(n)


def latest_metrics(metrics: DataFrame, now, minutes: int = 5, tie: str = "id") -> DataFrame:
    """Newest value per metric name inside the last minutes before ``now``."""
    until = F.lit(now).cast("timestamp")
    fresh = metrics.filter((F.col("ts") > until - F.expr(f"INTERVAL '{minutes}' MINUTE"))
                           & (F.col("ts") <= until))
    return latest_wins(fresh, ["metric_name"], [F.col("ts"), F.col(tie)])


def last_n(df: DataFrame, n: int, keys: Sequence[str], order: Sequence[str],
           bucket: Column) -> DataFrame:
    """The newest n rows per key.

    Each (key, bucket) keeps its own newest n first, so the final ranking of a hot key sees at
    most n rows per bucket; buckets are spread over tasks.
    """
    newest = [F.desc(c) for c in order]
    local = Window.partitionBy(*keys, "_b").orderBy(*newest)
    overall = Window.partitionBy(*keys).orderBy(*newest)
    return (df.withColumn("_b", bucket).withColumn("_r", F.row_number().over(local))
            .filter(F.col("_r") <= n).withColumn("_r", F.row_number().over(overall))
            .filter(F.col("_r") <= n).drop("_b", "_r"))


def duplicate_keys(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    return (df.groupBy(*keys).agg(F.count(F.lit(1)).alias("copies"))
            .filter(F.col("copies") > 1))
