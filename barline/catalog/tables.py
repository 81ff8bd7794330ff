"""Scans, rollups, upserts, positions, reports and top-k."""

from __future__ import annotations

from pyspark.sql import functions as F

from barline.catalog.base import BARS, register
from barline.operators import tables as tb
from barline.operators.bars import rollup
from barline.session import scratch_path
from barline.sources import derived as src
from barline.sources import schemas
from barline.sources.derived import bars_daily

WITH = f"WITH {BARS}\n"
OHLC = "open high low close"
RANGE = ("1996-03-01", "1999-06-30")


def ohlcv_sql(unit, where="TRUE", value="value"):
    return f"""SELECT event_type AS symbol, date_trunc('{unit}', ts) AS ts,
  arg_min({value}, row(ts, event_id)) AS open, max({value}) AS high, min({value}) AS low,
  arg_max({value}, row(ts, event_id)) AS close, CAST(count(*) AS BIGINT) AS volume
FROM events WHERE {where} GROUP BY 1, 2"""


@register("scan_bars", f"""{WITH} SELECT ts, open, high, low, close, volume FROM bars
WHERE symbol = 'A-F' AND ts BETWEEN '{RANGE[0]}' AND '{RANGE[1]}'""", OHLC)
def scan_bars(spark, d):
    return tb.scan_bars(bars_daily(spark, d), "A-F", *RANGE)


for _name, _tf, _unit in (("ohlcv_1min", "1Min", "minute"), ("ohlcv_1hour", "1Hour", "hour"),
                          ("ohlcv_daily", "1Day", "day")):
    def _rollup(spark, d, tf=_tf):
        return src.ohlcv(spark, d, tf)
    register(_name, ohlcv_sql(_unit), OHLC)(_rollup)


@register("bars_daily", f"{WITH} SELECT * FROM bars", OHLC)
def bars_from_lines(spark, d):
    return rollup(src.line_ticks(spark, d), "1Day")


@register("scan_ohlcv", f"""SELECT ts, open, high, low, close, volume FROM ({ohlcv_sql('hour')})
WHERE symbol = 'click' AND ts >= '2024-01-05' AND ts <= '2024-01-20'""", OHLC)
def scan_ohlcv(spark, d):
    tables = {"ohlcv_1hour": src.ohlcv(spark, d, "1Hour"), "ohlcv_daily": src.ohlcv(spark, d, "1Day")}
    return tb.scan_ohlcv(tables, "click", "1Hour", "2024-01-05", "2024-01-20")


SIGNALS = """SELECT event_id AS id, event_type AS symbol, ts,
  CASE WHEN user_id % 2 = 0 THEN 'CONFLUENCE' ELSE 'TECHNICAL' END AS signal_type,
  CASE WHEN value > 15 THEN 'LONG' ELSE 'SHORT' END AS direction, value / 100 AS strength
FROM events"""


@register("scan_signals", f"""SELECT * FROM ({SIGNALS}) WHERE symbol = 'view'
  AND signal_type = 'CONFLUENCE' AND ts >= '2024-01-03' """, "strength")
def scan_signals(spark, d):
    return tb.scan_filtered(src.signals(spark, d), start="2024-01-03", symbol="view",
                            signal_type="CONFLUENCE")


POSITIONS = """SELECT o_orderkey AS id, o_orderpriority AS symbol,
  CAST(o_custkey % 50 + 1 AS INTEGER) AS quantity, o_totalprice / 100 AS entry_price,
  o_totalprice / 100 * (1 + ((o_orderkey % 21) - 10) / 100e0) AS current_price,
  CASE WHEN o_custkey % 3 = 0 THEN 'SHORT' ELSE 'LONG' END AS position_type,
  o_orderdate AS entry_time, CASE WHEN o_orderstatus = 'F' THEN 'CLOSED' ELSE 'OPEN' END AS status
FROM orders"""
CLOSES = """SELECT o_orderkey AS id,
  o_totalprice / 100 * (1 + ((o_orderkey % 13) - 6) / 100e0) AS exit_price,
  o_orderdate + INTERVAL 5 DAY AS exit_time FROM orders WHERE o_orderstatus = 'P'"""


@register("scan_open_positions", f"SELECT * FROM ({POSITIONS}) WHERE status = 'OPEN'",
          "entry_price current_price")
def scan_open_positions(spark, d):
    return tb.scan_open_positions(src.positions(spark, d))


@register("sql_select", f"""{WITH} SELECT symbol, count(*) AS bars, avg(close) AS avg_close
FROM bars WHERE close > 500 GROUP BY symbol""", "avg_close")
def sql_select(spark, d):
    return tb.sql_select(
        spark, "SELECT symbol, count(*) AS bars, avg(close) AS avg_close FROM market_bars "
        "WHERE close > :floor GROUP BY symbol", {"market_bars": bars_daily(spark, d)},
        {"floor": 500})


@register("normalize_bars", f"""{WITH} SELECT symbol, ts, open, high, low, close,
  CAST(coalesce(CASE WHEN open > close THEN volume END, 0) AS BIGINT) AS volume FROM bars""", OHLC)
def normalize_bars(spark, d):
    raw = bars_daily(spark, d).select(
        "symbol", F.col("ts").alias("Date"), F.col("open").alias("OPEN"),
        F.col("high").alias("High"), F.col("low").alias("low"), F.col("close").alias("Close"),
        F.when(F.col("open") > F.col("close"), F.col("volume")).alias("Volume"))
    return tb.normalize_bars(raw)


@register("source_fallback", f"""{WITH}, a AS (SELECT * FROM bars WHERE symbol LIKE 'R%')
SELECT * FROM a UNION ALL
SELECT * FROM bars WHERE symbol NOT IN (SELECT symbol FROM a)""", OHLC)
def source_fallback(spark, d):
    bars = bars_daily(spark, d)
    return tb.source_fallback(bars.filter(F.col("symbol").startswith("R")), bars)


@register("coverage_check", f"""{WITH} SELECT symbol, count(*) AS bars,
  count(*) < 3050 * 0.8 AS short FROM bars GROUP BY 1""")
def coverage_check(spark, d):
    return tb.coverage_check(bars_daily(spark, d), 3050)


@register("cache_covers_range", f"""{WITH} SELECT symbol, min(ts) AS first_ts, max(ts) AS last_ts,
  min(ts) <= '1995-01-02' AND max(ts) >= '2001-10-31' AS covers FROM bars GROUP BY 1""")
def cache_covers_range(spark, d):
    return tb.cache_covers_range(bars_daily(spark, d), "1995-01-02", "2001-10-31")


@register("lookback_filter", f"""{WITH} SELECT * FROM bars
WHERE ts BETWEEN TIMESTAMP '2000-06-30' - INTERVAL 302 DAY AND '2000-06-30'""", OHLC)
def lookback_filter(spark, d):
    return tb.lookback_filter(bars_daily(spark, d), "2000-06-30", 252, "1Day")


@register("timeframe_bucket", """SELECT event_type AS symbol,
  time_bucket(INTERVAL 4 HOUR, ts, TIMESTAMP '1970-01-01') AS ts,
  arg_min(value, row(ts, event_id)) AS open, max(value) AS high, min(value) AS low,
  arg_max(value, row(ts, event_id)) AS close, CAST(count(*) AS BIGINT) AS volume
FROM events GROUP BY 1, 2""", OHLC)
def timeframe_bucket(spark, d):
    return tb.timeframe_bucket(src.bars_intraday(spark, d), "4Hour", "event_id")


@register("scan_ticks", """SELECT event_type AS symbol, ts, value AS price,
  CAST(user_id AS BIGINT) AS size, 'X' AS exchange FROM events WHERE ts >= '2024-01-02'""", "price")
def scan_ticks(spark, d):
    ev = src.table(spark, d, "events").select(
        F.col("event_type").alias("symbol"), "ts", F.col("value").alias("price"),
        F.col("user_id").alias("size"), F.lit("X").alias("exchange"))
    return tb.scan_ticks(ev, schemas.TRADES, start="2024-01-02")


@register("scan_quotes", """SELECT event_type AS symbol, ts, value - 1e-2 AS bid_price,
  value + 1e-2 AS ask_price, CAST(user_id AS BIGINT) AS bid_size, CAST(user_id + 1 AS BIGINT) AS ask_size
FROM events WHERE ts <= '2024-01-25'""", "bid_price ask_price")
def scan_quotes(spark, d):
    ev = src.table(spark, d, "events").select(
        F.col("event_type").alias("symbol"), "ts", (F.col("value") - 0.01).alias("bid_price"),
        (F.col("value") + 0.01).alias("ask_price"), F.col("user_id").alias("bid_size"),
        (F.col("user_id") + 1).alias("ask_size"))
    return tb.scan_ticks(ev, schemas.QUOTES, end="2024-01-25")


@register("upsert_bars", f"""{WITH},
o AS (SELECT *, close * 1.01e0 AS vwap, CAST(7 AS INTEGER) AS trade_count FROM bars
      WHERE ts < '2000-01-01'),
f AS (SELECT symbol, ts, open, high, low, close + 1 AS close, volume, close AS vwap,
             CAST(9 AS INTEGER) AS trade_count FROM bars WHERE ts >= '1999-01-01')
SELECT coalesce(o.symbol, f.symbol) AS symbol, coalesce(o.ts, f.ts) AS ts,
  coalesce(f.open, o.open) AS open, coalesce(f.high, o.high) AS high, coalesce(f.low, o.low) AS low,
  coalesce(f.close, o.close) AS close, coalesce(f.volume, o.volume) AS volume,
  coalesce(o.vwap, f.vwap) AS vwap, coalesce(o.trade_count, f.trade_count) AS trade_count
FROM o FULL OUTER JOIN f ON o.symbol = f.symbol AND o.ts = f.ts""", OHLC + " vwap")
def upsert_bars(spark, d):
    bars = bars_daily(spark, d)
    old = (bars.filter("ts < '2000-01-01'").withColumn("vwap", F.col("close") * 1.01)
           .withColumn("trade_count", F.lit(7)))
    new = (bars.filter("ts >= '1999-01-01'").withColumn("vwap", F.col("close"))
           .withColumn("trade_count", F.lit(9)).withColumn("close", F.col("close") + 1))
    return tb.upsert_bars(old, new)


LONG = f"""{WITH},
old_rows AS (SELECT symbol, ts, 'close' AS feature_name, close AS feature_value, 'v1' AS feature_version,
  TIMESTAMP '2024-01-01' AS created_at FROM bars
  UNION ALL SELECT symbol, ts, 'spread', CASE WHEN high > low THEN high - low END, 'v1',
  TIMESTAMP '2024-01-01' FROM bars),
new_rows AS (SELECT symbol, ts, 'close' AS feature_name, close * 2 AS feature_value, 'v2' AS feature_version,
  TIMESTAMP '2024-02-01' AS created_at FROM bars WHERE ts >= '1998-01-01')"""


def _feature_rows(spark, d):
    bars = bars_daily(spark, d)
    wide = bars.withColumn("spread", F.when(F.col("high") > F.col("low"),
                                            F.col("high") - F.col("low")))
    old = tb.to_long(wide, ["close", "spread"], "v1", "2024-01-01")
    new = tb.to_long(bars.filter("ts >= '1998-01-01'").withColumn("close", F.col("close") * 2),
                     ["close"], "v2", "2024-02-01")
    return old, new


@register("upsert_features", f"""{LONG}
SELECT o.* FROM old_rows o ANTI JOIN new_rows n USING (symbol, ts, feature_name)
WHERE feature_value IS NOT NULL UNION ALL SELECT * FROM new_rows""", "feature_value")
def upsert_features(spark, d):
    return tb.upsert_features(*_feature_rows(spark, d))


@register("features_wide", f"""{LONG} SELECT symbol, ts, max(CASE WHEN feature_name = 'close'
  THEN feature_value END) AS close, max(CASE WHEN feature_name = 'spread' THEN feature_value END)
  AS spread FROM old_rows WHERE feature_value IS NOT NULL GROUP BY 1, 2""", "close spread")
def features_wide(spark, d):
    return tb.features_wide(_feature_rows(spark, d)[0], ["close", "spread"])


@register("append_signal", f"""SELECT id, symbol, ts, strength,
  '{{"direction":"' || direction || '","signal_type":"' || signal_type || '"}}' AS metadata
FROM ({SIGNALS})""", "strength")
def append_signal(spark, d):
    path = scratch_path(spark, "trading_signals")
    rows = src.signals(spark, d)
    for part in ("LONG", "SHORT"):
        tb.append_rows(rows.filter(F.col("direction") == part), path,
                       {"metadata": ["direction", "signal_type"]})
    return spark.read.parquet(path)


METRICS = """SELECT event_id AS id, ts, event_type AS metric_name, value AS metric_value,
  props AS labels FROM events"""


@register("upsert_metric", f"""SELECT date_trunc('hour', ts) AS ts, metric_name,
  arg_max(id, id) AS id, arg_max(metric_value, id) AS metric_value, arg_max(labels, id) AS labels
FROM ({METRICS}) GROUP BY 1, 2""", "metric_value")
def upsert_metric(spark, d):
    m = src.metrics(spark, d).withColumn("ts", F.date_trunc("hour", "ts"))
    return tb.upsert_metric(m, "id")


@register("position_open", f"""SELECT id, symbol, quantity, entry_price, position_type, entry_time,
  entry_price AS current_price, 'OPEN' AS status FROM ({POSITIONS})""", "entry_price current_price")
def position_open(spark, d):
    return tb.position_open(src.positions(spark, d).drop("current_price", "status"))


CLOSED = f"""SELECT p.* REPLACE ('CLOSED' AS status), exit_price, exit_time,
  CASE WHEN position_type = 'LONG' THEN exit_price - entry_price ELSE entry_price - exit_price END
    * quantity AS pnl,
  CASE WHEN position_type = 'LONG' THEN exit_price - entry_price ELSE entry_price - exit_price END
    * quantity / (entry_price * quantity) * 100 AS pnl_pct
FROM ({POSITIONS}) p JOIN ({CLOSES}) c USING (id) WHERE p.status = 'OPEN'"""


@register("position_close", CLOSED, "entry_price current_price exit_price pnl pnl_pct")
def position_close(spark, d):
    return tb.position_close(src.positions(spark, d), src.closes(spark, d))


@register("position_snapshot", f"""SELECT p.* REPLACE (CASE WHEN c.id IS NULL THEN p.status ELSE 'CLOSED' END AS status), exit_price, exit_time,
  CASE WHEN position_type = 'LONG' THEN exit_price - entry_price ELSE entry_price - exit_price END * quantity AS pnl,
  CASE WHEN position_type = 'LONG' THEN exit_price - entry_price ELSE entry_price - exit_price END
    * quantity / (entry_price * quantity) * 100 AS pnl_pct
FROM ({POSITIONS}) p LEFT JOIN ({CLOSES}) c ON p.id = c.id AND p.status = 'OPEN'""", "entry_price current_price exit_price pnl pnl_pct")
def position_snapshot(spark, d):
    return tb.close_positions(src.positions(spark, d), src.closes(spark, d))


@register("close_join", f"""SELECT symbol, position_type, count(*) AS closed, sum(pnl) AS pnl
FROM ({CLOSED}) GROUP BY 1, 2""", "pnl", digits=3)
def close_join(spark, d):
    return (tb.position_close(src.positions(spark, d), src.closes(spark, d))
            .groupBy("symbol", "position_type")
            .agg(F.count(F.lit(1)).alias("closed"), F.sum("pnl").alias("pnl")))


@register("union_positions", f"""SELECT id, symbol, quantity, entry_price, current_price,
  position_type, entry_time, status FROM ({POSITIONS}) WHERE status = 'OPEN'
UNION ALL SELECT o_orderkey, o_orderpriority, CAST(1 AS INTEGER), o_totalprice, NULL, 'LONG', NULL, NULL
FROM orders WHERE o_orderstatus = 'O'""", "entry_price current_price")
def union_positions(spark, d):
    broker = src.table(spark, d, "orders").filter("o_orderstatus = 'O'").select(
        F.col("o_orderkey").alias("id"), F.col("o_orderpriority").alias("symbol"),
        F.lit(1).alias("quantity"), F.col("o_totalprice").alias("entry_price"),
        F.lit("LONG").alias("position_type"))
    return tb.union_positions(tb.scan_open_positions(src.positions(spark, d)), broker)


REPORT = ("report_id bigint, rankings array<struct<feature_name:string,importance:double,"
          "rank:bigint>>, params map<string,bigint>")


@register("json_report_scan", """SELECT event_id AS report_id, event_type AS feature_name,
  value AS importance, CAST(1 AS BIGINT) AS rank FROM events
UNION ALL SELECT event_id, 'user', value / 2, user_id FROM events""", "importance")
def json_report_scan(spark, d):
    path = scratch_path(spark, "reports")
    ev = src.table(spark, d, "events")

    def entry(name, imp, rank):
        return F.struct(name.alias("feature_name"), imp.alias("importance"), rank.alias("rank"))

    ev.select(F.col("event_id").alias("report_id"),
              F.array(entry(F.col("event_type"), F.col("value"), F.lit(1).cast("bigint")),
                      entry(F.lit("user"), F.col("value") / 2, F.col("user_id"))).alias("rankings"),
              F.from_json("props", "map<string,bigint>").alias("params")).write.json(path)
    return tb.report_rankings(tb.read_reports(spark, path, REPORT))


@register("rollup_refresh", f"""SELECT * FROM ({ohlcv_sql('hour', 'user_id > 20')})
WHERE NOT (ts >= '2024-01-10' AND ts < '2024-01-20') UNION ALL
SELECT * FROM ({ohlcv_sql('hour', "ts >= '2024-01-10' AND ts < '2024-01-20'")})""", OHLC)
def rollup_refresh(spark, d):
    ticks = src.event_ticks(spark, d)
    late = src.table(spark, d, "events").filter("user_id > 20").select("event_id")
    stored = rollup(ticks.join(late, F.col("seq") == late.event_id, "left_semi"), "1Hour")
    return tb.rollup_refresh(stored, ticks, "1Hour", "2024-01-10", "2024-01-20", rollup)


@register("rollup_realtime", ohlcv_sql("day"), OHLC)
def rollup_realtime(spark, d):
    ticks = src.event_ticks(spark, d)
    stored = rollup(ticks.filter("ts < '2024-01-20'"), "1Day")
    return tb.rollup_realtime(stored, ticks, "1Day", "2024-01-20", rollup)


@register("recent_signals", f"SELECT * FROM ({SIGNALS}) ORDER BY ts DESC, id DESC LIMIT 10",
          "strength")
def recent_signals(spark, d):
    return tb.recent(src.signals(spark, d), 10, ["id"])


@register("latest_metrics", f"""SELECT * FROM ({METRICS}) WHERE ts > TIMESTAMP '2024-01-29' - INTERVAL 600 MINUTE
  AND ts <= '2024-01-29' QUALIFY row_number() OVER (PARTITION BY metric_name ORDER BY ts DESC, id DESC) = 1""",
          "metric_value")
def latest_metrics(spark, d):
    return tb.latest_metrics(src.metrics(spark, d), "2024-01-29", 600)


@register("last_n", f"""SELECT * FROM ({METRICS})
QUALIFY row_number() OVER (PARTITION BY metric_name ORDER BY ts DESC, id DESC) <= 100""",
          "metric_value")
def last_n(spark, d):
    return tb.last_n(src.metrics(spark, d), 100, ["metric_name"], ["ts", "id"],
                     F.date_trunc("day", "ts"))


@register("dup_keys", """SELECT event_type AS symbol, date_trunc('hour', ts) AS ts, count(*) AS copies
FROM events GROUP BY 1, 2 HAVING count(*) > 1""")
def dup_keys(spark, d):
    ev = src.bars_intraday(spark, d).withColumn("ts", F.date_trunc("hour", "ts"))
    return tb.duplicate_keys(ev, ["symbol", "ts"])
