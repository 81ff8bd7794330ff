"""Data quality and readiness."""

from __future__ import annotations

from pyspark.sql import functions as F

from barline.catalog.base import BARS, NUMBERED, register
from barline.catalog.labels import CALENDAR
from barline.catalog.features import ALL_INDICATORS
from barline.catalog.tables import ohlcv_sql
from barline.operators import features as feat
from barline.operators import quality as q
from barline.sources import derived as src
from barline.sources.derived import bars_daily, bars_series

WITH = f"WITH {BARS}\n"
NWITH = f"WITH {NUMBERED}\n"

# bars with some broken rows: prices shifted below zero, volume lowered, some keys repeated
DIRTY = f"""{WITH}, dirty AS (SELECT symbol, ts, open - 60 AS open, high, low - 55 AS low, close, volume - 20 AS volume
  FROM bars UNION ALL SELECT symbol, ts, open, low - 1, low, close, volume FROM bars WHERE volume > 300)"""


def _dirty(spark, d):
    bars = bars_daily(spark, d)
    a = (bars.withColumn("open", F.col("open") - 60).withColumn("low", F.col("low") - 55)
         .withColumn("volume", F.col("volume") - 20))
    return a.unionByName(bars.filter("volume > 300").withColumn("high", F.col("low") - 1))


def _rule(name, cond):
    sev = "warning" if "outside" in name else "error"
    return (f"SELECT '{name}' AS rule, '{sev}' AS severity, count(*) AS violations FROM dirty WHERE {cond}")


RULES = {**{f"negative_{c}": f"{c} < 0" for c in ("open", "high", "low", "close", "volume")},
         "high_below_low": "high < low", "open_outside_range": "open < low OR open > high",
         "close_outside_range": "close < low OR close > high"}


@register("validate_bars", DIRTY + " UNION ALL ".join(_rule(n, c) for n, c in RULES.items()) + """
UNION ALL SELECT 'duplicate_key', 'warning', CAST(coalesce(sum(c), 0) AS BIGINT) FROM (SELECT count(*) AS c FROM dirty
GROUP BY symbol, ts HAVING count(*) > 1)""")
def validate_bars(spark, d):
    return q.validate_bars(_dirty(spark, d))


@register("quarantine_bars", f"""{DIRTY} SELECT symbol, ts, open, high, low, close, volume, concat_ws(',', """ + ", ".join(
    f"CASE WHEN {c} THEN '{n}' END" for n, c in RULES.items() if "outside" not in n)
    + ") AS errors FROM dirty", "open high low close")
def quarantine_bars(spark, d):
    return q.split_valid(_dirty(spark, d)).withColumn("errors", F.concat_ws(",", "errors"))


RAW_KEYS = """SELECT event_id, CASE event_id % 5 WHEN 0 THEN ' ' || event_type || ' ' WHEN 1 THEN 'AB' || user_id
    WHEN 2 THEN '  ' WHEN 3 THEN event_type || '.' || upper(event_type) ELSE left(event_type, 4) || '.n' END AS symbol,
  CASE event_id % 6 WHEN 0 THEN strftime(ts, '%Y-%m-%d %H:%M:%S') WHEN 1 THEN strftime(ts, '%Y-%m-%dT%H:%M:%S')
    WHEN 2 THEN strftime(ts, '%Y-%m-%d') WHEN 3 THEN CAST(CAST(floor(epoch(ts)) AS BIGINT) AS VARCHAR)
    WHEN 4 THEN 'invalid-date' END AS ts FROM events"""


@register("clean_keys", f"""WITH r AS ({RAW_KEYS}), c AS (SELECT event_id, upper(trim(symbol)) AS clean_symbol,
  CASE WHEN regexp_full_match(ts, '\\d+') THEN make_timestamp(CAST(ts AS BIGINT) * 1000000)
    ELSE try_cast(ts AS TIMESTAMP) END AS clean_ts FROM r)
SELECT *, CASE WHEN clean_symbol = '' THEN 'empty symbol' WHEN length(clean_symbol) > 10 THEN 'symbol too long'
  WHEN NOT regexp_full_match(clean_symbol, '[A-Z]{{1,5}}(\\.[A-Z]+)?') THEN 'bad symbol'
  WHEN clean_ts IS NULL THEN 'bad timestamp' END AS reason FROM c""")
def clean_keys(spark, d):
    ev = src.table(spark, d, "events")
    k, t = F.col("event_id"), F.col("event_type")
    raw = ev.select(
        "event_id",
        F.when(k % 5 == 0, F.concat(F.lit(" "), t, F.lit(" ")))
        .when(k % 5 == 1, F.concat(F.lit("AB"), F.col("user_id").cast("string")))
        .when(k % 5 == 2, "  ").when(k % 5 == 3, F.concat(t, F.lit("."), F.upper(t)))
        .otherwise(F.concat(F.substring(t, 1, 4), F.lit(".n"))).alias("symbol"),
        F.when(k % 6 == 0, F.date_format("ts", "yyyy-MM-dd HH:mm:ss"))
        .when(k % 6 == 1, F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss"))
        .when(k % 6 == 2, F.date_format("ts", "yyyy-MM-dd"))
        .when(k % 6 == 3, F.unix_seconds("ts").cast("string"))
        .when(k % 6 == 4, "invalid-date").alias("ts"))
    return q.clean_keys(raw).select("event_id", "clean_symbol", "clean_ts", "reason")


@register("trading_calendar", f"{WITH}, {CALENDAR} SELECT symbol, day FROM cal")
def trading_calendar(spark, d):
    return q.trading_calendar(bars_daily(spark, d))


GAPS = """g AS (SELECT *, lag(ts) OVER (PARTITION BY symbol ORDER BY ts) AS prev_ts FROM bars),
g2 AS (SELECT *, (epoch_us(ts) - epoch_us(prev_ts)) / 86400e6 AS gap_days FROM g)"""


@register("gap_analysis", f"""{WITH}, {GAPS}, {CALENDAR}, s AS (SELECT symbol, count(*) AS actual,
  avg(gap_days) AS avg_gap, quantile_cont(gap_days, 0.5) AS median_gap, max(gap_days) AS max_gap,
  count(CASE WHEN gap_days > 3 THEN 1 END) AS large_gaps FROM g2 GROUP BY 1),
x AS (SELECT symbol, count(*) AS expected FROM cal GROUP BY 1)
SELECT *, expected - actual AS missing, actual / expected * 100 AS coverage_pct FROM s JOIN x USING (symbol)""",
          "avg_gap median_gap max_gap coverage_pct")
def gap_analysis(spark, d):
    return q.gap_analysis(bars_series(spark, d))



@register("large_gaps", f"""{WITH}, l AS (SELECT * FROM bars WHERE volume > 150), g AS (SELECT symbol, ts,
   lag(ts) OVER (PARTITION BY symbol ORDER BY ts) AS prev_ts FROM l)
SELECT symbol, prev_ts AS gap_start, ts AS gap_end, date_diff('day', prev_ts, ts) AS calendar_days,
  CAST((SELECT count(*) FROM range(1, date_diff('day', prev_ts, ts)) r(k)
   WHERE isodow(CAST(prev_ts AS DATE) + CAST(k AS INTEGER)) <= 5 AND strftime(CAST(prev_ts AS DATE) + CAST(k AS INTEGER), '%m-%d')
     NOT IN ('01-01', '07-04', '12-25', '12-31')) AS INTEGER) AS expected_trading_days
FROM g WHERE date_diff('day', prev_ts, ts) > 3""")
def large_gaps(spark, d):
    return q.large_gaps(bars_daily(spark, d).filter("volume > 150"))


@register("quality_profile", f"""{WITH}, d AS (SELECT symbol, ts, open, high, low,
  CASE WHEN volume > 20 THEN close END AS close, volume - 20 AS volume FROM bars),
c AS (SELECT *, abs(close / nullif(lag(close) OVER w, 0) - 1) AS chg, date_diff('day', lag(ts) OVER w, ts) AS gap
      FROM d WINDOW w AS (PARTITION BY symbol ORDER BY ts))
SELECT symbol, count(*) AS rows, """ + ", ".join(
    f"count(*) - count({c}) AS null_{c}" for c in ("open", "high", "low", "close", "volume")) + """,
  (count(*) - count(close)) * 100 / count(*) AS null_close_pct,
  count(CASE WHEN close <= 0 THEN 1 END) AS zero_prices, count(CASE WHEN chg > 0.5e0 THEN 1 END) AS extreme_changes,
  max(chg) AS max_change, count(CASE WHEN volume = 0 THEN 1 END) AS zero_volume,
  count(CASE WHEN gap > 2 THEN 1 END) AS large_gaps FROM c GROUP BY 1""", "null_close_pct max_change")
def quality_profile(spark, d):
    bars = bars_series(spark, d)
    dirty = (bars.withColumn("close", F.when(F.col("volume") > 20, F.col("close")))
             .withColumn("volume", F.col("volume") - 20))
    return q.quality_profile(dirty)


NULL_FEATURES = ["sma_20", "sma_50", "sma_200", "atr", "natr", "kc_upper", "rsi"]


@register("feature_nulls", f"{ALL_INDICATORS} " + " UNION ALL ".join(
    f"SELECT '{c}' AS feature, count(*) - count({c}) AS nulls, (count(*) - count({c})) * 100 / count(*) AS null_pct FROM z"
    for c in NULL_FEATURES), "null_pct")
def feature_nulls(spark, d):
    return q.feature_nulls(feat.all_indicators(bars_series(spark, d)), NULL_FEATURES)


@register("readiness_flags", f"""WITH h AS ({ohlcv_sql('hour')})
SELECT symbol, count(*) AS rows, CAST(date_diff('day', min(ts), max(ts)) AS INTEGER) AS days,
  concat_ws('; ', CASE WHEN count(*) < 100 THEN 'insufficient rows' WHEN count(*) < 252 THEN 'limited rows' END,
  CASE WHEN count(*) < 1260 THEN 'below lookback' END,
  CASE WHEN date_diff('day', min(ts), max(ts)) < 365 THEN 'under 1 year'
       WHEN date_diff('day', min(ts), max(ts)) < 756 THEN 'under 3 years' END) AS flags
FROM h GROUP BY 1""")
def readiness_flags(spark, d):
    return q.readiness_flags(src.ohlcv(spark, d, "1Hour"))


MARKS = {"accuracy": 40, "precision": 45, "recall": 50, "f1_score": 47, "cv_mean": 42}
MODELS = "SELECT p_brand AS model, metric, value FROM (" + " UNION ALL ".join(
    f"SELECT p_brand, '{m}' AS metric, avg(p_size) / {k} AS value FROM part GROUP BY 1" for m, k in MARKS.items()
) + " UNION ALL SELECT p_brand, 'dsr', 0.75e0 + avg(p_size) / 140 FROM part GROUP BY 1)"


def model_metrics(spark, d):
    per = src.table(spark, d, "part").groupBy(F.col("p_brand").alias("model")).agg(
        *[(F.avg("p_size") / k).alias(m) for m, k in MARKS.items()],
        (F.avg("p_size") / 140 + 0.75).alias("dsr"))
    return per.unpivot(["model"], [*MARKS, "dsr"], "metric", "value")


ASSESSED = f"""m AS ({MODELS}), t(metric, p, w) AS (VALUES ('accuracy', 0.60e0, NULL), ('precision', 0.55e0, NULL),
 ('recall', 0.50e0, NULL), ('f1_score', 0.55e0, NULL), ('dsr', 0.95e0, 0.90e0), ('cv_mean', 0.60e0, NULL)),
s AS (SELECT model, metric, value, CASE WHEN value >= p THEN 'PASS' WHEN value >= w THEN 'WARNING' ELSE 'FAIL' END AS status
      FROM m JOIN t USING (metric)),
o AS (SELECT model, bool_and(status = 'PASS') AS ok, max(CASE WHEN metric = 'dsr' THEN value END) AS dsr FROM s GROUP BY 1),
a AS (SELECT s.*, CASE WHEN ok THEN 'READY' ELSE 'REVIEW' END AS overall,
  CASE WHEN ok AND dsr >= 0.95 THEN 'HIGH' WHEN dsr >= 0.9 THEN 'MEDIUM' ELSE 'LOW' END AS confidence
  FROM s JOIN o USING (model))"""


@register("threshold_assess", f"WITH {ASSESSED} SELECT * FROM a", "value")
def threshold_assess(spark, d):
    return q.threshold_assess(model_metrics(spark, d))


@register("model_scorecard", f"""WITH {ASSESSED} SELECT metric, avg(value) AS mean_value, min(value) AS min_value,
  max(value) AS max_value, count(*) AS models, count(CASE WHEN overall = 'READY' THEN 1 END) AS ready
FROM a GROUP BY 1""", "mean_value min_value max_value")
def model_scorecard(spark, d):
    return q.model_scorecard(q.threshold_assess(model_metrics(spark, d)))
