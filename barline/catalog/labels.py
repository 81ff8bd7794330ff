"""Labels, folds, walk-forward windows and alignment joins."""

from __future__ import annotations

from pyspark.sql import functions as F

from barline.catalog.base import BARS, NUMBERED, lag_sql, register
from barline.catalog.tables import POSITIONS, ohlcv_sql
from barline.operators import align, folds, labels
from barline.operators import indicators as ind
from barline.operators.quality import trading_calendar
from barline.plans.series import block_window, core_rows, in_blocks
from barline.sources import derived as src
from barline.sources.derived import bars_daily, bars_series

WITH = f"WITH {NUMBERED}\n"
P = "OVER (PARTITION BY symbol ORDER BY ts"
BINARY = f"""SELECT symbol, ts, close, CASE WHEN lead(close, 5) {P}) IS NULL THEN -1
  WHEN (lead(close, 5) {P}) - close) / close > 0.02e0 THEN 1 ELSE 0 END AS label FROM b"""


@register("binary_label", WITH + BINARY, "close")
def binary_label(spark, d):
    return labels.binary_label(bars_series(spark, d))


@register("label_filter", f"{WITH} SELECT * FROM ({BINARY}) WHERE label >= 0", "close")
def label_filter(spark, d):
    return labels.label_filter(labels.binary_label(bars_series(spark, d)))


@register("label_distribution", f"""{WITH}, c AS (SELECT symbol, label, count(*) AS rows
  FROM ({BINARY}) GROUP BY 1, 2)
SELECT symbol, label, rows, min(rows) OVER (PARTITION BY symbol) / max(rows) OVER (PARTITION BY symbol)
  AS balance, min(rows) OVER (PARTITION BY symbol) / max(rows) OVER (PARTITION BY symbol) < 0.3
  AS imbalanced FROM c""", "balance")
def label_distribution(spark, d):
    return labels.label_distribution(labels.binary_label(bars_series(spark, d)))


EXTREMA = f"""x AS (SELECT *, rn >= 5 AND rn < n - 5 AS inner_row,
  min(close) {P} ROWS BETWEEN 5 PRECEDING AND 5 FOLLOWING) AS lo,
  max(close) {P} ROWS BETWEEN 5 PRECEDING AND 5 FOLLOWING) AS hi,
  max(close) {P} ROWS BETWEEN CURRENT ROW AND 9 FOLLOWING) AS fmax,
  min(close) {P} ROWS BETWEEN CURRENT ROW AND 9 FOLLOWING) AS fmin FROM b),
y AS (SELECT *, inner_row AND close = lo AS is_min, inner_row AND close = hi AND close <> lo AS is_max
      FROM x)"""


@register("local_extrema", f"{WITH}, {EXTREMA} SELECT symbol, ts, close, is_min, is_max FROM y",
          "close")
def local_extrema(spark, d):
    return labels.local_extrema(bars_series(spark, d))


@register("npmm_label", f"""{WITH}, {EXTREMA} SELECT symbol, ts,
  CASE WHEN is_min AND (fmax - close) / close >= 0.02e0 THEN 1
       WHEN is_max AND (close - fmin) / close >= 0.02e0 THEN -1 ELSE 0 END AS npmm_label FROM y""")
def npmm_label(spark, d):
    return labels.npmm_label(bars_series(spark, d))


@register("triple_barrier", f"""{WITH}, p AS (
  SELECT e.symbol, e.rn, l.rn AS pos, (l.close - e.close) / e.close AS ret
  FROM b e JOIN b l ON l.symbol = e.symbol AND l.rn > e.rn),
h AS (SELECT symbol, rn, arg_min(CASE WHEN ret >= 0.02e0 THEN 1 WHEN ret <= -0.01e0 THEN -1 ELSE 0 END, pos)
        AS label FROM p WHERE ret >= 0.02e0 OR ret <= -0.01e0 OR abs(ret) < 0.005e0 GROUP BY 1, 2)
SELECT symbol, ts, CAST(coalesce(label, 0) AS INTEGER) AS label FROM b LEFT JOIN h USING (symbol, rn)""")
def triple_barrier(spark, d):
    return labels.triple_barrier(spark, bars_series(spark, d))


@register("forward_returns", f"""{WITH} SELECT symbol, ts, horizon, forward_return FROM (""" + " UNION ALL ".join(
    f"SELECT symbol, ts, {h} AS horizon, (lead(close, {h}) {P}) - close) / close AS forward_return FROM b"
    for h in (1, 5, 20)) + ") WHERE forward_return IS NOT NULL", "forward_return")
def forward_returns(spark, d):
    return labels.forward_returns(bars_series(spark, d))


# ---- folds -----------------------------------------------------------------------------------

FOLD = "CAST(least(rn // greatest(n // 5, 1), 4) AS INTEGER)"


@register("simple_kfold", f"{WITH} SELECT symbol, ts, {FOLD} AS fold FROM b")
def simple_kfold(spark, d):
    return folds.simple_kfold(bars_series(spark, d))


@register("fold_membership", f"""{WITH} SELECT symbol, ts, CAST(f AS INTEGER) AS fold, {FOLD} = f AS is_test
FROM b, range(5) t(f)""")
def fold_membership(spark, d):
    return folds.fold_membership(bars_series(spark, d))


def _with_t1(spark, d):
    df = in_blocks(bars_series(spark, d), after=5)
    df = df.withColumn("t1", F.coalesce(F.lead("ts", 5).over(block_window()), "ts"))
    return core_rows(df, drop_rn=False)


PURGED = f"""{WITH}, t AS (SELECT *, coalesce(lead(ts, 5) {P}), ts) AS t1 FROM b),
f AS (SELECT t.*, CAST(k AS INTEGER) AS fold, rn >= k * n // 5 AND rn < (k + 1) * n // 5 AS is_test,
   rn >= k * n // 5 - CAST(floor(n * 0.01e0) AS BIGINT)
   AND rn < (k + 1) * n // 5 + CAST(floor(n * 0.01e0) AS BIGINT) AS near FROM t, range(5) r(k)),
s AS (SELECT symbol, fold, min(ts) AS s0, min(t1) AS lo, max(t1) AS hi FROM f WHERE is_test GROUP BY 1, 2)
"""


@register("purged_kfold", PURGED + """SELECT symbol, ts, fold, is_test,
  NOT (t1 >= lo AND t1 <= hi) AND NOT near AND NOT is_test AS is_train
FROM f JOIN s USING (symbol, fold)""")
def purged_kfold(spark, d):
    return folds.purged_kfold(_with_t1(spark, d))


@register("purged_kfold_intervals", PURGED + """SELECT symbol, ts, fold, is_test,
  NOT (t1 >= s0 AND ts <= hi) AND NOT near AND NOT is_test AS is_train
FROM f JOIN s USING (symbol, fold)""")
def purged_kfold_intervals(spark, d):
    return folds.purged_kfold(_with_t1(spark, d), t0="ts")


@register("cpcv_splits", f"""{WITH},
m AS (SELECT mask FROM range(1024) t(mask) WHERE bit_count(mask) = 5),
p AS (SELECT symbol, least(rn // greatest(n // 10, 1), 9) AS part, count(*) AS rows FROM b GROUP BY 1, 2)
SELECT symbol, mask, CAST(sum(CASE WHEN (mask >> part) & 1 = 1 THEN rows ELSE 0 END) AS BIGINT) AS train_rows,
  CAST(sum(CASE WHEN (mask >> part) & 1 = 1 THEN 0 ELSE rows END) AS BIGINT) AS test_rows
FROM p, m GROUP BY 1, 2""")
def cpcv_splits(spark, d):
    return folds.cpcv_splits(spark, bars_series(spark, d))


WINDOWS = """w AS (SELECT symbol, CAST((s - 504) // 63 AS INTEGER) AS window_id, s - 504 AS is_start,
  s AS is_end, s + {gap} AS oos_start, s + {gap} + 126 AS oos_end
  FROM (SELECT symbol, unnest(range(504, max(n) - {gap} - 126 - 1 + 1, 63)) AS s FROM b GROUP BY symbol))"""


@register("walk_forward", f"{WITH}, {WINDOWS.format(gap=5)} SELECT * FROM w")
def walk_forward(spark, d):
    return folds.walk_forward(bars_series(spark, d), gap=5)


MEMBERS = """members AS (SELECT b.symbol, ts, rn, close, CAST(window_id AS BIGINT) AS window_id,
  CASE WHEN rn < is_end THEN 'IS' ELSE 'OOS' END AS role FROM b JOIN w ON w.symbol = b.symbol
  AND ((rn >= is_start AND rn < is_end) OR (rn >= oos_start AND rn < oos_end)))"""


@register("window_membership", f"""{WITH}, {WINDOWS.format(gap=5)}, {MEMBERS}
SELECT symbol, ts, rn, window_id, role FROM members""")
def window_membership(spark, d):
    return folds.window_membership(bars_series(spark, d), gap=5)


@register("concat_oos", f"""{WITH}, {WINDOWS.format(gap=0)}, {MEMBERS}
SELECT symbol, ts, rn, close, window_id FROM members WHERE role = 'OOS'""", "close")
def concat_oos(spark, d):
    return folds.concat_oos(folds.window_membership(bars_series(spark, d), "close"))


@register("time_series_split", f"""{WITH}, c AS (SELECT symbol, max(n) AS n FROM b GROUP BY 1)
SELECT symbol, CAST(f AS INTEGER) AS fold, greatest(n - (5 - f) * (n // 6) - 3 - 400, 0) AS train_start,
  n - (5 - f) * (n // 6) - 3 AS train_end, n - (5 - f) * (n // 6) AS test_start,
  n - (5 - f) * (n // 6) + n // 6 AS test_end FROM c, range(5) t(f)""")
def time_series_split(spark, d):
    return folds.time_series_split(bars_series(spark, d), gap=3, max_train=400)


@register("time_split", f"{WITH} SELECT symbol, ts, rn < floor(n * 0.8e0) AS is_train FROM b")
def time_split(spark, d):
    return folds.time_split(bars_series(spark, d))


# ---- alignment -------------------------------------------------------------------------------

@register("align_signals", f"""{WITH} SELECT symbol, ts, close,
  CASE WHEN volume > 100 THEN (volume - 100) / 100e0 ELSE 0 END AS sentiment,
  CASE WHEN open > close THEN 5e-1 ELSE 0 END AS fundamental FROM b""", "close sentiment fundamental")
def align_signals(spark, d):
    bars = bars_daily(spark, d)
    sent = bars.filter("volume > 100").select("symbol", "ts", ((F.col("volume") - 100) / 100).alias("s"))
    fund = bars.filter("open > close").select("symbol", "ts", F.lit(0.5).alias("f"))
    return align.align_signals(bars.select("symbol", "ts", "close"), sentiment=sent, fundamental=fund)


@register("asof_sentiment", f"""WITH h AS ({ohlcv_sql('hour')}),
s AS (SELECT event_type AS symbol, ts, event_id, (value - 25) / 25 AS score FROM events WHERE value > 20)
SELECT h.symbol, h.ts, h.close, arg_max(s.score, row(s.ts, s.event_id)) AS score
FROM h LEFT JOIN s ON s.symbol = h.symbol AND s.ts <= h.ts GROUP BY 1, 2, 3""", "close score")
def asof_sentiment(spark, d):
    hours = src.ohlcv(spark, d, "1Hour").select("symbol", "ts", "close")
    scores = src.table(spark, d, "events").filter("value > 20").select(
        F.col("event_type").alias("symbol"), "ts", "event_id",
        ((F.col("value") - 25) / 25).alias("score"))
    return align.asof_join(hours, scores, "score", tie=["event_id"])


def predictions(spark, d):
    """Scores from the 60-row z-score of the 5-row return, with horizon 5."""
    df = in_blocks(bars_series(spark, d), 70)
    df = df.withColumn("ret5", F.coalesce(ind.change(5), F.lit(0.0)))
    df = df.withColumn("z", ind.zscore_col("ret5", 60))
    score = F.greatest(F.least(F.col("z"), F.lit(3.0)), F.lit(-3.0)) / 3
    return core_rows(df.withColumn("score", score)).select(
        F.col("symbol").alias("signal"), F.lit(5).alias("horizon"), "ts", "score")


def actuals(spark, d):
    r = labels.forward_returns(bars_series(spark, d), (5,))
    return r.select(F.col("symbol").alias("signal"), "horizon", "ts",
                    F.col("forward_return").alias("actual"))


W60 = f"{P} ROWS BETWEEN 59 PRECEDING AND CURRENT ROW)"
PREDICTIONS = f"""r5 AS (SELECT *, coalesce(close / {lag_sql('close', 5)} - 1, 0e0) AS ret5,
   (lead(close, 5) {P}) - close) / close AS actual FROM b),
pred AS (SELECT symbol, symbol AS signal, 5 AS horizon, ts, rn, n, actual,
  least(greatest(coalesce(CASE WHEN count(ret5) {W60} = 60 AND min(ret5) {W60} < max(ret5) {W60}
   THEN (ret5 - avg(ret5) {W60}) / stddev_samp(ret5) {W60} END, 0e0), -3e0), 3e0) / 3 AS score FROM r5)"""


@register("prediction_actual", f"""{WITH}, {PREDICTIONS}
SELECT signal, horizon, ts, score, actual FROM pred WHERE actual IS NOT NULL""", "score actual")
def prediction_actual(spark, d):
    return align.prediction_actual(predictions(spark, d), actuals(spark, d))


SYMBOLS = ["A-F", "A-O", "N-F", "N-O", "R-F", "R-O"]


@register("align_predictions", f"""{WITH}, {PREDICTIONS}, v AS (SELECT ts, """ + ", ".join(
    f"max(CASE WHEN symbol = '{s}' THEN score END) AS \"{s}\"" for s in SYMBOLS)
    + " FROM pred GROUP BY 1) SELECT * FROM v WHERE "
    + " AND ".join(f'"{s}" IS NOT NULL' for s in SYMBOLS),
    " ".join(f'"{s}"' for s in SYMBOLS))
def align_predictions(spark, d):
    p = predictions(spark, d).withColumnRenamed("signal", "symbol")
    return align.align_predictions(p, SYMBOLS)


@register("target_vs_current", f"""WITH t AS (SELECT DISTINCT event_type AS symbol, 0.2e0 AS weight FROM events
   UNION ALL SELECT DISTINCT o_orderpriority, 0.1e0 FROM orders),
c AS (SELECT symbol, CAST(sum(quantity) AS BIGINT) AS current, arg_max(current_price, id) AS price
      FROM ({POSITIONS}) WHERE status = 'OPEN' GROUP BY 1)
SELECT symbol, weight, coalesce(current, 0) AS current, coalesce(price, 0) AS price
FROM t LEFT JOIN c USING (symbol)""", "weight price")
def target_vs_current(spark, d):
    held = src.positions(spark, d).filter("status = 'OPEN'")
    targets = (src.table(spark, d, "events").select(F.col("event_type").alias("symbol")).distinct()
               .withColumn("weight", F.lit(0.2))
               .unionByName(src.table(spark, d, "orders")
                            .select(F.col("o_orderpriority").alias("symbol")).distinct()
                            .withColumn("weight", F.lit(0.1))))
    price = held.groupBy("symbol").agg(F.max_by("current_price", "id").alias("price"))
    return align.target_vs_current(targets, held, price)


@register("pairwise_symbols", f"""{WITH}, r AS (SELECT symbol, ts, coalesce(close / {lag_sql('close', 1)} - 1, 0e0)
  AS ret FROM b)
SELECT p.ts, p.symbol AS a, p.ret AS x, q.symbol AS b, q.ret AS y FROM r p JOIN r q
ON p.ts = q.ts AND p.symbol < q.symbol""", "x y")
def pairwise_symbols(spark, d):
    r = ind.returns(bars_series(spark, d), 1).withColumnRenamed("return_1d", "ret")
    return align.pairwise_symbols(r)


CALENDAR = """cal AS (SELECT symbol, CAST(d AS DATE) AS day FROM (SELECT symbol,
    unnest(generate_series(CAST(min(ts) AS DATE), CAST(max(ts) AS DATE), INTERVAL 1 DAY)) AS d
    FROM bars GROUP BY 1)
  WHERE isodow(d) <= 5 AND strftime(d, '%m-%d') NOT IN ('01-01', '07-04', '12-25', '12-31'))"""


@register("expected_days_anti", f"""WITH {BARS}, {CALENDAR} SELECT symbol, day FROM cal
ANTI JOIN (SELECT symbol, CAST(ts AS DATE) AS day FROM bars) USING (symbol, day)""")
def expected_days_anti(spark, d):
    bars = bars_daily(spark, d)
    return align.expected_days_anti(bars, trading_calendar(bars))
