"""Backtest statistics, trade performance, information coefficients and drift."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from barline.catalog.base import NUMBERED, lag_sql, register
from barline.catalog.labels import PREDICTIONS, actuals, predictions
from barline.catalog.tables import METRICS, POSITIONS
from barline.functions import norm_cdf_sql, norm_ppf_sql
from barline.operators import align, indicators as ind, monitoring as mon, stats
from barline.operators.monitoring import ks_pvalue_sql
from barline.sources import derived as src
from barline.sources.derived import bars_series

WITH = f"WITH {NUMBERED}\n"
RET = f"""r AS (SELECT symbol, ts, rn, coalesce(close / {lag_sql('close', 1)} - 1, 0e0) AS ret FROM b)"""


def daily_returns(spark, d):
    return ind.returns(bars_series(spark, d), 1).withColumnRenamed("return_1d", "ret")


SHARPE = """CASE WHEN count(ret) >= 2 AND min(ret) < max(ret) THEN avg(ret) / stddev_samp(ret) * sqrt(252e0) ELSE 0e0 END"""


@register("sharpe", f"{WITH}, {RET} SELECT symbol, {SHARPE} AS sharpe, count(*) AS rows FROM r GROUP BY 1",
          "sharpe")
def sharpe(spark, d):
    return stats.sharpe(daily_returns(spark, d), ["symbol"])


MOM = f"""mu AS (SELECT symbol, avg(ret) AS m, stddev_samp(ret) AS sd, {SHARPE} AS sharpe, count(*) AS rows FROM r GROUP BY 1),
mo AS (SELECT r.symbol, any_value(sharpe) AS sharpe, any_value(rows) AS rows,
  avg(power(ret - m, 3)) / power(any_value(sd), 3) AS skew, avg(power(ret - m, 4)) / power(any_value(sd), 4) AS kurtosis
  FROM r JOIN mu USING (symbol) GROUP BY 1)"""


@register("return_moments", f"{WITH}, {RET}, {MOM} SELECT symbol, skew, kurtosis FROM mo", "skew kurtosis")
def return_moments(spark, d):
    return stats.return_moments(daily_returns(spark, d), ["symbol"])


def psr_sql(bench):
    return f"""pz AS (SELECT *, (sharpe - {bench}) / (sqrt((1 + (1 + 0.5e0 * skew * skew) * sharpe * sharpe / 252e0
  - skew * sharpe / sqrt(252e0) + (kurtosis - 3) / 4 * sharpe * sharpe / 252e0) / (rows - 1)) * sqrt(252e0)) AS z FROM mo)"""


@register("psr", f"{WITH}, {RET}, {MOM}, {psr_sql('0e0')} SELECT symbol, {norm_cdf_sql('z')} AS psr FROM pz", "psr")
def psr(spark, d):
    return stats.psr(daily_returns(spark, d), ["symbol"])


BEST = f"""tr AS (SELECT avg(sharpe) AS tm, stddev_pop(sharpe) AS tsd, 1 - 1e0 / count(*) AS p1,
  1 - 1e0 / (count(*) * {math.e!r}e0) AS p2 FROM mo),
bm AS (SELECT tm + tsd * ((1 - 0.5772156649e0) * {norm_ppf_sql('p1')} + 0.5772156649e0 * {norm_ppf_sql('p2')}) AS expected_max FROM tr)"""


@register("dsr", f"""{WITH}, {RET}, {MOM}, {BEST}, {psr_sql('(SELECT expected_max FROM bm)')}
SELECT symbol, sharpe, (SELECT expected_max FROM bm) AS expected_max, {norm_cdf_sql('z')} AS dsr FROM pz""",
          "sharpe expected_max dsr")
def dsr(spark, d):
    return stats.dsr(daily_returns(spark, d), ["symbol"])


@register("pbo", f"""{WITH}, {RET}, full_ts AS (SELECT ts FROM r GROUP BY ts HAVING count(*) = (SELECT count(DISTINCT symbol) FROM r)),
k AS (SELECT ts, row_number() OVER (ORDER BY ts) - 1 AS t, count(*) OVER () AS n FROM full_ts),
m AS (SELECT symbol AS trial, least(t // greatest(n // 16, 1), 15) AS seg, count(*) AS c, sum(ret) AS s, sum(ret * ret) AS q
      FROM r JOIN k USING (ts) WHERE n >= 16 GROUP BY 1, 2),
masks AS (SELECT mask FROM range(65536) x(mask) WHERE bit_count(mask) = 8),
sides AS (SELECT mask, trial, (mask >> seg) & 1 AS side, sum(c) AS c, sum(s) AS s, sum(q) AS q FROM m, masks GROUP BY 1, 2, 3),
sr AS (SELECT mask, trial, max(CASE WHEN side = 1 THEN (s / c) / sqrt((q - s * s / c) / (c - 1)) END) AS a,
   max(CASE WHEN side = 0 THEN (s / c) / sqrt((q - s * s / c) / (c - 1)) END) AS z FROM sides GROUP BY 1, 2),
bt AS (SELECT mask, arg_max(z, a) AS best FROM sr GROUP BY 1),
rk AS (SELECT mask, count(CASE WHEN z < best THEN 1 END) / count(*) AS rank FROM sr JOIN bt USING (mask) GROUP BY 1)
SELECT coalesce(avg(CASE WHEN rank < 0.5 THEN 1e0 ELSE 0e0 END), 0e0) AS pbo, count(*) AS splits FROM rk""", "pbo")
def pbo(spark, d):
    r = daily_returns(spark, d)
    names = r.select("symbol").distinct().count()
    common = r.groupBy("ts").agg(F.count(F.lit(1)).alias("k")).filter(F.col("k") == names)
    trials = r.join(common, "ts", "left_semi").withColumnRenamed("symbol", "trial")
    return stats.pbo(spark, trials)


TRADES = """tr AS (SELECT o_orderkey AS id, o_orderpriority AS symbol, o_orderdate AS ts,
  o_totalprice - avg(o_totalprice) OVER (PARTITION BY o_orderpriority) AS pnl FROM orders)"""
RUNW = "OVER (PARTITION BY symbol ORDER BY ts, id ROWS UNBOUNDED PRECEDING)"
EQUITY = f"""{TRADES}, eq0 AS (SELECT *, 100000 + sum(pnl / 1000) {RUNW} AS equity FROM tr),
eq1 AS (SELECT *, greatest(max(equity) {RUNW}, 100000) AS peak FROM eq0),
eq AS (SELECT *, (peak - equity) / peak AS drawdown FROM eq1)"""


@register("performance_stats", f"""WITH {EQUITY} SELECT symbol, count(*) AS trades,
  count(CASE WHEN pnl > 0 THEN 1 END) * 100 / count(*) AS win_rate, avg(CASE WHEN pnl > 0 THEN pnl END) AS avg_win,
  avg(CASE WHEN pnl < 0 THEN pnl END) AS avg_loss,
  abs(sum(CASE WHEN pnl > 0 THEN pnl END) / sum(CASE WHEN pnl < 0 THEN pnl END)) AS profit_factor,
  avg(pnl) AS mean_trade, greatest(max(drawdown), 0) * 100 AS max_drawdown
FROM eq WHERE pnl <> 0 GROUP BY 1""", "win_rate avg_win avg_loss profit_factor mean_trade max_drawdown", digits=4)
def performance_stats(spark, d):
    return stats.performance_stats(src.trades_closed(spark, d), scale=1000.0)


@register("running_drawdown", f"""WITH {EQUITY} SELECT symbol, id, equity, peak, drawdown, drawdown >= 0.1e0 AS halted FROM eq""",
          "equity peak drawdown", digits=4)
def running_drawdown(spark, d):
    eq = stats.equity_curve(src.trades_closed(spark, d), scale=1000.0)
    return eq.select("symbol", "id", "equity", "peak", "drawdown", (F.col("drawdown") >= 0.1).alias("halted"))


@register("pnl_histogram", f"""WITH {TRADES}, s AS (SELECT *, min(pnl) OVER w AS lo, max(pnl) OVER w AS hi FROM tr
  WINDOW w AS (PARTITION BY symbol))
SELECT symbol, CAST(least(floor((pnl - lo) / ((hi - lo) / 30)), 29) AS INTEGER) AS bin, count(*) AS rows FROM s GROUP BY 1, 2""")
def pnl_histogram(spark, d):
    return stats.histogram(src.trades_closed(spark, d), "pnl")


@register("portfolio_summary", f"""WITH p AS (SELECT symbol, count(*) AS positions,
  sum(CASE WHEN position_type = 'SHORT' THEN -1 ELSE 1 END * (current_price - entry_price) * quantity) AS unrealised_pnl,
  sum(current_price * quantity) AS value FROM ({POSITIONS}) WHERE status = 'OPEN' GROUP BY 1)
SELECT *, value / sum(value) OVER () * 100 AS weight_pct, 1e9 - sum(value) OVER () AS cash FROM p""",
          "unrealised_pnl value weight_pct cash", digits=2)
def portfolio_summary(spark, d):
    return stats.portfolio_summary(src.positions(spark, d), 1e9)


def class_predictions(spark, d):
    docs, labels = src.table(spark, d, "documents"), src.table(spark, d, "labels")
    mid = docs.agg(F.expr("percentile(n_chars, 0.5)").alias("_mid"))  # one row
    return (labels.join(docs, "doc_id").join(F.broadcast(mid))
            .select("source", F.col("quality").alias("actual"),
                    (F.col("n_chars") > F.col("_mid")).cast("int").alias("predicted")))


CLASSES = """cl AS (SELECT source, quality AS actual, CASE WHEN n_chars > (SELECT quantile_cont(n_chars, 0.5) FROM documents)
  THEN 1 ELSE 0 END AS predicted FROM labels JOIN documents USING (doc_id))"""


@register("confusion_metrics", f"""WITH {CLASSES}, c AS (SELECT source, count(*) AS rows,
  count(CASE WHEN actual = 1 THEN 1 END) AS buy, count(CASE WHEN actual = 0 THEN 1 END) AS sell,
  count(CASE WHEN actual = predicted THEN 1 END) AS ok, count(CASE WHEN predicted = 1 AND actual = 1 THEN 1 END) AS tp,
  count(CASE WHEN predicted = 1 AND actual = 0 THEN 1 END) AS fp, count(CASE WHEN predicted = 0 AND actual = 1 THEN 1 END) AS fn
  FROM cl GROUP BY 1), p AS (SELECT *, coalesce(tp / nullif(tp + fp, 0), 0) AS precision, coalesce(tp / nullif(tp + fn, 0), 0) AS recall FROM c)
SELECT source, rows, buy, sell, ok / rows AS accuracy, precision, recall,
  coalesce(2 * precision * recall / nullif(precision + recall, 0), 0) AS f1_score FROM p""", "accuracy precision recall f1_score")
def confusion_metrics(spark, d):
    return stats.confusion_metrics(class_predictions(spark, d), ["source"])


def matched(spark, d):
    return align.prediction_actual(predictions(spark, d), actuals(spark, d))


MATCHED = f"""{PREDICTIONS}, mt AS (SELECT signal, horizon, ts, score, actual,
  row_number() OVER (PARTITION BY signal ORDER BY ts) - 1 AS i, count(*) OVER (PARTITION BY signal) AS k
  FROM pred WHERE actual IS NOT NULL)"""


@register("horizon_metrics", f"""{WITH}, {MATCHED} SELECT horizon, avg((score - actual) * (score - actual)) AS mse,
  avg(abs(score - actual)) AS mae, sqrt(avg((score - actual) * (score - actual))) AS rmse,
  covar_samp(score, actual) / (stddev_samp(score) * stddev_samp(actual)) AS ic FROM mt GROUP BY 1""", "mse mae rmse ic")
def horizon_metrics(spark, d):
    return stats.horizon_metrics(matched(spark, d), ["horizon"])


@register("forecast_ic", f"""{WITH}, {MATCHED} SELECT signal, horizon,
  covar_samp(score, actual) / (stddev_samp(score) * stddev_samp(actual)) AS ic, count(*) AS rows
  FROM mt WHERE i >= k - 100 GROUP BY 1, 2""", "ic")
def forecast_ic(spark, d):
    return mon.forecast_ic(matched(spark, d), 100)


F20 = "OVER (PARTITION BY signal ORDER BY ts ROWS BETWEEN 19 PRECEDING AND CURRENT ROW)"
ROLLING = f"""{MATCHED}, rl AS (SELECT signal, horizon, ts, i AS rn, coalesce(CASE WHEN min(score) {F20} < max(score) {F20}
  AND min(actual) {F20} < max(actual) {F20} THEN covar_samp(score, actual) {F20}
  / (stddev_samp(score) {F20} * stddev_samp(actual) {F20}) END, 0) AS ic FROM mt QUALIFY i >= 19)"""


@register("rolling_ic", f"{WITH}, {ROLLING} SELECT signal, horizon, ts, rn, ic FROM rl", "ic")
def rolling_ic(spark, d):
    return mon.rolling_ic(matched(spark, d))


@register("ic_stats", f"""{WITH}, {ROLLING} SELECT signal, horizon, avg(ic) AS mean_ic, stddev_pop(ic) AS std_ic,
  avg(CASE WHEN ic > 0 THEN 1e0 ELSE 0e0 END) AS positive_share, avg(ic) / stddev_pop(ic) AS ic_ir, avg(ic) < 0.05 AS alert
FROM rl GROUP BY 1, 2""", "mean_ic std_ic positive_share ic_ir")
def ic_stats(spark, d):
    return mon.ic_stats(mon.rolling_ic(matched(spark, d)))


@register("ic_half_life", f"""{WITH}, {ROLLING}, l AS (SELECT *, lag(ic) OVER (PARTITION BY signal ORDER BY ts) AS prev FROM rl),
c AS (SELECT signal, horizon, covar_samp(prev, ic) / (stddev_samp(CASE WHEN prev IS NOT NULL THEN ic END) * stddev_samp(prev)) AS r FROM l GROUP BY 1, 2)
SELECT signal, horizon, r AS autocorrelation, CASE WHEN r > 0 THEN -ln(2) / ln(r) END AS half_life FROM c""",
          "autocorrelation half_life")
def ic_half_life(spark, d):
    return mon.ic_half_life(mon.rolling_ic(matched(spark, d)))


@register("ic_decay", f"{WITH}, {ROLLING} SELECT signal, horizon, regr_slope(ic, rn) * 252 AS decay_rate FROM rl GROUP BY 1, 2",
          "decay_rate")
def ic_decay(spark, d):
    return mon.ic_decay(mon.rolling_ic(matched(spark, d)))


# ---- drift -----------------------------------------------------------------------------------

def drift_samples(spark, d):
    ev = src.table(spark, d, "events").select(F.col("event_type").alias("feature"), "value", "ts")
    return (ev.filter("ts < '2024-01-16'").drop("ts"),
            ev.filter("ts >= '2024-01-16'").withColumn("value", F.col("value") * 1.05).drop("ts"))


SAMPLES = """ref AS (SELECT event_type AS feature, value FROM events WHERE ts < '2024-01-16'),
cur AS (SELECT event_type AS feature, value * 1.05e0 AS value FROM events WHERE ts >= '2024-01-16')"""
PSI = """sp AS (SELECT feature, min(value) AS lo, max(value) AS hi, count(*) AS nr FROM ref GROUP BY 1),
bothp AS (SELECT feature, value, 1 AS r, 0 AS c FROM ref UNION ALL SELECT feature, value, 0, 1 FROM cur),
bn AS (SELECT feature, CASE WHEN value BETWEEN lo AND hi THEN least(floor((value - lo) / ((hi - lo) / 10)), 9) END AS bin,
   sum(r) AS r, sum(c) AS c, any_value(nr) AS nr FROM bothp JOIN sp USING (feature) GROUP BY 1, 2),
sh AS (SELECT feature, bin, CASE WHEN r = 0 THEN 1e-6 ELSE r / nr END AS pr,
   CASE WHEN c = 0 THEN 1e-6 ELSE c / sum(c) OVER (PARTITION BY feature) END AS pc FROM bn),
psi AS (SELECT feature, sum((pc - pr) * ln(pc / pr)) AS psi FROM sh WHERE bin IS NOT NULL GROUP BY 1)"""
KS = f"""kv AS (SELECT feature, value, sum(r) AS r, sum(c) AS c FROM (SELECT feature, value, 1 AS r, 0 AS c FROM ref
   UNION ALL SELECT feature, value, 0, 1 FROM cur) GROUP BY 1, 2),
kr AS (SELECT feature, abs(sum(r) OVER o / sum(r) OVER p - sum(c) OVER o / sum(c) OVER p) AS gap, sum(r) OVER p AS nr, sum(c) OVER p AS nc
   FROM kv WINDOW o AS (PARTITION BY feature ORDER BY value), p AS (PARTITION BY feature)),
kd AS (SELECT feature, max(gap) AS ks_statistic, sqrt(any_value(nr) * any_value(nc) / (any_value(nr) + any_value(nc))) * max(gap) AS lam
   FROM kr GROUP BY 1),
ks AS (SELECT feature, ks_statistic, {ks_pvalue_sql('lam')} AS p_value FROM kd)"""


@register("psi", f"WITH {SAMPLES}, {PSI} SELECT * FROM psi", "psi")
def psi(spark, d):
    return mon.psi(*drift_samples(spark, d))


@register("ks_test", f"WITH {SAMPLES}, {KS} SELECT * FROM ks", "ks_statistic p_value")
def ks_test(spark, d):
    return mon.ks_test(spark, *drift_samples(spark, d))


DATA_DRIFT = f"""{PSI}, {KS}, ag AS (SELECT max(psi) AS psi, min(p_value) AS p_value, max(ks_statistic) AS ks_statistic,
  coalesce(string_agg(CASE WHEN psi > 0.2 OR p_value < 0.05 THEN feature END, ',' ORDER BY feature), '') AS drifted_features
  FROM psi JOIN ks USING (feature)),
dd AS (SELECT 'data' AS drift_type, drifted_features <> '' AS drift_detected, CASE WHEN drifted_features = '' THEN 'low'
  WHEN psi > 0.5 OR p_value < 0.01 THEN 'high' WHEN psi > 0.3 OR p_value < 0.03 THEN 'medium' ELSE 'low' END AS severity,
  psi, p_value, ks_statistic, drifted_features FROM ag)"""


@register("data_drift", f"WITH {SAMPLES}, {DATA_DRIFT} SELECT * FROM dd", "psi p_value ks_statistic")
def data_drift(spark, d):
    return mon.data_drift(spark, *drift_samples(spark, d))


CORR = "covar_samp(score, actual) FILTER ({0}) / (stddev_samp(score) FILTER ({0}) * stddev_samp(actual) FILTER ({0}))"
CONCEPT = f"""{MATCHED}, hv AS (SELECT signal, horizon, {CORR.format('i < k - 50')} AS ic_first, {CORR.format('i >= k - 50')} AS ic_second
  FROM mt WHERE i >= k - 100 GROUP BY 1, 2),
cd AS (SELECT *, ic_first - ic_second AS ic_drop, ic_first - ic_second > 0.1 AS drift_detected,
  CASE WHEN ic_first - ic_second > 0.3 THEN 'high' WHEN ic_first - ic_second > 0.2 THEN 'medium' ELSE 'low' END AS severity FROM hv)"""


@register("concept_drift", f"{WITH}, {CONCEPT} SELECT * FROM cd", "ic_first ic_second ic_drop")
def concept_drift(spark, d):
    return mon.concept_drift(matched(spark, d))


PRED_DRIFT = f"""{KS}, pd AS (SELECT feature, ks_statistic, p_value,
   abs((SELECT avg(value) FROM cur WHERE cur.feature = ks.feature) - (SELECT avg(value) FROM ref WHERE ref.feature = ks.feature)) AS mean_shift,
   abs((SELECT stddev_pop(value) FROM cur WHERE cur.feature = ks.feature) - (SELECT stddev_pop(value) FROM ref WHERE ref.feature = ks.feature)) AS std_shift
   FROM ks), pr AS (SELECT *, p_value < 0.05 OR mean_shift > 0.1 AS drift_detected,
   CASE WHEN NOT (p_value < 0.05 OR mean_shift > 0.1) THEN 'low' WHEN p_value < 0.01 OR mean_shift > 0.2 THEN 'high'
   WHEN p_value < 0.03 OR mean_shift > 0.15 THEN 'medium' ELSE 'low' END AS severity FROM pd)"""
SCORE_SAMPLES = f"""{PREDICTIONS}, ref AS (SELECT signal AS feature, score AS value FROM pred WHERE ts < '1998-06-01'),
cur AS (SELECT signal AS feature, score AS value FROM pred WHERE ts >= '1998-06-01')"""


@register("prediction_drift", f"{WITH}, {SCORE_SAMPLES}, {PRED_DRIFT} SELECT * FROM pr",
          "ks_statistic p_value mean_shift std_shift")
def prediction_drift(spark, d):
    p = predictions(spark, d).select(F.col("signal").alias("feature"), F.col("score").alias("value"), "ts")
    return mon.prediction_drift(spark, p.filter("ts < '1998-06-01'").drop("ts"),
                                p.filter("ts >= '1998-06-01'").drop("ts"))


@register("drift_report", f"""{WITH}, {SCORE_SAMPLES}, {PRED_DRIFT},
conc AS (WITH {CONCEPT.replace(PREDICTIONS + ', ', '')} SELECT * FROM cd),
dat AS (WITH {SAMPLES}, {DATA_DRIFT} SELECT * FROM dd)
SELECT 'data' AS drift_type, 'all' AS subject, drift_detected, severity FROM dat
UNION ALL SELECT 'concept', signal, drift_detected, severity FROM conc
UNION ALL SELECT 'prediction', feature, drift_detected, severity FROM pr""")
def drift_report(spark, d):
    return mon.drift_report(data_drift(spark, d), concept_drift(spark, d), prediction_drift(spark, d))


@register("metric_stats", f"""WITH m AS ({METRICS}), l AS (SELECT * FROM m QUALIFY row_number() OVER (PARTITION BY metric_name
  ORDER BY ts DESC, id DESC) <= 1000)
SELECT metric_name, count(*) AS n, sum(metric_value) AS total, min(metric_value) AS lo, max(metric_value) AS hi, avg(metric_value) AS mean,
  quantile_cont(metric_value, 0.5) AS p50, quantile_cont(metric_value, 0.95) AS p95, quantile_cont(metric_value, 0.99) AS p99
FROM l GROUP BY 1""", "total lo hi mean p50 p95 p99")
def metric_stats(spark, d):
    return stats.metric_stats(src.metrics(spark, d), ["metric_name"])


@register("counter_gauge", f"""SELECT metric_name, sum(metric_value) AS counter, arg_max(metric_value, row(ts, id)) AS gauge
FROM ({METRICS}) GROUP BY 1""", "counter gauge")
def counter_gauge(spark, d):
    return stats.counter_gauge(src.metrics(spark, d))
