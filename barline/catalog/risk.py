"""Sizing, stops, breakers, execution cost, portfolio weights and rebalancing."""

from __future__ import annotations

from pyspark.sql import functions as F

from barline.catalog.base import BARS, NUMBERED, full_sql, register
from barline.catalog.indicators import TR
from barline.catalog.labels import PREDICTIONS, predictions
from barline.catalog.stats import RET, TRADES, daily_returns
from barline.catalog.tables import POSITIONS, ohlcv_sql
from barline.operators import cost, portfolio, risk
from barline.operators import indicators as ind
from barline.plans.series import core_rows, in_blocks
from barline.sources import derived as src
from barline.sources.derived import bars_daily, bars_series

WITH = f"WITH {NUMBERED}\n"


def candidates(spark, d):
    """One trade idea per bar, with stop and target from ATR."""
    df = core_rows(ind.with_atr(in_blocks(bars_series(spark, d), 14), 14))
    df = df.filter(F.col("_atr_14").isNotNull()).select(
        "symbol", "ts", F.col("close").alias("entry"), F.col("_atr_14").alias("atr"),
        (F.col("close") > F.col("open")).alias("is_long"), F.lit(100000.0).alias("capital"),
        (0.35 + (F.col("volume") % 50) / 100).alias("win_probability"),
        ((F.col("volume") % 13) / 100).alias("drawdown"),
        ((F.col("volume") % 4) * 5000.0).alias("current_exposure"),
        ((F.col("volume") % 17) != 0).alias("can_trade"))
    return risk.atr_stop(df)


CAND = f"""{TR}, ca AS (SELECT symbol, ts, close AS entry, {full_sql('avg', 'tr', 14)} AS atr, close > open AS is_long, 100000e0 AS capital,
  0.35e0 + (volume % 50) / 100e0 AS win_probability, (volume % 13) / 100e0 AS drawdown, (volume % 4) * 5000e0 AS current_exposure,
  volume % 17 <> 0 AS can_trade FROM t QUALIFY atr IS NOT NULL),
cd AS (SELECT *, CASE WHEN is_long THEN entry - 2 * atr ELSE entry + 2 * atr END AS stop,
  CASE WHEN is_long THEN entry + 4 * atr ELSE entry - 4 * atr END AS target FROM ca)"""


@register("atr_stop", f"WITH {BARS}, {CAND} SELECT symbol, ts, entry, stop, target FROM cd", "entry stop target", digits=4)
def atr_stop(spark, d):
    return candidates(spark, d).select("symbol", "ts", "entry", "stop", "target")


@register("fixed_fraction_size", f"""WITH {BARS}, {CAND} SELECT symbol, ts, CASE WHEN entry = stop THEN 1 ELSE
  greatest(least(CAST(trunc(capital * 0.02e0 / abs(entry - stop)) AS BIGINT), CAST(trunc(capital * 0.1e0 / entry) AS BIGINT)), 1) END AS shares FROM cd""")
def fixed_fraction_size(spark, d):
    return candidates(spark, d).select("symbol", "ts", risk.fixed_fraction_size().alias("shares"))


KELLY = """k0 AS (SELECT *, abs(entry - stop) AS rk, abs(target - entry) / nullif(abs(entry - stop), 0) AS payoff FROM cd),
k1 AS (SELECT *, coalesce((win_probability * payoff - (1 - win_probability)) / payoff, 0e0) AS kelly_fraction,
  coalesce(win_probability * payoff - (1 - win_probability), 0e0) AS edge FROM k0),
k2 AS (SELECT *, least(greatest(kelly_fraction * 0.25e0, 0e0), 0.1e0) AS fraction FROM k1),
kl AS (SELECT *, capital * fraction AS risk_amount, CASE WHEN fraction > 0 THEN greatest(least(CAST(trunc(capital * fraction / rk) AS BIGINT),
  CAST(trunc(capital * 0.1e0 / entry) AS BIGINT)), 0) ELSE 0 END AS position_size FROM k2)"""


@register("kelly_size", f"""WITH {BARS}, {CAND}, {KELLY} SELECT symbol, ts, coalesce(payoff, 0e0) AS payoff_ratio, kelly_fraction, edge, fraction,
  risk_amount, position_size FROM kl""", "payoff_ratio kelly_fraction edge fraction risk_amount", digits=4)
def kelly_size(spark, d):
    return risk.kelly_size(candidates(spark, d)).select(
        "symbol", "ts", "payoff_ratio", "kelly_fraction", "edge", "fraction", "risk_amount", "position_size")


W100 = "OVER (PARTITION BY symbol ORDER BY ts, id ROWS BETWEEN 99 PRECEDING AND CURRENT ROW)"


@register("kelly_history", f"""WITH {TRADES} SELECT symbol, id,
  CASE WHEN count(*) {W100} < 10 THEN 5e-1 ELSE avg(CASE WHEN pnl > 0 THEN 1e0 ELSE 0e0 END) {W100} END AS win_rate,
  CASE WHEN count(*) {W100} < 10 THEN 1.5e0 ELSE coalesce(avg(CASE WHEN pnl > 0 THEN pnl END) {W100} / avg(CASE WHEN pnl < 0 THEN -pnl END) {W100}, 1.5e0) END AS payoff
FROM tr""", "win_rate payoff")
def kelly_history(spark, d):
    return risk.kelly_history(src.trades_closed(spark, d))


@register("trailing_stop", f"""WITH {BARS} SELECT symbol, ts, CASE WHEN symbol LIKE '%F' THEN
  max(greatest(50e0, close * (1 - 0.05e0))) OVER w ELSE min(least(200000e0, close * (1 + 0.05e0))) OVER w END AS stop
FROM bars WINDOW w AS (PARTITION BY symbol ORDER BY ts)""", "stop", digits=4)
def trailing_stop(spark, d):
    df = bars_series(spark, d).withColumn("is_long", F.col("symbol").endswith("F"))
    return risk.trailing_stop(df.withColumn("first_stop", F.when(F.col("is_long"), 50.0).otherwise(200000.0)))


STREAK = """OVER (PARTITION BY symbol ORDER BY ts, id ROWS UNBOUNDED PRECEDING)"""


@register("loss_streak", f"""WITH {TRADES}, i AS (SELECT *, sum(CASE WHEN pnl >= 0 THEN 1 ELSE 0 END) {STREAK} AS isl FROM tr)
SELECT symbol, id, pnl, CAST(sum(CASE WHEN pnl < 0 THEN 1 ELSE 0 END) OVER (PARTITION BY symbol, isl ORDER BY ts, id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS loss_streak
FROM i""", "pnl", digits=4)
def loss_streak(spark, d):
    return risk.loss_streak(src.trades_closed(spark, d))


@register("daily_pnl", f"""WITH {TRADES} SELECT symbol, CAST(ts AS DATE) AS day, sum(pnl) AS pnl,
  sum(CASE WHEN pnl < 0 THEN pnl ELSE 0 END) AS realised_loss FROM tr GROUP BY 1, 2""", "pnl realised_loss", digits=3)
def daily_pnl(spark, d):
    return risk.daily_pnl(src.trades_closed(spark, d))


DD = "CASE WHEN drawdown >= 0.1e0 THEN 0 ELSE CAST(trunc(position_size * greatest(5e-1, 1 - drawdown / 0.1e0)) AS BIGINT) END"


@register("drawdown_size", f"WITH {BARS}, {CAND}, {KELLY} SELECT symbol, ts, {DD} AS shares FROM kl")
def drawdown_size(spark, d):
    return risk.kelly_size(candidates(spark, d)).select("symbol", "ts", risk.drawdown_size().alias("shares"))


@register("exposure_check", f"""WITH {BARS}, h AS (SELECT sum(current_price * quantity) AS current_exposure FROM ({POSITIONS}) WHERE status = 'OPEN')
SELECT symbol, ts, volume * close AS new_value, current_exposure, (current_exposure + volume * close) / (current_exposure * 5.001e0) <= 0.2e0 AS within_limit
FROM bars, h""", "new_value current_exposure", digits=1)
def exposure_check(spark, d):
    c = bars_daily(spark, d).select("symbol", "ts", (F.col("volume") * F.col("close")).alias("new_value"))
    held = src.positions(spark, d)
    total = held.filter("status = 'OPEN'").agg((F.sum(F.col("current_price") * F.col("quantity")) * 5.001).alias("capital"))
    return risk.exposure_check(c.join(F.broadcast(total)), held).drop("capital")  # one row


@register("evaluate_trade", f"""WITH {BARS}, {CAND}, {KELLY}, e0 AS (SELECT *, {DD} AS sized FROM kl),
e1 AS (SELECT *, CASE WHEN (current_exposure + sized * entry) / capital <= 0.2e0 THEN sized ELSE CAST(trunc(sized * 5e-1) AS BIGINT) END AS fin FROM e0),
e2 AS (SELECT *, CASE WHEN NOT can_trade THEN 'trading halted' WHEN edge <= 0 THEN 'negative edge' WHEN fin <= 0 THEN 'position too small' ELSE 'OK' END AS reason FROM e1)
SELECT symbol, ts, reason = 'OK' AS approved, reason, CASE WHEN reason = 'OK' THEN fin ELSE 0 END AS position_size, coalesce(payoff, 0e0) AS risk_reward FROM e2""",
          "risk_reward")
def evaluate_trade(spark, d):
    return risk.evaluate_trade(candidates(spark, d)).select(
        "symbol", "ts", "approved", "reason", "position_size", "risk_reward")


def event_log(spark, d):
    ev = src.table(spark, d, "events")
    return ev.select(
        F.concat(F.lit("s"), (F.col("user_id") % 5).cast("string")).alias("symbol"), "ts",
        F.col("event_id").alias("id"),
        F.when(F.col("event_type") == "error", "error").when(F.col("event_type") == "purchase", "trade")
        .otherwise("other").alias("kind"),
        F.when(F.col("event_type") == "purchase", F.col("value") - 12).alias("pnl"))


LOG = """lg AS (SELECT 's' || (user_id % 5) AS symbol, ts, event_id AS id, CASE event_type WHEN 'error' THEN 'error' WHEN 'purchase' THEN 'trade'
  ELSE 'other' END AS kind, CASE WHEN event_type = 'purchase' THEN value - 12 END AS pnl FROM events)"""
SO = "PARTITION BY symbol ORDER BY ts, id ROWS UNBOUNDED PRECEDING"


@register("breaker_level", f"""WITH {LOG}, a AS (SELECT *, count(CASE WHEN kind = 'error' THEN 1 END) OVER (PARTITION BY symbol ORDER BY ts
   RANGE BETWEEN INTERVAL 1 HOUR PRECEDING AND CURRENT ROW) AS errors,
  sum(CASE WHEN pnl >= 0 THEN 1 ELSE 0 END) OVER ({SO}) AS isl,
  sum(CASE WHEN pnl < 0 THEN pnl ELSE 0 END) OVER (PARTITION BY symbol, CAST(ts AS DATE) ORDER BY ts, id ROWS UNBOUNDED PRECEDING) AS day_loss FROM lg),
b AS (SELECT *, CAST(sum(CASE WHEN pnl < 0 THEN 1 ELSE 0 END) OVER (PARTITION BY symbol, isl ORDER BY ts, id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS loss_streak FROM a),
c AS (SELECT *, max(CASE WHEN errors >= 5 OR loss_streak >= 5 THEN 3 WHEN abs(day_loss) > 500 * 0.1e0 OR loss_streak >= 3 THEN 2 WHEN errors >= 2 THEN 1 ELSE 0 END)
  OVER ({SO}) AS lv FROM b)
SELECT symbol, ts, id, kind, errors, loss_streak, day_loss, ['normal', 'warn', 'soft_halt', 'hard_halt'][lv + 1] AS level FROM c""", "day_loss")
def breaker_level(spark, d):
    return risk.breaker_level(event_log(spark, d), starting_equity=500.0, seconds=3600)


@register("rate_window", """SELECT user_id AS key, event_id, count(*) OVER (PARTITION BY user_id ORDER BY ts RANGE BETWEEN INTERVAL 6 HOUR PRECEDING AND CURRENT ROW) AS in_window,
  count(*) OVER (PARTITION BY user_id ORDER BY ts RANGE BETWEEN INTERVAL 6 HOUR PRECEDING AND CURRENT ROW) > 3 AS over_limit FROM events""")
def rate_window(spark, d):
    ev = src.table(spark, d, "events").select(F.col("user_id").alias("key"), "event_id", "ts")
    return risk.rate_window(ev, 3, 6 * 3600).drop("ts")


# ---- execution cost --------------------------------------------------------------------------

def orders_to_cost(spark, d):
    df = cost.with_adv(bars_series(spark, d))
    kind = F.element_at(F.array(*[F.lit(k) for k in ("market", "limit", "vwap", "twap")]),
                        (F.col("volume") % 4 + 1).cast("int"))
    return df.select("symbol", "ts", (F.col("volume") * 0.01).alias("size"), F.col("close").alias("price"),
                     "adv", ((F.col("volume") % 3) / 2).alias("urgency"), kind.alias("order_type"))


ORDERS = """oc AS (SELECT symbol, ts, volume * 0.01e0 AS size, close AS price, avg(volume) OVER (PARTITION BY symbol ORDER BY ts ROWS 19 PRECEDING) AS adv,
  (volume % 3) / 2e0 AS urgency, ['market', 'limit', 'vwap', 'twap'][volume % 4 + 1] AS order_type FROM bars),
oc1 AS (SELECT *, size * price AS order_value, size / adv AS participation FROM oc),
oc2 AS (SELECT *, order_value * 0.001e0 AS commission, order_value * 0.0005e0 * 5e-1 AS spread_cost,
  0.1e0 * sqrt(participation) * order_value * (5e-1 + 5e-1 * urgency) * CASE order_type WHEN 'market' THEN 1e0 WHEN 'limit' THEN 5e-1 WHEN 'vwap' THEN 0.7e0 ELSE 0.6e0 END AS market_impact,
  order_value * (sqrt(participation) * 0.01e0 + urgency * 0.005e0 + CASE order_type WHEN 'market' THEN 0.002e0 WHEN 'limit' THEN 0e0 ELSE 0.001e0 END) AS slippage FROM oc1),
co AS (SELECT *, commission + spread_cost + market_impact + slippage AS total_cost FROM oc2)"""


@register("order_cost", f"""WITH {BARS}, {ORDERS} SELECT symbol, ts, order_value, participation, commission, spread_cost, market_impact, slippage, total_cost,
  total_cost / order_value * 100 AS cost_pct FROM co""", "order_value participation commission spread_cost market_impact slippage total_cost cost_pct", digits=4)
def order_cost(spark, d):
    return cost.order_cost(orders_to_cost(spark, d)).drop("size", "price", "adv", "urgency", "order_type")


TOTALS = "to_ AS (SELECT " + ", ".join(f"sum({c}) AS {c}_sum" for c in cost.PARTS) + """, sum(order_value) AS value_sum, count(*) AS orders
  FROM co WHERE ts BETWEEN '1996-01-01' AND '2000-12-31')"""
SUMS = " ".join(f"{c}_sum" for c in cost.PARTS) + " value_sum"


@register("cost_totals", f"WITH {BARS}, {ORDERS}, {TOTALS} SELECT * FROM to_", SUMS, digits=3)
def cost_totals(spark, d):
    return cost.cost_totals(cost.order_cost(orders_to_cost(spark, d)), "1996-01-01", "2000-12-31")


@register("cost_attribution", f"""WITH {BARS}, {ORDERS}, {TOTALS} SELECT *, 1e6 AS gross_pnl, 1e6 - total_cost_sum AS net_pnl,
  total_cost_sum / 1e6 * 100 AS pct_of_gross, total_cost_sum / value_sum * 100 AS pct_of_value FROM to_""",
          SUMS + " gross_pnl net_pnl pct_of_gross pct_of_value", digits=3)
def cost_attribution(spark, d):
    return cost.cost_attribution(cost_totals(spark, d), F.lit(1e6))


SCHEDULE = "symbol, step, sum(shares) AS shares, count(*) AS orders"


def _per_step(df):
    return df.groupBy("symbol", "step").agg(F.sum("shares").alias("shares"), F.count(F.lit(1)).alias("orders"))


@register("twap_schedule", f"""WITH {BARS}, {ORDERS}, s AS (SELECT symbol, CAST(k AS INTEGER) AS step, size / 390 AS shares FROM oc, range(390) t(k))
SELECT {SCHEDULE} FROM s GROUP BY 1, 2""", "shares")
def twap_schedule(spark, d):
    return _per_step(cost.twap_schedule(orders_to_cost(spark, d), 390))


@register("ac_schedule", f"""WITH {BARS}, {ORDERS}, s AS (SELECT symbol, CAST(k AS INTEGER) AS step, CASE WHEN k = 0 THEN 0e0 ELSE
  size * exp((k - 1) * (-{cost.DAILY_VOLATILITY!r}e0 / 0.1e0 / 389)) - size * exp(k * (-{cost.DAILY_VOLATILITY!r}e0 / 0.1e0 / 389)) END AS shares FROM oc, range(390) t(k))
SELECT {SCHEDULE} FROM s GROUP BY 1, 2""", "shares")
def ac_schedule(spark, d):
    return _per_step(cost.ac_schedule(orders_to_cost(spark, d), steps_per_day=390))


@register("vwap_schedule", f"""WITH o AS (SELECT symbol, volume AS size FROM ({ohlcv_sql('day')})),
p AS (SELECT event_type AS symbol, hour(ts) AS idx, CAST(count(*) AS DOUBLE) AS v FROM events GROUP BY 1, 2),
g AS (SELECT symbol, CAST(k AS INTEGER) AS step, k * (m - 1) / 389e0 AS x, m FROM (SELECT symbol, count(*) AS m FROM p GROUP BY 1), range(390) t(k)),
i AS (SELECT g.symbol, step, a.v * (1 - (x - floor(x))) + b.v * (x - floor(x)) AS v FROM g JOIN p a ON a.symbol = g.symbol AND a.idx = floor(x)
  JOIN p b ON b.symbol = g.symbol AND b.idx = least(floor(x) + 1, m - 1)),
s AS (SELECT symbol, step, size * v / sum(v) OVER (PARTITION BY symbol, o.size, o.k) AS shares FROM (SELECT *, row_number() OVER () AS k FROM o) o JOIN i USING (symbol))
SELECT {SCHEDULE} FROM s GROUP BY 1, 2""", "shares")
def vwap_schedule(spark, d):
    ev = src.table(spark, d, "events")
    profile = ev.groupBy(F.col("event_type").alias("symbol"), F.hour("ts").cast("bigint").alias("idx")).agg(
        F.count(F.lit(1)).cast("double").alias("volume"))
    orders = src.ohlcv(spark, d, "1Day").select("symbol", "ts", F.col("volume").alias("size"))
    return _per_step(cost.vwap_schedule(orders, profile, 390))


# ---- portfolio -------------------------------------------------------------------------------

def quarter_returns(spark, d):
    return daily_returns(spark, d).withColumn("rebalance", F.date_trunc("quarter", "ts"))


QR = f"{RET}, qr AS (SELECT *, date_trunc('quarter', ts) AS rebalance FROM r)"
COV = """cv AS (SELECT p.rebalance, p.symbol AS a, q.symbol AS b, CASE WHEN count(*) > 1 THEN covar_samp(p.ret, q.ret) END AS cov, count(*) AS rows
  FROM qr p JOIN qr q ON p.ts = q.ts AND p.symbol <= q.symbol GROUP BY 1, 2, 3)"""


@register("cov_pairs", f"{WITH}, {QR}, {COV} SELECT * FROM cv", "cov", digits=4)
def cov_pairs(spark, d):
    return portfolio.cov_pairs(quarter_returns(spark, d), "rebalance")


def quarter_signals(spark, d):
    p = predictions(spark, d).withColumn("rebalance", F.date_trunc("quarter", "ts"))
    return p.groupBy("rebalance", F.col("signal").alias("symbol")).agg(F.max_by("score", "ts").alias("signal"))


QS = f"{PREDICTIONS}, qs AS (SELECT date_trunc('quarter', ts) AS rebalance, symbol, arg_max(score, ts) AS signal FROM pred GROUP BY 1, 2)"


@register("signal_moments", f"""{WITH}, {QS} SELECT p.rebalance, p.symbol AS a, q.symbol AS b, CASE WHEN p.symbol = q.symbol THEN 0.04e0
  ELSE 0.02e0 * (1 + 5e-1 * sign(p.signal) * sign(q.signal)) END AS cov, p.signal * 0.001e0 AS expected_return
FROM qs p JOIN qs q USING (rebalance)""", "cov expected_return")
def signal_moments(spark, d):
    return portfolio.signal_moments(quarter_signals(spark, d), "rebalance")


@register("equal_weight", f"{WITH}, {QS} SELECT rebalance, symbol, 1e0 / count(*) OVER (PARTITION BY rebalance) AS weight FROM qs", "weight")
def equal_weight(spark, d):
    return portfolio.equal_weight(quarter_signals(spark, d), "rebalance")


@register("kelly_weights", f"""{WITH}, {QS}, {RET}, t AS (SELECT date_trunc('quarter', ts) AS rebalance, symbol, avg(CASE WHEN ret > 0 THEN 1e0 ELSE 0e0 END) AS win_rate,
  avg(CASE WHEN ret > 0 THEN ret END) AS avg_win, avg(CASE WHEN ret < 0 THEN ret END) AS avg_loss FROM r GROUP BY 1, 2),
k AS (SELECT *, avg_win / abs(avg_loss) AS pay FROM qs JOIN t USING (rebalance, symbol)),
k1 AS (SELECT *, coalesce(greatest((win_rate * pay - (1 - win_rate)) / pay * abs(signal), 0), 0) AS raw FROM k),
k2 AS (SELECT *, CASE WHEN sum(raw) OVER w > 0 THEN raw / sum(raw) OVER w ELSE 1e0 / count(*) OVER w END AS f FROM k1 WINDOW w AS (PARTITION BY rebalance)),
k3 AS (SELECT *, least(greatest(f, 0e0), 0.2e0) AS c FROM k2)
SELECT rebalance, symbol, c / sum(c) OVER (PARTITION BY rebalance) AS weight, c / sum(c) OVER (PARTITION BY rebalance) > 0.2e0 + 1e-12 AS over_cap FROM k3""", "weight")
def kelly_weights(spark, d):
    t = quarter_returns(spark, d).groupBy("rebalance", "symbol").agg(
        F.avg(F.when(F.col("ret") > 0, 1.0).otherwise(0.0)).alias("win_rate"),
        F.avg(F.when(F.col("ret") > 0, F.col("ret"))).alias("avg_win"),
        F.avg(F.when(F.col("ret") < 0, F.col("ret"))).alias("avg_loss"))
    return portfolio.kelly_weights(quarter_signals(spark, d).join(t, ["rebalance", "symbol"]), "rebalance")


def quarter_mu(spark, d):
    return quarter_returns(spark, d).groupBy("rebalance", "symbol").agg(F.avg("ret").alias("expected_return"))


@register("weight_sweep", f"""{WITH}, {QR}, n AS (SELECT rebalance, count(DISTINCT symbol) AS symbols FROM qr GROUP BY 1)
SELECT rebalance, unnest({list(portfolio.METHODS)!r}) AS method, symbols, 1e0 AS total, TRUE AS sound FROM n""", "total", digits=4)
def weight_sweep(spark, d):
    """Weights of each method: all symbols, sum 1, within the bounds or equal where these cannot hold."""
    w = portfolio.weight_sweep(cov_pairs(spark, d), quarter_mu(spark, d), "rebalance")
    n = F.count(F.lit(1))
    top = F.greatest(F.lit(portfolio.MAX_WEIGHT), 1 / n)
    return w.groupBy("rebalance", "method").agg(
        n.alias("symbols"), F.sum("weight").alias("total"),
        ((F.min("weight") >= portfolio.MIN_WEIGHT - 1e-9) & (F.max("weight") <= top + 1e-9)).alias("sound"))


@register("portfolio_metrics", f"""{WITH}, {QR}, {COV}, mu AS (SELECT rebalance, symbol, avg(ret) AS mu, 1e0 / count(*) OVER (PARTITION BY rebalance) AS w FROM qr GROUP BY 1, 2),
e AS (SELECT rebalance, sum(w * mu) AS expected_return, any_value(w) AS w FROM mu GROUP BY 1),
v AS (SELECT rebalance, sqrt(greatest(sum(CASE WHEN a = b THEN 1 ELSE 2 END * w * w * cov), 0)) AS volatility FROM cv JOIN e USING (rebalance) GROUP BY 1)
SELECT rebalance, expected_return, volatility, coalesce(expected_return / nullif(volatility, 0), 0) AS ratio FROM e JOIN v USING (rebalance)""", "expected_return volatility ratio", digits=4)
def portfolio_metrics(spark, d):
    mu = quarter_mu(spark, d)
    w = portfolio.equal_weight(mu, "rebalance")
    return portfolio.portfolio_metrics(w, portfolio.cov_pairs(quarter_returns(spark, d), "rebalance"), mu, "rebalance")


@register("rebalance_orders", f"""WITH p AS ({POSITIONS}), w AS (SELECT symbol, count(*) / sum(count(*)) OVER () AS weight FROM p WHERE symbol <> '5-LOW' GROUP BY 1),
px AS (SELECT symbol, arg_max(current_price, id) AS price FROM p GROUP BY 1),
h AS (SELECT symbol, CAST(sum(quantity) AS BIGINT) AS current FROM p WHERE status = 'OPEN' AND symbol <> '1-URGENT' GROUP BY 1),
j AS (SELECT coalesce(w.symbol, h.symbol) AS symbol, weight, price, coalesce(current, 0) AS current FROM w JOIN px USING (symbol) FULL OUTER JOIN h ON h.symbol = w.symbol),
t AS (SELECT *, coalesce(CAST(trunc(weight * 1e8 / price) AS BIGINT), 0) AS target FROM j)
SELECT symbol, target AS target_shares, current AS current_shares, CASE WHEN weight IS NULL THEN 0 ELSE abs(target - current) END AS quantity,
  CASE WHEN weight IS NULL OR target = current THEN 'hold' WHEN target > current THEN 'buy' ELSE 'sell' END AS side, weight IS NULL AS untargeted FROM t""")
def rebalance_orders(spark, d):
    p = src.positions(spark, d)
    n = p.filter("symbol <> '5-LOW'").groupBy("symbol").agg(F.count(F.lit(1)).alias("n"))
    w = n.join(F.broadcast(n.agg(F.sum("n").alias("t")))).select("symbol", (F.col("n") / F.col("t")).alias("weight"))
    price = p.groupBy("symbol").agg(F.max_by("current_price", "id").alias("price"))
    held = p.filter("status = 'OPEN' AND symbol <> '1-URGENT'").select("symbol", "quantity")
    return portfolio.rebalance_orders(w, held, price, 1e8)
