"""Technical indicators over daily bars."""

from __future__ import annotations

from barline.catalog.base import (
    BARS, NUMBERED, full_sql, lag_sql, register, std_sql, zscore_sql,
)
from barline.operators import indicators as ind
from barline.sources.derived import bars_daily, bars_series

WITH = f"WITH {BARS}\n"
BB = (f"SELECT *, {full_sql('avg', 'close', 20)} AS mid, {std_sql('close', 20)} AS sd FROM bars")
BB_OUT = f"""{WITH}, s AS ({BB})
SELECT symbol, ts, close, mid + 2 * sd AS bb_upper, mid AS bb_middle, mid - 2 * sd AS bb_lower,
       coalesce(CASE WHEN sd > 0 THEN (close - (mid - 2 * sd)) / (4 * sd) END, 0.5e0) AS bb_pct_b
FROM s"""
TR = f"""t AS (SELECT *, greatest(high - low, abs(high - {lag_sql('close', 1)}),
                                  abs(low - {lag_sql('close', 1)})) AS tr FROM bars)"""


@register("bollinger", BB_OUT, "close bb_upper bb_middle bb_lower bb_pct_b", digits=4)
def bollinger(spark, d):
    return ind.bollinger(bars_series(spark, d))


@register("upper_band_crossings", f"""SELECT symbol, count(*) AS bars,
  CAST(sum(CASE WHEN close > bb_upper THEN 1 ELSE 0 END) AS BIGINT) AS above_upper,
  avg(bb_pct_b) AS avg_pct_b FROM ({BB_OUT}) GROUP BY 1""", "avg_pct_b")
def upper_band_crossings(spark, d):
    return ind.upper_band_crossings(bars_series(spark, d))


@register("sma", WITH + "SELECT symbol, ts, " + ", ".join(
    f"{full_sql('avg', 'close', p)} AS sma_{p}" for p in (20, 50, 200)) + " FROM bars",
    "sma_20 sma_50 sma_200", digits=4)
def sma(spark, d):
    return ind.sma(bars_series(spark, d), 20, 50, 200)


@register("atr", f"{WITH}, {TR} SELECT symbol, ts, {full_sql('avg', 'tr', 14)} AS atr FROM t", "atr", digits=4)
def atr(spark, d):
    return ind.atr(bars_series(spark, d))


@register("natr", f"""{WITH}, {TR} SELECT symbol, ts,
  coalesce({full_sql('avg', 'tr', 14)} / close * 100, 0e0) AS natr FROM t""", "natr")
def natr(spark, d):
    return ind.natr(bars_series(spark, d))


@register("roc", WITH + "SELECT symbol, ts, " + ", ".join(
    f"coalesce((close - {lag_sql('close', p)}) / {lag_sql('close', p)} * 100, 0e0) AS roc_{p}"
    for p in (12, 63)) + " FROM bars", "roc_12 roc_63")
def roc(spark, d):
    return ind.roc(bars_series(spark, d), 12, 63)


HH, LL = full_sql("max", "high", 14), full_sql("min", "low", 14)


@register("stochastic", f"""{WITH}, k AS (SELECT symbol, ts,
  coalesce((close - {LL}) / nullif({HH} - {LL}, 0) * 100, 50e0) AS stoch_k FROM bars)
SELECT *, coalesce({full_sql('avg', 'stoch_k', 3)}, 50e0) AS stoch_d FROM k""", "stoch_k stoch_d")
def stochastic(spark, d):
    return ind.stochastic(bars_series(spark, d))


@register("williams_r", f"""{WITH} SELECT symbol, ts,
  coalesce(({HH} - close) / nullif({HH} - {LL}, 0) * -100, -50e0) AS williams_r FROM bars""",
          "williams_r")
def williams_r(spark, d):
    return ind.williams_r(bars_series(spark, d))


@register("obv", f"""{WITH}, s AS (SELECT symbol, ts,
  coalesce(sign(close - {lag_sql('close', 1)}), 0) * volume AS sv FROM bars)
SELECT symbol, ts, CAST(sum(sv) OVER (PARTITION BY symbol ORDER BY ts) AS DOUBLE) AS obv FROM s""",
          "obv")
def obv(spark, d):
    return ind.obv(bars_series(spark, d))


def vwap_sql(part):
    w = f"OVER (PARTITION BY {part} ORDER BY ts)"
    return f"""{WITH}, s AS (SELECT *, sum((high + low + close) / 3 * volume) {w}
    / nullif(sum(volume) {w}, 0) AS vw FROM bars)
SELECT symbol, ts, coalesce((close - vw) / nullif(vw, 0) * 100, 0e0) AS vwap_dev FROM s"""


@register("vwap_dev", vwap_sql("symbol"), "vwap_dev")
def vwap_dev(spark, d):
    return ind.vwap_dev(bars_series(spark, d))


@register("volume_ratio", f"""{WITH} SELECT symbol, ts,
  coalesce(volume / nullif({full_sql('avg', 'volume', 20)}, 0), 1e0) AS volume_ratio FROM bars""",
          "volume_ratio")
def volume_ratio(spark, d):
    return ind.volume_ratio(bars_series(spark, d))


DH, DL = full_sql("max", "high", 20), full_sql("min", "low", 20)


@register("donchian", f"""{WITH} SELECT symbol, ts, {DH} AS dc_upper, ({DH} + {DL}) / 2 AS dc_middle,
  {DL} AS dc_lower FROM bars""", "dc_upper dc_middle dc_lower", digits=4)
def donchian(spark, d):
    return ind.donchian(bars_series(spark, d))


@register("returns_1_5_20", WITH + "SELECT symbol, ts, " + ", ".join(
    f"coalesce(close / {lag_sql('close', h)} - 1, 0e0) AS return_{h}d" for h in (1, 5, 20))
    + " FROM bars", "return_1d return_5d return_20d")
def returns(spark, d):
    return ind.returns(bars_series(spark, d), 1, 5, 20)


@register("price_vs_ma", WITH + "SELECT symbol, ts, " + ", ".join(
    f"(close - {full_sql('avg', 'close', p)}) / {full_sql('avg', 'close', p)} * 100 "
    f"AS price_sma{p}_pct" for p in (20, 50, 200)) + " FROM bars",
    "price_sma20_pct price_sma50_pct price_sma200_pct")
def price_vs_ma(spark, d):
    return ind.price_vs_ma(bars_series(spark, d), 20, 50, 200)


@register("zscore", f"{WITH} SELECT symbol, ts, {zscore_sql('close', 252)} AS close_zscore FROM bars",
          "close_zscore")
def zscore(spark, d):
    return ind.zscore(bars_series(spark, d))


@register("hist_volatility", f"""{WITH} SELECT symbol,
  CASE WHEN min(close) < max(close) THEN stddev_samp(close) ELSE 0 END / avg(close) AS volatility,
  count(*) AS bars FROM bars GROUP BY 1""", "volatility")
def hist_volatility(spark, d):
    return ind.hist_volatility(bars_series(spark, d))


@register("latest_row", f"""{WITH} SELECT symbol, ts, open, high, low, close, volume FROM bars
QUALIFY row_number() OVER (PARTITION BY symbol ORDER BY ts DESC) = 1""", "open high low close")
def latest_row(spark, d):
    return ind.latest_row(bars_daily(spark, d))


F20 = "OVER (PARTITION BY symbol ORDER BY ts ROWS BETWEEN 19 PRECEDING AND CURRENT ROW)"


@register("signal_norm", f"""{WITH} SELECT symbol, ts, CASE
  WHEN count(close) {F20} < 5 THEN least(greatest(close, -1e0), 1e0)
  WHEN min(close) {F20} < max(close) {F20} THEN
    least(greatest((close - avg(close) {F20}) / stddev_pop(close) {F20}, -3e0), 3e0) / 3
  ELSE 0e0 END AS signal_norm FROM bars""", "signal_norm")
def signal_norm(spark, d):
    return ind.signal_norm(bars_series(spark, d), "close")


# ---- exponential averages: the oracle walks the recursion row by row -------------------------

def ewm_sql(columns: dict[str, tuple[str, str]], pre: str = "", src: str = "b") -> str:
    """``columns`` maps a name to its first value (over s) and its step (over s and e)."""
    first = ", ".join(f"CAST({a} AS DOUBLE) AS {n}" for n, (a, _) in columns.items())
    step = ", ".join(f"CAST({s} AS DOUBLE)" for _, s in columns.values())
    return f"""WITH RECURSIVE {NUMBERED}{pre},
e AS (SELECT s.symbol, s.rn, {first} FROM {src} s WHERE s.rn = 0
      UNION ALL
      SELECT s.symbol, s.rn, {step} FROM e JOIN {src} s ON s.symbol = e.symbol AND s.rn = e.rn + 1)
"""


def step(name: str, x: str, alpha: float) -> str:
    return f"{alpha!r}e0 * ({x}) + (1e0 - {alpha!r}e0) * e.{name}"


def ema_columns(*periods: int) -> dict[str, tuple[str, str]]:
    return {f"e{p}": ("s.close", step(f"e{p}", "s.close", 2 / (p + 1))) for p in periods}


@register("ema", ewm_sql(ema_columns(9, 12, 20, 21, 26)) + """
SELECT symbol, ts, e9 AS ema_9, e12 AS ema_12, e20 AS ema_20, e21 AS ema_21, e26 AS ema_26
FROM e JOIN b USING (symbol, rn)""", "ema_9 ema_12 ema_20 ema_21 ema_26", digits=4)
def ema(spark, d):
    return ind.ema(bars_series(spark, d), 9, 12, 20, 21, 26)


GL = f""",
g AS (SELECT *, coalesce(greatest(close - {lag_sql('close', 1)}, 0), 0) AS gain,
             coalesce(greatest({lag_sql('close', 1)} - close, 0), 0) AS loss FROM b)"""
RSI_COLS = {f"{k}{p}": (f"s.{v}", step(f"{k}{p}", f"s.{v}", 1 / p))
            for p in (14, 63) for k, v in (("g", "gain"), ("l", "loss"))}


def rsi_sql(p):
    return f"100 - 100 / (1 + coalesce(g{p} / nullif(l{p}, 0), 1e0))"


@register("rsi", ewm_sql(RSI_COLS, GL, "g") + f"""
SELECT symbol, ts, {rsi_sql(14)} AS rsi_14, {rsi_sql(63)} AS rsi_63
FROM e JOIN b USING (symbol, rn)""", "rsi_14 rsi_63")
def rsi(spark, d):
    return ind.rsi(bars_series(spark, d), 14, 63)


def next_ema(p):
    return f"({step(f'e{p}', 's.close', 2 / (p + 1))})"


MACD_COLS = ema_columns(12, 26) | {
    "sig": ("0", step("sig", f"{next_ema(12)} - {next_ema(26)}", 2 / 10))}


@register("macd", ewm_sql(MACD_COLS) + """
SELECT symbol, ts, e12 - e26 AS macd, sig AS macd_signal, e12 - e26 - sig AS macd_histogram
FROM e JOIN b USING (symbol, rn)""", "macd macd_signal macd_histogram", digits=4)
def macd(spark, d):
    return ind.macd(bars_series(spark, d))


@register("ppo", ewm_sql(ema_columns(12, 26)) + """
SELECT symbol, ts, coalesce((e12 - e26) / nullif(e26, 0) * 100, 0e0) AS ppo
FROM e JOIN b USING (symbol, rn)""", "ppo")
def ppo(spark, d):
    return ind.ppo(bars_series(spark, d))


ATR_CTE = f""",
{TR},
a AS (SELECT symbol, ts, {full_sql('avg', 'tr', 14)} AS atr14, {full_sql('avg', 'tr', 20)} AS atr20
      FROM t)"""


@register("keltner", ewm_sql(ema_columns(20), ATR_CTE) + """
SELECT symbol, ts, e20 + 2 * atr20 AS kc_upper, e20 AS kc_middle, e20 - 2 * atr20 AS kc_lower
FROM e JOIN b USING (symbol, rn) JOIN a USING (symbol, ts)""", "kc_upper kc_middle kc_lower", digits=4)
def keltner(spark, d):
    return ind.keltner(bars_series(spark, d))


MOM = f""",
m AS (SELECT *, close - {lag_sql('close', 12)} AS mom,
             {full_sql('avg', 'close', 20)} AS mid, {std_sql('close', 20)} AS sd FROM b)"""
MOM_COLS = ema_columns(20) | {"mo": ("NULL", f"""CASE WHEN s.rn < 12 THEN NULL
   WHEN s.rn = 12 THEN s.mom ELSE {step('mo', 's.mom', 2 / 7)} END""")}


def inside_sql(k):
    return (f"(mid + 2 * sd < e20 + {k}e0 * atr20 AND mid - 2 * sd > e20 - {k}e0 * atr20)")


SQUEEZE_OUT = f"""CAST({inside_sql(1.5)} AS INTEGER) AS squeeze,
  CASE WHEN {inside_sql(1.0)} THEN 1e0 WHEN {inside_sql(1.5)} THEN 5e-1 ELSE 0e0 END AS squeeze_pro,
  coalesce(mo, 0) AS squeeze_momentum"""


@register("squeeze_pro", ewm_sql(MOM_COLS, ATR_CTE + MOM, "m") + f"""
SELECT symbol, ts, {SQUEEZE_OUT}
FROM e JOIN m USING (symbol, rn) JOIN a USING (symbol, ts)""", "squeeze_pro squeeze_momentum", digits=4)
def squeeze_pro(spark, d):
    return ind.squeeze_pro(bars_series(spark, d))


DM = f""",
d0 AS (SELECT *, coalesce(greatest(high - {lag_sql('high', 1)}, 0), 0) AS up,
              coalesce(greatest({lag_sql('low', 1)} - low, 0), 0) AS dn FROM b),
d1 AS (SELECT *, CASE WHEN up > dn THEN up ELSE 0 END AS pdm FROM d0),
d2 AS (SELECT d1.*, CASE WHEN dn > pdm THEN dn ELSE 0 END AS mdm, atr14
       FROM d1 JOIN a USING (symbol, ts))"""


def dx_sql(p, m):
    return (f"coalesce(100 * abs({p} / s.atr14 - {m} / s.atr14) "
            f"/ nullif({p} / s.atr14 + {m} / s.atr14, 0), 0e0)")


def _next(n, x):
    return f"({step(n, x, 1 / 14)})"


ADX_COLS = {"p": ("s.pdm", _next("p", "s.pdm")), "m": ("s.mdm", _next("m", "s.mdm")),
            "ax": ("0", step("ax", dx_sql(_next("p", "s.pdm"), _next("m", "s.mdm")), 1 / 14))}


@register("adx", ewm_sql(ADX_COLS, ATR_CTE + DM, "d2") + """
SELECT symbol, ts, ax AS adx, coalesce(p / atr14 * 100, 0e0) AS plus_di,
       coalesce(m / atr14 * 100, 0e0) AS minus_di
FROM e JOIN d2 USING (symbol, rn)""", "adx plus_di minus_di", digits=4)
def adx(spark, d):
    return ind.adx(bars_series(spark, d))


@register("ma_cross_flags", ewm_sql(ema_columns(9, 21)) + f""",
c AS (SELECT *, CAST({full_sql('avg', 'close', 20)} > {full_sql('avg', 'close', 50)} AS INTEGER) AS x
      FROM b)
SELECT symbol, ts, x AS sma_20_50_cross, CAST(e9 > e21 AS INTEGER) AS ema_9_21_cross
FROM e JOIN c USING (symbol, rn)""")
def ma_cross_flags(spark, d):
    return ind.ma_cross_flags(bars_series(spark, d))
