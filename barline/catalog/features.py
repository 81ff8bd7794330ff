"""Feature tables: all indicators, differencing, z-scores, selection and the long store."""

from __future__ import annotations

from barline.catalog.base import BARS, full_sql, lag_sql, register, zscore_sql
from barline.catalog.indicators import (
    ADX_COLS, ATR_CTE, DM, GL, MACD_COLS, MOM, RSI_COLS, SQUEEZE_OUT, ema_columns, ewm_sql,
    rsi_sql,
)
from barline.catalog.indicators import step
from barline.operators import features as feat
from barline.operators import ffd as ffd_ops
from barline.sources.derived import bars_series

WEIGHTS = """weights AS (
  SELECT 0 AS k, CAST(1 AS DOUBLE) AS w
  UNION ALL
  SELECT k + 1, -w * ({d}e0 - (k + 1) + 1) / (k + 1) FROM weights
  WHERE abs(w * ({d}e0 - (k + 1) + 1) / (k + 1)) >= 1e-5)"""


def conv_sql(src: str, columns: list[str]) -> str:
    """Kernel-weighted sums per row of ``src``; NULL unless the kernel is full."""
    lists = ", ".join(f"list(coalesce({c}, 0e0)) OVER k AS l_{c}, count({c}) OVER k AS c_{c}"
                      for c in columns)
    sums = ", ".join(f"CASE WHEN c_{c} = width THEN list_dot_product(l_{c}, w) END AS {c}_ffd"
                     for c in columns)
    return f"""SELECT symbol, rn, {sums}
  FROM (SELECT symbol, rn, (SELECT list(w ORDER BY k DESC) FROM weights) AS w, width, {lists}
        FROM {src} CROSS JOIN (SELECT count(*) AS width FROM weights)
        WINDOW k AS (PARTITION BY symbol ORDER BY rn
                     ROWS BETWEEN (SELECT count(*) - 1 FROM weights) PRECEDING AND CURRENT ROW))
  WHERE rn >= width - 1"""


NUM = "b AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY ts) - 1 AS rn FROM bars)"
FFD_SQL = f"""WITH RECURSIVE {WEIGHTS.format(d=0.8)}, {BARS}, {NUM}, c AS ({conv_sql('b', ['close', 'volume'])})
SELECT symbol, ts, close_ffd, volume_ffd FROM b LEFT JOIN c USING (symbol, rn)"""


@register("ffd", FFD_SQL, "close_ffd volume_ffd", digits=4)
def ffd(spark, d):
    return ffd_ops.ffd(bars_series(spark, d), ["close", "volume"], 0.8)


@register("ffd_conv", f"""SELECT symbol, ts, close_ffd FROM ({FFD_SQL}) WHERE close_ffd IS NOT NULL""",
          "close_ffd", digits=4)
def ffd_conv(spark, d):
    return ffd_ops.ffd_conv(bars_series(spark, d), "close", 0.8)


ALL_COLS = ema_columns(9, 20, 21) | MACD_COLS | RSI_COLS | ADX_COLS | {
    "mo": ("NULL", f"""CASE WHEN s.rn < 12 THEN NULL
   WHEN s.rn = 12 THEN s.mom ELSE {step('mo', 's.mom', 2 / 7)} END""")}
ALL_SRC = GL + ATR_CTE + DM + MOM + """,
src AS (SELECT b.*, gain, loss, pdm, mdm, a.atr14, a.atr20, mom, mid, sd
        FROM b JOIN g USING (symbol, rn) JOIN d2 USING (symbol, rn) JOIN m USING (symbol, rn)
        JOIN a ON a.symbol = b.symbol AND a.ts = b.ts)"""
HH, LL = full_sql("max", "high", 14), full_sql("min", "low", 14)
RUN = "OVER (PARTITION BY symbol ORDER BY ts)"
SMA = {p: full_sql("avg", "close", p) for p in (20, 50, 200)}
ALL_INDICATORS = ewm_sql(ALL_COLS, ALL_SRC, "src") + f""",
o AS (SELECT symbol, rn, sum((high + low + close) / 3 * volume) {RUN} / nullif(sum(volume) {RUN}, 0) AS vw,
   coalesce(sign(close - {lag_sql('close', 1)}), 0) * volume AS sv,
   coalesce((close - {LL}) / nullif({HH} - {LL}, 0) * 100, 50e0) AS stoch_k,
   coalesce(({HH} - close) / nullif({HH} - {LL}, 0) * -100, -50e0) AS williams_r,
   coalesce(volume / nullif({full_sql('avg', 'volume', 20)}, 0), 1e0) AS volume_ratio,
   {SMA[20]} AS sma_20, {SMA[50]} AS sma_50, {SMA[200]} AS sma_200,
   {", ".join(f"coalesce((close / {lag_sql('close', p)} - 1) * 100, 0e0) AS roc_{p}" for p in (12, 63))},
   {", ".join(f"coalesce(close / {lag_sql('close', p)} - 1, 0e0) AS return_{p}d" for p in (1, 5, 20))}
   FROM b),
z AS (SELECT src.symbol, src.ts, src.rn, open, high, low, close, volume, sma_20, sma_50, sma_200,
   e9 AS ema_9, e21 AS ema_21, {rsi_sql(14)} AS rsi, {rsi_sql(63)} AS rsi_63, roc_12, roc_63,
   coalesce((e12 - e26) / nullif(e26, 0) * 100, 0e0) AS ppo, williams_r, stoch_k,
   coalesce(CASE WHEN src.rn >= 2 THEN avg(stoch_k) OVER (PARTITION BY src.symbol ORDER BY src.rn
     ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) END, 50e0) AS stoch_d, {SQUEEZE_OUT},
   e12 - e26 AS macd, sig AS macd_signal, e12 - e26 - sig AS macd_histogram, ax AS adx,
   coalesce(p / atr14 * 100, 0e0) AS plus_di, coalesce(m / atr14 * 100, 0e0) AS minus_di,
   mid + 2 * sd AS bb_upper, mid AS bb_middle, mid - 2 * sd AS bb_lower,
   coalesce(CASE WHEN sd > 0 THEN (close - (mid - 2 * sd)) / (4 * sd) END, 5e-1) AS bb_pct_b,
   e20 + 2 * atr20 AS kc_upper, e20 AS kc_middle, e20 - 2 * atr20 AS kc_lower, atr14 AS atr,
   coalesce(atr14 / close * 100, 0e0) AS natr,
   CAST(sum(sv) OVER (PARTITION BY src.symbol ORDER BY src.rn) AS DOUBLE) AS obv,
   coalesce((close - vw) / nullif(vw, 0) * 100, 0e0) AS vwap_dev, volume_ratio,
   {", ".join(f"(close - sma_{p}) / sma_{p} * 100 AS price_sma{p}_pct" for p in (20, 50, 200))},
   CAST(sma_20 > sma_50 AS INTEGER) AS sma_20_50_cross, CAST(e9 > e21 AS INTEGER) AS ema_9_21_cross,
   return_1d, return_5d, return_20d
  FROM src JOIN e USING (symbol, rn) JOIN o USING (symbol, rn))"""
INTS = {"squeeze", "sma_20_50_cross", "ema_9_21_cross"}
PRICES = "open high low close"
BASE_DOUBLES = " ".join(c for c in feat.BASE if c not in INTS)
BAR_LIST = "symbol, ts, open, high, low, close, volume"


@register("all_indicators", f"{ALL_INDICATORS} SELECT {BAR_LIST}, {', '.join(feat.BASE)} FROM z",
          f"{PRICES} {BASE_DOUBLES}", digits=4)
def all_indicators(spark, d):
    return feat.all_indicators(bars_series(spark, d))


@register("drop_warmup", f"{ALL_INDICATORS} SELECT symbol, ts, close, rsi, macd, atr FROM z "
          "WHERE close IS NOT NULL AND rsi IS NOT NULL AND macd IS NOT NULL AND atr IS NOT NULL",
          "close rsi macd atr", digits=4)
def drop_warmup(spark, d):
    return feat.drop_warmup(feat.all_indicators(bars_series(spark, d))).select(
        "symbol", "ts", "close", "rsi", "macd", "atr")


ML = ALL_INDICATORS.replace("WITH RECURSIVE ", f"WITH RECURSIVE {WEIGHTS.format(d=0.5)}, ", 1) + f""",
c AS ({conv_sql('z', feat.FFD)}),
f AS (SELECT z.*, {', '.join(f'{c}_ffd' for c in feat.FFD)},
        {', '.join(f"{zscore_sql(c, 252)} AS {c}_zscore" for c in feat.ZSCORE)}
      FROM z LEFT JOIN c USING (symbol, rn))
"""
ML_DOUBLES = " ".join(c for c in feat.feature_names() if c not in INTS)


@register("ml_features", f"{ML} SELECT {BAR_LIST}, {', '.join(feat.feature_names())} FROM f WHERE atr IS NOT NULL",
          f"{PRICES} {ML_DOUBLES}", digits=4)
def ml_features(spark, d):
    return feat.ml_features(bars_series(spark, d))


TOP = feat.select_top_features(feat.feature_names(), 45)


@register("project_features", f"{ML} SELECT symbol, ts, {', '.join(TOP)} FROM f WHERE atr IS NOT NULL",
          " ".join(c for c in TOP if c not in INTS), digits=4)
def project_features(spark, d):
    return feat.project_features(feat.ml_features(bars_series(spark, d)), 45)
