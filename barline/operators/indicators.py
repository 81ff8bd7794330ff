"""Technical indicators over bars, one plan for all symbols.

Column builders take the block window ``w`` and are composed by the operators below; operators
take a bars frame and return (symbol, ts, values).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, WindowSpec
from pyspark.sql import functions as F

from barline.functions import bounded, filled, full, ratio, zero_if_null
from barline.functions.cols import rows
from barline.operators.ewm import Ewm, add_ewm, ewm_halo, span_alpha
from barline.plans.series import block_window, core_rows, in_blocks, number_rows, running

KEY = ["symbol", "ts"]


# ---- column builders -------------------------------------------------------------------------

def sma_col(period: int, x: str = "close", w: WindowSpec | None = None) -> Column:
    f = rows(w or block_window(), period)
    return full(F.avg(x).over(f), x, f, period)


def std_col(period: int, x: str = "close", w: WindowSpec | None = None) -> Column:
    """Sample deviation; exactly 0 on a constant window."""
    f = rows(w or block_window(), period)
    sd = F.when(F.min(x).over(f) < F.max(x).over(f), F.stddev_samp(x).over(f)).otherwise(0.0)
    return full(sd, x, f, period)


def high_col(period: int, w: WindowSpec | None = None) -> Column:
    f = rows(w or block_window(), period)
    return full(F.max("high").over(f), "high", f, period)


def low_col(period: int, w: WindowSpec | None = None) -> Column:
    f = rows(w or block_window(), period)
    return full(F.min("low").over(f), "low", f, period)


def lagged(x: str, n: int, w: WindowSpec | None = None) -> Column:
    return F.lag(x, n).over(w or block_window())


def change(n: int, x: str = "close", w: WindowSpec | None = None) -> Column:
    """x / x[-n] - 1, NULL on the first n rows."""
    return ratio(F.col(x) - lagged(x, n, w), lagged(x, n, w))


def true_range(w: WindowSpec | None = None) -> Column:
    prev = lagged("close", 1, w)
    # greatest skips NULL, so the first row of a series is high - low
    return F.greatest(F.col("high") - F.col("low"), F.abs(F.col("high") - prev),
                      F.abs(F.col("low") - prev))


def stoch_raw(period: int) -> Column:
    return filled(ratio(F.col("close") - low_col(period),
                        high_col(period) - low_col(period)) * 100, 50.0)


def zscore_col(x: str, window: int, w: WindowSpec | None = None) -> Column:
    f = rows(w or block_window(), window)
    z = ratio(F.col(x) - F.avg(x).over(f), F.stddev_samp(x).over(f))
    return zero_if_null(F.when((F.count(x).over(f) == window)
                               & (F.min(x).over(f) < F.max(x).over(f)), z))


def with_atr(df: DataFrame, *periods: int) -> DataFrame:
    df = df.withColumn("_tr", true_range())
    return df.select("*", *[sma_col(p, "_tr").alias(f"_atr_{p}") for p in periods])


def _out(df: DataFrame, *cols: str) -> DataFrame:
    return core_rows(df).select(*KEY, *cols)


# ---- plain rolling windows -------------------------------------------------------------------

def sma(bars: DataFrame, *periods: int, block_rows: int | None = None) -> DataFrame:
    df = in_blocks(bars, max(periods) - 1, block_rows=block_rows)
    df = df.select("*", *[sma_col(p).alias(f"sma_{p}") for p in periods])
    return _out(df, *[f"sma_{p}" for p in periods])


def with_bollinger(df: DataFrame, period: int = 20, width: float = 2.0) -> DataFrame:
    df = df.withColumns({"bb_middle": sma_col(period), "_bb_sd": std_col(period)})
    mid, reach = F.col("bb_middle"), F.col("_bb_sd") * width
    # the exact zero test keeps rounding noise out of 0/0
    pct = ratio(F.col("close") - (mid - reach), reach * 2)
    return df.withColumns({"bb_upper": mid + reach, "bb_lower": mid - reach,
                           "bb_pct_b": filled(F.when(F.col("_bb_sd") > 0, pct), 0.5)})


def bollinger(bars: DataFrame, period: int = 20, width: float = 2.0,
              block_rows: int | None = None) -> DataFrame:
    df = with_bollinger(in_blocks(bars, period - 1, block_rows=block_rows), period, width)
    return _out(df, "close", "bb_upper", "bb_middle", "bb_lower", "bb_pct_b")


def upper_band_crossings(bars: DataFrame) -> DataFrame:
    """Bars that close above the upper Bollinger band, per symbol."""
    return (bollinger(bars).groupBy("symbol")
            .agg(F.count(F.lit(1)).alias("bars"),
                 F.sum(F.when(F.col("close") > F.col("bb_upper"), 1).otherwise(0))
                 .alias("above_upper"),
                 F.avg("bb_pct_b").alias("avg_pct_b")))


def atr(bars: DataFrame, period: int = 14, block_rows: int | None = None) -> DataFrame:
    df = with_atr(in_blocks(bars, period, block_rows=block_rows), period)
    return _out(df.withColumnRenamed(f"_atr_{period}", "atr"), "atr")


def natr(bars: DataFrame, period: int = 14, block_rows: int | None = None) -> DataFrame:
    df = with_atr(in_blocks(bars, period, block_rows=block_rows), period)
    return _out(df.withColumn("natr", zero_if_null(ratio(f"_atr_{period}", "close") * 100)), "natr")


def roc(bars: DataFrame, *periods: int, block_rows: int | None = None) -> DataFrame:
    df = in_blocks(bars, max(periods), block_rows=block_rows)
    df = df.select("*", *[zero_if_null(change(p) * 100).alias(f"roc_{p}") for p in periods])
    return _out(df, *[f"roc_{p}" for p in periods])


def with_stochastic(df: DataFrame, k: int = 14, d: int = 3) -> DataFrame:
    df = df.withColumn("stoch_k", stoch_raw(k))
    return df.withColumn("stoch_d", filled(sma_col(d, "stoch_k"), 50.0))


def stochastic(bars: DataFrame, k: int = 14, d: int = 3, block_rows: int | None = None) -> DataFrame:
    return _out(with_stochastic(in_blocks(bars, k + d, block_rows=block_rows), k, d),
                "stoch_k", "stoch_d")


def williams_col(period: int = 14) -> Column:
    return filled(ratio(high_col(period) - F.col("close"),
                        high_col(period) - low_col(period)) * -100, -50.0)


def williams_r(bars: DataFrame, period: int = 14, block_rows: int | None = None) -> DataFrame:
    df = in_blocks(bars, period - 1, block_rows=block_rows)
    return _out(df.withColumn("williams_r", williams_col(period)), "williams_r")


def with_obv_vwap(bars: DataFrame, block_rows: int | None = None) -> DataFrame:
    """Whole-series running volume columns; keeps every input column and adds ``rn``."""
    df = in_blocks(bars, 1, block_rows=block_rows)
    move = F.col("close") - lagged("close", 1)
    df = df.withColumn("_signed", zero_if_null(F.signum(move)) * F.col("volume"))
    df = df.filter("core").drop("core", "sub")  # blk stays: running totals reuse its partitions
    typical = (F.col("high") + F.col("low") + F.col("close")) / 3
    df = running(df, {"obv": ("sum", F.col("_signed").cast("double")),
                      "_pv": ("sum", typical * F.col("volume")),
                      "_v": ("sum", F.col("volume").cast("double"))}, block_rows=block_rows)
    vwap = ratio("_pv", "_v")
    df = df.withColumn("vwap_dev", zero_if_null(ratio(F.col("close") - vwap, vwap) * 100))
    return df.drop("_signed", "_pv", "_v", "blk")


def obv(bars: DataFrame, block_rows: int | None = None) -> DataFrame:
    return with_obv_vwap(bars, block_rows).select(*KEY, "obv")


def vwap_dev(bars: DataFrame, session: Column | None = None,
             block_rows: int | None = None) -> DataFrame:
    """Deviation from the volume-weighted price, cumulative over the series or per session."""
    keys = ["symbol"]
    df = bars
    if session is not None:
        df, keys = df.withColumn("_session", session), ["symbol", "_session"]
    df = number_rows(df, keys)
    typical = (F.col("high") + F.col("low") + F.col("close")) / 3
    df = running(df, {"_pv": ("sum", typical * F.col("volume")),
                      "_v": ("sum", F.col("volume").cast("double"))}, keys, block_rows)
    vwap = ratio("_pv", "_v")
    return df.select(*KEY, zero_if_null(ratio(F.col("close") - vwap, vwap) * 100).alias("vwap_dev"))


def volume_ratio_col(period: int = 20) -> Column:
    return filled(ratio("volume", sma_col(period, "volume")), 1.0)


def volume_ratio(bars: DataFrame, period: int = 20, block_rows: int | None = None) -> DataFrame:
    df = in_blocks(bars, period - 1, block_rows=block_rows)
    return _out(df.withColumn("volume_ratio", volume_ratio_col(period)), "volume_ratio")


def donchian(bars: DataFrame, period: int = 20, block_rows: int | None = None) -> DataFrame:
    df = in_blocks(bars, period - 1, block_rows=block_rows)
    df = df.withColumn("dc_upper", high_col(period)).withColumn("dc_lower", low_col(period))
    return _out(df.withColumn("dc_middle", (F.col("dc_upper") + F.col("dc_lower")) / 2),
                "dc_upper", "dc_middle", "dc_lower")


def returns(bars: DataFrame, *horizons: int, block_rows: int | None = None) -> DataFrame:
    df = in_blocks(bars, max(horizons), block_rows=block_rows)
    df = df.select("*", *[zero_if_null(change(h)).alias(f"return_{h}d") for h in horizons])
    return _out(df, *[f"return_{h}d" for h in horizons])


def price_vs_ma(bars: DataFrame, *periods: int, block_rows: int | None = None) -> DataFrame:
    df = in_blocks(bars, max(periods) - 1, block_rows=block_rows)
    for p in periods:
        df = df.withColumn(f"price_sma{p}_pct",
                           ratio(F.col("close") - sma_col(p), sma_col(p)) * 100)
    return _out(df, *[f"price_sma{p}_pct" for p in periods])


def signal_norm(df: DataFrame, x: str, lookback: int = 20, keys=("symbol",), order=("ts",),
                block_rows: int | None = None) -> DataFrame:
    """z-score against the last ``lookback`` values (population sd), clipped at 3 and scaled to 1.

    With fewer than 5 values the raw value is clipped to 1; constant history gives 0.
    """
    d = in_blocks(df, lookback - 1, keys=keys, order=order, block_rows=block_rows)
    f = rows(block_window(keys), lookback)
    z = ratio(F.col(x) - F.avg(x).over(f), F.stddev_pop(x).over(f))
    value = (F.when(F.count(x).over(f) < 5, bounded(x, -1.0, 1.0))
             .when(F.min(x).over(f) < F.max(x).over(f), bounded(z, -3.0, 3.0) / 3)
             .otherwise(0.0))
    return core_rows(d.withColumn("signal_norm", value)).select(*keys, *order, "signal_norm")


# ---- exponential averages --------------------------------------------------------------------

def ema(bars: DataFrame, *periods: int, x: str = "close", block_rows: int | None = None) -> DataFrame:
    halo = max(ewm_halo(span_alpha(p)) for p in periods)
    df = in_blocks(bars if x == "close" else bars.drop("vn"), halo, block_rows=block_rows, values=x)
    df = add_ewm(df, {f"ema_{p}": Ewm(F.col(x), span_alpha(p)) for p in periods})
    return _out(df, *[f"ema_{p}" for p in periods])


def gain_loss(df: DataFrame) -> DataFrame:
    delta = zero_if_null(F.col("close") - lagged("close", 1))
    return df.withColumns({"_gain": F.greatest(delta, F.lit(0.0)),
                           "_loss": F.greatest(-delta, F.lit(0.0))})


def rsi_specs(*periods: int) -> dict[str, Ewm]:
    specs = {}
    for p in periods:
        specs[f"_gain_{p}"] = Ewm(F.col("_gain"), 1.0 / p)
        specs[f"_loss_{p}"] = Ewm(F.col("_loss"), 1.0 / p)
    return specs


def rsi_col(p: int) -> Column:
    # no losses so far: relative strength counts as 1, so the index is 50
    return 100.0 - 100.0 / (1.0 + filled(ratio(f"_gain_{p}", f"_loss_{p}"), 1.0))


def rsi(bars: DataFrame, *periods: int, block_rows: int | None = None) -> DataFrame:
    df = in_blocks(bars, max(ewm_halo(1.0 / p) for p in periods) + 1, block_rows=block_rows)
    df = add_ewm(gain_loss(df), rsi_specs(*periods))
    df = df.select("*", *[rsi_col(p).alias(f"rsi_{p}") for p in periods])
    return _out(df, *[f"rsi_{p}" for p in periods])


def macd(bars: DataFrame, fast: int = 12, slow: int = 26, signal: int = 9,
         block_rows: int | None = None) -> DataFrame:
    halo = ewm_halo(span_alpha(slow)) + ewm_halo(span_alpha(signal))
    df = in_blocks(bars, halo, block_rows=block_rows, values="close")
    df = add_ewm(df, {"_fast_ema": Ewm(F.col("close"), span_alpha(fast)),
                      "_slow_ema": Ewm(F.col("close"), span_alpha(slow))})
    df = df.withColumn("macd", F.col("_fast_ema") - F.col("_slow_ema"))
    df = add_ewm(df, {"macd_signal": Ewm(F.col("macd"), span_alpha(signal))})
    df = df.withColumn("macd_histogram", F.col("macd") - F.col("macd_signal"))
    return _out(df, "macd", "macd_signal", "macd_histogram")


def ppo(bars: DataFrame, fast: int = 12, slow: int = 26, block_rows: int | None = None) -> DataFrame:
    df = in_blocks(bars, ewm_halo(span_alpha(slow)), block_rows=block_rows, values="close")
    df = add_ewm(df, {"_fast_ema": Ewm(F.col("close"), span_alpha(fast)),
                      "_slow_ema": Ewm(F.col("close"), span_alpha(slow))})
    return _out(df.withColumn("ppo", ppo_col("_fast_ema", "_slow_ema")), "ppo")


def ppo_col(fast: str, slow: str) -> Column:
    return zero_if_null(ratio(F.col(fast) - F.col(slow), F.col(slow)) * 100)


def keltner(bars: DataFrame, period: int = 20, width: float = 2.0,
            block_rows: int | None = None) -> DataFrame:
    df = in_blocks(bars, ewm_halo(span_alpha(period)), block_rows=block_rows, values="close")
    df = add_ewm(with_atr(df, period), {"kc_middle": Ewm(F.col("close"), span_alpha(period))})
    reach = F.col(f"_atr_{period}") * width
    df = (df.withColumn("kc_upper", F.col("kc_middle") + reach)
          .withColumn("kc_lower", F.col("kc_middle") - reach))
    return _out(df, "kc_upper", "kc_middle", "kc_lower")


MOMENTUM_ROWS, MOMENTUM_SMOOTH = 12, 6


def squeeze_columns(df: DataFrame, atr_name: str = "_atr_20", mid: str = "kc_middle") -> DataFrame:
    """Needs Bollinger bands, the channel middle, its ATR and ``_mom_ewm``."""
    def inside(mult):
        return ((F.col("bb_upper") < F.col(mid) + F.col(atr_name) * mult)
                & (F.col("bb_lower") > F.col(mid) - F.col(atr_name) * mult))
    return df.withColumns({
        "squeeze": inside(1.5).cast("int"),
        "squeeze_pro": F.when(inside(1.0), 1.0).when(inside(1.5), 0.5).otherwise(0.0),
        "squeeze_momentum": zero_if_null("_mom_ewm")})


def momentum_spec() -> Ewm:
    return Ewm(F.col("_mom"), span_alpha(MOMENTUM_SMOOTH), start=MOMENTUM_ROWS)


def squeeze_pro(bars: DataFrame, block_rows: int | None = None) -> DataFrame:
    df = in_blocks(bars, ewm_halo(span_alpha(20)) + MOMENTUM_ROWS, block_rows=block_rows, values="close")
    df = with_bollinger(with_atr(df, 20))
    df = df.withColumn("_mom", F.col("close") - lagged("close", MOMENTUM_ROWS))
    df = add_ewm(df, {"kc_middle": Ewm(F.col("close"), span_alpha(20)),
                      "_mom_ewm": momentum_spec()})
    return _out(squeeze_columns(df), "squeeze", "squeeze_pro", "squeeze_momentum")


def directional_moves(df: DataFrame) -> DataFrame:
    up = zero_if_null(F.when(F.col("rn") > 0, F.greatest(F.col("high") - lagged("high", 1), F.lit(0.0))))
    down = zero_if_null(F.when(F.col("rn") > 0, F.greatest(lagged("low", 1) - F.col("low"), F.lit(0.0))))
    df = df.withColumns({"_up": up, "_down": down})
    # on a tie the upward move is zeroed first and the downward one survives
    return df.withColumns({
        "_pdm": F.when(F.col("_up") > F.col("_down"), F.col("_up")).otherwise(0.0),
        "_mdm": F.when(F.col("_down") >= F.col("_up"), F.col("_down")).otherwise(0.0)})


def di_columns(df: DataFrame, period: int = 14, **more: Column) -> DataFrame:
    df = df.withColumns({"_pdi": ratio("_pdm_ewm", f"_atr_{period}") * 100,
                         "_mdi": ratio("_mdm_ewm", f"_atr_{period}") * 100, **more})
    return df.withColumn("_dx", zero_if_null(
        ratio(F.abs(F.col("_pdi") - F.col("_mdi")), F.col("_pdi") + F.col("_mdi")) * 100))


def adx(bars: DataFrame, period: int = 14, block_rows: int | None = None) -> DataFrame:
    a = 1.0 / period
    df = in_blocks(bars, 2 * ewm_halo(a) + period, block_rows=block_rows)
    df = add_ewm(directional_moves(with_atr(df, period)),
                 {"_pdm_ewm": Ewm(F.col("_pdm"), a), "_mdm_ewm": Ewm(F.col("_mdm"), a)})
    df = add_ewm(di_columns(df, period), {"adx": Ewm(F.col("_dx"), a)})
    df = (df.withColumn("plus_di", zero_if_null("_pdi"))
          .withColumn("minus_di", zero_if_null("_mdi")))
    return _out(df, "adx", "plus_di", "minus_di")


def ma_cross_flags(bars: DataFrame, block_rows: int | None = None) -> DataFrame:
    df = in_blocks(bars, ewm_halo(span_alpha(21)), block_rows=block_rows, values="close")
    df = add_ewm(df, {"ema_9": Ewm(F.col("close"), span_alpha(9)),
                      "ema_21": Ewm(F.col("close"), span_alpha(21))})
    df = (df.withColumn("sma_20_50_cross", (sma_col(20) > sma_col(50)).cast("int"))
          .withColumn("ema_9_21_cross", (F.col("ema_9") > F.col("ema_21")).cast("int")))
    return _out(df, "sma_20_50_cross", "ema_9_21_cross")


def zscore(bars: DataFrame, x: str = "close", window: int = 252,
           block_rows: int | None = None) -> DataFrame:
    df = in_blocks(bars, window - 1, block_rows=block_rows)
    return _out(df.withColumn(f"{x}_zscore", zscore_col(x, window)), f"{x}_zscore")


def hist_volatility(bars: DataFrame) -> DataFrame:
    """Coefficient of variation of close over the whole history."""
    sd = F.when(F.min("close") < F.max("close"), F.stddev_samp("close")).otherwise(0.0)
    return bars.groupBy("symbol").agg(ratio(sd, F.avg("close")).alias("volatility"),
                                      F.count(F.lit(1)).alias("bars"))


def latest_row(df: DataFrame, key: str = "symbol", ts: str = "ts") -> DataFrame:
    """Newest row per key, without a window over the key."""
    rest = [c for c in df.columns if c != key]
    newest = df.groupBy(key).agg(F.max_by(F.struct(*rest), ts).alias("_r"))
    return newest.select(key, "_r.*")
