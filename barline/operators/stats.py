"""Backtest statistics: Sharpe family, overfitting, trade performance, metric summaries."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from barline.functions import corr_agg, norm_cdf, norm_ppf, ratio, zero_if_null
from barline.operators.folds import half_splits, in_mask
from barline.operators.tables import last_n, latest_wins
from barline.plans.ranks import quantiles, same
from barline.plans.series import number_rows, running
from barline.sources.stored import stage

EULER = 0.5772156649  # fixed value, in the digits the results must equal


def _vary(x: str) -> Column:
    return F.min(x) < F.max(x)


def sharpe_agg(x: str, periods: int = 252) -> Column:
    """Annualised mean over sample deviation; 0 for fewer than two rows or constant input."""
    return zero_if_null(F.when((F.count(x) >= 2) & _vary(x),
                               ratio(F.avg(x), F.stddev_samp(x)) * math.sqrt(periods)))


def skew_agg(x: str) -> Column:
    """Central moment over n, sigma with n - 1; 0 on constant input."""
    n = F.count(x).cast("double")
    return zero_if_null(F.when(_vary(x), F.skewness(x) * F.pow((n - 1) / n, F.lit(1.5))))


def kurtosis_agg(x: str) -> Column:
    n = F.count(x).cast("double")
    k = (F.kurtosis(x) + 3) * F.pow((n - 1) / n, F.lit(2.0))
    return F.coalesce(F.when(_vary(x), k), F.lit(3.0))


def sharpe(returns: DataFrame, keys: list[str], x: str = "ret", periods: int = 252) -> DataFrame:
    return returns.groupBy(*keys).agg(sharpe_agg(x, periods).alias("sharpe"),
                                      F.count(x).alias("rows"))


def return_moments(returns: DataFrame, keys: list[str], x: str = "ret") -> DataFrame:
    return returns.groupBy(*keys).agg(skew_agg(x).alias("skew"), kurtosis_agg(x).alias("kurtosis"))


def with_psr(df: DataFrame, benchmark: Column | float = 0.0, periods: int = 252) -> DataFrame:
    """Needs sharpe, skew, kurtosis, rows; adds ``psr``."""
    sr, skew, kurt = F.col("sharpe"), F.col("skew"), F.col("kurtosis")
    per = sr * sr / periods
    var = 1 + (1 + 0.5 * skew * skew) * per - skew * sr / math.sqrt(periods) + (kurt - 3) / 4 * per
    err = F.when(var > 0, F.sqrt(var / (F.col("rows") - 1)))
    bar = benchmark if isinstance(benchmark, Column) else F.lit(float(benchmark))
    z = ratio(sr - bar, err * math.sqrt(periods))
    out = df.withColumn("_z", F.when(F.col("rows") >= 2, z))
    return out.withColumn("psr", F.when(F.col("rows") < 2, 0.0).otherwise(norm_cdf("_z"))).drop("_z")


def _moments(returns: DataFrame, keys: list[str], x: str, periods: int) -> DataFrame:
    return returns.groupBy(*keys).agg(
        sharpe_agg(x, periods).alias("sharpe"), skew_agg(x).alias("skew"),
        kurtosis_agg(x).alias("kurtosis"), F.count(x).alias("rows"))


def psr(returns: DataFrame, keys: list[str], benchmark: float = 0.0, x: str = "ret",
        periods: int = 252) -> DataFrame:
    return with_psr(_moments(returns, keys, x, periods), benchmark, periods).select(*keys, "psr")


def dsr(returns: DataFrame, keys: list[str], x: str = "ret", periods: int = 252) -> DataFrame:
    """Deflated Sharpe ratio: every key is a trial; the bar is the expected best of all trials.

    With a single trial the expectation is undefined and the result NULL.
    """
    m = _moments(returns, keys, x, periods)
    trials = m.agg(F.avg("sharpe").alias("_m"), F.stddev_pop("sharpe").alias("_s"),
                   F.count(F.lit(1)).cast("double").alias("_n"))
    trials = (trials.withColumn("_p1", 1 - ratio(F.lit(1.0), "_n"))
              .withColumn("_p2", 1 - ratio(F.lit(1.0), F.col("_n") * math.e)))
    best = F.col("_m") + F.col("_s") * ((1 - EULER) * norm_ppf("_p1") + EULER * norm_ppf("_p2"))
    trials = trials.select(best.alias("expected_max"))  # one row
    out = with_psr(m.join(F.broadcast(trials)), F.col("expected_max"), periods)
    return out.select(*keys, "sharpe", "expected_max",
                      F.when(F.col("expected_max").isNotNull(), F.col("psr")).alias("dsr"))


def pbo(spark: SparkSession, returns: DataFrame, parts: int = 16, limit: int | None = None,
        x: str = "ret") -> DataFrame:
    """Probability of backtest overfitting by combinatorially symmetric splits.

    ``returns`` holds (ts, trial, x) for the same time steps of every trial. Only one row per trial
    with count, sum and square sum per segment meets the splits, never the returns themselves: all
    splits, or ``limit`` of them. Fewer time steps than parts, or a single trial, give 0.
    """
    steps = number_rows(returns.select("ts").distinct(), keys=(), name="t", with_total=True)
    rows = returns.join(steps.filter(F.col("n") >= parts), "ts")
    size = F.greatest(F.floor(F.col("n") / parts), F.lit(1))
    seg = F.least(F.floor(F.col("t") / size), F.lit(parts - 1)).cast("int")
    def sums(i):
        own = F.when(seg == i, F.col(x))
        return F.struct(F.count(own).cast("double").alias("c"), F.coalesce(F.sum(own), F.lit(0.0)).alias("s"),
                        F.coalesce(F.sum(own * own), F.lit(0.0)).alias("q"))

    m = stage(rows.groupBy("trial").agg(F.array(*map(sums, range(parts))).alias("segs")), "trial-segments")
    masks = half_splits(spark, parts, limit).agg(F.collect_list("mask").alias("masks"))
    # one row with an array of masks, as many as `parts` allows
    m = m.join(F.broadcast(masks)).withColumn("mask", F.explode("masks")).drop("masks")

    def side(k, bit):
        return sum((F.when(in_mask("mask", str(i)) == bit, F.col("segs")[i][k]).otherwise(0.0)
                    for i in range(parts)), F.lit(0.0))

    def sr(bit):
        c, s, q = (side(k, bit) for k in "csq")
        var = ratio(q - ratio(s * s, c), c - 1)
        return F.when(var > 0, ratio(ratio(s, c), F.sqrt(var)))

    per_mask = Window.partitionBy("mask")
    best = F.max(F.when(F.col("sr_in").isNotNull(), F.struct("sr_in", "sr_out"))).over(per_mask)
    per = m.select("mask", "trial", sr(True).alias("sr_in"), sr(False).alias("sr_out"))
    rank = (per.withColumn("_best", best["sr_out"]).groupBy("mask").agg(
        (F.count(F.when(F.col("sr_out") < F.col("_best"), 1)) / F.count(F.lit(1))).alias("rank"),
        F.count(F.lit(1)).alias("trials")).filter("trials >= 2"))
    return rank.agg(zero_if_null(F.avg(F.when(F.col("rank") < 0.5, 1.0).otherwise(0.0))).alias("pbo"),
                    F.count(F.lit(1)).alias("splits"))


# ---- trades ----------------------------------------------------------------------------------

def equity_curve(trades: DataFrame, start: float = 100_000.0, scale: float = 1.0,
                 block_rows: int | None = None) -> DataFrame:
    """Running equity, its peak (at least the start) and drawdown per symbol."""
    df = trades if "rn" in trades.columns else number_rows(
        trades, ("symbol",), ("ts", "id"), bucket_seconds=86400, keep_bucket=block_rows is None)
    step = F.col("pnl") / scale
    df = running(df, {"_sum": ("sum", step), "_peak": ("peak", step)}, block_rows=block_rows)
    df = (df.withColumn("equity", F.col("_sum") + start)
          .withColumn("peak", F.greatest(F.col("_peak"), F.lit(0.0)) + start).drop("_sum", "_peak", "blk"))
    return df.withColumn("drawdown", ratio(F.col("peak") - F.col("equity"), "peak"))


def performance_stats(trades: DataFrame, start: float = 100_000.0, scale: float = 1.0) -> DataFrame:
    eq = equity_curve(trades.filter(F.col("pnl").isNotNull() & (F.col("pnl") != 0)), start, scale)
    win, loss = F.when(F.col("pnl") > 0, F.col("pnl")), F.when(F.col("pnl") < 0, F.col("pnl"))
    return eq.groupBy("symbol").agg(
        F.count(F.lit(1)).alias("trades"), (F.count(win) * 100 / F.count(F.lit(1))).alias("win_rate"),
        zero_if_null(F.avg(win)).alias("avg_win"), zero_if_null(F.avg(loss)).alias("avg_loss"),
        zero_if_null(F.abs(ratio(F.sum(win), F.sum(loss)))).alias("profit_factor"),
        F.avg("pnl").alias("mean_trade"),
        (F.greatest(F.max("drawdown"), F.lit(0.0)) * 100).alias("max_drawdown"))


def histogram(df: DataFrame, x: str, bins: int = 30, key: str = "symbol") -> DataFrame:
    """Equal-width bins over each key's range; the last bin is closed."""
    span = df.groupBy(key).agg(F.min(x).alias("_lo"), F.max(x).alias("_hi"))
    width = (F.col("_hi") - F.col("_lo")) / bins
    pos = F.coalesce(F.floor(ratio(F.col(x) - F.col("_lo"), width)), F.lit(0))
    out = df.join(span, key).groupBy(key, F.least(pos, F.lit(bins - 1)).cast("int").alias("bin"))
    return out.agg(F.count(F.lit(1)).alias("rows"))


def portfolio_summary(positions: DataFrame, capital: float) -> DataFrame:
    """Open positions per symbol with unrealised pnl, value, weight, and the cash left."""
    move = (F.col("current_price") - F.col("entry_price")) * F.col("quantity")
    signed = F.when(F.col("position_type") == "SHORT", -move).otherwise(move)
    per = positions.filter("status = 'OPEN'").groupBy("symbol").agg(
        F.count(F.lit(1)).alias("positions"), F.sum(signed).alias("unrealised_pnl"),
        F.sum(F.col("current_price") * F.col("quantity")).alias("value"))
    total = per.agg(F.sum("value").alias("_total"))  # one row
    return per.join(F.broadcast(total)).select(
        "symbol", "positions", "unrealised_pnl", "value",
        zero_if_null(ratio("value", "_total") * 100).alias("weight_pct"),
        (F.lit(capital) - F.col("_total")).alias("cash"))


# ---- model metrics ---------------------------------------------------------------------------

def confusion_metrics(df: DataFrame, keys: list[str], actual: str = "actual",
                      predicted: str = "predicted") -> DataFrame:
    a, p = F.col(actual), F.col(predicted)

    def n(cond):
        return F.count(F.when(cond, 1))
    c = df.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("rows"), n(a == p).alias("_ok"), n((p == 1) & (a == 1)).alias("_tp"),
        n((p == 1) & (a == 0)).alias("_fp"), n((p == 0) & (a == 1)).alias("_fn"),
        n(a == 1).alias("buy"), n(a == 0).alias("sell"))
    prec = zero_if_null(ratio("_tp", F.col("_tp") + F.col("_fp")))
    rec = zero_if_null(ratio("_tp", F.col("_tp") + F.col("_fn")))
    return c.select(*keys, "rows", "buy", "sell", zero_if_null(ratio("_ok", "rows")).alias("accuracy"),
                    prec.alias("precision"), rec.alias("recall"),
                    zero_if_null(ratio(2 * prec * rec, prec + rec)).alias("f1_score"))


def horizon_metrics(df: DataFrame, keys: list[str], predicted: str = "score",
                    actual: str = "actual") -> DataFrame:
    e = F.col(predicted) - F.col(actual)
    return df.groupBy(*keys).agg(
        F.avg(e * e).alias("mse"), F.avg(F.abs(e)).alias("mae"), F.sqrt(F.avg(e * e)).alias("rmse"),
        corr_agg(predicted, actual).alias("ic"))


# ---- operational metrics ---------------------------------------------------------------------

def metric_stats(metrics: DataFrame, keys: list[str], newest: int = 1000) -> DataFrame:
    """Summary of the newest values per metric (and labels)."""
    last = last_n(metrics, newest, keys, ["ts", "id"], F.date_trunc("day", "ts"))
    v = "metric_value"
    facts = last.groupBy(*keys).agg(
        F.count(v).alias("n"), F.sum(v).alias("total"), F.min(v).alias("lo"), F.max(v).alias("hi"), F.avg(v).alias("mean"))
    at = quantiles(last.select(*keys, v), keys, v, {f"p{q}": q / 100 for q in (50, 95, 99)})
    out = facts.alias("f").join(at.alias("q"), same("f", "q", keys), "left")
    return out.select("f.*", *[f"q.p{q}" for q in (50, 95, 99)])


def counter_gauge(metrics: DataFrame) -> DataFrame:
    """Counters add up, gauges keep their newest value."""
    total = metrics.groupBy("metric_name").agg(F.sum("metric_value").alias("counter"))
    last = latest_wins(metrics.select("metric_name", "ts", "id", "metric_value"), ["metric_name"],
                       [F.col("ts"), F.col("id")])
    return total.join(last.select("metric_name", F.col("metric_value").alias("gauge")), "metric_name")


def share_over(df: DataFrame, x: str, *keys: str) -> Column:
    return ratio(x, F.sum(x).over(Window.partitionBy(*keys)))
