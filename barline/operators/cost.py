"""Execution cost and order schedules over an orders table."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barline.functions import ratio, zero_if_null
from barline.functions.cols import rows
from barline.operators.tables import between
from barline.plans.series import block_window, core_rows, in_blocks

# Cost rates, and per order type the impact factor and extra slippage rate.
COMMISSION, SPREAD_BPS, IMPACT = 0.001, 5.0, 0.1
DAILY_VOLATILITY = 0.20 / math.sqrt(252)
MINUTES = 390
ORDER_TYPES = {"market": (1.0, 0.002), "limit": (0.5, 0.0), "vwap": (0.7, 0.001),
               "twap": (0.6, 0.001)}
PARTS = ["total_cost", "slippage", "market_impact", "commission", "spread_cost"]


def with_adv(bars: DataFrame, period: int = 20, block_rows: int | None = None) -> DataFrame:
    """Average volume over the last rows, a shorter history counting as it is."""
    df = in_blocks(bars, period - 1, block_rows=block_rows)
    adv = F.avg("volume").over(rows(block_window(), period))
    return core_rows(df.withColumn("adv", adv))


def _by_type(i: int) -> Column:
    out = F.lit(ORDER_TYPES["market"][i])
    for name, values in ORDER_TYPES.items():
        out = F.when(F.lower("order_type") == name, values[i]).otherwise(out)
    return out


def order_cost(orders: DataFrame) -> DataFrame:
    """Needs size, price, adv, urgency, order_type; adds the cost parts and their total."""
    df = orders.withColumn("order_value", F.col("size") * F.col("price"))
    df = df.withColumn("participation", zero_if_null(F.when(F.col("adv") > 0, ratio("size", "adv"))))
    root = F.sqrt("participation")
    slip = root * 0.01 + F.col("urgency") * 0.005 + _by_type(1)
    df = (df.withColumn("commission", F.col("order_value") * COMMISSION)
          .withColumn("spread_cost", F.col("order_value") * (SPREAD_BPS / 10000 / 2))
          .withColumn("market_impact", root * IMPACT * F.col("order_value")
                      * (0.5 + 0.5 * F.col("urgency")) * _by_type(0))
          .withColumn("slippage", F.col("order_value") * slip))
    df = df.withColumn("total_cost", F.col("commission") + F.col("spread_cost")
                       + F.col("market_impact") + F.col("slippage"))
    return df.withColumn("cost_pct", zero_if_null(ratio("total_cost", "order_value") * 100))


def cost_totals(costs: DataFrame, start=None, end=None) -> DataFrame:
    return between(costs, start, end).agg(
        *[zero_if_null(F.sum(c)).alias(f"{c}_sum") for c in PARTS],
        zero_if_null(F.sum("order_value")).alias("value_sum"), F.count(F.lit(1)).alias("orders"))


def cost_attribution(totals: DataFrame, gross_pnl: Column) -> DataFrame:
    cost = F.col("total_cost_sum")
    return (totals.withColumn("gross_pnl", gross_pnl)
            .withColumn("net_pnl", F.col("gross_pnl") - cost)
            .withColumn("pct_of_gross", zero_if_null(ratio(cost, F.abs(F.col("gross_pnl"))) * 100))
            .withColumn("pct_of_value", zero_if_null(ratio(cost, "value_sum") * 100)))


# ---- schedules: one row per order and step -----------------------------------------------------

def _steps(n: int) -> Column:
    return F.explode(F.sequence(F.lit(0), F.lit(n - 1)))


def twap_schedule(orders: DataFrame, steps: int = MINUTES) -> DataFrame:
    return orders.select("*", _steps(steps).alias("step")).withColumn("shares", F.col("size") / steps)


def ac_schedule(orders: DataFrame, days: float = 1.0, risk_aversion: float = 1.0,
                volatility: float = DAILY_VOLATILITY, steps_per_day: int = MINUTES) -> DataFrame:
    """Exponentially falling holdings; a slice is what the order sheds since the last step."""
    n = int(days * steps_per_day)
    rate = risk_aversion * volatility / IMPACT
    df = orders.select("*", _steps(n).alias("step"))
    dt = days / (n - 1)

    def held(step):
        return F.col("size") * F.exp(step * (-rate * dt))
    shares = F.when(F.col("step") == 0, F.lit(0.0)).otherwise(
        held(F.col("step") - 1) - held(F.col("step")))
    return df.withColumn("shares", F.greatest(shares, F.lit(0.0)))


def vwap_schedule(orders: DataFrame, profile: DataFrame, steps: int = MINUTES) -> DataFrame:
    """Order shares by expected volume. ``profile`` holds (symbol, idx, volume) at even spacing;
    other spacings are interpolated to ``steps`` points. No volume gives equal slices."""
    size = profile.groupBy("symbol").agg(F.count(F.lit(1)).alias("_m"))
    grid = size.select("symbol", "_m", _steps(steps).alias("step"))
    x = F.col("step") * (F.col("_m") - 1) / (steps - 1)
    grid = (grid.withColumn("_lo", F.floor(x)).withColumn("_f", x - F.floor(x))
            .withColumn("_hi", F.least(F.floor(x) + 1, F.col("_m") - 1)))
    lo = profile.select("symbol", F.col("idx").alias("_lo"), F.col("volume").alias("_vlo"))
    hi = profile.select("symbol", F.col("idx").alias("_hi"), F.col("volume").alias("_vhi"))
    grid = grid.join(lo, ["symbol", "_lo"]).join(hi, ["symbol", "_hi"])
    grid = grid.withColumn("_v", F.col("_vlo") * (1 - F.col("_f")) + F.col("_vhi") * F.col("_f"))
    total = grid.groupBy("symbol").agg(F.sum("_v").alias("_t"))
    share = F.coalesce(ratio("_v", "_t"), F.lit(1.0 / steps))
    grid = grid.join(total, "symbol").select("symbol", "step", share.alias("_share"))
    return orders.join(grid, "symbol").withColumn("shares", F.col("size") * F.col("_share")) \
        .drop("_share")
