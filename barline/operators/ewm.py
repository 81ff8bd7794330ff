"""Exponential averages as window sums: e_0 = x_0, e_i = alpha x_i + (1 - alpha) e_{i-1}.

Inside a sub-block of rows the recursion is one running sum of x_m q^-m, scaled by q^j. What came
before the sub-block enters through the closing values of the few sub-blocks that still weigh
more than 1e-18. No UDF and no recursion; linear work, parallel over blocks.
"""

from __future__ import annotations

import math
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barline.plans.series import SUB_ROWS, block_window

_TAIL = 18 * math.log(10)
_FAST_ROWS = 64


class Ewm(NamedTuple):
    x: Column
    alpha: float
    start: int = 0  # position of the first non-NULL x


def span_alpha(period: int) -> float:
    return 2.0 / (period + 1.0)


def _sub_rows(alpha: float) -> int:
    # q^-rows must stay far below the largest double
    return SUB_ROWS if -math.log(1 - alpha) * SUB_ROWS < 550 else _FAST_ROWS


def _carries(alpha: float) -> int:
    return math.ceil(_TAIL / (-math.log(1 - alpha) * _sub_rows(alpha)))


def ewm_halo(alpha: float) -> int:
    """Rows before a block that its averages reach."""
    return 0 if alpha >= 1 else (_carries(alpha) + 1) * _sub_rows(alpha)


def add_ewm(df: DataFrame, specs: dict[str, Ewm], keys=("symbol",)) -> DataFrame:
    """Adds one column per spec to a frame in blocks.

    Where x is NULL the last value stands in for it, so a gap neither pulls the average towards 0
    nor shifts its weights, and the result is NULL on the row itself. A series whose first values
    are NULL starts at its first value. Blocks that count rows with a value (``in_blocks`` with
    ``values``) hold the last value before them, whatever the gap; in other blocks an average whose
    last value lies before the halo starts anew at the next one.
    """
    rn = F.col("rn")
    plain = {n: s for n, s in specs.items() if s.alpha >= 1}
    specs = {n: s for n, s in specs.items() if s.alpha < 1}
    within = {SUB_ROWS: Window.partitionBy(*keys, "blk", "sub").orderBy("rn")}
    if any(_sub_rows(s.alpha) == _FAST_ROWS for s in specs.values()):
        df = df.withColumn("_fast", F.floor(rn / _FAST_ROWS))
        within[_FAST_ROWS] = Window.partitionBy(*keys, "blk", "sub", "_fast").orderBy("rn")
    before = block_window(keys).rowsBetween(Window.unboundedPreceding, -1)

    def at(alpha):  # position inside the sub-block
        return (rn % _sub_rows(alpha)).cast("double")

    def q_pow(alpha, e):
        return F.pow(F.lit(1 - alpha), e)  # exp(log q * e) would lose digits for large e

    seen = block_window(keys).rowsBetween(Window.unboundedPreceding, 0)
    df = df.select("*", *[s.x.alias(f"_ewx_{n}") for n, s in specs.items()])
    df = df.select("*", F.min("rn").over(seen).alias("_ewx0"),
                   *[F.last(f"_ewx_{n}", ignorenulls=True).over(seen).alias(f"_ewv_{n}") for n in specs],
                   *[F.min(F.when(F.col(f"_ewx_{n}").isNotNull(), rn)).over(seen).alias(f"_ewf_{n}") for n in specs])
    local = []
    for name, s in specs.items():
        value = F.col(f"_ewv_{name}")
        # the block that holds the first row of the series decides where it starts; in others the sum
        # is under way, unless their first rows know no value
        start = F.when((F.col("_ewx0") == 0) | (F.col(f"_ewf_{name}") > F.col("_ewx0")),
                       F.greatest(F.col(f"_ewf_{name}"), F.lit(s.start))).otherwise(s.start)
        weighted = F.when(rn == start, value).when(rn > start, value * s.alpha)
        run = within[_sub_rows(s.alpha)].rowsBetween(Window.unboundedPreceding, 0)
        total = F.sum(weighted * q_pow(s.alpha, -at(s.alpha))).over(run)
        local.append((q_pow(s.alpha, at(s.alpha)) * total).alias(f"_ewl_{name}"))
    df = df.select("*", *local)

    for k in range(1, max((_carries(s.alpha) for s in specs.values()), default=0) + 1):
        carried = []
        for name, s in specs.items():
            if _carries(s.alpha) < k:
                continue
            size = _sub_rows(s.alpha)
            closing = F.col(f"_ewl_{name}")
            if k > 1:
                closing = closing + F.lit((1 - s.alpha) ** size) * F.coalesce(
                    F.col(f"_ewc{k - 1}_{name}"), F.lit(0.0))
            carried.append(F.last(F.when(rn % size == size - 1, closing), ignorenulls=True)
                           .over(before).alias(f"_ewc{k}_{name}"))
        df = df.select("*", *carried)

    out = [F.col(c) for c in df.columns if c != "_fast" and c[:4] not in ("_ewl", "_ewc", "_ewx", "_ewv", "_ewf")]
    for name, s in specs.items():
        carry = F.coalesce(F.col(f"_ewc{_carries(s.alpha)}_{name}"), F.lit(0.0))
        total = F.col(f"_ewl_{name}") + q_pow(s.alpha, at(s.alpha) + 1) * carry
        out.append(F.when(F.col(f"_ewx_{name}").isNotNull(), total).alias(name))
    return df.select(*out, *[s.x.alias(n) for n, s in plain.items()])
