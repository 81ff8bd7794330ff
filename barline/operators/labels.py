"""Forward-looking labels. Frames look ahead, so blocks carry a halo after them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barline.functions import ratio
from barline.operators.barrier import triple_barrier  # noqa: F401
from barline.plans.series import block_window, core_rows, in_blocks, number_rows, split_blocks


def ahead(n: int, x: str = "close"):
    return F.lead(x, n).over(block_window())


def binary_label(bars: DataFrame, horizon: int = 5, threshold: float = 0.02,
                 block_rows: int | None = None) -> DataFrame:
    """1 where the return over the next ``horizon`` rows beats the threshold, -1 without one."""
    df = in_blocks(bars, after=horizon, block_rows=block_rows)
    ret = ratio(ahead(horizon) - F.col("close"), "close")
    label = F.when(ahead(horizon).isNull(), -1).when(ret > threshold, 1).otherwise(0)
    return core_rows(df.withColumn("label", label)).select("symbol", "ts", "close", "label")


def label_filter(labelled: DataFrame) -> DataFrame:
    return labelled.filter(F.col("label") >= 0)


def label_distribution(labelled: DataFrame, floor: float = 0.3) -> DataFrame:
    """Rows per label and how far the smallest class is from the largest."""
    per = labelled.groupBy("symbol", "label").agg(F.count(F.lit(1)).alias("rows"))
    total = per.groupBy("symbol").agg(F.min("rows").alias("_lo"), F.max("rows").alias("_hi"))
    return per.join(total, "symbol").select(
        "symbol", "label", "rows", ratio("_lo", "_hi").alias("balance"),
        (ratio("_lo", "_hi") < floor).alias("imbalanced"))


def _with_extrema(bars: DataFrame, n: int, after: int, block_rows: int | None) -> DataFrame:
    if "n" not in bars.columns:
        bars = number_rows(bars.drop("rn"), with_total=True)
    df = split_blocks(bars, n, after, block_rows)
    around = block_window().rowsBetween(-n, n)
    inner = (F.col("rn") >= n) & (F.col("rn") < F.col("n") - n)
    is_min = inner & (F.col("close") == F.min("close").over(around))
    is_max = inner & (F.col("close") == F.max("close").over(around))
    return (df.withColumn("is_min", is_min)
            .withColumn("is_max", is_max & ~F.col("is_min")))


def local_extrema(bars: DataFrame, n: int = 5, block_rows: int | None = None) -> DataFrame:
    """Rows that are the lowest or highest of their n neighbours on both sides."""
    return core_rows(_with_extrema(bars, n, n, block_rows)).select(
        "symbol", "ts", "close", "is_min", "is_max")


def npmm_label(bars: DataFrame, n: int = 5, threshold: float = 0.02,
               block_rows: int | None = None) -> DataFrame:
    """1 at a minimum that is followed by a rise, -1 at a maximum followed by a fall, else 0."""
    df = _with_extrema(bars, n, 2 * n, block_rows)
    coming = block_window().rowsBetween(0, 2 * n - 1)
    rise = ratio(F.max("close").over(coming) - F.col("close"), "close")
    fall = ratio(F.col("close") - F.min("close").over(coming), "close")
    label = (F.when(F.col("is_min") & (rise >= threshold), 1)
             .when(F.col("is_max") & (fall >= threshold), -1).otherwise(0))
    return core_rows(df.withColumn("npmm_label", label)).select("symbol", "ts", "npmm_label")


def forward_returns(bars: DataFrame, horizons=(1, 5, 20), block_rows: int | None = None) -> DataFrame:
    df = in_blocks(bars, after=max(horizons), block_rows=block_rows)
    df = core_rows(df.select("*", *[ratio(ahead(h) - F.col("close"), "close").alias(f"h{h}")
                                    for h in horizons]))
    pairs = ", ".join(f"{h}, h{h}" for h in horizons)
    long = df.select("symbol", "ts", F.expr(f"stack({len(horizons)}, {pairs})")
                     .alias("horizon", "forward_return"))
    return long.filter(F.col("forward_return").isNotNull())
