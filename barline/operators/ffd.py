"""Fixed-width fractional differencing.

The kernel is several hundred to several thousand rows wide, so each (symbol, block) is convolved
with NumPy inside its task; a block is bounded by BLOCK_ROWS plus the kernel width.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from barline.functions import ratio
from barline.plans.series import in_blocks


def ffd_weights(d: float, threshold: float = 1e-5) -> np.ndarray:
    """Weights by lag: w_0 = 1, w_k = -w_{k-1} (d - k + 1) / k, while |w_k| >= threshold."""
    size = 1024
    while True:
        k = np.arange(1, size)
        w = np.concatenate([[1.0], np.cumprod((k - 1 - d) / k)])
        small = np.nonzero(np.abs(w) < threshold)[0]
        if small.size:
            return w[:small[0]]
        size *= 2


def _differenced(x: np.ndarray, weights: np.ndarray) -> np.ndarray:
    out = np.full(x.size, np.nan)
    if x.size >= weights.size:
        # a NULL input makes every window over it NULL, and only those
        bad = np.isnan(x)
        y = np.convolve(np.where(bad, 0.0, x), weights, mode="valid")
        if bad.any():
            hits = np.concatenate([[0], np.cumsum(bad)])
            y = np.where(hits[weights.size:] - hits[:-weights.size] > 0, np.nan, y)
        out[weights.size - 1:] = y
    return out


def _rolling_zscore(x: np.ndarray, window: int, chunk: int = 8192) -> np.ndarray:
    """0 until the window is full and on constant windows; two-pass deviations per window."""
    out = np.zeros(x.size)
    for start in range(window - 1, x.size, chunk):
        end = min(start + chunk, x.size)
        frames = np.lib.stride_tricks.sliding_window_view(x[start - window + 1:end], window)
        sd = frames.std(axis=1, ddof=1)
        vary = frames.max(axis=1) > frames.min(axis=1)  # NaN compares false
        z = np.divide(x[start:end] - frames.mean(axis=1), sd, out=np.zeros(end - start),
                      where=vary & (sd > 0))
        out[start:end] = z
    return out


def add_block_features(blocks: DataFrame, ffd_columns: list[str] = (), d: float = 0.5,
                       threshold: float = 1e-5, zscore_columns: list[str] = (),
                       window: int = 252, keys=("symbol",)) -> DataFrame:
    """Adds ``<column>_ffd`` and ``<column>_zscore`` in one pass over each block.

    Both need frames of hundreds of rows for every value. A moving window in the engine would
    re-aggregate each frame from scratch, for every column.
    """
    weights = ffd_weights(d, threshold)

    def per_block(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("rn", kind="stable")

        def values(c):
            return pdf[c].to_numpy(dtype=float, na_value=np.nan)
        done = {f"{c}_ffd": _differenced(values(c), weights) for c in ffd_columns}
        done |= {f"{c}_zscore": _rolling_zscore(values(c), window) for c in zscore_columns}
        return pdf.assign(**done)

    ffd_names = [f"{c}_ffd" for c in ffd_columns]
    names = ffd_names + [f"{c}_zscore" for c in zscore_columns]
    schema = T.StructType(blocks.schema.fields
                          + [T.StructField(n, T.DoubleType()) for n in names])
    out = blocks.groupBy(*keys, "blk").applyInPandas(per_block, schema)
    # NaN crosses the Arrow border as NaN; the engine's missing value is NULL
    return out.withColumns({n: F.when(~F.isnan(n), F.col(n)) for n in ffd_names})


def ffd(bars: DataFrame, columns: list[str], d: float = 0.5, threshold: float = 1e-5,
        block_rows: int | None = None) -> DataFrame:
    df = bars.select("symbol", "ts", *columns, *[c for c in ("rn",) if c in bars.columns])
    df = in_blocks(df, len(ffd_weights(d, threshold)) - 1, block_rows=block_rows)
    df = df.withColumns({c: F.col(c).cast("double") for c in columns})
    out = add_block_features(df, columns, d, threshold).filter("core")
    return out.select("symbol", "ts", *[f"{c}_ffd" for c in columns])


def ffd_conv(bars: DataFrame, column: str, d: float = 0.5, threshold: float = 1e-5,
             block_rows: int | None = None) -> DataFrame:
    """As ``ffd``, keeping only rows with a full kernel."""
    return ffd(bars, [column], d, threshold, block_rows).filter(F.col(f"{column}_ffd").isNotNull())


def optimal_d(bars: DataFrame, column: str = "close", step: float = 0.05, top: float = 1.0,
              threshold: float = 1e-5, critical: float = -2.86, min_rows: int = 20,
              block_rows: int | None = None) -> DataFrame:
    """Smallest differencing order whose series passes a Dickey-Fuller test, per symbol.

    The test regresses the change on the level with a constant. Every block differences its rows
    at all orders and hands on the regression sums only, which then add up per (symbol, order).
    Without a pass the order with the lowest statistic wins; 0.5 if no series is long enough.
    """
    grid = [round(step * (i + 1), 10) for i in range(int(round(top / step)))]
    kernels = {d: ffd_weights(d, threshold) for d in grid}
    sums = ["n", "x", "y", "xx", "xy", "yy"]

    def per_block(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("rn", kind="stable")
        values, core = pdf[column].to_numpy(dtype=float), pdf["core"].to_numpy()
        out = []
        for d, w in kernels.items():
            level = _differenced(values, w)
            x, dy = level[:-1], np.diff(level)
            use = core[1:] & ~np.isnan(dy)
            x, dy = x[use], dy[use]
            out.append((pdf["symbol"].iloc[0], d, float(x.size), x.sum(), dy.sum(), x @ x, x @ dy,
                        dy @ dy))
        return pd.DataFrame(out, columns=["symbol", "d", *sums])

    df = bars.select("symbol", "ts", F.col(column).cast("double").alias(column),
                     *[c for c in ("rn",) if c in bars.columns])
    blocks = in_blocks(df, max(len(w) for w in kernels.values()), block_rows=block_rows)
    schema = "symbol string, d double, " + ", ".join(f"{c} double" for c in sums)
    t = blocks.groupBy("symbol", "blk").applyInPandas(per_block, schema)
    t = t.groupBy("symbol", "d").agg(*[F.sum(c).alias(c) for c in sums])
    n = F.col("n")
    sxx = F.col("xx") - F.col("x") * F.col("x") / n
    sxy = F.col("xy") - F.col("x") * F.col("y") / n
    syy = F.col("yy") - F.col("y") * F.col("y") / n
    t = t.filter((n >= min_rows - 1) & (sxx > 0)).withColumn("slope", sxy / sxx).withColumn(
        "stat", ratio(F.col("slope"), F.sqrt(ratio(syy - F.col("slope") * sxy, (n - 2) * sxx))))
    best = t.groupBy("symbol").agg(
        F.min(F.when(F.col("stat") < critical, F.col("d"))).alias("_pass"),
        F.min_by("d", "stat").alias("_least"), F.count(F.lit(1)).alias("orders_tested"))
    out = bars.select("symbol").distinct().join(best, "symbol", "left")
    return out.select("symbol", F.coalesce("_pass", "_least", F.lit(0.5)).alias("d"),
                      F.col("_pass").isNotNull().alias("stationary"),
                      F.coalesce("orders_tested", F.lit(0)).alias("orders_tested"))
