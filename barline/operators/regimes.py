"""Correlation structure and market regimes."""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from barline.functions import corr_over, ratio
from barline.functions.cols import rows
from barline.operators import gram
from barline.operators.align import pairwise_symbols
from barline.plans.series import block_window, core_rows, in_blocks
from barline.sources.stored import stage


def corr_matrix(returns: DataFrame, value: str = "ret") -> DataFrame:
    """Correlation of every pair over the steps that have both; 0 where undefined."""
    return gram.pair_sums(returns, value=value).where("a < b").select("a", "b", gram.correlation().alias("corr"))


def rolling_corr(returns: DataFrame, window: int = 60, value: str = "ret",
                 block_rows: int | None = None) -> DataFrame:
    keys = ("a", "b")
    df = in_blocks(pairwise_symbols(returns, value), window - 1, keys=keys, block_rows=block_rows)
    f = rows(block_window(keys), window)
    df = df.withColumn("corr", corr_over("x", "y", f)).withColumn("_n", F.count(F.lit(1)).over(f))
    return core_rows(df.filter(F.col("_n") == window)).select("ts", "a", "b", "corr")


def corr_by(returns: DataFrame, bucket: Column, value: str = "ret") -> DataFrame:
    """Pair correlations per time bucket."""
    sums = gram.pair_sums(returns.withColumn("bucket", bucket), ["bucket"], value=value)
    return sums.where("a < b").select("bucket", "a", "b", gram.correlation().alias("corr"))


def regime_rules(market: DataFrame, vol_limit: float = 0.20, trend_limit: float = 25.0,
                 corr_limit: float = 0.7) -> DataFrame:
    """Needs volatility, trend, avg_corr, max_corr. Volatility and trend cover all cases."""
    high, trending = F.col("volatility") > vol_limit, F.col("trend") > trend_limit
    crisis = high & (F.col("avg_corr") > corr_limit)
    return (market
            .withColumn("regime", F.when(crisis, "crisis")
                        .when(~high & trending, "low_vol_trending")
                        .when(high & trending, "high_vol_trending")
                        .when(~high, "low_vol_mean_reverting").otherwise("high_vol_mean_reverting"))
            .withColumn("confidence", F.when(crisis, F.least(F.lit(1.0), F.col("max_corr")))
                        .when(~high & trending, 0.8).when(high & trending, 0.7)
                        .when(~high, 0.75).otherwise(0.7)))


def regime_transitions(regimes: DataFrame, ts: str = "bucket", lookback: int = 20) -> DataFrame:
    """Share of each next regime per regime, over the newest observations."""
    last = regimes.orderBy(F.desc(ts)).limit(lookback)  # at most `lookback` rows
    nxt = F.lead("regime").over(Window.partitionBy(F.lit(0)).orderBy(ts))
    moves = last.withColumn("next_regime", nxt).filter(F.col("next_regime").isNotNull())
    per = moves.groupBy("regime", "next_regime").agg(F.count(F.lit(1)).alias("moves"))
    total = F.sum("moves").over(Window.partitionBy("regime"))
    return per.select("regime", "next_regime", "moves", ratio("moves", total).alias("probability"))


def regime_history(regimes: DataFrame, start, end, ts: str = "bucket") -> DataFrame:
    return regimes.filter((F.col(ts) >= F.lit(start).cast("timestamp"))
                          & (F.col(ts) <= F.lit(end).cast("timestamp")))


WIDTH, ROUNDS = 10, 2   # columns of the random projection, and times it is sharpened


def principal_scores(cells: DataFrame, k: int = 2, width: int = WIDTH, rounds: int = ROUNDS, seed: int = 42) -> DataFrame:
    """(row, features): the rows' scores on their first ``k`` principal components, from cells (row, column, x)
    whose missing ones are 0, by a randomised range finder of a small fixed width.

    Each column has a random vector, from its hash; a row's sum over its columns, weighted by these, is a
    sketch of the row. From the sketches' orthonormal basis every column gets its coefficients, and from
    these the next, sharper sketch. Only rows x width numbers and width x width sums reach the driver,
    never a covariance of the columns.
    """
    spark = cells.sparkSession
    cells = stage(cells.select("row", "column", F.col("x").cast("double").alias("x")), "cells")
    rows = cells.select("row").distinct().count()
    means = cells.groupBy("column").agg((F.sum("x") / F.lit(float(max(1, rows)))).alias("m"))
    uniform = lambda j, part: (F.pmod(F.xxhash64("column", F.lit(seed), F.lit(j), F.lit(part)), F.lit(1 << 40)) + 0.5) / float(1 << 40)
    normal = [F.sqrt(-2 * F.log(uniform(j, 0))) * F.cos(2 * math.pi * uniform(j, 1)) for j in range(width)]
    weights = means.select("column", "m", *[w.alias(f"w{j}") for j, w in enumerate(normal)])
    for _ in range(rounds + 1):
        weights = stage(weights, "column-weights")
        # (x - m) w summed over all columns: the mean's share is the same for every row
        less = np.array(weights.agg(*[F.coalesce(F.sum(F.col("m") * F.col(f"w{j}")), F.lit(0.0)) for j in range(width)]).first())
        sketch = cells.join(weights, "column").groupBy("row").agg(*[F.sum(F.col("x") * F.col(f"w{j}")).alias(f"y{j}") for j in range(width)])
        got = sketch.orderBy("row").collect()  # a row of `width` numbers per time bucket
        names = [r["row"] for r in got]
        basis, _ = np.linalg.qr(np.array([r[1:] for r in got], dtype=float).reshape(len(got), width) - less)
        width = basis.shape[1]
        table = spark.createDataFrame([(r, *map(float, q)) for r, q in zip(names, basis)], T.StructType(
            [cells.schema["row"], *[T.StructField(f"q{j}", T.DoubleType()) for j in range(width)]]))
        total = basis.sum(axis=0)
        coefficients = (cells.join(F.broadcast(table), "row").groupBy("column")  # as long as the list of buckets
                        .agg(*[F.sum(F.col("x") * F.col(f"q{j}")).alias(f"c{j}") for j in range(width)]).join(means, "column"))
        weights = coefficients.select("column", "m", *[(F.col(f"c{j}") - F.col("m") * float(total[j])).alias(f"w{j}") for j in range(width)])
    pairs = [(i, j) for i in range(width) for j in range(i, width)]
    sums = weights.agg(*[F.coalesce(F.sum(F.col(f"w{i}") * F.col(f"w{j}")), F.lit(0.0)) for i, j in pairs]).first()
    small = np.zeros((width, width))
    for (i, j), v in zip(pairs, sums, strict=True):
        small[i, j] = small[j, i] = v
    value, vector = np.linalg.eigh(small)
    top = np.argsort(-value)[:k]
    scores = basis @ vector[:, top] * np.sqrt(np.maximum(value[top], 0))
    scores = np.pad(scores, ((0, 0), (0, k - scores.shape[1])))
    out = spark.createDataFrame([(r, [float(x) for x in row]) for r, row in zip(names, scores)],
                                T.StructType([cells.schema["row"], T.StructField("_f", T.ArrayType(T.DoubleType()))]))
    return out.select("row", array_to_vector("_f").alias("features"))


def regime_clusters(correlations: DataFrame, symbols: Sequence[str], k: int = 6,
                    seed: int = 42) -> DataFrame:
    """Correlation matrices per bucket, reduced to two principal components and clustered; named by mean
    correlation. A pair that a bucket lacks counts as 0.
    """
    spark = correlations.sparkSession
    chosen = spark.createDataFrame([(s,) for s in sorted(set(symbols))], "s string")
    kept = correlations.join(chosen.withColumnRenamed("s", "a"), "a", "left_semi").join(chosen.withColumnRenamed("s", "b"), "b", "left_semi")
    n = len(set(symbols))
    means = kept.groupBy("bucket").agg((F.sum("corr") / F.lit(n * (n - 1) / 2)).alias("avg_corr"))
    cells = kept.select(F.col("bucket").alias("row"), F.concat_ws("~", "a", "b").alias("column"), F.col("corr").alias("x"))
    reduced = principal_scores(cells).withColumnRenamed("row", "bucket")
    out = KMeans(k=k, seed=seed, featuresCol="features", predictionCol="cluster").fit(reduced) \
        .transform(reduced).join(means, "bucket")
    c = F.col("avg_corr")
    return out.select("bucket", "cluster", "avg_corr", F.when(c > 0.7, "crisis")
                      .when(c > 0.5, "high_vol_trending").when(c > 0.3, "low_vol_trending")
                      .when(c > 0.1, "low_vol_mean_reverting").otherwise("neutral").alias("regime"))
