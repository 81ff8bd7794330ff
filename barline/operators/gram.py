"""Sums over pairs of symbols as blocked Gram matrices.

A time step is one row with the values of all its symbols. A task adds up outer products, tile of symbols by
tile of symbols, with zeros and a mask for what is missing, and hands on one row per pair: a shuffle of
n^2 rows per task, where a join of symbols at each time step makes T x n^2.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

TILE = 64          # symbols per side of a tile
OPEN_TILES = 512   # tiles a task keeps open, some 100 MB; beyond them partial sums are handed on
SUMS = ("n", "sx", "sy", "sxy", "sxx", "syy")
FLAT = 1e-12       # a variance below this share of the squares is that of a constant


def _tiles(idx: np.ndarray, step: np.ndarray, x: np.ndarray, steps: int):
    """Sums of every pair of tiles that a group's values touch: (tile a, tile b, six matrices)."""
    tile = idx // TILE
    dense = {}
    for t in np.unique(tile):
        at = tile == t
        m, v = np.zeros((steps, TILE)), np.zeros((steps, TILE))
        m[step[at], idx[at] % TILE] = 1
        v[step[at], idx[at] % TILE] = x[at]
        dense[int(t)] = m, v, v * v
    for a, (ma, xa, qa) in dense.items():
        for b, (mb, xb, qb) in dense.items():
            if a <= b:
                yield a, b, np.stack([ma.T @ mb, xa.T @ mb, ma.T @ xb, xa.T @ xb, qa.T @ mb, ma.T @ qb])


def pair_sums(values: DataFrame, by: Sequence[str] = (), step: str = "ts", symbol: str = "symbol", value: str = "ret") -> DataFrame:
    """Per group of ``by`` and pair a <= b of symbols, over the steps that have both: n and the sums of x, y,
    xy, xx and yy of the values less their symbol's mean in the group (which leaves covariances as they are).

    A step holds at most one value of a symbol; NULLs and NaNs count as missing. Symbols come as a and b.
    """
    by = list(by)
    df = values.select(*by, F.col(step).alias("_step"), F.col(symbol).alias("_s"), F.col(value).cast("double").alias("_x"))
    df = df.where(F.col("_x").isNotNull() & ~F.isnan("_x") & F.col("_s").isNotNull())
    names = df.select("_s").distinct().select("_s", (F.row_number().over(Window.partitionBy(F.lit(0)).orderBy("_s")) - 1).alias("_i"))
    means = df.groupBy(*by, "_s").agg(F.avg("_x").alias("_m"))
    rows = (df.join(means, [*by, "_s"]).join(names, "_s").groupBy(*by, "_step")
            .agg(F.collect_list(F.struct("_i", (F.col("_x") - F.col("_m")).alias("_x"))).alias("_v"))
            .select(*by, F.col("_v._i").alias("_i"), F.col("_v._x").alias("_x")))
    keys = [rows.schema[c] for c in by]
    schema = T.StructType([*keys, T.StructField("_a", T.IntegerType()), T.StructField("_b", T.IntegerType()),
                           *[T.StructField(s, T.DoubleType()) for s in SUMS]])

    def add_up(batches):
        open_: dict = {}

        def hand_on():
            for (key, a, b), m in open_.items():
                i, j = np.nonzero(m[0])
                keep = (a < b) | (i <= j)
                i, j = i[keep], j[keep]
                if len(i):
                    n = len(i)
                    cols = [pa.array([k] * n, f) for k, f in zip(key, key_types[0], strict=True)]
                    cols += [pa.array(a * TILE + i, pa.int32()), pa.array(b * TILE + j, pa.int32()), *(pa.array(s[i, j]) for s in m)]
                    yield pa.RecordBatch.from_arrays(cols, names=[*by, "_a", "_b", *SUMS])
            open_.clear()
        key_types: list = []
        for batch in batches:
            key_types[:] = [[batch.column(c).type for c in by]]
            keys_ = list(zip(*(batch.column(c).to_pylist() for c in by), strict=True)) if by else [()] * batch.num_rows
            groups: dict = {}
            for r, k in enumerate(keys_):
                groups.setdefault(k, []).append(r)
            for key, at in groups.items():
                part = batch.take(pa.array(at))
                ends = part.column("_i").value_lengths().to_numpy()
                idx, x = (part.column(c).flatten().to_numpy() for c in ("_i", "_x"))
                for a, b, sums in _tiles(idx, np.repeat(np.arange(len(at)), ends), x, len(at)):
                    if (key, a, b) in open_:
                        open_[key, a, b] += sums
                    else:
                        open_[key, a, b] = sums
            if len(open_) > OPEN_TILES:
                yield from hand_on()
        if key_types:
            yield from hand_on()

    sums = rows.mapInArrow(add_up, schema).groupBy(*by, "_a", "_b").agg(*[F.sum(s).alias(s) for s in SUMS])
    a, b = (names.select(F.col("_s").alias(s), F.col("_i").alias(f"_{s}")) for s in "ab")
    return sums.join(a, "_a").join(b, "_b").select(*by, "a", "b", F.col("n").cast("bigint").alias("n"), *SUMS[1:])


def spread(s: str, q: str):
    """Sum of squared deviations from the sums ``s`` and ``q``; NULL for a constant."""
    v = F.col(q) - F.col(s) * F.col(s) / F.col("n")
    return F.when(v > F.lit(FLAT) * F.col(q), v)


def covariance():
    return F.when(F.col("n") > 1, (F.col("sxy") - F.col("sx") * F.col("sy") / F.col("n")) / (F.col("n") - 1))


def correlation():
    """0 where undefined: fewer than two common steps, or a constant."""
    together = F.col("sxy") - F.col("sx") * F.col("sy") / F.col("n")
    return F.coalesce(F.when(F.col("n") > 1, together / F.sqrt(spread("sx", "sxx") * spread("sy", "syy"))), F.lit(0.0))
