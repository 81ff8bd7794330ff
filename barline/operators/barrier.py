"""Triple barrier: the first later bar that gains, loses or hardly moves, however far ahead it lies.

A block of bars settles what its own rows and a bounded reach behind them decide. Events still open
there search a tree of value ranges. A leaf covers some hundred rows, a node ``FANOUT`` of the level
below, and each keeps the ranges its closes lie in. Gaps between closes that are too narrow to hold a
whole quiet band are closed; the bands of all bases being equally wide on a log scale, this keeps the
list short and its answer exact: a node holds a touch if and only if its ranges say so. So an event
climbs over whole nodes and descends only to the one leaf that settles it.

Events travel in packs of one block at most. A step joins packs with the row of their node's children;
there are two steps per level, and every one is a written table.
"""

from __future__ import annotations

import math
from contextlib import contextmanager

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from barline.plans.series import block_size, number_rows, split_blocks
from barline.sources.stored import stage

FANOUT = 64
CELLS = 2 ** 21   # comparisons (base x range) made at a time
PACKS_AT_A_TIME = 64   # rows of an Arrow batch; a pack carries a block's events and a node's ranges
PACKS = "symbol string, level int, grp bigint, first bigint, rns array<bigint>, bases array<double>"
CHILDREN = "symbol string, grp bigint, child array<bigint>, lo array<double>, hi array<double>"


def _returns(price: np.ndarray, base: np.ndarray) -> np.ndarray:
    with np.errstate(all="ignore"):
        return (price - base) / base


def first_touch(price: np.ndarray, events: np.ndarray, rise: float, fall: float,
                quiet: float, limit: int | None):
    """Label per event (positions in ``price``) and whether it is settled inside ``price``. A base
    that is no finite number is never left, so its label is 0."""
    label = np.zeros(events.size, dtype=np.int32)
    open_ = np.isfinite(price[events])
    step = 0
    while open_.any():
        step += 1
        if limit is not None and step > limit:
            open_[:] = False
            break
        live = np.nonzero(open_)[0]
        at = events[live] + step
        live = live[at < price.size]
        if live.size == 0:
            break
        ret = _returns(price[events[live] + step], price[events[live]])
        label[live[ret >= rise]] = 1
        label[live[(ret < rise) & (ret <= -fall)]] = -1
        open_[live[(ret >= rise) | (ret <= -fall) | (np.abs(ret) < quiet)]] = False
    return label, ~open_


def ranges(lo: np.ndarray, hi: np.ndarray, quiet: float):
    """Sorted disjoint ranges that cover the given ones, gaps too narrow for a quiet band closed."""
    order = np.argsort(lo, kind="stable")
    lo, hi = lo[order], np.maximum.accumulate(hi[order]) if lo.size else hi
    if quiet <= 0:
        return lo[:1], hi[-1:]
    left, right = np.abs(hi[:-1]), np.abs(lo[1:])
    same_side = np.sign(hi[:-1]) * np.sign(lo[1:]) > 0
    # the margin keeps rounding from closing a gap that does hold a band
    width = math.inf if quiet >= 1 else (1 + quiet) / (1 - quiet) * (1 - 1e-9)
    with np.errstate(all="ignore"):
        narrow = np.maximum(left, right) / np.minimum(left, right) < width
    cut = ~((lo[1:] <= hi[:-1]) | (same_side & narrow))
    return lo[np.r_[True, cut]] if lo.size else lo, hi[np.r_[cut, True]] if hi.size else hi


def _holds(lo: np.ndarray, hi: np.ndarray, base: np.ndarray, rise: float, fall: float, quiet: float) -> np.ndarray:
    """Per base and range: does a close in it end the event?"""
    a, b = _returns(lo[None, :], base[:, None]), _returns(hi[None, :], base[:, None])
    out = (a >= rise) | (b >= rise) | (a <= -fall) | (b <= -fall) | (np.abs(a) < quiet) | (np.abs(b) < quiet)
    return out | ((np.sign(a) * np.sign(b) < 0) & (quiet > 0))


def _first_hits(child, lo, hi, first, bases, *marks) -> np.ndarray:
    """The first child from ``first`` on that holds a touch, per base; -1 without one."""
    kept = child >= first
    child, lo, hi = child[kept], lo[kept], hi[kept]
    out = np.full(bases.size, -1, dtype=np.int64)
    if child.size:
        rows = max(1, CELLS // child.size)
        for i in range(0, bases.size, rows):
            hit = _holds(lo, hi, bases[i:i + rows], *marks)
            out[i:i + rows] = np.where(hit.any(axis=1), child[hit.argmax(axis=1)], -1)
    return out


@contextmanager
def _small_batches(spark: SparkSession):
    """Arrow batches of few rows, for jobs that are planned inside."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, str(PACKS_AT_A_TIME))
    try:
        yield
    finally:
        spark.conf.set(name, before)


def _children(rows: pd.DataFrame, of: str, quiet: float, fanout: int) -> pd.DataFrame:
    """One row with the ranges of all children, in their order."""
    parts = [(c, *ranges(g["lo"].to_numpy(dtype=float), g["hi"].to_numpy(dtype=float), quiet))
             for c, g in rows.groupby(of, sort=True)]
    return pd.DataFrame({
        "symbol": rows["symbol"].iloc[:1].to_numpy(),
        "grp": [int(rows[of].iloc[0]) // fanout],
        "child": [np.concatenate([np.full(lo.size, c, dtype=np.int64) for c, lo, _ in parts])],
        "lo": [np.concatenate([lo for _, lo, _ in parts])],
        "hi": [np.concatenate([hi for _, _, hi in parts])]})


def _tree(bars: DataFrame, leaf: int, quiet: float, longest: int, fanout: int) -> list[DataFrame]:
    """Per level, one row per node above it with the ranges of its children."""
    # a group is the leaves of one node; closes that are no number can't end an event
    closes = (bars.where(F.col("close").isNotNull() & ~F.isnan("close"))
              .select("symbol", F.floor(F.col("rn") / leaf).alias("leaf"), F.col("close").cast("double").alias("lo"))
              .withColumn("hi", F.col("lo")))
    level = stage(closes.groupBy("symbol", F.floor(F.col("leaf") / fanout))
                  .applyInPandas(lambda key, pdf: _children(pdf, "leaf", quiet, fanout), CHILDREN), "barrier-leaves")
    levels, nodes = [level], -(-longest // leaf)
    while nodes > fanout:
        def above(key, pdf):
            flat = pd.DataFrame({"symbol": pdf["symbol"].iloc[0], "node": np.repeat(pdf["grp"].to_numpy(), pdf["lo"].map(len)),
                                 "lo": np.concatenate(pdf["lo"].tolist()), "hi": np.concatenate(pdf["hi"].tolist())})
            return _children(flat, "node", quiet, fanout)
        nodes = -(-nodes // fanout)
        level = stage(level.groupBy("symbol", F.floor(F.col("grp") / fanout)).applyInPandas(above, CHILDREN),
                      f"barrier-level-{len(levels)}")
        levels.append(level)
    return levels


def _leaves_of(packs: DataFrame, levels: list[DataFrame], marks: tuple, fanout: int) -> DataFrame:
    """Packs (level -1, ``first`` the leaf) of the events that some leaf settles."""
    def step(at: int, up: bool):
        def search(batches):
            for batch in batches:
                out = []
                for row in batch.itertuples(index=False):
                    bases, rns = np.asarray(row.bases, dtype=float), np.asarray(row.rns)
                    # a node without any number in it has no row
                    child, lo, hi = (np.asarray([] if x is None else x) for x in (row.child, row.lo, row.hi))
                    hits = _first_hits(child, lo, hi, row.first, bases, *marks)
                    for c in np.unique(hits):
                        own = hits == c
                        if c >= 0:
                            place = (at - 1, c, c * fanout if at else c)
                        elif up:
                            place = (at + 1, (row.grp + 1) // fanout, row.grp + 1)
                        else:
                            continue
                        out.append((row.symbol, *place, rns[own], bases[own]))
                yield pd.DataFrame(out, columns=["symbol", "level", "grp", "first", "rns", "bases"])
        return search

    def walk(frame: DataFrame, at: int, up: bool) -> DataFrame:
        met = frame.where(F.col("level") == at).drop("level").join(levels[at], ["symbol", "grp"], "left")
        return stage(met.mapInPandas(step(at, up), PACKS), f"barrier-{'up' if up else 'down'}-{at}")

    moved = packs
    seen = []
    for at in range(len(levels)):
        moved = walk(moved, at, True)
        seen.append(moved.where(F.col("level") < at))
    for at in range(len(levels) - 2, -1, -1):
        # what a climb met at ``at`` + 1, and what came down to it
        down = seen[at + 1].where(F.col("level") == at)
        if at + 2 < len(levels):
            down = down.unionByName(came.where(F.col("level") == at))
        came = walk(down, at, False)
    return seen[0] if len(levels) == 1 else seen[0].unionByName(came.where(F.col("level") == -1))


def _in_leaves(found: DataFrame, bars: DataFrame, leaf: int, marks: tuple, limit: int | None) -> DataFrame:
    """(symbol, rn, label) of events whose leaf is known."""
    rows = (bars.withColumn("first", F.floor(F.col("rn") / leaf))
            .join(found.select("symbol", "first").distinct(), ["symbol", "first"], "left_semi")
            .groupBy("symbol", "first").agg(F.array_sort(F.collect_list(F.struct("rn", F.col("close").cast("double").alias("close")))).alias("rows"))
            .select("symbol", "first", F.col("rows.rn").alias("at"), F.col("rows.close").alias("price")))
    rise, fall, quiet = marks

    def settle(batches):
        for batch in batches:
            out = []
            for row in batch.itertuples(index=False):
                price, at = np.asarray(row.price, dtype=float), np.asarray(row.at)
                bases, rns = np.asarray(row.bases, dtype=float), np.asarray(row.rns)
                label, open_ = np.zeros(bases.size, dtype=np.int32), np.ones(bases.size, dtype=bool)
                for i in range(price.size):
                    live = np.nonzero(open_)[0]
                    if live.size == 0:
                        break
                    ret = _returns(price[i], bases[live])
                    ends = (ret >= rise) | (ret <= -fall) | (np.abs(ret) < quiet)
                    if limit is not None:
                        ends |= at[i] - rns[live] > limit
                        ret = np.where(at[i] - rns[live] > limit, np.nan, ret)
                    label[live] = np.where(ret >= rise, 1, np.where(ret <= -fall, -1, 0))
                    open_[live[ends]] = False
                out.append(pd.DataFrame({"symbol": row.symbol, "rn": rns, "label": label}))
            yield pd.concat(out) if out else pd.DataFrame(columns=["symbol", "rn", "label"])
    return (found.select("symbol", "first", "rns", "bases").join(rows, ["symbol", "first"])
            .mapInPandas(settle, "symbol string, rn bigint, label int"))


def triple_barrier(spark: SparkSession, bars: DataFrame, rise: float = 0.02, fall: float = 0.01,
                   quiet: float = 0.005, max_holding: int | None = None, reach: int = 1024,
                   block_rows: int | None = None, fanout: int = FANOUT) -> DataFrame:
    """First later bar that gains ``rise`` (1), loses ``fall`` (-1) or hardly moves (0); 0 without one.

    A block sees ``reach`` rows ahead; events still open there find their bar through the tree, so the
    result is exact without a time limit and no task holds more than a block, a reach or a node's
    children. A NULL close ends no event, and an event without a finite close has label 0.
    """
    if "n" not in bars.columns:
        bars = number_rows(bars.drop("rn"), with_total=True)
    bars = bars.select("symbol", "ts", "rn", "n", "close")
    if max_holding is not None:
        reach = min(reach, max_holding)
    reach = max(reach, 1)
    size = block_rows or block_size(reach)
    marks = (rise, fall, quiet)

    def settle(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("rn", kind="stable")
        events = np.nonzero(pdf["core"].to_numpy())[0]
        label, done = first_touch(pdf["close"].to_numpy(dtype=float), events, *marks, max_holding)
        out = pdf.iloc[events][["symbol", "ts", "rn", "n", "blk", "close"]]
        ends = bool(len(pdf)) and pdf["rn"].iloc[-1] == pdf["n"].iloc[-1] - 1
        return out.assign(label=label, settled=done | ends)

    schema = ("symbol string, ts timestamp, rn bigint, n bigint, blk bigint, close double, label int, settled boolean")
    blocks = split_blocks(bars, after=reach, block_rows=size)
    near = stage(blocks.groupBy("symbol", "blk").applyInPandas(settle, schema), "barrier-near")
    out = near.where("settled").select("symbol", "ts", "label")
    far = near.where("NOT settled")
    longest = far.agg(F.max("n")).first()[0]
    if longest is None:
        return out
    # blocks end on a leaf's border, so the first leaf not yet seen holds none of the seen rows
    leaf = math.gcd(size, reach)
    first = F.floor(((F.col("blk") + 1) * size + reach) / leaf)
    packs = (far.groupBy("symbol", "blk").agg(F.collect_list(F.struct("rn", "close")).alias("e"))
             .select("symbol", F.lit(0).alias("level"), F.floor(first / fanout).alias("grp"), first.alias("first"),
                     F.col("e.rn").alias("rns"), F.col("e.close").alias("bases")))
    series = bars.join(far.select("symbol").distinct(), "symbol", "left_semi")
    levels = _tree(series, leaf, quiet, longest, fanout)
    with _small_batches(spark):
        found = _leaves_of(packs, levels, marks, fanout)
        settled = stage(_in_leaves(found, series, leaf, marks, max_holding), "barrier-far")
    far = far.drop("label").join(settled, ["symbol", "rn"], "left")
    return out.unionByName(far.select("symbol", "ts", F.coalesce("label", F.lit(0)).alias("label")))
