"""Ordered series without one task per key.

A window over ``partitionBy(symbol)`` puts a whole symbol into one task. Here a series is
numbered with a two-level count (rows per calendar bucket or sampled range, then a prefix over those)
and cut into row blocks. A block carries the rows before and after it that its frames reach
(the halo), so every window runs over ``(key, block)`` and gives the same values as one over the
whole series. Running totals use block totals plus a prefix over blocks.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from barline.plans.ranks import dealt

SUB_ROWS = 1024          # grain of the exponential averages
BLOCK_ROWS = 16 * SUB_ROWS   # blocks of running totals
MIN_BLOCK = 8 * SUB_ROWS
DAY = 86400
BAR_BUCKET = 180 * DAY   # calendar bucket for bar tables
TICK_BUCKET = 6 * 3600   # for event and tick tables
UNPLACED = "a row without key or time has no place in a series; set such rows apart first (clean_keys)"


def number_rows(df: DataFrame, keys: Sequence[str] = ("symbol",), order: Sequence[str] = ("ts",),
                bucket_seconds: int = BAR_BUCKET, name: str = "rn", with_total: bool = False,
                keep_bucket: bool = False, values: str | None = None, by_rows: bool = False) -> DataFrame:
    """0-based position of each row in its series; ``n`` is the series length on request.

    With ``by_rows`` the series are cut by row count in place of the calendar: the rows are dealt, in order,
    over all tasks by sampled ranges and written, so that even one key's single day spreads. Use it for
    dense series, such as logs and ticks; ``blk`` then numbers these ranges.

    With ``values`` a column ``vn`` numbers the rows where that column has a value; a row without one
    has the number of the last such row, or 0 before the first (see ``split_blocks``).

    The calendar bucket may stay as ``blk``: ``running`` then works in buckets as they lie.
    A row whose key or time is NULL ends the job with a message instead of vanishing in a join.
    """
    keys = list(keys)
    if by_rows:
        b = dealt(df, [F.col(c) for c in (*keys, *order)], "dealt-series", "_bk").withColumn(
            "_bk", F.when(F.col(order[0]).isNotNull(), F.col("_bk").cast("bigint")))
    else:
        b = df.withColumn("_bk", F.floor(F.unix_seconds(F.col(order[0])) / bucket_seconds))
    counts = b.groupBy(*keys, "_bk").agg(F.count(F.lit(1)).alias("_c"), F.count(values or F.lit(1)).alias("_cv"))
    per_key = Window.partitionBy(*keys) if keys else Window.partitionBy(F.lit(0))
    before = per_key.orderBy("_bk").rowsBetween(Window.unboundedPreceding, -1)
    cols = [F.coalesce(F.sum("_c").over(before), F.lit(0)).alias("_off")]
    if values:
        cols.append(F.coalesce(F.sum("_cv").over(before), F.lit(0)).alias("_offv"))
    if with_total:
        cols.append(F.sum("_c").over(per_key).alias("n"))
    offsets = counts.select(*keys, "_bk", *cols)
    local = Window.partitionBy(*keys, "_bk").orderBy(*order)
    # an outer join, as an inner one would quietly leave out rows without key or time
    rn = F.when(F.col("_off").isNull(), F.raise_error(F.lit(UNPLACED))).otherwise(F.col("_off") + F.col("_pos") - 1)
    b = b.withColumn("_pos", F.row_number().over(local))
    if values:
        b = b.withColumn("_posv", F.count(values).over(local.rowsBetween(Window.unboundedPreceding, 0)))
    vn = F.greatest(F.col("_offv") + F.col("_posv") - 1, F.lit(0)).alias("vn")
    return (b.join(offsets, [*keys, "_bk"], "left")
            .select(*[c for c in df.columns if c != name and not (values and c == "vn")],
                    rn.cast("bigint").alias(name), *([vn] if values else []),
                    *(["n"] if with_total else []),
                    *([F.col("_bk").alias("blk")] if keep_bucket else [])))


def block_size(halo: int) -> int:
    """Rows per block: many blocks for parallelism, but halo copies stay below an eighth."""
    return max(MIN_BLOCK, -(-8 * halo // SUB_ROWS) * SUB_ROWS)


def split_blocks(df: DataFrame, before: int = 0, after: int = 0,
                 block_rows: int | None = None, keys: Sequence[str] = ("symbol",), place: str = "rn") -> DataFrame:
    """Adds ``blk`` and ``sub``; halo rows are repeated in the neighbouring blocks.

    With ``place="vn"`` blocks and halo count rows that have a value: a frame that looks for the last
    value before its block then finds it, however long a gap runs over the border. Shuffled once by (keys, blk), which every window over a block and any part of it accepts.
    """
    size = block_rows or block_size(before + after)
    rn, at = F.col("rn"), F.col(place)
    own = F.floor(at / size)
    if before or after:
        first = F.floor(F.greatest(at - after, F.lit(0)) / size)
        last = F.floor((at + before) / size)
        blk = F.explode(F.sequence(first, last))
    else:
        blk = own
    df = df.select("*", F.floor(rn / SUB_ROWS).alias("sub"), own.alias("_own"), blk.alias("blk"))
    return (df.withColumn("core", F.col("blk") == F.col("_own")).drop("_own")
            .repartition(*keys, "blk"))


def block_window(keys: Sequence[str] = ("symbol",)) -> WindowSpec:
    """The one window spec of the library; only frames differ, so one sort serves all."""
    return Window.partitionBy(*keys, "blk").orderBy("sub", "rn")


def core_rows(df: DataFrame, drop_rn: bool = True) -> DataFrame:
    out = df.filter("core").drop("blk", "sub", "core")
    return out.drop("rn") if drop_rn else out


def in_blocks(df: DataFrame, before: int = 0, after: int = 0, keys: Sequence[str] = ("symbol",),
              order: Sequence[str] = ("ts",), bucket_seconds: int = BAR_BUCKET,
              block_rows: int | None = None, with_total: bool = False, values: str | None = None) -> DataFrame:
    """number_rows + split_blocks; a frame that is already numbered is not numbered again. With
    ``values`` the blocks count the rows where that column has a value."""
    if "rn" not in df.columns:
        df = number_rows(df, keys, order, bucket_seconds, with_total=with_total, values=values)
    return split_blocks(with_value_numbers(df, values, keys) if values else df, before, after, block_rows, keys,
                        "vn" if values else "rn")


def with_value_numbers(df: DataFrame, values: str, keys: Sequence[str] = ("symbol",)) -> DataFrame:
    """A numbered frame with ``vn``, which stored bars carry for their closes."""
    if "vn" in df.columns:
        return df
    df = running(df.drop("blk"), {"vn": ("sum", F.col(values).isNotNull().cast("bigint"))}, keys)
    return df.withColumn("vn", F.greatest(F.col("vn") - 1, F.lit(0)))


_COMBINE = {"sum": F.sum, "max": F.max, "min": F.min}


def running(df: DataFrame, totals: dict[str, tuple], keys: Sequence[str] = ("symbol",),
            block_rows: int | None = None) -> DataFrame:
    """Running values from the first row of each series to the current row.

    ``totals`` maps an output name to one of
      ("sum" | "max" | "min", x)   the running aggregate
      ("peak", x)                  the highest running sum of x so far
      ("since", x, reset)          the sum of x since the last row with ``reset``
    ``df`` carries ``rn``; a column ``blk`` of consecutive row groups is used as it is. Each block is scanned on its own; one row per block carries the state
    on, so chained values come out of one pass instead of nested ones.
    """
    keys = list(keys)
    own = F.col("blk") if "blk" in df.columns else F.floor(F.col("rn") / (block_rows or BLOCK_ROWS))
    b = df.withColumn("_rb", own)
    local = Window.partitionBy(*keys, "_rb").orderBy("rn").rowsBetween(
        Window.unboundedPreceding, 0)
    upto = Window.partitionBy(*keys).orderBy("_rb").rowsBetween(Window.unboundedPreceding, 0)
    prior = Window.partitionBy(*keys).orderBy("_rb").rowsBetween(Window.unboundedPreceding, -1)
    first, second, blocks, prefix, out = [], [], [], [], []
    for n, (kind, x, *reset) in totals.items():
        b = b.withColumn(f"_x_{n}", x)
        agg = _COMBINE.get(kind, F.sum)
        first.append(agg(f"_x_{n}").over(local).alias(f"_l_{n}"))
        lo, pre = F.col(f"_l_{n}"), F.col(f"_p_{n}")
        if kind in _COMBINE:
            blocks.append(agg(f"_x_{n}").alias(f"_t_{n}"))
            prefix.append([(f"_p_{n}", agg(f"_t_{n}").over(prior))])
            merged = {"sum": F.coalesce(lo + pre, lo, pre), "max": F.greatest(lo, pre),
                      "min": F.least(lo, pre)}[kind]
            out.append((n, merged))
        elif kind == "peak":
            second.append(F.max(lo).over(local).alias(f"_m_{n}"))
            blocks += [F.sum(f"_x_{n}").alias(f"_t_{n}"), F.max(lo).alias(f"_h_{n}")]
            prefix.append([(f"_p_{n}", F.coalesce(F.sum(f"_t_{n}").over(prior), F.lit(0))),
                           (f"_q_{n}", F.max(pre + F.col(f"_h_{n}")).over(prior))])
            out.append((n, F.greatest(pre + F.col(f"_m_{n}"), F.col(f"_q_{n}"))))
        else:
            b = b.withColumn(f"_r_{n}", F.coalesce(reset[0], F.lit(False)))
            second.append(F.max(F.when(F.col(f"_r_{n}"), lo)).over(local).alias(f"_m_{n}"))
            blocks += [F.sum(f"_x_{n}").alias(f"_t_{n}"),
                       F.max(F.when(F.col(f"_r_{n}"), lo)).alias(f"_h_{n}")]
            # x is not negative, so the running sum at the last reset is the largest at any reset
            prefix.append([(f"_c_{n}", F.sum(f"_t_{n}").over(upto)),
                           (f"_p_{n}", F.coalesce(F.sum(f"_t_{n}").over(prior), F.lit(0)) - F.coalesce(
                               F.max(F.col(f"_c_{n}") - F.col(f"_t_{n}") + F.col(f"_h_{n}")).over(prior),
                               F.lit(0)))])
            out.append((n, F.coalesce(lo - F.col(f"_m_{n}"), lo + F.coalesce(pre, F.lit(0)))))
    b = b.select("*", *first)
    if second:
        b = b.select("*", *second)
    state = b.groupBy(*keys, "_rb").agg(*blocks)
    for stage in range(max(len(p) for p in prefix)):
        state = state.select("*", *[p[stage][1].alias(p[stage][0]) for p in prefix if stage < len(p)])
    carried = [name for p in prefix for name, _ in p]
    b = b.join(state.select(*keys, "_rb", *carried), [*keys, "_rb"], "left")
    kept = [F.col(c) for c in df.columns if c not in totals]
    return b.select(*kept, *[c.alias(n) for n, c in out])
