"""Positions inside groups of any size.

A window over a bare key puts a key's rows into one task. Here sampled range partitioning deals the
rows, in order, over all tasks, wherever a group begins or ends; a prefix over the counts per
(group, task) carries the numbering on.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barline.sources.stored import stage


def dealt(df: DataFrame, order: list[Column], name: str = "dealt", part: str = "part") -> DataFrame:
    """``df`` as a written table, range-partitioned by ``order``; ``part`` numbers the ranges
    upwards. Rows equal in all of ``order`` share a range."""
    return stage(df.repartitionByRange(*order).withColumn(part, F.spark_partition_id()), name)


def numbered(df: DataFrame, group: str, order: list[Column], position: str = "pos", total: str = "n",
             name: str = "numbered") -> DataFrame:
    """``df`` with its position (from 0) by ``order`` inside ``group``, a column without nulls, and
    the group's number of rows. Ties in ``order`` stand in any order, so make it total."""
    rows = dealt(df, [F.col(group), *order], name, "_part")
    along = Window.partitionBy(group).orderBy("_part")
    parts = rows.groupBy(group, "_part").agg(F.count("*").alias("_rows"))
    parts = parts.select(group, "_part", (F.sum("_rows").over(along) - F.col("_rows")).alias("_before"),
                         F.sum("_rows").over(Window.partitionBy(group)).alias(total))
    inside = F.row_number().over(Window.partitionBy(group, "_part").orderBy(*order)) - 1
    return (rows.withColumn("_inside", inside).join(parts, [group, "_part"])
            .withColumn(position, F.col("_before") + F.col("_inside")).drop("_part", "_inside", "_before"))


def same(left: str, right: str, keys: Sequence[str]) -> Column:
    """Equal keys of two aliased frames, NULL equal to NULL."""
    out = F.lit(True)
    for k in keys:
        out = out & F.col(f"{left}.{k}").eqNullSafe(F.col(f"{right}.{k}"))
    return out


def running_counts(counts: DataFrame, keys: Sequence[str], value: str, sums: Sequence[str], name: str = "value-counts") -> DataFrame:
    """``counts`` (one row per key and value) with, for each of ``sums``, its running total up to and
    including the row in the order of ``value`` (``up_<sum>``) and the key's total (``all_<sum>``)."""
    keys = list(keys)
    rows = dealt(counts.select(*keys, value, *sums), [*map(F.col, keys), F.col(value)], name, "_part")
    per_key = Window.partitionBy(*keys) if keys else Window.partitionBy(F.lit(0))
    earlier = per_key.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    parts = rows.groupBy(*keys, "_part").agg(*[F.sum(s).alias(f"_{s}") for s in sums])
    parts = parts.select(*keys, "_part", *[F.coalesce(F.sum(f"_{s}").over(earlier), F.lit(0)).alias(f"_before_{s}") for s in sums],
                         *[F.sum(f"_{s}").over(per_key).alias(f"all_{s}") for s in sums])
    inside = Window.partitionBy(*keys, "_part").orderBy(value).rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.select("*", *[F.sum(s).over(inside).alias(f"_in_{s}") for s in sums])
    out = rows.alias("r").join(parts.alias("p"), same("r", "p", [*keys, "_part"]))
    return out.select(*[F.col(f"r.{c}") for c in (*keys, value, *sums)],
                      *[(F.col(f"_before_{s}") + F.col(f"_in_{s}")).alias(f"up_{s}") for s in sums],
                      *[F.col(f"all_{s}") for s in sums])


def quantiles(df: DataFrame, keys: Sequence[str], value: str, shares: dict[str, float]) -> DataFrame:
    """Exact quantiles per key, between neighbouring values as ``percentile`` does, by counting: values are
    counted, ranged over all tasks and numbered by running counts, so no task holds a key's values."""
    keys = list(keys)
    counts = df.where(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count(F.lit(1)).alias("n"))
    ranked = running_counts(counts, keys, value, ["n"], "quantile-counts")
    below = F.col("up_n") - F.col("n")

    def at(rank):
        return F.max(F.when((below <= rank) & (rank < F.col("up_n")), F.col(value).cast("double")))
    found, out = [], []
    for name, q in shares.items():
        place = (F.col("all_n") - 1) * F.lit(float(q))
        found += [at(F.floor(place)).alias(f"_lo_{name}"), at(F.ceil(place)).alias(f"_hi_{name}"), F.max(place).alias(f"_at_{name}")]
        lo, hi, where = (F.col(f"_{x}_{name}") for x in ("lo", "hi", "at"))
        between = (F.ceil(where) - where) * lo + (where - F.floor(where)) * hi
        out.append(F.when(lo == hi, lo).otherwise(between).alias(name))
    return ranked.groupBy(*keys).agg(*found).select(*keys, *out)
