"""Cross-validation and walk-forward splits as tables.

Membership follows from the row position by arithmetic, so no range join and no cross join is
needed. Input frames carry ``rn`` (position) and ``n`` (series length).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F



def _numbered(df: DataFrame, *extra: str) -> DataFrame:
    return df.select("symbol", "ts", "rn", "n", *extra)


def simple_kfold(df: DataFrame, k: int = 5) -> DataFrame:
    """Contiguous folds; the last one takes the remainder."""
    size = F.greatest(F.floor(F.col("n") / k), F.lit(1))
    fold = F.least(F.floor(F.col("rn") / size), F.lit(k - 1)).cast("int")
    return _numbered(df).select("symbol", "ts", fold.alias("fold"))


def fold_membership(df: DataFrame, k: int = 5) -> DataFrame:
    """One row per (row, fold) with its role."""
    rows = simple_kfold(df, k).withColumnRenamed("fold", "_own")
    rows = rows.withColumn("fold", F.explode(F.sequence(F.lit(0), F.lit(k - 1))))
    return rows.select("symbol", "ts", "fold", (F.col("fold") == F.col("_own")).alias("is_test"))


def purged_kfold(df: DataFrame, t1: str = "t1", k: int = 5, embargo: float = 0.01,
                 t0: str | None = None) -> DataFrame:
    """Train rows lose label overlap with the test fold and an embargo on both sides.

    By default only label ends are compared; with ``t0`` the whole label interval is.
    """
    rows = _numbered(df, t1, *([t0] if t0 else [])).withColumn(
        "fold", F.explode(F.sequence(F.lit(0), F.lit(k - 1))))
    lo = F.floor(F.col("fold") * F.col("n") / k)
    hi = F.floor((F.col("fold") + 1) * F.col("n") / k)
    rows = (rows.withColumn("_lo", lo).withColumn("_hi", hi)
            .withColumn("is_test", (F.col("rn") >= F.col("_lo")) & (F.col("rn") < F.col("_hi"))))
    spans = rows.filter("is_test").groupBy("symbol", "fold").agg(
        F.min(t0 or t1).alias("_t_min"), F.max(t1).alias("_t_max"))
    gap = F.floor(F.col("n") * embargo)
    overlap = (F.col(t1) >= F.col("_t_min")) & (F.col(t0 or t1) <= F.col("_t_max"))
    near = (F.col("rn") >= F.col("_lo") - gap) & (F.col("rn") < F.col("_hi") + gap)
    return rows.join(spans, ["symbol", "fold"]).select(
        "symbol", "ts", "fold", "is_test", (~overlap & ~near & ~F.col("is_test")).alias("is_train"))


def half_splits(spark: SparkSession, parts: int, limit: int | None = None) -> DataFrame:
    """Train/test choices of half the parts, as bit masks: all of them, or ``limit`` picked by a
    hash. Their number depends on ``parts`` only, whatever the data holds.
    """
    if parts % 2:
        raise ValueError("parts must be even")
    masks = spark.range(1 << parts).withColumnRenamed("id", "mask")
    masks = masks.filter(F.bit_count("mask") == parts // 2)
    if limit is None:
        return masks
    return masks.orderBy(F.md5(F.col("mask").cast("string")), "mask").limit(limit)


def in_mask(mask: str, part: str):
    return F.expr(f"(shiftright({mask}, cast({part} AS int)) & 1) = 1")


def cpcv_splits(spark: SparkSession, df: DataFrame, parts: int = 10,
                limit: int | None = None) -> DataFrame:
    """Rows of each symbol in train and test per combination of parts."""
    size = F.greatest(F.floor(F.col("n") / parts), F.lit(1))
    part = F.least(F.floor(F.col("rn") / size), F.lit(parts - 1)).cast("int")
    per = df.groupBy("symbol", part.alias("part")).agg(F.count(F.lit(1)).alias("rows"))
    masks = half_splits(spark, parts, limit).agg(F.collect_list("mask").alias("masks"))
    # one row with an array of masks, as many as `parts` allows
    per = per.join(F.broadcast(masks)).withColumn("mask", F.explode("masks"))
    train = in_mask("mask", "part")
    return per.groupBy("symbol", "mask").agg(
        F.sum(F.when(train, F.col("rows")).otherwise(0)).alias("train_rows"),
        F.sum(F.when(train, 0).otherwise(F.col("rows"))).alias("test_rows"))


def walk_forward(df: DataFrame, in_sample: int = 504, out_sample: int = 126, step: int = 63,
                 gap: int = 0, max_horizon: int = 1, expanding: bool = False) -> DataFrame:
    """Window bounds per symbol, as half-open row ranges."""
    n = df.groupBy("symbol").agg(F.max("n").alias("n"))
    last = F.col("n") - gap - out_sample - max_horizon
    starts = F.when(last >= in_sample, F.sequence(F.lit(in_sample).cast("bigint"), last,
                                                  F.lit(step).cast("bigint")))
    w = n.select("symbol", F.posexplode(starts).alias("window_id", "_s"))
    is_start = F.lit(0).cast("bigint") if expanding else F.col("_s") - in_sample
    return w.select("symbol", "window_id", is_start.alias("is_start"), F.col("_s").alias("is_end"),
                    (F.col("_s") + gap).alias("oos_start"),
                    (F.col("_s") + gap + out_sample).alias("oos_end"))


def window_membership(df: DataFrame, *carry: str, in_sample: int = 504, out_sample: int = 126,
                      step: int = 63, gap: int = 0, max_horizon: int = 1,
                      expanding: bool = False) -> DataFrame:
    """Rows with the walk-forward windows they fall in. Window w starts testing at
    in_sample + w * step, so the windows of a row are an integer range."""
    rn, n = F.col("rn"), F.col("n")
    last = F.floor((n - gap - out_sample - max_horizon - in_sample) / step)

    def span(lo, hi):
        lo, hi = F.greatest(lo, F.lit(0)), F.least(hi, last)
        return F.when((last >= 0) & (lo <= hi), F.sequence(lo, hi))

    # in-sample: s - in_sample <= rn < s ; out-of-sample: s + gap <= rn < s + gap + out_sample
    in_lo = F.floor((rn - in_sample) / step) + 1
    in_hi = last if expanding else F.floor(rn / step)
    out_lo = F.floor((rn - in_sample - gap - out_sample) / step) + 1
    out_hi = F.floor((rn - in_sample - gap) / step)
    both = F.concat(
        F.transform(F.coalesce(span(in_lo, in_hi), F.array().cast("array<bigint>")),
                    lambda w: F.struct(w.alias("window_id"), F.lit("IS").alias("role"))),
        F.transform(F.coalesce(span(out_lo, out_hi), F.array().cast("array<bigint>")),
                    lambda w: F.struct(w.alias("window_id"), F.lit("OOS").alias("role"))))
    return _numbered(df, *carry).select("symbol", "ts", "rn", *carry, F.explode(both).alias("_w")) \
        .select("symbol", "ts", "rn", *carry, "_w.window_id", "_w.role")


def concat_oos(members: DataFrame) -> DataFrame:
    """All out-of-sample rows of all windows; rows of overlapping windows repeat."""
    return members.filter(F.col("role") == "OOS").drop("role")


def time_series_split(df: DataFrame, k: int = 5, gap: int = 0, test_size: int | None = None,
                      max_train: int | None = None) -> DataFrame:
    """Expanding (or capped) train range before each of the last k test ranges."""
    n = df.groupBy("symbol").agg(F.max("n").alias("n"))
    size = F.lit(test_size).cast("bigint") if test_size else F.floor(F.col("n") / (k + 1))
    n = n.withColumn("_size", size).withColumn("fold", F.explode(F.sequence(F.lit(0), F.lit(k - 1))))
    test_start = F.col("n") - (F.lit(k) - F.col("fold")) * F.col("_size")
    train_end = test_start - gap
    train_start = (F.greatest(train_end - max_train, F.lit(0)) if max_train
                   else F.lit(0)).cast("bigint")
    return n.select("symbol", "fold", train_start.alias("train_start"),
                    train_end.alias("train_end"), test_start.alias("test_start"),
                    (test_start + F.col("_size")).alias("test_end"))


def time_split(df: DataFrame, share: float = 0.8) -> DataFrame:
    return _numbered(df).select("symbol", "ts",
                                (F.col("rn") < F.floor(F.col("n") * share)).alias("is_train"))
