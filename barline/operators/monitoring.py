"""Information coefficients and drift of features, concept and predictions."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from barline.functions import corr_agg, corr_over, ratio, zero_if_null
from barline.functions.cols import rows
from barline.operators.tables import last_n
from barline.plans.ranks import running_counts
from barline.plans.series import block_window, core_rows, in_blocks

IC_KEYS = ("signal", "horizon")


def forecast_ic(matched: DataFrame, last: int | None = None) -> DataFrame:
    """Correlation of score and outcome per signal and horizon, over all or the newest rows."""
    if last:
        matched = last_n(matched, last, IC_KEYS, ["ts"], F.date_trunc("quarter", "ts"))
    return matched.groupBy(*IC_KEYS).agg(corr_agg("score", "actual").alias("ic"),
                                         F.count(F.lit(1)).alias("rows"))


def rolling_ic(matched: DataFrame, window: int = 20, block_rows: int | None = None) -> DataFrame:
    """Correlation over the last ``window`` rows, from the first full window on."""
    df = in_blocks(matched, window - 1, keys=IC_KEYS, block_rows=block_rows)
    f = rows(block_window(IC_KEYS), window)
    df = df.withColumn("ic", corr_over("score", "actual", f)).withColumn(
        "_full", F.count(F.lit(1)).over(f) == window)
    return core_rows(df.filter("_full"), drop_rn=False).select(*IC_KEYS, "ts", "rn", "ic")


def ic_stats(rolling: DataFrame, alert: float = 0.05) -> DataFrame:
    sd = F.when(F.min("ic") < F.max("ic"), F.stddev_pop("ic")).otherwise(0.0)
    out = rolling.groupBy(*IC_KEYS).agg(F.avg("ic").alias("mean_ic"), sd.alias("std_ic"),
                                        F.avg(F.when(F.col("ic") > 0, 1.0).otherwise(0.0))
                                        .alias("positive_share"))
    return (out.withColumn("ic_ir", zero_if_null(ratio("mean_ic", "std_ic")))
            .withColumn("alert", F.col("mean_ic") < alert))


def ic_half_life(rolling: DataFrame, block_rows: int | None = None) -> DataFrame:
    """-ln 2 / ln(lag-1 autocorrelation); NULL below 10 rows or without positive correlation."""
    df = in_blocks(rolling.drop("rn"), 1, keys=IC_KEYS, block_rows=block_rows)
    df = core_rows(df.withColumn("_prev", F.lag("ic").over(block_window(IC_KEYS))))
    r = df.groupBy(*IC_KEYS).agg(corr_agg("_prev", "ic", None).alias("_r"),
                                 F.count(F.lit(1)).alias("_n"))
    life = F.when((F.col("_n") >= 10) & (F.col("_r") > 0) & (F.col("_r") < 1),
                  -math.log(2) / F.log("_r"))
    return r.select(*IC_KEYS, F.col("_r").alias("autocorrelation"), life.alias("half_life"))


def ic_decay(rolling: DataFrame, periods: int = 252) -> DataFrame:
    """Yearly slope of the rolling coefficient; NULL below 20 rows."""
    x = F.col("rn").cast("double")
    slope = F.when(F.count(F.lit(1)) >= 20, ratio(F.covar_samp(x, "ic"), F.var_samp(x)) * periods)
    return rolling.groupBy(*IC_KEYS).agg(slope.alias("decay_rate"))


# ---- drift -----------------------------------------------------------------------------------
# Reference and current samples are long tables (feature, value).

def psi(reference: DataFrame, current: DataFrame, bins: int = 10) -> DataFrame:
    """Population stability index over equal bins of the reference range.

    Current values outside the range leave the bins but stay in the denominator.
    """
    ref, cur = (d.filter(F.col("value").isNotNull()) for d in (reference, current))
    span = ref.groupBy("feature").agg(F.min("value").alias("_a"), F.max("value").alias("_b"),
                                      F.count(F.lit(1)).alias("_nr"))
    flat = F.col("_a") == F.col("_b")
    span = span.select("feature", "_nr", F.when(flat, F.col("_a") - 0.5).otherwise(F.col("_a")).alias("_lo"),
                       F.when(flat, F.col("_b") + 0.5).otherwise(F.col("_b")).alias("_hi"))
    both = (ref.select("feature", "value", F.lit(1).alias("_r"), F.lit(0).alias("_c"))
            .unionByName(cur.select("feature", "value", F.lit(0).alias("_r"), F.lit(1).alias("_c"))))
    pos = F.floor(ratio(F.col("value") - F.col("_lo"), (F.col("_hi") - F.col("_lo")) / bins))
    inside = (F.col("value") >= F.col("_lo")) & (F.col("value") <= F.col("_hi"))
    binned = both.join(span, "feature").withColumn(
        "bin", F.when(inside, F.least(pos, F.lit(bins - 1))))
    per = binned.groupBy("feature", "bin").agg(
        F.sum("_r").alias("_r"), F.sum("_c").alias("_c"), F.max("_nr").alias("_nr"))
    nc = per.groupBy("feature").agg(F.sum("_c").alias("_nc"))

    def share(k, n):
        return F.when(F.col(k) == 0, 1e-6).otherwise(ratio(k, n))
    r, c = share("_r", "_nr"), share("_c", "_nc")
    return (per.join(nc, "feature").groupBy("feature")
            .agg(zero_if_null(F.sum(F.when(F.col("bin").isNotNull(), (c - r) * F.log(c / r))))
                 .alias("psi")))


def ks_pvalue_sql(lam: str, terms: int = 25) -> str:
    """Two-sided asymptotic tail as SQL text over the scaled statistic."""
    series = " ".join(f"{'+' if k % 2 else '-'} exp(-{2 * k * k}e0 * ({lam}) * ({lam}))"
                      for k in range(1, terms + 1))
    return f"(CASE WHEN ({lam}) < 0.2e0 THEN 1e0 ELSE least(greatest(2e0 * (0e0 {series}), 0e0), 1e0) END)"


def ks_test(spark: SparkSession, reference: DataFrame, current: DataFrame) -> DataFrame:
    """Two-sample Kolmogorov-Smirnov statistic and asymptotic p-value per feature.

    Ties collapse first. The values of all features are ranged over all tasks, in order, and the running
    shares go on from task to task by a prefix over their counts; nothing is looked up per value.
    """
    both = (reference.select("feature", "value", F.lit(1).alias("_r"), F.lit(0).alias("_c"))
            .unionByName(current.select("feature", "value", F.lit(0).alias("_r"),
                                        F.lit(1).alias("_c")))
            .filter(F.col("value").isNotNull()))
    counts = both.groupBy("feature", "value").agg(F.sum("_r").alias("_r"), F.sum("_c").alias("_c"))
    run = running_counts(counts, ["feature"], "value", ["_r", "_c"], "ks-counts")
    gap = F.abs(ratio("up__r", "all__r") - ratio("up__c", "all__c"))
    out = run.groupBy("feature").agg(
        F.max(gap).alias("ks_statistic"), F.max("all__r").cast("double").alias("_n"),
        F.max("all__c").cast("double").alias("_m"))
    out = out.withColumn("_lam", F.sqrt(ratio(F.col("_n") * F.col("_m"), F.col("_n") + F.col("_m")))
                         * F.col("ks_statistic"))
    return out.select("feature", "ks_statistic", F.expr(ks_pvalue_sql("_lam")).alias("p_value"))


def _ladder(high: Column, medium: Column, drifted: Column) -> Column:
    return F.when(drifted & high, "high").when(drifted & medium, "medium").otherwise("low")


def data_drift(spark: SparkSession, reference: DataFrame, current: DataFrame,
               psi_limit: float = 0.2, p_limit: float = 0.05) -> DataFrame:
    """One row over all features: worst values, drifted features (by name) and severity."""
    per = psi(reference, current).join(ks_test(spark, reference, current), "feature")
    bad = (F.col("psi") > psi_limit) | (F.col("p_value") < p_limit)
    out = per.agg(F.max("psi").alias("psi"), F.min("p_value").alias("p_value"),
                  F.max("ks_statistic").alias("ks_statistic"),
                  F.array_sort(F.collect_list(F.when(bad, F.col("feature")))).alias("_f"))
    hit = F.size("_f") > 0
    return out.select(
        F.lit("data").alias("drift_type"), hit.alias("drift_detected"),
        _ladder((F.col("psi") > 0.5) | (F.col("p_value") < 0.01),
                (F.col("psi") > 0.3) | (F.col("p_value") < 0.03), hit).alias("severity"),
        "psi", "p_value", "ks_statistic", F.concat_ws(",", "_f").alias("drifted_features"))


def concept_drift(matched: DataFrame, window: int = 100, min_rows: int = 50,
                  keys: Sequence[str] = IC_KEYS) -> DataFrame:
    """Drop of the coefficient from the first to the second half of the newest rows."""
    last = last_n(matched, window, keys, ["ts"], F.date_trunc("quarter", "ts"))
    w = Window.partitionBy(*keys)  # at most `window` rows per key here
    last = (last.withColumn("_n", F.count(F.lit(1)).over(w))
            .withColumn("_i", F.row_number().over(w.orderBy("ts")) - 1))
    first = F.col("_i") < F.floor(F.col("_n") / 2)

    def ic(cond):
        return corr_agg(F.when(cond, F.col("score")), F.when(cond, F.col("actual")))
    out = last.groupBy(*keys).agg(ic(first).alias("ic_first"), ic(~first).alias("ic_second"),
                                  F.max("_n").alias("_n"))
    drop = F.col("ic_first") - F.col("ic_second")
    hit = (F.col("_n") >= min_rows) & (drop > 0.1)
    return out.select(*keys, "ic_first", "ic_second", drop.alias("ic_drop"),
                      hit.alias("drift_detected"),
                      _ladder(drop > 0.3, drop > 0.2, hit).alias("severity"))


def prediction_drift(spark: SparkSession, reference: DataFrame, current: DataFrame,
                     p_limit: float = 0.05) -> DataFrame:
    """KS test plus shifts of mean and deviation, per feature (a model or signal)."""
    def moments(df, s):
        return df.groupBy("feature").agg(F.avg("value").alias(f"_m{s}"),
                                         F.stddev_pop("value").alias(f"_s{s}"))
    out = (ks_test(spark, reference, current).join(moments(reference, "r"), "feature")
           .join(moments(current, "c"), "feature")
           .withColumn("mean_shift", F.abs(F.col("_mc") - F.col("_mr")))
           .withColumn("std_shift", F.abs(F.col("_sc") - F.col("_sr"))))
    p, shift = F.col("p_value"), F.col("mean_shift")
    hit = (p < p_limit) | (shift > 0.1)
    return out.select("feature", "ks_statistic", "p_value", "mean_shift", "std_shift",
                      hit.alias("drift_detected"),
                      _ladder((p < 0.01) | (shift > 0.2), (p < 0.03) | (shift > 0.15), hit)
                      .alias("severity"))


def drift_report(data: DataFrame, concept: DataFrame, prediction: DataFrame) -> DataFrame:
    """All checks in one table: type, subject, verdict, severity."""
    def part(df, kind, subject):
        return df.select(F.lit(kind).alias("drift_type"), subject.alias("subject"),
                         "drift_detected", "severity")
    return (part(data, "data", F.lit("all"))
            .unionByName(part(concept, "concept", F.col("signal")))
            .unionByName(part(prediction, "prediction", F.col("feature"))))
