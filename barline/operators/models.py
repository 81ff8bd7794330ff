"""Model training, scoring and ensembles on MLlib. Splits follow time, never chance.

Fits are pooled over symbols unless asked otherwise. Fits of folds, windows, symbols or parameter
choices run side by side over one assembled table (``fits``).
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Sequence

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.feature import OneHotEncoder, StringIndexer, VectorAssembler
from pyspark.ml.regression import GBTRegressor, LinearRegression
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barline.functions import corr_agg, ratio, zero_if_null
from barline.operators import fits
from barline.operators.labels import npmm_label
from barline.operators.stats import confusion_metrics, kurtosis_agg, sharpe_agg, skew_agg, with_psr
from barline.operators.tables import latest_wins
from barline.plans.series import number_rows
from barline.sources.stored import stage

# Sector membership and the published ranks of indicators.
SECTORS = {"tech": ("AAPL", "MSFT", "GOOGL", "AMZN", "NVDA", "TSLA", "META", "AMD", "INTC", "NFLX"),
           "finance": ("JPM", "GS"), "healthcare": ("JNJ", "UNH", "PFE"), "energy": ("XOM", "CVX")}
PUBLISHED_RANKS = {"squeeze_pro": 1, "ppo": 2, "macd": 3, "roc_63": 4, "rsi_63": 5}

# Category by the first matching part of the name, tested in this order.
CATEGORIES = [(["squeeze"], "Volatility Squeeze"),
              (["rsi", "roc", "ppo", "stoch", "williams"], "Momentum"),
              (["macd"], "Trend (MACD)"), (["adx", "di"], "Trend (ADX)"),
              (["sma", "ema", "ma"], "Moving Average"), (["bb", "bollinger"], "Volatility (BB)"),
              (["kc", "keltner"], "Volatility (KC)"), (["atr", "natr"], "Volatility (ATR)"),
              (["vwap", "obv", "volume"], "Volume"), (["return"], "Returns"),
              (["price", "cross"], "Price Pattern"), (["_ffd"], "Fractional Diff"),
              (["_zscore"], "Normalized")]


# ---- estimators ------------------------------------------------------------------------------

def as_doubles(df: DataFrame, names: Sequence[str]) -> DataFrame:
    return df.withColumns({n: F.col(n).cast("double") for n in names})


def score_rows(model, df: DataFrame) -> DataFrame:
    """``df`` with class, both probabilities, confidence, and score 2 * class - 1."""
    return fits.scored(model, df)


POOLED = "_pooled"


def split_groups(rows: DataFrame, names: Sequence[str], by: str = POOLED, share: float = 0.8, late: float = 0.15,
                 carry: Sequence[str] = ()) -> fits.Groups:
    """Rows assembled for one fit per value of ``by`` (one for all by default): the first ``share`` of
    each series trains, and the last part of that, ``late``, judges the rounds. ``rows`` carries rn, n, label."""
    early = F.floor(F.col("n") * share)
    if by == POOLED:
        rows = rows.withColumn(POOLED, F.lit(0))
    return fits.Groups(rows, names, by, F.col("rn") < early, carry, late=F.col("rn") >= F.floor(early * (1 - late)))


def gbt_train(rows: DataFrame, names: Sequence[str], share: float = 0.8, stop: bool = True, **params):
    """Fits on the first share of each series, and stops when the last part of that gains no more;
    returns the model and the later rows, scored. ``rows`` carries rn, n and label."""
    groups = split_groups(rows, names, share=share)
    model = groups.whole_model(0, fits.boosted(groups.part(0).where("_train"), stop=stop, **params))
    return model, score_rows(model, as_doubles(rows, names).filter(F.col("rn") >= F.floor(F.col("n") * share)))


def gbt_train_each(rows: DataFrame, names: Sequence[str], by: str = "symbol", share: float = 0.8, stop: bool = True,
                   keep: Sequence[str] = ("ts", "label"), **params):
    """A model per symbol, fitted side by side: {symbol: model for rows as they come} and the later rows,
    scored each by its own. A symbol whose training rows have one class has no model and predicts that."""
    groups = split_groups(rows, names, by, share, carry=[c for c in keep if c != "label"])
    trees, scores = fits.fit_groups(groups, keep, stop=stop, **params)
    return {v: groups.whole_model(v, t) if t else None for v, t in trees.items()}, scores


def npmm_training(features: DataFrame, bars: DataFrame, n: int = 5, threshold: float = 0.02) -> DataFrame:
    """``features`` (symbol, ts, ...) at confirmed lows (label 1) and highs (label 0) of ``bars``; rows
    between them take no part, and rn and n count the labelled rows alone."""
    marks = npmm_label(bars, n, threshold).where("npmm_label <> 0").select(
        "symbol", "ts", (F.col("npmm_label") == 1).cast("int").alias("label"))
    return number_rows(marks, with_total=True).join(features, ["symbol", "ts"], "left")


def gbt_importance(model, names: Sequence[str], spark) -> DataFrame:
    """Importance per feature with its rank; a model's features are a bounded list."""
    values = model.stages[-1].featureImportances.toArray().tolist()
    df = spark.createDataFrame(list(zip(names, values)), "feature string, importance double")
    return top_features(df, len(names))


def top_features(importances: DataFrame, n: int) -> DataFrame:
    """The n most important features, ties by name. ``rank`` starts at 1."""
    best = importances.orderBy(F.desc("importance"), "feature").limit(n)
    order = Window.partitionBy(F.lit(0)).orderBy(F.desc("importance"), "feature")
    return best.withColumn("rank", F.row_number().over(order))


def param_search(rows: DataFrame, names: Sequence[str], choices: int | list[dict] = 27, share: float = 0.8,
                 seed: int = 42, keep: int = 3, first_trees: int = 2) -> DataFrame:
    """Successive halving over choices of nine parameters, drawn from ``fits.SPACE`` unless given. A choice
    fits on the first ``share`` of each series and is judged on the rest, so nothing from later on
    enters a fit. One row per choice and rung: choice, rung, trees, accuracy, survives, params, rows."""
    groups = split_groups(rows, names, share=share)
    total, fitted = groups.rows.get(0, (0, 0))
    drawn = fits.drawn(choices, seed) if isinstance(choices, int) else choices
    found = fits.halving_search(groups, 0, drawn, keep, first_trees) if fitted else []
    out = [(x["choice"], x["rung"], x["trees"], x["accuracy"], x["survives"], str(sorted(x["params"].items())), total - fitted)
           for x in found]
    return rows.sparkSession.createDataFrame(
        out, "choice int, rung int, trees int, accuracy double, survives boolean, params string, rows bigint")


def purged_cv_score(rows: DataFrame, names: Sequence[str], k: int = 5, gap: int = 5,
                    min_train: int = 100, min_test: int = 20, **params) -> DataFrame:
    """Accuracy on each next fold after training on everything before it, less a gap."""
    size, rn = F.floor(F.col("n") / k), F.col("rn")
    roles = F.filter(F.transform(F.sequence(F.lit(0), F.lit(k - 2)), lambda i: F.struct(
        i.alias("fold"), (rn < (i + 1) * size - gap).alias("train"),
        ((rn >= (i + 1) * size) & (rn < (i + 2) * size)).alias("test"))), lambda x: x["train"] | x["test"])
    rows = rows.withColumn("_role", F.explode(roles)).withColumn("fold", F.col("_role.fold")).withColumn("_in", F.col("_role.train"))
    groups = fits.Groups(rows.drop("_role"), names, "fold", F.col("_in"))
    groups.values = [v for v in groups.values if groups.rows[v][1] >= min_train and groups.rows[v][0] - groups.rows[v][1] >= min_test]
    _, scores = fits.fit_groups(groups, ["label"], **params)
    return scores.groupBy(F.col("fold").cast("int").alias("fold")).agg(
        F.avg((F.col("predicted") == F.col("label")).cast("double")).alias("accuracy"), F.count(F.lit(1)).alias("rows"))


def cv_summary(scores: DataFrame) -> DataFrame:
    return scores.agg(F.avg("accuracy").alias("mean_score"), F.stddev_pop("accuracy").alias("std_score"),
                      F.count(F.lit(1)).alias("folds"))


# ---- walk-forward ----------------------------------------------------------------------------

def walk_forward_fit(members: DataFrame, names: Sequence[str], stop: bool = True, late: float = 0.15, **params) -> DataFrame:
    """Out-of-sample predictions: one pooled fit per window, side by side over one assembled table. With
    ``stop`` the last part, ``late``, of each symbol's in-sample rows judges the rounds.

    ``members`` has symbol, ts, rn, window_id, role, label and ret."""
    inside = F.col("role") == "IS"
    ends = members.where(inside).groupBy("symbol", "window_id").agg(F.min("rn").alias("_lo"), F.max("rn").alias("_hi"))
    rows = members.join(ends, ["symbol", "window_id"], "left")
    groups = fits.Groups(rows, names, "window_id", inside, ["symbol", "ts", "ret"],
                         late=F.col("rn") > F.col("_lo") + (F.col("_hi") - F.col("_lo")) * (1 - late))
    _, scores = fits.fit_groups(groups, ["symbol", "ts", "label", "ret"], stop=stop, **params)
    return scores


def wfo_report(oos: DataFrame, min_rows: int = 20) -> DataFrame:
    """Per window: accuracy and Sharpe of the asset's own and of the strategy's returns.

    Needs symbol, window_id, label, predicted, ret.
    """
    df = oos.withColumn("strategy_return", F.when(F.col("predicted") == 1, F.col("ret")).otherwise(0.0))
    out = df.groupBy("symbol", "window_id").agg(
        F.count(F.lit(1)).alias("rows"),
        F.avg((F.col("predicted") == F.col("label")).cast("double")).alias("accuracy"),
        sharpe_agg("ret").alias("oos_sharpe"), sharpe_agg("strategy_return").alias("strategy_sharpe"))
    return out.filter(F.col("rows") >= min_rows)


def wfo_overall(oos: DataFrame) -> DataFrame:
    m = oos.groupBy("symbol").agg(sharpe_agg("ret").alias("sharpe"), skew_agg("ret").alias("skew"),
                                  kurtosis_agg("ret").alias("kurtosis"), F.count("ret").alias("rows"))
    return with_psr(m).select("symbol", "sharpe", "psr", "rows")


# ---- registry and ensembles ------------------------------------------------------------------

def register_version(registry_path: str, versions: DataFrame) -> None:
    versions.write.mode("append").parquet(registry_path)


def latest_model(registry: DataFrame) -> DataFrame:
    """Newest registered version per symbol."""
    return latest_wins(registry, ["symbol"], [F.col("created_at"), F.col("version")])


REGISTRY = "symbol string, version string, path string, created_at timestamp, accuracy double, rows bigint"


def save_models(spark, root: str, version: str, models: dict, scores: DataFrame, by: str = "symbol") -> None:
    """Writes every model under ``root`` and then its registry row, so a listed version is a whole one.
    ``scores`` (by, label, predicted) gives the rows and the accuracy on record."""
    hit = F.avg((F.col("predicted") == F.col("label")).cast("double"))
    facts = {r[0]: (r[1], r[2]) for r in scores.groupBy(by).agg(hit, F.count(F.lit(1))).collect()}  # one row per model
    kept = [(v, f"{root}/models/{fits.value_name(v)}/{version}") for v, m in models.items() if m]
    fits.concurrently(spark, [lambda m=models[v], path=path: m.write().save(path) for v, path in kept])
    now = dt.datetime.now(dt.timezone.utc)
    rows = [(str(v), version, path, now, *(facts.get(v) or (None, 0))) for v, path in kept]
    register_version(f"{root}/registry", spark.createDataFrame(rows, REGISTRY))


def model_versions(spark, root: str) -> DataFrame:
    return spark.read.schema(REGISTRY).parquet(f"{root}/registry")


def load_newest(spark, root: str) -> dict[str, PipelineModel]:
    """The newest stored model of every symbol: one registry row each."""
    return {r["symbol"]: PipelineModel.load(r["path"]) for r in latest_model(model_versions(spark, root)).collect()}


def score_newest(spark, root: str, rows: DataFrame, names: Sequence[str], by: str = "symbol") -> DataFrame:
    """``rows`` scored, each symbol by its newest stored model; symbols without one are left out."""
    rows, out = as_doubles(rows, names), None
    for value, model in sorted(load_newest(spark, root).items()):
        part = score_rows(model, rows.where(F.col(by) == value))
        out = part if out is None else out.unionByName(part)
    return out


def sector_map(df: DataFrame, sectors: dict[str, Sequence[str]] | None = None,
               symbol: str = "symbol") -> DataFrame:
    """Sector per symbol, from a lookup of a few dozen rows."""
    pairs = [(s, k) for k, members in (sectors or SECTORS).items() for s in members]
    lookup = df.sparkSession.createDataFrame(pairs, f"{symbol} string, sector string")
    return df.join(F.broadcast(lookup), symbol, "left").withColumn(
        "sector", F.coalesce("sector", F.lit("other")))


def market_aggregate(df: DataFrame) -> DataFrame:
    """Market state per time step: means over symbols of volatility, trend and return."""
    sd = F.when(F.min("ret") < F.max("ret"), F.stddev_pop("ret")).otherwise(0.0)
    return df.groupBy("ts").agg(F.avg("volatility").alias("market_volatility"),
                                F.avg("trend").alias("market_trend"),
                                F.avg("ret").alias("market_return"), sd.alias("market_return_sd"))


def meta_features(predictions: DataFrame, market: DataFrame, symbols: Sequence[str],
                  sectors: dict[str, Sequence[str]]) -> DataFrame:
    """One row per time step: score and confidence per symbol, cross-section, sectors, market."""
    cells = [F.first(F.when(F.col("symbol") == s, F.col(c)), ignorenulls=True).alias(f"{c}_{s}")
             for c in ("score", "confidence") for s in sorted(symbols)]

    def spread(c, name):
        return [F.avg(c).alias(f"{name}_mean"), zero_if_null(F.stddev_pop(c)).alias(f"{name}_std")]
    cross = [*spread("score", "score"), F.count(F.when(F.col("score") > 0, 1)).alias("bullish"),
             F.count(F.when(F.col("score") < 0, 1)).alias("bearish"),
             *spread("confidence", "confidence")]
    per_sector = []
    for name, members in sectors.items():
        c = F.when(F.col("symbol").isin(*members), F.col("score"))
        per_sector += [zero_if_null(F.avg(c)).alias(f"{name}_mean"),
                       zero_if_null(F.stddev_pop(c)).alias(f"{name}_std")]
    wide = predictions.groupBy("ts").agg(*cells, *cross, *per_sector)
    state = [c for c in market.columns if c != "ts"]
    return wide.join(market, "ts", "left").na.fill(0.0, state)


def meta_learner(rows: DataFrame, names: Sequence[str], target: str = "target",
                 kind: str = "ridge", symbol: str | None = "symbol"):
    """Regresses the target on meta features; the target's symbol is a feature too."""
    rows = as_doubles(rows, names)
    stages, inputs = [], list(names)
    if symbol:
        stages = [StringIndexer(inputCol=symbol, outputCol="_si", handleInvalid="keep"),
                  OneHotEncoder(inputCol="_si", outputCol="_sv")]
        inputs.append("_sv")
    est = {"ridge": lambda: LinearRegression(labelCol=target, regParam=1.0, elasticNetParam=0.0),
           "linear": lambda: LinearRegression(labelCol=target),
           "boosted": lambda: GBTRegressor(labelCol=target, maxIter=50, maxDepth=3, stepSize=0.1,
                                           seed=42)}[kind]()
    model = Pipeline(stages=[*stages, VectorAssembler(inputCols=inputs, outputCol="features"), est]).fit(rows)
    return model, model.transform(rows)


def regression_metrics(df: DataFrame, target: str = "target", predicted: str = "prediction") -> DataFrame:
    e = F.col(predicted) - F.col(target)
    return df.agg(F.avg(e * e).alias("mse"), F.avg(F.abs(e)).alias("mae"),
                  corr_agg(predicted, target).alias("correlation"), F.count(F.lit(1)).alias("rows"))


def oof_stack(rows: DataFrame, names: Sequence[str], bases: dict, k: int = 5,
              target: str = "target", by_time: bool = True, ridge: float = 1.0):
    """Out-of-fold predictions of every base model, a linear learner on top, bases refit on all.

    ``by_time`` cuts contiguous folds; otherwise rows are spread by hash, which leaks on series.
    """
    fold = (F.least(F.floor(F.col("rn") * k / F.col("n")), F.lit(k - 1)) if by_time
            else F.pmod(F.xxhash64("symbol", "rn"), F.lit(k))).cast("int")
    rows = as_doubles(rows, names)
    data = stage(VectorAssembler(inputCols=list(names), outputCol="features").transform(
        rows.na.fill(0.0, list(names))).withColumn("_fold", fold), "stack-rows")
    spark = data.sparkSession
    jobs = [(i, name) for i in range(k) for name in bases] + [(None, name) for name in bases]
    fitted = dict(zip(jobs, fits.concurrently(spark, [
        lambda i=i, name=name: bases[name].fit(data if i is None else data.filter(F.col("_fold") != i)) for i, name in jobs]), strict=True))
    parts = None
    for i in range(k):
        held = data.filter(F.col("_fold") == i)
        for name in bases:
            held = fitted[i, name].transform(held).withColumnRenamed("prediction", name)
        parts = held if parts is None else parts.unionByName(held)
    stacked = VectorAssembler(inputCols=list(bases), outputCol="base_predictions").transform(parts)
    top = LinearRegression(featuresCol="base_predictions", labelCol=target, regParam=ridge,
                           elasticNetParam=0.0).fit(stacked)
    finals = {name: fitted[None, name] for name in bases}
    return top, finals, top.transform(stacked).drop("features", "base_predictions", "_fold")


def meta_importance(model, names: Sequence[str], spark) -> DataFrame:
    """Absolute coefficient per base model."""
    return spark.createDataFrame([(n, abs(float(c))) for n, c in zip(names, model.coefficients)],
                                 "model string, importance double")


def blend(predictions: DataFrame, weights: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Weight-normalised average; ``predictions`` is long: keys, model, prediction. ``weights`` has a
    row per model and goes to every task: a join by model would put all rows of a model into one."""
    return predictions.join(F.broadcast(weights), "model").groupBy(*keys).agg(
        ratio(F.sum(F.col("weight") * F.col("prediction")), F.sum("weight")).alias("blended"))


# ---- reports ---------------------------------------------------------------------------------

def indicator_category(name: str = "feature") -> Column:
    low = F.lower(name)
    out = F.lit("Other")
    for parts, label in reversed(CATEGORIES):
        hit = low.contains(parts[0])
        for p in parts[1:]:
            hit = hit | low.contains(p)
        out = F.when(hit, label).otherwise(out)
    return out


def base_name(name: str = "feature") -> Column:
    return F.regexp_replace(F.regexp_replace(F.lower(name), "_zscore", ""), "_ffd", "")


def contribution_summary(contributions: DataFrame, *keys: str) -> DataFrame:
    """Mean absolute contribution per feature."""
    return contributions.groupBy(*keys, "feature").agg(
        F.avg(F.abs(F.col("contribution"))).alias("importance"))


def symbol_rankings(fitted: dict, names: Sequence[str], spark) -> DataFrame:
    """Features of every symbol's model by importance, ties by name: symbol, feature, importance, rank.
    A symbol without a model has no rows; there is one row per model and feature."""
    rows = [(str(symbol), name, float(share)) for symbol, model in sorted(fitted.items()) if model
            for name, share in zip(names, model.stages[-1].featureImportances.toArray(), strict=True)]
    df = spark.createDataFrame(rows, "symbol string, feature string, importance double")
    order = Window.partitionBy("symbol").orderBy(F.desc("importance"), "feature")
    return df.withColumn("rank", F.row_number().over(order))


def rank_indicators(rankings: DataFrame) -> DataFrame:
    """Average importance and rank over symbols, ranked again. One row per feature name."""
    per = rankings.groupBy("feature").agg(F.avg("importance").alias("importance"),
                                          F.floor(F.avg("rank")).alias("mean_rank"),
                                          F.count(F.lit(1)).alias("symbols"))
    order = Window.partitionBy(F.lit(0)).orderBy(F.desc("importance"), "feature")
    return per.withColumn("rank", F.row_number().over(order)).withColumn(
        "category", indicator_category())


def rank_agreement(ranked: DataFrame, published: dict[str, int] | None = None) -> DataFrame:
    """Correlation of published and observed ranks over the best match per published name."""
    published = published or PUBLISHED_RANKS
    hit = F.lit(None).cast("string")
    base = base_name()
    for name in reversed(list(published)):
        hit = F.when(base.contains(name), name).otherwise(hit)
    first = ranked.withColumn("name", hit).filter(F.col("name").isNotNull()).groupBy("name").agg(
        F.min("rank").alias("observed"))
    value = F.lit(None).cast("int")
    for name, r in published.items():
        value = F.when(F.col("name") == name, r).otherwise(value)
    pairs = first.withColumn("published", value)
    n = F.count(F.lit(1))
    return pairs.agg(n.alias("matches"), F.when(n >= 3, corr_agg("published", "observed"))
                     .alias("correlation"))


def period_comparison(ranked: DataFrame) -> DataFrame:
    """Best rank of the 63-row and the short variant of RSI and ROC."""
    low = F.lower("feature")
    variants = {"rsi": (((low == "rsi") | low.startswith("rsi_")) & ~low.contains("rsi_63"),
                        low.contains("rsi_63")),
                "roc": (low.contains("roc_12") & ~low.contains("roc_63"), low.contains("roc_63"))}
    out = None
    for name, (short, long) in variants.items():
        row = ranked.agg(F.lit(name).alias("indicator"),
                         F.min(F.when(short, F.col("rank"))).alias("short_rank"),
                         F.max(F.when(short, F.col("importance"))).alias("short_importance"),
                         F.min(F.when(long, F.col("rank"))).alias("long_rank"),
                         F.max(F.when(long, F.col("importance"))).alias("long_importance"))
        out = row if out is None else out.unionByName(row)
    return out.withColumn("longer_better", F.col("long_rank") < F.col("short_rank"))


def training_summary(results: DataFrame) -> DataFrame:
    """Success and failure counts and mean metrics of a training run."""
    ok = F.col("success")
    return results.agg(
        F.count(F.lit(1)).alias("total"), F.count(F.when(ok, 1)).alias("successful"),
        F.count(F.when(~ok, 1)).alias("failed"),
        *[F.avg(F.when(ok, F.col(m))).alias(f"avg_{m}")
          for m in ("accuracy", "precision", "recall", "f1_score")])


def validation_metrics(scored: DataFrame, keys: list[str]) -> DataFrame:
    return confusion_metrics(scored, keys, "label", "predicted")
