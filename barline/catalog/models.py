"""Models, ensembles, walk-forward reports and indicator rankings."""

from __future__ import annotations

from pyspark.ml import PipelineModel
from pyspark.ml.regression import GBTRegressor, LinearRegression
from pyspark.sql import Window
from pyspark.sql import functions as F

from barline.catalog.base import BARS, NUMBERED, register
from barline.catalog.features import ALL_INDICATORS
from barline.catalog.labels import EXTREMA, MEMBERS, PREDICTIONS, SYMBOLS, WINDOWS, predictions
from barline.catalog.stats import psr_sql, MOM, SHARPE
from barline.functions import norm_cdf_sql
from barline.operators import folds, labels, models
from barline.operators import ffd as ffd_ops
from barline.operators.features import feature_names
from barline.sources import derived as src
from barline.sources.derived import bars_series, feature_table, indicator_table
from barline.sources.stored import stage, stored, stored_path

WITH = f"WITH {NUMBERED}\n"
P = "OVER (PARTITION BY symbol ORDER BY ts"
TRAIN_ON = feature_names()


def training_rows(spark, d):
    """All features with labels; rows without a label leave, features of the warm-up are NULL."""
    def build():
        x = feature_table(spark, d).select("symbol", "ts", *TRAIN_ON)
        y = labels.label_filter(labels.binary_label(bars_series(spark, d))).select("symbol", "ts", "label")
        n = bars_series(spark, d).select("symbol", "ts", "rn", (F.col("n") - 5).alias("n"))
        r = indicator_table(spark, d).select("symbol", "ts", F.col("return_1d").alias("ret"))
        return y.join(n, ["symbol", "ts"]).join(r, ["symbol", "ts"]).join(x, ["symbol", "ts"], "left")
    return stored(spark, d, "training-rows", build)


# A fit has no SQL. These queries return facts about the fit that SQL derives from the tables alone:
# how many rows each fold or window holds, and that every output keeps the rules it must obey.
ROWS = f"""{WITH}, t AS (SELECT symbol, ts, rn, n - 5 AS n, CASE WHEN (lead(close, 5) {P}) - close) / close > 0.02e0 THEN 1 ELSE 0 END AS label FROM b),
tr AS (SELECT * FROM t WHERE rn < n)"""
HELD = "tr WHERE rn >= floor(n * 0.8e0)"


def share(c):
    return (c >= 0) & (c <= 1)


def pooled_fit(spark, d):
    """One fit over all symbols, kept as a stored model with its scored rows and read by three queries."""
    def build(path):
        model, scored = models.gbt_train(training_rows(spark, d), TRAIN_ON)
        model.write().save(f"{path}/model")
        scored.select("symbol", "ts", "label", "predicted", "probability_up", "confidence", "score").write.parquet(f"{path}/scored")
    path = stored_path(spark, d, "pooled-fit", build)
    return PipelineModel.load(f"{path}/model"), spark.read.parquet(f"{path}/scored")


@register("gbt_train", f"{ROWS} SELECT symbol, count(*) AS rows, CAST(sum(label) AS BIGINT) AS positives, TRUE AS sound FROM {HELD} GROUP BY 1")
def gbt_train(spark, d):
    """Held-out rows per symbol, and that the metrics agree with the predictions."""
    _, scored = pooled_fit(spark, d)
    hit = (F.col("predicted") == F.col("label")).cast("double")
    facts = scored.groupBy("symbol").agg(
        F.count(F.lit(1)).alias("rows"), F.sum(F.col("label").cast("bigint")).alias("positives"),
        F.avg(hit).alias("_hits"), F.bool_and(F.col("predicted").isin(0, 1)).alias("_classes"))
    out = facts.join(models.validation_metrics(scored, ["symbol"]).drop("rows"), "symbol")
    return out.select("symbol", "rows", "positives", (
        F.col("_classes") & (F.abs(F.col("accuracy") - F.col("_hits")) < 1e-9) & share(F.col("precision"))
        & share(F.col("recall"))).alias("sound"))


@register("npmm_train", f"""{WITH}, {EXTREMA}, m AS (SELECT symbol, ts, CASE WHEN is_min AND (fmax - close) / close >= 0.02e0 THEN 1
  WHEN is_max AND (close - fmin) / close >= 0.02e0 THEN 0 END AS label FROM y),
k AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY ts) - 1 AS rn, count(*) OVER (PARTITION BY symbol) AS n FROM m WHERE label IS NOT NULL)
SELECT symbol, count(*) AS rows, CAST(sum(label) AS BIGINT) AS positives, TRUE AS sound FROM k WHERE rn >= floor(n * 0.8e0) GROUP BY 1""")
def npmm_train(spark, d):
    """A fit on confirmed lows and highs: held-out rows and lows per symbol, and that the classes follow the probability."""
    rows = models.npmm_training(feature_table(spark, d).select("symbol", "ts", *TRAIN_ON), bars_series(spark, d))
    _, s = models.gbt_train(rows, TRAIN_ON)
    return s.groupBy("symbol").agg(
        F.count(F.lit(1)).alias("rows"), F.sum(F.col("label").cast("bigint")).alias("positives"),
        F.bool_and(share(F.col("probability_up")) & ((F.col("predicted") == 1) == (F.col("probability_up") > 0.5))).alias("sound"))


@register("score_rows", f"{ROWS} SELECT symbol, ts, label, TRUE AS sound FROM {HELD}")
def score_rows(spark, d):
    """Held-out rows, and that class, confidence and score follow from the probability."""
    _, s = pooled_fit(spark, d)
    p, up = F.col("probability_up"), F.col("predicted")
    sound = (share(p) & ((up == 1) == (p > 0.5)) & (F.col("score") == 2 * up - 1)
             & (F.abs(F.col("confidence") - F.greatest(p, 1 - p)) < 1e-9))
    return s.select("symbol", "ts", F.col("label").cast("int").alias("label"), sound.alias("sound"))


@register("gbt_importance", f"SELECT {len(TRAIN_ON)} AS features, 1e0 AS total, TRUE AS sound FROM lineitem LIMIT 1", "total")
def gbt_importance(spark, d):
    """Importances are shares of 1, ranked from the largest on."""
    model, _ = pooled_fit(spark, d)
    top = models.gbt_importance(model, TRAIN_ON, spark)
    later = F.lead("importance").over(Window.partitionBy(F.lit(0)).orderBy("rank"))
    return top.withColumn("_next", F.coalesce(later, F.lit(0.0))).agg(
        F.countDistinct("feature").cast("int").alias("features"), F.sum("importance").alias("total"),
        F.bool_and(share(F.col("importance")) & (F.col("importance") >= F.col("_next"))).alias("sound"))


CHOICES, KEPT = 27, 3


@register("param_search", f"""{ROWS}, r AS (SELECT unnest([0, 1, 2]) AS rung, unnest([{CHOICES}, {CHOICES // KEPT}, {CHOICES // KEPT // KEPT}]) AS choices,
  unnest([{CHOICES // KEPT}, {CHOICES // KEPT // KEPT}, 1]) AS survivors)
SELECT rung, CAST(choices AS BIGINT) AS choices, CAST(survivors AS BIGINT) AS survivors, (SELECT count(*) FROM {HELD}) AS rows, TRUE AS sound FROM r""")
def param_search(spark, d):
    """Choices and survivors of every rung, all judged on the later rows; the survivors are the best ones,
    and each parameter stays inside its range."""
    found = models.param_search(training_rows(spark, d), TRAIN_ON, CHOICES, keep=KEPT)
    worst, lost = F.min(F.when(F.col("survives"), F.col("accuracy"))), F.max(F.when(~F.col("survives"), F.col("accuracy")))
    return found.groupBy("rung").agg(
        F.countDistinct("choice").alias("choices"), F.sum(F.col("survives").cast("bigint")).alias("survivors"),
        F.max("rows").alias("rows"), (F.bool_and(share(F.col("accuracy")) & (F.size(F.split("params", r"\), \(")) == 9))
                                      & (worst >= lost)).alias("sound"))


@register("purged_cv_score", f"""{ROWS}, s AS (SELECT symbol, CAST(max(n) // 5 AS BIGINT) AS size FROM tr GROUP BY 1)
SELECT CAST(k AS INTEGER) AS fold, CAST(sum(size) AS BIGINT) AS rows, TRUE AS sound FROM s, range(4) f(k) GROUP BY 1""")
def purged_cv_score(spark, d):
    out = models.purged_cv_score(training_rows(spark, d), TRAIN_ON, k=5)
    return out.select("fold", "rows", share(F.col("accuracy")).alias("sound"))


@register("walk_forward_fit", f"""{ROWS}, m AS (SELECT symbol, max(n) AS n FROM tr GROUP BY 1),
w AS (SELECT symbol, CAST(k AS BIGINT) AS window_id, 504 + k * 63 AS s, n FROM m, range(10000) g(k) WHERE 504 + k * 63 <= n - 126 - 1)
SELECT symbol, window_id, 126 AS rows, sum(label) AS positives, avg(ret) AS mean_return, TRUE AS sound
FROM w JOIN (SELECT symbol, rn, label, coalesce(close / lag(close) {P}) - 1, 0e0) AS ret FROM (SELECT t.*, b.close FROM t JOIN b USING (symbol, rn))) x
  USING (symbol) WHERE x.rn >= s AND x.rn < s + 126 GROUP BY 1, 2""", "mean_return")
def walk_forward_fit(spark, d):
    """Every window's out-of-sample rows, positives and mean return, and that the report's accuracy is the
    share of hits and its strategy takes part in no more than the rows it predicts."""
    rows = training_rows(spark, d)
    members = folds.window_membership(rows, *TRAIN_ON, "label", "ret")
    oos = stage(models.walk_forward_fit(members, TRAIN_ON), "walk-forward-scores")
    report = models.wfo_report(oos)
    facts = oos.groupBy("symbol", "window_id").agg(
        F.sum(F.col("label").cast("bigint")).alias("positives"), F.avg("ret").alias("mean_return"),
        F.avg((F.col("predicted") == F.col("label")).cast("double")).alias("_hits"),
        F.bool_and(F.col("predicted").isin(0, 1)).alias("_classes"), F.max("predicted").alias("_any"))
    sound = (F.col("_classes") & (F.abs(F.col("accuracy") - F.col("_hits")) < 1e-9)
             & ((F.col("_any") == 1) | (F.col("strategy_sharpe") == 0)) & F.col("oos_sharpe").isNotNull())
    return report.join(facts, ["symbol", "window_id"]).select(
        "symbol", F.col("window_id").cast("bigint").alias("window_id"), F.col("rows").cast("int").alias("rows"), "positives", "mean_return",
        sound.alias("sound"))


def rule_oos(spark, d):
    """Out-of-sample rows with a rule in place of a model: up after a fall."""
    df = labels.binary_label(bars_series(spark, d)).select("symbol", "ts", "label")
    r = bars_series(spark, d).join(df, ["symbol", "ts"]).join(
        indicator_table(spark, d).select("symbol", "ts", F.col("return_1d").alias("ret")), ["symbol", "ts"])
    r = r.withColumn("predicted", F.when(F.col("ret") < 0, 1).otherwise(0))
    return folds.concat_oos(folds.window_membership(r, "label", "ret", "predicted"))


OOS = f"""{WINDOWS.format(gap=0)}, {MEMBERS}, lr AS (SELECT symbol, ts, CASE WHEN lead(close, 5) {P}) IS NULL THEN -1 WHEN (lead(close, 5) {P}) - close) / close > 0.02e0
   THEN 1 ELSE 0 END AS label, coalesce(close / lag(close) {P}) - 1, 0e0) AS ret FROM b),
oos AS (SELECT symbol, ts, window_id, label, ret, CASE WHEN ret < 0 THEN 1 ELSE 0 END AS predicted FROM members JOIN lr USING (symbol, ts) WHERE role = 'OOS')"""
STRATEGY = SHARPE.replace("ret", "sret")


@register("wfo_report", f"""{WITH}, {OOS}, s AS (SELECT *, CASE WHEN predicted = 1 THEN ret ELSE 0e0 END AS sret FROM oos)
SELECT symbol, window_id, count(*) AS rows, avg(CASE WHEN predicted = label THEN 1e0 ELSE 0e0 END) AS accuracy, {SHARPE} AS oos_sharpe,
  {STRATEGY} AS strategy_sharpe FROM s GROUP BY 1, 2""", "accuracy oos_sharpe strategy_sharpe")
def wfo_report(spark, d):
    return models.wfo_report(rule_oos(spark, d))


@register("wfo_overall", f"""{WITH}, {OOS}, r AS (SELECT * FROM oos), {MOM}, {psr_sql('0e0')}
SELECT symbol, sharpe, {norm_cdf_sql('z')} AS psr, rows FROM pz""", "sharpe psr")
def wfo_overall(spark, d):
    return models.wfo_overall(rule_oos(spark, d))


def _symbol_fits(spark, d):
    """The registry of a model per symbol, stored in two versions, and their held-out scores; fitted once."""
    def build(path):
        fitted, scores = models.gbt_train_each(training_rows(spark, d), TRAIN_ON, trees=10, depth=3)
        for version in ("v1", "v2"):
            models.save_models(spark, path, version, fitted, scores)
        scores.write.parquet(f"{path}/scores")
    return stored_path(spark, d, "symbol-fits", build)


@register("latest_model", f"""{ROWS} SELECT symbol, count(*) AS rows, 2 AS versions, 'v2' AS version, TRUE AS sound FROM {HELD} GROUP BY 1""")
def latest_model(spark, d):
    """A model per symbol is fitted and stored twice; the newest version of each is found in the registry,
    loaded and applied to the held-out rows: it scores as the unsaved one did."""
    rows, root = training_rows(spark, d), _symbol_fits(spark, d)
    scores = spark.read.parquet(f"{root}/scores")
    held = rows.where(F.col("rn") >= F.floor(F.col("n") * 0.8))
    again = models.score_newest(spark, root, held, TRAIN_ON).select(
        "symbol", "ts", F.col("probability_up").alias("_p"), F.col("predicted").alias("_c"))
    same = (F.abs(F.col("_p") - F.col("probability_up")) < 1e-12) & (F.col("_c") == F.col("predicted"))
    facts = scores.join(again, ["symbol", "ts"]).groupBy("symbol").agg(F.count(F.lit(1)).alias("rows"), F.bool_and(same).alias("_same"))
    listed = models.model_versions(spark, root)
    newest = models.latest_model(listed).select("symbol", "version", "accuracy", F.col("rows").alias("_rows"))
    counts = listed.groupBy("symbol").agg(F.countDistinct("version").cast("int").alias("versions"))
    return facts.join(newest, "symbol").join(counts, "symbol").select(
        "symbol", "rows", "versions", "version", (F.col("_same") & share(F.col("accuracy")) & (F.col("_rows") == F.col("rows"))).alias("sound"))


SECTOR_OF = {"returned": ["R-F", "R-O"], "accepted": ["A-F", "A-O"], "none": ["N-F"]}
SECTOR_CASE = "CASE " + " ".join(f"WHEN symbol IN ({', '.join(repr(s) for s in m)}) THEN '{k}'" for k, m in SECTOR_OF.items()) + " ELSE 'other' END"


@register("sector_map", f"WITH {BARS} SELECT {SECTOR_CASE} AS sector, count(*) AS bars FROM bars GROUP BY 1")
def sector_map(spark, d):
    return models.sector_map(bars_series(spark, d), SECTOR_OF).groupBy("sector").agg(F.count(F.lit(1)).alias("bars"))


def market_rows(spark, d):
    return indicator_table(spark, d).select("symbol", "ts", (F.col("natr") / 100).alias("volatility"),
                                            F.col("adx").alias("trend"), F.col("return_1d").alias("ret"))


MARKET = """mk AS (SELECT ts, avg(natr / 100) AS market_volatility, avg(adx) AS market_trend, avg(return_1d) AS market_return,
  CASE WHEN min(return_1d) < max(return_1d) THEN stddev_pop(return_1d) ELSE 0 END AS market_return_sd FROM z GROUP BY 1)"""
MARKET_COLS = "market_volatility market_trend market_return market_return_sd"


@register("market_aggregate", f"{ALL_INDICATORS}, {MARKET} SELECT * FROM mk", MARKET_COLS, digits=5)
def market_aggregate(spark, d):
    return models.market_aggregate(market_rows(spark, d))


def meta_rows(spark, d):
    p = predictions(spark, d).select(F.col("signal").alias("symbol"), "ts", "score", F.abs(F.col("score")).alias("confidence"))
    return models.meta_features(p, models.market_aggregate(market_rows(spark, d)), SYMBOLS, SECTOR_OF)


META_CELLS = [f"{c}_{s}" for c in ("score", "confidence") for s in SYMBOLS]
META_STATS = ["score_mean", "score_std", "confidence_mean", "confidence_std"] + [f"{k}_{x}" for k in SECTOR_OF for x in ("mean", "std")]
META_SQL = f"""{PREDICTIONS.replace('FROM b)', 'FROM zb)', 1)}, mf AS (SELECT ts, """ + ", ".join(
    f"max(CASE WHEN symbol = '{s}' THEN {'abs(score)' if c == 'confidence' else 'score'} END) AS \"{c}_{s}\"" for c in ("score", "confidence") for s in SYMBOLS) + """,
  avg(score) AS score_mean, stddev_pop(score) AS score_std, count(CASE WHEN score > 0 THEN 1 END) AS bullish, count(CASE WHEN score < 0 THEN 1 END) AS bearish,
  avg(abs(score)) AS confidence_mean, stddev_pop(abs(score)) AS confidence_std, """ + ", ".join(
    f"coalesce(avg(score) FILTER (symbol IN ({', '.join(repr(s) for s in m)})), 0) AS {k}_mean, coalesce(stddev_pop(score) FILTER (symbol IN ({', '.join(repr(s) for s in m)})), 0) AS {k}_std"
    for k, m in SECTOR_OF.items()) + " FROM pred GROUP BY 1)"


@register("meta_features", f"""{ALL_INDICATORS}, {MARKET}, zb AS (SELECT *, count(*) OVER (PARTITION BY symbol) AS n FROM z), {META_SQL}
SELECT * FROM mf LEFT JOIN mk USING (ts)""", " ".join(f'"{c}"' for c in META_CELLS) + " " + " ".join(META_STATS) + " " + MARKET_COLS, digits=5)
def meta_features(spark, d):
    return meta_rows(spark, d)


def meta_training(spark, d):
    m = meta_rows(spark, d)
    names = [c for c in m.columns if c != "ts"]
    m = m.select("ts", *[F.col(f"`{c}`").alias(f"m{i}") for i, c in enumerate(names)]).na.fill(0.0)
    y = labels.forward_returns(bars_series(spark, d), (5,)).select(
        "symbol", "ts", F.greatest(F.least("forward_return", F.lit(1.0)), F.lit(-1.0)).alias("target"))
    return m.join(y, "ts"), [f"m{i}" for i in range(len(names))]


def fit_facts(metrics):
    error, mean = F.col("mse"), F.col("mae")
    sound = share(F.abs(F.col("correlation"))) & (error >= 0) & (mean * mean <= error + 1e-12)
    return metrics.select("rows", sound.alias("sound"))


@register("meta_learner", f"""{ROWS}, {PREDICTIONS}, e AS (SELECT DISTINCT ts FROM pred)
SELECT count(*) AS rows, TRUE AS sound FROM tr JOIN e USING (ts)""")
def meta_learner(spark, d):
    rows, names = meta_training(spark, d)
    _, fitted = models.meta_learner(rows, names)
    return fit_facts(models.regression_metrics(fitted))


def _stack(spark, d):
    """Predictions out of fold and coefficients, fitted once and stored."""
    def build(path):
        y = labels.forward_returns(bars_series(spark, d), (5,)).select(
            "symbol", "ts", F.greatest(F.least("forward_return", F.lit(1.0)), F.lit(-1.0)).alias("target"))
        rows = training_rows(spark, d).join(y, ["symbol", "ts"])
        bases = {"linear": LinearRegression(labelCol="target", regParam=0.1),
                 "trees": GBTRegressor(labelCol="target", maxIter=50, maxDepth=6, seed=42)}
        top, _, out = models.oof_stack(rows, TRAIN_ON, bases, k=5)
        out.select("symbol", "ts", "target", "prediction").write.parquet(f"{path}/rows")
        models.meta_importance(top, list(bases), spark).write.parquet(f"{path}/importance")
    path = stored_path(spark, d, "stack", build)
    return spark.read.parquet(f"{path}/rows"), spark.read.parquet(f"{path}/importance")


@register("oof_stack", f"{ROWS} SELECT count(*) AS rows, TRUE AS sound FROM tr")
def oof_stack(spark, d):
    """Every row is predicted once, by models that have not seen its fold."""
    return fit_facts(models.regression_metrics(_stack(spark, d)[0]))


@register("meta_importance", "SELECT unnest(['linear', 'trees']) AS model, TRUE AS sound FROM (SELECT 1 FROM lineitem LIMIT 1)")
def meta_importance(spark, d):
    return _stack(spark, d)[1].select("model", (F.col("importance") >= 0).alias("sound"))


@register("blend", """SELECT event_id, (2 * value + 1 * user_id + 0.5e0 * (value - user_id)) / 3.5e0 AS blended FROM events""", "blended")
def blend(spark, d):
    ev = src.table(spark, d, "events")
    v, u = F.col("value"), F.col("user_id").cast("double")
    long = ev.select("event_id", v.alias("a"), u.alias("b"), (v - u).alias("c")).unpivot(
        ["event_id"], ["a", "b", "c"], "model", "prediction")
    w = spark.createDataFrame([("a", 2.0), ("b", 1.0), ("c", 0.5)], "model string, weight double")
    return models.blend(long, w, ["event_id"])


# ---- rankings --------------------------------------------------------------------------------

RANKED = ["squeeze_pro", "ppo", "macd", "macd_signal", "roc_12", "roc_63", "rsi", "rsi_63", "adx", "plus_di", "bb_pct_b", "atr", "natr",
          "vwap_dev", "volume_ratio", "stoch_k", "williams_r", "kc_upper", "return_5d", "price_sma20_pct", "obv"]


def contributions(spark, d):
    """A stand-in for model contributions: each feature against its own scale."""
    z = indicator_table(spark, d).select("symbol", "ts", *[F.col(c).cast("double").alias(c) for c in RANKED])
    long = z.unpivot(["symbol", "ts"], RANKED, "feature", "v").filter("v IS NOT NULL")
    return long.withColumn("contribution", F.col("v") / (F.abs(F.col("v")) + 10))


CONTRIB = "ct AS (SELECT symbol, ts, feature, v / (abs(v) + 10) AS contribution FROM (" + " UNION ALL ".join(
    f"SELECT symbol, ts, '{c}' AS feature, {c} AS v FROM z" for c in RANKED) + ") WHERE v IS NOT NULL)"


@register("contribution_summary", f"{ALL_INDICATORS}, {CONTRIB} SELECT symbol, feature, avg(abs(contribution)) AS importance FROM ct GROUP BY 1, 2",
          "importance")
def contribution_summary(spark, d):
    return models.contribution_summary(contributions(spark, d), "symbol")


def rankings(spark, d):
    per = models.contribution_summary(contributions(spark, d), "symbol")
    order = Window.partitionBy("symbol").orderBy(F.desc("importance"), "feature")  # one row per feature
    return per.withColumn("rank", F.row_number().over(order))


RANK = f"""{CONTRIB}, rk AS (SELECT symbol, feature, avg(abs(contribution)) AS importance,
  row_number() OVER (PARTITION BY symbol ORDER BY avg(abs(contribution)) DESC, feature) AS rank FROM ct GROUP BY 1, 2)"""
LIKE = "CASE " + " ".join("WHEN " + " OR ".join(f"contains(feature, '{p}')" for p in parts) + f" THEN '{label}'"
                          for parts, label in models.CATEGORIES) + " ELSE 'Other' END"
AVG_RANK = f"""{RANK}, ar AS (SELECT feature, avg(importance) AS importance, CAST(floor(avg(rank)) AS BIGINT) AS mean_rank, count(*) AS symbols,
  CAST(row_number() OVER (ORDER BY avg(importance) DESC, feature) AS INTEGER) AS rank, {LIKE} AS category FROM rk GROUP BY 1)"""


@register("fitted_rankings", f"""{ROWS}, s AS (SELECT count(DISTINCT symbol) AS symbols FROM {HELD})
SELECT feature, {LIKE} AS category, symbols, TRUE AS sound FROM (SELECT unnest({TRAIN_ON!r}) AS feature), s""")
def fitted_rankings(spark, d):
    """Indicators ranked by the importances of the newest stored model of every symbol: shares of 1 per
    symbol, ranks from 1 on without gaps, means over symbols ranked again."""
    per = models.symbol_rankings(models.load_newest(spark, _symbol_fits(spark, d)), TRAIN_ON, spark)
    whole = per.groupBy("symbol").agg(F.abs(F.sum("importance") - 1).alias("_off"), F.sum("rank").alias("_ranks"))
    n = len(TRAIN_ON)
    right = whole.agg(F.bool_and((F.col("_off") < 1e-9) & (F.col("_ranks") == n * (n + 1) // 2)).alias("_right"))
    ranked = models.rank_indicators(per)
    inside = share(F.col("importance")) & F.col("rank").between(1, n) & F.col("mean_rank").between(1, n)
    return ranked.crossJoin(F.broadcast(right)).select("feature", "category", "symbols", (inside & F.col("_right")).alias("sound"))  # one row


@register("top_features", f"""{ALL_INDICATORS}, {RANK} SELECT feature, avg(importance) AS importance,
  CAST(row_number() OVER (ORDER BY avg(importance) DESC, feature) AS INTEGER) AS rank FROM rk GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 10""", "importance")
def top_features(spark, d):
    per = rankings(spark, d).groupBy("feature").agg(F.avg("importance").alias("importance"))
    return models.top_features(per, 10)


@register("rank_indicators", f"{ALL_INDICATORS}, {AVG_RANK} SELECT * FROM ar", "importance")
def rank_indicators(spark, d):
    return models.rank_indicators(rankings(spark, d))


@register("indicator_category", f"{ALL_INDICATORS}, {CONTRIB} SELECT {LIKE} AS category, count(*) AS rows, count(DISTINCT feature) AS features FROM ct GROUP BY 1")
def indicator_category(spark, d):
    c = contributions(spark, d).groupBy("feature").agg(F.count(F.lit(1)).alias("n"))
    return c.groupBy(models.indicator_category().alias("category")).agg(
        F.sum("n").alias("rows"), F.count(F.lit(1)).alias("features"))


@register("rank_agreement", f"""{ALL_INDICATORS}, {AVG_RANK}, nm AS (SELECT CASE """ + " ".join(
    f"WHEN contains(feature, '{k}') THEN '{k}'" for k in models.PUBLISHED_RANKS) + """ END AS name, rank FROM ar),
f AS (SELECT name, min(rank) AS observed, CASE name """ + " ".join(f"WHEN '{k}' THEN {v}" for k, v in models.PUBLISHED_RANKS.items())
    + """ END AS published FROM nm WHERE name IS NOT NULL GROUP BY 1)
SELECT count(*) AS matches, covar_samp(published, observed) / (stddev_samp(published) * stddev_samp(observed)) AS correlation FROM f""", "correlation")
def rank_agreement(spark, d):
    return models.rank_agreement(models.rank_indicators(rankings(spark, d)))


def _variant(name, short, long):
    return f"""SELECT '{name}' AS indicator, min(CASE WHEN {short} THEN rank END) AS short_rank, max(CASE WHEN {short} THEN importance END) AS short_importance,
  min(CASE WHEN {long} THEN rank END) AS long_rank, max(CASE WHEN {long} THEN importance END) AS long_importance,
  min(CASE WHEN {long} THEN rank END) < min(CASE WHEN {short} THEN rank END) AS longer_better FROM ar"""


@register("period_comparison", f"""{ALL_INDICATORS}, {AVG_RANK} {_variant('rsi', "feature = 'rsi'", "feature = 'rsi_63'")}
UNION ALL {_variant('roc', "feature = 'roc_12'", "feature = 'roc_63'")}""", "short_importance long_importance")
def period_comparison(spark, d):
    return models.period_comparison(models.rank_indicators(rankings(spark, d)))


@register("training_summary", """WITH t AS (SELECT p_brand, avg(p_size) / 40 AS accuracy, avg(p_size) / 45 AS precision, avg(p_size) / 50 AS recall,
  avg(p_size) / 47 AS f1_score, avg(p_retailprice) > 1000 AS success FROM part GROUP BY 1)
SELECT count(*) AS total, count(*) FILTER (success) AS successful, count(*) FILTER (NOT success) AS failed, """ + ", ".join(
    f"avg({m}) FILTER (success) AS avg_{m}" for m in ("accuracy", "precision", "recall", "f1_score")) + " FROM t",
    "avg_accuracy avg_precision avg_recall avg_f1_score")
def training_summary(spark, d):
    t = src.table(spark, d, "part").groupBy("p_brand").agg(
        *[(F.avg("p_size") / k).alias(m) for m, k in (("accuracy", 40), ("precision", 45), ("recall", 50), ("f1_score", 47))],
        (F.avg("p_retailprice") > 1000).alias("success"))
    return models.training_summary(t)


OPTIMAL = f"""WITH RECURSIVE {BARS}, ds AS (SELECT k / 20e0 AS d FROM range(1, 21) t(k)),
wt AS (SELECT d, 0 AS k, CAST(1 AS DOUBLE) AS w FROM ds UNION ALL
  SELECT d, k + 1, -w * (d - (k + 1) + 1) / (k + 1) FROM wt WHERE abs(w * (d - (k + 1) + 1) / (k + 1)) >= 1e-5),
wl AS (SELECT d, list(w ORDER BY k DESC) AS w, count(*) AS width FROM wt GROUP BY 1),
sl AS (SELECT symbol, list(close ORDER BY ts) AS c, count(*) AS n FROM bars GROUP BY 1),
y AS (SELECT symbol, d, i, list_dot_product(c[i - width + 1:i], w) AS y FROM (SELECT symbol, c, d, w, width, unnest(range(width, n + 1)) AS i FROM sl, wl WHERE n >= width)),
x AS (SELECT symbol, d, lag(y) OVER (PARTITION BY symbol, d ORDER BY i) AS x, y - lag(y) OVER (PARTITION BY symbol, d ORDER BY i) AS dy FROM y),
s AS (SELECT symbol, d, count(*) AS m, var_samp(x) * (count(*) - 1) AS sxx, covar_samp(x, dy) * (count(*) - 1) AS sxy, var_samp(dy) * (count(*) - 1) AS syy
  FROM x WHERE x IS NOT NULL GROUP BY 1, 2 HAVING count(*) >= 19),
t AS (SELECT symbol, d, sxy / sxx / sqrt((syy - sxy / sxx * sxy) / ((m - 2) * sxx)) AS stat FROM s)
SELECT symbol, coalesce(min(CASE WHEN stat < -2.86 THEN d END), arg_min(d, stat), 0.5e0) AS d, min(CASE WHEN stat < -2.86 THEN d END) IS NOT NULL AS stationary,
  count(stat) AS orders_tested FROM (SELECT DISTINCT symbol FROM bars) LEFT JOIN t USING (symbol) GROUP BY 1"""


@register("optimal_d", OPTIMAL, "d")
def optimal_d(spark, d):
    return ffd_ops.optimal_d(bars_series(spark, d))
