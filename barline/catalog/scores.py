"""Sentiment, fundamentals, technical scores, confluence and market regimes."""

from __future__ import annotations

from pyspark.sql import functions as F

from barline.catalog.base import NUMBERED, register
from barline.catalog.features import ALL_INDICATORS
from barline.catalog.labels import PREDICTIONS, SYMBOLS, actuals, predictions
from barline.catalog.stats import RET, daily_returns
from barline.operators import align, regimes, scores
from barline.operators import tables as tb
from barline.session import scratch_path
from barline.sources import derived as src
from barline.sources.derived import indicator_table

WITH = f"WITH {NUMBERED}\n"


def responses(spark, d):
    """Model answers of varying form: clean JSON, cut JSON, plain words."""
    ev = src.table(spark, d, "events")
    v = F.col("value")
    s4 = F.format_string("%.4f", (v - 25) / 25)
    c2 = F.format_string("%.2f", F.get_json_object("props", "$.k").cast("int") / 100)
    cls = F.when(v > 30, "BULLISH").when(v < 12, "bearish").otherwise("mixed")
    js = F.concat(F.lit('{"sentiment": '), s4, F.lit(', "confidence": '), c2,
                  F.lit(', "classification": "'), cls, F.lit('", "reasoning": "moved '), s4, F.lit('"}'))
    plain = F.when(v > 25, F.concat(F.lit("Outlook is Bullish, around "), s4, F.lit(" overall"))) \
        .otherwise("No clear view")
    text = F.when(F.col("event_id") % 11 == 0, plain).when(
        F.col("event_id") % 7 == 0, F.substring(js, 1, 42)).otherwise(F.concat(F.lit("Answer: "), js))
    return ev.select("event_id", F.col("event_type").alias("symbol"), "ts",
                     F.when(F.col("user_id") % 3 == 0, "social_media").otherwise("financial_headline")
                     .alias("source"), text.alias("response"))


RESPONSES = """rq AS (SELECT *, format('{:.4f}', (value - 25) / 25) AS s4,
   format('{:.2f}', CAST(json_extract_string(props, '$.k') AS INTEGER) / 100) AS c2,
   CASE WHEN value > 30 THEN 'BULLISH' WHEN value < 12 THEN 'bearish' ELSE 'mixed' END AS cls FROM events),
rj AS (SELECT *, '{"sentiment": ' || s4 || ', "confidence": ' || c2 || ', "classification": "' || cls || '", "reasoning": "moved ' || s4 || '"}' AS js FROM rq),
rs AS (SELECT event_id, event_type AS symbol, ts, CASE WHEN user_id % 3 = 0 THEN 'social_media' ELSE 'financial_headline' END AS source,
   CASE WHEN event_id % 11 = 0 THEN CASE WHEN value > 25 THEN 'Outlook is Bullish, around ' || s4 || ' overall' ELSE 'No clear view' END
        WHEN event_id % 7 = 0 THEN left(js, 42) ELSE 'Answer: ' || js END AS response FROM rj),
bk AS (SELECT *, regexp_extract(response, '\\{[^{}]*\\}', 0) AS block FROM rs),
pv AS (SELECT *, block <> '' AND json_valid(block) AS ok FROM bk),
pn AS (SELECT *, CASE WHEN ok THEN TRY_CAST(json_extract_string(block, '$.sentiment') AS DOUBLE) ELSE
     least(greatest(coalesce(TRY_CAST(nullif(regexp_extract(response, '(?i)"sentiment"?\\s*:\\s*(-?\\d+\\.?\\d*)', 1), '') AS DOUBLE),
       TRY_CAST(nullif(regexp_extract(response, '-?\\d+\\.?\\d*', 0), '') AS DOUBLE), 0e0), -1e0), 1e0) END AS score,
   CASE WHEN ok THEN TRY_CAST(json_extract_string(block, '$.confidence') AS DOUBLE) ELSE
     least(greatest(coalesce(TRY_CAST(nullif(regexp_extract(response, '(?i)"confidence"?\\s*:\\s*(-?\\d+\\.?\\d*)', 1), '') AS DOUBLE), 5e-1), 0e0), 1e0) END AS confidence,
   CASE WHEN ok THEN lower(json_extract_string(block, '$.classification')) WHEN contains(lower(response), 'bullish') THEN 'bullish'
     WHEN contains(lower(response), 'bearish') THEN 'bearish' ELSE 'neutral' END AS cl,
   CASE WHEN ok THEN json_extract_string(block, '$.reasoning') ELSE left(regexp_replace(response, '[{}\\[\\]"]', '', 'g'), 200) END AS reasoning FROM pv),
ps AS (SELECT event_id, symbol, ts, source, score, confidence, reasoning, CASE WHEN contains(cl, 'bullish') THEN 'bullish'
   WHEN contains(cl, 'bearish') THEN 'bearish' WHEN contains(cl, 'neutral') THEN 'neutral' WHEN score > 0.3 THEN 'bullish'
   WHEN score < -0.3 THEN 'bearish' ELSE 'neutral' END AS classification FROM pn)"""


def parsed(spark, d):
    return scores.parse_sentiment(responses(spark, d)).drop("response")


@register("parse_sentiment", f"WITH {RESPONSES} SELECT * FROM ps", "score confidence")
def parse_sentiment(spark, d):
    return parsed(spark, d)


DISCOUNT = "sd AS (SELECT * REPLACE (CASE WHEN source = 'social_media' THEN confidence * 0.7e0 ELSE confidence END AS confidence) FROM ps)"


@register("social_discount", f"WITH {RESPONSES}, {DISCOUNT} SELECT event_id, source, confidence FROM sd", "confidence")
def social_discount(spark, d):
    return scores.social_discount(parsed(spark, d)).select("event_id", "source", "confidence")


@register("sentiment_agg", f"""WITH {RESPONSES}, {DISCOUNT}, g AS (SELECT symbol, date_trunc('day', ts) AS day,
  coalesce(sum(score * confidence) / nullif(sum(confidence), 0), avg(score)) AS aggregated_score, avg(confidence) AS confidence,
  count(*) AS num_items, count(*) FILTER (classification = 'bullish') AS bullish_count,
  count(*) FILTER (classification = 'bearish') AS bearish_count, count(*) FILTER (classification = 'neutral') AS neutral_count
  FROM sd GROUP BY 1, 2)
SELECT *, CASE WHEN bullish_count > bearish_count AND bullish_count > neutral_count THEN 'bullish'
  WHEN bearish_count > bullish_count AND bearish_count > neutral_count THEN 'bearish' ELSE 'neutral' END AS aggregated_classification FROM g""",
          "aggregated_score confidence")
def sentiment_agg(spark, d):
    s = scores.social_discount(parsed(spark, d)).withColumn("day", F.date_trunc("day", "ts"))
    return scores.sentiment_agg(s, ["symbol", "day"])


def stored_sentiment(spark, d):
    path = scratch_path(spark, "sentiment_scores")
    tb.append_rows(parsed(spark, d), path, {"raw_response": ["classification", "reasoning"]})
    return spark.read.parquet(path)


@register("append_sentiment", f"""WITH {RESPONSES} SELECT event_id, symbol, ts, source, score, confidence,
  '{{"classification":"' || classification || '","reasoning":' || to_json(reasoning) || '}}' AS raw_response FROM ps""", "score confidence")
def append_sentiment(spark, d):
    return stored_sentiment(spark, d)


@register("scan_sentiment", f"""WITH {RESPONSES} SELECT * FROM ps WHERE symbol = 'click' AND source = 'social_media'
  AND ts BETWEEN '2024-01-05' AND '2024-01-25'""", "score confidence")
def scan_sentiment(spark, d):
    return tb.scan_filtered(parsed(spark, d), "2024-01-05", "2024-01-25", symbol="click", source="social_media")


FUND = """fu AS (SELECT s_suppkey AS id, CASE WHEN s_suppkey % 7 <> 0 THEN s_acctbal / 150 END AS pe,
  CASE WHEN s_suppkey % 5 <> 0 THEN s_acctbal / 1500 END AS pb,
  CASE WHEN s_suppkey % 4 = 0 THEN NULL WHEN s_suppkey % 3 = 0 THEN s_acctbal / 300 ELSE s_acctbal / 30000 END AS roe,
  CASE WHEN s_suppkey % 6 <> 0 THEN abs(s_acctbal) / 4000 END AS de FROM supplier),
f1 AS (SELECT *, CASE WHEN pe <> 0 THEN CASE WHEN pe > 0 THEN least(greatest((50 - pe) / 45, 0e0), 1e0) ELSE 5e-1 END END AS ps,
  CASE WHEN pb <> 0 THEN CASE WHEN pb > 0 THEN least(greatest((5 - pb) / 4.5e0, 0e0), 1e0) ELSE 5e-1 END END AS bs,
  CASE WHEN roe <> 0 THEN least(greatest((CASE WHEN roe > 1 THEN roe / 100 ELSE roe END + 0.1e0) / 0.4e0, 0e0), 1e0) ELSE 0e0 END AS rsc,
  CASE WHEN de <> 0 THEN least(greatest((2 - de) / 2, 0e0), 1e0) END AS ds FROM fu),
f2 AS (SELECT *, CASE WHEN ps IS NOT NULL AND bs IS NOT NULL THEN ((ps + bs) / 2 - 5e-1) * 2 WHEN ps IS NOT NULL THEN (ps - 5e-1) * 2
  WHEN bs IS NOT NULL THEN (bs - 5e-1) * 2 ELSE 0e0 END AS value_score,
  CASE WHEN ds IS NULL THEN coalesce(rsc, 0e0) WHEN rsc > 0 THEN (rsc + ds) / 2 ELSE ds END AS rawq FROM f1),
f3 AS (SELECT id, value_score, CASE WHEN rawq > 0 THEN (rawq - 5e-1) * 2 ELSE rawq END AS quality_score FROM f2)"""


def fundamentals(spark, d):
    s = src.table(spark, d, "supplier")
    k, b = F.col("s_suppkey"), F.col("s_acctbal")
    return scores.fundamental_scores(s.select(
        k.alias("id"), F.when(k % 7 != 0, b / 150).alias("pe"), F.when(k % 5 != 0, b / 1500).alias("pb"),
        F.when(k % 4 == 0, None).when(k % 3 == 0, b / 300).otherwise(b / 30000).alias("roe"),
        F.when(k % 6 != 0, F.abs(b) / 4000).alias("de")))


@register("fundamental_scores", f"WITH {FUND} SELECT * FROM f3", "value_score quality_score")
def fundamental_scores(spark, d):
    return fundamentals(spark, d).select("id", "value_score", "quality_score")


@register("fundamental_factor", f"""WITH {FUND} SELECT id, least(greatest((0.25e0 * value_score + 0.25e0 * quality_score) / 0.5e0, -1e0), 1e0)
  AS fundamental_score FROM f3""", "fundamental_score")
def fundamental_factor(spark, d):
    df = fundamentals(spark, d)
    return df.select("id", scores.fundamental_factor(df).alias("fundamental_score"))


TECH_COLS = ["rsi", "macd", "macd_histogram", "bb_pct_b", "adx", "stoch_k"]
CLIP = "least(greatest({0}, -1e0), 1e0)".format
TECH = f"""te AS (SELECT *, {CLIP(f"(0.15e0 * ((rsi - 50) / 50) + 0.15e0 * {CLIP('macd')} + 0.1e0 * {CLIP('macd_histogram')} + 0.1e0 * ((bb_pct_b - 5e-1) * 2) + 0.1e0 * {CLIP('(adx - 25) / 25')} + 0.1e0 * ((stoch_k - 50) / 50)) / 0.7e0")} AS technical_score,
  {CLIP('(volume - 100) / 100e0')} AS sentiment, CASE WHEN open > close THEN 5e-1 ELSE 0e0 END AS fundamental,
  return_20d AS return_20, natr / 15000 AS volatility FROM z)"""


def indicator_rows(spark, d):
    df = indicator_table(spark, d)
    return df.select("symbol", "ts", *TECH_COLS,
                     (F.greatest(F.least((F.col("volume") - 100) / 100, F.lit(1.0)), F.lit(-1.0))).alias("sentiment"),
                     F.when(F.col("open") > F.col("close"), 0.5).otherwise(0.0).alias("fundamental"),
                     F.col("return_20d").alias("return_20"), (F.col("natr") / 15000).alias("volatility"))


@register("technical_score", f"{ALL_INDICATORS}, {TECH} SELECT symbol, ts, technical_score FROM te", "technical_score", digits=5)
def technical_score(spark, d):
    df = indicator_rows(spark, d)
    return df.select("symbol", "ts", scores.technical_score(df.select(*TECH_COLS)).alias("technical_score"))


REGIME = """CASE WHEN volatility > 0.02e0 THEN 'high_volatility' WHEN volatility < 0.01e0 THEN 'low_volatility' WHEN adx > 25 THEN 'trending'
  WHEN return_20 > 0.05e0 THEN 'bullish' WHEN return_20 < -0.05e0 THEN 'bearish' ELSE 'neutral' END"""


@register("market_regime", f"{ALL_INDICATORS}, {TECH} SELECT symbol, ts, {REGIME} AS regime FROM te")
def market_regime(spark, d):
    return indicator_rows(spark, d).select("symbol", "ts", scores.market_regime().alias("regime"))


def confluence_sql(regime):
    def w(i):
        return "CASE regime " + " ".join(f"WHEN '{k}' THEN {v[i]}e0" for k, v in scores.REGIME_WEIGHTS.items()) + " END"
    return f"""cf0 AS (SELECT symbol, ts, technical_score, sentiment AS sentiment_score, fundamental AS fundamental_score, {regime} AS regime FROM te),
cf1 AS (SELECT *, {w(0)} * technical_score + {w(1)} * sentiment_score + {w(2)} * fundamental_score AS confluence_score,
  [technical_score, sentiment_score, fundamental_score] AS parts FROM cf0),
cf2 AS (SELECT *, len(list_filter(parts, lambda x: x > 0.1e0)) AS pos, len(list_filter(parts, lambda x: x < -0.1e0)) AS neg FROM cf1),
cf AS (SELECT symbol, ts, confluence_score, CASE WHEN confluence_score > 0.3e0 THEN 'long' WHEN confluence_score < -0.3e0 THEN 'short' ELSE 'neutral' END AS direction,
  least(abs(confluence_score), 1e0) AS strength,
  (CASE WHEN pos = 3 OR neg = 3 THEN 0.9e0 WHEN (pos = 2 AND neg = 0) OR (neg = 2 AND pos = 0) THEN 0.75e0 WHEN pos = 2 OR neg = 2 THEN 0.6e0 ELSE 0.4e0 END)
    * (5e-1 + 5e-1 * (abs(technical_score) + abs(sentiment_score) + abs(fundamental_score)) / 3) AS confidence,
  technical_score, sentiment_score, fundamental_score, regime FROM cf2)"""


CF = "confluence_score strength confidence technical_score sentiment_score fundamental_score"


@register("confluence", f"{ALL_INDICATORS}, {TECH}, {confluence_sql(REGIME)} SELECT * FROM cf", CF, digits=5)
def confluence(spark, d):
    df = indicator_rows(spark, d)
    df = (df.withColumn("regime", scores.market_regime())
          .withColumn("technical_score", scores.technical_score(df.select(*TECH_COLS)))
          .withColumnRenamed("sentiment", "sentiment_score")
          .withColumnRenamed("fundamental", "fundamental_score"))
    return scores.confluence(df).select("symbol", "ts", "confluence_score", "direction", "strength", "confidence",
                                        "technical_score", "sentiment_score", "fundamental_score", "regime")


NEUTRAL = "'neutral'"


@register("confluence_batch", f"{ALL_INDICATORS}, {TECH}, {confluence_sql(NEUTRAL)} SELECT * FROM cf", CF, digits=5)
def confluence_batch(spark, d):
    df = indicator_rows(spark, d).select("symbol", "ts", *TECH_COLS, "sentiment", "fundamental")
    return scores.confluence_batch(df)


KIND = "CASE left(signal, 1) WHEN 'A' THEN 'technical' WHEN 'N' THEN 'sentiment' ELSE 'fundamental' END"


@register("ic_weights", f"""{WITH}, {PREDICTIONS}, o AS (SELECT {KIND} AS kind, ts, score, actual FROM pred WHERE actual IS NOT NULL
  QUALIFY row_number() OVER (PARTITION BY kind ORDER BY ts DESC, signal DESC) <= 100),
c AS (SELECT kind, abs(avg(CASE WHEN (score > 0) = (actual > 0) THEN 1e0 ELSE -1e0 END)) AS ic FROM o GROUP BY 1)
SELECT max(CASE WHEN kind = 'technical' THEN ic END) / sum(ic) AS technical, max(CASE WHEN kind = 'sentiment' THEN ic END) / sum(ic) AS sentiment,
  max(CASE WHEN kind = 'fundamental' THEN ic END) / sum(ic) AS fundamental FROM c""", "technical sentiment fundamental")
def ic_weights(spark, d):
    obs = align.prediction_actual(predictions(spark, d), actuals(spark, d))
    kind = F.when(F.col("signal").startswith("A"), "technical").when(F.col("signal").startswith("N"), "sentiment") \
        .otherwise("fundamental")
    return scores.ic_weights(obs.withColumn("kind", kind), tie=["signal"])


@register("agreement_signal", """WITH a AS (SELECT event_id, CASE WHEN user_id % 2 = 0 THEN 1e0 ELSE -1e0 END AS technical, (value - 20) / 40 AS sentiment,
  0.5e0 + (user_id % 50) / 100e0 AS confidence FROM events)
SELECT *, CASE WHEN technical > 0 AND sentiment > 0.1 THEN 1 WHEN technical < 0 AND sentiment < -0.1 THEN -1 ELSE 0 END AS signal,
  CASE WHEN (technical > 0 AND sentiment > 0.1) OR (technical < 0 AND sentiment < -0.1) THEN least(confidence, abs(sentiment)) ELSE confidence END AS signal_confidence
FROM a""", "technical sentiment confidence signal_confidence")
def agreement_signal(spark, d):
    ev = src.table(spark, d, "events")
    return scores.agreement_signal(ev.select(
        "event_id", F.when(F.col("user_id") % 2 == 0, 1.0).otherwise(-1.0).alias("technical"),
        ((F.col("value") - 20) / 40).alias("sentiment"), (0.5 + (F.col("user_id") % 50) / 100).alias("confidence")))


# ---- correlation regimes ---------------------------------------------------------------------

PAIRS = f"""{RET}, pr AS (SELECT p.ts, p.symbol AS a, q.symbol AS b, p.ret AS x, q.ret AS y FROM r p JOIN r q ON p.ts = q.ts AND p.symbol < q.symbol)"""
CORR = "coalesce(CASE WHEN min(x) < max(x) AND min(y) < max(y) THEN covar_samp(x, y) / (stddev_samp(x) * stddev_samp(y)) END, 0)"


@register("corr_matrix", f"{WITH}, {PAIRS} SELECT a, b, {CORR} AS corr FROM pr GROUP BY 1, 2", "corr")
def corr_matrix(spark, d):
    return regimes.corr_matrix(daily_returns(spark, d))


W60 = "OVER (PARTITION BY a, b ORDER BY ts ROWS BETWEEN 59 PRECEDING AND CURRENT ROW)"


@register("rolling_corr", f"""{WITH}, {PAIRS} SELECT ts, a, b, coalesce(CASE WHEN min(x) {W60} < max(x) {W60} AND min(y) {W60} < max(y) {W60}
  THEN covar_samp(x, y) {W60} / (stddev_samp(x) {W60} * stddev_samp(y) {W60}) END, 0) AS corr
FROM pr QUALIFY count(*) {W60} = 60""", "corr")
def rolling_corr(spark, d):
    return regimes.rolling_corr(daily_returns(spark, d))


def market_months(spark, d):
    c = regimes.corr_by(daily_returns(spark, d), F.date_trunc("month", "ts"))
    c = c.groupBy("bucket").agg(F.avg("corr").alias("avg_corr"), F.max("corr").alias("max_corr"))
    z = indicator_table(spark, d).groupBy(F.date_trunc("month", "ts").alias("bucket")).agg(
        (F.avg("natr") / 1000).alias("volatility"), (F.avg("adx") * 1.6).alias("trend"))
    return c.join(z, "bucket")


MONTHS = f"""rr AS (SELECT symbol, ts, return_1d AS ret FROM z),
pr AS (SELECT p.ts, p.symbol AS a, q.symbol AS b, p.ret AS x, q.ret AS y FROM rr p JOIN rr q ON p.ts = q.ts AND p.symbol < q.symbol),
cb AS (SELECT date_trunc('month', ts) AS bucket, a, b, {CORR} AS corr FROM pr GROUP BY 1, 2, 3),
mm AS (SELECT * FROM (SELECT bucket, avg(corr) AS avg_corr, max(corr) AS max_corr FROM cb GROUP BY 1)
  JOIN (SELECT date_trunc('month', ts) AS bucket, avg(natr) / 1000 AS volatility, avg(adx) * 1.6e0 AS trend FROM z GROUP BY 1) USING (bucket)),
rg AS (SELECT *, CASE WHEN volatility > 0.2 AND avg_corr > 0.7 THEN 'crisis' WHEN volatility <= 0.2 AND trend > 25 THEN 'low_vol_trending'
  WHEN volatility > 0.2 AND trend > 25 THEN 'high_vol_trending' WHEN volatility <= 0.2 THEN 'low_vol_mean_reverting' ELSE 'high_vol_mean_reverting' END AS regime,
  CASE WHEN volatility > 0.2 AND avg_corr > 0.7 THEN least(1e0, max_corr) WHEN volatility <= 0.2 AND trend > 25 THEN 0.8e0
  WHEN volatility > 0.2 AND trend > 25 THEN 0.7e0 WHEN volatility <= 0.2 THEN 0.75e0 ELSE 0.7e0 END AS confidence FROM mm)"""


@register("regime_rules", f"{ALL_INDICATORS}, {MONTHS} SELECT * FROM rg", "avg_corr max_corr volatility trend confidence", digits=5)
def regime_rules(spark, d):
    return regimes.regime_rules(market_months(spark, d))


@register("regime_transitions", f"""{ALL_INDICATORS}, {MONTHS}, l AS (SELECT bucket, regime FROM rg ORDER BY bucket DESC LIMIT 20),
n AS (SELECT regime, lead(regime) OVER (ORDER BY bucket) AS next_regime FROM l)
SELECT regime, next_regime, count(*) AS moves, count(*) / sum(count(*)) OVER (PARTITION BY regime) AS probability
FROM n WHERE next_regime IS NOT NULL GROUP BY 1, 2""", "probability")
def regime_transitions(spark, d):
    return regimes.regime_transitions(regimes.regime_rules(market_months(spark, d)))


@register("regime_history", f"{ALL_INDICATORS}, {MONTHS} SELECT bucket, regime FROM rg WHERE bucket BETWEEN '1997-01-01' AND '1999-12-31'")
def regime_history(spark, d):
    r = regimes.regime_rules(market_months(spark, d))
    return regimes.regime_history(r, "1997-01-01", "1999-12-31").select("bucket", "regime")


N_PAIRS = len(SYMBOLS) * (len(SYMBOLS) - 1) // 2


@register("regime_clusters", f"""{WITH}, {PAIRS}, m AS (SELECT date_trunc('month', ts) AS bucket, a, b, {CORR} AS corr FROM pr GROUP BY 1, 2, 3),
g AS (SELECT bucket, sum(corr) / {N_PAIRS} AS avg_corr FROM m GROUP BY 1)
SELECT bucket, avg_corr, CASE WHEN avg_corr > 0.7 THEN 'crisis' WHEN avg_corr > 0.5 THEN 'high_vol_trending' WHEN avg_corr > 0.3 THEN 'low_vol_trending'
  WHEN avg_corr > 0.1 THEN 'low_vol_mean_reverting' ELSE 'neutral' END AS regime, TRUE AS sound FROM g""", "avg_corr")
def regime_clusters(spark, d):
    """Mean correlation and name per month; that the cluster is one of the six and not all are one."""
    c = regimes.corr_by(daily_returns(spark, d), F.date_trunc("month", "ts"))
    out = regimes.regime_clusters(c, SYMBOLS)
    return out.select("bucket", "avg_corr", "regime", F.col("cluster").between(0, 5).alias("sound"))
