"""Sentiment parsing and aggregation, fundamental and technical scores, confluence signals."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barline.functions import bounded, ratio, zero_if_null
from barline.operators.tables import last_n

# Indicator weights, factor weights, and signal weights per market regime.
INDICATOR_WEIGHTS = {"rsi": 0.15, "macd": 0.15, "macd_histogram": 0.10, "bb_pct_b": 0.10,
                     "adx": 0.10, "stoch_k": 0.10, "momentum": 0.10, "trend": 0.20}
FACTOR_WEIGHTS = {"value": 0.25, "quality": 0.25, "momentum": 0.20, "growth": 0.15,
                  "low_vol": 0.15}
SIGNAL_KINDS = ("technical", "sentiment", "fundamental")
REGIME_WEIGHTS = {"bullish": (0.35, 0.40, 0.25), "bearish": (0.30, 0.30, 0.40),
                  "high_volatility": (0.50, 0.30, 0.20), "low_volatility": (0.35, 0.30, 0.35),
                  "trending": (0.50, 0.30, 0.20), "mean_reverting": (0.30, 0.35, 0.35),
                  "neutral": (0.40, 0.35, 0.25)}
DEFAULT_WEIGHTS = REGIME_WEIGHTS["neutral"]
SOCIAL_DISCOUNT = 0.7
NEUTRAL_BAND = 0.3


# ---- sentiment -------------------------------------------------------------------------------

# The forms of a number and of a named field in free model output.
NUMBER = r"-?\d+\.?\d*"
FIELD = r'(?i)"{name}"?\s*:\s*{value}'


def _number(text: Column, field: str) -> Column:
    found = F.regexp_extract(text, FIELD.format(name=field, value=f"({NUMBER})"), 1)
    return F.when(found != "", found.cast("double"))


def parse_sentiment(responses: DataFrame, text: str = "response") -> DataFrame:
    """Score, confidence, class and reasoning out of free model output.

    A flat JSON object wins; without a valid one the fields are searched by pattern, clamped,
    and any first number stands in for the score.
    """
    t = F.col(text)
    block = F.regexp_extract(t, r"(?s)\{[^{}]*\}", 0)
    fields = F.from_json(F.when(block != "", block), "map<string,string>")
    df = responses.withColumn("_j", fields)
    valid = F.col("_j").isNotNull()

    def json_num(name, default):
        return F.coalesce(F.col("_j")[name].try_cast("double"), F.lit(default))
    any_number = F.regexp_extract(t, NUMBER, 0)
    loose_score = bounded(F.coalesce(_number(t, "sentiment"),
                                     F.when(any_number != "", any_number.cast("double")),
                                     F.lit(0.0)), -1.0, 1.0)
    loose_conf = bounded(F.coalesce(_number(t, "confidence"), F.lit(0.5)), 0.0, 1.0)
    low = F.lower(t)
    loose_class = (F.when(low.contains("bullish"), "bullish")
                   .when(low.contains("bearish"), "bearish").otherwise("neutral"))
    quoted = F.regexp_extract(t, FIELD.format(name="reasoning", value='"([^"]*)"'), 1)
    bare = F.substring(F.regexp_replace(t, r'[{}\[\]"]', ""), 1, 200)
    df = (df.withColumn("score", F.when(valid, json_num("sentiment", 0.0)).otherwise(loose_score))
          .withColumn("confidence", F.when(valid, json_num("confidence", 0.5)).otherwise(loose_conf))
          .withColumn("_class", F.when(valid, F.lower(F.coalesce(F.col("_j")["classification"],
                                                                 F.lit("neutral"))))
                      .otherwise(loose_class))
          .withColumn("reasoning", F.when(valid, F.coalesce(F.col("_j")["reasoning"], F.lit("")))
                      .otherwise(F.when(quoted != "", quoted).otherwise(bare))))
    named = [(F.col("_class").contains(c), c) for c in ("bullish", "bearish", "neutral")]
    final = F.when(named[0][0], named[0][1])
    for cond, name in named[1:]:
        final = final.when(cond, name)
    final = (final.when(F.col("score") > NEUTRAL_BAND, "bullish")
             .when(F.col("score") < -NEUTRAL_BAND, "bearish").otherwise("neutral"))
    return df.withColumn("classification", final).drop("_j", "_class")


def social_discount(scores: DataFrame) -> DataFrame:
    return scores.withColumn("confidence", F.when(
        F.col("source") == "social_media", F.col("confidence") * SOCIAL_DISCOUNT)
        .otherwise(F.col("confidence")))


def sentiment_agg(scores: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Confidence-weighted score (plain mean without confidence), counts and majority class."""
    def n(c):
        return F.count(F.when(F.col("classification") == c, 1))
    g = scores.groupBy(*keys).agg(
        F.coalesce(ratio(F.sum(F.col("score") * F.col("confidence")), F.sum("confidence")),
                   F.avg("score")).alias("aggregated_score"),
        zero_if_null(F.avg("confidence")).alias("confidence"), F.count(F.lit(1)).alias("num_items"),
        n("bullish").alias("bullish_count"), n("bearish").alias("bearish_count"),
        n("neutral").alias("neutral_count"))
    b, s, o = F.col("bullish_count"), F.col("bearish_count"), F.col("neutral_count")
    return g.withColumn("aggregated_classification",
                        F.when((b > s) & (b > o), "bullish").when((s > b) & (s > o), "bearish")
                        .otherwise("neutral"))


# ---- fundamentals ----------------------------------------------------------------------------

def fundamental_scores(df: DataFrame) -> DataFrame:
    """value_score from P/E and P/B, quality_score from ROE and D/E; 0 counts as missing."""
    def have(c):
        return F.coalesce(F.col(c) != 0, F.lit(False))

    def low_is_good(c, top, width):
        return F.when(F.col(c) > 0, bounded((F.lit(top) - F.col(c)) / width, 0.0, 1.0)).otherwise(0.5)
    pe, pb = low_is_good("pe", 50.0, 45.0), low_is_good("pb", 5.0, 4.5)
    mean = F.when(have("pe") & have("pb"), (pe + pb) / 2).when(have("pe"), pe).when(have("pb"), pb)
    value = zero_if_null((mean - 0.5) * 2)
    # a return on equity above 1 is a percentage
    roe = F.when(have("roe"), F.when(F.col("roe") > 1, F.col("roe") / 100).otherwise(F.col("roe")))
    roe_score = zero_if_null(bounded((roe + 0.1) / 0.4, 0.0, 1.0))
    debt = bounded((2 - F.when(have("de"), F.col("de"))) / 2, 0.0, 1.0)
    raw = (F.when(debt.isNull(), roe_score).when(roe_score > 0, (roe_score + debt) / 2)
           .otherwise(debt))
    quality = F.when(raw > 0, (raw - 0.5) * 2).otherwise(raw)
    return df.withColumn("value_score", value).withColumn("quality_score", quality)


def _weighted(parts: dict[str, tuple[float, Column]]) -> Column:
    """Weighted mean over the values present, clipped; 0 if none is."""
    total = sum((zero_if_null(v * w) for w, v in parts.values()), F.lit(0.0))
    weight = sum((F.when(v.isNotNull(), w).otherwise(0.0) for w, v in parts.values()), F.lit(0.0))
    return zero_if_null(bounded(ratio(total, weight), -1.0, 1.0))


def fundamental_factor(df: DataFrame, names: dict[str, str] | None = None) -> Column:
    """Factor score from the columns present; ``names`` maps a factor to its column."""
    names = names or {"value": "value_score", "quality": "quality_score"}
    parts = {}
    for factor, w in FACTOR_WEIGHTS.items():
        c = names.get(factor, factor)
        if c in df.columns:
            parts[factor] = (w, bounded(c, -1.0, 1.0))
    return _weighted(parts)


def technical_score(df: DataFrame, already_scaled: Sequence[str] = ()) -> Column:
    """Indicator score; every indicator is scaled to [-1, 1] once."""
    scale = {"rsi": lambda c: (c - 50) / 50, "stoch_k": lambda c: (c - 50) / 50,
             "bb_pct_b": lambda c: (c - 0.5) * 2,
             "adx": lambda c: bounded((c - 25) / 25, -1.0, 1.0)}
    parts = {}
    for name, w in INDICATOR_WEIGHTS.items():
        if name in df.columns:
            c = F.col(name)
            plain = name in already_scaled or name not in scale
            parts[name] = (w, bounded(c, -1.0, 1.0) if plain else scale[name](c))
    return _weighted(parts)


# ---- regime and confluence -------------------------------------------------------------------

def market_regime(return_20: str = "return_20", volatility: str = "volatility",
                  trend: str = "adx") -> Column:
    r, v, t = F.col(return_20), F.col(volatility), F.col(trend)
    return (F.when(v > 0.02, "high_volatility").when(v < 0.01, "low_volatility")
            .when(t > 25, "trending").when(r > 0.05, "bullish").when(r < -0.05, "bearish")
            .otherwise("neutral"))


def ic_weights(observations: DataFrame, keep: int = 100, min_rows: int = 20,
               tie: Sequence[str] = ()) -> DataFrame:
    """One row of signal weights from sign agreement; the defaults until each kind has history."""
    last = last_n(observations, keep, ["kind"], ["ts", *tie], F.date_trunc("quarter", "ts"))
    agree = F.when((F.col("score") > 0) == (F.col("actual") > 0), 1.0).otherwise(-1.0)
    per = last.groupBy("kind").agg(F.abs(F.avg(agree)).alias("ic"), F.count(F.lit(1)).alias("n"))

    def pick(kind, c):
        return F.max(F.when(F.col("kind") == kind, F.col(c)))
    one = per.agg(*[pick(k, "ic").alias(f"_{k}") for k in SIGNAL_KINDS],
                  *[F.coalesce(pick(k, "n"), F.lit(0)).alias(f"_n{k}") for k in SIGNAL_KINDS])
    total = sum((F.col(f"_{k}") for k in SIGNAL_KINDS[1:]), F.col(f"_{SIGNAL_KINDS[0]}"))
    enough = (F.least(*[F.col(f"_n{k}") for k in SIGNAL_KINDS]) >= min_rows) & (total > 0)
    return one.select(*[F.when(enough, ratio(f"_{k}", total)).otherwise(w).alias(k)
                        for k, w in zip(SIGNAL_KINDS, DEFAULT_WEIGHTS)])


def _regime_weight(i: int, regime: Column) -> Column:
    out = F.lit(DEFAULT_WEIGHTS[i])
    for name, w in REGIME_WEIGHTS.items():
        out = F.when(regime == name, w[i]).otherwise(out)
    return out


def confluence(df: DataFrame, threshold: float = 0.3, use_regime: bool = True) -> DataFrame:
    """Needs technical_score, sentiment_score, fundamental_score, regime."""
    parts = [bounded(f"{k}_score", -1.0, 1.0) if k == "sentiment" else F.col(f"{k}_score")
             for k in SIGNAL_KINDS]
    weights = [_regime_weight(i, F.col("regime")) if use_regime else F.lit(DEFAULT_WEIGHTS[i])
               for i in range(3)]
    score = weights[0] * parts[0] + weights[1] * parts[1] + weights[2] * parts[2]

    def n(cond):
        return sum((F.when(cond(p), 1).otherwise(0) for p in parts), F.lit(0))
    pos, neg = n(lambda p: p > 0.1), n(lambda p: p < -0.1)
    flat = n(lambda p: F.abs(p) <= 0.1)
    base = (F.when((pos == 3) | (neg == 3), 0.9)
            .when(((pos == 2) | (neg == 2)) & (flat == 1), 0.75)
            .when((pos == 2) | (neg == 2), 0.6).otherwise(0.4))
    mean = (F.abs(parts[0]) + F.abs(parts[1]) + F.abs(parts[2])) / 3
    out = df.withColumn("confluence_score", score)
    c = F.col("confluence_score")
    strength = F.when(F.abs(c) > threshold, F.least(F.abs(c), F.lit(1.0))).otherwise(F.abs(c))
    return (out.withColumn("direction", F.when(c > threshold, "long").when(c < -threshold, "short")
                           .otherwise("neutral"))
            .withColumn("strength", strength)
            .withColumn("confidence", bounded(base * (0.5 + 0.5 * mean), 0.0, 1.0)))


def confluence_batch(aligned: DataFrame) -> DataFrame:
    """Indicators plus sentiment and fundamental columns to signals, neutral regime throughout."""
    df = aligned.withColumn("technical_score", technical_score(aligned)).withColumn(
        "fundamental_score", bounded("fundamental", -1.0, 1.0)).withColumn(
        "sentiment_score", F.col("sentiment")).withColumn("regime", F.lit("neutral"))
    return confluence(df).select("symbol", "ts", "confluence_score", "direction", "strength",
                                 "confidence", "technical_score", "sentiment_score",
                                 "fundamental_score", "regime")


def agreement_signal(df: DataFrame) -> DataFrame:
    """Buy or sell only where model class and sentiment agree."""
    t, s, c = F.col("technical"), F.col("sentiment"), F.col("confidence")
    buy, sell = (t > 0) & (s > 0.1), (t < 0) & (s < -0.1)
    return df.withColumn("signal", F.when(buy, 1).when(sell, -1).otherwise(0)).withColumn(
        "signal_confidence", F.when(buy | sell, F.least(c, F.abs(s))).otherwise(c))
