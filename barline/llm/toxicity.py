"""Toxicity by gradient-boosted trees over dense features, with isotonic calibration.

Features: lexicon densities (a short fixed list and a learned one), hits close to a second-person
word, capitals, punctuation and obfuscated spellings. Lexicon and trees are learned from a bounded
sample of labelled rows; scoring reads every whole text.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from barline.llm import trees
from barline.llm.common import col, labelled_sample

TRAIN_ROWS = 12_000
LEXICON_WORDS = 256
THRESHOLD = 0.7
NEAR = 8

# Common insults and second-person words of the four languages.
INSULTS = ("idiot", "idiots", "idiota", "idiote", "moron", "stupid", "loser", "trash", "scum", "pathetic",
           "worthless", "disgusting", "clown", "dumb", "fool", "imbecile", "imbécil", "imbécile",
           "dumm", "blöd", "trottel", "abschaum", "stupide", "débile", "estúpido", "basura", "tonto")
SECOND_PERSON = ("you", "your", "yours", "yourself", "du", "dich", "dir", "dein", "deine", "ihr", "euch",
                 "tu", "te", "toi", "ton", "ta", "vous", "votre", "tú", "ti", "usted", "ustedes")
# Characters that stand in for letters in obfuscated words.
STANDS_FOR = str.maketrans("013457@$!", "oieastasi")

LETTERS = re.compile(r"[^\W\d_]+")
MASKED = re.compile(r"[^\W\d_]+[0-9@$!*]+[^\W\d_][\w@$!*]*")

# Byte classes for one histogram per text: capitals (of ASCII; see features), digits, !, ?, other punctuation, space.
KINDS = np.zeros((256, 6))
for _kind, _bytes in enumerate((b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789", b"!", b"?",
                                b"\"#$%&'()*+,-./:;<=>@[\\]^_`{|}~", b" \t\r\n")):
    KINDS[list(_bytes), _kind] = 1


def features(text: str, lexicon: dict[str, float], fixed: frozenset, second: frozenset) -> list[float]:
    words = LETTERS.findall(text.lower())
    n = max(1, len(words))
    hits = [i for i, w in enumerate(words) if w in lexicon or w in fixed]
    weights = [lexicon.get(words[i], 0.0) for i in hits]
    persons = np.array([i for i, w in enumerate(words) if w in second]) if hits else None
    near = 0
    if hits and len(persons):
        near = int((np.abs(np.array(hits)[:, None]
                           - persons[np.clip(np.searchsorted(persons, hits)[:, None] + np.array([-1, 0]),
                                             0, len(persons) - 1)]).min(axis=1) <= NEAR).sum())
    masked = MASKED.findall(text)
    plain = [LETTERS.findall(m.lower().replace("*", "").translate(STANDS_FOR)) for m in masked]
    uncovered = sum(any(w in fixed or w in lexicon for w in ws) for ws in plain)
    data = text.encode("utf-8", "replace")
    codes = np.frombuffer(data, np.uint8)
    share = np.bincount(codes, minlength=256) @ KINDS / max(1, len(data))
    # capitals of Latin-1: À to Þ but ×, two bytes each
    share[0] += ((codes[:-1] == 0xC3) & (codes[1:] <= 0x9E) & (codes[1:] != 0x97)).sum() / max(1, len(data))
    return [len(hits) / n, np.log1p(len(hits)), sum(words[i] in fixed for i in hits) / n,
            sum(weights) / n, sum(weights), max(weights, default=0.0), len({words[i] for i in hits}),
            near / n, near, len(masked) / n, uncovered, np.log1p(len(words)), len(data) / n, *share]


@dataclass
class Model:
    lexicon: dict[str, float]
    forest: trees.Forest
    calibration: trees.Calibration

    def score(self, x: np.ndarray) -> np.ndarray:
        return self.calibration(self.forest.margin(x))


def measured(df: DataFrame, lexicon: dict[str, float], model: Model | None = None) -> DataFrame:
    """``df`` (id, body, ...) without the body: its features, or its score if a model is given."""
    others = [f for f in df.schema if f.name != "body"]
    value_field = T.StructField("score", T.DoubleType()) if model else T.StructField("x", T.ArrayType(T.DoubleType()))

    def run(batches):
        fixed, second = frozenset(INSULTS), frozenset(SECOND_PERSON)
        for b in batches:
            x = [features(t, lexicon, fixed, second) for t in b.column("body").to_pylist()]
            value = pa.array(model.score(np.array(x)), pa.float64()) if model \
                else pa.array(x, pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays([*(b.column(f.name) for f in others), value],
                                             names=[*(f.name for f in others), value_field.name])

    return df.mapInArrow(run, T.StructType([*others, value_field]))


def learn_lexicon(sample: DataFrame, words: int) -> dict[str, float]:
    """Words with the largest log-likelihood ratio for label 1, with their log odds: document
    frequencies per class, summed by Spark; only the ``words`` best rows reach the driver."""
    split = F.array_distinct(F.split(F.lower("body"), r"[^\p{L}]+"))
    sizes = sample.agg(F.sum("label").alias("ones"), F.count("*").alias("all")).first()
    ones, zeros = int(sizes["ones"] or 0), int(sizes["all"]) - int(sizes["ones"] or 0)
    if not ones or not zeros:
        return {}
    p, n = F.col("p"), F.col("n")
    odds = F.log((p + 0.5) / (ones + 1)) - F.log((n + 0.5) / (zeros + 1))
    term = lambda a, e: F.when(a > 0, a * F.log(a / e)).otherwise(0.0)
    ratio = 2 * (term(p, (p + n) * ones / (ones + zeros)) + term(n, (p + n) * zeros / (ones + zeros)))
    top = (sample.select("label", F.explode(split).alias("word")).where("word <> ''")
           .groupBy("word").agg(F.sum("label").alias("p"), F.sum(1 - F.col("label")).alias("n"))
           .where("p >= 5").select("word", odds.alias("odds"), ratio.alias("ratio"))
           .where("odds > 1 AND ratio > 20").orderBy(F.desc("ratio"), "word").limit(words))
    return {r["word"]: r["odds"] for r in top.collect()}


def train(docs: DataFrame, labels: DataFrame, keep: Column, rows: int = TRAIN_ROWS,
          lexicon_words: int = LEXICON_WORDS, key: str = "doc_id", text: str = "text",
          label: str = "toxic") -> Model:
    """Learn from at most ``rows`` labelled documents that ``keep`` admits. Without any label
    the score is 0 for every text."""
    sample = labelled_sample(docs, labels, label, keep, rows, key, text)
    lexicon = learn_lexicon(sample, lexicon_words)
    got = measured(sample, lexicon).orderBy(F.xxhash64("id"), "id").toArrow()
    y = np.array(got["label"].to_pylist(), dtype=float)
    x = np.array(got["x"].to_pylist(), dtype=float).reshape(len(y), -1 if len(y) else 0)
    return Model(lexicon, *trees.fit_calibrated(x, y))


def score(docs: DataFrame, model: Model, key: str = "doc_id", text: str = "text",
          threshold: float = THRESHOLD) -> DataFrame:
    """One row per document: key, score (0 to 1), predicted (1 from ``threshold`` on).

    Null counts as empty text and is scored like any other. Rows repeating a key are scored one
    by one; an empty table gives no rows; other columns, of any name, are no input.
    """
    df = docs.select(col(key).alias("id"), F.coalesce(col(text), F.lit("")).alias("body"))
    return (measured(df, model.lexicon, model).withColumnRenamed("id", key)
            .withColumn("predicted", (F.col("score") >= threshold).cast("int")))


def keep_clean(docs: DataFrame, model: Model, text: str = "text",
               threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs`` that score below ``threshold``, unchanged."""
    df = docs.select(F.struct(*map(col, docs.columns)).alias("row"),
                     F.coalesce(col(text), F.lit("")).alias("body"))
    return (measured(df, model.lexicon, model).where(F.col("score") < threshold)
            .select("row.*").toDF(*docs.columns))
