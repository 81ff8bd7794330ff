"""Quality by histogram gradient-boosted trees over document statistics.

The statistics come from one byte histogram, the words and the lines of a text. Trees are fitted on
a bounded sample of labelled rows and flattened, so that a batch is scored in a few numpy steps.
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
THRESHOLD = 0.7

# Very frequent words of the four languages.
STOP_WORDS = frozenset((
    "the of and to in is that it for was on are with this be at by or from a "
    "der die das und ist von zu den mit ein eine im für auf nicht als "
    "le la les de des du et un une est dans pour que qui sur au "
    "el los las y en que del se con por para no una su al es").split())

# Byte classes: lower, upper, digit, sentence mark, other marks by kind, spaces, lines, non-ASCII.
CLASSES = (b"abcdefghijklmnopqrstuvwxyz", b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789", b".,", b"!", b"?",
           b"*", b"#$%&", b"|", b"\"'()-:;/", b"+<=>@[\\]^_`{}~", b" \t\r", b"\n", bytes(range(128, 256)))
KINDS = np.zeros((256, len(CLASSES)))
for _kind, _bytes in enumerate(CLASSES):
    KINDS[list(_bytes), _kind] = 1
WORD = re.compile(r"\S+")


def statistics(text: str) -> list[float]:
    data = text.encode("utf-8", "replace")
    counts = np.bincount(np.frombuffer(data, np.uint8), minlength=256)
    share = counts @ KINDS / max(1, len(data))
    p = counts[counts > 0] / max(1, len(data))
    words = text.split()
    n = max(1, len(words))
    lines = [x for x in text.split("\n") if x.strip()]
    m = max(1, len(lines))
    return [*share, float(-(p * np.log(p)).sum()) if len(data) else 0.0, np.log1p(len(data)), np.log1p(len(words)),
            len(data) / n, len(set(words)) / n, sum(map(STOP_WORDS.__contains__, words)) / n,
            np.log1p(len(lines)), len(set(lines)) / m, n / m, max(map(len, words), default=0)]


@dataclass
class Model:
    forest: trees.Forest
    calibration: trees.Calibration

    def score(self, x: np.ndarray) -> np.ndarray:
        return self.calibration(self.forest.margin(x))


def measured(df: DataFrame, model: Model | None = None) -> DataFrame:
    """``df`` (id, body, ...) without the body: its statistics, or its score if a model is given."""
    others = [f for f in df.schema if f.name != "body"]
    value_field = T.StructField("score", T.DoubleType()) if model else T.StructField("x", T.ArrayType(T.DoubleType()))

    def run(batches):
        for b in batches:
            x = [statistics(t) for t in b.column("body").to_pylist()]
            value = pa.array(model.score(np.array(x)), pa.float64()) if model \
                else pa.array(x, pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays([*(b.column(f.name) for f in others), value],
                                             names=[*(f.name for f in others), value_field.name])

    return df.mapInArrow(run, T.StructType([*others, value_field]))


def train(docs: DataFrame, labels: DataFrame, keep: Column, rows: int = TRAIN_ROWS,
          key: str = "doc_id", text: str = "text", label: str = "quality") -> Model:
    """Learn from at most ``rows`` labelled documents that ``keep`` admits. Without any label
    the score is 0 for every text."""
    sample = labelled_sample(docs, labels, label, keep, rows, key, text)
    got = measured(sample).orderBy(F.xxhash64("id"), "id").toArrow()
    y = np.array(got["label"].to_pylist(), dtype=float)
    x = np.array(got["x"].to_pylist(), dtype=float).reshape(len(y), -1 if len(y) else 0)
    return Model(*trees.fit_calibrated(x, y))


def score(docs: DataFrame, model: Model, key: str = "doc_id", text: str = "text",
          threshold: float = THRESHOLD) -> DataFrame:
    """One row per document: key, score (0 to 1, higher is better), predicted.

    Null counts as empty text and is scored like any other. Rows repeating a key are scored one
    by one; an empty table gives no rows; other columns, of any name, are no input.
    """
    df = docs.select(col(key).alias("id"), F.coalesce(col(text), F.lit("")).alias("body"))
    return (measured(df, model).withColumnRenamed("id", key)
            .withColumn("predicted", (F.col("score") >= threshold).cast("int")))
