"""Language identification with a blended-spectrum string kernel.

A text is the set of its character 1-, 2- and 3-grams (presence, not counts), taken from the whole
lower-cased text over an alphabet of 64 symbols. The kernel of two texts is the number of shared
n-grams over the geometric mean of their numbers. Nystroem: a text is described by its kernel
values with a few landmark texts per language, whitened by the landmarks' own kernel matrix; a
one-versus-rest ridge regression on these features gives a score per language. Scoring a batch is
two matrix products.
"""

from __future__ import annotations

from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barline.llm.common import col

ALPHABET = 64
SLOTS = 64             # hash slots per language from which training documents are taken
TRAIN_PER_SLOT = 8     # at most SLOTS * TRAIN_PER_SLOT training documents per language
LANDMARKS = 32         # per language, the first of its training documents by hash
LANGUAGES = 64         # with more languages, each gets fewer training documents and landmarks
FEWEST = 8             # training documents that a language keeps, however many languages there are
RIDGE = 1e-3
SHARPNESS = 6.0
GRAMS = ALPHABET + ALPHABET ** 2 + ALPHABET ** 3


def symbol_table() -> np.ndarray:
    """Code point to symbol: 0 for what is no letter, a-z, the Latin-1 letters, and the rest of
    the letters by remainder over all symbols but 0."""
    table = np.zeros(0x110000, dtype=np.uint8)
    for cp in range(0x110000):
        if 97 <= cp <= 122:
            table[cp] = cp - 96
        elif 0xDF <= cp <= 0xFF and cp != 0xF7:
            table[cp] = 27 + cp - 0xDF
        elif cp > 127 and chr(cp).isalpha():
            table[cp] = 1 + cp * 40503 % (ALPHABET - 1)
    return table


_TABLE: list[np.ndarray] = []


def symbols(text: str) -> np.ndarray:
    if not _TABLE:
        _TABLE.append(symbol_table())
    return _TABLE[0][np.frombuffer(text.lower().encode("utf-32-le", "replace"), np.uint32)]


def grams(text: str, present: np.ndarray) -> bool:
    """Mark the n-grams of ``text`` in ``present``; False if it has no letter. Runs of other
    characters count as one blank."""
    s = symbols(text).astype(np.int64)
    s = s[(s > 0) | np.concatenate([[True], s[:-1] > 0])] if len(s) else s
    present[:] = False
    present[s] = True
    present[ALPHABET + s[:-1] * ALPHABET + s[1:]] = True
    present[ALPHABET + ALPHABET ** 2 + (s[:-2] * ALPHABET + s[1:-1]) * ALPHABET + s[2:]] = True
    return bool((s > 0).any())


@dataclass
class Landmarks:
    """n-grams of the landmark texts: the sorted n-grams that any has, presence, root of sizes."""
    vocabulary: np.ndarray
    present: np.ndarray
    root: np.ndarray

    def kernel(self, present: np.ndarray, size: np.ndarray) -> np.ndarray:
        return (present @ self.present.T) / (np.sqrt(np.maximum(size, 1))[:, None] * self.root)

    def describe(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Kernel values with the landmarks, and which texts have a letter."""
        one = np.zeros(GRAMS, dtype=bool)
        rows = np.zeros((len(texts), len(self.vocabulary)), dtype=np.float32)
        size, letters = np.zeros(len(texts), dtype=np.float32), np.zeros(len(texts), dtype=bool)
        for i, t in enumerate(texts):
            letters[i] = grams(t, one)
            rows[i] = one[self.vocabulary]
            size[i] = np.count_nonzero(one)
        return self.kernel(rows, size), letters


@dataclass
class Model:
    languages: list[str]
    landmarks: Landmarks | None
    weights: np.ndarray

    def predict(self, texts: list[str]) -> tuple[list[str], np.ndarray]:
        if not self.languages:
            return ["und"] * len(texts), np.zeros(len(texts))
        k, letters = self.landmarks.describe(texts)
        z = SHARPNESS * (k @ self.weights)
        p = np.exp(z - z.max(axis=1, keepdims=True))
        p /= p.sum(axis=1, keepdims=True)
        best = p.argmax(axis=1)
        return ([self.languages[j] if ok else "und" for j, ok in zip(best, letters, strict=True)],
                np.where(letters, p[np.arange(len(best)), best], 0.0).astype(float))


def training_sample(docs: DataFrame, keep: Column, key: str, text: str, lang: str) -> DataFrame:
    """(rank, marks, lang, body): per language the documents with the smallest hash in each of SLOTS
    slots, so at most SLOTS * TRAIN_PER_SLOT of them, ranked from 0 on, first one per slot. Every
    language with a text that has a letter is there; beyond LANGUAGES of them the documents
    per language and ``marks``, its landmarks, shrink as their number grows. Rows that share a key
    count by themselves, each with its own language and text; rows that repeat all three count once."""
    read = (docs.where(keep & col(lang).isNotNull() & col(text).rlike("\\p{L}"))
            .select(col(key).alias("id"), col(lang).alias("lang"), F.xxhash64(col(text)).alias("text_hash"),
                    col(text).alias("body")))
    same = ["id", "lang", "text_hash"]
    h = F.xxhash64("id", "lang", "text_hash")
    ids = read.select(*same, h.alias("h"), F.pmod(h, F.lit(SLOTS)).alias("slot"))
    crowd = max(1.0, ids.select("lang").distinct().count() / LANGUAGES)
    most = max(FEWEST, int(SLOTS * TRAIN_PER_SLOT / crowd))
    n = F.dense_rank().over(Window.partitionBy("lang", "slot").orderBy("h", "id", "text_hash"))  # repeated rows share it
    rank = F.row_number().over(Window.partitionBy("lang").orderBy("n", "slot")) - 1  # bounded by SLOTS * TRAIN_PER_SLOT
    ids = (ids.withColumn("n", n).where(F.col("n") <= TRAIN_PER_SLOT).dropDuplicates([*same, "n", "slot"])
           .withColumn("rank", rank.cast("long")).where(F.col("rank") < most)
           .select(*same, "rank", F.lit(max(1, int(LANDMARKS / crowd))).alias("marks")))
    met = [F.col(f"r.{c}").eqNullSafe(F.col(f"i.{c}")) for c in same]
    return (read.alias("r").join(F.broadcast(ids).alias("i"), met[0] & met[1] & met[2])
            .select("i.lang", "i.rank", "i.marks", "r.body").groupBy("lang", "rank")
            .agg(F.max("marks").alias("marks"), F.min_by("body", F.xxhash64("body")).alias("body")))


def train(docs: DataFrame, keep: Column, key: str = "doc_id", text: str = "text",
          lang: str = "lang") -> Model:
    """Fit on whole texts of a bounded sample of the rows that ``keep`` admits. The n-grams of
    the landmarks and the kernel rows of the sample are computed by Spark's tasks; the driver gets
    sets of at most GRAMS numbers per landmark and one row per training document."""
    sample = training_sample(docs, keep, key, text, lang)

    def marked(batches):
        one = np.zeros(GRAMS, dtype=bool)
        for b in batches:
            sets = []
            for t in b.column("body").to_pylist():
                grams(t, one)
                sets.append(np.flatnonzero(one).astype(np.int32))
            yield pa.RecordBatch.from_pydict({"lang": b.column("lang"), "rank": b.column("rank"),
                                              "grams": pa.array(sets, pa.list_(pa.int32()))})

    marks = (sample.where(F.col("rank") < F.col("marks")).select("lang", "rank", "body")
             .mapInArrow(marked, "lang string, rank long, grams array<int>")
             .orderBy("lang", "rank").toArrow())
    sets = [np.array(g, dtype=np.int64) for g in marks["grams"].to_pylist()]
    if not sets:
        return Model([], None, np.zeros((0, 0)))
    vocabulary = np.unique(np.concatenate(sets))
    present = np.zeros((len(sets), len(vocabulary)), dtype=np.float32)
    for i, g in enumerate(sets):
        present[i, np.searchsorted(vocabulary, g)] = 1
    root = np.sqrt(np.array([max(1, len(g)) for g in sets], dtype=np.float32))
    landmarks = Landmarks(vocabulary, present, root)

    def described(batches):
        for b in batches:
            k, letters = landmarks.describe(b.column("body").to_pylist())
            yield pa.RecordBatch.from_pydict({
                "lang": b.column("lang"), "rank": b.column("rank"),
                "k": pa.array(list(k), pa.list_(pa.float32())), "letters": pa.array(letters)})

    got = (sample.select("lang", "rank", "body")
           .mapInArrow(described, "lang string, rank long, k array<float>, letters boolean")
           .where("letters").orderBy("lang", "rank").toArrow())
    names = got["lang"].to_pylist()
    languages = sorted(set(names))
    if not languages:
        return Model([], None, np.zeros((0, 0)))
    own = landmarks.kernel(present, root.astype(np.float64) ** 2).astype(np.float64)
    value, vector = np.linalg.eigh(own)
    ok = value > 1e-6 * value.max()
    whiten = vector[:, ok] / np.sqrt(value[ok])
    x = got["k"].combine_chunks().flatten().to_numpy().reshape(len(names), -1).astype(np.float64) @ whiten
    y = np.where(np.array(names)[:, None] == np.array(languages)[None, :], 1.0, -1.0)
    # Every language weighs the same, however many of the sampled documents it has.
    times = Counter(names)
    w = 1.0 / np.array([times[n] for n in names])
    xw = x * w[:, None]
    beta = np.linalg.solve(xw.T @ x + RIDGE * np.eye(x.shape[1]), xw.T @ y)
    return Model(languages, landmarks, (whiten @ beta).astype(np.float32))


def predict(docs: DataFrame, model: Model, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: key, lang_pred, score (share of the best language, 0 to 1).

    A null text and one without a letter give ``und`` and score 0, and so does every text if
    nothing was learned. Ties go to the first language by name. Rows repeating a key are read one
    by one; an empty table gives no rows; other columns, of any name, are no input.
    """
    df = docs.select(col(key).alias("id"), F.coalesce(col(text), F.lit("")).alias("body"))
    kind = df.schema["id"].dataType.simpleString()

    def run(batches):
        for b in batches:
            names, p = model.predict(b.column("body").to_pylist())
            yield pa.RecordBatch.from_pydict({"id": b.column("id"), "lang_pred": pa.array(names, pa.string()),
                                              "score": pa.array(p, pa.float64())})

    return df.mapInArrow(run, f"id {kind}, lang_pred string, score double").withColumnRenamed("id", key)
