"""The language model against kernel ridge regression in its dual form, over plain sets of n-grams."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from barline.llm import langid

WORDS = {"en": "the cat sat on that mat and with which they thought".split(),
         "de": "der Hund bellt über die Straße und nicht auf dem Weg".split(),
         "fr": "le chien était dans la rue avec une très belle maison".split()}


def plain_grams(text):
    s = []
    for c in langid.symbols(text).tolist():
        if c or not s or s[-1]:
            s.append(c)
    return {tuple(s[i:i + n]) for n in (1, 2, 3) for i in range(len(s) - n + 1)}


def kernel(a, b):
    return np.array([[len(x & y) / np.sqrt(max(1, len(x)) * max(1, len(y))) for y in b] for x in a])


def test_scores_equal_dual_ridge(spark):
    rng = random.Random(2)
    rows = [(i, lang, " ".join(rng.choices(WORDS[lang], k=rng.randrange(3, 12))))
            for i, lang in enumerate(rng.choices(["en", "en", "en", "de", "fr"], k=90))]
    docs = spark.createDataFrame(rows, "doc_id long, lang string, text string")
    keep = F.lit(True)
    model = langid.train(docs, keep)
    sample = langid.training_sample(docs, keep, "doc_id", "text", "lang").collect()
    sets, names = [plain_grams(r.body) for r in sample], [r.lang for r in sample]
    marks = [s for s, r in zip(sets, sample, strict=True) if r["rank"] < r.marks]
    languages = sorted(set(names))
    assert model.languages == languages == ["de", "en", "fr"] and len(marks) > 60
    inverse = np.linalg.pinv(kernel(marks, marks), rcond=1e-6, hermitian=True)
    near = kernel(sets, marks)
    y = np.where(np.array(names)[:, None] == np.array(languages)[None, :], 1.0, -1.0)
    own = np.diag([langid.RIDGE * names.count(n) for n in names])   # a language weighs the same, whatever its number
    alpha = np.linalg.solve(near @ inverse @ near.T + own, y)

    new = ["the dog and the cat", "über den Hund", "la maison dans la rue", "xyz", "and die le", "THE MAT!! 12 und"]
    value = langid.SHARPNESS * kernel([plain_grams(t) for t in new], marks) @ inverse @ near.T @ alpha
    p = np.exp(value - value.max(axis=1, keepdims=True))
    p /= p.sum(axis=1, keepdims=True)
    got, score = model.predict(new)
    assert got == [languages[j] for j in p.argmax(axis=1)] and got[:3] == ["en", "de", "fr"]
    assert score == pytest.approx(p.max(axis=1), abs=5e-3)
