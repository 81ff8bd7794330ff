"""Language, toxicity, quality and neighbours: held-out results, odd rows, brute force."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from barline.llm import ann, langid, quality, toxicity, trees
from barline.llm.common import fold

SF = "/root/testdata/sf0.01"


def auc(y, s):
    y, s = np.asarray(y), np.asarray(s)
    pos, neg = s[y == 1], s[y == 0]
    return float((pos[:, None] > neg[None, :]).mean() + 0.5 * (pos[:, None] == neg[None, :]).mean())


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


@pytest.fixture(scope="module")
def labels(spark):
    return spark.read.parquet(f"{SF}/labels.parquet")


def test_forest_equals_row_by_row_walk():
    rng = np.random.default_rng(2)
    x = rng.normal(size=(500, 6))
    y = (x[:, 0] * x[:, 1] > 0).astype(float)
    forest = trees.fit(x, y, rounds=20, depth=3)

    def walk(row):
        total = forest.base
        for t in range(len(forest.leaf)):
            k = 0
            while k < forest.feature.shape[1]:
                k = 2 * k + 1 + int(row[forest.feature[t, k]] > forest.cut[t, k])
            total += forest.leaf[t, k - forest.feature.shape[1]]
        return total
    assert np.allclose(forest.margin(x), [walk(r) for r in x])
    assert ((forest.margin(x) > 0) == (y == 1)).mean() > 0.9


def test_isotonic_is_monotone_and_calibrated():
    rng = np.random.default_rng(3)
    z = rng.normal(size=4000)
    y = (rng.uniform(size=4000) < 1 / (1 + np.exp(-2 * z))).astype(float)
    f = trees.isotonic(z, y)
    grid = f(np.linspace(-3, 3, 200))
    assert (np.diff(grid) >= 0).all() and abs(f(np.array([0.0]))[0] - 0.5) < 0.08


def test_language_held_out(docs, odd, none):
    model = langid.train(docs, fold(F.col("doc_id"), 5) != 0)
    got = langid.predict(docs, model).join(docs.select("doc_id", "lang"), "doc_id").where(fold(F.col("doc_id"), 5) == 0)
    rows = got.collect()
    assert np.mean([r.lang == r.lang_pred for r in rows]) > 0.97
    rows = langid.predict(odd, model).collect()
    texts = odd.select("text").collect()
    assert len(rows) == len(texts) and all(0 <= r.score <= 1 for r in rows)
    assert sum(r.lang_pred == "und" for r in rows) == sum(not any(c.isalpha() for c in t.text or "") for t in texts)
    empty = langid.train(none, F.lit(True))
    assert {r.lang_pred for r in langid.predict(odd, empty).collect()} == {"und"}
    assert langid.predict(none, model).collect() == []


def test_all_languages_are_learned(spark):
    rng = random.Random(6)
    rows = []
    for n in range(80):
        letters = rng.sample("abcdefghijklmnopqrstuvwxyz", 6)
        for _ in range(1 if n == 79 else 3 if n > 60 else 8):
            text = " ".join("".join(rng.choices(letters, k=5)) for _ in range(120))
            rows.append((len(rows), text, f"l{n:02}"))
    rows.append((None, "?!", "none"))
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = langid.train(df, F.lit(True))
    assert model.languages == [f"l{n:02}" for n in range(80)]
    got = langid.predict(df, model).join(df, "doc_id").collect()
    assert np.mean([r.lang == r.lang_pred for r in got]) > 0.95
    assert all(r.lang == r.lang_pred for r in got if r.lang == "l79")


def test_kernel_equals_plain_sets():
    def plain(t):
        s = []
        for c in langid.symbols(t).tolist():
            if c or not s or s[-1]:
                s.append(c)
        return {tuple(s[i:i + n]) for n in (1, 2, 3) for i in range(len(s) - n + 1)}
    a, b = "Der  Hund, der 12 bellt", "le chien"
    one = np.zeros(langid.GRAMS, dtype=bool)
    langid.grams(a, one)
    marks = langid.Landmarks(np.flatnonzero(one), np.ones((1, one.sum()), np.float32), np.sqrt([one.sum()]))
    k, _ = marks.describe([b, a])
    x, y = plain(a), plain(b)
    assert k[0, 0] == pytest.approx(len(x & y) / np.sqrt(len(x) * len(y))) and k[1, 0] == pytest.approx(1)


def test_toxicity_held_out(docs, labels, odd, none):
    keep = fold(F.col("doc_id"), 3) != 1
    model = toxicity.train(docs, labels, keep)
    got = toxicity.score(docs, model).join(labels, "doc_id").where(~keep).collect()
    assert auc([r.toxic for r in got], [r.score for r in got]) > 0.88
    flagged = [r for r in got if r.predicted]
    assert np.mean([r.toxic for r in flagged]) > 0.9 and all(r.score >= 0.7 for r in flagged)
    rows = toxicity.score(odd, model).collect()
    assert len(rows) == odd.count() and all(0 <= r.score <= 1 for r in rows)
    assert toxicity.score(none, model).collect() == []
    blank = toxicity.train(odd, labels.where("false"), F.lit(True))
    assert {r.score for r in toxicity.score(odd, blank).collect()} == {0.0}
    kept = toxicity.keep_clean(odd, model)
    assert kept.columns == odd.columns and kept.count() == sum(r.score < 0.7 for r in rows)


def test_training_rows_are_bounded_and_admitted(docs, labels):
    from barline.llm.common import labelled_sample
    keep = fold(F.col("doc_id"), 3) != 1
    rows = labelled_sample(docs, labels, "toxic", keep, 50).select("id").collect()
    import zlib
    assert len(rows) == 50 and all(zlib.crc32(str(r.id).encode()) % 3 != 1 for r in rows)


def test_repeated_ids_give_one_training_row_each(spark):
    from barline.llm.common import labelled_sample
    docs = spark.range(5000).selectExpr("id % 3 AS doc_id", "concat('text ', id % 700) AS text")
    labels = spark.createDataFrame([(0, 1), (1, 0), (1, 1), (2, 0), (None, 1)], "doc_id long, toxic int")
    rows = labelled_sample(docs, labels, "toxic", F.lit(True), 2).collect()
    assert len({r.id for r in rows}) == len(rows) == 2
    assert all(r.label == {0: 1, 1: 1, 2: 0}[r.id] for r in rows)


def test_language_sample_keeps_each_text_with_its_own_language(spark):
    rows = [(1, "ein deutscher satz", "de"), (1, "an english sentence", "en"), (1, "without language", None), (1, "?!", "de"),
            (None, "une phrase", "fr")] + [(2, "the same text", "en")] * 5000
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = langid.training_sample(df, F.lit(True), "doc_id", "text", "lang").select("lang", "body").collect()
    assert sorted(map(tuple, got)) == [("de", "ein deutscher satz"), ("en", "an english sentence"), ("en", "the same text"),
                                       ("fr", "une phrase")]


def test_capitals_of_every_language_count():
    f = lambda t: toxicity.features(t, {}, frozenset(), frozenset())[13]
    for t, n in [("ÉÜA", 3), ("×é÷aa", 0), ("Ñandú", 1), ("", 0)]:
        assert f(t) == pytest.approx(n / max(1, len(t.encode()))), t


def test_second_person_proximity():
    f = lambda t: toxicity.features(t, {}, frozenset(toxicity.INSULTS), frozenset(toxicity.SECOND_PERSON))
    assert f("you are an idiot")[8] == 1 and f("an idiot " + "x " * 30 + "you")[8] == 0 and f("an idiot")[8] == 0
    assert f("such an 1d1ot here")[10] == 0 and f("such an id1ot here")[10] == 1


def test_quality_held_out(docs, labels, odd, none):
    keep = fold(F.col("doc_id"), 4) != 2
    model = quality.train(docs, labels, keep)
    got = quality.score(docs, model).join(labels, "doc_id").where(~keep).collect()
    assert auc([r.quality for r in got], [r.score for r in got]) > 0.95
    assert len(quality.score(odd, model).collect()) == odd.count()
    assert quality.score(none, model).collect() == []


def brute(ids, v, k):
    u = v / np.linalg.norm(v, axis=1, keepdims=True)
    out = {}
    for i in range(len(ids)):
        if ids[i] % 50 == 0:
            s = np.round(u @ u[i], 12)
            order = [j for j in np.lexsort((ids, -s)) if ids[j] != ids[i]][:k]
            out[int(ids[i])] = [int(ids[j]) for j in order]
    return out


def test_neighbours_recall_scores_and_copies(spark):
    rng = np.random.default_rng(4)
    centre = rng.normal(size=(12, 24))
    v = centre[rng.integers(0, 12, 3000)] + 0.6 * rng.normal(size=(3000, 24))
    v[::3] = v[0]  # a third of the table is one vector
    v = v.astype(np.float32)
    df = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "vec_id long, embedding array<float>")
    got = {}
    for r in ann.nearest(df, F.col("vec_id") % 50 == 0).collect():
        got.setdefault(r.query_id, {})[r["rank"]] = (r.vec_id, r.score)
    want = brute(np.arange(3000), v.astype(float), 5)
    hits = [len({got[q][n][0] for n in range(1, 6)} & set(w)) for q, w in want.items()]
    assert np.mean(hits) / 5 >= 0.9
    assert [got[0][n][0] for n in range(1, 6)] == [3, 6, 9, 12, 15]
    for q, near in got.items():
        for i, s in near.values():
            a, b = v[q].astype(float), v[i].astype(float)
            assert s == pytest.approx(a @ b / np.sqrt((a @ a) * (b @ b)), abs=1e-12)


def test_neighbours_of_odd_rows(spark):
    inf, nan = float("inf"), float("nan")
    rows = [(0, [1.0, 0.0]), (1, [2.0, 0.0]), (2, [0.0, 1.0]), (3, None), (4, [0.0, 0.0]), (5, [1.0, None]),
            (6, [nan, 1.0]), (7, [inf, 1.0]), (8, []), (9, [1.0, 1.0, 1.0]), (None, [1.0, 0.1]), (50, [1.0, 0.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("list", F.lit("extra"))
    got = [(r.query_id, r["rank"], r.vec_id, round(r.score, 6)) for r in ann.nearest(df, F.col("vec_id") % 50 == 0).collect()]
    assert sorted(got) == [(0, 1, 1, 1.0), (0, 2, 50, 1.0), (0, 3, 2, 0.0), (50, 1, 0, 1.0), (50, 2, 1, 1.0), (50, 3, 2, 0.0)]
    assert ann.nearest(df.where("false"), F.col("vec_id") % 50 == 0).collect() == []


def test_cosines_of_extreme_components(spark):
    rows = [(0, [1e200, 2e200]), (1, [2e-200, 4e-200]), (2, [1e300, -1e300]), (3, [3.0, 1.0]), (4, [5e-324, 0.0]), (5, [1e308, 1e308])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = {r.vec_id: r.score for r in ann.nearest(df, F.col("vec_id") == 0).collect()}
    unit = {i: np.array(v) / np.abs(v).max() for i, v in rows}
    for i in range(1, 6):
        a, b = unit[0], unit[i]
        assert got[i] == pytest.approx(a @ b / np.sqrt((a @ a) * (b @ b)), abs=1e-15)


def test_scan_abandons_only_what_the_bound_allows():
    rng = np.random.default_rng(5)
    x = ann.units(rng.normal(size=(2500, 48))) @ ann.rotation(48)
    q = x[7]
    at = ann.scan(q, [x[:, i:i + 16] for i in range(0, 48, 16)], np.inf, 6)
    near = np.argsort(((x - q) ** 2).sum(axis=1))[:6]
    assert len(set(near) & set(at)) >= 5 and 7 in at
