"""Fits: full size of the registered ones, early stopping, search by halving, stored models."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from barline.catalog import models as queries
from barline.operators import fits, folds, models

SF = "/root/testdata/sf0.001"


def test_walk_forward_fit_takes_every_window(spark, monkeypatch):
    seen = []

    def fit(members, names, **params):
        seen.append(params)
        return members.filter("role = 'OOS'").withColumn("predicted", F.lit(0))
    monkeypatch.setattr(models, "walk_forward_fit", fit)
    got = {(r.symbol, r.window_id) for r in queries.walk_forward_fit(spark, SF).collect()}
    want = folds.walk_forward(queries.training_rows(spark, SF)).collect()
    assert seen == [{}] and got == {(r.symbol, r.window_id) for r in want} and len(want) > 0


class Stop(Exception):
    pass


def test_fits_have_the_operators_full_size(spark, monkeypatch):
    seen = []

    def fit(train, label="label", **params):
        seen.append(params)
        raise Stop

    def stack(rows, names, bases, **params):
        seen.append({p: bases["trees"].getOrDefault(p) for p in ("maxIter", "maxDepth")})
        raise Stop
    monkeypatch.setattr(fits, "boosted", fit)
    monkeypatch.setattr(fits, "PARALLEL", 1)
    monkeypatch.setattr(models, "oof_stack", stack)
    monkeypatch.setattr("barline.sources.stored._PATHS", {k: v for k, v in __import__("barline.sources.stored", fromlist=["x"])._PATHS.items()
                                                          if k[2] not in ("pooled-fit", "stack")})
    for query in (queries.gbt_train, queries.score_rows, queries.gbt_importance, queries.purged_cv_score,
                  queries.walk_forward_fit, queries.oof_stack, queries.meta_importance):
        before = len(seen)
        with pytest.raises(Stop):
            query(spark, SF)
        assert len(seen) > before and all(s in ({}, {"stop": True}, {"maxIter": 50, "maxDepth": 6}) for s in seen[before:])


def series_rows(spark, n=600, symbols=("A", "B"), noise=False, seed=3):
    """Two features; the label follows the first one, or nothing."""
    rng = np.random.default_rng(seed)
    rows = []
    for s in symbols:
        x = rng.normal(size=(n, 2))
        y = rng.integers(0, 2, n) if noise else (x[:, 0] + 0.3 * rng.normal(size=n) > 0).astype(int)
        rows += [(s, f"{i:05d}", i, n, float(a), float(b), int(c)) for i, ((a, b), c) in enumerate(zip(x, y))]
    return spark.createDataFrame(rows, "symbol string, ts string, rn long, n long, x double, y double, label int")


def test_early_stopping_cuts_rounds_on_noise_and_loses_nothing(spark):
    rows = series_rows(spark, noise=True)
    groups = models.split_groups(rows, ["x", "y"])
    train = groups.part(0).where("_train")
    full = fits.boosted(train.where(~F.col(fits.LATE)), trees=20, depth=3)
    cut = fits.boosted(train, trees=20, depth=3, stop=True)
    assert cut.getNumTrees < 20 == full.getNumTrees
    late = train.where(fits.LATE)
    loss = lambda m: m.evaluateEachIteration(late)[-1]
    assert loss(cut) <= loss(full) + 1e-9


def test_halving_keeps_the_best_and_fits_the_last_rung_in_full(spark):
    rows = series_rows(spark)
    choices = [{"trees": 6, "depth": 1 + i % 2, "rate": 0.001 if i else 0.3, "minInstancesPerNode": 1 + i} for i in range(7)]
    found = [r.asDict() for r in models.param_search(rows, ["x", "y"], choices, keep=2, first_trees=1).collect()]
    by = {r: [x for x in found if x["rung"] == r] for r in {x["rung"] for x in found}}
    assert {r: (len(v), sum(x["survives"] for x in v)) for r, v in by.items()} == {0: (7, 4), 1: (4, 2), 2: (2, 1)}
    assert {x["trees"] for x in by[0]} == {1} and {x["trees"] for x in by[1]} == {2} and {x["trees"] for x in by[2]} == {6}
    for v in by.values():
        assert min(x["accuracy"] for x in v if x["survives"]) >= max(x["accuracy"] for x in v if not x["survives"])
    assert found[0]["rung"] == 2 and found[0]["survives"]
    assert fits.drawn(30) == fits.drawn(30) and all(len(c) == 9 for c in fits.drawn(30))
    assert fits.rungs(27) == [(27, 2), (9, 6), (3, None)] and fits.rungs(2) == [(2, None)]


def test_models_per_symbol_are_stored_and_found_again(spark, tmp_path):
    rows = series_rows(spark).unionByName(series_rows(spark, 60, ("C",)).withColumn("label", F.lit(1)))
    rows = rows.withColumn("x", F.when(F.col("rn") % 50 > 0, F.col("x")))  # gaps are filled with the symbol's own mean
    fitted, scores = models.gbt_train_each(rows, ["x", "y"], trees=5, depth=2)
    assert set(fitted) == {"A", "B", "C"} and fitted["C"] is None
    assert {r.symbol: r["count"] for r in scores.groupBy("symbol").count().collect()} == {"A": 120, "B": 120, "C": 12}
    assert {r.predicted for r in scores.where("symbol = 'C'").collect()} == {1}
    root = str(tmp_path)
    models.save_models(spark, root, "v1", {"A": fitted["B"], "B": fitted["B"]}, scores)
    models.save_models(spark, root, "v2", fitted, scores)
    assert models.model_versions(spark, root).count() == 4
    newest = {r.symbol: r for r in models.latest_model(models.model_versions(spark, root)).collect()}
    assert {s: (r.version, r.rows) for s, r in newest.items()} == {"A": ("v2", 120), "B": ("v2", 120)}
    held = rows.where("rn >= floor(n * 0.8)")
    again = {(r.symbol, r.ts): r.probability_up for r in models.score_newest(spark, root, held, ["x", "y"]).collect()}
    assert len(again) == 240
    for r in scores.where("symbol <> 'C'").collect():
        assert again[r.symbol, r.ts] == pytest.approx(r.probability_up, abs=1e-12)


def test_a_changed_source_is_built_anew(spark, tmp_path):
    from barline.sources.stored import stored
    spark.range(3).write.parquet(str(tmp_path / "t.parquet"))
    read = lambda: spark.read.parquet(str(tmp_path / "t.parquet"))
    assert stored(spark, str(tmp_path), "copy", read).count() == 3
    spark.range(5).write.mode("overwrite").parquet(str(tmp_path / "t.parquet"))
    assert stored(spark, str(tmp_path), "copy", read).count() == 5



def test_rankings_of_fits_per_symbol(spark):
    """The feature that the label follows comes first for every symbol and over all of them."""
    fitted, _ = models.gbt_train_each(series_rows(spark, 300), ["y", "x"], trees=3, depth=2)
    per = models.symbol_rankings(fitted | {"none": None}, ["y", "x"], spark)
    rows = {(r.symbol, r["rank"]): r for r in per.collect()}
    assert set(rows) == {(s, k) for s in "AB" for k in (1, 2)}
    assert all(rows[s, 1].feature == "x" and abs(rows[s, 1].importance + rows[s, 2].importance - 1) < 1e-9 for s in "AB")
    over = {r.feature: r for r in models.rank_indicators(per).collect()}
    assert over["x"]["rank"] == over["x"].mean_rank == 1 and over["y"].symbols == 2
