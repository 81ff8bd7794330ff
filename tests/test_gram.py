"""Blocked pair sums and the randomised projection against numpy and pandas."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from barline.operators import gram, portfolio, regimes


def returns(symbols, steps, seed=1, groups=1):
    rng = np.random.default_rng(seed)
    common = rng.normal(size=steps)
    x = 5 + common[:, None] * rng.uniform(0.2, 1, symbols) + rng.normal(size=(steps, symbols))
    x[rng.random(x.shape) < 0.2] = np.nan
    x[:, 0] = 7.25  # a constant
    return pd.DataFrame([(f"g{t % groups}", t, f"s{i:02d}", None if np.isnan(v) else float(v)) for t, row in enumerate(x) for i, v in enumerate(row)],
                        columns=["g", "ts", "symbol", "ret"])


@pytest.mark.parametrize("tile, open_tiles", [(64, 512), (3, 2)])
def test_pairs_equal_those_of_pandas(spark, monkeypatch, tile, open_tiles):
    monkeypatch.setattr(gram, "TILE", tile)
    monkeypatch.setattr(gram, "OPEN_TILES", open_tiles)
    pdf = returns(11, 60, groups=2)
    df = spark.createDataFrame(pdf, "g string, ts long, symbol string, ret double").repartition(5)
    got = {(r.g, r.a, r.b): (r["cov"], r["rows"]) for r in portfolio.cov_pairs(df, "g").collect()}
    for g, part in pdf.groupby("g"):
        wide = part.pivot(index="ts", columns="symbol", values="ret").astype(float)
        want, n = wide.cov(min_periods=2), wide.notna().astype(int).T @ wide.notna().astype(int)
        for i, a in enumerate(wide.columns):
            for b in wide.columns[i:]:
                cov, rows = got.pop((g, a, b))
                assert rows == n.loc[a, b] and cov == pytest.approx(want.loc[a, b], abs=1e-9)
    assert not got
    corr = {(r.a, r.b): r["corr"] for r in regimes.corr_matrix(df).collect()}
    want = pdf.pivot(index="ts", columns="symbol", values="ret").astype(float).corr().fillna(0.0)
    assert len(corr) == 55
    for (a, b), c in corr.items():
        assert c == pytest.approx(0.0 if "s00" in (a, b) else want.loc[a, b], abs=1e-9)


def test_pair_sums_shuffle_no_pairs_of_a_time_step(spark):
    df = spark.createDataFrame(returns(6, 30), "g string, ts long, symbol string, ret double")
    text = regimes.corr_matrix(df)._jdf.queryExecution().executedPlan().toString()
    assert "MapInArrow" in text and "ts#" not in "".join(x for x in text.split("\n") if "Join" in x)
    assert regimes.corr_matrix(df.where("false")).collect() == []


def distances(x):
    return np.sqrt(((x[:, None] - x[None]) ** 2).sum(axis=2))


@pytest.mark.parametrize("rows, columns", [(30, 15), (40, 300)])
def test_scores_are_those_of_the_principal_components(spark, rows, columns):
    rng = np.random.default_rng(columns)
    a = rng.normal(size=(rows, 2)) @ (5 * rng.normal(size=(2, columns))) + 0.3 * rng.normal(size=(rows, columns)) + 2
    a[rng.random(a.shape) < 0.02] = 0  # missing cells
    cells = spark.createDataFrame([(i, f"c{j}", float(v)) for i, r in enumerate(a) for j, v in enumerate(r) if v], "row long, column string, x double")
    got = np.array([r.features.toArray() for r in regimes.principal_scores(cells).orderBy("row").collect()])
    c = a - a.mean(axis=0)
    u, s, _ = np.linalg.svd(c, full_matrices=False)
    assert np.allclose(distances(got), distances(u[:, :2] * s[:2]), rtol=1e-4, atol=1e-3)


def test_clusters_of_many_symbols(spark):
    rng = np.random.default_rng(2)
    names = [f"s{i:02d}" for i in range(40)]
    level = [0.8, 0.2, 0.6, 0.05]
    rows = [(b, names[i], names[j], float(np.clip(level[b % 4] + 0.02 * rng.normal(), -1, 1)))
            for b in range(24) for i in range(40) for j in range(i + 1, 40)]
    df = spark.createDataFrame(rows, "bucket long, a string, b string, corr double")
    out = regimes.regime_clusters(df.unionByName(df.limit(5).withColumn("a", F.lit("other"))), names, k=4).collect()
    assert len(out) == 24 and len({(r.bucket % 4, r.cluster) for r in out}) == 4
    assert {(r.bucket % 4, r.regime) for r in out} == {
        (0, "crisis"), (1, "low_vol_mean_reverting"), (2, "high_vol_trending"), (3, "neutral")}
