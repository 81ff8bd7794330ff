"""Hand-worked values (FIXTURES.md, part C) and invariants."""

import datetime as dt
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from barline.functions import norm_cdf, norm_ppf, timeframe_seconds
from barline.operators import (
    align, cost, features, ffd, folds, indicators as ind, labels, monitoring, portfolio, quality,
    risk, scores, stats, tables,
)
from conftest import make_bars


@pytest.fixture(scope="module")
def rise(spark):
    """Ten rows: open 100+i, high 102+i, low 98+i, close 101+i."""
    rows = [("AAPL", dt.datetime(2024, 1, 1) + dt.timedelta(days=i), 100.0 + i, 102.0 + i, 98.0 + i,
             101.0 + i, 1_000_000) for i in range(10)]
    return spark.createDataFrame(rows, "symbol string, ts timestamp, open double, high double, "
                                       "low double, close double, volume bigint").cache()


def col(df, name):
    return [r[name] for r in df.orderBy("ts").collect()]


def test_rise_indicators(rise):
    assert col(ind.atr(rise, 5), "atr") == [None] * 4 + [4.0] * 6
    assert col(ind.atr(rise, 14), "atr") == [None] * 10
    assert col(ind.rsi(rise, 14), "rsi_14") == [50.0] * 10
    ema = col(ind.ema(rise, 9), "ema_9")
    assert ema[:3] == pytest.approx([101, 101.2, 101.56]) and ema[-1] == pytest.approx(106.536870912)
    assert col(ind.obv(rise), "obv") == [i * 1e6 for i in range(10)]
    dev = col(ind.vwap_dev(rise), "vwap_dev")
    assert dev[0] == pytest.approx(0.664451827) and dev[-1] == pytest.approx(4.928457870)
    assert col(ind.stochastic(rise), "stoch_k") == [50.0] * 10
    assert col(ind.williams_r(rise), "williams_r") == [-50.0] * 10


def test_rise_labels(rise):
    assert col(labels.binary_label(rise), "label") == [1] * 5 + [-1] * 5
    assert col(labels.npmm_label(rise), "npmm_label") == [0] * 10
    assert features.ml_features(rise).count() == 0


def test_feature_names():
    assert len(features.feature_names()) == 70
    top = features.select_top_features(features.feature_names(), 45)
    assert len(top) == len(set(top)) == 45 and top[0] == "squeeze_pro"


def test_constant_series(spark):
    bars = make_bars(spark, {"K": [50.0] * 300}, high=lambda c: c, low=lambda c: c)
    z = features.ml_features(bars, ffd=False).toPandas()
    assert (z["rsi"] == 50).all() and (z["roc_12"] == 0).all() and (z["obv"] == 0).all()
    for c in ("rsi", "roc_12", "stoch_k", "bb_pct_b", "volume_ratio"):
        assert (z[f"{c}_zscore"] == 0).all()
    assert z["macd"].abs().max() < 1e-9 and z["ppo"].abs().max() < 1e-9
    assert (z["stoch_k"] == 50).all() and (z["williams_r"] == -50).all() and (z["bb_pct_b"] == .5).all()


def test_indicator_invariants(spark):
    rng = np.random.default_rng(1)
    bars = make_bars(spark, {"R": 100 + np.cumsum(rng.normal(0, 1, 400))})
    z = features.all_indicators(bars).toPandas()
    assert z["rsi"].between(0, 100).all() and z["stoch_k"].between(0, 100).all()
    full = z.dropna(subset=["bb_lower"])
    assert ((full["bb_lower"] <= full["bb_middle"]) & (full["bb_middle"] <= full["bb_upper"])).all()
    assert (z["obv"].diff().dropna().abs().isin([0, 1_000_000])).all()


def test_triple_barrier_paths(spark):
    bars = make_bars(spark, {"a": [100, 100.2, 103], "b": [100, 101, 103], "c": [100, 99.2, 98.9],
                             "d": [100]})
    out = labels.triple_barrier(spark, bars)
    first = {r["symbol"]: r["label"] for r in out.filter("ts = '2000-01-01'").collect()}
    assert first == {"a": 0, "b": 1, "c": -1, "d": 0}


def test_ffd_weights():
    w = ffd.ffd_weights(0.5)
    assert w[:4].tolist() == [1, -0.5, -0.125, -0.0625] and len(w) == 927
    assert len(ffd.ffd_weights(0.8)) == 228


def _numbered(spark, n):
    return spark.range(n).select(F.lit("s").alias("symbol"), F.timestamp_seconds(F.col("id") * 86400)
                                 .alias("ts"), F.col("id").alias("rn"), F.lit(n).cast("bigint").alias("n"))


def test_walk_forward(spark):
    w = [tuple(r)[2:] for r in folds.walk_forward(_numbered(spark, 735)).orderBy("window_id").collect()]
    assert w == [(0, 504, 504, 630), (63, 567, 567, 693)]
    assert folds.walk_forward(_numbered(spark, 630)).count() == 0


@pytest.mark.parametrize("gap,expanding", [(0, False), (7, False), (3, True)])
def test_window_membership_matches_bounds(spark, gap, expanding):
    df = _numbered(spark, 1000)
    got = {(r["rn"], r["window_id"], r["role"]) for r in
           folds.window_membership(df, gap=gap, expanding=expanding).collect()}
    want = set()
    for r in folds.walk_forward(df, gap=gap, expanding=expanding).collect():
        want |= {(i, r["window_id"], "IS") for i in range(r["is_start"], r["is_end"])}
        want |= {(i, r["window_id"], "OOS") for i in range(r["oos_start"], r["oos_end"])}
    assert got == want


def test_purged_folds_are_disjoint(spark):
    df = _numbered(spark, 200).withColumn("t1", F.expr("ts + INTERVAL '5' DAY"))
    rows = folds.purged_kfold(df, k=4, embargo=0.02).toPandas()
    assert not (rows["is_train"] & rows["is_test"]).any()
    day = rows["ts"].dt.normalize().astype("int64")
    for _, f in rows.assign(day=day).groupby("fold"):
        gap = 86400 * 10 ** 6 if f["day"].max() < 10 ** 17 else 86400 * 10 ** 9
        test = f[f["is_test"]]["day"]
        train = f[f["is_train"]]["day"]
        assert ((train < test.min() - 3 * gap) | (train > test.max() + 3 * gap)).all()


def test_return_statistics(spark):
    df = spark.createDataFrame([("s", x) for x in (.01, -.02, .03, 0., .01)], "k string, ret double")
    r = stats.sharpe(df, ["k"]).first()
    assert r["sharpe"] == pytest.approx(5.243177385)
    m = stats.return_moments(df, ["k"]).first()
    assert m["skew"] == pytest.approx(-0.128112147) and m["kurtosis"] == pytest.approx(1.451900826)
    assert stats.psr(df, ["k"]).first()["psr"] == pytest.approx(0.734660792)
    assert stats.dsr(df, ["k"]).first()["dsr"] is None  # a single trial
    flat = spark.createDataFrame([("s", .1)] * 9, "k string, ret double")
    assert stats.sharpe(flat, ["k"]).first()["sharpe"] == 0.0


def test_normal_functions(spark):
    x = [-40., -8., -3.3, -1., 0., .5, 1.96, 6., 8.]
    df = spark.createDataFrame([(v,) for v in x], "x double")
    for r in df.select("x", norm_cdf("x").alias("p")).collect():
        want = 0.5 * math.erfc(-r["x"] / math.sqrt(2))
        assert r["p"] == pytest.approx(want, rel=1e-7, abs=1e-14)
    q = spark.createDataFrame([(p,) for p in (1e-9, .01, .3, .5, .8, .999, 1 - 1e-9)], "p double")
    for r in q.withColumn("x", norm_ppf("p")).withColumn("b", norm_cdf("x")).collect():
        assert r["b"] == pytest.approx(r["p"], rel=1e-9)
    assert spark.createDataFrame([(1.0,)], "p double").select(norm_ppf("p")).first()[0] is None


def _sample(spark, values):
    return spark.createDataFrame([("f", float(v)) for v in values], "feature string, value double")


def test_psi_and_ks(spark):
    a, b = _sample(spark, range(10)), _sample(spark, range(5, 15))
    assert monitoring.psi(a, b).first()["psi"] == pytest.approx(5.756405168)
    assert monitoring.psi(a, a).first()["psi"] == 0.0
    ks = monitoring.ks_test(spark, _sample(spark, [1, 2, 3]), _sample(spark, [2, 3, 4])).first()
    assert ks["ks_statistic"] == pytest.approx(1 / 3)


def test_ks_over_ranges(spark):
    rng = np.random.default_rng(5)
    x, y = np.round(rng.normal(0, 1, 900), 2), np.round(rng.normal(.2, 1, 700), 2)
    got = monitoring.ks_test(spark, _sample(spark, x), _sample(spark, y)).first()
    grid = np.unique(np.concatenate([x, y]))
    want = max(abs((x <= g).mean() - (y <= g).mean()) for g in grid)
    assert got["ks_statistic"] == pytest.approx(want)


def test_pbo(spark):
    rng = np.random.default_rng(2)
    m = rng.normal(0, 1, (64, 5))
    rows = [(dt.datetime(2020, 1, 1) + dt.timedelta(days=t), f"t{j}", float(m[t, j]))
            for t in range(64) for j in range(5)]
    df = spark.createDataFrame(rows, "ts timestamp, trial string, ret double")
    got = stats.pbo(spark, df, parts=4, limit=100).first()
    import itertools
    seg, hit = np.array_split(m, 4), []
    for c in itertools.combinations(range(4), 2):
        sr = lambda ids: np.vstack([seg[i] for i in ids]).mean(0) / np.vstack([seg[i] for i in ids]).std(0, ddof=1)
        a, z = sr(c), sr([i for i in range(4) if i not in c])
        hit.append((z < z[a.argmax()]).mean() < .5)
    assert got["splits"] == 6 and got["pbo"] == pytest.approx(np.mean(hit))


def test_sizing(spark):
    df = spark.createDataFrame([(100., 98., 104., 1e5, .6)],
                               "entry double, stop double, target double, capital double, win_probability double")
    k = risk.kelly_size(df).first()
    assert k["kelly_fraction"] == pytest.approx(.4) and k["edge"] == pytest.approx(.8)
    assert k["fraction"] == pytest.approx(.10) and k["position_size"] == 100
    assert df.select(risk.fixed_fraction_size().alias("s")).first()["s"] == 100


def test_order_cost(spark):
    df = spark.createDataFrame([(1000., 50., 1e6, .5, "market")],
                               "size double, price double, adv double, urgency double, order_type string")
    c = cost.order_cost(df).first()
    assert [c[k] for k in ("commission", "spread_cost", "market_impact", "slippage", "total_cost")] == \
        pytest.approx([50, 12.5, 118.585412256, 240.811388301, 421.896800557])


def test_schedules_sum_to_order(spark):
    o = spark.createDataFrame([("s", 1000.)], "symbol string, size double")
    assert cost.twap_schedule(o).agg(F.sum("shares")).first()[0] == pytest.approx(1000)
    prof = spark.createDataFrame([("s", i, float(v)) for i, v in enumerate([5, 1, 9])],
                                 "symbol string, idx bigint, volume double")
    assert cost.vwap_schedule(o, prof).agg(F.sum("shares")).first()[0] == pytest.approx(1000)
    ac = cost.ac_schedule(o).orderBy("step").toPandas()["shares"]
    assert (ac >= 0).all() and ac[1] > ac[300] > 0


def test_scores(spark):
    df = spark.createDataFrame([(.5, .4, .2, "neutral")],
                               "technical_score double, sentiment_score double, fundamental_score double, regime string")
    c = scores.confluence(df).first()
    assert c["confluence_score"] == pytest.approx(.39) and c["direction"] == "long"
    assert c["confidence"] == pytest.approx(.615)
    s = spark.createDataFrame([("x", .8, .9, "bullish"), ("x", -.2, .3, "neutral"), ("x", 0., 0., "neutral")],
                              "symbol string, score double, confidence double, classification string")
    a = scores.sentiment_agg(s, ["symbol"]).first()
    assert a["aggregated_score"] == pytest.approx(.55) and a["confidence"] == pytest.approx(.4)


def test_sentiment_fallbacks(spark):
    text = ['Sure: {"sentiment": 1.7, "confidence": 0.9, "classification": "mixed"} ok',
            '{"sentiment": -3.5, "confidence": 0.2, "reas', "Slightly BEARISH, -0.4 maybe", "nothing here"]
    df = spark.createDataFrame(list(enumerate(text)), "id int, response string")
    r = scores.parse_sentiment(df).orderBy("id").collect()
    assert [x["score"] for x in r] == [1.7, -1.0, -0.4, 0.0]
    assert [x["confidence"] for x in r] == [0.9, 0.2, 0.5, 0.5]
    assert [x["classification"] for x in r] == ["bullish", "neutral", "bearish", "neutral"]


def test_breaker(spark):
    t0 = dt.datetime(2024, 1, 1)
    rows = [("five", t0 + dt.timedelta(seconds=10 * i), i, "error", None) for i in range(5)]
    rows += [("two", t0 + dt.timedelta(seconds=10 * i), i, "error", None) for i in range(2)]
    rows += [("two", t0 + dt.timedelta(hours=5), 9, "other", None)]
    log = spark.createDataFrame(rows, "symbol string, ts timestamp, id bigint, kind string, pnl double")
    last = {r["symbol"]: r["level"] for r in risk.breaker_level(log).orderBy("ts").collect()}
    assert last == {"five": "hard_halt", "two": "warn"}


def test_upsert(spark):
    t = dt.datetime(2024, 1, 1)
    ddl = ("symbol string, ts timestamp, open double, high double, low double, close double, volume bigint, "
           "vwap double, trade_count int")
    old = spark.createDataFrame([("A", t, 9., 10., 8., 9., 5, 9.5, 3)], ddl)
    new = spark.createDataFrame([("A", t, 10., 12., 9., 11., 7, None, None), ("B", t, 1., 1., 1., 1., 1, 1., 1)], ddl)
    out = {r["symbol"]: r for r in tables.upsert_bars(old, new).collect()}
    assert len(out) == 2 and out["A"]["close"] == 11 and out["A"]["vwap"] == 9.5
    assert out["A"]["trade_count"] == 3 and out["B"]["vwap"] == 1


def test_clean_keys(spark):
    raw = spark.createDataFrame([("AAPL", "2024-01-15"), ("msft", "2024-01-15T10:00:00"), ("", "2024-01-15"),
                                 ("AAPL123", "2024-01-15"), ("aa-pl", "2024-01-15"), ("BRK.B", "invalid-date"),
                                 ("X", "86400")], "symbol string, ts string")
    got = [(r["clean_symbol"], r["reason"]) for r in quality.clean_keys(raw).collect()]
    assert got == [("AAPL", None), ("MSFT", None), ("", "empty symbol"), ("AAPL123", "bad symbol"),
                   ("AA-PL", "bad symbol"), ("BRK.B", "bad timestamp"), ("X", None)]


def test_validate_bars(spark, rise):
    assert all(r["violations"] == 0 for r in quality.validate_bars(rise).collect())
    assert quality.check_schema(rise) == [] and quality.check_schema(rise.drop("close")) == ["missing close"]


def test_asof_join(spark):
    rng = np.random.default_rng(9)
    t0 = dt.datetime(2024, 1, 1)
    lt = sorted(rng.integers(0, 10 ** 6, 300).tolist())
    rt = sorted(rng.integers(0, 10 ** 6, 40).tolist())
    left = spark.createDataFrame([("k", t0 + dt.timedelta(seconds=x)) for x in lt], "symbol string, ts timestamp")
    right = spark.createDataFrame([("k", t0 + dt.timedelta(seconds=x), float(i)) for i, x in enumerate(rt)],
                                  "symbol string, ts timestamp, v double")
    got = [r["v"] for r in align.asof_join(left, right, "v", bucket_seconds=20000).orderBy("ts").collect()]
    want = [float(np.searchsorted(rt, x, "right") - 1) if x >= rt[0] else None for x in lt]
    assert got == want


def test_weight_methods():
    rng = np.random.default_rng(4)
    x = rng.normal(0, 1, (300, 8)) * np.linspace(.5, 2, 8)
    cov, mu = np.cov(x.T), rng.normal(0, .1, 8)
    for w in (portfolio.mean_variance(mu, cov, 1.0, 0, .2), portfolio.risk_parity(cov, 0, .5),
              portfolio.hierarchical(cov, 0, 1)):
        assert w.sum() == pytest.approx(1) and (w >= -1e-12).all()
    w = portfolio.risk_parity(cov, 0, 1)
    rc = w * (cov @ w)
    assert rc.max() / rc.min() == pytest.approx(1, abs=1e-6)
    v = portfolio.mean_variance(np.zeros(8), cov, 1.0, 0, 1)
    grid = rng.dirichlet(np.ones(8), 4000)
    assert v @ cov @ v <= np.einsum("ij,jk,ik->i", grid, cov, grid).min() + 1e-9


def test_weight_sweep_infeasible_is_equal(spark):
    cov = spark.createDataFrame([(1, "a", "a", 1.), (1, "a", "b", 0.), (1, "b", "b", 2.)],
                                "g int, a string, b string, cov double")
    mu = spark.createDataFrame([(1, "a", .1), (1, "b", .2)], "g int, symbol string, expected_return double")
    assert {r["weight"] for r in portfolio.weight_sweep(cov, mu, "g").collect()} == {.5}


def test_half_life(spark):
    rng, x = np.random.default_rng(0), [0.0]
    for e in rng.normal(0, 1, 4000):
        x.append(.5 * x[-1] + e)
    rows = [("s", 1, dt.datetime(2000, 1, 1) + dt.timedelta(days=i), i, float(v)) for i, v in enumerate(x)]
    df = spark.createDataFrame(rows, "signal string, horizon int, ts timestamp, rn bigint, ic double")
    r = monitoring.ic_half_life(df, block_rows=500).first()
    want = np.corrcoef(x[:-1], x[1:])[0, 1]
    assert r["autocorrelation"] == pytest.approx(want) and r["half_life"] == pytest.approx(-math.log(2) / math.log(want))


def test_timeframes():
    assert [timeframe_seconds(t) for t in ("1Day", "4Hour", "15Min", "1min")] == [86400, 14400, 900, 60]
    assert tables.lookback_days(252, "15Min") == 3
    with pytest.raises(ValueError):
        timeframe_seconds("1Fortnight")


def test_upsert_replaces_touched_days_only(spark, tmp_path):
    t = [dt.datetime(2024, 1, d, 10) for d in (1, 2, 3)]
    ddl = ("symbol string, ts timestamp, open double, high double, low double, close double, volume bigint, "
           "vwap double, trade_count int")
    path = str(tmp_path / "bars")
    old = spark.createDataFrame([("A", x, 9., 10., 8., 9., 5, 9.5, 3) for x in t], ddl)
    old.withColumn("date", F.to_date("ts")).write.partitionBy("date").parquet(path)
    before = {p: p.stat().st_mtime_ns for p in (tmp_path / "bars" / "date=2024-01-01").glob("*.parquet")}
    fresh = spark.createDataFrame([("A", t[1], 1., 1., 1., 1., 1, 0., 0), ("B", t[1], 2., 2., 2., 2., 2, 2., 2)], ddl)
    tables.upsert_partitions(spark, path, fresh)
    rows = {(r["symbol"], r["ts"].day): r for r in spark.read.parquet(path).collect()}
    assert len(rows) == 4 and rows["A", 2]["close"] == 1 and rows["A", 2]["vwap"] == 9.5
    after = {p: p.stat().st_mtime_ns for p in (tmp_path / "bars" / "date=2024-01-01").glob("*.parquet")}
    assert before == after
