"""Operators cut into small blocks give what the whole series gives, checked with pandas."""

import datetime as dt

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from barline.operators import features
from barline.operators import ffd as ffd_ops
from barline.operators import indicators as ind
from barline.operators import labels, risk, stats
from barline.operators.ewm import Ewm, add_ewm, ewm_halo
from barline.plans.series import core_rows, in_blocks, number_rows, running
from conftest import by_symbol, make_bars, series

BLOCK = 700


def close(got, want, tol=1e-9):
    got, want = np.asarray(got, float), np.asarray(want, float)
    assert got.shape == want.shape
    assert np.array_equal(np.isnan(got), np.isnan(want))
    ok = ~np.isnan(got)
    assert np.allclose(got[ok], want[ok], rtol=tol, atol=tol)


def test_positions(walk):
    df, closes = walk
    n = number_rows(df, bucket_seconds=20 * 86400, with_total=True)
    got = by_symbol(n, "rn", "n")
    for s, c in closes.items():
        assert (got[s][:, 0] == np.arange(len(c))).all() and (got[s][:, 1] == len(c)).all()


@pytest.mark.parametrize("alpha", [2 / 3, 2 / 7, 2 / 27, 1 / 14, 1 / 63, 2 / 201, 1.0])
def test_ewm(walk, alpha):
    df, closes = walk
    b = in_blocks(df, ewm_halo(alpha), block_rows=BLOCK)
    got = by_symbol(core_rows(add_ewm(b, {"e": Ewm(F.col("close"), alpha)})), "e")
    for s, c in closes.items():
        close(got[s][:, 0], series(c).ewm(alpha=alpha, adjust=False).mean(), 1e-12)


def test_ewm_start(walk):
    df, closes = walk
    b = in_blocks(df, ewm_halo(2 / 7) + 12, block_rows=BLOCK)
    b = b.withColumn("m", F.col("close") - ind.lagged("close", 12))
    got = by_symbol(core_rows(add_ewm(b, {"e": Ewm(F.col("m"), 2 / 7, start=12)})), "e")
    for s, c in closes.items():
        close(got[s][:, 0], series(c).diff(12).ewm(alpha=2 / 7, adjust=False).mean(), 1e-9)


def gaps(spark):
    """Random walks with runs of NULL closes: one of 3,000 rows, one at the start, short ones."""
    rng = np.random.default_rng(11)
    closes = {}
    for name, n, holes in (("A", 9000, [(4000, 7000)]), ("B", 6000, [(0, 2500), (2600, 2610), (3000, 5900)]), ("C", 400, [(0, 400)])):
        c = 100 + np.cumsum(rng.normal(0, 1, n))
        for a, b in holes:
            c[a:b] = np.nan
        closes[name] = c
    rows = [(s, dt.datetime(2000, 1, 1) + dt.timedelta(days=i), None if np.isnan(x) else float(x), 1.0)
            for s, c in closes.items() for i, x in enumerate(c)]
    df = spark.createDataFrame(rows, "symbol string, ts timestamp, close double, volume double")
    return df.withColumns({"open": F.col("close"), "high": F.col("close") + 1, "low": F.col("close") - 1}), closes


@pytest.mark.parametrize("block, numbered", [(700, False), (2048, True), (10 ** 6, False)])
def test_averages_over_long_gaps(spark, block, numbered):
    df, closes = gaps(spark)
    if numbered:
        df = number_rows(df, with_total=True, values="close")
    e = by_symbol(ind.ema(df, 9, 26, block_rows=block), "ema_9", "ema_26")
    m = by_symbol(ind.macd(df, block_rows=block), "macd", "macd_signal")
    k = by_symbol(ind.keltner(df, block_rows=block), "kc_middle")
    for s, c in closes.items():
        x, hole = series(c).ffill(), np.isnan(c)

        def avg(v, alpha):
            return v.ewm(alpha=alpha, adjust=False).mean().mask(hole)
        close(e[s][:, 0], avg(x, .2), 1e-9)
        close(e[s][:, 1], avg(x, 2 / 27), 1e-9)
        line = avg(x, 2 / 13) - avg(x, 2 / 27)
        close(m[s][:, 0], line, 1e-9)
        close(m[s][:, 1], avg(line.ffill(), .2), 1e-9)
        close(k[s][:, 0], avg(x, 2 / 21), 1e-9)


def test_all_indicators_over_long_gaps(spark):
    df, closes = gaps(spark)
    parts = by_symbol(features.all_indicators(df, block_rows=700), "ema_9", "macd", "macd_signal")
    for s, got in by_symbol(features.all_indicators(df, block_rows=10 ** 6), "ema_9", "macd", "macd_signal").items():
        close(parts[s], got, 1e-9)


def test_rolling(walk):
    df, closes = walk
    sma = by_symbol(ind.sma(df, 20, 200, block_rows=BLOCK), "sma_20", "sma_200")
    z = by_symbol(ind.zscore(df, "close", 252, block_rows=BLOCK), "close_zscore")
    for s, c in closes.items():
        x = series(c)
        close(sma[s][:, 0], x.rolling(20).mean())
        close(sma[s][:, 1], x.rolling(200).mean())
        want = ((x - x.rolling(252).mean()) / x.rolling(252).std()).fillna(0.0)
        close(z[s][:, 0], want, 1e-7)


def test_chained_averages(walk):
    df, closes = walk
    macd = by_symbol(ind.macd(df, block_rows=BLOCK), "macd", "macd_signal")
    adx = by_symbol(ind.adx(df, block_rows=BLOCK), "adx")
    whole = by_symbol(ind.adx(df, block_rows=10 ** 6), "adx")
    for s, c in closes.items():
        x = series(c)
        line = x.ewm(alpha=2 / 13, adjust=False).mean() - x.ewm(alpha=2 / 27, adjust=False).mean()
        close(macd[s][:, 0], line, 1e-9)
        close(macd[s][:, 1], line.ewm(alpha=.2, adjust=False).mean(), 1e-9)
        close(adx[s], whole[s], 1e-9)


def test_running_kinds(walk):
    df, closes = walk
    n = number_rows(df).withColumn("x", F.col("close") - F.lit(160.0))
    out = running(n, {"s": ("sum", F.col("x")), "hi": ("max", F.col("x")), "lo": ("min", F.col("x")),
                      "pk": ("peak", F.col("x")),
                      "since": ("since", F.abs(F.col("x")), F.col("x") > 3)}, block_rows=50)
    got = by_symbol(out, "s", "hi", "lo", "pk", "since")
    for s, c in closes.items():
        x = np.asarray(c) - 160.0
        cum = np.cumsum(x)
        close(got[s][:, 0], cum, 1e-8)
        close(got[s][:, 1], np.maximum.accumulate(x))
        close(got[s][:, 2], np.minimum.accumulate(x))
        close(got[s][:, 3], np.maximum.accumulate(cum), 1e-8)
        since, acc = [], 0.0
        for v in x:
            acc = 0.0 if v > 3 else acc + abs(v)
            since.append(acc)
        close(got[s][:, 4], since, 1e-6)


def test_obv_vwap(walk):
    df, closes = walk
    got = by_symbol(ind.with_obv_vwap(df, block_rows=BLOCK), "obv", "vwap_dev")
    for s, c in closes.items():
        c, v = np.asarray(c), np.array([100 + (i * 37) % 91 for i in range(len(c))], float)
        close(got[s][:, 0], np.cumsum(np.sign(np.diff(c, prepend=c[0])) * v))
        vw = np.cumsum(c * v) / np.cumsum(v)
        close(got[s][:, 1], (c - vw) / vw * 100, 1e-8)


def test_ffd_blocks(walk):
    df, closes = walk
    w = ffd_ops.ffd_weights(0.8)
    got = by_symbol(ffd_ops.ffd(df, ["close"], 0.8, block_rows=BLOCK), "close_ffd")
    for s, c in closes.items():
        want = np.full(len(c), np.nan)
        for i in range(len(w) - 1, len(c)):
            want[i] = np.dot(w, np.asarray(c)[i::-1][:len(w)])
        close(got[s][:, 0], want, 1e-8)


def test_optimal_d_blocks(walk):
    df, _ = walk
    a = ffd_ops.optimal_d(df, step=0.2, block_rows=BLOCK).orderBy("symbol").collect()
    b = ffd_ops.optimal_d(df, step=0.2, block_rows=10 ** 6).orderBy("symbol").collect()
    assert [tuple(r) for r in a] == [tuple(r) for r in b]


def test_triple_barrier_rounds(spark, walk):
    """A reach of 2 rows forces several rounds; the result must not change."""
    df, closes = walk
    got = by_symbol(labels.triple_barrier(spark, df, 0.05, 0.04, 0.0, reach=2, block_rows=BLOCK), "label")
    for s, c in closes.items():
        want = []
        for i in range(len(c)):
            label = 0
            for j in range(i + 1, len(c)):
                r = (c[j] - c[i]) / c[i]
                if r >= 0.05 or r <= -0.04:
                    label = 1 if r > 0 else -1
                    break
            want.append(label)
        assert (got[s][:, 0] == np.array(want)).all()


def test_labels_across_blocks(walk):
    df, closes = walk
    got = by_symbol(labels.binary_label(df, block_rows=100), "label")
    npmm = by_symbol(labels.npmm_label(df, block_rows=100), "npmm_label")
    for s, c in closes.items():
        c = np.asarray(c)
        want = np.full(len(c), -1.0)
        want[:-5] = ((c[5:] - c[:-5]) / c[:-5] > 0.02)
        assert (got[s][:, 0] == want).all()
        want = np.zeros(len(c))
        for i in range(5, len(c) - 5):
            near, ahead = c[i - 5:i + 6], c[i:i + 10]
            if c[i] == near.min():
                want[i] = (ahead.max() - c[i]) / c[i] >= 0.02
            elif c[i] == near.max():
                want[i] = -float((c[i] - ahead.min()) / c[i] >= 0.02)
        assert (npmm[s][:, 0] == want).all()


@pytest.fixture(scope="module")
def trades(spark):
    rng = np.random.default_rng(3)
    rows = [("K", dt.datetime(2024, 1, 1) + dt.timedelta(minutes=7 * (i // 2)), i, float(p))
            for i, p in enumerate(np.round(rng.normal(0, 10, 800), 2))]
    return spark.createDataFrame(rows, "symbol string, ts timestamp, id bigint, pnl double").cache(), \
        np.array([r[3] for r in rows])


def test_equity_and_streak(trades):
    df, pnl = trades
    got = stats.equity_curve(df, block_rows=33).orderBy("id").toPandas()
    eq = 100000 + np.cumsum(pnl)
    peak = np.maximum(np.maximum.accumulate(eq), 100000)
    close(got["equity"], eq)
    close(got["peak"], peak)
    streak = risk.loss_streak(df, block_rows=33).orderBy("id").toPandas()["loss_streak"]
    want, k = [], 0
    for p in pnl:
        k = k + 1 if p < 0 else 0
        want.append(k)
    assert streak.tolist() == want


def test_kelly_history(trades):
    df, pnl = trades
    got = risk.kelly_history(df, block_rows=64).orderBy("id").toPandas()
    for i in (0, 5, 8, 9, 120, 799):
        w = pnl[max(0, i - 99):i + 1]
        if len(w) < 10:
            assert (got["win_rate"][i], got["payoff"][i]) == (0.5, 1.5)
        else:
            assert got["win_rate"][i] == pytest.approx((w > 0).mean())
            assert got["payoff"][i] == pytest.approx(w[w > 0].mean() / -w[w < 0].mean())


def test_trailing_count_across_blocks(spark, trades):
    df, _ = trades
    out = risk.trailing_count(df, F.col("pnl") < 0, 3600, "c", "symbol", block_seconds=1800)
    p = out.orderBy("id").toPandas()
    t = pd.to_datetime(p["ts"])
    for i in (0, 17, 400, 799):
        near = (t <= t[i]) & (t >= t[i] - pd.Timedelta(seconds=3600))
        assert p["c"][i] == ((p["pnl"] < 0) & near).sum()


def test_running_in_calendar_buckets(trades):
    df, pnl = trades
    got = stats.equity_curve(df).orderBy("id").toPandas()
    close(got["equity"], 100000 + np.cumsum(pnl))
    streak = risk.loss_streak(df).orderBy("id").toPandas()["loss_streak"]
    blocked = risk.loss_streak(df, block_rows=33).orderBy("id").toPandas()["loss_streak"]
    assert streak.tolist() == blocked.tolist()


def _first_bars(c, rise, fall, quiet, limit=None):
    out = []
    for i, base in enumerate(c):
        label = 0
        for p in c[i + 1:(None if limit is None else i + 1 + limit)]:
            with np.errstate(all="ignore"):
                r = (np.float64(p) - base) / base
            if r >= rise or r <= -fall or abs(r) < quiet:
                label = 1 if r >= rise else -1 if r <= -fall else 0
                break
        out.append(label)
    return np.array(out)


def _far_series():
    rng = np.random.default_rng(3)
    swing = np.where(np.arange(600) % 2, 100.9, 100.0)      # open for good, with a gap around each price
    return {"flat": [100.0] * 500 + [103.0] + [100.0] * 99,
            "swing": np.r_[swing, 108.0, 107.2].tolist(),
            "drift": np.round(50 + 0.004 * np.arange(600) + rng.normal(0, .02, 600), 3).tolist(),
            "holes": [float("nan") if i % 7 == 3 else 100.0 + (i % 3) * 0.8 for i in range(400)] + [90.0, 200.0],
            "hush": [100.0, 101.0] + [float("nan")] * 300 + [101.5, 103.0],
            "below": [-10.0, 0.0, 10.0, 0.5, -10.05] * 60, "short": [1.0], "gone": [float("nan")] * 5,
            "mixed": np.round(rng.choice([-100.0, 100.0, 100.9, 0.0], 900, p=[.002, .497, .497, .004]), 3).tolist()}


@pytest.mark.parametrize("rise,fall,quiet,limit,reach,rows,fanout", [
    (0.02, 0.02, 0.0, None, 4, 8, 4), (0.02, 0.02, 0.005, None, 8, 16, 4), (0.05, 0.04, 0.002, None, 6, 9, 8),
    (0.02, 0.02, 0.005, 300, 8, 16, 4), (0.5, 0.5, 0.0, None, 16, 16, 64), (5.0, 3.0, 1.5, None, 4, 4, 8)])
def test_triple_barrier_far_ahead(spark, rise, fall, quiet, limit, reach, rows, fanout):
    """Touches hundreds of blocks ahead, gaps around the quiet band, nulls, zero and negative closes."""
    closes = _far_series()
    got = by_symbol(labels.triple_barrier(spark, make_bars(spark, closes), rise, fall, quiet, limit,
                                          reach=reach, block_rows=rows, fanout=fanout), "label")
    for s, c in closes.items():
        assert (got[s][:, 0] == _first_bars(np.array(c), rise, fall, quiet, limit)).all(), s


def test_triple_barrier_ranges():
    """A node's ranges answer as its closes do."""
    from barline.operators import barrier
    rng = np.random.default_rng(5)
    for quiet in (0.0, 0.005, 0.3, 2.0):
        for _ in range(300):
            closes = np.unique(np.round(rng.choice([100, -100, 1]) * np.exp(rng.normal(0, rng.choice([.005, .02, 1]), 9)), 6))
            lo, hi = barrier.ranges(closes, closes, quiet)
            bases = rng.choice([100, -100, 1]) * np.exp(rng.normal(0, .05, 20))
            ret = (closes[None, :] - bases[:, None]) / bases[:, None]
            want = ((ret >= 0.02) | (ret <= -0.01) | (np.abs(ret) < quiet)).any(axis=1)
            assert (barrier._holds(lo, hi, bases, 0.02, 0.01, quiet).any(axis=1) == want).all()
