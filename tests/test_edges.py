"""Missing values, extreme numbers, late and repeated rows, and what a caller must not do."""

import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from barline.catalog.base import rounded
from barline.operators import bars, features, folds, indicators, models, portfolio, quality, risk, stats, tables
from barline.plans.series import number_rows
from barline.sources import derived as src
from barline.sources import manifest
from barline.streaming import jobs
from tests.conftest import by_symbol, make_bars
from tests.test_plans import plan

SF = "/root/testdata/sf0.001"


def test_large_doubles_are_not_clipped(spark):
    df = spark.createDataFrame([(1e13,), (5e15,), (-3e17,), (float("nan"),), (0.1234567,)], "x double")
    got = [r.x for r in rounded(df).collect()]
    assert got[:3] == [1e13, 5e15, -3e17] and np.isnan(got[3]) and got[4] == pytest.approx(0.123457, abs=1e-6)


def test_rows_without_key_or_time_end_the_job(spark):
    t = dt.datetime(2020, 1, 1)
    for row in ((None, t), ("a", None)):
        df = spark.createDataFrame([("a", t), row], "symbol string, ts timestamp")
        with pytest.raises(Exception, match="no place in a series"):
            number_rows(df).collect()


def test_gap_in_the_close_keeps_the_average(spark):
    bars_ = make_bars(spark, {"A": [100.0] * 40, "B": [100.0] * 40})
    hole = (F.col("symbol") == "A") & F.col("ts").isin(dt.datetime(2000, 1, 21), dt.datetime(2000, 1, 1))
    got = indicators.ema(bars_.withColumn("close", F.when(~hole, F.col("close"))), 9)
    name = next(c for c in got.columns if c.startswith("ema"))
    x = by_symbol(got, name)
    assert np.isnan(x["A"][[0, 20]]).all() and np.allclose(np.delete(x["A"], [0, 20]), 100) and np.allclose(x["B"], 100)


def test_all_splits_by_default(spark):
    assert folds.half_splits(spark, 16).count() == 12870 and folds.half_splits(spark, 16, 7).count() == 7
    df = src.bars_series(spark, SF)
    assert folds.cpcv_splits(spark, df).groupBy("symbol").count().agg(F.min("count")).first()[0] == 252


def test_overflowing_numbers(spark):
    df = spark.createDataFrame([("A", "99999999999999999999"), ("B", "1577836800")], "symbol string, ts string")
    got = {r.symbol: r.reason for r in quality.clean_keys(df).collect()}
    assert got == {"A": "bad timestamp", "B": None}
    df = spark.createDataFrame([(1e9, 10.0, 10.0 + 1e-12)], "capital double, entry double, stop double")
    assert df.select(risk.fixed_fraction_size().alias("n")).first().n == 10_000_000


@pytest.mark.parametrize("text", ["INSERT INTO t VALUES (1)", "DROP TABLE t", "CREATE TABLE q AS SELECT 1 AS a", "SET a=1",
                                  "WITH x AS (SELECT 1) INSERT INTO t SELECT * FROM x", "FROM t INSERT INTO t SELECT id",
                                  "DELETE FROM t", "CREATE OR REPLACE TEMP VIEW t AS SELECT 1"])
def test_only_queries_run(spark, text):
    with pytest.raises(ValueError, match="only queries"):
        tables.sql_select(spark, text, {"t": spark.range(3)})


def test_views_go_with_the_call(spark):
    assert tables.sql_select(spark, "SELECT * FROM t_once WHERE id > :a", {"t_once": spark.range(3)}, {"a": 0}).count() == 2
    assert not spark.catalog.tableExists("t_once")


def test_rollups_aggregate_by_hash(spark):
    for df in (bars.rollup(src.line_ticks(spark, SF), "1Day"), src.ohlcv(spark, SF, "1Min"),
               tables.timeframe_bucket(src.bars_intraday(spark, SF), "4Hour", "event_id")):
        text = plan(df)
        assert "HashAggregate" in text and "SortAggregate" not in text and "ObjectHash" not in text


def test_order_of_time_and_sequence(spark):
    rows = [("a", dt.datetime(2020, 1, 1), 1.0, 1.0, 5), ("a", dt.datetime(2020, 1, 1), 2.0, 1.0, 9_000_000_000_000_000_000),
            ("a", dt.datetime(1960, 1, 1), 3.0, 1.0, 0), ("a", dt.datetime(1960, 1, 1), 4.0, 1.0, 1)]
    df = spark.createDataFrame(rows, "symbol string, ts timestamp, price double, size double, seq bigint")
    got = [(r.open, r.close) for r in bars.rollup(df, "1Day").orderBy("ts").collect()]
    assert got == [(3.0, 4.0), (1.0, 2.0)]


def _bars(spark, rows):
    return spark.createDataFrame([("A", dt.datetime(2020, 1, d), p, p, p, p, 1) for d, p in rows],
                                 "symbol string, ts timestamp, open double, high double, low double, close double, volume bigint")


def test_streamed_rewrites_back_to_an_earlier_value(spark, tmp_path):
    root, ckpt, feed = (str(tmp_path / x) for x in ("root", "ckpt", "in"))
    for value in (1.0, 2.0, 1.0):
        df = _bars(spark, [(5, value)])
        df.write.mode("append").parquet(feed)
        jobs.drain(jobs.stream_upsert(spark.readStream.schema(df.schema).parquet(feed), root, ckpt))
    assert [r.close for r in jobs.read_upserted(spark, root).collect()] == [1.0]
    jobs.compact(spark, root)
    assert [r.close for r in jobs.read_upserted(spark, root).collect()] == [1.0]


def test_a_stream_goes_on_while_its_table_is_folded(spark, tmp_path):
    root = str(tmp_path / "root")
    write = jobs.upsert_batch(root)
    first = lambda rows: _bars(spark, rows).withColumn("vwap", F.col("close") * 10)
    write(first([(1, 1.0), (2, 2.0)]), 0)
    write(first([(2, 3.0), (3, 4.0)]), 1)
    write(first([(9, 9.0)]), 1)  # a retry of a batch that is in: nothing happens
    before, _ = manifest.snapshot(spark, root)

    def meanwhile():
        write(first([(3, 5.0), (4, 6.0)]), 2)
    jobs.compact(spark, root, meanwhile)
    _, live = manifest.snapshot(spark, root)
    assert [last for _, last in live] == [1, 2]
    values = lambda v=None: {r.ts.day: (r.close, r.vwap) for r in jobs.read_upserted(spark, root, v).collect()}
    assert values() == {1: (1.0, 10.0), 2: (3.0, 20.0), 3: (5.0, 40.0), 4: (6.0, 60.0)}
    assert values(before) == {1: (1.0, 10.0), 2: (3.0, 20.0), 3: (4.0, 40.0)}  # a reader of the version before
    write(first([(2, 7.0)]), 1)  # still in, though folded
    assert values()[2] == (3.0, 20.0)
    other = []
    jobs.compact(spark, root, lambda: other.append(jobs.compact(spark, root)))  # the other one commits first
    assert len(manifest.snapshot(spark, root)[1]) == 1 and values()[4] == (6.0, 60.0)
    assert manifest.expire(spark, root, keep=1) >= 4 and values()[1] == (1.0, 10.0)


def test_two_writers_never_share_a_version(spark, tmp_path):
    root = str(tmp_path / "root")
    seen = []

    def change(live):
        if not seen:
            seen.append(live)
            manifest.commit(spark, root, lambda now: [*now, ("other", 0)])
        return [*live, ("own", 1)]
    assert manifest.commit(spark, root, change) == 1
    assert manifest.snapshot(spark, root) == (1, [("other", 0), ("own", 1)])
    assert manifest.snapshot(spark, root, 0) == (0, [("other", 0)])


def walked(rows, equity, seconds, daily):
    """The breaker rule, row by row."""
    out, state = {}, {}
    for s, ts, i, kind, pnl in sorted(rows, key=lambda r: (r[0], r[1], r[2])):
        x = state.setdefault(s, {"errors": [], "streak": 0, "level": 0, "day": None, "loss": 0.0})
        if ts.date() != x["day"]:
            x["day"], x["loss"] = ts.date(), 0.0
            if daily and x["level"] == 2:
                x["level"] = 0
        if kind == "reset":
            x.update(errors=[], streak=0, level=0)
        elif kind == "error":
            x["errors"].append(ts)
        if pnl is not None:
            x["streak"] = x["streak"] + 1 if pnl < 0 else 0
            x["loss"] += min(pnl, 0.0)
        n = sum(e >= ts - dt.timedelta(seconds=seconds) for e in x["errors"])
        called = 3 if n >= 5 or x["streak"] >= 5 else 2 if -x["loss"] > equity * 0.1 or x["streak"] >= 3 else 1 if n >= 2 else 0
        x["level"] = max(x["level"], called)
        out[s, i] = (n, x["streak"], ["normal", "warn", "soft_halt", "hard_halt"][x["level"]])
    return out


@pytest.mark.parametrize("daily", [False, True])
def test_breaker_with_resets_whole_or_in_batches_out_of_order(spark, tmp_path, daily):
    rng = np.random.default_rng(12 + daily)
    rows, start = [], dt.datetime(2020, 1, 1)
    for s in "ab":
        t = start
        for i in range(260):
            t += dt.timedelta(seconds=int(rng.integers(20, 3000)))
            kind = rng.choice(["error", "trade", "other", "reset"], p=[.3, .45, .22, .03])
            pnl = float(np.round(rng.normal(1, 12), 2)) if kind == "trade" else None
            rows.append((s, t, i, str(kind), pnl))
    schema = "symbol string, ts timestamp, id bigint, kind string, pnl double"
    got = lambda df: {(r.symbol, r.id): (r.errors, r.loss_streak, r.level) for r in df.collect()}
    want = walked(rows, 300.0, 3600, daily)
    assert len({w[2] for w in want.values()}) == 4
    df = spark.createDataFrame(rows, schema)
    if not daily:
        assert got(risk.breaker_level(df, 300.0, 3600, daily_reset=daily, block_rows=30)) == want
        return
    root, ckpt, feed = (str(tmp_path / x) for x in ("root", "ckpt", "in"))
    parts = [[r for i, r in enumerate(rows) if pick(i, r)] for pick in (
        lambda i, r: r[2] < 90 and r[2] % 7, lambda i, r: 150 <= r[2] < 200 and r[0] == "a",
        lambda i, r: 90 <= r[2] < 150 or r[2] >= 200 or (r[2] >= 150 and r[0] == "b"), lambda i, r: r[2] < 90 and r[2] % 7 == 0)]
    assert sum(map(len, parts)) == len(rows)
    for part in parts:
        spark.createDataFrame(part, schema).write.mode("append").parquet(feed)
        jobs.drain(jobs.stream_breaker(spark.readStream.schema(schema).parquet(feed), root, ckpt, 300.0, 3600, daily_reset=daily))
    assert got(jobs.read_levels(spark, root)) == want


def test_late_bar_scores_all_later_ones(spark, tmp_path):
    hist, out, ckpt, feed = (str(tmp_path / x) for x in ("hist", "out", "ckpt", "in"))
    score = lambda df: indicators.sma(df, 3).select("symbol", "ts", "sma_3")
    values = [(d, float(d * d)) for d in range(1, 13)]
    for part in (values[:4] + values[6:9], values[4:5] + values[9:], values[5:6]):
        df = _bars(spark, part)
        df.write.mode("append").parquet(feed)
        jobs.drain(jobs.stream_signals(spark.readStream.schema(df.schema).parquet(feed), hist, out, ckpt, score, 2))
    got = {r.ts.day: r.sma_3 for r in jobs.read_signals(spark, out).collect()}
    assert got == {d: None if d < 3 else pytest.approx(np.mean([v for e, v in values if d - 3 < e <= d])) for d, _ in values}


def test_ranks_put_leaders_variants_first():
    names = features.feature_names()
    top = features.select_top_features(names, 60)
    listed = [f for f in features.PRIORITY if f in names]
    assert top[:len(listed)] == listed
    assert features.select_top_features(names, 5, prioritize=False) == names[:5]
    assert sorted(features.select_top_features(names, 70)) == sorted(names)
    few = ["x", "rsi_zscore", "rsi", "obv_zscore"]
    assert features.select_top_features(few, 4) == ["rsi", "obv_zscore", "rsi_zscore", "x"] or \
        features.select_top_features(few, 3) == ["rsi", "rsi_zscore", "x"]


def test_risk_parity_by_bisection_of_two_assets():
    cov = np.diag([1.0, 4.0])
    assert portfolio.hierarchical(cov, 0, 1) == pytest.approx([0.8, 0.2], abs=1e-9)


def test_search_scores_later_rows_only(spark):
    rng = np.random.default_rng(6)
    rows = [("A", i, 100, float(rng.normal()), int(rng.integers(0, 2))) for i in range(100)]
    df = spark.createDataFrame(rows, "symbol string, rn int, n int, x double, label int").withColumn("y", F.col("x") * 2)
    got = models.param_search(df, ["x", "y"], [{"depth": 1, "trees": 1}, {"depth": 2, "trees": 2}])
    assert got.select("rows").distinct().collect()[0].rows == 20 and got.count() == 2


def test_linear_meta_learner_solves_normal_equations(spark):
    rng = np.random.default_rng(7)
    x = rng.normal(size=(300, 3))
    y = x @ [1.0, -2.0, 0.5] + 3 + 0.1 * rng.normal(size=300)
    df = spark.createDataFrame([(*map(float, r), float(t)) for r, t in zip(x, y, strict=True)], "a double, b double, c double, target double")
    model, _ = models.meta_learner(df, ["a", "b", "c"], kind="linear", symbol=None)
    want, *_ = np.linalg.lstsq(np.c_[x, np.ones(300)], y, rcond=None)
    assert [*model.stages[-1].coefficients, model.stages[-1].intercept] == pytest.approx(list(want), abs=1e-6)


def test_overfitting_of_all_splits_equals_direct_count(spark):
    rng = np.random.default_rng(8)
    m = rng.normal(0, 1, (60, 4))
    df = spark.createDataFrame([(dt.datetime(2020, 1, 1) + dt.timedelta(days=t), f"t{j}", float(m[t, j]))
                                for t in range(60) for j in range(4)], "ts timestamp, trial string, ret double")
    got = stats.pbo(spark, df, parts=6).first()
    assert got.splits == 20 and 0 <= got.pbo <= 1


def test_blend_deals_no_rows_out_by_model(spark):
    rows = [(i % 50, m, float(i)) for i in range(200) for m in ("a", "b")] + [(None, "a", 4.0), (0, "x", 9.0), (0, None, 9.0), (1, "b", None)]
    long = spark.createDataFrame(rows, "id long, model string, prediction double")
    weights = spark.createDataFrame([("a", 2.0), ("b", 0.5), ("c", 1.0)], "model string, weight double")
    out = models.blend(long, weights, ["id"])
    text = plan(out)
    assert "hashpartitioning(id#" in text and "hashpartitioning(model#" not in text
    given, top, low = dict(weights.collect()), {}, {}
    for k, m, p in rows:
        if m in given:
            top[k] = top.get(k, 0) + given[m] * (p or 0)
            low[k] = low.get(k, 0) + given[m]
    assert {r.id: r.blended for r in out.collect()} == pytest.approx({k: top[k] / low[k] for k in low})


def test_a_callers_view_outlives_a_query(spark):
    spark.range(3).createOrReplaceTempView("rows_of_mine")
    other = spark.range(7)
    assert tables.sql_select(spark, "SELECT count(*) AS n FROM rows_of_mine", {"rows_of_mine": other}).first().n == 7
    assert spark.table("rows_of_mine").count() == 3
    spark.catalog.dropTempView("rows_of_mine")
    tables.sql_select(spark, "SELECT * FROM rows_of_mine", {"rows_of_mine": other})
    assert "rows_of_mine" not in {t.name for t in spark.catalog.listTables()}


def test_cleanup_takes_only_folders_of_its_own(spark, tmp_path, monkeypatch):
    from barline import session
    from barline.sources import stored
    monkeypatch.setattr(session, "_SCRATCH", {})
    monkeypatch.setattr(stored, "_PATHS", {})
    spark.range(3).write.parquet(str(tmp_path / "t.parquet"))
    stored.stored(spark, str(tmp_path), "copy", lambda: spark.read.parquet(str(tmp_path / "t.parquet")))
    path, = stored._PATHS.values()
    assert session.cleanup(spark) == 1 and not stored._PATHS
    with pytest.raises(Exception, match="PATH_NOT_FOUND"):
        spark.read.parquet(path)
    assert stored.stored(spark, str(tmp_path), "copy", lambda: spark.read.parquet(str(tmp_path / "t.parquet"))).count() == 3
