import datetime as dt
import os
import sys

import numpy as np
import pandas as pd
import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from barline.session import get_spark  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    s = get_spark("tests", "local[8]", **{"spark.sql.shuffle.partitions": "4",
                                          "spark.driver.memory": "8g"})
    s.sparkContext.setLogLevel("ERROR")
    return s


def make_bars(spark, closes: dict, high=None, low=None, volume=1_000_000):
    """Daily bars from close lists per symbol; open = close, spread 2 unless given."""
    rows = []
    for sym, values in closes.items():
        for i, c in enumerate(values):
            c = float(c)
            rows.append((sym, dt.datetime(2000, 1, 1) + dt.timedelta(days=i), c,
                         c + 1.0 if high is None else high(c), c - 1.0 if low is None else low(c), c,
                         int(volume if not callable(volume) else volume(i))))
    return spark.createDataFrame(rows, "symbol string, ts timestamp, open double, high double, "
                                       "low double, close double, volume bigint")


@pytest.fixture(scope="session")
def walk(spark):
    """Random walks of uneven length: (bars frame, {symbol: closes})."""
    rng = np.random.default_rng(7)
    closes = {s: np.round(100 + np.cumsum(rng.normal(0, 1, n)) + rng.normal(0, .2, n), 4) + 60
              for s, n in (("A", 5200), ("B", 900), ("C", 37))}
    df = make_bars(spark, closes, volume=lambda i: 100 + (i * 37) % 91)
    return df.cache(), closes


def by_symbol(df, *cols, order="ts"):
    p = df.orderBy("symbol", order).toPandas()
    return {s: g[list(cols)].to_numpy(dtype=float) for s, g in p.groupby("symbol")}


def series(x):
    return pd.Series(np.asarray(x, dtype=float))
