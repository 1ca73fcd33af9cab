from __future__ import annotations

import math
import random
import statistics

import numpy as np
import pytest
from pyspark.sql import functions as F

from panelkit.operators import features as ft

#: Log returns of three tickers; the last one begins late, so its own rows and the market's calendar differ.
RETURNS = {"oak": [0.03, -0.01, 0.02, 0.05, 0.08], "elm": [0.01, 0.03, -0.02, 0.01, 0.06], "fir": [None, None, 0.06, -0.03, 0.01]}
SERIES = [(t, d, x) for t, values in RETURNS.items() for d, x in enumerate(values) if x is not None]
BETA_SCHEMA = "ticker string, date int, logret double"


def _column(df, name):
    return [r[name] for r in df.orderBy("ticker", "date").collect()]


def expected_betas(window):
    """Covariance of a ticker's last rows with the market, over the variance of the market's last dates; lists and loops."""
    dates = range(5)
    market = {d: statistics.fmean([x for _, at, x in SERIES if at == d]) for d in dates}
    out = []
    for t in sorted(RETURNS):
        own = [(d, x) for at, d, x in SERIES if at == t]
        for k, (d, _) in enumerate(own):
            if k + 1 < window or d + 1 < window:
                out.append(None)
                continue
            last = own[k + 1 - window : k + 1]
            mean_x, mean_m = statistics.fmean([x for _, x in last]), statistics.fmean([market[at] for at, _ in last])
            covariance = sum((x - mean_x) * (market[at] - mean_m) for at, x in last) / (window - 1)
            out.append(covariance / statistics.variance([market[at] for at in range(d + 1 - window, d + 1)]))
    return out


def test_beta_by_definition(spark):
    df = ft.add_beta(spark.createDataFrame(SERIES, BETA_SCHEMA), [2, 3], min_tickers=1)
    for w in (2, 3):
        assert _column(df, f"beta{w}") == pytest.approx(expected_betas(w), abs=1e-9)
    given = ft.add_market_return(spark.createDataFrame(SERIES, BETA_SCHEMA), 1)  # the market is there already
    assert _column(ft.add_beta(given, 3), "beta3") == pytest.approx(expected_betas(3), abs=1e-9)


def test_too_few_tickers_have_no_market(spark):
    df = ft.add_beta(spark.createDataFrame(SERIES, BETA_SCHEMA), [2])
    assert set(_column(df, "beta2")) == {None} and set(_column(df, "mkt_logret")) == {None} and set(_column(df, "n_tickers")) == {2, 3}


def test_market_has_beta_one_to_itself(spark):
    rng = random.Random(1)
    rows = [(t, d, rng.gauss(0, 0.01)) for d in range(40) for t in "ABC"]
    df = ft.add_market_return(spark.createDataFrame(rows, "ticker string, date int, logret double"), 1)
    market = df.select(F.lit("M").alias("ticker"), "date", F.col("mkt_logret").alias("logret")).distinct()
    got = [x for x in _column(ft.add_beta(market, 5, min_tickers=1), "beta5") if x is not None]
    assert len(got) == 36 and got == pytest.approx([1.0] * 36)


@pytest.fixture(scope="module")
def walk(spark):
    rng = random.Random(7)
    rows = []
    for t in "ABC":
        price = 100.0
        for d in range(120):
            if rng.random() < 0.1:
                continue  # a gap
            price *= math.exp(rng.gauss(0, 0.02))
            rows.append((t, d, price, rng.randint(1, 1000)))
    rng.shuffle(rows)
    return spark.createDataFrame(rows, "ticker string, date int, close double, volume bigint").cache()


def test_returns_and_momentum(spark, walk):
    df = ft.add_fwdret_horizon(ft.add_fwd_returns(ft.add_momentum(ft.add_log_returns(walk), (5, 10))), [1, 3])
    rows = df.orderBy("ticker", "date").collect()
    by = {t: [r for r in rows if r["ticker"] == t] for t in "ABC"}
    for own in by.values():
        for k, r in enumerate(own):
            logret = math.log(r["close"]) - math.log(own[k - 1]["close"]) if k else None
            assert r["logret"] == (pytest.approx(logret) if k else None)
            assert r["fwdret"] == (pytest.approx(own[k + 1]["logret"]) if k + 1 < len(own) else None)
            assert r["mom5"] == (pytest.approx(r["close"] / own[k - 5]["close"] - 1) if k >= 5 else None)
            wanted = sum(x["logret"] for x in own[k + 1 : k + 4]) if k + 3 < len(own) else None
            assert r["fwd_ret_3"] == (pytest.approx(wanted) if wanted is not None else None)


@pytest.mark.parametrize("window", [2, 20, 60])
def test_running_sums_equal_frames(spark, walk, window):
    base = ft.add_log_returns(walk)
    slow, fast = ft.add_volatility(base, [window], by_sums=False), ft.add_volatility(base, [window])
    a, b = _column(slow, f"std{window}"), _column(fast, f"std{window}")
    assert [x is None for x in a] == [x is None for x in b]
    assert np.allclose([x for x in a if x is not None], [x for x in b if x is not None], atol=1e-12)
    a, b = (_column(ft.add_log_adv(walk, [window], by_sums=s), f"log_adv{window}") for s in (False, True))
    assert [x is None for x in a] == [x is None for x in b]
    assert np.allclose([x for x in a if x is not None], [x for x in b if x is not None], atol=1e-10)


def test_beta_by_running_sums(spark, walk):
    base = ft.add_log_returns(walk)
    a, b = (_column(ft.add_beta(base, 20, min_tickers=2, by_sums=s), "beta20") for s in (False, True))
    assert [x is None for x in a] == [x is None for x in b] and sum(x is not None for x in a) > 50
    assert np.allclose([x for x in a if x is not None], [x for x in b if x is not None], atol=1e-9)


def test_momentum_fills_null_closes(spark):
    rows = [("A", 1, 10.0), ("A", 2, None), ("A", 3, 15.0)]
    got = _column(ft.add_momentum(spark.createDataFrame(rows, "ticker string, date int, close double"), 1), "mom1")
    assert got == [None, 0.0, 0.5]


def test_missing_days_and_build(spark):
    rows = [("A", f"2024-01-{d:02d}", 10.0 + d, 5) for d in (1, 2, 5)]
    df = spark.createDataFrame(rows, "ticker string, d string, close double, volume bigint").select("ticker", F.to_date("d").alias("date"), "close", "volume")
    assert _column(ft.missing_days(df), "missing_days") == [None, 0, 2]
    out = ft.build_features(df, (2,), (2,), min_tickers=1)
    assert {"logret", "fwdret", "mkt_logret", "n_tickers", "beta2", "mom2", "std2", "dollar_volume", "log_adv2"} <= set(out.columns)
    assert out.count() == 3


def test_full_width(spark):
    columns = "ticker string, date int, open double, high double, low double, close double, volume bigint"
    assert len(ft.build_features(spark.createDataFrame([], columns)).columns) == 32
