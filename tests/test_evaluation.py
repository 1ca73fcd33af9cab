from __future__ import annotations

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from panelkit.functions.stats import two_sided_pvalue
from panelkit.operators import evaluation as ev
from panelkit.operators import reports
from tests.panels import PANELS

X = [0.10, -0.05, 0.20, 0.05, 0.00, 0.15, -0.10, 0.10]


def _series(spark, values):
    return spark.createDataFrame([(k, None if v is None else float(v)) for k, v in enumerate(values)], "date int, ic double")


def test_newey_west_hand_computed(spark):
    r = ev.newey_west(_series(spark, X)).first()
    assert (r["max_lag"], r["n"]) == (2, 8)
    assert r["mean"] == pytest.approx(0.05625) and r["se"] == pytest.approx(0.016137430609, abs=1e-12) and r["t_stat"] == pytest.approx(3.485685011587, abs=1e-9)


@pytest.mark.parametrize("n", [2, 3, 30, 250])
def test_newey_west_against_numpy(spark, n):
    rng = random.Random(n)
    values = [rng.gauss(0.01, 0.1) for _ in range(n)]
    d = np.array(values) - np.mean(values)
    lag = max(1, int(4 * (n / 100) ** (2 / 9)))
    var = d @ d / n + 2 * sum((1 - k / (lag + 1)) * (d[k:] @ d[: n - k]) / n for k in range(1, lag + 1) if k < n)
    r = ev.newey_west(_series(spark, values)).first()
    assert r["max_lag"] == lag
    if var > 0:
        assert r["t_stat"] == pytest.approx(np.mean(values) / math.sqrt(var / n), rel=1e-9)
    else:
        assert r["se"] is None and r["t_stat"] is None


def test_newey_west_degenerate(spark):
    for values in ([], [0.1], [None, None], [0.5, 0.5, 0.5]):
        rows = ev.newey_west(_series(spark, values)).collect()
        assert all(r["t_stat"] is None for r in rows)
    assert ev.newey_west(_series(spark, [0.1, float("nan"), 0.3])).first()["n"] == 2


def test_drawdown_and_sharpe(spark):
    frame = _series(spark, X)
    assert ev.max_drawdown(frame, "ic").first()[0] == pytest.approx(-0.10)
    assert ev.max_drawdown(_series(spark, [-0.3, 0.1]), "ic").first()[0] == 0.0
    assert ev.sharpe_ratio(frame, "ic").first()[0] == pytest.approx(9.400193421608)
    assert ev.sharpe_ratio(_series(spark, [0.1, 0.1]), "ic").first()[0] is None
    assert ev.sharpe_ratio(_series(spark, []), "ic").first()[0] is None


def test_pvalues_to_double_precision(spark):
    ts = [0.0, 0.5, 1.0, 1.96, -3.0, 5.0, 7.0, 7.2, 10.0, 20.0, 40.0, None]
    got = [r[0] for r in spark.createDataFrame([(t,) for t in ts], "t double").select(two_sided_pvalue(F.col("t"))).collect()]
    for t, p in zip(ts, got, strict=True):
        if t is None:
            assert p is None
        else:
            assert p == pytest.approx(math.erfc(abs(t) / math.sqrt(2)), rel=1e-6, abs=1e-14)


@pytest.mark.parametrize("name", PANELS)
@pytest.mark.parametrize("method", ["spearman", "pearson"])
def test_ic_never_fails(spark, name, method):
    df = spark.createDataFrame(PANELS[name], "ticker string, date int, feat double").withColumn("fwdret", F.col("feat") * 2)
    rows = ev.compute_ic(df, "feat", method=method).collect()
    for r in rows:
        assert r["ic"] is None or r["ic"] == pytest.approx(1.0)
    with pytest.raises(ValueError):
        ev.compute_ic(df, "feat", method="other")


def test_spearman_against_numpy(spark):
    rng = random.Random(3)
    rows = [(str(t), d, float(rng.randint(0, 9)), rng.gauss(0, 1)) for d in range(5) for t in range(30)]
    rows[4] = (*rows[4][:2], None, 0.5)
    df = spark.createDataFrame(rows, "ticker string, date int, x double, fwdret double")
    got = {r["date"]: r["ic"] for r in ev.compute_ic(df, "x").collect()}

    def ranks(v):
        v = np.array(v)
        return np.array([(v < a).sum() + ((v == a).sum() + 1) / 2 for a in v])

    for d in range(5):
        own = [r for r in rows if r[1] == d and r[2] is not None]
        assert got[d] == pytest.approx(np.corrcoef(ranks([r[2] for r in own]), ranks([r[3] for r in own]))[0, 1])


def test_autocorrelation_modes(spark):
    rng = random.Random(5)
    rows = [(t, d, rng.gauss(0, 1)) for t in "AB" for d in range(50)]
    df = spark.createDataFrame(rows, "ticker string, date int, x double")
    flat = ev.autocorrelation(df.where("ticker = 'A'"), "x", (1, 3)).first()
    a = np.array([r[2] for r in rows if r[0] == "A"])
    b = np.array([r[2] for r in rows if r[0] == "B"])
    of = lambda v, k: np.corrcoef(v[k:], v[:-k])[0, 1]
    assert flat["lag_3"] == pytest.approx(of(a, 3))
    grouped = {r["lag"]: r for r in ev.autocorrelation(df, "x", (1, 3), "ticker").collect()}
    assert grouped[1]["mean"] == pytest.approx((of(a, 1) + of(b, 1)) / 2) and grouped[1]["n_groups"] == 2


def test_reports_equal_their_parts(spark):
    rng = random.Random(9)
    rows = [(str(t), f"2024-01-{d:02d}", rng.gauss(0, 1), rng.gauss(0, 1), rng.gauss(0, 0.01)) for d in range(1, 21) for t in range(25)]
    df = spark.createDataFrame(rows, "ticker string, d string, s1 double, s2 double, fwdret double").withColumn("date", F.to_date("d")).drop("d").cache()
    both = {r["signal"]: r for r in reports.compare_reports(df, ["s1", "s2"]).collect()}
    assert set(both) == {"s1", "s2"} and tuple(both["s1"].asDict()) == reports.FIELDS
    ic = ev.compute_ic(df, "s1").cache()
    nw = ev.newey_west(ic).first()
    spread = ev.decile_longshort_returns(df, "s1")
    r = both["s1"]
    assert r["ic_mean"] == pytest.approx(ev.summarize_ic(ic).first()["mean"])
    assert r["ic_tstat_nw"] == pytest.approx(nw["t_stat"]) and r["ic_pval_nw"] == pytest.approx(math.erfc(abs(nw["t_stat"]) / math.sqrt(2)), rel=1e-9)
    assert r["long_short_max_dd"] == pytest.approx(ev.max_drawdown(spread, "spread_ret").first()[0])
    assert r["recent_coverage"] == 1.0 and r["n_days"] == 20
    assert reports.signal_report(df, "s2").first() == both["s2"] or reports.signal_report(df, "s2").first()["ic_mean"] == pytest.approx(both["s2"]["ic_mean"])


def test_decile_spread_has_a_null_bucket(spark):
    df = spark.createDataFrame(PANELS["some_missing"], "ticker string, date int, feat double").withColumn("fwdret", F.lit(1.0))
    assert None in {r["bucket"] for r in ev.decile_spread(df, "feat").collect()}


def test_heatmap_has_the_cells_of_all_tickers(spark):
    df = spark.createDataFrame(PANELS["many_dates"], "ticker string, date int, feat double")
    assert sorted(map(tuple, ev.heatmap(df, "feat").collect())) == sorted(PANELS["many_dates"])
    assert {r["ticker"] for r in ev.heatmap(df, "feat", ["oak", "fir"]).collect()} == {"oak", "fir"}
