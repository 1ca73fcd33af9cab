from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from panelkit.operators import signals
from tests.panels import ONE_DATE, PANELS, expected

SCHEMA = "ticker string, date int, feat double"


@pytest.mark.parametrize("name", PANELS)
def test_all_methods_keep_the_rows(spark, name):
    df = spark.createDataFrame(PANELS[name], SCHEMA)
    for m in signals.METHODS:
        df = signals.make_signal(df, "feat", m)
    rows = df.collect()
    assert len(rows) == len(PANELS[name])
    for r in rows:
        for m in ("rank", "zscore_tanh"):
            assert r[f"feat_{m}"] is None or abs(r[f"feat_{m}"]) <= 1 + 1e-12


@pytest.mark.parametrize("name", ONE_DATE)
def test_signals_by_definition(spark, name):
    methods = ("zscore", "zscore_tanh", "rank", "decile")
    df = spark.createDataFrame(PANELS[name], SCHEMA)
    for m in methods:
        df = signals.make_signal(df, "feat", m)
    rows = {r["ticker"]: r for r in df.collect()}
    for m in methods:
        got = [rows[t][f"feat_{m}"] for t, _, _ in PANELS[name]]
        assert got == pytest.approx(expected([x for _, _, x in PANELS[name]], m), abs=1e-9), m


def test_row_order_does_not_matter(spark):
    rows = PANELS["many_dates"]
    one, two = (signals.make_signal(spark.createDataFrame(x, SCHEMA), "feat", "rank").orderBy("ticker", "date").collect() for x in (rows, rows[::-1]))
    assert one == two


def test_descending_and_options(spark):
    df = spark.createDataFrame(PANELS["spread_out"], SCHEMA)
    got = signals.make_signal(df, "feat", "decile", descending=True, n_buckets=4).orderBy("ticker").collect()
    assert [r["feat_decile"] for r in got] == [1, 1, 0, 0, -1]  # quartiles are 0.25 and 6.75 themselves
    got = signals.rank(df, "feat", descending=True).orderBy("ticker").collect()
    assert [r["feat_rank"] for r in got] == [5, 4, 3, 2, 1]
    with pytest.raises(ValueError):
        signals.make_signal(df, "feat", "unknown")


def test_clip_keeps_null_and_nan(spark):
    df = spark.createDataFrame([(None,), (float("nan"),), (9.0,), (-9.0,), (1.0,)], "x double")
    got = [r[0] for r in df.select(signals.clip_expr(F.col("x"))).collect()]
    assert got[0] is None and got[1] != got[1] and got[2:] == [3.0, -3.0, 1.0]


def test_expression_helpers(spark):
    from panelkit.functions.helpers import add_expr, as_list

    assert as_list("a") == ["a"] and as_list(("a", "b")) == ["a", "b"] and as_list(5) == [5]
    with pytest.raises(TypeError):
        as_list(None)
    df = add_expr(spark.createDataFrame([(0.5, 1.0)], "a double, b double"), signals.tanh_expr, ["a", "b"], "t", scale=2.0)
    assert df.columns == ["a", "b", "a_t", "b_t"]
