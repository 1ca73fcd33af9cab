"""Shapes of plans: what is read, and how often rows move."""

from __future__ import annotations

import math
import random

from pyspark.sql import functions as F

from panelkit import __main__ as cli
from panelkit.operators import evaluation as ev
from panelkit.operators import features as ft
from panelkit.operators import reports, signals
from panelkit.plans import workflow


def _plan(df) -> str:
    text = df._jdf.queryExecution().executedPlan().toString()
    return text.split("== Initial Plan ==")[-1]


def _prices(spark, tmp_path):
    rows = [(t, d, 10.0 + d, 1.0, 5) for t in "AB" for d in range(5)]
    spark.createDataFrame(rows, "ticker string, date int, close double, open double, volume bigint").write.parquet(str(tmp_path / "p"))
    return spark.read.parquet(str(tmp_path / "p"))


def test_a_chain_of_features_moves_rows_once(spark, tmp_path):
    df = ft.add_fwd_returns(ft.add_log_returns(_prices(spark, tmp_path)))
    df = ft.add_log_adv(ft.add_volatility(ft.add_momentum(df, [5, 20]), [5, 20, 60]), [5, 60])
    plan = _plan(df.drop("open"))
    assert plan.count("Exchange hashpartitioning(ticker") == 1 and plan.count("Exchange") == 1
    assert plan.count("Sort [") == 1
    assert "open" not in plan.split("ReadSchema")[1]


def test_signals_of_a_date_move_rows_once(spark, tmp_path):
    df = _prices(spark, tmp_path)
    for m in signals.METHODS:
        df = signals.make_signal(df, "close", m)
    assert _plan(df).count("Exchange") == 1


def test_filters_reach_the_scan(spark, tmp_path):
    plan = _plan(ft.add_log_returns(_prices(spark, tmp_path)).where("ticker = 'A'").select("logret"))
    assert "EqualTo(ticker,A)" in plan and "volume" not in plan


def test_ic_ranks_and_groups_in_one_move(spark, tmp_path):
    plan = _plan(ev.compute_ic(_prices(spark, tmp_path), "close", "open"))
    assert plan.count("Exchange") == 1


def test_reports_move_rows_three_times(spark, tmp_path):
    df = _prices(spark, tmp_path).withColumn("date", F.date_add(F.lit("2020-01-01").cast("date"), F.col("date")))
    plan = _plan(reports.compare_reports(df, ["close", "open", "volume"], "open"))
    assert plan.count("Exchange") == 3 and plan.count("FileScan") == 1


def test_the_market_is_broadcast_and_made_once(spark, tmp_path):
    plan = _plan(ft.add_beta(ft.add_log_returns(_prices(spark, tmp_path)), (5, 60)))
    assert plan.count("BroadcastHashJoin") == 1 and "SortMergeJoin" not in plan and plan.count("FileScan") == 2


def test_workflow_from_files(spark, tmp_path, capsys):
    raw = tmp_path / "raw"
    raw.mkdir()
    rng = random.Random(3)
    for t in range(6):
        price, lines = 50.0, ["Date,Open,High,Low,Close,Adj Close,Volume"]
        for d in range(80):
            price *= math.exp(rng.gauss(0, 0.02))
            lines.append(f"2024-{1 + d // 28:02d}-{1 + d % 28:02d},1,1,1,1,{price},{100 + t}")
        (raw / f"T{t}.csv").write_text("\n".join(lines))
    clean = workflow.build_prices(spark, f"{raw}/*.csv", str(tmp_path / "prices"))
    assert clean.count() == 480
    panel = workflow.build_features(spark, str(tmp_path / "prices"), str(tmp_path / "features"), 1, (5, 20), (20,))
    out = workflow.compare_signals(panel, ["mom5", "std20", "beta20"], "rank").collect()
    assert len(out) == 3 and {"signal", "ic_mean", "survives_bh", "survives_by", "qvalue"} <= set(out[0].asDict())
    assert all(r["n_days"] > 10 for r in out)
    cli.main(["inspect", str(tmp_path / "features"), "mom5"])
    assert "2024-01-10" in capsys.readouterr().out
