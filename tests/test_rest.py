from __future__ import annotations

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from panelkit.operators import inspection, risk, validation
from panelkit.plans.queries import rounded, rounded_correlations
from panelkit.sources import panels, prices
from panelkit.streaming import ingest


def test_folds(spark):
    dates = spark.createDataFrame([(d,) for d in range(1, 21)] * 2, "date int")
    got = [tuple(r)[1:] for r in validation.rolling_purged_embargoed_splits(dates, 5, 3, 4, 2, 1).orderBy("fold").collect()]
    assert got == [(1, 5, 8, 10), (5, 9, 12, 14), (9, 13, 16, 18)]
    with pytest.raises(ValueError):
        validation.rolling_purged_embargoed_splits(dates, 5, 3, 3, 2, 1)
    assert validation.rolling_purged_embargoed_splits(dates.limit(0), 5, 3, 4, 2, 1).count() == 0


def _csv(folder, ticker, rows):
    lines = ["Date,Open,High,Low,Close,Adj Close,Volume", *rows]
    (folder / f"{ticker}.csv").write_text("\n".join(lines) + "\n")


def test_etl(spark, tmp_path):
    raw = tmp_path / "raw"
    raw.mkdir()
    _csv(raw, "AAA", ["2024-01-02,1,2,0.5,9,1.5,100", "2024-01-02,1,2,0.5,9,1.5,100", "2024-01-03,1,2,0.5,9,0,100", "2024-01-04,1,2,0.5,9,1.25,0"])
    _csv(raw, "BRK-B", ["2024-01-02,1,2,0.5,9,2.5,7", "2024-01-03,,,,,,"])
    out = prices.etl(spark, f"{raw}/*.csv", str(tmp_path / "prices"))
    assert out.columns == list(prices.COLUMNS)
    assert sorted((r["ticker"], r["close"], r["volume"]) for r in out.collect()) == [("AAA", 1.5, 100), ("BRK-B", 2.5, 7)]
    assert prices.check_unique(out).count() == 0
    prices.write_csv_per_ticker(out, str(tmp_path / "csv"))
    assert spark.read.option("header", True).csv(str(tmp_path / "csv")).count() == 2


def test_streaming_ingestion_equals_the_batch(spark, tmp_path):
    raw, done, mark = tmp_path / "raw", str(tmp_path / "prices"), str(tmp_path / "mark")
    raw.mkdir()
    _csv(raw, "AAA", ["2024-01-02,1,2,0.5,9,1.5,100", "2024-01-02,1,2,0.5,9,1.5,100"])
    ingest.ingest_available(spark, str(raw), done, mark)
    _csv(raw, "BBB", ["2024-01-02,1,2,0.5,9,2.5,100", "2024-01-03,1,2,0.5,9,-1,100"])
    ingest.ingest_available(spark, str(raw), done, mark)
    ingest.ingest_available(spark, str(raw), done, mark)  # nothing new
    got = sorted(map(tuple, spark.read.parquet(done).select(*prices.COLUMNS).collect()))
    wanted = sorted(map(tuple, prices.clean_prices(prices.scan_csv(spark, f"{raw}/*.csv")).collect()))
    assert got == wanted and len(got) == 2


def test_inspection(spark):
    df = spark.createDataFrame([("A", k, float(k), float(k % 3)) for k in range(10)] + [("B", 0, None, float("nan"))], "ticker string, date int, x double, y double")
    nulls = {r["column"]: r for r in inspection.null_counts(df, ["x", "y"]).collect()}
    assert (nulls["x"]["n_null"], nulls["y"]["n_nan"]) == (1, 1)
    q = {r["p"]: r["value"] for r in inspection.quantiles(df, "x", (0.0, 0.5, 1.0)).collect()}
    assert q[0.0] == 0.0 and q[1.0] == 9.0 and q[0.5] in (4.0, 5.0)
    corr = {(r["a"], r["b"]): r["corr"] for r in inspection.correlation_matrix(df, ["x", "y"]).collect()}
    x = np.arange(10.0)
    assert corr["x", "y"] == pytest.approx(np.corrcoef(x, x % 3)[0, 1]) and corr["x", "x"] == pytest.approx(1.0)
    assert inspection.unique_counts(df).first()["n_rows"] == 11
    assert sum(r["n"] for r in inspection.histogram(df, "x", 0.0, 9.0, 3).collect()) == 10
    assert inspection.latest(df).count() == 1
    wide = panels.wide(df, "x", ["A", "B"])
    assert wide.columns == ["date", "A", "B"] and wide.count() == 10


@pytest.mark.parametrize("few", [10, 0])
def test_order_statistics(spark, monkeypatch, few):
    from panelkit.functions import quantiles as q

    monkeypatch.setattr(q, "ACCURACY", 200 if few == 0 else 5000)
    rng = np.random.default_rng(4)
    values = np.concatenate([rng.normal(size=20_000), np.zeros(5000), np.full(4000, 2.0)])
    long = spark.createDataFrame([("x", float(v)) for v in values] + [("one", 3.0)], "column string, value double")
    points = [0.0, 0.01, 0.37, 0.5, 0.8, 0.999, 1.0]
    got = {(r["column"], r["p"]): r["value"] for r in q.linear_quantiles(long, points).collect()}
    for p in points:
        assert got["x", p] == pytest.approx(np.quantile(values, p), abs=1e-12) and got["one", p] == 3.0
    nearest = {r["p"]: r["value"] for r in q.order_statistics(long.where("column = 'x'"), points, F.round(F.col("p") * (F.col("n") - 1))).collect()}
    ordered = np.sort(values)
    for p in points:
        assert nearest[p] == ordered[int(np.floor(p * (len(values) - 1) + 0.5))]


def test_half_years(spark):
    df = spark.createDataFrame([("2024-06-30", 1.0), ("2024-07-01", 2.0), ("2024-12-31", 4.0)], "d string, x double").select(F.to_date("d").alias("date"), "x")
    assert sorted((str(r["period"]), r["mean"], r["n"]) for r in inspection.half_years(df, "x").collect()) == [("2024-01-01", 1.0, 1), ("2024-07-01", 3.0, 2)]


def test_risk():
    low, high = risk.marchenko_pastur_bounds(100, 400)
    assert (low, high) == pytest.approx((0.25, 2.25))
    rng = np.random.default_rng(1)
    x = rng.normal(size=(300, 20)) + 0.8 * rng.normal(size=(300, 1))
    corr = np.corrcoef(x.T)
    cleaned = risk.clean_correlation_matrix(corr, 300)
    assert np.allclose(np.diag(cleaned), 1) and np.linalg.eigvalsh(cleaned).min() > 0
    assert risk.absorption_ratio(corr, 20) == pytest.approx(1.0) and 0.2 < risk.absorption_ratio(corr, 1) < 1
    block = np.kron(np.eye(3), np.full((4, 4), 0.9)) + 0.05
    names = risk.louvain_clustering(block)
    assert len(set(names)) == 3 and all(len(set(names[k : k + 4])) == 1 for k in (0, 4, 8))


def test_all_correlations_equal_the_pairwise_ones(spark, monkeypatch):
    monkeypatch.setattr(risk, "BLOCK", 3)
    rng = np.random.default_rng(5)
    rows = [(f"t{t}", d, None if rng.random() < 0.1 else float(rng.normal())) for t in range(20) for d in range(30) if rng.random() < 0.8]
    rows += [("flat", d, 0.1) for d in range(30)] + [("steps", d, 0.1 if d < 15 else 0.3) for d in range(30)] + [("half", d, float(d % 4)) for d in range(15)]
    rows += [("once", 3, 1.0), ("empty", 4, None), ("apart", 99, 1.0)]
    df = spark.createDataFrame(rows, "ticker string, date int, x double")
    got = {(r["i"], r["j"]): r["corr"] for r in risk.all_correlations(df, "x").collect()}
    wanted = {(r["i"], r["j"]): r["corr"] for r in risk.pairwise_correlations(df, "x", sorted({r[0] for r in rows})).collect()}
    assert got.keys() == wanted.keys() and len(got) > 20 * 19 / 2
    assert got["flat", "t1"] is None and got["half", "steps"] is None
    for k, v in wanted.items():
        assert got[k] is None if v is None else got[k] == pytest.approx(v, abs=1e-9), k


def test_all_correlations_move_series_not_cells(spark, monkeypatch):
    """Rows moved: a series once for each block, where every one of its cells went to each block."""
    monkeypatch.setattr(risk, "BLOCK", 3)
    tickers, dates = 60, 200
    df = spark.range(tickers * dates).selectExpr(f"cast(id % {tickers} as string) AS ticker", f"cast(id / {tickers} as int) AS date", "sin(id * id) AS x").localCheckpoint()
    moved = lambda: sum(s.shuffleWriteRecords() for s in stages())

    def stages():
        sc = spark.sparkContext
        some = sc._jsc.sc().statusStore().stageList(None, False, False, sc._gateway.new_array(sc._jvm.double, 0), None)
        return [some.apply(k) for k in range(some.size())]

    sc = spark.sparkContext._jsc.sc()
    sc.listenerBus().waitUntilEmpty()
    before = moved()
    assert risk.all_correlations(df, "x").count() == tickers * (tickers - 1) // 2
    sc.listenerBus().waitUntilEmpty()
    assert 0 < moved() - before < tickers * dates


def test_rounded_correlations_equal_rounded(spark):
    rng = np.random.default_rng(8)
    ties = [k / 2e9 for k in range(-2001, 2001)] + [0.1234567885, -0.9999999995, 0.0000000005, 1.0, -1.0, -0.0, None, -1e-12]
    df = spark.createDataFrame([(x,) for x in [*ties, *map(float, rng.uniform(-1, 1, 5000))]], "corr double")
    for digits in (6, 9):
        assert [str(r[0]) for r in rounded_correlations(df, digits).collect()] == [str(r[0]) for r in rounded(df, digits).collect()]


def test_whole_matrix_operators_equal_numpy(spark):
    rng = np.random.default_rng(6)
    x = rng.normal(size=(40, 12)) + rng.normal(size=(40, 3)).repeat(4, axis=1)
    df = spark.createDataFrame([(f"t{t:02}", d, float(x[d, t])) for t in range(12) for d in range(40)], "ticker string, date int, x double")
    corr = np.corrcoef(x.T)
    values, vectors = np.linalg.eigh(corr)
    low = values <= (1 + np.sqrt(12 / 40)) ** 2
    rest = (vectors * np.where(low, values[low].mean(), values)) @ vectors.T
    wanted = rest / np.sqrt(np.outer(np.diag(rest), np.diag(rest)))
    got = {(r["i"], r["j"]): r["corr"] for r in risk.cleaned_correlations(df, "x").collect()}
    assert len(got) == 66 and all(v == pytest.approx(wanted[int(i[1:]), int(j[1:])], abs=1e-9) for (i, j), v in got.items())
    assert risk.absorption(df, "x", 3).first()["absorption"] == pytest.approx(values[-3:].sum() / 12)
    member = {r["ticker"]: r["community"] for r in risk.communities(df, "x").collect()}
    groups = [{member[f"t{t:02}"] for t in range(k, k + 4)} for k in (0, 4, 8)]
    assert len(member) == 12 and all(len(g) == 1 for g in groups) and len(set.union(*groups)) == 3
    none = df.where("false")
    assert risk.cleaned_correlations(none, "x").count() == risk.communities(none, "x").count() == 0
    assert risk.absorption(none, "x", 3).first()["absorption"] is None


@pytest.fixture(scope="module")
def many():
    """More tickers than a matrix taken apart whole: 2,100 of three groups, some without a date, one constant, one empty; as rows and as the matrix."""
    rng = np.random.default_rng(9)
    x = rng.normal(size=(2100, 12)) + 1.5 * rng.normal(size=(3, 12)).repeat(700, axis=0)
    some = rng.random(2100) < 0.1
    x[some, rng.integers(0, 4, some.sum())] = np.nan
    x[40:60, 5:8], x[7], x[8] = np.nan, 0.1, np.nan
    corr = np.eye(2100)
    for i in range(2100):
        known = np.isfinite(x[i]) & np.isfinite(x)
        with np.errstate(all="ignore"):
            n = known.sum(axis=1)
            u, v = np.where(known, x[i], 0), np.where(known, x, 0)
            u, v = np.where(known, u - (u.sum(axis=1) / n)[:, None], 0), np.where(known, v - (v.sum(axis=1) / n)[:, None], 0)
            c = (u * v).sum(axis=1) / np.sqrt((u * u).sum(axis=1) * (v * v).sum(axis=1))
        corr[i] = np.where(np.isfinite(c) & (np.arange(2100) != 7) & (i != 7), c, 0)
    np.fill_diagonal(corr, 1)
    return pa.table({"ticker": [f"t{t:04}" for t in range(2100) for _ in range(12)], "date": list(range(12)) * 2100, "x": pa.array(x.ravel(), from_pandas=True)}), corr


def test_absorption_of_many_tickers(spark, many):
    table, corr = many
    wanted = np.linalg.eigvalsh(corr)[-5:].sum() / 2100
    assert risk.absorption(spark.createDataFrame(table), "x", 5).first()["absorption"] == pytest.approx(wanted, abs=1e-9)
    none = spark.createDataFrame(table).withColumn("x", F.lit(None).cast("double"))
    assert risk.absorption(none, "x", 5).first()["absorption"] == pytest.approx(5 / 2100)


def test_cleaned_correlations_of_many_tickers(spark, many):
    table, corr = many
    got = risk.cleaned_correlations(spark.createDataFrame(table), "x").toArrow()
    i, j = (np.array([int(t[1:]) for t in got.column(c).to_pylist()]) for c in ("i", "j"))
    assert len(got) == 2100 * 2099 // 2 == len(set(zip(i.tolist(), j.tolist(), strict=True))) and (i < j).all()
    assert np.abs(got.column("corr").to_numpy() - risk.clean_correlation_matrix(corr, 12)[i, j]).max() < 1e-8


def test_communities_of_many_tickers(spark, many):
    table, corr = many
    member = {r["ticker"]: r["community"] for r in risk.communities(spark.createDataFrame(table), "x").collect()}
    got = [member[f"t{t:04}"] for t in range(2100)]
    assert got == risk.louvain_clustering(corr) and 3 <= len(set(got)) < 20


def test_communities_by_kept_links_are_those_by_weights():
    rng = np.random.default_rng(4)
    weight = np.clip(np.corrcoef(rng.normal(size=(300, 40))), 0, None)
    np.fill_diagonal(weight, 0)
    for resolution in (0.5, 1.0, 2.0):
        kept = risk._louvain(lambda: iter([(0, weight[:100]), (100, weight[100:])]), 300, resolution, lambda k: weight[k])
        assert kept == risk.louvain_clustering(weight, resolution)


def test_communities_make_few_rows_anew(many):
    """Rows of weights that are made one list at a time: not one by one for each move, and the same communities."""
    weight = np.clip(many[1], 0, None) * (np.random.default_rng(2).random((2100, 2100)) < 0.5)
    weight = np.maximum(weight, weight.T)
    np.fill_diagonal(weight, 0)
    asked = []

    def row(k):
        asked.append(np.size(k))
        return weight[k]

    kept = risk._louvain(lambda: iter([(0, weight)]), 2100, 1.0, row, lambda some, block: weight[some, block])
    assert kept == risk.louvain_clustering(weight) and sum(asked) > 4 * len(asked)


def test_correlations_by_masks_equal_those_by_pairs():
    """Sums over common dates are made once for each list of dates; a series whose variance is in one date that others miss is made anew."""
    rng = np.random.default_rng(3)
    x = rng.normal(size=(60, 12))
    x[10:30, 3], x[20:40, [0, 5]], x[40:44, 2:11] = np.nan, np.nan, np.nan
    x[44], x[45, :11], x[46, 3] = 0.1, 0.1, 1e9
    for a, b in ((slice(0, 60), slice(0, 60)), (slice(0, 10), slice(10, 60)), (slice(50, 60), slice(0, 10))):
        side = risk._Side(x)
        for u, v in ((side.cut(a), side.cut(b)), (risk._Side(x[a]), risk._Side(x[b]))):
            got = risk._correlations(u, v)
            for i, j in np.ndindex(got.shape):
                known = np.isfinite(x[a][i]) & np.isfinite(x[b][j])
                p, q = x[a][i][known], x[b][j][known]
                if known.sum() < 2 or np.ptp(p) == 0 or np.ptp(q) == 0:
                    assert np.isnan(got[i, j])
                else:
                    assert got[i, j] == pytest.approx(np.corrcoef(p, q)[0, 1], abs=1e-7)


def test_csv_folders_of_odd_tickers_come_back(spark, tmp_path):
    rows = [("A/B", "2020-01-02", 1.5, 2.0, 1.0, 9.0, 1.25, 10), ("BRK.B", "2020-01-03", 1.5, 2.0, 1.0, 9.0, 1.75, 20), ("x y%", "2020-01-03", 1.0, 1.0, 1.0, 1.0, -1.0, 5)]
    raw = spark.createDataFrame(rows, "ticker string, Date string, Open double, High double, Low double, Close double, `Adj Close` double, Volume long")
    prices.write_csv_per_ticker(raw, str(tmp_path / "raw"))
    got = prices.etl(spark, f"{tmp_path}/raw/*/*.csv", str(tmp_path / "prices")).collect()
    assert sorted((r["ticker"], str(r["date"]), r["close"], r["volume"]) for r in got) == [("A/B", "2020-01-02", 1.25, 10), ("BRK.B", "2020-01-03", 1.75, 20)]


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() == 1
    names = entry.queries()
    assert set(entry.oracle_sql()) <= set(names)
