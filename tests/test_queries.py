from __future__ import annotations

import os

import pytest

from panelkit.plans.oracle import ORACLE
from panelkit.plans.queries import QUERIES
from panelkit.sources import panels
from tests.compare import differing_rows

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


#: Eigenvalues and communities can't be said in SQL; tests/test_rest.py has them against numpy.
NO_SQL = {"cleaned_correlations", "absorption", "communities"}


def test_every_query_has_sql():
    assert set(QUERIES) == set(ORACLE) | NO_SQL


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
@pytest.mark.parametrize("name", ORACLE)
def test_query_equals_its_sql(spark, name):
    rows, mine, wanted = differing_rows(QUERIES[name](spark, SF), ORACLE[name], SF)
    assert rows > 0 and mine == [] and wanted == []


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
def test_the_wide_panel_has_every_cell(spark):
    cells = panels.wide_cells(QUERIES["panel_daily"](spark, SF), "close").selectExpr("date", "inline(cells)").select("ticker", "date", "value")
    wanted = QUERIES["panel_daily"](spark, SF).select("ticker", "date", "close")
    assert QUERIES["pivot_wide"](spark, SF).selectExpr("sum(n_tickers)").first()[0] == wanted.count()
    assert wanted.select("ticker").distinct().count() > 5
    assert cells.exceptAll(wanted).isEmpty() and wanted.exceptAll(cells).isEmpty()


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
def test_all_windows_are_built(spark):
    built = {f"{c}{n}" for c in ("mom", "std", "log_adv") for n in (5, 10, 20, 60, 120, 252)} | {"beta60", "beta252"}
    assert built <= set(QUERIES["features_all"](spark, SF).columns)
