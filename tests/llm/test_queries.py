from __future__ import annotations

import os

import pytest

from panelkit.llm.queries import oracle_sql, queries
from tests.compare import differing_rows

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
@pytest.mark.parametrize("name", sorted(oracle_sql()))
def test_query_equals_its_sql(spark, name):
    rows, mine, wanted = differing_rows(queries()[name](spark, SF), oracle_sql()[name], SF)
    assert rows > 0 and mine == [] and wanted == []


def test_one_query_per_operator():
    assert sorted(int(n[2:].split("_")[0]) for n in queries()) == list(range(1, 11))
