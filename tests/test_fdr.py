from __future__ import annotations

import math
import random

import numpy as np
import pytest

from panelkit.operators import fdr
from tests.panels import PVALUES, q_values, step_up


def _frame(spark, p):
    return spark.createDataFrame([(f"s{k}", 0.0, x) for k, x in enumerate(p)], "signal string, tstat double, pvalue double")


@pytest.mark.parametrize("name", PVALUES)
def test_report(spark, name):
    p = PVALUES[name]
    bh, by, q = step_up(p, fdr.ALPHA, False), step_up(p, fdr.ALPHA, True), q_values(p)
    assert (bh, by) == {"tiny": (4, 4), "large": (0, 0), "one": (1, 1), "equal": (5, 0), "on_the_line": (2, 0), "missing": (2, 2), "nothing": (0, 0), "bh_alone": (4, 0)}[name]
    rows = fdr.fdr_report(_frame(spark, p)).collect()
    assert len(rows) == len(p)
    assert sum(r["survives_bh"] for r in rows) == bh and sum(r["survives_by"] for r in rows) == by
    assert all(r["survives_bh"] or not r["survives_by"] for r in rows)
    known = [r for r in rows if r["pvalue"] is not None and not math.isnan(r["pvalue"])]
    assert [r["qvalue"] for r in known] == pytest.approx(q, abs=1e-6)
    assert all(r["qvalue"] is None and not r["survives_bh"] for r in rows if r not in known)
    assert rows[: len(known)] == known  # missing ones last


def test_null_fails_closed(spark):
    rows = fdr.fdr_report(_frame(spark, [0.01, None])).collect()
    assert [r["survives_bh"] for r in rows] == [True, False]


def test_q_rises_with_p(spark):
    rng = random.Random(2)
    rows = fdr.qvalues(_frame(spark, [rng.random() ** 2 for _ in range(200)])).orderBy("pvalue").collect()
    q = [r["qvalue"] for r in rows]
    assert q == sorted(q)


def test_pi0(spark):
    assert fdr.estimate_pi0(_frame(spark, [0.5] * 5)).first()[0] == 1.0
    uniform = [(k + 0.5) / 400 for k in range(400)]
    assert fdr.estimate_pi0(_frame(spark, uniform)).first()[0] == pytest.approx(1.0, abs=0.02)
    spiked = [0.0001 * k for k in range(200)] + [(k + 0.5) / 200 for k in range(200)]
    assert fdr.estimate_pi0(_frame(spark, spiked)).first()[0] < 0.6
    assert sum(fdr.smoothing_weights()) == pytest.approx(1.0)
    assert fdr.smoothing_weights()[0] == pytest.approx(-0.0929596719, abs=1e-9) and fdr.smoothing_weights()[-1] == pytest.approx(0.5816814764, abs=1e-9)
    p = np.array(spiked)
    shares = [(p > lam).mean() / (1 - lam) for lam in fdr.LAMBDAS]
    wanted = np.polyval(np.polyfit(fdr.LAMBDAS, shares, 3), fdr.LAMBDAS[-1])
    assert fdr.estimate_pi0(_frame(spark, spiked)).first()[0] == pytest.approx(wanted, abs=1e-9)
