"""Small panels of (ticker, date, feat) rows by name, p-values by name, and what is expected of them by plain Python.

All values are made up here. Expectations are computed by the definitions, with lists and loops, not by the engine.
"""

from __future__ import annotations

import math
import statistics


def _cross(*values):
    """One date; tickers by letter."""
    return [(f"T{k}", 7, value) for k, value in enumerate(values)]


def _walks(starts: dict[str, float], dates: dict[str, range], step: float):
    return [(t, d, start + step * math.sin(3.0 * d + len(t) + start)) for t, start in starts.items() for d in dates[t]]


_STARTS = {"oak": -2.5, "elm": 0.25, "fir": 6.0, "ash": 17.5, "yew": 3.75}
PANELS = {
    "spread_out": _cross(-4.5, 0.25, 2.0, 6.75, 19.0),
    "many_dates": _walks(_STARTS, dict.fromkeys(_STARTS, range(5)), 1.5),
    "ragged": _walks(_STARTS, dict(zip(_STARTS, (range(5), range(2, 5), range(3), range(1, 4), range(4, 5)), strict=True)), 0.75),
    "one_row": _cross(-3.25),
    "one_ticker": _walks({"oak": 1.0}, {"oak": range(6)}, 2.0),
    "all_equal": _cross(1.5, 1.5, 1.5),
    "some_missing": _cross(None, 8.5, None, -1.0, 4.25),
    "more_than_buckets": _cross(*[((5 * k) % 13) / 4 for k in range(13)]),
    "tied": _cross(0.5, 2.5, 0.5, 2.5, 2.5, 9.0, -1.0),
}


def quantile(values: list[float], share: float) -> float:
    """Linear between neighbours in order."""
    at = share * (len(values) - 1)
    low = sorted(values)[math.floor(at)]
    return low + (sorted(values)[math.ceil(at)] - low) * (at - math.floor(at))


def expected(values: list, method: str, n_buckets: int = 10) -> list:
    """A signal of one date's values."""
    there = [x for x in values if x is not None]
    deviation = statistics.stdev(there) if len(there) > 1 else 0.0
    out = []
    for x in values:
        if x is None:
            out.append(None)
        elif method == "rank":
            place = sum(y < x for y in there) + (sum(y == x for y in there) - 1) / 2
            out.append(2 * place / (len(values) - 1) - 1 if len(values) > 1 else None)
        elif method == "decile":
            out.append(1 if x > quantile(there, 1 - 1 / n_buckets) else -1 if x <= quantile(there, 1 / n_buckets) else 0)
        elif deviation == 0:
            out.append(None)
        else:
            z = (x - statistics.fmean(there)) / deviation
            out.append(math.tanh(z) if method == "zscore_tanh" else z)
    return out


ONE_DATE = [name for name, rows in PANELS.items() if len({d for _, d, _ in rows}) == 1]

NAN = float("nan")
PVALUES = {
    "tiny": [2e-6, 7e-5, 3e-4, 4e-4],
    "large": [0.33, 0.61, 0.58, 0.97, 0.82, 0.74],
    "one": [0.021],
    "equal": [0.027] * 5,
    "on_the_line": [0.0125, 0.025, 0.0376, 0.9],  # the first two lie on their thresholds, the third just above
    "missing": [NAN, 0.0007, 0.36, NAN, 0.011],
    "nothing": [],
    "bh_alone": [0.0061, 0.012, 0.0155, 0.023, 0.041, 0.27, 0.44, 0.66],
}


def step_up(p: list[float], alpha: float, harmonic: bool) -> int:
    """How many survive."""
    ranked = sorted(x for x in p if not math.isnan(x))
    m = len(ranked)
    scale = sum(1 / i for i in range(1, m + 1)) if harmonic else 1
    return max((i for i, x in enumerate(ranked, 1) if x <= alpha * (i / m) / scale), default=0)


def q_values(p: list[float]) -> list[float]:
    """In the order of the p-values, all tests taken as null."""
    ranked = sorted(x for x in p if not math.isnan(x))
    return [min([x * len(ranked) / i for i, x in enumerate(ranked, 1) if i >= k] + [ranked[-1]]) for k in range(1, len(ranked) + 1)]
