"""DuckDB SQL of the queries in ``queries``, written for itself."""

from __future__ import annotations

from statistics import NormalDist

# Fixed values, written here for themselves and not taken from the engine: 1463 times the weights of the least-squares
# cubic's last value over 19 even steps (exact integers), and the published constants of a rational approximation to the
# normal tail, with where it ends.
CUBIC_END = (-136, -16, 59, 96, 102, 84, 49, 4, -44, -88, -121, -136, -126, -84, -3, 124, 304, 544, 851)
TAIL_TOP = ("0.0352624965998911", "0.700383064443688", "6.37396220353165", "33.912866078383", "112.079291497871", "221.213596169931", "220.206867912376")
TAIL_BOTTOM = ("0.0883883476483184", "1.75566716318264", "16.064177579207", "86.7807322029461", "296.564248779674", "637.333633378831", "793.826512519948", "440.413735824752")
TAIL_FAR, TAIL_NONE, ROOT_OF_TWO_PI = "7.07106781186547", "37", "2.5066282746310002"

DAILY = """
p AS (
  SELECT CAST(user_id AS VARCHAR) AS ticker, CAST(ts AS DATE) AS date,
         arg_min(value, row(ts, event_id)) AS open, max(value) AS high, min(value) AS low,
         arg_max(value, row(ts, event_id)) AS close, CAST(count(*) AS BIGINT) AS volume
  FROM events GROUP BY 1, 2
  HAVING arg_max(value, row(ts, event_id)) > 0
)"""


def _shipments(period: str) -> str:
    return f"""
p AS (
  SELECT CAST(l_suppkey AS VARCHAR) AS ticker, CAST(date_trunc('{period}', l_shipdate) AS DATE) AS date,
         arg_min(l_extendedprice / l_quantity, row(l_shipdate, l_orderkey, l_linenumber)) AS open,
         max(l_extendedprice / l_quantity) AS high, min(l_extendedprice / l_quantity) AS low,
         CAST(sum(CAST(l_extendedprice AS DECIMAL(18,2))) AS DOUBLE) / CAST(sum(CAST(l_quantity AS DECIMAL(18,2))) AS DOUBLE) AS close,
         CAST(sum(CAST(l_quantity AS DECIMAL(18,2))) AS BIGINT) AS volume
  FROM lineitem GROUP BY 1, 2
)"""


WEEKLY, MONTHLY = _shipments("week"), _shipments("month")
RETURNS = """
r AS (SELECT *, ln(close) - ln(lag(close) OVER (PARTITION BY ticker ORDER BY date)) AS logret FROM p)"""


def _w(n: int) -> str:
    return f"(PARTITION BY ticker ORDER BY date ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW)"


BASE = (
    RETURNS
    + """,
b AS (
  SELECT ticker, date, close, logret, lead(logret) OVER w AS fwdret, close / lag(close, 5) OVER w - 1 AS mom5,
         CASE WHEN count(logret) OVER """
    + _w(5)
    + " = 5 THEN stddev_samp(logret) OVER "
    + _w(5)
    + """ END AS std5
  FROM r WINDOW w AS (PARTITION BY ticker ORDER BY date)
)"""
)


def r(x: str, digits: int = 9) -> str:
    return f"(round({x}, {digits}) + 0.0)"


def on(panel: str, *steps: str) -> str:
    return "WITH " + ",".join([panel, *steps]) + "\n"


def feature(columns: dict[str, str], panel: str = DAILY, digits: int = 9, source: str = "r", *steps: str) -> str:
    cols = ", ".join(f"{r(x, digits)} AS {name}" for name, x in columns.items())
    return on(panel, RETURNS, *steps) + f"SELECT ticker, date, {cols} FROM {source}"


def full(fn: str, x: str, n: int) -> str:
    return f"CASE WHEN count({x}) OVER {_w(n)} = {n} THEN {fn} OVER {_w(n)} END"


def lagged(n: int) -> str:
    return f"close / lag(close, {n}) OVER (PARTITION BY ticker ORDER BY date) - 1"


def market(panel: str, least: int) -> str:
    return f"""
mk AS (SELECT date AS kdate, CASE WHEN count(logret) >= {least} THEN avg(logret) END AS mkt, CAST(count(logret) AS BIGINT) AS nt FROM r GROUP BY date)"""


def beta(windows: tuple[int, ...], panel: str, least: int, digits: int = 6) -> str:
    var = ", ".join(f"CASE WHEN count(mkt) OVER (ORDER BY kdate ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW) = {n} THEN var_samp(mkt) OVER (ORDER BY kdate ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW) END AS v{n}" for n in windows)
    out = ", ".join(r(f"CASE WHEN count(logret + mkt) OVER {_w(n)} = {n} THEN covar_samp(logret, mkt) OVER {_w(n)} END / nullif(v{n}, 0)", digits) + f" AS beta{n}" for n in windows)
    return on(panel, RETURNS, market(panel, least)) + f""", mv AS (SELECT kdate, mkt, nt, {var} FROM mk), j AS (SELECT r.*, mkt, nt, {', '.join(f'v{n}' for n in windows)} FROM r LEFT JOIN mv ON r.date = mv.kdate)
SELECT ticker, date, {out} FROM j"""


def signal(x: str, name: str, cast: str = "") -> str:
    return on(DAILY, BASE) + f"SELECT ticker, date, {x if cast else r(x)} AS {name} FROM b"


Z = "CASE WHEN stddev_samp({x}) OVER d > 0 THEN ({x} - avg({x}) OVER d) / stddev_samp({x}) OVER d END"


def z(x: str = "mom5", sign: str = "") -> str:
    return f"{sign}(" + Z.format(x=x).replace("OVER d", "OVER (PARTITION BY date)") + ")"


def rank(x: str, keys: str = "date", order: str = "") -> str:
    return f"CASE WHEN {x} IS NOT NULL THEN CAST(rank() OVER (PARTITION BY {keys} ORDER BY {x} {order} NULLS LAST) AS DOUBLE) + (count(*) OVER (PARTITION BY {keys}, {x}) - 1) / 2.0 END"


def scaled(x: str, keys: str = "date") -> str:
    return f"2.0 * (({rank(x, keys)}) - 1) / nullif(CAST(count(*) OVER (PARTITION BY {keys}) - 1 AS DOUBLE), 0) - 1"


def decile(x: str, n: int = 10, keys: str = "date") -> str:
    q = f"quantile_cont({x}, [{1 / n!r}::DOUBLE, {(n - 1) / n!r}::DOUBLE]) OVER (PARTITION BY {keys})"
    return f"CASE WHEN {x} IS NULL THEN NULL WHEN {x} > ({q})[2] THEN 1 WHEN {x} <= ({q})[1] THEN -1 ELSE 0 END"


def pearson(x: str, y: str) -> str:
    both = f"FILTER (WHERE {x} IS NOT NULL AND {y} IS NOT NULL)"
    return f"covar_pop(CAST({x} AS DOUBLE), CAST({y} AS DOUBLE)) / nullif(stddev_pop(CAST({x} AS DOUBLE)) {both} * stddev_pop(CAST({y} AS DOUBLE)) {both}, 0)"


def ic(x: str = "mom5", y: str = "fwdret", source: str = "b", keys: str = "date", name: str = "ic") -> str:
    """CTEs up to a table of ICs per key."""
    return f"""
c_{name} AS (SELECT {keys}, {x} AS x, {y} AS y FROM {source} WHERE {x} IS NOT NULL AND {y} IS NOT NULL),
k_{name} AS (SELECT {keys}, {rank('x', keys)} AS rx, {rank('y', keys)} AS ry FROM c_{name}),
{name} AS (SELECT {keys}, {pearson('rx', 'ry')} AS ic FROM k_{name} GROUP BY {keys})"""


def summary(source: str = "ic", keys: str = "") -> str:
    k = f"{keys}, " if keys else ""
    tail = f" GROUP BY {keys}" if keys else ""
    ir = "avg(ic) / nullif(stddev_samp(ic), 0)"
    return f"""SELECT {k}{r('avg(ic)')} AS mean, {r('stddev_samp(ic)')} AS std, {r(ir)} AS ir, {r(ir + ' * sqrt(CAST(count(ic) AS DOUBLE))')} AS t_stat,
       {r('avg(CASE WHEN ic > 0 THEN 1.0 WHEN ic IS NOT NULL THEN 0.0 END)')} AS hit_rate, CAST(count(ic) AS BIGINT) AS n_days FROM {source}{tail}"""


METHODS = {"zscore_tanh": f"tanh({z()})", "zscore_clip": f"greatest(-3.0, least(3.0, {z()}))", "rank": scaled("mom5"), "decile": decile("mom5")}


def by_method(methods: dict[str, str]) -> str:
    cols = ", ".join(f"CAST({x} AS DOUBLE) AS {m}" for m, x in methods.items())
    # a clip of a missing value is missing
    cols = cols.replace("CAST(greatest(", "CAST(CASE WHEN " + z() + " IS NOT NULL THEN greatest(").replace("))) AS DOUBLE) AS zscore_clip", "))) END AS DOUBLE) AS zscore_clip")
    rows = " UNION ALL ".join(f"SELECT '{m}' AS method, date, {m} AS value, fwdret FROM sg" for m in methods)
    return on(DAILY, BASE) + f", sg AS (SELECT *, {cols} FROM b), lg AS ({rows})," + ic("value", "fwdret", "lg", "method, date")


def newey_west(source: str = "ic", keys: str = "") -> str:
    """CTEs to ``nw``: mean, se, t_stat, max_lag, n."""
    part = f"PARTITION BY {keys} " if keys else ""
    k, a, g = (f"{keys}, ", f"a.{keys} = b.{keys} AND", f" GROUP BY {keys}") if keys else ("", "", "")
    return f"""
x AS (SELECT {k}row_number() OVER ({part}ORDER BY date) AS i, ic, ic - avg(ic) OVER ({part}) AS d FROM {source} WHERE ic IS NOT NULL),
pn AS (SELECT {k}count(*) AS n, greatest(1, CAST(floor(4 * power(count(*) / CAST(100 AS DOUBLE), CAST(2 AS DOUBLE) / 9)) AS INT)) AS l, avg(ic) AS m, sum(d * d) / count(*) AS g0 FROM x{g}),
ac AS (SELECT {'a.' + keys + ',' if keys else ''} sum((1 - (a.i - b.i) / CAST(pn.l + 1 AS DOUBLE)) * a.d * b.d) / max(pn.n) AS s
       FROM x a JOIN x b ON {a} a.i > b.i JOIN pn ON {'pn.' + keys + ' = a.' + keys + ' AND' if keys else ''} a.i - b.i <= pn.l{' GROUP BY a.' + keys if keys else ''}),
nv AS (SELECT pn.*, g0 + 2 * coalesce(s, 0) AS v FROM pn LEFT JOIN ac ON {'pn.' + keys + ' = ac.' + keys if keys else 'TRUE'}),
nw AS (SELECT {k}m AS mean, CASE WHEN v > 0 THEN sqrt(v / n) END AS se, m / nullif(CASE WHEN v > 0 THEN sqrt(v / n) END, 0) AS t_stat, l AS max_lag, CAST(n AS BIGINT) AS n FROM nv WHERE n >= 2)"""


WEEKLY_IC = on(WEEKLY, BASE) + "," + ic()
SPREAD = (
    on(DAILY, BASE)
    + f""", sd AS (SELECT date, fwdret AS f, {decile('mom5')} AS s FROM b),
sp AS (SELECT date, avg(f) FILTER (WHERE s = 1) AS long_ret, avg(-f) FILTER (WHERE s = -1) AS short_ret FROM sd
       GROUP BY date HAVING count(*) FILTER (WHERE s = 1) > 0 AND count(*) FILTER (WHERE s = -1) > 0),
sr AS (SELECT *, long_ret + short_ret AS spread_ret FROM sp)
"""
)
PVALUES = """WITH v AS (
  SELECT signal, CASE WHEN n % 11 <> 0 THEN ((n * n) % 97) * (n % 7) / 1000.0::DOUBLE END AS p
  FROM (SELECT signal, CAST(regexp_extract(signal, '(\\d+)', 1) AS BIGINT) AS n FROM (SELECT DISTINCT p_brand AS signal FROM part))
), k AS (SELECT *, row_number() OVER (ORDER BY p) AS i, count(*) OVER () AS n FROM v WHERE p IS NOT NULL)
"""
PI0 = "CASE WHEN count(p) < 20 THEN 1.0 ELSE least(greatest(" + " + ".join(f"({w!r}::DOUBLE) * avg(CASE WHEN p > {lam!r}::DOUBLE THEN 1.0 ELSE 0.0 END) / {1 - lam!r}::DOUBLE" for lam, w in [(0.05 * k, n / 1463) for k, n in enumerate(CUBIC_END, 1)]) + ", 0.0), 1.0) END"
FDR = (
    PVALUES
    + f""", pz AS (SELECT CAST({PI0} AS DOUBLE) AS pi0 FROM k),
h AS (SELECT sum(1.0::DOUBLE / i) AS hm FROM k),
cut AS (SELECT coalesce(max(i) FILTER (WHERE p <= 0.2::DOUBLE * (i / CAST(n AS DOUBLE))), 0) AS bh,
               coalesce(max(i) FILTER (WHERE p <= 0.2::DOUBLE * (i / CAST(n AS DOUBLE)) / hm), 0) AS by_ FROM k, h),
q AS (SELECT signal, i, min(pi0 * n * p / i) OVER (ORDER BY i DESC ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS q FROM k, pz),
out AS (SELECT v.signal, v.p, coalesce(k.i <= bh, FALSE) AS survives_bh, coalesce(k.i <= by_, FALSE) AS survives_by, q.q
        FROM v CROSS JOIN cut LEFT JOIN k ON k.signal = v.signal LEFT JOIN q ON q.signal = v.signal)
"""
)


def tail(x: str) -> str:
    """Two-sided normal p-value of a t-statistic, by Horner's rule in SQL."""
    a = f"abs({x})"

    def horner(values: tuple[str, ...]) -> str:
        out = f"{values[0]}::DOUBLE"
        for v in values[1:]:
            out = f"({out} * {a} + {v}::DOUBLE)"
        return out

    e = f"exp(-{a} * {a} / 2)"
    far = f"{e} / ({a} + 1 / ({a} + 2 / ({a} + 3 / ({a} + 4 / ({a} + 0.65::DOUBLE))))) / {ROOT_OF_TWO_PI}::DOUBLE"
    return f"2 * CASE WHEN {x} IS NULL THEN NULL WHEN {a} > {TAIL_NONE}::DOUBLE THEN 0 WHEN {a} < {TAIL_FAR}::DOUBLE THEN {e} * {horner(TAIL_TOP)} / {horner(TAIL_BOTTOM)} ELSE {far} END"


def decay(horizons: tuple[int, ...]) -> str:
    sums = ", ".join(f"CASE WHEN count(logret) OVER (PARTITION BY ticker ORDER BY date ROWS BETWEEN 1 FOLLOWING AND {h} FOLLOWING) = {h} THEN sum(logret) OVER (PARTITION BY ticker ORDER BY date ROWS BETWEEN 1 FOLLOWING AND {h} FOLLOWING) END AS f{h}" for h in horizons)
    rows = " UNION ALL ".join(f"SELECT CAST({h} AS INT) AS horizon, date, mom5, f{h} AS f FROM ah" for h in horizons)
    return on(DAILY, BASE) + f", ah AS (SELECT *, {sums} FROM b), lh AS ({rows})," + ic("mom5", "f", "lh", "horizon, date") + f", s AS ({summary('ic', 'horizon')}) SELECT horizon, mean, std, ir, hit_rate, n_days FROM s"


def report(names: tuple[str, ...]) -> str:
    rows = " UNION ALL ".join(f"SELECT '{c}' AS signal, ticker, date, {c} AS value, fwdret FROM b" for c in names)
    return (
        on(DAILY, BASE)
        + f", lg AS ({rows}),"
        + ic("value", "fwdret", "lg", "signal, date")
        + f", s AS ({summary('ic', 'signal').replace(', 9)', ', 12)')}),"
        + newey_west("ic", "signal")
        + f""", lc AS (SELECT signal, ic, lag(ic) OVER (PARTITION BY signal ORDER BY date) AS l FROM ic),
lr AS (SELECT signal, {pearson('ic', 'l')} AS ac FROM lc GROUP BY signal),
cv AS (SELECT signal, avg(CASE WHEN value IS NOT NULL THEN 1.0 ELSE 0.0 END) AS cov FROM lg WHERE date >= (SELECT max(date) FROM lg) - 365 GROUP BY signal),
tc AS (SELECT signal, date, abs(value - lag(value) OVER (PARTITION BY signal, ticker ORDER BY date)) AS c FROM lg),
tv AS (SELECT signal, avg(t) AS tv FROM (SELECT signal, date, avg(c) AS t FROM tc GROUP BY 1, 2) GROUP BY signal),
sd AS (SELECT signal, date, fwdret AS f, {decile('value', 10, 'signal, date')} AS s FROM lg),
sp AS (SELECT signal, date, avg(f) FILTER (WHERE s = 1) + avg(-f) FILTER (WHERE s = -1) AS x FROM sd GROUP BY 1, 2),
cs AS (SELECT signal, date, x, sum(x) OVER (PARTITION BY signal ORDER BY date ROWS UNBOUNDED PRECEDING) AS c FROM sp WHERE x IS NOT NULL),
dd AS (SELECT signal, x, c - max(c) OVER (PARTITION BY signal ORDER BY date ROWS UNBOUNDED PRECEDING) AS d FROM cs),
ls AS (SELECT signal, avg(x) / nullif(stddev_pop(x), 0) * sqrt(252.0) AS sh, min(d) AS mdd FROM dd GROUP BY signal)
SELECT s.signal, {r('s.mean', 7)} AS ic_mean, {r('s.std', 7)} AS ic_std, {r('s.ir', 7)} AS ic_ir, {r('s.t_stat', 7)} AS ic_tstat_naive,
       {r('nw.t_stat', 7)} AS ic_tstat_nw, {r(tail('nw.t_stat'), 7)} AS ic_pval_nw, {r('ac', 7)} AS ic_lag1_autocorr, {r('hit_rate', 7)} AS hit_rate, n_days,
       {r('cov', 7)} AS recent_coverage, {r('tv', 7)} AS avg_turnover, {r('sh', 7)} AS long_short_sharpe, {r('mdd', 7)} AS long_short_max_dd
FROM s JOIN nw USING (signal) JOIN lr USING (signal) JOIN cv USING (signal) JOIN tv USING (signal) JOIN ls USING (signal)"""
    )


def bucket(x: str, n: int) -> str:
    q = f"quantile_cont({x}, [{', '.join(f'{k / n!r}::DOUBLE' for k in range(1, n))}]) OVER (PARTITION BY date)"
    return f"CASE WHEN {x} IS NOT NULL THEN len(list_filter({q}, lambda e: {x} > e)) END"


FOLDS = (
    on(WEEKLY)
    + """, c AS (SELECT date, row_number() OVER (ORDER BY date) - 1 AS i FROM (SELECT DISTINCT date FROM p)),
s AS (SELECT unnest(range(56, (SELECT count(*) FROM c) - 13 + 1, 16)) AS s),
f AS (SELECT row_number() OVER (ORDER BY s) - 1 AS fold, s FROM s),
fo AS (SELECT fold, a.date AS train_start, b.date AS train_end, d.date AS test_start, e.date AS test_end
       FROM f JOIN c a ON a.i = s - 56 JOIN c b ON b.i = s - 5 JOIN c d ON d.i = s JOIN c e ON e.i = s + 12)
"""
)


def quantile_rows(columns: tuple[str, ...], points: tuple[float, ...]) -> str:
    one = [f"SELECT '{c}' AS \"column\", {p!r}::DOUBLE AS p, v FROM (SELECT {c} AS v, row_number() OVER (ORDER BY {c}) AS i, count(*) OVER () AS n FROM b WHERE {c} IS NOT NULL) WHERE i = CAST(round({p!r}::DOUBLE * (n - 1)) AS BIGINT) + 1" for c in columns for p in points]
    return on(DAILY, BASE) + f'SELECT "column", {r("p")} AS p, {r("v")} AS value FROM (' + " UNION ALL ".join(one) + ")"


def corr_rows(columns: tuple[str, ...]) -> str:
    one = [f"SELECT '{a}' AS a, '{b}' AS b, {r(pearson(a, b))} AS corr FROM cc" for a in columns for b in columns]
    return on(DAILY, BASE) + ", cc AS (SELECT * FROM b WHERE " + " AND ".join(f"{c} IS NOT NULL" for c in columns) + ") " + " UNION ALL ".join(one)


def all_features(windows: tuple[int, ...], betas: tuple[int, ...]) -> str:
    cols = ", ".join([*(r(lagged(n), 6) + f" AS mom{n}" for n in windows), *(r(full("stddev_samp(logret)", "logret", n), 6) + f" AS std{n}" for n in windows), *(r("ln(" + full("avg(close * volume)", "close", n) + ")", 6) + f" AS log_adv{n}" for n in windows)])
    fwd = "lead(logret) OVER (PARTITION BY ticker ORDER BY date)"
    inner = beta(betas, WEEKLY, 20).rsplit("SELECT ticker", 1)
    return inner[0] + f"SELECT {r('close')} AS close, volume, {r('logret', 6)} AS logret, {r(fwd, 6)} AS fwdret, {r('mkt', 6)} AS mkt_logret, nt AS n_tickers, {r('close * volume')} AS dollar_volume, {cols}, ticker" + inner[1]


def columns_of(p: str, digits: int) -> str:
    return on(p) + f"SELECT ticker, date, {', '.join(r(c, digits) + ' AS ' + c for c in ('open', 'high', 'low', 'close'))}, volume FROM p"


ORACLE: dict[str, str] = {
    "etl_clean_prices": columns_of(DAILY, 9),
    "csv_scan": columns_of(DAILY, 9),
    "panel_daily": columns_of(DAILY, 9),
    "panel_monthly": columns_of(MONTHLY, 9),
    "panel_weekly": columns_of(WEEKLY, 9),
    "log_returns": feature({"logret": "logret"}),
    "fwd_returns": feature({"fwdret": "lead(logret) OVER (PARTITION BY ticker ORDER BY date)"}),
    "fwd_returns_h5": feature({"fwd_ret_5": "CASE WHEN count(logret) OVER (PARTITION BY ticker ORDER BY date ROWS BETWEEN 1 FOLLOWING AND 5 FOLLOWING) = 5 THEN sum(logret) OVER (PARTITION BY ticker ORDER BY date ROWS BETWEEN 1 FOLLOWING AND 5 FOLLOWING) END"}),
    "momentum_multi": feature({f"mom{n}": lagged(n) for n in (5, 10, 20)}),
    "volatility_multi": feature({f"std{n}": full("stddev_samp(logret)", "logret", n) for n in (5, 10, 20)}),
    "dollar_volume": feature({"dollar_volume": "close * volume"}),
    "adv": feature({f"adv{n}": full("avg(close * volume)", "close", n) for n in (5, 20)}, DAILY, 6),
    "log_adv": feature({f"log_adv{n}": "ln(" + full("avg(close * volume)", "close", n) + ")" for n in (5, 20)}),
    "market_return": on(DAILY, RETURNS, market(DAILY, 100)) + f"SELECT ticker, date, {r('mkt')} AS mkt_logret, nt AS n_tickers FROM r LEFT JOIN mk ON date = kdate",
    "market_var": on(DAILY, RETURNS, market(DAILY, 100)) + f"SELECT kdate AS date, {r('CASE WHEN count(mkt) OVER w = 5 THEN var_samp(mkt) OVER w END')} AS mkt_var5 FROM mk WINDOW w AS (ORDER BY kdate ROWS BETWEEN 4 PRECEDING AND CURRENT ROW)",
    "rolling_beta": beta((5, 10), DAILY, 100),
    "rolling_beta_joined": beta((5, 10), DAILY, 100),
    "rolling_beta_weekly": beta((60, 252), WEEKLY, 20),
    "features_all": all_features((5, 10, 20, 60, 120, 252), (60, 252)),
    "missing_days": on(DAILY) + "SELECT ticker, date, CAST(date_diff('day', lag(date) OVER (PARTITION BY ticker ORDER BY date), date) - 1 AS INT) AS missing_days FROM p",
    "zscore": signal(z(), "mom5_z"),
    "zscore_desc": signal(z("mom5", "-"), "mom5_z"),
    "tanh": signal("tanh(2.0 * mom5)", "mom5_tanh"),
    "clip": signal("CASE WHEN mom5 IS NOT NULL THEN greatest(-0.5, least(0.5, mom5)) END", "mom5_clip"),
    "rank_avg": signal(rank("mom5"), "mom5_rank"),
    "rank_desc": signal(rank("mom5", "date", "DESC"), "mom5_rank"),
    "rank_scaled": signal(scaled("mom5"), "mom5_rank_scaled"),
    "decile": signal(decile("mom5"), "mom5_decile", "int"),
    "quintile_n5": signal(decile("mom5", 5), "mom5_decile", "int"),
    "signal_zscore_tanh": on(DAILY, BASE) + f"SELECT ticker, date, {r('tanh(' + z('mom5') + ')')} AS mom5_zscore_tanh, {r('tanh(' + z('std5') + ')')} AS std5_zscore_tanh FROM b",
    "signal_zscore_clip": signal(f"CASE WHEN {z()} IS NOT NULL THEN greatest(-1.0, least(1.0, {z()})) END", "mom5_zscore_clip"),
    "frame_signals": on(DAILY, BASE)
    + f"SELECT ticker, date, {r(z())} AS mom5_z, {r(z('std5'))} AS std5_z, {r('tanh(2.0 * mom5)')} AS mom5_tanh, {r('CASE WHEN mom5 IS NOT NULL THEN greatest(-0.5, least(0.5, mom5)) END')} AS mom5_clip, "
    + f"{r(rank('mom5'))} AS mom5_rank, {r(scaled('mom5'))} AS mom5_rank_scaled, CAST({decile('mom5')} AS INT) AS mom5_decile FROM b",
    "ic_spearman": on(DAILY, BASE) + "," + ic() + f" SELECT date, {r('ic')} AS ic FROM ic",
    "ic_pearson": on(DAILY, BASE) + f", c AS (SELECT * FROM b WHERE mom5 IS NOT NULL AND fwdret IS NOT NULL) SELECT date, {r(pearson('mom5', 'fwdret'))} AS ic FROM c GROUP BY date",
    "ic_summary": on(DAILY, BASE) + "," + ic() + " " + summary(),
    "ic_by_method": by_method(METHODS) + " " + summary("ic", "method"),
    "ic_dict": by_method({"zscore": z(), "rank": scaled("mom5")}) + f" SELECT method, date, {r('ic')} AS ic FROM ic",
    "newey_west": WEEKLY_IC + "," + newey_west() + f" SELECT {r('mean', 7)} AS mean, {r('se', 7)} AS se, {r('t_stat', 7)} AS t_stat, max_lag, n FROM nw",
    "ic_decay": decay((1, 2, 5)),
    "autocorr_flat": WEEKLY_IC + f", l AS (SELECT ic, lag(ic, 1) OVER (ORDER BY date) AS l1, lag(ic, 5) OVER (ORDER BY date) AS l5 FROM ic) SELECT {r(pearson('ic', 'l1'))} AS lag_1, {r(pearson('ic', 'l5'))} AS lag_5 FROM l",
    "autocorr_by_ticker": on(DAILY, BASE)
    + f""", l AS (SELECT ticker, logret AS x, lag(logret, 1) OVER w AS l1, lag(logret, 5) OVER w AS l5 FROM b WINDOW w AS (PARTITION BY ticker ORDER BY date)),
g AS (SELECT ticker, {pearson('x', 'l1')} AS r1, {pearson('x', 'l5')} AS r5 FROM l GROUP BY ticker),
u AS (SELECT 1 AS lag, r1 AS r FROM g UNION ALL SELECT 5, r5 FROM g)
SELECT lag, {r('avg(r)')} AS mean, {r('stddev_samp(r)')} AS std, CAST(count(r) AS BIGINT) AS n_groups FROM u GROUP BY lag""",
    "recent_coverage": on(DAILY, BASE) + f"SELECT {r('avg(CASE WHEN mom5 IS NOT NULL THEN 1.0 ELSE 0.0 END)')} AS coverage FROM b WHERE date >= (SELECT max(date) FROM b) - 10",
    "turnover": on(DAILY, BASE) + f", t AS (SELECT date, abs(mom5 - lag(mom5) OVER (PARTITION BY ticker ORDER BY date)) AS c FROM b) SELECT date, {r('avg(c)')} AS turnover FROM t GROUP BY date",
    "turnover_multi": on(DAILY, BASE) + f", t AS (SELECT date, abs(mom5 - lag(mom5) OVER w) AS c, abs(std5 - lag(std5) OVER w) AS e FROM b WINDOW w AS (PARTITION BY ticker ORDER BY date)) SELECT date, {r('avg(c)')} AS mom5_turnover, {r('avg(e)')} AS std5_turnover FROM t GROUP BY date",
    "series_summary": SPREAD + " UNION ALL ".join(f"SELECT '{c}' AS \"column\", {r(f'avg({c})')} AS mean, {r(f'stddev_samp({c})')} AS std, CAST(count({c}) AS BIGINT) AS n FROM sr" for c in ("long_ret", "short_ret", "spread_ret")),
    "long_short": SPREAD + f"SELECT date, {r('long_ret')} AS long_ret, {r('short_ret')} AS short_ret, {r('spread_ret')} AS spread_ret FROM sr",
    "sharpe": SPREAD + f"SELECT {r('avg(spread_ret) / nullif(stddev_pop(spread_ret), 0) * sqrt(252.0)')} AS sharpe FROM sr",
    "max_drawdown": SPREAD + f", c AS (SELECT date, sum(spread_ret) OVER (ORDER BY date ROWS UNBOUNDED PRECEDING) AS c FROM sr WHERE spread_ret IS NOT NULL), d AS (SELECT c - max(c) OVER (ORDER BY date ROWS UNBOUNDED PRECEDING) AS d FROM c) SELECT {r('min(d)')} AS max_drawdown FROM d",
    "decile_spread": on(DAILY, BASE) + f", u AS (SELECT fwdret AS f, CAST({bucket('mom5', 10)} AS INT) AS bucket FROM b) SELECT bucket, {r('avg(f)')} AS mean_fwd FROM u GROUP BY bucket",
    "cumulative_ic": on(DAILY, BASE) + "," + ic() + f" SELECT date, {r('sum(coalesce(ic, 0)) OVER (ORDER BY date ROWS UNBOUNDED PRECEDING)')} AS cum_ic FROM ic",
    "ic_distribution": on(DAILY, BASE) + "," + ic() + f", q AS (SELECT quantile_cont(ic, [0.0, 0.25, 0.5, 0.75, 1.0]) AS q FROM ic) SELECT {r('q[1]')} AS lo, {r('q[2]')} AS q1, {r('q[3]')} AS median, {r('q[4]')} AS q3, {r('q[5]')} AS hi FROM q",
    "coverage_per_date": on(DAILY, BASE) + "SELECT date, CAST(count(mom5) AS BIGINT) AS n FROM b GROUP BY date",
    "moments_per_date": on(DAILY, BASE) + f"SELECT date, {r('avg(mom5)')} AS mean, {r('stddev_samp(mom5)')} AS std FROM b GROUP BY date",
    "one_pager": on(DAILY, BASE) + f"SELECT date, CAST(count(mom5) AS BIGINT) AS n, {r('avg(mom5)')} AS mean, {r('stddev_samp(mom5)')} AS std FROM b GROUP BY date",
    "heatmap": on(DAILY, BASE) + f"SELECT ticker, date, {r('mom5')} AS value FROM b",
    "bh": FDR + "SELECT signal, survives_bh FROM out",
    "by": FDR + "SELECT signal, survives_by FROM out",
    "pi0": FDR + f"SELECT {r('pi0')} AS pi0 FROM pz",
    "qvalues": FDR + f"SELECT signal, {r('q')} AS qvalue FROM out",
    "fdr_report": FDR + f"SELECT signal, {r('p')} AS pvalue, survives_bh, survives_by, {r('q')} AS qvalue FROM out",
    "cv_folds": FOLDS + "SELECT * FROM fo",
    "fold_sizes": FOLDS + "SELECT fold, part, CAST(count(*) AS BIGINT) AS n FROM p JOIN (SELECT fold, 'train' AS part, train_start AS a, train_end AS b FROM fo UNION ALL SELECT fold, 'test', test_start, test_end FROM fo) ON date BETWEEN a AND b GROUP BY fold, part",
    "semiannual_stats": on(WEEKLY, RETURNS) + f"SELECT make_date(CAST(year(date) AS INT), CAST((month(date) - 1) // 6 * 6 + 1 AS INT), 1) AS period, {r('avg(logret)')} AS mean, {r('stddev_samp(logret)')} AS std, CAST(count(logret) AS BIGINT) AS n FROM r GROUP BY 1",
    "feature_quantiles": quantile_rows(("mom5", "std5"), (0.01, 0.5, 0.99)),
    "feature_corr_matrix": corr_rows(("mom5", "std5", "logret")),
    "describe": on(DAILY, BASE) + " UNION ALL ".join(f"SELECT '{c}' AS \"column\", CAST(count({c}) AS BIGINT) AS n, {r(f'avg({c})')} AS mean, {r(f'stddev_samp({c})')} AS std, {r(f'min({c})')} AS lo, {r(f'quantile_cont({c}, 0.25)')} AS q1, {r(f'quantile_cont({c}, 0.5)')} AS median, {r(f'quantile_cont({c}, 0.75)')} AS q3, {r(f'max({c})')} AS hi FROM b" for c in ("mom5", "logret")),
    "histogram": on(DAILY, BASE) + "SELECT CAST(CASE WHEN logret < -5 THEN 0 WHEN logret >= 5 THEN 101 ELSE floor((logret + 5) / 10 * 100) + 1 END AS BIGINT) AS bin, CAST(count(*) AS BIGINT) AS n FROM b WHERE logret IS NOT NULL GROUP BY 1",
    "null_counts": on(DAILY, BASE) + " UNION ALL ".join(f"SELECT '{c}' AS \"column\", CAST(sum(CAST({c} IS NULL AS INT)) AS BIGINT) AS n_null, CAST(coalesce(sum(CAST(isnan({c}) AS INT)), 0) AS BIGINT) AS n_nan, CAST(coalesce(sum(CAST(isinf({c}) AS INT)), 0) AS BIGINT) AS n_inf FROM b" for c in ("mom5", "std5", "logret", "fwdret")),
    "unique_counts": on(DAILY) + "SELECT CAST(count(DISTINCT ticker) AS BIGINT) AS n_tickers, CAST(count(DISTINCT date) AS BIGINT) AS n_dates, CAST(count(*) AS BIGINT) AS n_rows FROM p",
    "rows_per_ticker": on(DAILY) + "SELECT ticker, CAST(count(*) AS BIGINT) AS n FROM p GROUP BY ticker",
    "pivot_wide": on(DAILY) + "SELECT date, CAST(count(*) AS BIGINT) AS n_tickers, string_agg(ticker || '=' || CAST(CAST(round(close, 6) AS DECIMAL(28,6)) AS VARCHAR), ',' ORDER BY ticker) AS closes FROM p GROUP BY date",
    "latest_cross_section": on(DAILY, BASE) + f"SELECT ticker, date, {', '.join(r(c) + ' AS ' + c for c in ('close', 'logret', 'fwdret', 'mom5', 'std5'))} FROM b WHERE date = (SELECT max(date) FROM b)",
    "mp_bounds": on(MONTHLY) + f", s AS (SELECT count(DISTINCT ticker) AS a, count(DISTINCT date) AS o FROM p) SELECT CAST(a AS BIGINT) AS n_assets, CAST(o AS BIGINT) AS n_obs, {r('power(1 - sqrt(a / CAST(o AS DOUBLE)), 2)')} AS low, {r('power(1 + sqrt(a / CAST(o AS DOUBLE)), 2)')} AS high FROM s",
    "pairwise_correlations": on(MONTHLY, RETURNS) + f"SELECT a.ticker AS i, b.ticker AS j, {r(pearson('a.logret', 'b.logret'))} AS corr FROM r a JOIN r b USING (date) WHERE a.ticker < b.ticker GROUP BY 1, 2",
    "compare_reports": report(("mom5", "std5", "logret")),
    "signal_report": report(("mom5",)),
    "ic_pvalue": WEEKLY_IC + "," + newey_west() + f" SELECT {r('mean')} AS mean, {r('se')} AS se, {r('t_stat')} AS t_stat, max_lag, n, {r(tail('t_stat'))} AS p_value FROM nw",
    "sample_tickers": on(DAILY) + ", t AS (SELECT DISTINCT ticker FROM p ORDER BY md5(ticker || ':0'), ticker LIMIT 10) SELECT ticker, CAST(count(*) AS BIGINT) AS n FROM p WHERE ticker IN (SELECT ticker FROM t) GROUP BY ticker",
    "normal_quantiles": on(DAILY, BASE) + " UNION ALL ".join(f"SELECT {k / 10!r}::DOUBLE AS p, {r(f'quantile_cont(logret, {k / 10!r}::DOUBLE)')} AS value, {r(f'{NormalDist().inv_cdf(k / 10)!r}::DOUBLE')} AS normal FROM b" for k in range(1, 10)),
}
