"""Secret scan with multipart credential linking.

Three kinds of strong findings stand by themselves: ``assign`` (a credential word that is assigned a value), ``access``
(an access key id) and ``hex`` (a long run of hex digits). Weak parts mean little alone: an account name (``ident``), a
bare 40-character key (``key``) and a service address (``endpoint``). They are reported only where the parts that
complete a credential stand within ``SCOPE`` code points, from the end of one to the start of the other: a key next to
an identifier, an identifier next to a secret, an endpoint next to both. That is an interval join: parts are dealt into
all buckets of ``SCOPE`` code points that they touch, per document, and a weak part looks up each role in its own buckets
and the two beside them. A bucket holds a role's least start and greatest end, so parts are never paired up.

Matches come from splitting a text at a pattern and extracting the pattern: the lengths of pieces and matches in turn
give every span. All of it is built-in functions.

Defined cases: a null text has no findings; repeated rows each have a row of their own; an empty table gives an empty
result; other columns are ignored; a very long part touches one bucket per ``SCOPE`` of its length.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ._work import keep, pick

SCOPE = 400

# Patterns of the findings. Base kinds first, in the order in which they are listed.
ASSIGN = r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"""AKIA[A-Z0-9]+"""
HEX = r"""[0-9a-f]{32,}"""
IDENT = r"""(?i)(?:user(?:_?name)?|login|account|client_?id)["']?\x20*[:=]\x20*["']?[A-Za-z0-9._@+-]{3,}"""
KEY = r"""(?<![A-Za-z0-9+/=_-])[A-Za-z0-9+/]{40}(?![A-Za-z0-9+/=_-])"""
ENDPOINT = r"""(?i)(?:https?|s3|jdbc:[a-z0-9]+|postgres(?:ql)?|mysql|mongodb|redis|amqp|ftp|ssh)://[^\x00-\x20"'<>]+"""
#: Least length of the value of ``assign`` and of an ``access`` match.
ASSIGN_VALUE, ACCESS_LENGTH = 8, 16

KINDS = ("assign", "access", "hex", "ident", "key", "endpoint")
BASE = 3
#: What a text must hold for a pattern to be worth trying; never narrower than the pattern.
_HINTS = {
    "assign": lambda t: t.rlike(r"(?i)(?:password|passwd|secret|token|api_?key)[\"']?\x20*[:=]"),
    "access": lambda t: t.contains("AKIA"),
    "hex": lambda t: t.rlike(HEX),
    "ident": lambda t: t.rlike(r"(?i)(?:name|user|login|account|client_?id)[\"']?\x20*[:=]"),
    "key": lambda t: t.rlike(r"[A-Za-z0-9+/]{40}"),
    "endpoint": lambda t: t.contains("://"),
}
_PATTERNS = {"assign": ASSIGN, "access": ACCESS, "hex": HEX, "ident": IDENT, "key": KEY, "endpoint": ENDPOINT}


def _found(text: Column, kind: str) -> Column:
    """Per match of a kind: code points before it since the last match, its length, and whether it counts."""
    pattern = F.lit(_PATTERNS[kind])
    matches = F.regexp_extract_all(text, pattern, F.lit(0))
    gaps = F.split(text, _PATTERNS[kind], -1)
    if kind == "assign":
        values = F.regexp_extract_all(text, pattern, F.lit(2))
        counts = F.transform(values, lambda v: F.length(v) >= ASSIGN_VALUE)
    elif kind == "access":
        counts = F.transform(matches, lambda m: F.length(m) >= ACCESS_LENGTH)
    else:
        counts = F.transform(matches, lambda m: F.lit(True))
    found = F.zip_with(F.zip_with(matches, gaps, lambda m, g: F.struct(F.length(g).alias("gap"), F.length(m).alias("size"))), counts, lambda x, ok: F.struct(x["gap"].alias("gap"), x["size"].alias("size"), ok.alias("ok")))
    # the last piece has no match behind it
    found = F.filter(found, lambda x: x["size"].isNotNull())
    return F.when(_HINTS[kind](text), found).otherwise(F.array().cast("array<struct<gap: int, size: int, ok: boolean>>"))


def parts(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> tuple[DataFrame, DataFrame]:
    """(rid, doc_id) of all rows, and (rid, kind, begin, end) of everything found, weak parts included."""
    own = pick(docs, doc_id=doc_id, text=text).select("doc_id", F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    # numbered once, in the table that is kept; no later step numbers rows again
    scanned = keep(own.select(F.monotonically_increasing_id().alias("rid"), "doc_id", *[_found(F.col("text"), k).alias(k) for k in KINDS]), "secret-scan")
    each = F.array(*[F.struct(F.lit(i).alias("kind"), F.col(k).alias("found")) for i, k in enumerate(KINDS)])
    rows = (
        scanned.select("rid", F.explode(F.filter(each, lambda x: F.size(x["found"]) > 0)).alias("one"))
        .select("rid", F.col("one.kind").alias("kind"), F.posexplode("one.found").alias("n", "m"))
        .select("rid", "kind", "n", "m.gap", "m.size", "m.ok")
    )
    upto = Window.partitionBy("rid", "kind").orderBy("n").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    spans = rows.withColumn("end", F.sum(F.col("gap") + F.col("size")).over(upto)).where("ok").select("rid", "kind", (F.col("end") - F.col("size")).alias("begin"), "end")
    return scanned.select("rid", "doc_id"), keep(spans, "secret-parts")


def linked(spans: DataFrame, scope: int = SCOPE) -> DataFrame:
    """The weak parts of ``spans`` next to the parts that complete them."""
    identifier, secret = ("access", "ident"), ("assign", "hex", "key")
    index = {k: i for i, k in enumerate(KINDS)}
    role = lambda kinds: F.col("kind").isin([index[k] for k in kinds])
    first, last = F.expr(f"begin div {scope}"), F.expr(f"`end` div {scope}")
    placed = spans.where(role(identifier + secret)).withColumn("bucket", F.explode(F.sequence(first, last)))
    reach = lambda name, kinds: [F.min(F.when(role(kinds), F.col("begin"))).alias(f"first_{name}"), F.max(F.when(role(kinds), F.col("end"))).alias(f"last_{name}")]
    cells = placed.groupBy("rid", "bucket").agg(*reach("id", identifier), *reach("secret", secret))
    weak = spans.where(F.col("kind") >= BASE).withColumns({"low": first, "high": last}).withColumn("bucket", F.explode(F.sequence(F.col("low") - 1, F.col("high") + 1)))
    beside = weak.join(cells, ["rid", "bucket"])

    def near(name: str) -> Column:
        # what lies in a bucket of the part itself is near; in the buckets before and behind only what reaches furthest matters
        begins, ends = F.col(f"first_{name}"), F.col(f"last_{name}")
        nearest = F.when(F.col("bucket") < F.col("low"), F.col("begin") - ends <= scope).when(F.col("bucket") > F.col("high"), begins - F.col("end") <= scope).otherwise(begins.isNotNull())
        return F.coalesce(nearest, F.lit(False))

    known = beside.groupBy("rid", "kind", "begin", "end").agg(F.max(near("id")).alias("id"), F.max(near("secret")).alias("secret"))
    complete = F.when(F.col("kind") == index["key"], F.col("id")).when(F.col("kind") == index["ident"], F.col("secret")).otherwise(F.col("id") & F.col("secret"))
    return known.where(complete).select("rid", "kind", "begin", "end")


def scan(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", scope: int = SCOPE) -> DataFrame:
    """doc_id, findings: all spans by begin, then kind as listed, as (begin, kind, end) with the kind's number."""
    rows, spans = parts(docs, doc_id, text)
    reported = spans.where(F.col("kind") < BASE).unionByName(linked(spans, scope))
    by_row = reported.groupBy("rid").agg(F.array_sort(F.collect_list(F.struct("begin", "kind", "end"))).alias("findings"))
    return rows.join(by_row, "rid", "left").select("doc_id", F.coalesce("findings", F.array().cast("array<struct<begin: bigint, kind: int, end: bigint>>")).alias("findings"))


def _text(findings: Column) -> Column:
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(findings, lambda x: F.concat_ws(":", F.get(names, x["kind"]), x["begin"].cast("string"), x["end"].cast("string"))), ",")


def op7_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Findings of all ``documents``."""
    found = scan(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    count = lambda k: F.size(F.filter("findings", lambda x: x["kind"] == k)).cast("long")
    return found.select(
        "doc_id",
        count(0).alias("n_assign"),
        count(1).alias("n_access"),
        count(2).alias("n_hex"),
        F.sha2(_text(F.filter("findings", lambda x: x["kind"] < BASE)), 256).alias("base_sha256"),
        _text(F.col("findings")).alias("spans"),
    )


def _sql() -> str:
    """The same findings in DuckDB SQL; its patterns know no look-around, so a key is a whole run of 40 characters."""
    quoted = lambda p: "'" + p.replace("'", "''") + "'"
    runs = r"[A-Za-z0-9+/=_-]+"
    patterns = {**_PATTERNS, "key": runs}
    holds = {"assign": f"length(regexp_extract_all(text, {quoted(ASSIGN)}, 2)[i]) >= {ASSIGN_VALUE}", "access": f"length(m[i]) >= {ACCESS_LENGTH}", "key": "regexp_full_match(m[i], '[A-Za-z0-9+/]{40}')"}
    parts = " UNION ALL ".join(
        f"SELECT rid, {k} AS kind, {holds.get(name, 'TRUE')} AS ok, length(m[i]) AS size, sum(length(g[i]) + length(m[i])) OVER (PARTITION BY rid ORDER BY i) AS e "
        f"FROM (SELECT *, unnest(range(1, len(m) + 1)) AS i FROM (SELECT rid, text, regexp_extract_all(text, {quoted(patterns[name])}) AS m, string_split_regex(text, {quoted(patterns[name])}) AS g FROM d))"
        for k, name in enumerate(KINDS)
    )
    near = lambda kinds: f"EXISTS (SELECT 1 FROM f o WHERE o.rid = f.rid AND o.kind IN {kinds} AND o.b <= f.e + {SCOPE} AND o.e >= f.b - {SCOPE})"
    name = "CASE kind " + " ".join(f"WHEN {k} THEN '{n}'" for k, n in enumerate(KINDS)) + " END"
    one = f"{name} || ':' || b || ':' || e"
    return f"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS text FROM documents),
x AS ({parts}),
f AS (SELECT rid, kind, CAST(e - size AS BIGINT) AS b, CAST(e AS BIGINT) AS e FROM x WHERE ok),
s AS (SELECT * FROM f WHERE kind < 3 OR (kind = 4 AND {near('(1, 3)')}) OR (kind = 3 AND {near('(0, 2, 4)')}) OR (kind = 5 AND {near('(1, 3)')} AND {near('(0, 2, 4)')})),
t AS (SELECT rid, CAST(count(*) FILTER (WHERE kind = 0) AS BIGINT) AS n_assign, CAST(count(*) FILTER (WHERE kind = 1) AS BIGINT) AS n_access, CAST(count(*) FILTER (WHERE kind = 2) AS BIGINT) AS n_hex,
             string_agg({one}, ',' ORDER BY b, kind) FILTER (WHERE kind < 3) AS base, string_agg({one}, ',' ORDER BY b, kind) AS spans FROM s GROUP BY rid)
SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM d LEFT JOIN t USING (rid)"""


OP7_SQL = _sql()
