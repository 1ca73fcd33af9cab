"""Sharding on a consistent-hash ring with virtual nodes and bounded loads.

Each shard owns ``vnodes`` arcs of a ring of 60-bit positions. A document's position is taken from its id's SHA-256; the arc it
falls on names its shard. A shard has a fixed capacity: the documents' number divided by the shards' number, rounded
down, and one more for the fullest shards as far as the remainder goes. Shards first take documents from their own
arcs, clockwise; what a full shard can't take continues clockwise to the next virtual node whose shard has room. So
counts differ by one at most (law ``rows``), and only the overflow moves away from where the ring alone puts it.

Only the number of documents on each arc reaches the driver: ``n_shards * vnodes`` numbers, set by parameters.
Documents are numbered within their arc by a window, so the largest sort is one arc's.

Defined cases: a null text has size 1 and checksum 0, as an empty one; repeated rows (same id, size and checksum) are
counted as one key with a multiplicity, so that a key which holds a third of all rows is one row until the end, where its
slots are dealt into ranges and spread over all tasks; a null id has a position of its own; ids at one position (ties) are
ordered by id, size and checksum; very long texts count as they are; an empty table gives an empty result; other columns
of the input are ignored.
"""

from __future__ import annotations

import bisect
import hashlib
import json

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ._work import CHUNK, keep, pick, repeated

N_SHARDS = 16
VNODES = 512
#: A position is as many hex digits of a SHA-256.
DIGITS = 15
#: The ring is looked up by the top bits of a position first.
CELL_BITS = 14


def ring_positions(n_shards: int, vnodes: int) -> list[tuple[int, int]]:
    """(position, shard) of all virtual nodes, clockwise. A shard's nodes don't depend on the number of shards."""
    nodes = []
    for shard in range(n_shards):
        for v in range(vnodes):
            digest = hashlib.sha256(f"shard {shard} node {v}".encode()).hexdigest()
            nodes.append((int(digest[:DIGITS], 16), shard))
    return sorted(nodes)


def owner_index(positions: list[int], key: int) -> int:
    """Index of the first node at or after a position, around the ring."""
    return bisect.bisect_left(positions, key) % len(positions)


def bounded_plan(owners: list[int], counts: list[int], n_shards: int) -> list[dict]:
    """Pieces of arcs: ranks ``lo`` to ``hi`` (exclusive) of arc ``arc`` go to ``shard`` from slot ``slot`` on."""
    total = sum(counts)
    own = [0] * n_shards
    for owner, count in zip(owners, counts, strict=True):
        own[owner] += count
    fullest = sorted(range(n_shards), key=lambda s: (-own[s], s))
    room = [total // n_shards] * n_shards
    for s in fullest[: total % n_shards]:
        room[s] += 1
    used = [0] * n_shards
    pieces, over = [], []

    def place(arc: int, lo: int, hi: int, shard: int) -> None:
        pieces.append({"arc": arc, "lo": lo, "hi": hi, "shard": shard, "slot": used[shard]})
        used[shard] += hi - lo

    for arc, (owner, count) in enumerate(zip(owners, counts, strict=True)):
        taken = min(count, room[owner] - used[owner])
        if taken:
            place(arc, 0, taken, owner)
        if taken < count:
            over.append((arc, taken, count))
    for arc, lo, hi in over:
        at = arc
        while lo < hi:
            at = (at + 1) % len(owners)
            taken = min(hi - lo, room[owners[at]] - used[owners[at]])
            if taken:
                place(arc, lo, lo + taken, owners[at])
                lo += taken
    return pieces


def _inline(spark: SparkSession, rows: list[dict], ddl: str) -> DataFrame:
    """A small table as a literal of the plan."""
    return spark.range(1).select(F.inline(F.from_json(F.lit(json.dumps(rows)), f"array<struct<{ddl}>>")))


def with_arc(keys: DataFrame, n_shards: int, vnodes: int) -> DataFrame:
    """Add ``arc``, the index of the virtual node that owns ``position``. The lookup table's size is set by parameters."""
    nodes = ring_positions(n_shards, vnodes)
    positions = [p for p, _ in nodes]
    shift = 4 * DIGITS - CELL_BITS
    cells = []
    for cell in range(1 << CELL_BITS):
        first = bisect.bisect_left(positions, cell << shift)
        last = bisect.bisect_left(positions, (cell + 1) << shift)
        inside = [{"p": positions[i], "a": i} for i in range(first, last)]
        cells.append({"cell": cell, "inside": inside, "beyond": last % len(positions)})
    ring = _inline(keys.sparkSession, cells, "cell bigint, inside array<struct<p: bigint, a: int>>, beyond int")
    found = F.filter("inside", lambda x: x["p"] >= F.col("position"))
    return (
        keys.withColumn("cell", F.shiftright("position", shift))
        .join(F.broadcast(ring), "cell")
        .withColumn("arc", F.when(F.size(found) > 0, found[0]["a"]).otherwise(F.col("beyond")))
        .drop("cell", "inside", "beyond")
    )


def shard(docs: DataFrame, n_shards: int = N_SHARDS, vnodes: int = VNODES, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard: one row per input row."""
    if n_shards < 1 or vnodes < 1:
        raise ValueError("n_shards and vnodes must be positive")
    spark = docs.sparkSession
    body = F.coalesce(F.col("text").cast("binary"), F.lit(b""))
    keys = (
        pick(docs, doc_id=doc_id, text=text).select("doc_id", (F.octet_length(body) + 1).cast("long").alias("size"), F.crc32(body).alias("text_crc32"))
        .groupBy("doc_id", "size", "text_crc32")
        .agg(F.count(F.lit(1)).alias("m"))
        .withColumn("position", F.conv(F.left(F.sha2(F.coalesce(F.col("doc_id").cast("string"), F.lit("null")).cast("binary"), 256), F.lit(DIGITS)), 16, 10).cast("long"))
    )
    keys = keep(with_arc(keys, n_shards, vnodes), "ring-keys")
    owners = [s for _, s in ring_positions(n_shards, vnodes)]
    counts, most = [0] * len(owners), 0
    for row in keys.groupBy("arc").agg(F.sum("m").alias("n"), F.max("m").alias("most")).collect():  # at most n_shards * vnodes rows
        counts[row["arc"]], most = row["n"], max(most, row["most"])
    pieces = _inline(spark, bounded_plan(owners, counts, n_shards), "arc int, lo bigint, hi bigint, shard int, slot bigint")
    order = Window.partitionBy("arc").orderBy("position", "doc_id", "size", "text_crc32")
    ranked = keys.withColumn("after", F.sum("m").over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow))).withColumn("before", F.col("after") - F.col("m"))
    placed = ranked.join(F.broadcast(pieces), "arc").where((F.col("before") < F.col("hi")) & (F.col("after") > F.col("lo")))
    first, last = F.greatest("before", "lo"), F.least("after", "hi")
    runs = placed.select("doc_id", "size", "text_crc32", "shard", (F.col("slot") + first - F.col("lo")).alias("slot"), (last - first).alias("rows"))
    if most > CHUNK:
        runs = keep(runs, "ring-runs")
    return repeated(runs, "rows", ["shard", "slot"], most, "step").select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit("rows").alias("law"),
        "shard",
        (F.col("slot") + F.col("step")).alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
    )


def op5_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Put all ``documents`` into 16 shards; law ``rows``."""
    return shard(spark.read.parquet(f"{sf_dir}/documents.parquet"))


# The same ring and plan in DuckDB, which has no CRC-32: bytes go through the table of its polynomial, one after the
# other. ``own`` is what shards take from their own arcs, ``walk`` places the overflow piece by piece.
OP5_SQL = """
WITH RECURSIVE crc AS (
  SELECT list_transform(range(256), lambda i: list_reduce(list_prepend(i, range(8)), lambda c, k: xor(c >> 1, 3988292384 * (c & 1)))) AS t),
d AS (
  SELECT doc_id, CAST(strlen(coalesce(text, '')) + 1 AS BIGINT) AS size,
         CAST('0x' || substr(sha256(coalesce(CAST(doc_id AS VARCHAR), 'null')), 1, 15) AS BIGINT) AS pos,
         CAST(xor(4294967295, list_reduce(list_prepend(4294967295, list_transform(regexp_extract_all(hex(coalesce(text, '')), '..'), lambda h: CAST('0x' || h AS BIGINT))),
              lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1]))) AS BIGINT) AS text_crc32
  FROM documents, crc),
nodes AS (
  SELECT CAST(row_number() OVER (ORDER BY pos, shard) - 1 AS BIGINT) AS arc, pos, shard
  FROM (SELECT s AS shard, CAST('0x' || substr(sha256('shard ' || s || ' node ' || v), 1, 15) AS BIGINT) AS pos FROM range(16) a(s), range(512) b(v))),
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY arc ORDER BY pos, doc_id NULLS FIRST, size, text_crc32) - 1 AS rank
  FROM (SELECT d.*, coalesce(n.arc, 0) AS arc FROM d ASOF LEFT JOIN nodes n ON d.pos <= n.pos)),
arcs AS (
  SELECT arc, shard, coalesce(n, 0) AS n, coalesce(sum(coalesce(n, 0)) OVER (PARTITION BY shard ORDER BY arc ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
  FROM nodes LEFT JOIN (SELECT arc, count(*) AS n FROM ranked GROUP BY arc) USING (arc)),
shards AS (
  SELECT shard, own, (SELECT count(*) FROM d) // 16 + CAST(row_number() OVER (ORDER BY own DESC, shard) <= (SELECT count(*) FROM d) % 16 AS BIGINT) AS room
  FROM (SELECT shard, sum(n) AS own FROM arcs GROUP BY shard)),
own AS (SELECT arc, shard, n, before, least(n, greatest(room - before, 0)) AS taken FROM arcs JOIN shards USING (shard)),
over AS (SELECT row_number() OVER (ORDER BY arc) AS k, arc, CAST(taken AS BIGINT) AS lo, CAST(n AS BIGINT) AS hi FROM own WHERE taken < n),
walk AS (
  SELECT CAST(1 AS BIGINT) AS k, (SELECT arc FROM over WHERE k = 1) AS at, (SELECT lo FROM over WHERE k = 1) AS lo,
         (SELECT list(CAST(room - least(room, own) AS BIGINT) ORDER BY shard) FROM shards) AS room,
         CAST(NULL AS BIGINT) AS arc, CAST(NULL AS BIGINT) AS plo, CAST(NULL AS BIGINT) AS phi, CAST(NULL AS BIGINT) AS pshard, CAST(NULL AS BIGINT) AS pleft
  UNION ALL
  SELECT CASE WHEN done THEN k + 1 ELSE k END, CASE WHEN done THEN (SELECT arc FROM over o WHERE o.k = z.k + 1) ELSE next END,
         CASE WHEN done THEN (SELECT lo FROM over o WHERE o.k = z.k + 1) ELSE lo + piece END,
         list_transform(room, lambda x, i: CASE WHEN i = s + 1 THEN x - piece ELSE x END), arc, lo, lo + piece, s, room[s + 1]
  FROM (SELECT *, least(hi - lo, room[s + 1]) AS piece, hi - lo <= room[s + 1] AS done
        FROM (SELECT w.k, w.lo, w.room, o.arc, o.hi, arg_min(n.arc, (n.arc - w.at + 8191) % 8192) AS next, arg_min(n.shard, (n.arc - w.at + 8191) % 8192) AS s
              FROM walk w JOIN over o ON o.k = w.k JOIN nodes n ON w.room[n.shard + 1] > 0 GROUP BY ALL)) z),
pieces AS (
  SELECT arc, 0 AS lo, taken AS hi, shard, before AS slot FROM own WHERE taken > 0
  UNION ALL SELECT arc, plo, phi, pshard, room - pleft FROM (SELECT arc, plo, phi, pshard, pleft FROM walk WHERE arc IS NOT NULL) JOIN shards ON shard = pshard)
SELECT doc_id, size, text_crc32, 'rows' AS law, CAST(shard AS INT) AS shard, CAST(slot + rank - lo AS BIGINT) AS slot, CAST(NULL AS INT) AS grown_shard
FROM ranked JOIN pieces USING (arc) WHERE rank >= lo AND rank < hi"""
