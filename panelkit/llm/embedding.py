"""Near-duplicate embeddings by int8 tile products with rigorous error bounds.

Equal vectors form a class; one vector stands for it. A class has a 64-bit id, and a second hash shows if two different
vectors ever share one; then all ids are made anew. Classes are dealt into blocks by hash, bounded in vectors and bytes,
and each pair of blocks is a tile of a bounded size, so a task never holds more than two blocks. In a tile all vectors are scaled to length 1 and
rounded to 8 bits, ``u = s q + e``, and the length ``d`` of each rounding error is kept. For two vectors the product of
the rounded ones differs from the cosine by at most ``d_u + d_v + d_u d_v``: what is surely above or below the threshold
is settled by the integer product (exact in a float product of such small integers), and only pairs for which it could go
either way are computed again in double precision.

A tile returns a number of links per vector and, for what it links, edges of a spanning forest: no more rows than it
holds vectors, however many of them are alike.

All pairs of distinct vectors are looked at: the work is quadratic in their number, which is what a complete answer for
vectors without structure costs.

Defined cases: vectors that are null, empty, zero or hold null or non-finite components are linked with nothing and kept;
vectors of different lengths are never linked; repeated rows are copies of each other; a null id never names a component
unless all ids in it are null; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._components import components
from ._work import forget, keep, pick

COSINE = 0.95
#: Most vectors of a block, and the least number of blocks (so that few vectors still make enough tiles for all cores).
BLOCK, LEAST_BLOCKS = 16_384, 8
#: Bytes of a block's vectors in double precision; a tile holds two blocks, and a copy of parts of them at a time.
BLOCK_BYTES = 64 << 20
#: Should two different vectors share a 64-bit id, which a second hash shows, all ids are made anew.
SALTS = 4
#: Side of the products within a tile.
SIDE = 1024
#: More than any rounding of the double arithmetic here, for dimensions up to a million.
EPSILON = 1e-9
#: Dimensions whose products of 7-bit integers a 24-bit mantissa adds up exactly.
EXACT_DIMENSIONS = 1024


def unit(x: np.ndarray) -> np.ndarray:
    """Rows scaled to length 1, in double precision."""
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def quantised(u: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``q, s, d``: int8 rows, their scales, and a bound on the length of ``u - s q``."""
    s = np.abs(u).max(axis=1) / 127.0
    q = np.rint(u / s[:, None]).astype(np.int8)
    error = u - s[:, None] * q
    return q, s, np.sqrt((error * error).sum(axis=1)) + EPSILON


def tile_links(u: np.ndarray, v: np.ndarray, qu: tuple, qv: tuple, cosine: float) -> tuple[np.ndarray, np.ndarray]:
    """Index pairs with cosine at or above the threshold."""
    (q, s, d), (r, t, e) = qu, qv
    dims = q.shape[1]
    if dims <= EXACT_DIMENSIONS:
        product = q.astype(np.float32) @ r.astype(np.float32).T
    else:
        product = sum((q[:, k : k + EXACT_DIMENSIONS].astype(np.float32) @ r[:, k : k + EXACT_DIMENSIONS].astype(np.float32).T).astype(np.float64) for k in range(0, dims, EXACT_DIMENSIONS))
    worst = d.max() + e.max() + d.max() * e.max()
    # below this no pair of the row can reach the threshold, whatever the column's scale and error
    floor = (cosine - worst) / (s * t.max()) if cosine > worst else np.full(len(s), -np.inf)
    i, j = np.nonzero(product >= (floor * (1 - 1e-6) - 1e-3).astype(np.float32)[:, None])
    value = product[i, j].astype(np.float64) * s[i] * t[j]
    bound = d[i] + e[j] + d[i] * e[j]
    sure = value - bound >= cosine
    open_ = np.flatnonzero(~sure & (value + bound >= cosine))
    for k in range(0, len(open_), 1 << 16):
        some = open_[k : k + (1 << 16)]
        sure[some] = np.einsum("nd,nd->n", u[i[some]], v[j[some]]) >= cosine
    return i[sure], j[sure]


def forest(n: int, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Edges that join what the links a-b join: each node to the least of its component."""
    label = np.arange(n)
    while True:
        before = label.copy()
        low = np.minimum(label[a], label[b])
        np.minimum.at(label, a, low)
        np.minimum.at(label, b, low)
        label = label[label]
        if (label == before).all():
            node = np.flatnonzero(label != np.arange(n))
            return label[node], node


def _tile(rows: pa.Table, cosine: float) -> pa.Table:
    ids, copies = rows.column("set_id").to_numpy(), rows.column("m").to_numpy()
    block = rows.column("block").to_numpy()
    size = rows.column("embedding").combine_chunks().value_lengths().to_numpy()
    links = np.zeros(len(ids), dtype=np.int64)
    edges_a, edges_b = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
    own = bool(rows.column("own")[0].as_py())
    for dims in np.unique(size).tolist():
        mine = np.flatnonzero(size == dims)
        sides = [mine[block[mine] == k] for k in np.unique(block[mine])]
        if len(sides) == 1 and not own:
            continue  # the other block has no such vector
        # vectors stay as they came; doubles, and their rounded form, are made for one part of each side at a time
        left = [(part, *_part(rows, part, dims)) for part in _parts(sides[0])]
        for k, part in enumerate(_parts(sides[-1])):
            _, v, qv = left[k] if own else (part, *_part(rows, part, dims))
            for p, (rows_a, u, qu) in enumerate(left):
                if own and k < p:
                    continue
                i, j = tile_links(u, v, qu, qv, cosine)
                if own and k == p:
                    i, j = i[i < j], j[i < j]
                if not len(i):
                    continue
                links += np.bincount(rows_a[i], weights=copies[part[j]], minlength=len(ids)).astype(np.int64)
                links += np.bincount(part[j], weights=copies[rows_a[i]], minlength=len(ids)).astype(np.int64)
                a, b = forest(len(rows_a) + len(part), i, j + len(rows_a))
                both = np.concatenate([rows_a, part])
                edges_a.append(both[a])
                edges_b.append(both[b])
    a, b = forest(len(ids), np.concatenate(edges_a), np.concatenate(edges_b))
    some = np.flatnonzero(links)
    return pa.table({"set_id": np.concatenate([ids[some], ids[b]]), "links": np.concatenate([links[some], np.zeros(len(b), np.int64)]), "to": pa.concat_arrays([pa.nulls(len(some), pa.int64()), pa.array(ids[a], pa.int64())])})


def _parts(rows: np.ndarray) -> list[np.ndarray]:
    return [rows[k : k + SIDE] for k in range(0, len(rows), SIDE)]


def _part(rows: pa.Table, some: np.ndarray, dims: int) -> tuple[np.ndarray, tuple]:
    """Unit vectors of some rows, and their rounded form."""
    flat = rows.column("embedding").take(pa.array(some)).combine_chunks().flatten().to_numpy(zero_copy_only=False)
    u = unit(flat.astype(np.float64).reshape(len(some), dims))
    return u, quantised(u)


def near_duplicates(vectors: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding", cosine: float = COSINE) -> DataFrame:
    """vec_id, n_links, component_id, kept: one row per input row."""
    rows = pick(vectors, vec_id=vec_id, embedding=embedding)
    finite = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    valid = F.coalesce(F.col("embedding").isNotNull() & (F.size("embedding") > 0) & finite & F.exists("embedding", lambda x: x != 0), F.lit(False))
    rows = rows.withColumn("valid", valid)
    for salt in range(SALTS):
        named = rows.withColumn("set_id", F.when(F.col("valid"), F.xxhash64(F.lit(salt), "embedding")))
        check = F.xxhash64(F.lit(-1 - salt), "embedding")
        parts = [F.min("vec_id").alias("low"), F.count(F.lit(1)).alias("m"), F.any_value("embedding").alias("embedding"), F.min(check).alias("check"), F.max(check).alias("check_too")]
        classes = keep(named.where("valid").groupBy("set_id").agg(*parts), "embedding-classes")
        held = classes.agg(F.count(F.lit(1)).alias("n"), F.sum(F.size("embedding")).alias("size"), F.coalesce(F.max(F.col("check") != F.col("check_too")), F.lit(False)).alias("mixed")).first()
        if not held["mixed"]:
            break
        forget(classes)
    else:
        raise RuntimeError("different vectors share an id under every salt")
    rows = named
    blocks = max(LEAST_BLOCKS, -(-held["n"] // BLOCK), -(-(held["size"] or 0) * 8 // BLOCK_BYTES))
    dealt = (
        classes.select("set_id", "m", "embedding", F.pmod("set_id", F.lit(blocks)).cast("int").alias("block"))
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
        .withColumn("tile", F.least("block", "other").cast("long") * blocks + F.greatest("block", "other"))
        .withColumn("own", F.col("block") == F.col("other"))
        .select("tile", "block", "own", "set_id", "m", "embedding")
    )

    def work(table: pa.Table) -> pa.Table:
        return _tile(table, cosine)

    found = keep(dealt.groupBy("tile").applyInArrow(work, "set_id long, links long, to long"), "embedding-tiles")
    linked = components(found.where("to IS NOT NULL").select(F.col("set_id").alias("a"), F.col("to").alias("b")), "embedding")
    counts = found.groupBy("set_id").agg(F.sum("links").alias("links"))
    named = classes.select("set_id", "low", "m").join(linked.withColumnRenamed("node", "set_id"), "set_id", "left").withColumn("component", F.coalesce("component", "set_id"))
    least = named.groupBy("component").agg(F.min("low").alias("component_id"))
    by_class = keep(
        named.join(least, "component").join(counts, "set_id", "left").select("set_id", "component_id", (F.coalesce("links", F.lit(0)) + F.col("m") - 1).alias("n_links")),
        "embedding-components",
    )
    full = rows.where("set_id IS NOT NULL").select("vec_id", "set_id").join(by_class, "set_id").select("vec_id", "n_links", "component_id")
    none = rows.where("set_id IS NULL").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return full.unionByName(none).withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))


def op8_embedding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links and components of all ``embeddings``."""
    return near_duplicates(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


OP8_SQL = """
WITH v AS (
  SELECT row_number() OVER () AS rid, vec_id,
         CASE WHEN len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0
                   AND len(list_filter(embedding, lambda x: x <> 0)) > 0
              THEN list_transform(embedding, lambda x: CAST(x AS DOUBLE)) END AS e
  FROM embeddings
), u AS (
  SELECT a.rid AS a, b.rid AS b FROM v a JOIN v b ON a.rid < b.rid AND len(a.e) = len(b.e)
  WHERE list_cosine_similarity(a.e, b.e) >= 0.95
), l AS (SELECT a AS src, b AS dst FROM u UNION ALL SELECT b, a FROM u),
n AS (SELECT src, count(*) AS n FROM l GROUP BY src)
SELECT * FROM (
WITH RECURSIVE reach(src, dst) AS (
  SELECT rid, rid FROM v
  UNION
  SELECT reach.src, l.dst FROM reach JOIN l ON reach.dst = l.src
)
SELECT x.vec_id AS vec_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_links, min(y.vec_id) AS component_id, x.vec_id = min(y.vec_id) AS kept
FROM reach JOIN v x ON x.rid = reach.src JOIN v y ON y.rid = reach.dst LEFT JOIN n ON n.src = reach.src
GROUP BY x.rid, x.vec_id, n.n)
"""
