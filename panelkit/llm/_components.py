"""Connected components of a link table by contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._work import forget, keep

#: Contraction ends long before: each round a constant share of the nodes goes, as ids are hashes.
MAX_ROUNDS = 100


def components(links: DataFrame, tag: str) -> DataFrame:
    """node, component (the least node id of those reachable isn't promised, only one id per component).

    links: a, b; node ids must be hashes, so that their order is random. Every round each node points to its least
    neighbour, links are rewritten to what their ends point to, and links within one node and repeats go. Sums and
    minima are combined before each shuffle, so a hub with very many links is no hot task; its joins can be split.
    """
    edges = keep(links.where("a <> b").select("a", "b").distinct(), f"{tag}-edges")
    labels = keep(edges.select(F.explode(F.array("a", "b")).alias("node")).distinct().withColumn("component", F.col("node")), f"{tag}-labels")
    for _ in range(MAX_ROUNDS):
        if edges.isEmpty():
            break
        both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        parents = keep(both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("low")).select("node", F.least("node", "low").alias("parent")), f"{tag}-parents")
        to_a, to_b = parents.select(F.col("node").alias("a"), F.col("parent").alias("pa")), parents.select(F.col("node").alias("b"), F.col("parent").alias("pb"))
        shrunk = edges.join(to_a, "a").join(to_b, "b").where("pa <> pb").select(F.least("pa", "pb").alias("a"), F.greatest("pa", "pb").alias("b")).distinct()
        renamed = labels.join(parents.select(F.col("node").alias("component"), "parent"), "component", "left").select("node", F.coalesce("parent", "component").alias("component"))
        old_edges, old_labels = edges, labels
        edges, labels = keep(shrunk, f"{tag}-edges"), keep(renamed, f"{tag}-labels")
        for x in (old_edges, old_labels, parents):
            forget(x)
    else:
        raise RuntimeError("components didn't converge")
    return labels
