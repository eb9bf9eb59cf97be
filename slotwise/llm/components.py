"""Connected components of a table of links, in rounds of joins."""

from __future__ import annotations

from itertools import count

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from slotwise.llm.common import stored


def _with_least(edges: DataFrame) -> DataFrame:
    """(u, v, m): edges in both directions and the least of u and its neighbours."""
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return both.join(least, "u")


def components(links: DataFrame, rounds: int | None = None, most: int | None = None) -> DataFrame:
    """(node, label) for every node of ``links`` (u, v); the label is the component's least node.

    Large-star and small-star steps in turn: every node hangs its larger, then
    its smaller neighbours under the least one it knows, until nothing changes.
    No step gathers a node's neighbours; a hub's rows are split by adaptive
    execution. Rounds grow with the logarithm of the longest path; with ``rounds``
    given, links that need more are an error. ``most`` bounds the number of links;
    no round makes more of them.
    """
    edges = stored(links.filter("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges", most=most)
    most = edges.count()
    before = None
    for done in count():
        if done == rounds:
            raise RuntimeError(f"components still change after {rounds} rounds")
        large = _with_least(edges).filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()
        low = large.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
        least = low.groupBy("u").agg(F.min("v").alias("m"))
        small = low.join(least, "u")
        edges = stored(small.filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(
            least.select("u", F.col("m").alias("v"))).distinct(), "edges", most=most)
        state = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state == before:
            break
        before = state
    labels = edges.groupBy("u").agg(F.min("v").alias("label")).select(F.col("u").alias("node"), "label")
    roots = edges.select(F.col("v").alias("node")).distinct().join(labels.select("node"), "node", "left_anti")
    return labels.unionByName(roots.select("node", F.col("node").alias("label")))
