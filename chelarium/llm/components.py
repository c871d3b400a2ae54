"""Connected components by alternating large-star and small-star contraction.

Scale: edges are distinct pairs; each step is an aggregation with map-side combine and a join on the node.
Nodes with many neighbours (more than 1/HOT_NODES of all edges, hence fewer than twice HOT_NODES of them) meet their edges through a
broadcast of bounded size, all others through a shuffle join without hot keys. Each round is written to the
shared folder, so lost executors repeat one round at most. Neither edges nor labels go to the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chelarium.session import drop_settled, settle

HOT_NODES = 2000
MAX_ROUNDS = 60


def hot_from(total: int) -> int:
    """Rows from which a key is hot; no more than HOT_NODES keys can be."""
    return max(1000, total // HOT_NODES)


def join_summary(rows: DataFrame, summary: DataFrame, key: str, total: int, count: str = "n") -> DataFrame:
    """rows joined with summary, one row per key that counts the key's rows in `count`, without hot keys in any shuffle."""
    hot = F.col(count) >= hot_from(total)
    return rows.join(F.broadcast(summary.where(hot)), key).unionByName(rows.join(summary.where(~hot), key))


def link_edges(links: DataFrame) -> DataFrame:
    """(u, v), u > v: every node with the smallest node of each of its links; links: node, link, distinct rows."""
    total = links.count()
    least = links.groupBy("link").agg(F.min("node").alias("v"), F.count("*").alias("n")).where("n > 1")
    return join_summary(links, least, "link", total).where("node > v").select(F.col("node").alias("u"), "v").distinct()


def _star(pairs: DataFrame, total: int, hot: bool) -> DataFrame:
    """pairs (u, v) with the smallest v of each u as m; hot: whether any u may have hot_from(total) rows."""
    least = pairs.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n"))
    return join_summary(pairs, least, "u", total) if hot else pairs.join(least, "u")


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, root) of all nodes that edges (u, v) connect with another; root is the smallest node of the component.

    Roots have a row of their own. Self-loops and null ends connect nothing; an empty table gives no row.
    """
    current = settle(edges.where("u IS NOT NULL AND v IS NOT NULL AND u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    state = None
    for _ in range(MAX_ROUNDS):
        both = current.unionByName(current.select(F.col("v").alias("u"), F.col("u").alias("v")))
        per_node = both.groupBy("u").agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h"))
        digest = per_node.agg(F.sum("n"), F.sum("h"), F.max("n")).first()
        if tuple(digest) == state:
            break
        state = tuple(digest)
        total = max(1, (state[0] or 0) // 2)
        # afterwards a node has edges to smaller ones only, and no more of them than it had edges before
        hot = (state[2] or 0) >= hot_from(total)
        large = _star(both, 2 * total, hot).where("v > u").select(F.col("v").alias("u"), F.least("m", "u").alias("v")).where("u <> v").distinct()
        # large keeps u > v: the new end is at most the old, smaller one
        starred = _star(large, total, hot)
        small = starred.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(starred.select("u", F.col("m").alias("v"))).distinct()
        before, current = current, settle(small)
        drop_settled(current.sparkSession, before)
    else:
        raise RuntimeError(f"components did not settle in {MAX_ROUNDS} rounds")
    named = current.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return named.unionByName(current.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
