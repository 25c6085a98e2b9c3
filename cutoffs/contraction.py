"""Graph contraction on DataFrames: connected components by min-hooking and pointer jumping.

Each round every node hooks to its smallest neighbour, pointers are doubled to the roots and the edges are relabelled;
edges inside a component disappear, so later rounds work on ever smaller tables. Rounds grow with the logarithm of
the number of nodes, not with the diameter. Every step is a join or an aggregation with map-side combine.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cutoffs.session import materialize


#: Rows that a join may broadcast, at most: a plan takes a table's size from its files, which are far smaller than its rows.
BROADCAST_ROWS = 200_000


def pointer_roots(parent: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """(keys, node, parent) with parent <= node, roots pointing at themselves or absent -> (keys, node, root)."""
    cur = materialize(parent.select(*keys, "node", "parent"))
    large = cur.count() > BROADCAST_ROWS
    while True:
        up = _shuffled(cur.select(*keys, F.col("node").alias("parent"), F.col("parent").alias("_up")), large)
        nxt = materialize(cur.join(up, [*keys, "parent"], "left").select(*keys, "node", F.coalesce("_up", "parent").alias("parent"), (F.col("_up") < F.col("parent")).alias("_moved")))
        if nxt.filter("_moved").isEmpty():
            return nxt.select(*keys, "node", F.col("parent").alias("root"))
        cur = nxt.select(*keys, "node", "parent")


def _shuffled(df: DataFrame, large: bool) -> DataFrame:
    return df.hint("merge") if large else df


def connected_components(edges: DataFrame, u: str = "u", v: str = "v", keys: Sequence[str] = ()) -> DataFrame:
    """Component of each node that has an edge: (keys, node, component), component = smallest node in it.

    Null endpoints and self-loops link nothing; a node seen only in self-loops is its own component. With keys, which aren't
    null, each key has a graph of its own; all take their rounds together.
    """
    e = edges.select(*keys, F.col(u).alias("a"), F.col(v).alias("b")).filter("a is not null and b is not null")
    own = e.filter("a = b").select(*keys, F.col("a").alias("node")).distinct()
    live = materialize(e.filter("a <> b").select(*keys, F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    labels, many = None, False
    while not live.isEmpty():
        both = live.union(live.select(*keys, "b", "a")).toDF(*keys, "node", "nbr")
        parent = both.groupBy(*keys, "node").agg(F.min("nbr").alias("m")).select(*keys, "node", F.least("m", "node").alias("parent"))
        root = pointer_roots(parent, keys)
        large = root.count() > BROADCAST_ROWS
        if labels is None:  # the first round has a root for every node with an edge
            labels, many = root.select(*keys, "node", F.col("root").alias("component")), large
        else:
            labels = materialize(labels.join(_shuffled(root.withColumnRenamed("node", "component"), large), [*keys, "component"], "left").select(*keys, "node", F.coalesce("root", "component").alias("component")))
        ra, rb = (_shuffled(root.toDF(*keys, end, f"r{end}"), large) for end in ("a", "b"))
        live = materialize(live.join(ra, [*keys, "a"]).join(rb, [*keys, "b"]).filter("ra <> rb").select(*keys, F.least("ra", "rb").alias("a"), F.greatest("ra", "rb").alias("b")).distinct())
    alone = own.select(*keys, "node", F.col("node").alias("component"))
    return alone if labels is None else labels.union(alone.join(_shuffled(labels, many), [*keys, "node"], "left_anti"))
