"""Terrain routing on a pixel table: flood levels, flow directions, accumulation, height above drainage, flood fill.

Flood levels are the bottleneck routine with signs turned: the level of a cell is the smallest, over paths to an outlet,
of the largest elevation on the path. Accumulation and drainage follow pointers by doubling, so that the number of
rounds grows with the logarithm of the longest flow path.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cutoffs.contraction import connected_components
from cutoffs.operators.raster import neighbours
from cutoffs.operators.reach import isolation_times
from cutoffs.session import materialize

#: Cells are numbered row * WIDE + col.
WIDE = 1 << 20


def number(cells: DataFrame) -> DataFrame:
    return cells.withColumn("cell", F.col("row").cast("long") * WIDE + F.col("col").cast("long"))


def _pairs(cells: DataFrame) -> DataFrame:
    near = neighbours(cells.select("row", "col"))
    return near.select((F.col("row") * WIDE + F.col("col")).cast("long").alias("a"), (F.col("nrow") * WIDE + F.col("ncol")).cast("long").alias("b"))


def flood_levels(cells: DataFrame) -> DataFrame:
    """cells (row, col, elev, outlet) with cell number and level: the elevation that water must reach to drain."""
    c = materialize(number(cells))
    e = c.select("cell", "elev")
    edges = _pairs(c).filter("a < b").join(e.toDF("a", "ea"), "a").join(e.toDF("b", "eb"), "b")
    edges = edges.select(F.lit(0).alias("run"), F.xxhash64("a", "b").alias("edge_id"), F.col("a").alias("u"), F.col("b").alias("v"), (-F.greatest("ea", "eb")).alias("c"))
    out = c.filter("outlet").select(F.lit(0).alias("run"), F.col("cell").alias("node"), (-F.col("elev")).alias("a"))
    b = isolation_times(edges, out, ["run"]).select(F.col("node").alias("cell"), (-F.col("b")).alias("level"))
    return c.join(b, "cell", "left")


def flow_directions(levels: DataFrame) -> DataFrame:
    """(cell, down): the neighbour that each cell drains to, itself for an outlet.

    The neighbour has the smallest (level, steps across the flat to a lower cell, cell number).
    """
    lv = materialize(levels.select("row", "col", "cell", "level", "outlet"))
    near = materialize(_pairs(lv).join(lv.select(F.col("cell").alias("a"), F.col("level").alias("la"), F.col("outlet").alias("oa")), "a").join(lv.select(F.col("cell").alias("b"), F.col("level").alias("lb"), F.col("outlet").alias("ob")), "b"))
    hops = materialize(near.groupBy("a").agg(F.max(((F.col("lb") < F.col("la")) | F.col("oa")).cast("int")).alias("d")).filter("d = 1").select(F.col("a").alias("cell"), F.lit(0).alias("hops")))
    flat = materialize(near.filter("la = lb").select("a", "b"))
    step = 0
    while True:  # as many rounds as the widest flat has steps
        front = hops.filter(F.col("hops") == step).select(F.col("cell").alias("b"))
        new = flat.join(front, "b").select(F.col("a").alias("cell")).distinct().join(hops, "cell", "left_anti")
        new = materialize(new.withColumn("hops", F.lit(step + 1)))
        if new.isEmpty():
            break
        hops, step = materialize(hops.union(new)), step + 1
    far = near.filter("not oa").join(hops.toDF("b", "hb"), "b", "left").join(hops.toDF("a", "ha"), "a", "left")
    lower = far.filter("lb < la or (lb = la and coalesce(hb, 1000000000) < coalesce(ha, 1000000000)) or ob and lb <= la")
    pick = lower.groupBy("a").agg(F.min(F.struct("lb", F.coalesce("hb", F.lit(0)).alias("h"), "b")).alias("m"))
    return lv.join(pick.select(F.col("a").alias("cell"), F.col("m.b").alias("to")), "cell", "left").select("cell", F.when(F.col("outlet"), F.col("cell")).otherwise(F.coalesce("to", "cell")).alias("down"))


def _rounds(cells: DataFrame) -> range:
    """As many doublings as the longest path through all cells can need, and one to see that nothing moves."""
    return range(int(cells.count()).bit_length() + 2)


def accumulate(down: DataFrame) -> DataFrame:
    """(cell, acc): cells that drain through each cell, itself included."""
    cur = materialize(down.select("cell", F.when(F.col("down") != F.col("cell"), F.col("down")).alias("to"), F.lit(1).cast("long").alias("acc")))
    for _ in _rounds(cur):
        if cur.filter("to is not null").isEmpty():
            return cur.select("cell", "acc")
        add = cur.filter("to is not null").groupBy("to").agg(F.sum("acc").alias("_add")).withColumnRenamed("to", "cell")
        up = cur.select(F.col("cell").alias("to"), F.col("to").alias("_next"))
        cur = materialize(cur.join(add, "cell", "left").join(up, "to", "left").select("cell", F.col("_next").alias("to"), (F.col("acc") + F.coalesce("_add", F.lit(0))).alias("acc")))
    raise ValueError("the pointers from cell to cell run in a circle")


def height_above_drainage(cells: DataFrame, stream_cells: int = 124) -> DataFrame:
    """cells (row, col, elev, outlet, water) with level, down, acc and hand.

    Drainage cells are those with enough cells above, outlets and permanent water; hand is the elevation over the first
    one downstream, 0 at least.
    """
    lv = materialize(flood_levels(cells))
    down = materialize(flow_directions(lv))
    acc = accumulate(down)
    all_ = materialize(lv.join(down, "cell").join(acc, "cell").withColumn("drain", (F.col("acc") >= stream_cells) | F.col("outlet") | F.col("water")))
    cur = materialize(all_.select("cell", F.when(F.col("drain"), F.col("cell")).otherwise(F.col("down")).alias("to")))
    for _ in _rounds(cur):
        up = cur.select(F.col("cell").alias("to"), F.col("to").alias("_next"))
        nxt = materialize(cur.join(up, "to", "left").select("cell", F.coalesce("_next", "to").alias("to"), (F.coalesce("_next", "to") != F.col("to")).alias("_moved")))
        cur = nxt.select("cell", "to")
        if nxt.filter("_moved").isEmpty():
            break
    else:
        raise ValueError("the pointers from cell to cell run in a circle")
    base = all_.select(F.col("cell").alias("to"), F.col("elev").alias("_base"))
    out = all_.join(cur, "cell").join(base, "to")
    return out.select("row", "col", "elev", "level", "acc", F.greatest(F.lit(0.0), F.col("elev") - F.col("_base")).alias("hand"))


def flood_fill(wet: DataFrame, keys: list[str]) -> DataFrame:
    """Wet cells (keys, row, col, seed) that are joined to a seed through wet cells (8 neighbours), for all keys at once."""
    w = materialize(wet.select(*keys, "row", "col", "seed"))
    name = lambda r, c: F.struct(*keys, F.col(r).alias("row"), F.col(c).alias("col"))
    near = neighbours(w.select(*keys, "row", "col"), keys).select(name("row", "col").alias("u"), name("nrow", "ncol").alias("v"))
    comp = connected_components(near).withColumnRenamed("node", "n")
    named = materialize(w.withColumn("n", name("row", "col")).join(comp, "n", "left").withColumn("k", F.coalesce("component", "n")))
    return named.join(named.filter("seed").select("k").distinct(), "k", "left_semi").select(*keys, "row", "col")
