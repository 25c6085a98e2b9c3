"""Spatial joins by grid buckets: nearest, within a radius, point in polygon, distance to lines, crossings, suppression.

Each join puts both sides into cells of a grid and joins on the cell, so that a row meets its surroundings and nothing
else. Points are (x, y) in metres, or in degrees where that is said; polygons are rings ARRAY<STRUCT<x, y>>.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cutoffs.session import materialize


def cell(v: str | Column, size: float) -> Column:
    return F.floor((F.col(v) if isinstance(v, str) else v) / size)


def near_pairs(left: DataFrame, right: DataFrame, radius: float, extra: list[str] | None = None) -> DataFrame:
    """Pairs of (id, x, y) and (rid, rx, ry) at most radius apart, with `dist`; rows of `right` are copied to 9 cells."""
    keys = extra or []
    a = left.withColumn("_cx", cell("x", radius)).withColumn("_cy", cell("y", radius))
    around = [F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in (-1, 0, 1) for j in (-1, 0, 1)]
    b = right.withColumn("_o", F.explode(F.array(*around)))
    b = b.withColumn("_cx", cell("rx", radius) + F.col("_o.i")).withColumn("_cy", cell("ry", radius) + F.col("_o.j")).drop("_o")
    out = a.join(b.hint("merge"), [*keys, "_cx", "_cy"]).withColumn("dist", F.hypot(F.col("x") - F.col("rx"), F.col("y") - F.col("ry")))
    return out.filter(F.col("dist") <= radius).drop("_cx", "_cy")


def nearest(left: DataFrame, right: DataFrame, first_radius: float) -> DataFrame:
    """(left columns, rid, dist) of the nearest right point (ties: smallest rid), by rings of growing radius.

    Points that find none within a radius go on to the next, twice as large, until all have one. A null rid is left where
    a point has no place, or if no right point has one.
    """
    cols = left.columns
    placed = materialize(left.withColumn("_ok", _placed("x", "y")))
    done, rest, radius = placed.filter("not _ok").select(*cols), placed.filter("_ok").select(*cols), first_radius
    right = materialize(right.select("rid", "rx", "ry").filter(_placed("rx", "ry")))
    no = [F.lit(None).cast(right.schema["rid"].dataType).alias("rid"), F.lit(None).cast("double").alias("dist")]
    if right.isEmpty():
        return left.select(*cols, *no)
    done = done.select(*cols, *no)
    while not rest.isEmpty():
        best = near_pairs(rest.select("id", "x", "y"), right, radius).groupBy("id").agg(F.min(F.struct("dist", "rid")).alias("_m"))
        both = materialize(rest.join(best, "id", "left"))
        hit = both.filter("_m is not null").select(*cols, F.col("_m.rid").alias("rid"), F.col("_m.dist").alias("dist"))
        done = done.union(hit)
        rest = both.filter("_m is null").select(*cols)
        radius *= 2
    return done


def _placed(x: str, y: str) -> Column:
    """Whether both coordinates are finite numbers."""
    return F.coalesce((F.abs(F.col(x)) < 1e300) & (F.abs(F.col(y)) < 1e300), F.lit(False))


def snap(points: DataFrame, nodes: DataFrame, max_m: float = 2000.0, first_radius: float = 500.0) -> DataFrame:
    """Points (id, x, y) with node_id, snap_dist_m and `unsnapped` (farther than max_m) from nodes of the main component."""
    main = nodes.filter("component_main").select(F.col("node_id").alias("rid"), F.col("x").alias("rx"), F.col("y").alias("ry"))
    out = nearest(points, main, first_radius)
    return out.withColumnRenamed("rid", "node_id").withColumnRenamed("dist", "snap_dist_m").withColumn("unsnapped", F.coalesce(F.col("snap_dist_m") > max_m, F.lit(True)))


def radius_sum(left: DataFrame, right: DataFrame, radius: float, value: str) -> DataFrame:
    """(id, total): sum of a value of the right points within radius of each left point, 0 if none."""
    total = near_pairs(left, right, radius).groupBy("id").agg(F.sum(value).alias("total"))
    return left.select("id").join(total, "id", "left").withColumn("total", F.coalesce("total", F.lit(0.0)))


def first_within(left: DataFrame, moving: DataFrame, radius: float) -> DataFrame:
    """(id, hour): first hour at which a moving point (rid, rx, ry, hour) is within radius."""
    return near_pairs(left, moving, radius).groupBy("id").agg(F.min("hour").alias("hour"))


def inside(ring: Column, x: Column, y: Column) -> Column:
    """Whether a point is in a closed ring, by the parity of edges crossed to its right."""
    edges = F.zip_with(F.slice(ring, 1, F.size(ring) - 1), F.slice(ring, 2, F.size(ring) - 1), lambda a, b: F.struct(a.alias("a"), b.alias("b")))

    def crossed(n: Column, e: Column) -> Column:
        a, b = e["a"], e["b"]
        spans = (a["y"] > y) != (b["y"] > y)
        hit = F.when(spans, x < (b["x"] - a["x"]) * (y - a["y"]) / (b["y"] - a["y"]) + a["x"]).otherwise(False)
        return n + hit.cast("int")

    return F.aggregate(edges, F.lit(0), crossed) % 2 == 1


def _covering(polygons: DataFrame, size: float, margin: float = 0.0) -> DataFrame:
    """A row of each polygon for each grid cell of its bounding box (widened by margin): _cx, _cy."""
    xs, ys = F.transform("ring", lambda p: p["x"]), F.transform("ring", lambda p: p["y"])
    span = lambda v: F.sequence(F.floor((F.array_min(v) - margin) / size), F.floor((F.array_max(v) + margin) / size))
    return polygons.withColumn("_cx", F.explode(span(xs))).withColumn("_cy", F.explode(span(ys)))


def within(points: DataFrame, polygons: DataFrame, size: float) -> DataFrame:
    """points with `polygon_id`: the smallest id of the polygons that hold the point, null if none does."""
    cover = _covering(polygons.select("polygon_id", "ring"), size)
    p = points.withColumn("_cx", cell("x", size)).withColumn("_cy", cell("y", size))
    hit = p.join(cover, ["_cx", "_cy"]).filter(inside(F.col("ring"), F.col("x"), F.col("y"))).groupBy("id").agg(F.min("polygon_id").alias("polygon_id"))
    return points.join(hit, "id", "left")


def segment_distance(px: Column, py: Column, ax: Column, ay: Column, bx: Column, by: Column) -> Column:
    dx, dy = bx - ax, by - ay
    t = F.when(dx * dx + dy * dy > 0, ((px - ax) * dx + (py - ay) * dy) / (dx * dx + dy * dy)).otherwise(0.0)
    t = F.least(F.lit(1.0), F.greatest(F.lit(0.0), t))
    return F.hypot(px - ax - t * dx, py - ay - t * dy)


def segments(lines: DataFrame, line: str = "line", keep: list[str] | None = None) -> DataFrame:
    """(keep, seq, ax, ay, bx, by): a row per segment of each line."""
    pts = F.col(line)
    pairs = F.zip_with(F.slice(pts, 1, F.size(pts) - 1), F.slice(pts, 2, F.size(pts) - 1), lambda a, b: F.struct(a.alias("a"), b.alias("b")))
    out = lines.filter(F.size(pts) >= 2).select(*(keep or []), F.posexplode(pairs).alias("seq", "s"))
    return out.select(*(keep or []), "seq", F.col("s.a.x").alias("ax"), F.col("s.a.y").alias("ay"), F.col("s.b.x").alias("bx"), F.col("s.b.y").alias("by"))


def line_distance(points: DataFrame, lines: DataFrame, first_radius: float, most: float | None = None) -> DataFrame:
    """(id, line_id, dist): nearest line of each point (ties: smallest line_id), by boxes of growing width."""
    return segment_nearest(points, segments(lines, "line", ["line_id"]), first_radius, most)


def segment_nearest(points: DataFrame, seg: DataFrame, first_radius: float, most: float | None = None) -> DataFrame:
    """(id, line_id, dist): the nearest of segments (line_id, ax, ay, bx, by), which a line may have in any number of rows.

    Points without a place, and those with none within `most`, are left out; so are all if there is no segment. Points at
    one place are searched for once. Cells start at the size at which one holds about four places, if that is finer than
    first_radius, and a segment goes only to the cells that it passes, so that neither side grows with the other.
    """
    seg = materialize(seg.select("line_id", "ax", "ay", "bx", "by").filter(_placed("ax", "ay") & _placed("bx", "by")))
    placed = points.select("id", "x", "y").filter(_placed("x", "y"))
    rest = materialize(placed.select("x", "y").distinct())
    done = rest.limit(0).select("x", "y", F.lit(None).cast(seg.schema["line_id"].dataType).alias("line_id"), F.lit(None).cast("double").alias("dist"))
    if seg.isEmpty():
        return placed.join(done, ["x", "y"]).select("id", "line_id", "dist")
    radius = None
    while not rest.isEmpty():
        n, *box = rest.agg(F.count("*"), F.min("x"), F.max("x"), F.min("y"), F.max("y")).first()
        if radius is None:
            fine = math.sqrt((box[1] - box[0]) * (box[3] - box[2]) / n) / 2
            radius = min(first_radius, fine) if fine > 0 else first_radius
        radius = radius if most is None else min(radius, most)
        size = radius * CELL_RADII
        p = rest.withColumn("_cx", cell("x", size)).withColumn("_cy", cell("y", size))
        d = segment_distance(*(F.col(c) for c in ("x", "y", "ax", "ay", "bx", "by")))
        # a segment's rows in cells are many times its rows, which a plan's estimate doesn't know: never broadcast
        met = p.join(passed(seg, size, radius, *box).hint("merge"), ["_cx", "_cy"])
        best = met.withColumn("dist", d).filter(F.col("dist") <= radius).groupBy("x", "y").agg(F.min(F.struct("dist", "line_id")).alias("_m"))
        both = materialize(rest.join(best, ["x", "y"], "left"))
        done = done.union(both.filter("_m is not null").select("x", "y", F.col("_m.line_id").alias("line_id"), F.col("_m.dist").alias("dist")))
        if radius == most:
            break
        rest = both.filter("_m is null").select("x", "y")
        radius *= 2
    return placed.join(done, ["x", "y"]).select("id", "line_id", "dist")


#: Width of a cell in radii where segments are searched.
CELL_RADII = 4.0


def passed(seg: DataFrame, size: float, radius: float, x0: float, x1: float, y0: float, y1: float) -> DataFrame:
    """A row of each segment (ax, ay, bx, by) for each cell in the box x0 to x1, y0 to y1 that has places within radius of it.

    Column by column of cells: the stretch of the segment that can be near a place of the column has the rows of cells.
    """
    r = radius * (1 + 1e-6)
    low, high = F.least("ax", "bx"), F.greatest("ax", "bx")
    at = lambda v: F.floor(v / size)
    left, right = F.greatest(at(low - r), at(F.lit(x0))), F.least(at(high + r), at(F.lit(x1)))
    columns = seg.withColumn("_l", left).withColumn("_r", right).filter("_l <= _r").withColumn("_cx", F.explode(F.sequence("_l", "_r")))
    slope = (F.col("by") - F.col("ay")) / (F.col("bx") - F.col("ax"))
    y_at = lambda x: F.when(F.col("bx") != F.col("ax"), F.col("ay") + (x - F.col("ax")) * slope)
    a, b = y_at(F.greatest(low, F.col("_cx") * size - r)), y_at(F.least(high, (F.col("_cx") + 1) * size + r))
    most, least = F.greatest("ay", "by"), F.least("ay", "by")
    slack = r + F.greatest(F.abs(F.col("ay")), F.abs(F.col("by")), F.abs(most - least)) * 1e-9
    under = F.coalesce(F.greatest(F.least(a, b), least), least) - slack
    over = F.coalesce(F.least(F.greatest(a, b), most), most) + slack
    rows = columns.withColumn("_l", F.greatest(at(under), at(F.lit(y0)))).withColumn("_r", F.least(at(over), at(F.lit(y1))))
    return rows.filter("_l <= _r").withColumn("_cy", F.explode(F.sequence("_l", "_r"))).drop("_l", "_r")


def nearest_polygon(points: DataFrame, polygons: DataFrame, size: float) -> DataFrame:
    """points with polygon_id and dist: the polygon that holds the point (0), else the one whose ring is nearest."""
    held = materialize(within(points, polygons, size))
    out = held.filter("polygon_id is not null").withColumn("dist", F.lit(0.0))
    misses = held.filter("polygon_id is null").drop("polygon_id")
    rings = polygons.select(F.col("polygon_id").alias("line_id"), F.col("ring").alias("line"))
    far = line_distance(misses, rings, size).withColumnRenamed("line_id", "polygon_id")
    return out.unionByName(misses.join(far, "id", "left"))


#: Pairs of segments that one task compares in a cell, about.
TASK_PAIRS = 100_000_000


def crossings(roads: DataFrame, waters: DataFrame, size: float, task_pairs: int = TASK_PAIRS) -> DataFrame:
    """(road_id, water_id, dist, x, y): where lines cross, with the distance along the road; inner crossings only.

    Cells are `size` wide, or as wide as the mean box of a segment if that is more. Two segments are compared in the first
    cell that both boxes have, and only there. A cell with more than task_pairs pairs deals its roads and its waters to
    blocks that meet like rows and columns: a segment is copied once for each block of the other side, so that what moves is
    the pairs divided by the width of a block, and not by a task's pairs with all waters each.
    """
    def cut(lines: DataFrame, name: str) -> DataFrame:
        s = segments(lines, "line", [name])
        run = Window.partitionBy(name).orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
        return materialize(s.withColumn("before", F.coalesce(F.sum(F.hypot(F.col("bx") - F.col("ax"), F.col("by") - F.col("ay"))).over(run), F.lit(0.0))))

    r, w = cut(roads, "road_id"), cut(waters, "water_id").select("water_id", "seq", F.col("ax").alias("cx"), F.col("ay").alias("cy"), F.col("bx").alias("dx"), F.col("by").alias("dy"))
    extent = lambda s, *c: s.agg(F.avg((F.abs(F.col(c[0]) - F.col(c[2])) + F.abs(F.col(c[1]) - F.col(c[3]))) / 2)).first()[0] or 0.0
    size = max(size, extent(r, "ax", "ay", "bx", "by"), extent(w, "cx", "cy", "dx", "dy"))

    def boxed(s: DataFrame, name: str, x0: str, y0: str, x1: str, y1: str) -> DataFrame:
        at = lambda f, a, b: F.floor(f(a, b) / size)
        s = s.withColumns({f"{name}x": at(F.least, x0, x1), f"{name}y": at(F.least, y0, y1)})
        return s.withColumn("_cx", F.explode(F.sequence(F.col(f"{name}x"), at(F.greatest, x0, x1)))).withColumn("_cy", F.explode(F.sequence(F.col(f"{name}y"), at(F.greatest, y0, y1))))

    rb, wb = boxed(r, "_r", "ax", "ay", "bx", "by"), boxed(w, "_w", "cx", "cy", "dx", "dy")
    count = lambda b, n: b.groupBy("_cx", "_cy").agg(F.count("*").alias(n))
    n = materialize(count(rb, "_nr").join(count(wb, "_nw"), ["_cx", "_cy"]).withColumn("_n", F.col("_nr") * F.col("_nw")))
    tasks = max(int(roads.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-(n.agg(F.sum("_n")).first()[0] or 0) // task_pairs))
    width = lambda other: F.greatest(F.lit(math.sqrt(task_pairs)), task_pairs / F.col(other))
    parts = n.select("_cx", "_cy", *[F.ceil(F.col(a) / width(b)).alias(f"_of{a[-1]}") for a, b in (("_nr", "_nw"), ("_nw", "_nr"))])
    dealt = lambda k, *by: F.pmod(F.xxhash64(*by), F.col(k)).cast("long")
    each = lambda k: F.explode(F.sequence(F.lit(0).cast("long"), F.col(k).cast("long") - 1))
    rb = rb.join(parts, ["_cx", "_cy"]).withColumn("_pr", dealt("_ofr", "road_id", "seq")).withColumn("_pw", each("_ofw")).drop("_ofr", "_ofw")
    wb = wb.join(parts, ["_cx", "_cy"]).withColumn("_pw", dealt("_ofw", "water_id", "seq")).withColumn("_pr", each("_ofr")).drop("_ofr", "_ofw", "seq")
    on = ["_cx", "_cy", "_pr", "_pw"]
    det = (F.col("bx") - F.col("ax")) * (F.col("dy") - F.col("cy")) - (F.col("by") - F.col("ay")) * (F.col("dx") - F.col("cx"))
    both = rb.repartition(tasks, *on).join(wb.repartition(tasks, *on).hint("merge"), on)
    both = both.filter((F.col("_cx") == F.greatest("_rx", "_wx")) & (F.col("_cy") == F.greatest("_ry", "_wy"))).withColumn("det", det).filter("det <> 0")
    t = ((F.col("cx") - F.col("ax")) * (F.col("dy") - F.col("cy")) - (F.col("cy") - F.col("ay")) * (F.col("dx") - F.col("cx"))) / F.col("det")
    u = ((F.col("cx") - F.col("ax")) * (F.col("by") - F.col("ay")) - (F.col("cy") - F.col("ay")) * (F.col("bx") - F.col("ax"))) / F.col("det")
    both = both.withColumn("t", t).withColumn("u", u).filter("t between 0 and 1 and u between 0 and 1")
    length = F.hypot(F.col("bx") - F.col("ax"), F.col("by") - F.col("ay"))
    out = both.select("road_id", "water_id", (F.col("before") + F.col("t") * length).alias("dist"), (F.col("ax") + F.col("t") * (F.col("bx") - F.col("ax"))).alias("x"), (F.col("ay") + F.col("t") * (F.col("by") - F.col("ay"))).alias("y"))
    # a crossing at a vertex is that of two segments; lines of one segment have none
    single = r.filter("seq > 0").isEmpty() and w.filter("seq > 0").isEmpty() and not _repeated(r, "road_id") and not _repeated(w, "water_id")
    return out if single else out.distinct()


def _repeated(lines: DataFrame, name: str) -> bool:
    return not lines.groupBy(name).agg(F.count("*").alias("n")).filter("n > 1").isEmpty()


def suppress(points: DataFrame, radius: float, score: str, keys: list[str], most: int | None = None) -> DataFrame:
    """Greedy suppression: by falling score (ties: smallest id), keep a point unless a kept one is within radius.

    In rounds the best open point of each cell that beats the best of the eight cells around it is kept, and open points
    within radius of it are dropped; the result is that of going through the points one by one. Open points meet kept ones
    only, of which a cell's surroundings have one in a round, so that a round makes a few rows for each open point.
    `most` keeps the best of each key.
    """
    place = [*keys, "_cx", "_cy"]
    at = {"_cx": cell("x", radius), "_cy": cell("y", radius)}
    open_ = materialize(points.filter(_placed("x", "y")).select(*keys, "id", "x", "y", F.struct(F.col(score).alias("s"), (-F.col("id")).alias("n")).alias("_p")).withColumns(at))
    around = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in (-1, 0, 1) for j in (-1, 0, 1)])
    shifted = [*keys, (F.col("_cx") + F.col("_o.i")).alias("_cx"), (F.col("_cy") + F.col("_o.j")).alias("_cy")]
    kept = points.filter(~_placed("x", "y")).select(*keys, "id")  # what has no place is near nothing
    while not open_.isEmpty():
        best = materialize(open_.groupBy(*place).agg(F.max(F.struct("_p", "id", "x", "y")).alias("_b")))
        over = best.withColumn("_o", F.explode(around)).select(*shifted, "_b._p").groupBy(*place).agg(F.max("_p").alias("_most"))
        won = materialize(best.join(over, place).filter(F.col("_b._p") == F.col("_most")).select(*place, "_b.id", "_b.x", "_b.y"))
        kept = kept.union(won.select(*keys, "id"))
        near = won.withColumn("_o", F.explode(around)).select(*shifted, F.col("x").alias("rx"), F.col("y").alias("ry"))
        # at most four points of a round are near a cell, as each beats the cells around its own
        near = near.groupBy(*place).agg(F.collect_list(F.struct("rx", "ry")).alias("_w"))
        inside_one = F.exists("_w", lambda w: F.hypot(F.col("x") - w["rx"], F.col("y") - w["ry"]) <= radius)
        open_ = materialize(open_.join(near, place, "left").filter(~F.coalesce(inside_one, F.lit(False))).drop("_w"))
    out = points.join(kept, [*keys, "id"], "left_semi")
    if most is None:
        return out
    by = Window.partitionBy(*keys) if keys else Window.partitionBy(F.lit(0))
    return out.withColumn("_r", F.row_number().over(by.orderBy(F.desc(score), "id"))).filter(F.col("_r") <= most).drop("_r")


def dedupe(points: DataFrame, radius: float, rank: str, name: str = "name") -> DataFrame:
    """Of points of the same kind and normalised name within radius, the one with the best (smallest) rank stays."""
    key = F.trim(F.regexp_replace(F.lower(F.col(name)), "[^a-z0-9]+", " "))
    named = points.withColumn("_key", key).withColumn("_score", -F.col(rank))
    plain = named.filter("_key = ''")
    return suppress(named.filter("_key <> ''"), radius, "_score", ["kind", "_key"]).select(*points.columns).union(plain.select(*points.columns))


def within_distance(points: DataFrame, polygons: DataFrame, distance: float) -> DataFrame:
    """Points inside a polygon or at most `distance` from its ring."""
    rings = polygons.select(F.col("polygon_id").alias("line_id"), F.col("ring").alias("line"))
    held = within(points, polygons, distance).filter("polygon_id is not null").select("id")
    near = line_distance(points, rings, distance, most=distance).select("id")
    return points.join(held.union(near).distinct(), "id", "left_semi")


def landfall(tracks: DataFrame, coast: DataFrame, size: float, keys: list[str]) -> DataFrame:
    """First crossing of each track (keys, step, x, y) with the coast (coast_id, x, y, s): step, alongshore s, side.

    coast_id counts the points along the coast; where a number is missing the coast has a gap.
    side is the sign of the coast's direction against the track's: +1 if the coast runs from right to left.
    """
    by = Window.partitionBy(*keys).orderBy("step")
    t = tracks.select(*keys, "step", F.col("x").alias("ax"), F.col("y").alias("ay"), F.lead("x").over(by).alias("bx"), F.lead("y").over(by).alias("by")).filter("bx is not null")
    ahead = coast.select((F.col("coast_id") - 1).alias("coast_id"), F.col("x").alias("dx"), F.col("y").alias("dy"), F.col("s").alias("s1"))
    c = coast.select("coast_id", "s", F.col("x").alias("cx"), F.col("y").alias("cy")).join(ahead, "coast_id").drop("coast_id")
    span = lambda a, b: F.explode(F.sequence(F.floor(F.least(a, b) / size), F.floor(F.greatest(a, b) / size)))
    t = t.withColumn("_cx", span("ax", "bx")).withColumn("_cy", span("ay", "by"))
    c = c.withColumn("_cx", span("cx", "dx")).withColumn("_cy", span("cy", "dy"))
    det = (F.col("bx") - F.col("ax")) * (F.col("dy") - F.col("cy")) - (F.col("by") - F.col("ay")) * (F.col("dx") - F.col("cx"))
    both = t.join(c, ["_cx", "_cy"]).withColumn("det", det).filter("det <> 0")
    p = ((F.col("cx") - F.col("ax")) * (F.col("dy") - F.col("cy")) - (F.col("cy") - F.col("ay")) * (F.col("dx") - F.col("cx"))) / F.col("det")
    q = ((F.col("cx") - F.col("ax")) * (F.col("by") - F.col("ay")) - (F.col("cy") - F.col("ay")) * (F.col("bx") - F.col("ax"))) / F.col("det")
    hit = both.withColumn("p", p).withColumn("q", q).filter("p between 0 and 1 and q between 0 and 1")
    hit = hit.withColumn("alongshore", F.col("s") + F.col("q") * (F.col("s1") - F.col("s"))).withColumn("side", F.signum("det").cast("int"))
    return hit.groupBy(*keys).agg(F.min(F.struct("step", "p", "alongshore", "side")).alias("m")).select(*keys, "m.step", "m.alongshore", "m.side")
