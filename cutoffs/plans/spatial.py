"""Spatial operators over embeddings: two components as degrees, label as kind."""

from __future__ import annotations

from pyspark.sql import functions as F

from cutoffs.functions import geo
from cutoffs.operators import spatial
from cutoffs.registry import query, sql

#: Points in units of 1/1000 of a component, by their id.
POINTS = "SELECT vec_id AS id, label AS kind, round(CAST(embedding[{0}] AS DOUBLE) * 1000, 3) AS x, round(CAST(embedding[{1}] AS DOUBLE) * 1000, 3) AS y FROM embeddings"
SPARK_POINTS, P = POINTS.format(0, 1), f"p AS ({POINTS.format(1, 2)})"
_DIST = "sqrt(pow(a.x - b.x, 2) + pow(a.y - b.y, 2))"
#: Boxes around the points of each label, shrunk by half; as rings in Spark.
_BOX = "g AS (SELECT kind AS polygon_id, avg(x) - 60 AS x0, avg(x) + 60 AS x1, avg(y) - 60 AS y0, avg(y) + 60 AS y1 FROM p GROUP BY kind)"


def points(spark, sf):
    return sql(spark, sf, SPARK_POINTS)


def boxes(spark, sf):
    g = points(spark, sf).groupBy(F.col("kind").alias("polygon_id")).agg((F.avg("x") - 60).alias("x0"), (F.avg("x") + 60).alias("x1"), (F.avg("y") - 60).alias("y0"), (F.avg("y") + 60).alias("y1"))
    at = lambda a, b: F.struct(F.col(a).alias("x"), F.col(b).alias("y"))
    return g.select("polygon_id", F.array(at("x0", "y0"), at("x1", "y0"), at("x1", "y1"), at("x0", "y1"), at("x0", "y0")).alias("ring"))


def halves(spark, sf):
    p = points(spark, sf)
    right = p.filter("id % 5 = 0").select(F.col("id").alias("rid"), F.col("x").alias("rx"), F.col("y").alias("ry"))
    return p.filter("id % 5 <> 0"), right


@query(
    "J9_snap_to_nodes",
    f"WITH {P}, d AS (SELECT a.id, b.id AS node_id, {_DIST} AS d FROM p a, p b WHERE a.id % 5 <> 0 AND b.id % 5 = 0), r AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY d, node_id) AS k FROM d) SELECT id, node_id, round(d, 6) AS snap_dist_m, d > 20 AS unsnapped FROM r WHERE k = 1",
)
def j9(spark, sf):
    a, b = halves(spark, sf)
    nodes = b.select(F.col("rid").alias("node_id"), F.col("rx").alias("x"), F.col("ry").alias("y"), F.lit(True).alias("component_main"))
    out = spatial.snap(a, nodes, max_m=20.0, first_radius=15.0)
    return out.select("id", "node_id", F.round("snap_dist_m", 6).alias("snap_dist_m"), "unsnapped")


@query("J10_nearest_within", f"WITH {P}, d AS (SELECT a.id, b.id AS rid, {_DIST} AS d FROM p a, p b WHERE a.id % 5 <> 0 AND b.id % 5 = 0 AND {_DIST} <= 25), r AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY d, rid) AS k FROM d) SELECT id, rid, round(d, 6) AS dist FROM r WHERE k = 1")
def j10(spark, sf):
    a, b = halves(spark, sf)
    best = spatial.near_pairs(a, b, 25.0).groupBy("id").agg(F.min(F.struct("dist", "rid")).alias("m"))
    return best.select("id", "m.rid", F.round("m.dist", 6).alias("dist"))


@query("J11_nearest_place", f"WITH {P}, d AS (SELECT a.id, b.id AS rid, {_DIST} AS d FROM p a, p b WHERE a.id % 5 <> 0 AND b.id % 5 = 0 AND {_DIST} <= 10), r AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY d, rid) AS k FROM d) SELECT p.id, r.rid AS near_place FROM p LEFT JOIN r ON p.id = r.id AND k = 1 WHERE p.id % 5 <> 0")
def j11(spark, sf):
    a, b = halves(spark, sf)
    best = spatial.near_pairs(a, b, 10.0).groupBy("id").agg(F.min(F.struct("dist", "rid")).alias("m"))
    return a.select("id").join(best, "id", "left").select("id", F.col("m.rid").alias("near_place"))


@query("J17_radius_sum", f"WITH {P} SELECT a.id, round(coalesce(sum(b.kind) FILTER (WHERE {_DIST} <= 30), 0), 6) + 0e0 AS total FROM p a, p b WHERE a.id % 5 <> 0 AND b.id % 5 = 0 GROUP BY a.id")
def j17(spark, sf):
    a, b = halves(spark, sf)
    kinds = points(spark, sf).select(F.col("id").alias("rid"), F.col("kind").cast("double").alias("v"))
    return spatial.radius_sum(a, b.join(kinds, "rid"), 30.0, "v").withColumn("total", F.round("total", 6))


@query("J16_first_within", f"WITH {P} SELECT a.id, min(b.id % 48) AS hour FROM p a, p b WHERE a.id % 5 <> 0 AND b.id % 5 = 0 AND {_DIST} <= 30 GROUP BY a.id")
def j16(spark, sf):
    a, b = halves(spark, sf)
    return spatial.first_within(a, b.withColumn("hour", F.col("rid") % 48), 30.0)


@query("J6_point_in_polygon", f"WITH {P}, {_BOX} SELECT p.id, min(polygon_id) AS polygon_id FROM p LEFT JOIN g ON x > x0 AND x < x1 AND y > y0 AND y < y1 GROUP BY p.id")
def j6(spark, sf):
    return spatial.within(points(spark, sf), boxes(spark, sf), 40.0).select("id", "polygon_id")


@query("J7_rasterise", f"WITH {P}, {_BOX}, c AS (SELECT i.i * 32 + j.j AS id, -310 + i.i * 20 AS x, -310 + j.j * 20 AS y FROM (SELECT unnest(range(32)) AS i) i, (SELECT unnest(range(32)) AS j) j) SELECT c.id, min(polygon_id) AS polygon_id FROM c LEFT JOIN g ON x > x0 AND x < x1 AND y > y0 AND y < y1 GROUP BY c.id")
def j7(spark, sf):
    c = spark.range(1024).select("id", (-310.0 + F.floor(F.col("id") / 32) * 20).alias("x"), (-310.0 + F.col("id") % 32 * 20).alias("y"))
    return spatial.within(c, boxes(spark, sf), 40.0).select("id", "polygon_id")


@query(
    "J8_nearest_polygon",
    f"WITH {P}, {_BOX}, d AS (SELECT p.id, polygon_id, CASE WHEN x > x0 AND x < x1 AND y > y0 AND y < y1 THEN 0 ELSE sqrt(pow(greatest(x0 - x, 0, x - x1), 2) + pow(greatest(y0 - y, 0, y - y1), 2)) END AS d FROM p, g), r AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY d, polygon_id) AS k FROM d) SELECT id, polygon_id, round(d, 6) AS dist FROM r WHERE k = 1",
)
def j8(spark, sf):
    out = spatial.nearest_polygon(points(spark, sf), boxes(spark, sf), 40.0)
    return out.select("id", "polygon_id", F.round("dist", 6).alias("dist"))


@query("J27_within_distance", f"WITH {P}, {_BOX} SELECT DISTINCT id FROM p, g WHERE polygon_id = 1 AND (pow(greatest(x0 - x, 0, x - x1), 2) + pow(greatest(y0 - y, 0, y - y1), 2)) <= 400")
def j27(spark, sf):
    return spatial.within_distance(points(spark, sf), boxes(spark, sf).filter("polygon_id = 1"), 20.0).select("id")


_SEG = "s AS (SELECT a.x AS ax, a.y AS ay, b.x AS bx, b.y AS b_y FROM p a JOIN p b ON b.id = a.id + 1)"


@query(
    "J13_distance_to_line",
    f"""WITH {P}, {_SEG}, t AS (SELECT id, x, y, s.*, least(1, greatest(0, coalesce(((x - ax) * (bx - ax) + (y - ay) * (b_y - ay)) / nullif(pow(bx - ax, 2) + pow(b_y - ay, 2), 0), 0))) AS t FROM (SELECT id, x + 3 AS x, y - 2 AS y FROM p) p, s)
SELECT id, round(min(sqrt(pow(x - ax - t * (bx - ax), 2) + pow(y - ay - t * (b_y - ay), 2))), 6) AS dist FROM t GROUP BY id""",
)
def j13(spark, sf):
    """All points, shifted, against the line through all points in the order of their ids, a row per segment."""
    p = points(spark, sf)
    ahead = p.select((F.col("id") - 1).alias("id"), F.col("x").alias("bx"), F.col("y").alias("by"))
    seg = p.select("id", F.col("x").alias("ax"), F.col("y").alias("ay")).join(ahead, "id").select(F.lit(1).alias("line_id"), "ax", "ay", "bx", "by")
    moved = p.select("id", (F.col("x") + 3).alias("x"), (F.col("y") - 2).alias("y"))
    return spatial.segment_nearest(moved, seg, 20.0).select("id", F.round("dist", 6).alias("dist"))


_ROADS = "r AS (SELECT id AS road_id, x AS ax, y AS ay, lead(x) OVER (PARTITION BY kind ORDER BY id) AS bx, lead(y) OVER (PARTITION BY kind ORDER BY id) AS b_y FROM p WHERE id % 5 <> 0), w AS (SELECT id AS water_id, x AS cx, y AS cy, lead(x) OVER (PARTITION BY kind ORDER BY id) AS dx, lead(y) OVER (PARTITION BY kind ORDER BY id) AS dy FROM p WHERE id % 5 = 0)"


def two_points(df, name):
    from pyspark.sql import Window

    by = Window.partitionBy("kind").orderBy("id")
    nxt = F.lead(F.struct("x", "y")).over(by)
    return df.select(F.col("id").alias(name), F.array(F.struct("x", "y"), nxt).alias("line"), nxt.isNotNull().alias("ok")).filter("ok").select(name, "line")


@query(
    "J14_line_crossings",
    f"""WITH {P}, {_ROADS}, d AS (SELECT *, (bx - ax) * (dy - cy) - (b_y - ay) * (dx - cx) AS det FROM r, w WHERE bx IS NOT NULL AND dx IS NOT NULL),
t AS (SELECT *, ((cx - ax) * (dy - cy) - (cy - ay) * (dx - cx)) / det AS t, ((cx - ax) * (b_y - ay) - (cy - ay) * (bx - ax)) / det AS u FROM d WHERE det <> 0)
SELECT road_id, water_id, round(t * sqrt(pow(bx - ax, 2) + pow(b_y - ay, 2)), 4) AS dist FROM t WHERE t BETWEEN 0 AND 1 AND u BETWEEN 0 AND 1""",
)
def j14(spark, sf):
    p = points(spark, sf)
    out = spatial.crossings(two_points(p.filter("id % 5 <> 0"), "road_id"), two_points(p.filter("id % 5 = 0"), "water_id"), 40.0)
    return out.select("road_id", "water_id", F.round("dist", 4).alias("dist"))


_TRACK = "t AS (SELECT kind, id AS step, x AS ax, y AS ay, lead(x) OVER (PARTITION BY kind ORDER BY id) AS bx, lead(y) OVER (PARTITION BY kind ORDER BY id) AS b_y FROM p)"


@query(
    "J15_landfall",
    f"""WITH {P}, {_TRACK}, c AS (SELECT CAST(k AS DOUBLE) * 50 - 400 AS cx, 20e0 AS cy, CAST(k + 1 AS DOUBLE) * 50 - 400 AS dx, 25e0 AS dy, k FROM (SELECT unnest(range(16)) AS k)),
cc AS (SELECT k, cx, CASE WHEN k % 2 = 0 THEN 20e0 ELSE 25e0 END AS cy, dx, CASE WHEN k % 2 = 0 THEN 25e0 ELSE 20e0 END AS dy FROM c),
d AS (SELECT *, (bx - ax) * (dy - cy) - (b_y - ay) * (dx - cx) AS det FROM t, cc WHERE bx IS NOT NULL),
h AS (SELECT *, ((cx - ax) * (dy - cy) - (cy - ay) * (dx - cx)) / det AS p, ((cx - ax) * (b_y - ay) - (cy - ay) * (bx - ax)) / det AS q FROM d WHERE det <> 0),
r AS (SELECT *, row_number() OVER (PARTITION BY kind ORDER BY step, p) AS n FROM h WHERE p BETWEEN 0 AND 1 AND q BETWEEN 0 AND 1)
SELECT kind, step, round((k + q) * 10, 4) AS alongshore, CAST(sign(det) AS INTEGER) AS side FROM r WHERE n = 1""",
)
def j15(spark, sf):
    coast = spark.range(17).select(F.col("id").alias("coast_id"), (F.col("id") * 50.0 - 400).alias("x"), F.when(F.col("id") % 2 == 0, 20.0).otherwise(25.0).alias("y"), (F.col("id") * 10.0).alias("s"))
    out = spatial.landfall(points(spark, sf).withColumnRenamed("id", "step"), coast, 40.0, ["kind"])
    return out.withColumn("alongshore", F.round("alongshore", 4))


@query("J25_nearest_ten", f"WITH {P}, q AS (SELECT x AS qx, y AS qy FROM p WHERE id = 7), d AS (SELECT id, pow(x - qx, 2) + pow(y - qy, 2) AS d FROM p, q) SELECT id, round(d, 4) AS d2 FROM (SELECT *, row_number() OVER (ORDER BY d, id) AS k FROM d) WHERE k <= 10")
def j25(spark, sf):
    p = points(spark, sf)
    q = p.filter("id = 7").select(F.col("x").alias("qx"), F.col("y").alias("qy"))
    d = p.join(F.broadcast(q)).withColumn("d2", F.pow(F.col("x") - F.col("qx"), 2) + F.pow(F.col("y") - F.col("qy"), 2))
    return d.orderBy("d2", "id").limit(10).select("id", F.round("d2", 4).alias("d2"))


_SCORE = "(id * 37) % 101"


@query(
    "T4_spatial_suppression",
    f"""WITH RECURSIVE {P}, o AS (SELECT id, x, y, row_number() OVER (ORDER BY {_SCORE} DESC, id) AS k FROM p),
g(k, kept) AS (SELECT CAST(0 AS BIGINT), CAST([] AS BIGINT[]) UNION ALL
 SELECT g.k + 1, CASE WHEN EXISTS (SELECT 1 FROM o b WHERE list_contains(g.kept, b.id) AND pow(b.x - a.x, 2) + pow(b.y - a.y, 2) <= 2500) THEN g.kept ELSE list_append(g.kept, a.id) END FROM g JOIN o a ON a.k = g.k + 1)
SELECT unnest(kept) AS id FROM (SELECT kept FROM g ORDER BY k DESC LIMIT 1)""",
)
def t4(spark, sf):
    p = points(spark, sf).withColumn("score", (F.col("id") * 37) % 101)
    return spatial.suppress(p, 50.0, "score", []).select("id")


@query("T5_dedupe_by_name")
def t5(spark, sf):
    p = points(spark, sf).withColumn("name", F.concat(F.lit("Clinic No. "), (F.col("id") % 4).cast("string"))).withColumn("rank", F.col("id") % 3)
    return spatial.dedupe(p, 60.0, "rank")


_H = "sqrt(2 * 36.13e6 / (3 * sqrt(3.0)))"


@query(
    "SC16_hex_cells",
    f"""WITH {P}, m AS (SELECT id, x * 100 AS x, y * 100 AS y FROM p), a AS (SELECT id, (sqrt(3.0) / 3 * x - y / 3) / {_H} AS q, (2.0 / 3 * y) / {_H} AS r FROM m), b AS (SELECT id, q, r, round(q) AS rq, round(r) AS rr, round(-q - r) AS rs FROM a),
c AS (SELECT *, abs(rq - q) AS dq, abs(rr - r) AS dr, abs(rs + q + r) AS ds FROM b)
SELECT id, 'r6:' || CAST(CAST(CASE WHEN dq > dr AND dq > ds THEN -rr - rs ELSE rq END AS BIGINT) AS VARCHAR) || ':' || CAST(CAST(CASE WHEN dq > dr AND dq > ds THEN rr WHEN dr > ds THEN -rq - rs ELSE rr END AS BIGINT) AS VARCHAR) AS cell FROM c""",
)
def sc16(spark, sf):
    return points(spark, sf).select("id", geo.hex_cell(F.col("x") * 100, F.col("y") * 100, 6).alias("cell"))


@query(
    "SC14_line_length",
    f"""WITH {P}, l AS (SELECT kind, id, x, y, lag(x) OVER w AS px, lag(y) OVER w AS py FROM p WINDOW w AS (PARTITION BY kind ORDER BY id)) SELECT kind, round(sum(coalesce(sqrt(pow(x - px, 2) + pow(y - py, 2)), 0)), 4) AS length FROM l GROUP BY kind""",
)
def sc14(spark, sf):
    line = F.transform(F.array_sort(F.collect_list(F.struct("id", "x", "y"))), lambda p: F.struct(p["x"].alias("x"), p["y"].alias("y")))
    lines = points(spark, sf).groupBy("kind").agg(line.alias("line"))
    return lines.select("kind", F.round(geo.line_length(F.col("line")), 4).alias("length"))


@query(
    "SC15_densify",
    f"""WITH {P}, r AS (SELECT id AS road_id, x AS ax, y AS ay, lead(x) OVER (PARTITION BY kind ORDER BY id) AS bx, lead(y) OVER (PARTITION BY kind ORDER BY id) AS b_y FROM p), s AS (SELECT road_id, sqrt(pow(bx - ax, 2) + pow(b_y - ay, 2)) AS len, ax, ay, bx, b_y FROM r WHERE bx IS NOT NULL), n AS (SELECT *, greatest(2, CAST(ceil(len / 25) AS INTEGER) + 1) AS n FROM s), k AS (SELECT *, unnest(range(CAST(n AS BIGINT))) AS k FROM n)
SELECT road_id, k, round(ax + k / (n - 1e0) * (bx - ax) + 0.00123, 2) AS x, round(ay + k / (n - 1e0) * (b_y - ay) + 0.00123, 2) AS y FROM k""",
)
def sc15(spark, sf):
    lines = two_points(points(spark, sf), "road_id")
    d = lines.select("road_id", "line", F.posexplode(geo.densify(F.col("line"), 25.0)).alias("k", "d"))
    at = d.select("road_id", F.col("k").cast("long").alias("k"), geo.interpolate_line(F.col("line"), F.col("d")).alias("p"))
    return at.select("road_id", "k", F.round(F.col("p.x") + 0.00123, 2).alias("x"), F.round(F.col("p.y") + 0.00123, 2).alias("y"))
