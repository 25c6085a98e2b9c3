"""Road-graph building: orders as ways, their lineitems as nodes."""

from __future__ import annotations

from pyspark.sql import functions as F

from cutoffs.operators import network
from cutoffs.registry import query, sql

#: Ways of at least two nodes: the suppliers of an order in line order; points by supplier number.
REFS = "SELECT l_orderkey AS way_id, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity) - 1 AS pos, l_suppkey AS node_id FROM lineitem"
_XY = "CAST(node_id * 37 % 101 AS DOUBLE) AS x, CAST(node_id * 53 % 97 AS DOUBLE) AS y"


def ways(spark, sf):
    r = sql(spark, sf, REFS).withColumns({"x": (F.col("node_id") * 37 % 101).cast("double"), "y": (F.col("node_id") * 53 % 97).cast("double")})
    w = r.groupBy("way_id").agg(F.array_sort(F.collect_list(F.struct("pos", "node_id", "x", "y"))).alias("p")).filter(F.size("p") >= 2)
    return w.select("way_id", (F.col("way_id") % 7 == 0).alias("bridge"), (F.col("way_id") % 11 == 0).alias("ford"), F.lit(False).alias("tunnel"), F.transform("p", lambda x: x["node_id"]).alias("node_refs"), F.transform("p", lambda x: F.struct(x["x"].alias("x"), x["y"].alias("y"))).alias("coords"))


_R = f"r AS (SELECT *, count(*) OVER (PARTITION BY way_id) AS n FROM ({REFS})), w AS (SELECT * FROM r WHERE n >= 2), k AS (SELECT node_id, count(*) AS k, max(CASE WHEN pos = 0 OR pos = n - 1 THEN 1 ELSE 0 END) AS e FROM w GROUP BY 1), v AS (SELECT node_id FROM k WHERE k > 1 OR e = 1)"


@query("AG5_vertices", f"WITH {_R} SELECT node_id FROM v")
def ag5(spark, sf):
    return network.vertices(ways(spark, sf))


@query(
    "G1_build_graph",
    f"""WITH {_R}, p AS (SELECT w.way_id, w.pos, w.node_id, {_XY.replace("node_id", "w.node_id")}, v.node_id IS NOT NULL AS is_v FROM w LEFT JOIN v ON w.node_id = v.node_id),
s AS (SELECT way_id, pos, node_id, sum(CASE WHEN is_v THEN 1 ELSE 0 END) OVER o AS piece, lead(node_id) OVER o AS nxt, sqrt(pow(lead(x) OVER o - x, 2) + pow(lead(y) OVER o - y, 2)) AS d FROM p WINDOW o AS (PARTITION BY way_id ORDER BY pos)),
e AS (SELECT way_id, piece, arg_min(node_id, pos) AS u, arg_max(nxt, pos) AS v, sum(d) AS length, count(*) AS n FROM s WHERE nxt IS NOT NULL GROUP BY 1, 2)
SELECT way_id, CAST(piece AS BIGINT) AS piece, u, v, round(length, 6) AS length, CASE WHEN way_id % 11 = 0 THEN 'ford' WHEN way_id % 7 = 0 THEN 'bridge' ELSE 'none' END AS crossing_type FROM e WHERE NOT (u = v AND n = 1)""",
)
def g1(spark, sf):
    g = network.build_graph(ways(spark, sf))
    return g.select("way_id", F.col("piece").cast("long").alias("piece"), "u", "v", F.round("length", 6).alias("length"), "crossing_type")


_PIECES = f"""WITH {_R}, p AS (SELECT w.*, v.node_id IS NOT NULL AS is_v FROM w LEFT JOIN v ON w.node_id = v.node_id), s AS (SELECT way_id, pos, node_id, sum(CASE WHEN is_v THEN 1 ELSE 0 END) OVER o AS piece, lead(node_id) OVER o AS nxt FROM p WINDOW o AS (PARTITION BY way_id ORDER BY pos))
SELECT way_id, CAST(piece AS BIGINT) AS piece, arg_min(node_id, pos) AS u, arg_max(nxt, pos) AS v FROM s WHERE nxt IS NOT NULL GROUP BY 1, 2 HAVING NOT (arg_min(node_id, pos) = arg_max(nxt, pos) AND count(*) = 1)"""


@query("W9_way_split", _PIECES)
def w9(spark, sf):
    """Pieces of the ways between vertices, in order; loops without inner nodes go."""
    return network.build_graph(ways(spark, sf)).select("way_id", F.col("piece").cast("long").alias("piece"), "u", "v")


def planned(spark, sf):
    e = sql(spark, sf, "SELECT l_orderkey AS edge_id, l_linenumber, l_quantity FROM lineitem")
    return e.groupBy("edge_id").agg(F.collect_list((F.col("l_quantity") * 6).cast("double")).alias("dists")).select("edge_id", "dists", F.lit(400.0).alias("length"), F.col("edge_id").alias("u"), (F.col("edge_id") + 1).alias("v"))


#: Culverts of planned edges: crossings within the edge, 10 m on either side, overlapping ones as one stretch.
_CULVERTS = """c AS (SELECT DISTINCT l_orderkey AS edge_id, CAST(l_quantity * 6 AS DOUBLE) AS d FROM lineitem WHERE l_quantity * 6 BETWEEN 0 AND 400), s AS (SELECT edge_id, greatest(d - 10, 0) AS a, least(d + 10, 400) AS b FROM c),
m AS (SELECT edge_id, a, b, CASE WHEN a - max(b) OVER (PARTITION BY edge_id ORDER BY a, b ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) < 0.5 THEN 0 ELSE 1 END AS n FROM s), g AS (SELECT edge_id, a, b, sum(n) OVER (PARTITION BY edge_id ORDER BY a, b) AS k FROM m),
w AS (SELECT edge_id, min(a) AS a, max(b) AS b FROM g GROUP BY edge_id, k)"""


@query("W10_culvert_pieces", f"WITH {_CULVERTS}, o AS (SELECT edge_id, x.b AS a, coalesce(lead(x.a) OVER (PARTITION BY edge_id ORDER BY x.a, x.b), 400) AS b FROM (SELECT edge_id, a, b FROM w UNION ALL SELECT DISTINCT l_orderkey, CAST(0 AS DOUBLE), CAST(0 AS DOUBLE) FROM lineitem) x) SELECT edge_id, a, b, true AS culvert FROM w UNION ALL SELECT edge_id, a, b, false FROM o WHERE b > a")
def w10(spark, sf):
    """All pieces of each edge with their ends."""
    return network.culvert_pieces(planned(spark, sf)).select("edge_id", "a", "b", "culvert")


_G2 = """r AS (SELECT vec_id AS edge_id, label AS kind, vec_id % 3 AS t, CAST(embedding[1] AS DOUBLE) * 1000 AS ax, CAST(embedding[2] AS DOUBLE) * 1000 AS ay, lead(CAST(embedding[1] AS DOUBLE) * 1000) OVER w AS bx, lead(CAST(embedding[2] AS DOUBLE) * 1000) OVER w AS b_y FROM embeddings WINDOW w AS (PARTITION BY label ORDER BY vec_id))"""


@query("G2_insert_culverts", f"""WITH {_G2}, e AS (SELECT edge_id, t, ax, ay, bx, b_y, sqrt(pow(bx - ax, 2) + pow(b_y - ay, 2)) AS len FROM r WHERE bx IS NOT NULL), k AS (SELECT unnest(range(-5, 6)) * 40e0 + 3 AS x),
d AS (SELECT edge_id, len, (x - ax) / (bx - ax) * len AS d FROM e, k WHERE t = 0 AND bx <> ax AND (x - ax) / (bx - ax) BETWEEN 0 AND 1 AND ay + (x - ax) / (bx - ax) * (b_y - ay) BETWEEN -5000 AND 5000)
SELECT e.edge_id, CASE e.t WHEN 1 THEN 'bridge' WHEN 2 THEN 'tunnel' ELSE 'plain' END AS kind, count(d.d) AS crossings, round(e.len, 4) AS length, count(d.d) > 0 AS culverts FROM e LEFT JOIN d ON e.edge_id = d.edge_id GROUP BY ALL""")
def g2(spark, sf):
    """Roads between neighbouring points of a label over straight waters; bridges and tunnels (by id) are left whole."""
    from pyspark.sql import Window

    from cutoffs.operators import spatial

    nxt = Window.partitionBy("kind").orderBy("id")
    p = sql(spark, sf, "SELECT vec_id AS id, label AS kind, CAST(embedding[0] AS DOUBLE) * 1000 AS x, CAST(embedding[1] AS DOUBLE) * 1000 AS y FROM embeddings")
    e = p.withColumn("to", F.lead(F.struct("x", "y")).over(nxt)).withColumn("v", F.lead("id").over(nxt)).filter("to is not null")
    t = F.col("id") % 3
    roads = e.select(F.col("id").alias("road_id"), F.array(F.struct("x", "y"), "to").alias("line"))
    edges = e.select(F.col("id").alias("edge_id"), F.col("id").alias("u"), "v", F.hypot(F.col("to.x") - F.col("x"), F.col("to.y") - F.col("y")).alias("length"), F.when(t == 1, "bridge").otherwise("none").alias("crossing_type"), (t == 2).alias("tunnel"))
    at = F.col("id") * 40.0 - 197
    waters = spark.range(11).select(F.col("id").alias("water_id"), F.array(F.struct(at.alias("x"), F.lit(-5000.0).alias("y")), F.struct(at.alias("x"), F.lit(5000.0).alias("y"))).alias("line"))
    out = network.insert_culverts(edges, roads, waters, 200.0)
    hits = spatial.crossings(roads.filter("road_id % 3 = 0"), waters, 200.0).groupBy(F.col("road_id").alias("edge_id")).agg(F.count("*").alias("n"))
    per = out.groupBy("edge_id").agg(F.round(F.sum("length"), 4).alias("length"), F.bool_or(F.col("crossing_type") == "culvert").alias("culverts"))
    kind = F.when(F.col("edge_id") % 3 == 1, "bridge").when(F.col("edge_id") % 3 == 2, "tunnel").otherwise("plain")
    return per.join(hits, "edge_id", "left").select("edge_id", kind.alias("kind"), F.coalesce("n", F.lit(0)).alias("crossings"), "length", "culverts")


#: Tags by the way's number: roads of all sorts (links, tracks, none), waters, fords, named things and others.
_TAGS = {
    0: {"highway": "primary_link", "bridge": "yes"},
    1: {"waterway": "ditch"},
    2: {"shop": "yes"},
    3: {"highway": "track"},
    4: {"highway": "living_street", "bridge": "no"},
    5: {"waterway": "dam"},
    6: {"name": "Cyclone Shelter"},
    7: {"highway": "road", "ford": "yes"},
}


def elements(spark, sf):
    o = sql(spark, sf, f"SELECT way_id, pos, node_id FROM ({REFS})")
    w = o.groupBy("way_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "node_id"))), lambda x: x["node_id"]).alias("refs"))
    tags = F.lit(None).cast("map<string,string>")
    for k, v in _TAGS.items():
        tags = F.when(F.col("way_id") % 8 == k, F.create_map(*[F.lit(x) for kv in v.items() for x in kv])).otherwise(tags)
    nodes = sql(spark, sf, "SELECT s_suppkey AS node_id, CAST(s_suppkey * 37 % 101 AS DOUBLE) AS lon, CAST(s_suppkey * 53 % 97 AS DOUBLE) AS lat FROM supplier")
    return w.withColumn("tags", tags), nodes


_IN = "i AS (SELECT l_orderkey AS way_id, bool_or(l_suppkey * 37 % 101 BETWEEN 10 AND 60 AND l_suppkey * 53 % 97 BETWEEN 10 AND 60) AS ok, count(*) AS n FROM lineitem JOIN supplier ON l_suppkey = s_suppkey GROUP BY 1)"


@query("SRC8_roads", f"WITH {_IN} SELECT way_id, CASE way_id % 8 WHEN 0 THEN 'primary_link' WHEN 4 THEN 'living_street' ELSE 'road' END AS highway, way_id % 8 = 0 AS bridge, way_id % 8 = 7 AS ford, n FROM i WHERE ok AND way_id % 8 IN (0, 4, 7)")
def src8(spark, sf):
    w, n = elements(spark, sf)
    return network.roads(w, n, (10, 10, 60, 60)).select("way_id", "highway", "bridge", "ford", F.size("coords").cast("long").alias("n"))


@query("SRC9_waterways", f"WITH {_IN} SELECT way_id, n FROM i WHERE ok AND way_id % 8 = 1")
def src9(spark, sf):
    w, n = elements(spark, sf)
    return network.waterways(w, n, (10, 10, 60, 60)).select("way_id", F.size("coords").cast("long").alias("n"))


@query("SRC13_relevant_elements", "SELECT DISTINCT l_orderkey AS way_id FROM lineitem WHERE l_orderkey % 8 <> 2")
def src13(spark, sf):
    return network.relevant(elements(spark, sf)[0]).select("way_id")


_SITE_TAGS = [
    {"amenity": "hospital"},
    {"name": "Old CYCLONE centre"},
    {"place": "village", "name": "Inner", "name:te": "Lopali"},
    {"boundary": "administrative", "admin_level": "5"},
    {"shop": "yes"},
    {"healthcare": "yes"},
    {"amenity": "social_facility"},
    {"amenity": "health_post"},
    {"place": "isle", "name": "Rock"},
    {"natural": "coastline"},
    {"boundary": "administrative", "admin_level": "6"},
]


def _sites(spark, sf):
    s = sql(spark, sf, "SELECT s_suppkey, CAST(s_suppkey * 37 % 101 AS DOUBLE) AS lon, CAST(s_suppkey * 53 % 97 AS DOUBLE) AS lat FROM supplier")
    tags = F.lit(None).cast("map<string,string>")
    for k, v in enumerate(_SITE_TAGS):
        tags = F.when(F.col("s_suppkey") % len(_SITE_TAGS) == k, F.create_map(*[F.lit(x) for kv in v.items() for x in kv])).otherwise(tags)
    return s.withColumn("tags", tags)


@query("SRC10_poi_filter", "SELECT s_suppkey FROM supplier WHERE s_suppkey % 11 IN (0, 1, 5, 6)")
def src10(spark, sf):
    return _sites(spark, sf).filter(network.is_poi(F.col("tags"))).select("s_suppkey")


@query("SRC11_named_places", "SELECT s_suppkey AS place_id, 'village' AS kind, 'Inner' AS name, 'Lopali' AS name_te, CAST(NULL AS VARCHAR) AS name_hi FROM supplier WHERE s_suppkey % 11 = 2 AND s_suppkey * 37 % 101 BETWEEN 10 AND 80 AND s_suppkey * 53 % 97 BETWEEN 10 AND 80")
def src11(spark, sf):
    return network.named_places(_sites(spark, sf).withColumnRenamed("s_suppkey", "place_id"), (10, 10, 80, 80)).select("place_id", "kind", "name", "name_te", "name_hi")


@query("SRC12_boundaries", "SELECT s_suppkey FROM supplier WHERE s_suppkey % 11 IN (3, 9)")
def src12(spark, sf):
    return network.boundaries(_sites(spark, sf)).select("s_suppkey")


@query("G14_longest_coast", "SELECT min(o_orderkey) AS component, count(*) AS ways, CAST(max(k) AS BIGINT) AS last FROM (SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1 AS k FROM orders) GROUP BY o_custkey ORDER BY ways DESC, component LIMIT 1")
def g14(spark, sf):
    """Each customer's orders are a chain of ways from node to node, closed to a ring for even customers; the longest is the coast."""
    w = sql(spark, sf, "SELECT o_orderkey AS way_id, o_custkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1 AS k, count(*) OVER (PARTITION BY o_custkey) AS n FROM orders")
    node = lambda k: F.col("o_custkey") * 100000 + k
    after = F.when((F.col("o_custkey") % 2 == 0) & (F.col("k") + 1 == F.col("n")), 0).otherwise(F.col("k") + 1)
    m = network.merge_lines(w.select("way_id", node(F.col("k")).alias("first"), node(after).alias("last"), F.lit(1.0).alias("length")))
    out = m.groupBy("component").agg(F.count("*").alias("ways"), F.max("seq").cast("long").alias("last"))
    return out.orderBy(F.desc("ways"), "component").limit(1)
