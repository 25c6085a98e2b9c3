"""Road network: elements to roads, graph building, culverts, points of interest."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Classes of roads for vehicles, and their free-flow speeds in km/h.
ROAD_CLASSES = ("motorway", "motorway_link", "trunk", "trunk_link", "primary", "primary_link", "secondary", "secondary_link", "tertiary", "tertiary_link", "unclassified", "residential", "living_street", "service", "road")
SPEED_KMPH = {"motorway": 80.0, "motorway_link": 50.0, "trunk": 60.0, "trunk_link": 40.0, "primary": 50.0, "primary_link": 35.0, "secondary": 40.0, "secondary_link": 30.0, "tertiary": 30.0, "tertiary_link": 25.0, "unclassified": 20.0, "road": 20.0, "residential": 20.0, "living_street": 10.0, "service": 10.0}
#: Kinds of waterways, of health amenities, and keys of interest in map elements.
WATERWAYS = ("river", "stream", "canal", "drain", "ditch")
HEALTH_AMENITY = ("hospital", "clinic", "doctors")
KEYS = ("highway", "waterway", "amenity", "healthcare", "emergency", "social_facility", "power", "ford", "name")
#: Kinds of places, and administrative levels of boundaries.
PLACES = ("city", "town", "village", "hamlet", "suburb")
LEVELS = ("4", "5")
#: Points of ways that a task sorts, about (some 300 bytes each there).
TASK_POINTS = 1_000_000


def travel_time_s(length_m: Column, road_class: Column, kmh: dict[str, float] = SPEED_KMPH, default: float = 20.0) -> Column:
    """Seconds at the free-flow speed of the road's class, at `default` km/h where it has none."""
    speed = F.create_map(*[x for k, v in kmh.items() for x in (F.lit(k), F.lit(v))])
    return length_m / (F.coalesce(F.try_element_at(speed, F.coalesce(road_class, F.lit(""))), F.lit(default)) / 3.6)


def relevant(elements: DataFrame) -> DataFrame:
    """Elements (tags MAP) with any key of interest."""
    return elements.filter(F.exists(F.map_keys("tags"), lambda k: k.isin(*KEYS)))


def _flag(name: str) -> Column:
    v = F.try_element_at("tags", F.lit(name))
    return F.coalesce(~v.isin("no", "0", "false"), F.lit(False))


def roads(elements: DataFrame, nodes: DataFrame, box: tuple[float, float, float, float], classes: tuple[str, ...] = ROAD_CLASSES) -> DataFrame:
    """(way_id, highway, name, bridge, ford, tunnel, node_refs, coords) of ways of a class with any point in the box."""
    hw = F.try_element_at("tags", F.lit("highway"))
    way = elements.filter(hw.isin(*classes)).select("way_id", hw.alias("highway"), F.try_element_at("tags", F.lit("name")).alias("name"), _flag("bridge").alias("bridge"), (_flag("ford") | F.coalesce(hw == "ford", F.lit(False))).alias("ford"), _flag("tunnel").alias("tunnel"), "refs")
    return _with_coords(way, nodes, box)


def waterways(elements: DataFrame, nodes: DataFrame, box: tuple[float, float, float, float], kinds: tuple[str, ...] = WATERWAYS) -> DataFrame:
    ww = F.try_element_at("tags", F.lit("waterway"))
    return _with_coords(elements.filter(ww.isin(*kinds)).select("way_id", ww.alias("waterway"), "refs"), nodes, box)


def _with_coords(way: DataFrame, nodes: DataFrame, box: tuple[float, float, float, float]) -> DataFrame:
    w, s, e, n = box
    inside = F.col("lon").between(w, e) & F.col("lat").between(s, n)
    pts = way.select("way_id", F.posexplode("refs").alias("pos", "node_id")).join(nodes.select("node_id", "lon", "lat"), "node_id")
    line = pts.groupBy("way_id").agg(F.array_sort(F.collect_list(F.struct("pos", "node_id", "lon", "lat"))).alias("p"), F.bool_or(inside).alias("ok")).filter("ok")
    coords = F.transform("p", lambda x: F.struct(x["lon"].alias("x"), x["lat"].alias("y")))
    return way.drop("refs").join(line, "way_id").select(*[c for c in way.columns if c != "refs"], F.transform("p", lambda x: x["node_id"]).alias("node_refs"), coords.alias("coords"))


def is_poi(tags: Column) -> Column:
    """Health, shelter, social, emergency or power sites, and anything with "cyclone" in its name."""
    get = lambda k: F.coalesce(F.try_element_at(tags, F.lit(k)), F.lit(""))
    care = F.coalesce(F.map_contains_key(tags, "healthcare"), F.lit(False))
    return get("amenity").isin(*HEALTH_AMENITY, "shelter", "social_facility") | care | get("emergency").isin("assembly_point", "shelter") | F.contains(F.lower(get("name")), F.lit("cyclone")) | (get("power") == "substation")


def named_places(elements: DataFrame, box: tuple[float, float, float, float]) -> DataFrame:
    """(place_id, kind, name, name_te, name_hi, lon, lat) of places with a name inside the box; elements: place_id, lon, lat, tags."""
    w, s, e, n = box
    tag = lambda k: F.try_element_at("tags", F.lit(k))
    inside = F.col("lon").between(w, e) & F.col("lat").between(s, n)
    kept = elements.filter(F.coalesce(tag("place").isin(*PLACES), F.lit(False)) & tag("name").isNotNull() & inside)
    return kept.select("place_id", tag("place").alias("kind"), tag("name").alias("name"), tag("name:te").alias("name_te"), tag("name:hi").alias("name_hi"), "lon", "lat")


def boundaries(elements: DataFrame) -> DataFrame:
    """Elements that are administrative boundaries of the two upper levels, or coastline."""
    tag = lambda k: F.coalesce(F.try_element_at("tags", F.lit(k)), F.lit(""))
    return elements.filter((tag("boundary") == "administrative") & tag("admin_level").isin(*LEVELS) | (tag("natural") == "coastline"))


def ring_centroid(ring: Column) -> Column:
    """Mean of the vertices of a closed ring (the last repeats the first)."""
    inner = F.slice(ring, 1, F.size(ring) - 1)
    mean = lambda f: F.aggregate(inner, F.lit(0.0), lambda a, p: a + p[f]) / F.size(inner)
    return F.when((F.size(ring) >= 4) & (ring[0] == F.element_at(ring, -1)), F.struct(mean("x").alias("x"), mean("y").alias("y")))


def vertices(way: DataFrame) -> DataFrame:
    """(node_id): ends of ways and nodes that are referred to more than once."""
    return _vertices(way.select(F.posexplode("node_refs").alias("pos", "node_id"), F.size("node_refs").alias("n")))


def _vertices(refs: DataFrame) -> DataFrame:
    agg = refs.groupBy("node_id").agg(F.count("*").alias("k"), F.max(((F.col("pos") == 0) | (F.col("pos") == F.col("n") - 1)).cast("int")).alias("end"))
    return agg.filter("k > 1 or end = 1").select("node_id")


def build_graph(way: DataFrame, task_points: int = TASK_POINTS) -> DataFrame:
    """Edges between vertices: edge_id, u, v, way_id, piece, length, crossing_type; loops without inner nodes go.

    way: way_id, bridge, ford, tunnel, node_refs, coords (metres). Edge ids count in the order of (way_id, piece). The points
    of ways are written once and counted, and go to as many tasks as leave each about task_points of them.
    """
    from cutoffs.session import materialize

    pts = way.select("way_id", "bridge", "ford", "tunnel", F.size("node_refs").alias("n"), F.posexplode(F.arrays_zip("node_refs", "coords")).alias("pos", "p"))
    pts = materialize(pts.select("way_id", "bridge", "ford", "tunnel", "n", "pos", F.col("p.node_refs").alias("node_id"), F.col("p.coords.x").alias("x"), F.col("p.coords.y").alias("y")))
    tasks = max(int(way.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-pts.count() // task_points))
    v = _vertices(pts.select("pos", "node_id", "n")).withColumn("is_vertex", F.lit(1)).repartition(tasks, "node_id")
    pts = pts.drop("n").repartition(tasks, "node_id").join(v, "node_id", "left").withColumn("is_vertex", F.coalesce("is_vertex", F.lit(0))).repartition(tasks, "way_id")
    by = Window.partitionBy("way_id").orderBy("pos")
    # a step runs from a node to the next; it belongs to the piece that its first node opened
    step = pts.withColumn("piece", F.sum("is_vertex").over(by)).withColumn("to", F.lead(F.struct("node_id", "x", "y")).over(by)).filter("to is not null")
    step = step.withColumn("d", F.hypot(F.col("to.x") - F.col("x"), F.col("to.y") - F.col("y")))
    edge = step.groupBy("way_id", "piece", "bridge", "ford", "tunnel").agg(F.min_by("node_id", "pos").alias("u"), F.max_by("to.node_id", "pos").alias("v"), F.sum("d").alias("length"), F.count("*").alias("steps"))
    edge = edge.filter("not (u = v and steps = 1)")
    kind = F.when(F.col("ford"), "ford").when(F.col("bridge"), "bridge").otherwise("none")
    return edge.select(F.xxhash64("way_id", "piece").alias("edge_id"), "u", "v", "way_id", "piece", "length", kind.alias("crossing_type"), "tunnel")


def culvert_pieces(edges: DataFrame, half: float = 10.0, least: float = 0.5) -> DataFrame:
    """Splits edges (edge_id, u, v, length, dists ARRAY) at crossings: pieces (edge_id, k, a, b, from_node, to_node, culvert).

    Crossings that differ by under 0.1 count once; each takes `half` on either side, cut off at the ends, and joins with
    the one before if they touch; a rest shorter than `least` goes to the culvert beside it. New nodes get negative ids
    from a hash of the edge and the place, whatever the order of rows.
    """
    once = F.array_sort(F.array_distinct(F.transform(F.filter("dists", lambda d: (d >= 0) & (d <= F.col("length"))), lambda d: F.round(d, 1))))

    def grow(acc: Column, d: Column) -> Column:
        a, b = F.greatest(d - half, F.lit(0.0)), F.least(d + half, F.col("length"))
        a, b = F.when(a < least, 0.0).otherwise(a), F.when(F.col("length") - b < least, F.col("length")).otherwise(b)
        last = F.element_at(acc, -1)
        joined = F.concat(F.slice(acc, 1, F.size(acc) - 1), F.array(F.struct(last["a"].alias("a"), F.greatest(last["b"], b).alias("b"))))
        return F.when(F.size(acc) == 0, F.array(F.struct(a.alias("a"), b.alias("b")))).when(a - last["b"] < least, joined).otherwise(F.concat(acc, F.array(F.struct(a.alias("a"), b.alias("b")))))

    empty = F.array().cast("array<struct<a:double,b:double>>")
    spans = edges.withColumn("c", F.aggregate(once, empty, grow))
    cuts = F.array_sort(F.array_distinct(F.concat(F.array(F.lit(0.0), F.col("length")), F.flatten(F.transform("c", lambda s: F.array(s["a"], s["b"]))))))
    parts = spans.withColumn("cuts", cuts).select("edge_id", "u", "v", "length", "c", F.posexplode(F.zip_with(F.slice("cuts", 1, F.size("cuts") - 1), F.slice("cuts", 2, F.size("cuts") - 1), lambda a, b: F.struct(a.alias("a"), b.alias("b")))).alias("k", "p"))
    node = lambda at: F.when(at == 0, F.col("u")).when(at == F.col("length"), F.col("v")).otherwise(-F.abs(F.xxhash64("edge_id", at)) - 1)
    wet = F.exists("c", lambda s: (s["a"] <= F.col("p.a")) & (s["b"] >= F.col("p.b")))
    return parts.select("edge_id", "k", F.col("p.a").alias("a"), F.col("p.b").alias("b"), node(F.col("p.a")).alias("from_node"), node(F.col("p.b")).alias("to_node"), wet.alias("culvert"))


def insert_culverts(edges: DataFrame, roads: DataFrame, waters: DataFrame, size: float, half: float = 10.0, least: float = 0.5) -> DataFrame:
    """Edges with culverts where plain roads cross a waterway: (edge_id, piece, u, v, from_m, to_m, length, crossing_type).

    edges: edge_id, u, v, length, crossing_type, tunnel. roads: road_id (an edge's id), line. waters: water_id, line, both
    in metres. Tunnels, bridges and fords keep their edge as it is, as do roads that no water crosses; others are cut into
    pieces of type none or culvert. `size` is the width of the grid on which lines meet.
    """
    from cutoffs.operators.spatial import crossings

    plain = edges.filter((F.col("crossing_type") == "none") & ~F.coalesce("tunnel", F.lit(False)))
    open_ = roads.join(plain.select(F.col("edge_id").alias("road_id")), "road_id", "left_semi")
    at = crossings(open_, waters, size).groupBy(F.col("road_id").alias("edge_id")).agg(F.collect_set("dist").alias("dists"))
    cut = culvert_pieces(plain.join(at, "edge_id").select("edge_id", "u", "v", "length", "dists"), half, least)
    pieces = cut.select("edge_id", F.col("k").alias("piece"), F.col("from_node").alias("u"), F.col("to_node").alias("v"), F.col("a").alias("from_m"), F.col("b").alias("to_m"), (F.col("b") - F.col("a")).alias("length"), F.when(F.col("culvert"), "culvert").otherwise("none").alias("crossing_type"))
    whole = edges.join(at.select("edge_id"), "edge_id", "left_anti")
    whole = whole.select("edge_id", F.lit(0).alias("piece"), F.col("u").cast("long"), F.col("v").cast("long"), F.lit(0.0).alias("from_m"), F.col("length").alias("to_m"), "length", "crossing_type")
    return whole.union(pieces)


def merge_lines(ways: DataFrame) -> DataFrame:
    """(component, way_id, seq, length): chains of ways joined at their ends, in order; the longest chain is the coast.

    ways: way_id, first, last (end nodes), length; a way runs from first to last, and the next begins where it ends. Of
    several ways that end in a node, the one with the smallest id leads on, to the smallest that begins there; the others
    end or begin chains. A closed ring is cut before its smallest way. component is the smallest way of the chain.
    """
    from cutoffs.session import materialize

    w = materialize(ways.select("way_id", "first", "last", F.col("length").cast("double").alias("length")))
    ends = w.groupBy("last").agg(F.min("way_id").alias("prev")).withColumnRenamed("last", "first")
    starts = w.groupBy("first").agg(F.min("way_id").alias("way_id"))
    link = starts.join(ends, "first").filter("way_id <> prev").select("way_id", "prev")
    # steps back to the head by doubling, of the ways that don't know theirs yet. low is the smallest way passed and at the
    # steps to it: if the next stretch of the walk passes the same way again, this is a ring, and that way its smallest
    cur = materialize(w.join(link, "way_id", "left").select("way_id", F.col("prev").alias("to")))
    known = cur.filter("to is null").select("way_id", F.col("way_id").alias("head"), F.lit(0).cast("long").alias("seq"))
    open_ = cur.filter("to is not null").select("way_id", "to", F.lit(1).cast("long").alias("seq"), F.struct(F.col("to").alias("low"), F.lit(1).cast("long").alias("at")).alias("l"))
    while not open_.isEmpty():
        at = open_.select("way_id", F.lit(None).cast(known.schema["head"].dataType).alias("head"), "seq", F.col("to").alias("next"), "l").union(known.select("way_id", "head", "seq", F.lit(None).cast(known.schema["head"].dataType), F.lit(None).cast(open_.schema["l"].dataType)))
        at = at.select(F.col("way_id").alias("to"), F.col("head").alias("_head"), F.col("seq").alias("_seq"), F.col("next").alias("_next"), F.col("l").alias("_l"))
        head = F.coalesce("_head", F.when(F.col("l.low") == F.col("_l.low"), F.col("l.low")))
        met = open_.join(at, "to").withColumn("head", head)
        steps = F.when(F.col("way_id") == F.col("head"), 0).when(F.col("l.low") == F.col("head"), F.col("l.at")).otherwise(F.col("seq") + F.col("_seq"))
        further = F.struct(F.col("_l.low").alias("low"), (F.col("seq") + F.col("_l.at")).alias("at"))
        met = materialize(met.select("way_id", "head", F.when(F.col("head").isNull(), F.col("_next")).alias("to"), F.when(F.col("head").isNull(), F.col("seq") + F.col("_seq")).otherwise(steps).alias("seq"), F.when(F.col("head").isNull(), F.least("l", further)).alias("l")))
        known = known.union(met.filter("head is not null").select("way_id", "head", "seq"))
        open_ = met.filter("head is null").select("way_id", "to", "seq", "l")
    name = known.groupBy("head").agg(F.min("way_id").alias("component"))
    return w.join(known.join(name, "head"), "way_id").select("component", "way_id", "seq", "length")
