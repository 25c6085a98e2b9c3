"""Hazard, closure, impact and validation operators over customers, orders and labels."""

from __future__ import annotations

from pyspark.sql import functions as F

from cutoffs.operators import impact, rainfall
from cutoffs.registry import query, sql

ROADS = """SELECT p_partkey AS edge_id, CAST(p_size AS DOUBLE) / 10 AS hand, CASE p_partkey % 4 WHEN 0 THEN 'primary' WHEN 1 THEN 'tertiary_link' WHEN 2 THEN 'motorway_link' END AS road_class FROM part"""
_BED = "CASE WHEN road_class IN ('motorway', 'motorway_link', 'trunk', 'trunk_link', 'primary', 'primary_link') THEN 1.0e0 WHEN road_class IN ('secondary', 'secondary_link', 'tertiary', 'tertiary_link') THEN 0.6e0 ELSE 0.3e0 END"


@query("SC10_rain_threshold", f"WITH r AS ({ROADS}) SELECT edge_id, round(CASE WHEN hand + {_BED} + 0.3e0 < 5 THEN 50 + (hand + {_BED} + 0.3e0) / 0.02e0 END, 6) AS mm FROM r")
def sc10(spark, sf):
    return sql(spark, sf, ROADS).select("edge_id", F.round(rainfall.rain_threshold_mm(F.col("hand"), rainfall.bed_allowance(F.col("road_class"))), 6).alias("mm"))


@query("SC11_site_threshold", f"WITH r AS ({ROADS}) SELECT edge_id, round(50 + (hand + 0.3e0) / 0.02e0, 6) AS mm FROM r")
def sc11(spark, sf):
    return sql(spark, sf, ROADS).select("edge_id", F.round(rainfall.site_threshold_mm(F.col("hand")), 6).alias("mm"))


@query("SC12_bed_allowance", f"WITH r AS ({ROADS}) SELECT edge_id, {_BED} AS allowance FROM r")
def sc12(spark, sf):
    return sql(spark, sf, ROADS).select("edge_id", rainfall.bed_allowance(F.col("road_class")).alias("allowance"))


@query("SC20_flood_height", "SELECT c_custkey, round(least(5e0, greatest(0e0, 0.02e0 * (c_acctbal / 10 - 50))), 6) AS h FROM customer")
def sc20(spark, sf):
    return sql(spark, sf, "SELECT c_custkey, c_acctbal FROM customer").select("c_custkey", F.round(rainfall.flood_height(F.col("c_acctbal") / 10), 6).alias("h"))


@query("SC21_uniform_draw", "SELECT o_orderkey, CAST(('0x' || substr(sha256('run|' || o_orderkey || '|' || o_custkey), 1, 13)) AS BIGINT) / 4503599627370496e0 AS u FROM orders")
def sc21(spark, sf):
    return sql(spark, sf, "SELECT o_orderkey, o_custkey FROM orders").select("o_orderkey", rainfall.uniform(F.lit("run"), F.col("o_orderkey"), F.col("o_custkey")).alias("u"))


@query("SC17_alongshore_profile", "SELECT c_custkey, round(4 * exp(-0.5 * pow((c_acctbal / 100 - 20) / 60, 2)), 6) AS h FROM customer")
def sc17(spark, sf):
    h = rainfall.alongshore_profile(F.col("c_acctbal") / 100, F.lit(4.0), F.lit(20.0), F.lit(30.0))
    return sql(spark, sf, "SELECT c_custkey, c_acctbal FROM customer").select("c_custkey", F.round(h, 6).alias("h"))


@query("SC18_surge_depth", "SELECT c_custkey, round(CASE WHEN c_nationkey / 10e0 < 4 - 0.083e0 * (c_custkey % 40) THEN 4 - 0.083e0 * (c_custkey % 40) - c_nationkey / 10e0 END, 6) AS depth FROM customer")
def sc18(spark, sf):
    c = sql(spark, sf, "SELECT c_custkey, c_nationkey FROM customer")
    return c.select("c_custkey", F.round(rainfall.surge_depth(F.lit(4.0), F.col("c_custkey") % 40, F.col("c_nationkey") / 10), 6).alias("depth"))


@query("SC19_member_peak", "SELECT c_custkey, round(CASE WHEN c_nationkey % 2 = 0 THEN 3 * pow((c_custkey % 50) / 25e0, 2) ELSE 0 END, 6) AS peak, round(CASE WHEN c_custkey % 12 > 5 THEN c_custkey % 12 ELSE 46.4 * exp(-0.0155 * (c_custkey % 50) + 0.0169 * 16) END, 6) AS rmax FROM customer")
def sc19(spark, sf):
    c = sql(spark, sf, "SELECT c_custkey, c_nationkey FROM customer")
    v = F.col("c_custkey") % 50
    peak = rainfall.member_peak(F.lit(3.0), v, F.lit(25.0), F.col("c_nationkey") % 2 == 0)
    rmax = rainfall.member_rmax_km((F.col("c_custkey") % 12).cast("double"), v, F.lit(16.0))
    return c.select("c_custkey", F.round(peak, 6).alias("peak"), F.round(rmax, 6).alias("rmax"))


_CLEAN = "trim(regexp_replace(lower({0}), '[^a-z]+', ' ', 'g'))"


#: Nations as areas of three regions; their texts name an area, a region, part of the state, the state, or none of it.
_AREAS = "SELECT substr('abcdefghijklmnopqrstuvwxyz', n_nationkey + 1, 1) || 'land' AS name, CASE WHEN n_regionkey < 2 THEN 'Coastal Strip' ELSE 'Inland' END AS subdivision, CASE n_regionkey WHEN 0 THEN 'north_coastal' WHEN 1 THEN 'south_coastal' WHEN 2 THEN 'rayalaseema' ELSE 'other' END AS region FROM nation"
_SAID = "SELECT o_orderkey AS text_id, CASE o_orderkey % 6 WHEN 0 THEN 'Heavy rain over ' || coalesce(substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ', n_nationkey + 1, 1) || 'LAND', 'Rayalaseema') || '.' WHEN 1 THEN 'North-Coastal parts' WHEN 2 THEN 'Rayalaseema & south coastal Home State' WHEN 3 THEN 'Coastal Home State; squalls' WHEN 4 THEN 'most of HOME STATE' ELSE 'Far Country' END AS text FROM orders LEFT JOIN nation ON n_nationkey = o_custkey % 40"


@query(
    "J1_match_areas",
    f"""WITH a AS ({_AREAS}), t AS (SELECT o_orderkey AS text_id, o_orderkey % 6 AS k, substr('abcdefghijklmnopqrstuvwxyz', n_nationkey + 1, 1) || 'land' AS n_name FROM orders LEFT JOIN nation ON n_nationkey = o_custkey % 40)
SELECT text_id, n_name AS area, 1 AS tier FROM t WHERE k = 0 AND n_name IS NOT NULL
UNION ALL SELECT text_id, name, 2 FROM t JOIN a ON (k = 0 AND n_name IS NULL OR k = 2 AND false) AND region = 'rayalaseema'
UNION ALL SELECT text_id, name, 2 FROM t JOIN a ON k = 1 AND region = 'north_coastal'
UNION ALL SELECT text_id, name, 2 FROM t JOIN a ON k = 2 AND region = 'south_coastal'
UNION ALL SELECT text_id, name, 3 FROM t JOIN a ON k = 3 AND (subdivision LIKE 'Coastal%' OR region LIKE '%coastal')
UNION ALL SELECT text_id, name, 4 FROM t JOIN a ON k = 4
UNION ALL SELECT text_id, NULL, NULL FROM t WHERE k = 5""",
)
def j1(spark, sf):
    areas = sql(spark, sf, _AREAS).withColumn("variants", F.array().cast("array<string>"))
    return rainfall.match_areas(sql(spark, sf, _SAID), areas, "Home State")


_WARN = "SELECT c_nationkey AS area, CAST(c_custkey % 3 AS INTEGER) AS d0, c_mktsegment AS category, CASE c_custkey % 5 WHEN 0 THEN 'isolated' WHEN 1 THEN 'a_few' WHEN 2 THEN 'many' WHEN 3 THEN 'most' ELSE 'vague' END AS coverage FROM customer"
FRACTIONS = {"isolated": 0.125, "a_few": 0.38, "many": 0.63, "most": 0.88}
_FRAC = "CASE coverage WHEN 'isolated' THEN 0.125e0 WHEN 'a_few' THEN 0.38e0 WHEN 'many' THEN 0.63e0 WHEN 'most' THEN 0.88e0 END"


@query("AG8_coverage_table", f"WITH w AS ({_WARN}), d AS (SELECT area, DATE '2025-10-26' + d0 + k AS day, category, {_FRAC} AS frac FROM w, (SELECT unnest([0, 1]) AS k)) SELECT area, CAST(day AS DATE) AS day, category, max(frac) AS frac, bool_or(frac IS NULL) AS needs_review FROM d GROUP BY 1, 2, 3")
def ag8(spark, sf):
    w = sql(spark, sf, _WARN)
    day = F.date_add(F.lit("2025-10-26").cast("date"), F.col("d0"))
    return rainfall.coverage_table(w.withColumn("days", F.array(day, F.date_add(day, 1))), FRACTIONS)


_PATCH = "SELECT c_custkey AS patch, c_nationkey AS area, CAST(c_custkey % 1000 AS DOUBLE) / 1000 AS u, CAST(c_custkey % 7 AS DOUBLE) / 7 AS q FROM customer"
_CATS = "SELECT n_nationkey AS area, k * 50e0 AS lo, k * 50e0 + 40 AS hi, CAST((n_nationkey * 7 + k * 3) % 10 AS DOUBLE) / 20 AS frac FROM nation, ({ks}) AS ks"


@query("W6_category_draw", f"""WITH p AS ({_PATCH}), c AS ({_CATS.format(ks="SELECT unnest([1, 2, 3, 4]) AS k")}), l AS (SELECT area, lo, hi, max(frac) OVER (PARTITION BY area ORDER BY hi DESC, lo DESC) AS cum FROM c),
h AS (SELECT patch, q, lo, hi, row_number() OVER (PARTITION BY patch ORDER BY hi DESC, lo DESC) AS k FROM p JOIN l ON p.area = l.area WHERE u < cum) SELECT p.patch, round(coalesce(lo + p.q * (hi - lo), 0), 6) AS total_mm FROM p LEFT JOIN h ON p.patch = h.patch AND k = 1""")
def w6(spark, sf):
    day = F.lit("2025-10-26").cast("date")
    cats = sql(spark, sf, _CATS.format(ks="SELECT explode(array(1, 2, 3, 4)) AS k")).withColumn("day", day)
    out = rainfall.draw_totals(sql(spark, sf, _PATCH).withColumn("day", day), cats, ["patch"])
    return out.select("patch", F.round("total_mm", 6).alias("total_mm"))


_TOTAL = "SELECT o_custkey AS patch, CAST(o_orderdate AS DATE) AS day, CAST(o_orderkey % 120 AS DOUBLE) AS mm FROM orders"


@query("W7_hourly_curve", f"""WITH t AS (SELECT patch, DATE '2025-10-26' + CAST(date_diff('day', DATE '1992-01-01', day) % 3 AS INTEGER) AS day, mm FROM ({_TOTAL})), h AS (SELECT unnest(range(1, 49)) AS h),
p AS (SELECT patch, h, sum(CASE WHEN h > s AND h <= s + 24 THEN mm / 24 ELSE 0 END) AS r FROM (SELECT patch, mm, date_diff('day', DATE '2025-10-26', day) * 24 + 3 AS s FROM t), h GROUP BY 1, 2), c AS (SELECT patch, h, sum(r) OVER (PARTITION BY patch ORDER BY h) AS c FROM p) SELECT patch, h AS hour, round(c, 4) AS mm FROM c""")
def w7(spark, sf):
    t = sql(spark, sf, _TOTAL).select("patch", F.date_add(F.lit("2025-10-26").cast("date"), F.datediff("day", F.lit("1992-01-01").cast("date")) % 3).alias("day"), F.col("mm").alias("total_mm"))
    out = rainfall.hourly_curve(t, ["patch"], 48, F.lit("2025-10-26 00:00:00").cast("timestamp"))
    return out.select("patch", F.posexplode("cum").alias("hour", "mm")).filter("hour > 0").select("patch", F.col("hour").cast("long").alias("hour"), F.round("mm", 4).alias("mm"))


#: Members' curves by patch: four members, 25 patches, 73 hours.
_CURVE = "SELECT c_nationkey AS patch, c_custkey % 4 AS member, CAST(c_custkey % 73 AS INTEGER) AS h, abs(c_acctbal) / 100 AS r FROM customer"
_EDGE = "SELECT p_partkey AS edge_id, p_partkey % 25 AS patch, CASE WHEN p_size < 45 THEN 50 + p_size * 10e0 END AS threshold_mm, p_size AS surge_cell, CAST(p_partkey % 9 AS DOUBLE) / 4 AS need_m FROM part"
_CUM = f"k AS ({_CURVE}), g AS (SELECT DISTINCT patch, member FROM k), hh AS (SELECT unnest(range(0, 73)) AS h), c AS (SELECT g.patch, g.member, hh.h, coalesce(sum(k.r), 0) AS cum FROM g, hh LEFT JOIN k ON k.patch = g.patch AND k.member = g.member AND k.h <= hh.h GROUP BY 1, 2, 3)"
_ONSET = "SELECT s_suppkey % 4 AS member, s_suppkey % 50 AS surge_cell, max(CAST(s_suppkey % 7 AS DOUBLE) / 3) AS depth, min(s_suppkey % 31) AS onset FROM supplier GROUP BY 1, 2"


def curves(spark, sf):
    k = sql(spark, sf, _CURVE).groupBy("patch", "member", "h").agg(F.sum("r").alias("r"))
    by = k.groupBy("patch", "member").agg(F.map_from_entries(F.collect_list(F.struct("h", "r"))).alias("m"))
    step = F.transform(F.sequence(F.lit(0), F.lit(72)), lambda h: F.coalesce(F.try_element_at("m", h), F.lit(0.0)))
    cum = F.aggregate(step, F.array().cast("array<double>"), lambda a, r: F.concat(a, F.array(F.coalesce(F.try_element_at(a, F.lit(-1)), F.lit(0.0)) + r)))
    return by.select("member", "patch", cum.alias("cum"))


_RAIN = f"{_CUM}, e AS ({_EDGE}), rain AS (SELECT member, edge_id, min(h) AS t FROM e JOIN c ON e.patch = c.patch WHERE cum >= threshold_mm GROUP BY 1, 2)"


@query("J21_rain_closures", f"WITH {_RAIN} SELECT member, edge_id, CAST(t AS DOUBLE) AS t_close FROM rain")
def j21(spark, sf):
    e = sql(spark, sf, _EDGE)
    return e.join(curves(spark, sf), "patch").select("member", "edge_id", rainfall.first_hour_reaching(F.col("cum"), F.col("threshold_mm")).cast("double").alias("t_close")).filter("t_close is not null")


@query("J22_surge_closures", f"WITH e AS ({_EDGE}), o AS ({_ONSET}) SELECT member, edge_id, min(onset) AS t FROM e JOIN o ON e.surge_cell = o.surge_cell WHERE depth > need_m GROUP BY 1, 2")
def j22(spark, sf):
    e, o = sql(spark, sf, _EDGE), sql(spark, sf, _ONSET)
    return e.join(o, "surge_cell").filter("depth > need_m").groupBy("member", "edge_id").agg(F.min("onset").alias("t"))


_ALL = f"{_RAIN}, o AS ({_ONSET}), surge AS (SELECT member, edge_id, min(onset) AS t FROM e JOIN o ON e.surge_cell = o.surge_cell WHERE depth > need_m GROUP BY 1, 2), closed AS (SELECT member, edge_id, CAST(min(t) AS DOUBLE) AS t_close FROM (SELECT * FROM rain UNION ALL SELECT * FROM surge) GROUP BY 1, 2)"


@query("G13_edge_closures", f"WITH {_ALL} SELECT * FROM closed")
def g13(spark, sf):
    return rainfall.edge_closures(sql(spark, sf, _EDGE), curves(spark, sf), sql(spark, sf, _ONSET))


@query("AG29_earliest_cause", "SELECT l_orderkey, l_linenumber, min(least(nullif(l_partkey % 9, 0), nullif(l_suppkey % 7, 0))) AS t FROM lineitem GROUP BY 1, 2")
def ag29(spark, sf):
    t = sql(spark, sf, "SELECT l_orderkey, l_linenumber, nullif(l_partkey % 9, 0) AS a, nullif(l_suppkey % 7, 0) AS b FROM lineitem")
    return t.groupBy("l_orderkey", "l_linenumber").agg(F.min(rainfall.combine(F.col("a"), F.col("b"))).alias("t"))


@query("AG32_site_availability", f"""WITH {_CUM}, s AS ({_EDGE}), o AS ({_ONSET}), r AS (SELECT member, edge_id, min(h) FILTER (WHERE cum >= threshold_mm) AS t, max(cum) FILTER (WHERE h = 30) AS rain FROM s JOIN c ON s.patch = c.patch GROUP BY 1, 2),
u AS (SELECT member, edge_id, min(onset) AS t FROM s JOIN o ON s.surge_cell = o.surge_cell WHERE depth > 0.3 GROUP BY 1, 2) SELECT r.member, r.edge_id AS site_id, CAST(least(r.t, u.t) AS DOUBLE) AS avail, round(rain, 6) AS rain_at_landfall FROM r LEFT JOIN u ON r.member = u.member AND r.edge_id = u.edge_id""")
def ag32(spark, sf):
    sites = sql(spark, sf, _EDGE).withColumnRenamed("edge_id", "site_id")
    return rainfall.site_availability(sites, curves(spark, sf), sql(spark, sf, _ONSET), 30).withColumn("rain_at_landfall", F.round("rain_at_landfall", 6))


_CROSS = "SELECT l_orderkey * 8 + l_linenumber AS edge_id, l_partkey AS u, l_suppkey AS v, CASE WHEN l_linenumber = 1 THEN 'bridge' ELSE 'none' END AS crossing_type, l_quantity AS min_hand_m, l_quantity + l_tax AS hand_u_end_m, CASE WHEN l_returnflag = 'A' THEN NULL ELSE l_quantity + l_discount END AS hand_v_end_m FROM lineitem"


@query("J18_approach_heights", f"""WITH e AS ({_CROSS}), n AS (SELECT node, min(h) AS h FROM (SELECT u AS node, hand_u_end_m AS h FROM e WHERE crossing_type = 'none' UNION ALL SELECT v, hand_v_end_m FROM e WHERE crossing_type = 'none') GROUP BY 1)
SELECT edge_id, u, v, round(CASE WHEN crossing_type = 'none' THEN min_hand_m ELSE least(a.h, b.h) END, 6) AS hand_m FROM e LEFT JOIN n a ON e.u = a.node LEFT JOIN n b ON e.v = b.node""")
def j18(spark, sf):
    return rainfall.approach_heights(sql(spark, sf, _CROSS)).select("edge_id", "u", "v", F.round("hand_m", 6).alias("hand_m"))


_W = "SELECT unnest([0, 1, 2, 3]) AS member, unnest([1e0, 2e0, 3e0, 2e0]) / 8 AS weight"


def weights(spark):
    return spark.range(4).select(F.col("id").alias("member"), (F.element_at(F.array(*[F.lit(x) for x in (1.0, 2.0, 3.0, 2.0)]), (F.col("id") + 1).cast("int")) / 8).alias("weight"))


@query("AG19_closing_probability", f"WITH {_ALL}, w AS ({_W}) SELECT edge_id, sum(weight) AS p FROM closed JOIN w ON closed.member = w.member GROUP BY 1 HAVING sum(weight) >= 0.25")
def ag19(spark, sf):
    return impact.closing_probability(g13(spark, sf), weights(spark), 0.25)


@query("J20_star_join", f"WITH {_ALL}, w AS ({_W}) SELECT closed.member, edge_id, t_close, weight FROM closed JOIN w ON closed.member = w.member")
def j20(spark, sf):
    return g13(spark, sf).join(F.broadcast(weights(spark)), "member").select("member", "edge_id", "t_close", "weight")


@query("J5_patch_lookup", "SELECT c_custkey, coalesce(n_regionkey, -1) AS patch FROM customer LEFT JOIN (SELECT * FROM nation WHERE n_regionkey < 3) ON c_nationkey = n_nationkey")
def j5(spark, sf):
    n = sql(spark, sf, "SELECT n_nationkey AS c_nationkey, n_regionkey FROM nation").filter("n_regionkey < 3")
    return sql(spark, sf, "SELECT c_custkey, c_nationkey FROM customer").join(n, "c_nationkey", "left").select("c_custkey", F.coalesce("n_regionkey", F.lit(-1)).alias("patch"))


_CUT = "SELECT c_nationkey AS district, c_custkey % 4 AS member, CAST(c_custkey % 90 AS DOUBLE) AS b, floor(greatest(c_acctbal, 0)) AS population FROM customer"


@query("AG16_people_cut", f"""WITH c AS ({_CUT}), w AS ({_W}), h AS (SELECT unnest([0, 12, 24, 48, 72]) AS hour), g AS (SELECT d.district, w.member, weight, hour, coalesce(sum(population) FILTER (WHERE b <= hour), 0) AS people FROM (SELECT DISTINCT district FROM c) d CROSS JOIN w CROSS JOIN h LEFT JOIN c ON c.district = d.district AND c.member = w.member GROUP BY ALL),
v AS (SELECT district, hour, people, sum(weight) AS w FROM g GROUP BY ALL), q AS (SELECT district, hour, people, sum(w) OVER (PARTITION BY district, hour ORDER BY people) / sum(w) OVER (PARTITION BY district, hour) AS cdf FROM v)
SELECT district, CAST(hour AS INTEGER) AS hour, CAST(min(people) FILTER (WHERE cdf >= 0.1) AS DOUBLE) AS p10, CAST(min(people) FILTER (WHERE cdf >= 0.5) AS DOUBLE) AS p50, CAST(min(people) FILTER (WHERE cdf >= 0.9) AS DOUBLE) AS p90 FROM q GROUP BY 1, 2""")
def ag16(spark, sf):
    return impact.people_cut(sql(spark, sf, _CUT).withColumn("population", F.col("population").cast("double")), weights(spark), [0, 12, 24, 48, 72])


_ISO = "SELECT c_nationkey AS district, c_custkey % 4 AS member, c_custkey AS site, CASE WHEN c_custkey % 11 = 0 THEN CAST('-Infinity' AS DOUBLE) ELSE CAST(c_custkey % 90 AS DOUBLE) END AS b FROM customer"


@query("AG17_sites_at_risk", f"WITH i AS ({_ISO}) SELECT district, member, count(*) FILTER (WHERE b <> CAST('-Infinity' AS DOUBLE) AND b <= 36) AS at_landfall, count(*) FILTER (WHERE b <= 36) AS by_hour_rule FROM i GROUP BY 1, 2")
def ag17(spark, sf):
    return impact.sites_at_risk(sql(spark, sf, _ISO), 36.0)


@query("Q6_actions")
def q6(spark, sf):
    from cutoffs.plans.spatial import points

    p = points(spark, sf)
    cross = p.filter("id % 5 <> 0").select(F.col("kind").alias("district"), "id", "x", "y", ((F.col("id") % 10) / 10).alias("p"), (F.col("id") % 48).cast("double").alias("p10_close"))
    people = p.filter("id % 5 = 0").select(F.col("id").alias("rid"), F.col("x").alias("rx"), F.col("y").alias("ry"), (F.col("id") * 3.0).alias("population"))
    return impact.actions(cross, people, radius=60.0, apart=40.0)


@query("Q9_badges", "SELECT s_suppkey, CASE WHEN s_suppkey % 5 <> 0 THEN CAST(s_suppkey % 10 AS DOUBLE) / 10 END AS p, concat_ws('; ', CASE WHEN s_nationkey % 2 = 0 AND s_suppkey % 3 = 0 THEN 'possible delivery point' END, CASE WHEN s_suppkey % 3 <> 0 THEN 'referral isolation' END, CASE WHEN s_suppkey % 7 = 0 THEN 'no mapped route' END) AS badges FROM supplier")
def q9(spark, sf):
    s = sql(spark, sf, "SELECT s_suppkey, CASE WHEN s_nationkey % 2 = 0 THEN 'hospital' ELSE 'clinic' END AS kind, CAST(s_suppkey % 10 AS DOUBLE) / 10 AS p, s_suppkey % 7 = 0 AS no_route, s_suppkey % 3 = 0 AS reachable, s_suppkey % 5 = 0 AS deterministic FROM supplier")
    return impact.badges(s).select("s_suppkey", "p", F.array_join("badges", "; ").alias("badges"))


_LAB = "SELECT source AS district, labels.quality = 1 AS pred, labels.toxic = 1 AS obs FROM labels JOIN documents ON labels.doc_id = documents.doc_id"


@query("AG24_contingency", f"""WITH l AS ({_LAB}), c AS (SELECT district, count(*) FILTER (WHERE pred AND obs) AS hits, count(*) FILTER (WHERE NOT pred AND obs) AS misses, count(*) FILTER (WHERE pred AND NOT obs) AS false_alarms FROM l GROUP BY ROLLUP (district))
SELECT *, round(hits / nullif(hits + misses, 0), 3) AS pod, round(false_alarms / nullif(hits + false_alarms, 0), 3) AS far, round(hits / nullif(hits + misses + false_alarms, 0), 3) AS csi FROM c""")
def ag24(spark, sf):
    return impact.contingency(sql(spark, sf, _LAB), F.col("pred"), F.col("obs"), ["district"])


@query("T2_flag_top", "WITH k AS (SELECT c_nationkey, c_custkey, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_acctbal, c_custkey) AS r FROM customer) SELECT c_custkey, r <= c_nationkey + 1 AS flagged FROM k")
def t2(spark, sf):
    c = sql(spark, sf, "SELECT c_nationkey, c_custkey, c_acctbal, c_nationkey + 1 AS k FROM customer")
    return impact.flag_top(c, ["c_nationkey"], "c_acctbal", "k", tie="c_custkey").select("c_custkey", "flagged")


_VAL = "SELECT source AS district, labels.quality = 1 AS model, labels.doc_id % 3 = 0 AS baseline, CASE WHEN labels.doc_id % 10 = 9 THEN NULL ELSE labels.toxic = 1 END AS observed FROM labels JOIN documents ON labels.doc_id = documents.doc_id"


@query("Q8_validation_report", f"""WITH v AS ({_VAL}), m AS (SELECT district, 'model' AS method, model AS pred, observed AS obs FROM v WHERE observed IS NOT NULL UNION ALL SELECT district, 'baseline', baseline, observed FROM v WHERE observed IS NOT NULL),
c AS (SELECT method, district, count(*) FILTER (WHERE pred AND obs) AS hits, count(*) FILTER (WHERE NOT pred AND obs) AS misses, count(*) FILTER (WHERE pred AND NOT obs) AS false_alarms FROM m GROUP BY GROUPING SETS ((method, district), (method))),
u AS (SELECT district, count(*) AS not_observed FROM v WHERE observed IS NULL GROUP BY 1)
SELECT c.district, method, hits, misses, false_alarms, round(hits / nullif(hits + misses, 0), 3) AS pod, round(false_alarms / nullif(hits + false_alarms, 0), 3) AS far, round(hits / nullif(hits + misses + false_alarms, 0), 3) AS csi, coalesce(not_observed, 0) AS not_observed FROM c LEFT JOIN u ON c.district = u.district""")
def q8(spark, sf):
    return impact.validation_report(sql(spark, sf, _VAL), ["model", "baseline"])


@query("SC13_travel_time", "SELECT p_partkey, round(p_retailprice / (CASE p_size % 6 WHEN 0 THEN 80 WHEN 1 THEN 35 WHEN 2 THEN 25 WHEN 3 THEN 10 WHEN 4 THEN 40 ELSE 20 END / 3.6e0), 6) AS s FROM part")
def sc13(spark, sf):
    from cutoffs.operators.network import travel_time_s

    p = sql(spark, sf, "SELECT p_partkey, p_retailprice, CASE p_size % 6 WHEN 0 THEN 'motorway' WHEN 1 THEN 'primary_link' WHEN 2 THEN 'tertiary_link' WHEN 3 THEN 'living_street' WHEN 4 THEN 'secondary' END AS road_class FROM part")
    return p.select("p_partkey", F.round(travel_time_s(F.col("p_retailprice"), F.col("road_class")), 6).alias("s"))


#: A straight coast of 320 points every 0.25 km, and low ground behind it made of lineitem's grid.
_LOW = "SELECT CAST(l_orderkey % 40 AS INTEGER) AS row, CAST(l_partkey % 80 AS INTEGER) AS col, (sum(l_quantity) % 29) / 10 + 0.05 AS elev FROM lineitem GROUP BY 1, 2"
_MEMBERS = "SELECT n_nationkey AS member, 1.5e0 + n_nationkey / 10e0 AS peak_m, CASE WHEN n_nationkey % 6 <> 5 THEN n_nationkey * 3e0 END AS s_landfall_km, CAST(CASE WHEN n_nationkey % 2 = 0 THEN 1 ELSE -1 END AS INTEGER) AS right_sign, 10e0 + n_nationkey AS rmax_km FROM nation"
_TRACK = "SELECT n_nationkey AS member, h AS hour, n_nationkey * 3e0 - 120 + h * 4e0 AS x_km, 90e0 - h * 3e0 AS y_km FROM nation, ({hours})"


@query(
    "G8_member_surge",
    f"""WITH RECURSIVE g AS ({_LOW}), c AS (SELECT row, col, elev, row * 0.25e0 AS d_km, col * 4 AS coast_id, row = 0 AS seed FROM g), m AS ({_MEMBERS}), t AS ({_TRACK.format(hours="SELECT unnest(range(73)) AS h")}),
w AS (SELECT member, row, col, seed, coast_id, peak_m * exp(-0.5 * pow((coast_id * 0.25 - (s_landfall_km + right_sign * rmax_km)) / (2 * rmax_km), 2)) - 0.083e0 * d_km - elev AS depth FROM m, c WHERE s_landfall_km IS NOT NULL),
x AS (SELECT * FROM w WHERE depth > 0), o AS (SELECT i.i, j.j FROM (SELECT unnest([-1, 0, 1]) AS i) i, (SELECT unnest([-1, 0, 1]) AS j) j),
r(member, row, col) AS (SELECT member, row, col FROM x WHERE seed UNION SELECT x.member, x.row, x.col FROM r, o, x WHERE x.member = r.member AND x.row = r.row + i AND x.col = r.col + j),
n AS (SELECT m.member, k.id AS coast_id, min(hour) AS onset FROM m JOIN t ON m.member = t.member, (SELECT unnest(range(320)) AS id) k WHERE sqrt(pow(k.id * 0.25 - x_km, 2) + pow(y_km, 2)) <= rmax_km + 50 GROUP BY 1, 2)
SELECT x.member, x.row, x.col, round(depth, 6) AS depth, coalesce(CAST(onset AS DOUBLE), CAST('Infinity' AS DOUBLE)) AS onset FROM x JOIN r ON x.member = r.member AND x.row = r.row AND x.col = r.col LEFT JOIN n ON n.member = x.member AND n.coast_id = x.coast_id""",
)
def g8(spark, sf):
    cells = sql(spark, sf, _LOW).select("row", "col", F.col("elev").cast("double"), (F.col("row") * 0.25).cast("double").alias("d_km"), (F.col("col") * 4).cast("long").alias("coast_id"), (F.col("row") == 0).alias("seed"))
    coast = spark.range(320).select(F.col("id").alias("coast_id"), (F.col("id") * 0.25).alias("x_km"), F.lit(0.0).alias("y_km"), (F.col("id") * 0.25).alias("s_km"))
    track = sql(spark, sf, _TRACK.format(hours="SELECT explode(sequence(0, 72)) AS h"))
    out = rainfall.member_surge(sql(spark, sf, _MEMBERS), coast, cells, track, ["member"])
    return out.withColumn("depth", F.round("depth", 6))
