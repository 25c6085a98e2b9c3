"""Track operators over events: type = source, user = member, time of the event = valid time."""

from __future__ import annotations

from pyspark.sql import functions as F

from cutoffs.functions import geo, wind
from cutoffs.operators import series
from cutoffs.registry import query, sql

TRACKS = """SELECT event_type AS source, user_id AS member_no, 'S' || CAST(event_id % 3 AS VARCHAR(1)) AS storm_id, event_id, ts AS valid_utc,
  5e0 + (event_id % 997) / 1e2 AS lat, 80e0 + (event_id % 991) / 1e2 AS lon, value AS vmax_ms FROM events"""
#: In the other engine: seconds of a time, great-circle distance.
_T = f"t AS ({TRACKS}), x AS (SELECT *, epoch_us(valid_utc) / 1e6 AS s FROM t)"
_HAV = "2 * 6371.0088 * asin(sqrt(least(greatest(pow(sin(radians({b} - {a}) / 2), 2) + cos(radians({a})) * cos(radians({b})) * pow(sin(radians({d} - {c}) / 2), 2), 0.0), 1.0)))"


def hav(a: str, c: str, b: str, d: str) -> str:
    return _HAV.format(a=a, b=b, c=c, d=d)


def r6(df, *cols):
    return df.withColumns({c: F.round(c, 6) for c in cols})


@query("SC2_haversine_km", f"WITH {_T} SELECT event_id, round({hav('lat', 'lon', '16.5', '82.25')}, 6) AS km FROM x")
def sc2(spark, sf):
    t = sql(spark, sf, TRACKS)
    return t.select("event_id", F.round(geo.haversine_km(F.col("lat"), F.col("lon"), F.lit(16.5), F.lit(82.25)), 6).alias("km"))


@query("SC3_local_offsets", f"WITH {_T} SELECT event_id, round((lon - 82.25) * radians(1) * 6371008.8 * cos(radians((lat + 16.5) / 2)), 4) AS east, round((lat - 16.5) * radians(1) * 6371008.8, 4) AS north FROM x")
def sc3(spark, sf):
    e, n = geo.local_offsets_m(F.lit(82.25), F.lit(16.5), F.col("lon"), F.col("lat"))
    return sql(spark, sf, TRACKS).select("event_id", F.round(e, 4).alias("east"), F.round(n, 4).alias("north"))


@query("SC1_wind_units", """SELECT event_id, round(CASE event_id % 3 WHEN 0 THEN value * 1852 / 3600 WHEN 1 THEN value / 3.6 ELSE value END, 6) AS ms, round((CASE event_id % 3 WHEN 0 THEN value * 1852 / 3600 WHEN 1 THEN value / 3.6 ELSE value END) * 3600 / 1852, 6) AS kt FROM events""")
def sc1(spark, sf):
    e = sql(spark, sf, "SELECT event_id, value, CASE event_id % 3 WHEN 0 THEN 'kt' WHEN 1 THEN 'kmph' ELSE 'ms' END AS unit FROM events")
    ms = wind.wind_to_ms(F.col("value"), F.col("unit"))
    return e.select("event_id", F.round(ms, 6).alias("ms"), F.round(wind.ms_to_kt(ms), 6).alias("kt"))


@query("SC5_coriolis_rmax", f"WITH {_T} SELECT event_id, round(2e6 * 7.2921e-5 * sin(radians(lat)), 6) AS f, round(46.4 * exp(-0.0155 * vmax_ms / 10 + 0.0169 * abs(lat)), 6) AS rmax FROM x")
def sc5(spark, sf):
    t = sql(spark, sf, TRACKS)
    return t.select("event_id", F.round(wind.coriolis(F.col("lat")) * 1e6, 6).alias("f"), F.round(wind.willoughby_rmax_km(F.col("vmax_ms") / 10, F.col("lat")), 6).alias("rmax"))


_HALF = "greatest(1e3 * (event_id % 300), 1.0) * abs(2 * 7.2921e-5 * sin(radians(lat))) / 2"


@query("SC6_gradient_wind", f"WITH {_T} SELECT event_id, round(sqrt(1.5 / 1.15 * 4000 * pow(4e4 / greatest(1e3 * (event_id % 300), 1.0), 1.5) * exp(-pow(4e4 / greatest(1e3 * (event_id % 300), 1.0), 1.5)) + ({_HALF}) * ({_HALF})) - {_HALF}, 6) AS v FROM x")
def sc6(spark, sf):
    t = sql(spark, sf, TRACKS)
    v = wind.gradient_wind(1e3 * (F.col("event_id") % 300), F.lit(4e4), F.lit(1.5), F.lit(4000.0), wind.coriolis(F.col("lat")))
    return t.select("event_id", F.round(v, 6).alias("v"))


_W = {"r": "greatest(sqrt(ex * ex + ny * ny), 1.0)", "c": "cos(radians(20))", "s": "sin(radians(20))"}


@query(
    "SC9_surface_wind",
    f"""WITH {_T}, o AS (SELECT event_id, vmax_ms / 10 AS g, (event_id % 211 - 105) * 1e3 AS ex, (event_id % 197 - 98) * 1e3 AS ny, event_id % 2 = 0 AS land FROM x),
w AS (SELECT event_id, 0.8 * g * CASE WHEN land THEN 0.75 ELSE 1 END AS base, -ny / {_W["r"]} AS tx, ex / {_W["r"]} AS ty FROM o),
z AS (SELECT event_id, sqrt(pow(base * (tx * {_W["c"]} - ty * {_W["s"]}) + 1, 2) + pow(base * (tx * {_W["s"]} + ty * {_W["c"]}) + 2, 2)) AS v FROM w)
SELECT event_id, round(v, 6) AS sustained, round(v * 1.4, 6) AS gust FROM z""",
)
def sc9(spark, sf):
    t = sql(spark, sf, TRACKS)
    e, n = (F.col("event_id") % 211 - 105) * 1e3, (F.col("event_id") % 197 - 98) * 1e3
    v, g = wind.surface_wind(F.col("vmax_ms") / 10, e, n, F.lit(2.0), F.lit(4.0), F.col("event_id") % 2 == 0)
    return t.select("event_id", F.round(v, 6).alias("sustained"), F.round(g, 6).alias("gust"))


@query("SC8_fit_holland")
def sc8(spark, sf):
    t = sql(spark, sf, TRACKS).select("event_id", (F.col("vmax_ms") / 10 + 15).alias("v_sfc"), F.lit(5.0).alias("v_trans"), F.lit(40.0).alias("rmax_km"), "lat", F.when(F.col("event_id") % 2 == 0, 960.0 + F.col("event_id") % 40).alias("pc_hpa"))
    return wind.fit_holland(t)


_UTM_N = (1 / 298.257223563) / (2 - 1 / 298.257223563)


@query("SC4_utm_round_trip", f"WITH {_T} SELECT event_id, round(lat, 6) AS lat, round(lon, 6) AS lon FROM x")
def sc4(spark, sf):
    x, y = geo.to_utm(F.col("lon"), F.col("lat"))
    lon, lat = geo.from_utm(F.col("x"), F.col("y"))
    return sql(spark, sf, TRACKS).select("event_id", x.alias("x"), y.alias("y")).select("event_id", F.round(lat, 6).alias("lat"), F.round(lon, 6).alias("lon"))


#: The ellipsoid's constants for the projection, of third order: radius, three coefficients, eccentricity.
_UTM = """u AS (SELECT event_id, radians(lat) AS p, radians(lon - 81) AS d FROM x), v AS (SELECT event_id, d, sinh(asinh(tan(p)) - 0.08181919084262149e0 * atanh(0.08181919084262149e0 * sin(p))) AS t FROM u),
w AS (SELECT event_id, atan2(t, cos(d)) AS xi, asinh(sin(d) / sqrt(t * t + cos(d) * cos(d))) AS eta FROM v)
SELECT event_id, round(500000 + 0.9996e0 * 6367449.145823415e0 * (eta + 0.0008377318188192541 * cos(2 * xi) * sinh(2 * eta) + 7.608496958699166e-07 * cos(4 * xi) * sinh(4 * eta) + 1.2034877875966646e-09 * cos(6 * xi) * sinh(6 * eta)), 2) AS x,
 round(0.9996e0 * 6367449.145823415e0 * (xi + 0.0008377318188192541 * sin(2 * xi) * cosh(2 * eta) + 7.608496958699166e-07 * sin(4 * xi) * cosh(4 * eta) + 1.2034877875966646e-09 * sin(6 * xi) * cosh(6 * eta)), 2) AS y FROM w"""


@query("SC4_utm", f"WITH {_T}, {_UTM}")
def sc4_xy(spark, sf):
    x, y = geo.to_utm(F.col("lon"), F.col("lat"))
    return sql(spark, sf, TRACKS).select("event_id", F.round(x, 2).alias("x"), F.round(y, 2).alias("y"))


_FIX = "f AS (SELECT source, member_no, s, first(lat) AS lat, first(lon) AS lon, first(vmax_ms) AS v FROM x GROUP BY 1, 2, 3)"


@query(
    "J3_position_at",
    f"""WITH {_T}, q AS (SELECT DISTINCT source, member_no, 1705320000e0 AS q FROM x), {_FIX},
a AS (SELECT q.source, q.member_no, max(s) AS s0 FROM q JOIN f ON q.source = f.source AND q.member_no = f.member_no AND s <= q GROUP BY 1, 2),
b AS (SELECT q.source, q.member_no, min(s) AS s1 FROM q JOIN f ON q.source = f.source AND q.member_no = f.member_no AND s >= q GROUP BY 1, 2)
SELECT q.source, q.member_no, round(f0.lat + CASE WHEN s1 > s0 THEN (1705320000 - s0) / (s1 - s0) ELSE 0 END * (f1.lat - f0.lat), 6) AS lat, round(f0.lon + CASE WHEN s1 > s0 THEN (1705320000 - s0) / (s1 - s0) ELSE 0 END * (f1.lon - f0.lon), 6) AS lon
FROM q LEFT JOIN (a JOIN b ON a.source = b.source AND a.member_no = b.member_no JOIN f f0 ON f0.source = a.source AND f0.member_no = a.member_no AND f0.s = s0 JOIN f f1 ON f1.source = a.source AND f1.member_no = a.member_no AND f1.s = s1) ON q.source = a.source AND q.member_no = a.member_no""",
)
def j3(spark, sf):
    t = sql(spark, sf, TRACKS)
    ask = t.select("source", "member_no").distinct().withColumn("t_ref", F.timestamp_seconds(F.lit(1705320000)))
    return r6(series.positions_at(t, ask, ["source", "member_no"]).drop("t_ref"), "lat", "lon")


def _line(m: str) -> str:
    return f"round(CASE WHEN n < 2 THEN NULL WHEN s0 IS NULL THEN {m}1 WHEN s1 IS NULL THEN {m}0 WHEN s1 > s0 THEN {m}0 + (h * 3600 - s0) / (s1 - s0) * ({m}1 - {m}0) ELSE {m}0 END, 6) AS {m}"


@query(
    "W1_hourly_resampling",
    f"""WITH {_T}, f AS (SELECT source, member_no, s, first(lat) AS lat, first(vmax_ms) AS v FROM x GROUP BY 1, 2, 3),
g AS (SELECT source, member_no, count(*) AS n, unnest(range(CAST(ceil(min(s) / 3600) AS BIGINT), CAST(floor(max(s) / 3600) AS BIGINT) + 1)) AS h FROM f GROUP BY 1, 2),
z AS (SELECT g.source, g.member_no, g.h, any_value(n) AS n, max(s) FILTER (WHERE s <= h * 3600) AS s0, arg_max(lat, s) FILTER (WHERE s <= h * 3600) AS lat0, arg_max(v, s) FILTER (WHERE s <= h * 3600) AS v0,
 min(s) FILTER (WHERE s >= h * 3600) AS s1, arg_min(lat, s) FILTER (WHERE s >= h * 3600) AS lat1, arg_min(v, s) FILTER (WHERE s >= h * 3600) AS v1 FROM g JOIN f ON g.source = f.source AND g.member_no = f.member_no GROUP BY 1, 2, 3)
SELECT source, member_no, h AS hour, {_line("lat")}, {_line("v")} FROM z""",
)
def w1(spark, sf):
    t = sql(spark, sf, TRACKS)
    out = series.hourly(t, metrics=["lat", "vmax_ms"])
    return out.select("source", "member_no", (series.epoch("valid_utc") / 3600).cast("long").alias("hour"), F.round("lat", 6).alias("lat"), F.round("vmax_ms", 6).alias("v"))


#: Hourly tables made of events: hour of the day's grid, source, member.
_HOURLY = """SELECT event_type AS source, user_id AS member_no, date_trunc('hour', ts) AS valid_utc, 5e0 + avg(event_id % 997) / 1e2 AS lat, 80e0 + avg(event_id % 991) / 1e2 AS lon, avg(value) AS vmax_ms FROM events GROUP BY 1, 2, 3"""
_OFFICIAL = """SELECT date_trunc('hour', ts) AS valid_utc, 10e0 + avg(event_id % 97) / 1e2 AS lat, 84e0 + avg(event_id % 91) / 1e2 AS lon, avg(value) AS vmax_ms FROM events WHERE user_id % 7 = 0 AND ts < TIMESTAMP '2024-01-20 00:00:00' GROUP BY 1"""
_REF = f"m AS ({_HOURLY}), o AS ({_OFFICIAL}), k AS (SELECT source, valid_utc, avg(lat) AS mlat, avg(lon) AS mlon, quantile_cont(vmax_ms, 0.5) AS mv FROM m GROUP BY 1, 2)"


@query("AG6_source_reference", f"WITH {_REF} SELECT source, CAST(epoch(valid_utc) AS BIGINT) AS s, round(mlat, 6) AS mean_lat, round(mlon, 6) AS mean_lon, round(mv, 6) AS median_v FROM k")
def ag6(spark, sf):
    out = series.source_reference(sql(spark, sf, _HOURLY))
    return out.select("source", series.epoch("valid_utc").cast("long").alias("s"), F.round("mean_lat", 6).alias("mean_lat"), F.round("mean_lon", 6).alias("mean_lon"), F.round("median_v", 6).alias("median_v"))


_ALIGN = f"""{_REF}, c AS (SELECT source, k.valid_utc, o.lat - mlat AS dlat, o.lon - mlon AS dlon, coalesce(o.vmax_ms / nullif(mv, 0), 1.0) AS vs FROM k JOIN o ON k.valid_utc = o.valid_utc),
l AS (SELECT source, max(valid_utc) AS t, arg_max(dlat, valid_utc) AS dlat, arg_max(dlon, valid_utc) AS dlon, arg_max(vs, valid_utc) AS vs FROM c GROUP BY source),
z AS (SELECT m.*, l.*, c.dlat AS cdlat, c.dlon AS cdlon, c.vs AS cvs, l.dlat AS ldlat, l.dlon AS ldlon, l.vs AS lvs, CASE WHEN m.valid_utc > l.t THEN greatest(0, 1 - (epoch(m.valid_utc) - epoch(l.t)) / 3600 / 24) ELSE 0 END AS fade
 FROM m LEFT JOIN c ON m.source = c.source AND m.valid_utc = c.valid_utc LEFT JOIN l ON m.source = l.source),
a AS (SELECT source, member_no, valid_utc, lat + coalesce(cdlat, ldlat * fade, 0) AS lat, lon + coalesce(cdlon, ldlon * fade, 0) AS lon, vmax_ms * coalesce(cvs, 1 + (lvs - 1) * fade, 1) AS v FROM z)"""


@query("W2_alignment", f"WITH {_ALIGN} SELECT source, member_no, CAST(epoch(valid_utc) AS BIGINT) AS s, round(lat, 6) AS lat, round(lon, 6) AS lon, round(v, 6) AS v FROM a")
def w2(spark, sf):
    out = series.align(sql(spark, sf, _HOURLY), sql(spark, sf, _OFFICIAL))
    return out.select("source", "member_no", series.epoch("valid_utc").cast("long").alias("s"), F.round("lat", 6).alias("lat"), F.round("lon", 6).alias("lon"), F.round("vmax_ms", 6).alias("v"))


@query("AG28_alignment_report", f"""WITH {_ALIGN}, b AS (SELECT z.source, z.valid_utc, z.lat + cdlat AS lat, cdlat, cdlon, cvs FROM z WHERE valid_utc IN (SELECT valid_utc FROM o)), d AS (SELECT DISTINCT source, valid_utc, cvs FROM b)
SELECT b.source, count(DISTINCT b.valid_utc) AS hours, round(max(sqrt(pow(cdlat * 111.195, 2) + pow(cdlon * 111.195 * cos(radians(lat)), 2))), 5) AS max_shift_km, round(any_value(q.m), 6) AS median_vscale FROM b JOIN (SELECT source, quantile_cont(cvs, 0.5) AS m FROM d GROUP BY 1) q ON q.source = b.source GROUP BY b.source""")
def ag28(spark, sf):
    official = sql(spark, sf, _OFFICIAL)
    out = series.alignment_report(series.align(sql(spark, sf, _HOURLY), official), official)
    return out.select("source", "hours", F.round("max_shift_km", 5).alias("max_shift_km"), F.round("median_vscale", 6).alias("median_vscale"))


@query("AG7_members_per_source", "SELECT event_type AS source, count(DISTINCT user_id) AS members FROM events GROUP BY 1")
def ag7(spark, sf):
    return sql(spark, sf, TRACKS).groupBy("source").agg(F.countDistinct("member_no").alias("members"))


@query("T3_first_members", "WITH d AS (SELECT event_id, dense_rank() OVER (PARTITION BY event_type ORDER BY user_id) AS r FROM events) SELECT event_id FROM d WHERE r <= 20")
def t3(spark, sf):
    return series.first_members(sql(spark, sf, TRACKS), 20).select("event_id")


@query("SC28_horizon_filter", "SELECT event_id FROM events WHERE ts >= TIMESTAMP '2024-01-10 00:00:00' AND ts <= TIMESTAMP '2024-01-10 00:00:00' + INTERVAL 60 HOUR")
def sc28(spark, sf):
    now = F.to_timestamp(F.lit("2024-01-10 00:00:00"))
    h = (series.epoch("valid_utc") - series.epoch(now)) / 3600
    return sql(spark, sf, TRACKS).filter((h >= 0) & (h <= 36 + 24)).select("event_id")


def _k(c: str) -> str:
    h0, h1 = "(h - lag(h) OVER w)", "(lead(h) OVER w - h)"
    d0, d1 = f"({c} - lag({c}) OVER w)", f"(lead({c}) OVER w - {c})"
    return f"coalesce(CASE WHEN {h0} IS NOT NULL AND {h1} IS NOT NULL THEN ({h0} * {h0} * {d1} + {h1} * {h1} * {d0}) / ({h0} * {h1} * ({h0} + {h1})) WHEN {h1} IS NOT NULL THEN {d1} / {h1} WHEN {h0} IS NOT NULL THEN {d0} / {h0} END, 0)"


@query(
    "W4_translation_velocity",
    f"""WITH {_T}, y AS (SELECT source, member_no, event_id, lat, lon, (s - 1704067200) / 3600 AS h FROM x)
SELECT event_id, round({_k("lon")} * 111194.9 / 3600 * cos(radians(lat)), 5) AS u, round({_k("lat")} * 111194.9 / 3600, 5) AS v FROM y WINDOW w AS (PARTITION BY source, member_no ORDER BY h)""",
)
def w4(spark, sf):
    t = sql(spark, sf, TRACKS).withColumn("hour", (series.epoch("valid_utc") - 1704067200) / 3600)
    return series.translation_velocity(t).select("event_id", F.round("u", 5).alias("u"), F.round("v", 5).alias("v"))


@query(
    "W5_fix_speeds",
    f"""WITH {_T}, y AS (SELECT source, event_id AS seq, lat, lon, (s - 1704067200) / 3600 AS h FROM x), z AS (SELECT source, {hav("lag(lat) OVER w", "lag(lon) OVER w", "lat", "lon")} / nullif(abs(h - lag(h) OVER w), 0) AS v, coalesce(h > lag(h) OVER w, true) AS up FROM y WINDOW w AS (PARTITION BY source ORDER BY seq))
SELECT source, round(max(v), 3) AS max_kmh, bool_and(up) AS monotone FROM z GROUP BY source""",
)
def w5(spark, sf):
    t = sql(spark, sf, TRACKS).withColumn("lead_h", (series.epoch("valid_utc") - 1704067200) / 3600).withColumn("seq", F.col("event_id"))
    return series.fix_speeds(t, ["source"]).withColumn("max_kmh", F.round("max_kmh", 3))


@query(
    "AG9_closest_approach",
    f"WITH {_T}, p AS (SELECT n_nationkey AS place, 5e0 + n_nationkey / 2.5 AS plat, 80e0 + n_nationkey / 2.5 AS plon FROM nation) SELECT source, member_no, place, round(min({hav('lat', 'lon', 'plat', 'plon')}), 6) AS km FROM x, p GROUP BY 1, 2, 3",
)
def ag9(spark, sf):
    places = sql(spark, sf, "SELECT n_nationkey AS place, 5e0 + n_nationkey / 2.5e0 AS lat, 80e0 + n_nationkey / 2.5e0 AS lon FROM nation")
    return r6(series.closest_approach(sql(spark, sf, TRACKS), places, ["source", "member_no"]), "km")


@query(
    "J4_match_members",
    f"""WITH {_T}, o AS (SELECT epoch_us(valid_utc) / 1e6 AS s, lat, lon FROM ({_OFFICIAL})), o0 AS (SELECT min(s) AS s FROM o),
st AS (SELECT source, member_no, storm_id, greatest(min(x.s), any_value(o0.s)) AS q FROM x, o0 GROUP BY 1, 2, 3),
f AS (SELECT source, member_no, storm_id, s, first(lat) AS lat, first(lon) AS lon FROM x GROUP BY 1, 2, 3, 4),
a AS (SELECT st.source, st.member_no, st.storm_id, q, max(s) FILTER (WHERE s <= q) AS s0, min(s) FILTER (WHERE s >= q) AS s1, arg_max(lat, s) FILTER (WHERE s <= q) AS la0, arg_max(lon, s) FILTER (WHERE s <= q) AS lo0, arg_min(lat, s) FILTER (WHERE s >= q) AS la1, arg_min(lon, s) FILTER (WHERE s >= q) AS lo1
 FROM st JOIN f ON st.source = f.source AND st.member_no = f.member_no AND st.storm_id = f.storm_id GROUP BY 1, 2, 3, 4),
b AS (SELECT a.source, a.member_no, a.storm_id, max(o.s) FILTER (WHERE o.s <= q) AS t0, min(o.s) FILTER (WHERE o.s >= q) AS t1, arg_max(lat, o.s) FILTER (WHERE o.s <= q) AS oa0, arg_max(lon, o.s) FILTER (WHERE o.s <= q) AS oo0, arg_min(lat, o.s) FILTER (WHERE o.s >= q) AS oa1, arg_min(lon, o.s) FILTER (WHERE o.s >= q) AS oo1 FROM a, o GROUP BY 1, 2, 3),
p AS (SELECT a.source, a.member_no, a.storm_id, la0 + CASE WHEN s1 > s0 THEN (q - s0) / (s1 - s0) ELSE 0 END * (la1 - la0) AS lat, lo0 + CASE WHEN s1 > s0 THEN (q - s0) / (s1 - s0) ELSE 0 END * (lo1 - lo0) AS lon,
 oa0 + CASE WHEN t1 > t0 THEN (q - t0) / (t1 - t0) ELSE 0 END * (oa1 - oa0) AS olat, oo0 + CASE WHEN t1 > t0 THEN (q - t0) / (t1 - t0) ELSE 0 END * (oo1 - oo0) AS olon FROM a JOIN b ON a.source = b.source AND a.member_no = b.member_no AND a.storm_id = b.storm_id),
d AS (SELECT *, {hav("lat", "lon", "olat", "olon")} AS km FROM p), r AS (SELECT *, row_number() OVER (PARTITION BY source, member_no ORDER BY km, storm_id) AS k FROM d WHERE km <= 300)
SELECT x.event_id FROM x JOIN r ON x.source = r.source AND x.member_no = r.member_no AND x.storm_id = r.storm_id AND r.k = 1""",
)
def j4(spark, sf):
    return series.match_members(sql(spark, sf, TRACKS), sql(spark, sf, _OFFICIAL)).select("event_id")


@query(
    "SRC2_normalise_tracks",
    """SELECT event_id, round(5e0 + (event_id % 997) / 1e2, 6) AS lat, round(value / 100, 6) AS pmin_hpa, CAST(floor(epoch(ts) + (event_id % 48) * 3600) AS BIGINT) AS s FROM events WHERE event_id % 13 <> 0""",
)
def src2(spark, sf):
    raw = sql(spark, sf, "SELECT event_id, ts AS init_utc, CASE WHEN event_id % 13 = 0 THEN 1e20 ELSE 5e0 + (event_id % 997) / 1e2 END AS lat, 80e0 AS lon, value AS vmax_ms, value AS pmin_pa, CAST(event_id % 48 AS DOUBLE) AS lead_h FROM events")
    return series.normalise_tracks(raw).select("event_id", F.round("lat", 6).alias("lat"), F.round("pmin_hpa", 6).alias("pmin_hpa"), F.floor(series.epoch("valid_utc")).cast("long").alias("s"))


@query("SRC4_latest_runs", "WITH f AS (SELECT event_type AS source, date_trunc('hour', ts) AS t FROM events), k AS (SELECT source, max(t) AS t FROM f WHERE t + INTERVAL 6 HOUR <= TIMESTAMP '2024-01-15 12:00:00' GROUP BY source) SELECT source, strftime(t, 'run_%Y%m%dT%H.csv') AS file_name FROM k")
def src4(spark, sf):
    files = sql(spark, sf, "SELECT DISTINCT event_type AS source, ts FROM events").select("source", F.date_format("ts", "'run_'yyyyMMdd'T'HH'.csv'").alias("file_name")).distinct()
    types = ["click", "view", "purchase", "signup", "error", "login", "logout", "scroll"]
    delays = {t: 6.0 for t in types} | {r["source"]: 6.0 for r in files.select("source").distinct().collect()}
    return series.latest_runs(files, F.to_timestamp(F.lit("2024-01-15 12:00:00")), delays).select("source", "file_name")


@query("SRC3_official_track", "SELECT user_id AS bulletin_id, round((value + value + 10) / 2 * 1852 / 3600, 5) AS vmax_ms, (epoch_us(ts) - min(epoch_us(ts)) OVER (PARTITION BY user_id)) // 60000000 AS lead_min FROM events")
def src3(spark, sf):
    e = sql(spark, sf, "SELECT user_id AS bulletin_id, ts, value FROM events")
    item = F.struct(F.col("ts").alias("valid_utc"), F.lit(16.0).alias("lat"), F.lit(82.0).alias("lon"), F.col("value").alias("wind_min"), (F.col("value") + 10).alias("wind_max"), F.lit("kt").alias("unit"))
    reading = e.groupBy("bulletin_id").agg(F.sort_array(F.collect_list(item)).alias("forecast"))
    return series.official_track(reading).select("bulletin_id", F.round("vmax_ms", 5).alias("vmax_ms"), F.expr("lead_us div 60000000").alias("lead_min"))


@query("SRC5_prefix_scan", "SELECT DISTINCT p_brand AS track_id FROM part WHERE p_brand LIKE 'Brand#1%'")
def src5(spark, sf):
    return sql(spark, sf, "SELECT p_brand FROM part").filter(F.col("p_brand").startswith("Brand#1")).select(F.col("p_brand").alias("track_id")).distinct()


