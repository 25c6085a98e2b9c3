"""Text operators over documents, conversations, benchmark, pages and keys."""

from __future__ import annotations

from pyspark.sql import functions as F

from cutoffs.functions import text as T
from cutoffs.registry import query, sql


@query("F1_normalise", "SELECT doc_id, trim(regexp_replace(lower(text), '[^a-z]+', ' ', 'g')) AS t, trim(regexp_replace(lower(text), '[^a-z0-9.]+', ' ', 'g')) AS n FROM documents")
def f1(spark, sf):
    return sql(spark, sf, "SELECT doc_id, text FROM documents").select("doc_id", T.letters_only(F.col("text")).alias("t"), T.letters_digits(F.col("text")).alias("n"))


_A, _Z = "CAST(4 + o_orderkey % 9 AS VARCHAR(2))", "CAST(14 + o_orderkey % 7 AS VARCHAR(2))"
_PHRASE = f"SELECT o_orderkey, CASE o_orderkey % 6 WHEN 0 THEN {_A} || 'th to ' || {_Z} || 'th October' WHEN 1 THEN {_Z} || 'th & ' || {_A} || 'th' WHEN 2 THEN {_A} || 'th November' WHEN 3 THEN {_A} || ' & ' || {_Z} || ' October' WHEN 4 THEN {_A} || '-' || {_Z} || ' Nov or December' ELSE 'next week' END AS t FROM orders"


@query("F2_parse_days", """WITH t AS (SELECT o_orderkey, o_orderkey % 6 AS k, CAST(4 + o_orderkey % 9 AS BIGINT) AS a, CAST(14 + o_orderkey % 7 AS BIGINT) AS z FROM orders)
SELECT o_orderkey, CASE k WHEN 0 THEN z - a + 1 WHEN 4 THEN z - a + 1 WHEN 1 THEN 2 WHEN 3 THEN 2 WHEN 2 THEN 1 ELSE 0 END AS n, CASE k WHEN 2 THEN '2025-11-' WHEN 4 THEN '2025-12-' WHEN 5 THEN NULL ELSE '2025-10-' END || lpad(CAST(CASE k WHEN 1 THEN z ELSE a END AS VARCHAR), 2, '0') AS first,
CASE k WHEN 2 THEN '2025-11-' WHEN 4 THEN '2025-12-' WHEN 5 THEN NULL ELSE '2025-10-' END || lpad(CAST(CASE WHEN k IN (1, 2) THEN a ELSE z END AS VARCHAR), 2, '0') AS last FROM t""")
def f2(spark, sf):
    d = sql(spark, sf, _PHRASE).select("o_orderkey", T.parse_days(F.col("t"), 2025, 10).alias("d"))
    return d.select("o_orderkey", F.size("d").cast("long").alias("n"), F.get("d", F.lit(0)).cast("string").alias("first"), F.get("d", F.size("d") - 1).cast("string").alias("last"))


_BUL = """SELECT o_orderkey AS text_id, 'Forecast 27.10.25/1130 ' || CAST(10 + o_orderkey % 9 AS VARCHAR(2)) || '.5/83.2 ' || CAST(60 + o_orderkey % 9 AS VARCHAR(2)) || '-80 gusting to 90 ' || CASE o_orderkey % 3 WHEN 0 THEN 'Cyclonic Storm' WHEN 1 THEN 'Severe Cyclonic Storm' ELSE 'Deep Depression' END || '. 27.10.25/1730 15.0/82.9 80-90 gusting to 100 Depression' AS text FROM orders"""


@query("F3_bulletin_rows", """SELECT o_orderkey AS text_id, 0 AS seq, CAST(epoch(TIMESTAMP '2025-10-27 06:00:00') AS BIGINT) AS s, 10 + o_orderkey % 9 + 0.5e0 AS lat, CAST(60 + o_orderkey % 9 AS INTEGER) AS wind_lo, CASE o_orderkey % 3 WHEN 0 THEN 'CS' WHEN 1 THEN 'SCS' ELSE 'DD' END AS category FROM orders
UNION ALL SELECT o_orderkey, 1, CAST(epoch(TIMESTAMP '2025-10-27 12:00:00') AS BIGINT), 15e0, 80, 'D' FROM orders""")
def f3(spark, sf):
    out = T.bulletin_rows(sql(spark, sf, _BUL))
    return out.select("text_id", "seq", F.unix_seconds("valid_utc").alias("s"), "lat", "wind_lo", "category")


@query("F4_category_code", "SELECT p_partkey, CASE WHEN p_partkey % 4 = 0 THEN 'SCS' WHEN p_partkey % 4 = 1 THEN 'CS' WHEN p_partkey % 4 = 2 THEN 'D' END AS code FROM part")
def f4(spark, sf):
    p = sql(spark, sf, "SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN 'A Severe Cyclonic Storm near' WHEN 1 THEN 'cyclonic storm' WHEN 2 THEN 'Depression' ELSE p_name END AS t FROM part")
    return p.select("p_partkey", T.category_code(F.col("t")).alias("code"))


#: Sites by the supplier's number: names and tags of each kind.
_SITES = [
    ({"name": "Government General Hospital", "amenity": "hospital"}, "district_hospital", "high", None),
    ({"name": "GGH Annexe"}, "district_hospital", "medium", None),
    ({"name": "Area  Hospital Tuni", "healthcare": "hospital"}, "sdh_area_hospital", "high", None),
    ({"name": "Seva", "name:en": "Sub-Divisional Hospital"}, "sdh_area_hospital", "medium", None),
    ({"name": "C.H.C. Road", "amenity": "clinic"}, "chc", "high", None),
    ({"name": "UPHC North", "healthcare": "centre"}, "phc", "high", None),
    ({"official_name": "Village Health Clinic", "amenity": "doctors"}, "sub_centre", "medium", None),
    ({"name": "City Care", "amenity": "hospital"}, "hospital_other", "low", None),
    ({"name": "Corner clinic", "amenity": "clinic"}, None, None, None),
    ({"name": "MPCS Uppada"}, "shelter", "medium", None),
    ({"amenity": "shelter", "shelter_type": "gazebo"}, None, None, None),
    ({"amenity": "shelter"}, "shelter", "medium", None),
    ({"power": "substation", "voltage": "33000;132000"}, None, None, 132.0),
    ({"power": "substation", "voltage": "high"}, None, None, None),
    ({"shop": "yes"}, None, None, None),
]
_SQL_SITES = "VALUES (0, 'district_hospital', 'high', 'Government General Hospital'), (1, 'district_hospital', 'medium', 'GGH Annexe'), (2, 'sdh_area_hospital', 'high', 'Area  Hospital Tuni'), (3, 'sdh_area_hospital', 'medium', 'Seva'), (4, 'chc', 'high', 'C.H.C. Road'), (5, 'phc', 'high', 'UPHC North'), (6, 'sub_centre', 'medium', 'sub centre'), (7, 'hospital_other', 'low', 'City Care'), (9, 'shelter', 'medium', 'MPCS Uppada'), (11, 'shelter', 'medium', 'shelter')"


def sites(spark, sf):
    tags = F.lit(None).cast("map<string,string>")
    for k, (t, *_) in enumerate(_SITES):
        tags = F.when(F.col("s_suppkey") % len(_SITES) == k, F.create_map(*[F.lit(x) for kv in t.items() for x in kv])).otherwise(tags)
    return sql(spark, sf, "SELECT s_suppkey FROM supplier").withColumn("tags", tags)


@query("F5_health_tier", f"SELECT s_suppkey, tier, confidence FROM supplier LEFT JOIN ({_SQL_SITES}) AS k(k, tier, confidence, name) ON k = s_suppkey % 15 AND tier <> 'shelter'")
def f5(spark, sf):
    return sites(spark, sf).select("s_suppkey", T.health_tier(F.col("tags")).alias("h")).select("s_suppkey", "h.tier", "h.confidence")


@query("F6_classify_pois", f"SELECT 'osm_n' || s_suppkey AS poi_id, 'facility' AS kind, tier AS type, name, confidence, CAST(NULL AS DOUBLE) AS voltage_kv FROM supplier JOIN ({_SQL_SITES}) AS k(k, tier, confidence, name) ON k = s_suppkey % 15 UNION ALL SELECT 'osm_n' || s_suppkey, 'substation', NULL, NULL, NULL, CASE WHEN s_suppkey % 15 = 12 THEN 132e0 END FROM supplier WHERE s_suppkey % 15 IN (12, 13)")
def f6(spark, sf):
    return T.classify_pois(sites(spark, sf).select(F.lit("node").alias("osm_type"), F.col("s_suppkey").alias("osm_id"), "tags"))


@query("F7_voltage", "SELECT p_partkey, CASE WHEN p_partkey % 3 = 0 THEN greatest(132000, 33000 + p_size) / 1000e0 WHEN p_partkey % 3 = 1 THEN p_size / 1000e0 END AS kv FROM part")
def f7(spark, sf):
    p = sql(spark, sf, "SELECT p_partkey, CASE p_partkey % 3 WHEN 0 THEN '132000;' || CAST(33000 + p_size AS VARCHAR(9)) WHEN 1 THEN CAST(p_size AS VARCHAR(9)) ELSE 'unknown' END AS v FROM part")
    return p.select("p_partkey", T.max_voltage_kv(F.col("v")).alias("kv"))


@query("F8_referral_targets", "SELECT s_suppkey, unnest(CASE s_suppkey % 5 WHEN 0 THEN ['chc', 'sdh_area_hospital', 'district_hospital'] WHEN 1 THEN ['sdh_area_hospital', 'district_hospital'] WHEN 2 THEN ['district_hospital'] ELSE [] END) AS target_tier FROM supplier")
def f8(spark, sf):
    s = sql(spark, sf, "SELECT s_suppkey, CASE s_suppkey % 5 WHEN 0 THEN 'phc' WHEN 1 THEN 'chc' WHEN 2 THEN 'sdh_area_hospital' WHEN 3 THEN 'district_hospital' ELSE 'hospital_other' END AS tier FROM supplier")
    return T.referral_targets(s).select("s_suppkey", "target_tier")


_GROUP = "CASE WHEN n >= 10000000 THEN format('{{}},{{:02d}},{{:02d}},{{:03d}}', n // 10000000, n // 100000 % 100, n // 1000 % 100, n % 1000) WHEN n >= 100000 THEN format('{{}},{{:02d}},{{:03d}}', n // 100000, n // 1000 % 100, n % 1000) WHEN n >= 1000 THEN format('{{}},{{:03d}}', n // 1000, n % 1000) ELSE CAST(n AS VARCHAR) END".replace("{{", "{").replace("}}", "}")


@query("F9_formatting", f"WITH t AS (SELECT o_orderkey, o_orderkey * 37 % 12345678 AS n, (o_orderkey % 1000) / 1e3 AS p FROM orders) SELECT o_orderkey, {_GROUP} AS grouped, CASE WHEN p < 0.005 THEN '<1%' WHEN p > 0.995 THEN '>99%' ELSE CAST(CAST(round_even(p * 100, 0) AS BIGINT) AS VARCHAR) || '%' END AS prob FROM t")
def f9(spark, sf):
    t = sql(spark, sf, "SELECT o_orderkey, o_orderkey * 37 % 12345678 AS n, (o_orderkey % 1000) / 1e3 AS p FROM orders")
    return t.select("o_orderkey", T.indian_group(F.col("n")).alias("grouped"), T.probability(F.col("p")).alias("prob"))


@query("F9_people", """WITH t AS (SELECT o_orderkey, o_orderkey * 37 % 990001 - 5 AS n FROM orders), u AS (SELECT o_orderkey, greatest(n, 0) AS n, CAST(CASE WHEN n >= 1000 THEN round_even(n / 100e0, 0) * 100 WHEN n >= 10 THEN round_even(n / 10e0, 0) * 10 ELSE greatest(n, 0) END AS BIGINT) AS k FROM t)
SELECT o_orderkey, CASE WHEN n >= 100000 THEN format('{:.1f}', n / 1e5) || ' lakh' WHEN k >= 100000 THEN format('{},{:02d},{:03d}', k // 100000, k // 1000 % 100, k % 1000) WHEN k >= 1000 THEN format('{},{:03d}', k // 1000, k % 1000) ELSE CAST(k AS VARCHAR) END AS people FROM u""")
def f9_people(spark, sf):
    return sql(spark, sf, "SELECT o_orderkey, o_orderkey * 37 % 990001 - 5 AS n FROM orders").select("o_orderkey", T.people(F.col("n")).alias("people"))


@query("F10_ist_times", "SELECT event_id, strftime(ts + INTERVAL 330 MINUTE, '%H:%M') || ' IST' AS t, strftime(ts + INTERVAL 330 MINUTE, '%-d %B') AS d, strftime(ts + INTERVAL 330 MINUTE, '%Y-%m-%dT%H:%M:%S') || '+05:30' AS cap FROM events")
def f10(spark, sf):
    e = sql(spark, sf, "SELECT event_id, CAST(ts AS TIMESTAMP) AS ts FROM events")
    return e.select("event_id", T.ist_time(F.col("ts")).alias("t"), T.ist_date(F.col("ts")).alias("d"), T.cap_time(F.col("ts")).alias("cap"))


#: Months of three languages, one list after the other.
_MONTHS = "['Jan', 'Feb', 'Mar', 'Apr', 'May', 'Jun', 'Jul', 'Aug', 'Sep', 'Oct', 'Nov', 'Dec', 'జనవరి', 'ఫిబ్రవరి', 'మార్చి', 'ఏప్రిల్', 'మే', 'జూన్', 'జూలై', 'ఆగస్టు', 'సెప్టెంబర్', 'అక్టోబర్', 'నవంబర్', 'డిసెంబర్', 'जनवरी', 'फ़रवरी', 'मार्च', 'अप्रैल', 'मई', 'जून', 'जुलाई', 'अगस्त', 'सितंबर', 'अक्टूबर', 'नवंबर', 'दिसंबर']"


@query("F10_local_times", f"""WITH t AS (SELECT o_orderkey, CAST(o_orderdate AS TIMESTAMP) + INTERVAL 1 MINUTE * (o_orderkey % 1440) + INTERVAL 330 MINUTE AS t FROM orders),
u AS (SELECT o_orderkey, t, {_MONTHS} AS m FROM t) SELECT o_orderkey, day(t) || ' ' || m[month(t)] || ', ' || strftime(t, '%H:%M') || ' IST' AS en, day(t) || ' ' || m[12 + month(t)] || ', ' || strftime(t, '%H:%M') || ' IST' AS te, day(t) || ' ' || m[24 + month(t)] || ' ' || year(t) || ', ' || strftime(t, '%H:%M') || ' IST' AS hi FROM u""")
def f10_local(spark, sf):
    o = sql(spark, sf, "SELECT o_orderkey, CAST(o_orderdate AS TIMESTAMP) AS d FROM orders")
    at = F.timestamp_seconds(F.unix_seconds("d") + F.col("o_orderkey") % 1440 * 60)
    return o.select("o_orderkey", T.local_time(at, "en-IN").alias("en"), T.local_time(at, "te-IN").alias("te"), T.local_time(at, "hi-IN", True).alias("hi"))


@query("F11_labels", """SELECT s_suppkey, CASE s_suppkey % 3 WHEN 0 THEN 'PHC ' || n_name WHEN 1 THEN n_name || ', East' ELSE 'PHC' END || CASE WHEN s_suppkey % 4 = 0 THEN ' (SIMULATED)' ELSE '' END AS en,
 CASE s_suppkey % 3 WHEN 0 THEN 'PHC ' || n_name WHEN 1 THEN n_name || ', East' ELSE 'प्राथमिक स्वास्थ्य केंद्र (PHC)' END || ' – प्राथमिक स्वास्थ्य केंद्र (PHC)' || CASE WHEN s_suppkey % 4 = 0 THEN ' (SIMULATED)' ELSE '' END AS hi FROM supplier JOIN nation ON s_nationkey = n_nationkey""")
def f11(spark, sf):
    s = sql(spark, sf, "SELECT s_suppkey, CASE s_suppkey % 3 WHEN 0 THEN ' PHC,' || n_name WHEN 1 THEN n_name || ',East' END AS name FROM supplier JOIN nation ON s_nationkey = n_nationkey")
    args = (F.lit("phc"), F.col("name"), F.col("s_suppkey") % 4 == 0)
    return s.select("s_suppkey", T.facility_label(*args).alias("en"), T.facility_label(*args, "hi-IN").alias("hi"))


@query("F11_site_labels", """WITH t AS (SELECT s_suppkey, CASE WHEN s_suppkey % 2 = 0 THEN n_name END AS near, CASE WHEN s_suppkey % 3 = 0 THEN 'NH ' || s_nationkey END AS road, s_suppkey % 5 AS k FROM supplier JOIN nation ON s_nationkey = n_nationkey),
u AS (SELECT *, CASE k WHEN 0 THEN 'bridge' WHEN 1 THEN 'culvert' WHEN 2 THEN 'causeway' ELSE 'road' END AS en, CASE k WHEN 0 THEN 'వంతెన' WHEN 1 THEN 'కల్వర్టు' WHEN 2 THEN 'కాజ్‌వే' ELSE 'రహదారి' END AS te FROM t)
SELECT s_suppkey, en || coalesce(' near ' || near, '') || coalesce(' on ' || road, '') AS en, coalesce(lower(near) || ' సమీపంలోని ', '') || te || coalesce(' (' || road || ')', '') AS te FROM u""")
def f11_sites(spark, sf):
    s = sql(spark, sf, "SELECT s_suppkey, CASE WHEN s_suppkey % 2 = 0 THEN n_name END AS near, CASE WHEN s_suppkey % 3 = 0 THEN concat('NH ', s_nationkey) END AS road, CASE s_suppkey % 5 WHEN 0 THEN 'bridge' WHEN 1 THEN 'culvert' WHEN 2 THEN 'ford' WHEN 3 THEN 'none' END AS kind FROM supplier JOIN nation ON s_nationkey = n_nationkey")
    args = (F.col("kind"), F.col("road"), F.col("near"), F.lower("near"))
    return s.select("s_suppkey", T.site_label(*args).alias("en"), T.site_label(*args, "te-IN").alias("te"))


@query("F12_slug", "SELECT p_partkey, regexp_replace(lower(p_name || '_' || p_brand), '[^a-z0-9_]+', '_', 'g') AS slug FROM part")
def f12(spark, sf):
    return sql(spark, sf, "SELECT p_partkey, p_name, p_brand FROM part").select("p_partkey", T.slug(F.col("p_name"), F.col("p_brand")).alias("slug"))


@query("F13_content_key", "SELECT p_partkey, sha256('{\"p_brand\":\"' || p_brand || '\",\"p_size\":' || p_size || '}') AS k FROM part")
def f13(spark, sf):
    return sql(spark, sf, "SELECT p_partkey, p_brand, p_size FROM part").select("p_partkey", T.content_key(F.col("p_brand"), F.col("p_size")).alias("k"))


@query("F14_base64", "SELECT p_partkey, to_base64(encode(CAST(p_partkey AS VARCHAR))) AS b, 'id=' || p_partkey || '&size=' || p_size AS q FROM part")
def f14(spark, sf):
    p = sql(spark, sf, "SELECT p_partkey, p_size FROM part")
    return p.select("p_partkey", F.base64(F.col("p_partkey").cast("string").cast("binary")).alias("b"), F.concat(F.lit("id="), F.col("p_partkey"), F.lit("&size="), F.col("p_size")).alias("q"))


@query("F15_plain_code", "SELECT p_partkey, CASE p_partkey % 3 WHEN 0 THEN CAST(p_size AS VARCHAR) WHEN 1 THEN 'x' || p_size ELSE '' END AS code FROM part")
def f15(spark, sf):
    p = sql(spark, sf, "SELECT p_partkey, CASE p_partkey % 3 WHEN 0 THEN CAST(p_size AS VARCHAR(5)) || '.0' WHEN 1 THEN 'x' || CAST(p_size AS VARCHAR(5)) END AS c FROM part")
    return p.select("p_partkey", T.plain_code(F.col("c")).alias("code"))


#: Spelled out here, so that the library's list is checked and not repeated.
_NUM = "(?i)\\b(zero|two|three|four|five|six|seven|eight|nine|ten|eleven|twelve|thirteen|fourteen|fifteen|sixteen|seventeen|eighteen|nineteen|twenty|thirty|forty|fifty|sixty|seventy|eighty|ninety|hundreds?|thousands?|lakhs?|crores?|millions?|billions?|percent|per\\s+cent|dozens?|half)\\b"


@query("F16_number_words", f"""WITH t AS (SELECT p_partkey, CASE p_partkey % 8 WHEN 0 THEN 'thirteen people' WHEN 1 THEN 'half the town' WHEN 2 THEN 'a dozen roads' WHEN 3 THEN 'zero risk' WHEN 4 THEN 'per  cent of it' WHEN 5 THEN 'no one often' WHEN 6 THEN 'Billions of ' || p_name ELSE p_name END AS t FROM part)
SELECT p_partkey, concat_ws('; ', CASE WHEN regexp_matches(t, '{_NUM}') THEN 'number word' END) AS problems FROM t""")
def f16_words(spark, sf):
    p = sql(spark, sf, "SELECT p_partkey, CASE p_partkey % 8 WHEN 0 THEN 'thirteen people' WHEN 1 THEN 'half the town' WHEN 2 THEN 'a dozen roads' WHEN 3 THEN 'zero risk' WHEN 4 THEN 'per  cent of it' WHEN 5 THEN 'no one often' WHEN 6 THEN 'Billions of ' || p_name ELSE p_name END AS t FROM part")
    none = F.array().cast("array<string>")
    return p.select("p_partkey", F.array_join(T.number_problems(F.col("t"), none, none), "; ").alias("problems"))


@query("F16_number_safety", f"SELECT doc_id, concat_ws('; ', CASE WHEN regexp_matches(text, '\\p{{Nd}}') THEN 'digit' END, CASE WHEN regexp_matches(text, '{_NUM}') THEN 'number word' END, CASE WHEN contains(text, '%') THEN 'percent sign' END, CASE WHEN contains(text, '{{{{') OR contains(text, '}}}}') THEN 'malformed placeholder' END, 'missing: people') AS problems FROM documents")
def f16(spark, sf):
    p = T.number_problems(F.col("text"), F.array(F.lit("people")), F.array(F.lit("people")))
    return sql(spark, sf, "SELECT doc_id, text FROM documents").select("doc_id", F.array_join(p, "; ").alias("problems"))


@query("F17_render", "SELECT c_custkey, CASE WHEN c_custkey % 4 = 0 THEN 'unknown: nosuch' WHEN c_custkey % 4 = 1 THEN 'digit outside facts' END AS error, CASE WHEN c_custkey % 4 >= 2 THEN 'About ' || c_nationkey || ' people in ' || c_name || ' are cut off.' END AS text FROM customer")
def f17(spark, sf):
    c = sql(spark, sf, "SELECT c_custkey, c_name, c_nationkey, CASE c_custkey % 4 WHEN 0 THEN 'About {{nosuch}} people' WHEN 1 THEN 'About 5 people in {{place}}' ELSE 'About {{people}} people in {{ place }} are cut off.' END AS t FROM customer")
    facts = F.create_map(F.lit("people"), F.col("c_nationkey").cast("string"), F.lit("place"), F.col("c_name"))
    return c.select("c_custkey", T.render(F.col("t"), facts).alias("r")).select("c_custkey", "r.error", "r.text")


@query("F18_draft_constraints", "SELECT item_id, concat_ws('; ', CASE WHEN len(list_filter(regexp_split_to_array(text, '\\s+'), lambda x: x <> '')) > 90 THEN 'voice too long' END, CASE WHEN length(text) > 320 THEN 'message too long' END) AS problems FROM benchmark")
def f18(spark, sf):
    return sql(spark, sf, "SELECT item_id, text FROM benchmark").select("item_id", F.array_join(T.draft_problems(F.col("text"), F.col("text")), "; ").alias("problems"))


@query("F19_cosine", "SELECT a.vec_id, round(list_cosine_similarity(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])), 6) AS cos, list_cosine_similarity(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])) < 0.85 AS flagged FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1")
def f19(spark, sf):
    a = sql(spark, sf, "SELECT vec_id, embedding FROM embeddings")
    b = a.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("e2"))
    c = a.join(b, "vec_id").select("vec_id", T.cosine(F.col("embedding"), F.col("e2")).alias("c"))
    return c.select("vec_id", F.round("c", 6).alias("cos"), (F.col("c") < 0.85).alias("flagged"))


#: Nations as districts; their suppliers are facilities, their customers actions.
_DISTRICT = "SELECT n_nationkey AS district, n_name AS district_name, CASE WHEN n_nationkey % 5 = 4 THEN 'official' ELSE 'ensemble' END AS mode, n_nationkey * 9000.0 AS pop_p10, n_nationkey * 20000.0 AS pop_p50, n_nationkey * 41000.0 AS pop_p90 FROM nation"
_PEOPLE = "CASE WHEN {n} >= 100000 THEN format('{:.1f}', round_even({n} / 1e5, 1)) || ' lakh' WHEN {n} >= 1000 THEN format('{},{:03d}', CAST({n} AS BIGINT) // 1000, CAST({n} AS BIGINT) % 1000) ELSE CAST(CAST({n} AS BIGINT) AS VARCHAR) END"


def _said(n: str) -> str:
    return _PEOPLE.replace("{n}", n)


@query(
    "F20_facts_view",
    f"""WITH d AS ({_DISTRICT}), f AS (SELECT s_nationkey AS district, s_suppkey, (s_suppkey * 37 % 1000) / 1e3 AS p, row_number() OVER (PARTITION BY s_nationkey ORDER BY (s_suppkey * 37 % 1000) / 1e3 DESC, s_suppkey) AS k FROM supplier),
a AS (SELECT c_nationkey AS district, c_custkey, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_custkey) AS k FROM customer)
SELECT district, 'provenance' AS fact_id, true AS required, 'IMD National Bulletin No. 21 issued 27 Oct 2025, 11:30 IST' AS en, 'imd_bulletin_no' AS row_id FROM d
UNION ALL SELECT district, 'provenance_short', false, 'IMD Bulletin 21', 'imd_bulletin_no' FROM d UNION ALL SELECT district, 'district', true, district_name, 'district_name' FROM d UNION ALL SELECT district, 'landfall_window', false, '“tonight” (IMD)', 'landfall_window_text' FROM d
UNION ALL SELECT district, 'ensemble_size', false, '1,062 storm futures (ECMWF and Google DeepMind WeatherNext, aligned to the IMD track)', 'members' FROM d WHERE mode = 'ensemble'
UNION ALL SELECT district, 'pop_cut_p50', true, {_said("pop_p50")}, 'pop_cut_hospital.p50' FROM d UNION ALL SELECT district, 'pop_cut_range', true, {_said("pop_p10")} || ' to ' || {_said("pop_p90")}, 'pop_cut_hospital.p10_p90' FROM d WHERE mode = 'ensemble'
UNION ALL SELECT f.district, 'fac' || k || '_name', k = 1, 'PHC ' || s_suppkey, CAST(s_suppkey AS VARCHAR) FROM f WHERE k <= 5
UNION ALL SELECT f.district, 'fac' || k || '_p', k = 1, CASE WHEN p < 0.005 THEN '<1%' WHEN p > 0.995 THEN '>99%' ELSE CAST(CAST(round_even(p * 100, 0) AS BIGINT) AS VARCHAR) || '%' END, CAST(s_suppkey AS VARCHAR) FROM f JOIN d ON f.district = d.district WHERE k <= 5 AND mode = 'ensemble'
UNION ALL SELECT f.district, 'fac' || k || '_window', k = 1, '28 Oct, 22:30 IST to 29 Oct, 05:30 IST', CAST(s_suppkey AS VARCHAR) FROM f WHERE k <= 5 AND s_suppkey % 2 = 0
UNION ALL SELECT district, 'act' || k || '_site', k = 1, 'culvert near Tuni', CAST(c_custkey AS VARCHAR) FROM a WHERE k <= 3 UNION ALL SELECT district, 'act' || k || '_deadline', k = 1, '28 Oct, 22:30 IST (P10 closure − 6 h)', CAST(c_custkey AS VARCHAR) FROM a WHERE k <= 3
UNION ALL SELECT district, 'act' || k || '_deadline_short', false, '28 Oct, 22:30 IST', CAST(c_custkey AS VARCHAR) FROM a WHERE k <= 3 UNION ALL SELECT district, 'act' || k || '_people', false, '12,300', CAST(c_custkey AS VARCHAR) FROM a WHERE k <= 3""",
)
def f20(spark, sf):
    from cutoffs.operators.facts import build_facts

    at = lambda t: F.lit(t).cast("timestamp")
    no = F.lit(None).cast("double")
    d = sql(spark, sf, _DISTRICT).withColumns({"run_id": F.lit("r"), "bulletin_no": F.lit("21"), "issued_at": at("2025-10-27 06:00:00"), "landfall_text": F.lit("tonight"), "members": F.create_map(F.lit("a"), F.lit(976), F.lit("b"), F.lit(86), F.lit("IMD"), F.lit(1)), "fac_p10": no, "fac_p50": no, "fac_p90": no})
    s = sql(spark, sf, "SELECT s_nationkey AS district, s_suppkey AS facility_id FROM supplier")
    even = F.col("facility_id") % 2 == 0
    s = s.withColumns({"run_id": F.lit("r"), "type": F.lit("phc"), "name": F.concat(F.lit("PHC,"), F.col("facility_id")), "simulated": F.lit(False), "p": F.col("facility_id") * 37 % 1000 / 1000, "t10": F.when(even, at("2025-10-28 17:00:00")), "t90": F.when(even, at("2025-10-29 00:00:00"))})
    a = sql(spark, sf, "SELECT c_nationkey AS district, c_custkey AS action_id FROM customer")
    a = a.withColumns({"run_id": F.lit("r"), "rank": F.lit(1), "crossing": F.lit("culvert"), "road": F.lit(None).cast("string"), "place": F.lit("Tuni"), "place_te": F.lit("తుని"), "place_hi": F.lit(None).cast("string"), "deadline": at("2025-10-28 17:00:00"), "basis": F.lit("P10 closure - 6 h"), "people": F.lit(12345.0), "p_event": no})
    return build_facts(d, s, a).select("district", "fact_id", "required", "en", "row_id")


@query("F22_citations", "SELECT c.conv_id, c.turn, 'fact_' || (c.turn % 7) AS fact_id, n.n_name AS value FROM conversations c JOIN nation n ON n.n_nationkey = c.turn % 7 WHERE c.turn % 7 <> 3 UNION SELECT conv_id, turn, 'fact_1', n_name FROM conversations JOIN nation ON n_nationkey = 1")
def f22(spark, sf):
    """Each turn cites a fact twice over, another one, and one that is unknown."""
    c = sql(spark, sf, "SELECT conv_id, turn FROM conversations").distinct()
    own = F.concat(F.lit("{{fact_"), F.col("turn") % 7, F.lit("}}"))
    t = c.select(F.struct("conv_id", "turn").alias("text_id"), F.concat(own, F.lit(" and {{ fact_1 }}, {{nosuch}} and "), own).alias("text"))
    facts = sql(spark, sf, "SELECT concat('fact_', n_nationkey) AS fact_id, n_name AS value FROM nation WHERE n_nationkey <> 3")
    return T.citations(t, facts).select("text_id.conv_id", "text_id.turn", "fact_id", "value")


@query("SC25_confidence_band", "SELECT l_orderkey, l_linenumber, count(*) FILTER (WHERE l_discount * 10 >= 0.8) AS high, count(*) FILTER (WHERE l_discount * 10 < 0.5) AS low FROM lineitem GROUP BY 1, 2")
def sc25(spark, sf):
    t = sql(spark, sf, "SELECT l_orderkey, l_linenumber, l_discount * 10 AS c FROM lineitem").withColumn("b", T.confidence_band(F.col("c")))
    return t.groupBy("l_orderkey", "l_linenumber").agg(F.count(F.when(F.col("b") == "high", 1)).alias("high"), F.count(F.when(F.col("b") == "low", 1)).alias("low"))


@query("SC23_prob_from_deciles", "SELECT p_partkey, CAST(len(list_filter([3, 6, 9, 15, 22, 30, 44, 999, 999], lambda x: x <= p_size AND x < 999)) AS DOUBLE) / 10 AS p FROM part")
def sc23(spark, sf):
    d = F.array(*[F.lit(x) for x in (3, 6, 9, 15, 22, 30, 44, 999, 999)])
    return sql(spark, sf, "SELECT p_partkey, p_size FROM part").select("p_partkey", (T.probability_by(d, F.col("p_size"))).alias("p"))


@query("SC24_hours_to_iso", "SELECT p_partkey, CASE WHEN p_size % 5 > 0 THEN strftime(TIMESTAMP '2025-10-26 00:00:00' + p_size * INTERVAL 30 MINUTE, '%Y-%m-%dT%H:%M:%SZ') END AS iso FROM part")
def sc24(spark, sf):
    h = F.when(F.col("p_size") % 5 > 0, F.col("p_size") / 2).otherwise(float("inf"))
    iso = T.hours_to_iso(h, F.lit("2025-10-26 00:00:00"))
    return sql(spark, sf, "SELECT p_partkey, p_size FROM part").select("p_partkey", iso.alias("iso"))


@query("Q1_reading_checks", """WITH f AS (SELECT user_id AS b, event_id AS seq, event_id % 35 AS lat, 40 + event_id % 61 AS lon, CAST(event_id AS DOUBLE) / 2 AS h, value AS w, CASE WHEN user_id % 3 = 0 THEN 'CS' ELSE 'SuCS' END AS c FROM events),
g AS (SELECT *, lag(lat) OVER o AS plat, lag(lon) OVER o AS plon, lag(h) OVER o AS ph FROM f WINDOW o AS (PARTITION BY b ORDER BY seq)),
s AS (SELECT b, bool_and(lat BETWEEN 0 AND 30 AND lon BETWEEN 40 AND 100) AS basin, bool_and(CASE WHEN c = 'CS' THEN w >= 34 - 1 / 1.852 AND w <= 47 + 1 / 1.852 ELSE w >= 120 - 1 / 1.852 AND w <= 400 + 1 / 1.852 END) AS fits, bool_and(coalesce(h > ph, true)) AS rise,
 coalesce(max(2 * 6371.0088 * asin(least(1, sqrt(pow(sin(radians(lat - plat) / 2), 2) + cos(radians(plat)) * cos(radians(lat)) * pow(sin(radians(lon - plon) / 2), 2)))) / nullif(abs(h - ph), 0)), 0) <= 60 AS slow FROM g GROUP BY b),
k AS (SELECT b, unnest(['in_basin', 'leads_rise', 'speed_plausible', 'wind_matches_category', 'has_quotes', 'quotes_verbatim']) AS "check", unnest([basin, rise, slow, fits, b % 4 > 0, CASE WHEN b % 4 > 0 THEN b % 4 < 3 END]) AS ok FROM s)
SELECT b AS bulletin_id, "check", CASE WHEN ok IS NULL THEN 'na' WHEN ok THEN 'pass' ELSE 'fail' END AS status FROM k""")
def q1(spark, sf):
    f = sql(spark, sf, "SELECT user_id AS bulletin_id, event_id AS seq, CAST(event_id AS DOUBLE) / 2 AS lead_h, CAST(event_id % 35 AS DOUBLE) AS lat, CAST(40 + event_id % 61 AS DOUBLE) AS lon, value AS wind_kt, CASE WHEN user_id % 3 = 0 THEN 'CS' ELSE 'SuCS' END AS category FROM events")
    k = F.col("bulletin_id") % 4
    quotes = F.when(k == 0, F.array().cast("array<string>")).when(k == 3, F.array(F.lit("over the bay"), F.lit("over the sea"))).otherwise(F.array(F.lit("over  the bay")))
    r = f.select("bulletin_id").distinct().withColumn("text", F.lit("Storm over the bay")).withColumn("quotes", quotes)
    return T.reading_checks(r, f)


@query("Q2_closed_schema", "SELECT event_id, regexp_matches(props, '^\\{\"k\": ?-?[0-9]+\\}$') AND value >= 0 AS valid FROM events")
def q2(spark, sf):
    keys = F.json_object_keys("props")
    k = F.from_json("props", "k bigint")
    ok = F.coalesce((F.size(keys) == 1) & (F.get(keys, F.lit(0)) == "k") & k["k"].isNotNull() & (F.col("value") >= 0), F.lit(False))
    return sql(spark, sf, "SELECT event_id, props, value FROM events").select("event_id", ok.alias("valid"))


@query("Q3_report_routing", """SELECT l_orderkey, l_linenumber, count(*) FILTER (WHERE s_suppkey IS NOT NULL AND l_quantity > 10 AND l_returnflag <> 'A' AND l_discount * 10 >= 0.8 AND NOT (l_linenumber = 1 AND l_linestatus = 'F' AND l_returnflag = 'R')) AS auto FROM lineitem LEFT JOIN (SELECT * FROM supplier WHERE s_nationkey < 20) ON l_suppkey = s_suppkey GROUP BY 1, 2""")
def q3(spark, sf):
    r = sql(spark, sf, "SELECT l_orderkey, l_linenumber, l_suppkey AS asset_id, CASE WHEN l_linenumber = 1 THEN 'bridge' ELSE 'road' END AS kind, l_quantity > 10 AS location_ok, CASE l_returnflag WHEN 'A' THEN 'unknown' WHEN 'R' THEN 'open' ELSE 'closed' END AS passability, l_discount * 10 AS confidence, CASE l_linestatus WHEN 'F' THEN 'closed' ELSE 'open' END AS previous FROM lineitem")
    known = sql(spark, sf, "SELECT s_suppkey AS asset_id, s_nationkey FROM supplier").filter("s_nationkey < 20")
    return T.route_reports(r, known).groupBy("l_orderkey", "l_linenumber").agg(F.count(F.when(F.col("decision") == "auto_apply", 1)).alias("auto"))


@query("Q10_checksum", "SELECT doc_id, CASE WHEN doc_id % 10 = 3 THEN 'changed' WHEN doc_id % 10 = 4 THEN 'unknown' ELSE 'ok' END AS status FROM documents")
def q10(spark, sf):
    """Documents against a registry that has another hash for some of them and lacks others."""
    d = sql(spark, sf, "SELECT doc_id AS file_id, text AS content FROM documents")
    known = sql(spark, sf, "SELECT doc_id AS file_id, text FROM documents").filter("file_id % 10 <> 4")
    registry = known.select("file_id", F.sha2(F.when(F.col("file_id") % 10 == 3, F.concat("text", F.lit("."))).otherwise(F.col("text")), 256).alias("sha256"))
    return T.verified(d, registry).select(F.col("file_id").alias("doc_id"), "status")


_LINK = "'<a\\s[^>]*href=\"([^\"]*)\"[^>]*>((?:.|\\n)*?)</a>'"


@query("SRC18_listing_rows", f"""WITH l AS (SELECT page_id, url, unnest(regexp_extract_all(html, {_LINK}, 1)) AS href FROM pages) SELECT page_id, CASE WHEN regexp_matches(href, '^https?://') THEN href WHEN starts_with(href, '/') THEN regexp_extract(url, '^(https?://[^/]+)', 1) || href ELSE regexp_extract(url, '^(https?://[^/]+)', 1) || '/' || href END AS href FROM l""")
def src18(spark, sf):
    return T.listing_rows(sql(spark, sf, "SELECT page_id, url, html FROM pages")).select("page_id", "href")


@query("SRC19_listing_window", "SELECT event_id FROM events WHERE CAST(ts AS DATE) BETWEEN DATE '2024-01-05' AND DATE '2024-01-09'")
def src19(spark, sf):
    return sql(spark, sf, "SELECT event_id, CAST(ts AS DATE) AS d FROM events").filter(F.col("d").between(F.lit("2024-01-05").cast("date"), F.lit("2024-01-09").cast("date"))).select("event_id")


@query("SRC20_newest_bulletin", "SELECT strftime(max(date_trunc('minute', ts)), '%Y-%m-%d %H:%M') AS based_on, epoch(TIMESTAMP '2024-02-01') - epoch(max(date_trunc('minute', ts))) <= 36 * 3600 AS active FROM events")
def src20(spark, sf):
    t = sql(spark, sf, "SELECT event_id, CAST(ts AS TIMESTAMP) AS ts FROM events").select(F.concat(F.lit("Bulletin based on "), F.date_format("ts", "HH:mm"), F.lit(" UTC of "), F.date_format("ts", "dd-MM-yyyy")).alias("text"), F.lit("https://a.example/b_7.pdf").alias("url"))
    return T.newest_bulletin(t, F.lit("2024-02-01").cast("timestamp")).select(F.date_format("based_on", "yyyy-MM-dd HH:mm").alias("based_on"), "active")


@query("SRC22_known_bulletins", "SELECT o_custkey AS storm, o_orderkey AS run_id, sha256(CAST(o_orderkey AS VARCHAR)) AS sha256 FROM orders WHERE o_orderkey % 5 <> 0 AND o_orderkey % 7 <> 0")
def src22(spark, sf):
    """Storms are customers and their runs orders; some runs lack the address, some the hash."""
    o = sql(spark, sf, "SELECT o_custkey, o_orderkey FROM orders")
    k = F.col("o_orderkey")
    run = F.struct(k.alias("run_id"), F.lit("21").alias("bulletin_no"), F.when(k % 5 != 0, "https://a.example/b.pdf").alias("url"), F.when(k % 7 != 0, F.sha2(k.cast("string"), 256)).otherwise("").alias("sha256"))
    configs = o.groupBy(F.col("o_custkey").alias("storm")).agg(F.collect_list(run).alias("runs"))
    return T.known_bulletins(configs).select("storm", "run_id", "sha256")


@query("SNK7_alert_rows", """WITH a AS (SELECT s_suppkey, s_nationkey, strftime(TIMESTAMP '2025-10-26 04:00:00' + INTERVAL 1 HOUR * (s_suppkey % 9) + INTERVAL 330 MINUTE, '%Y-%m-%dT%H:%M:%S') || '+05:30' AS sent, strftime(TIMESTAMP '2025-10-29 04:00:00' + INTERVAL 330 MINUTE, '%Y-%m-%dT%H:%M:%S') || '+05:30' AS until FROM supplier),
i AS (SELECT *, 'ALERT-' || s_suppkey || '-' || s_nationkey || '-' || substr(sha256(s_suppkey || '|' || s_nationkey || '|' || sent || '|en-INRoads close|hi-INRoads'), 1, 10) AS identifier FROM a)
SELECT identifier, sent, CASE WHEN s_suppkey % 4 > 0 THEN until END AS expires, CASE s_suppkey % 3 WHEN 0 THEN '16.5,82.0 16.5,82.1235 16.75,82.1235 16.5,82.0' WHEN 1 THEN '16.5,82.0 17.5,82.0 17.0,83.0 16.5,82.0' END AS polygon, language FROM i, (SELECT unnest(['en-IN', 'hi-IN']) AS language)""")
def snk7(spark, sf):
    s = sql(spark, sf, "SELECT s_suppkey AS run_id, s_nationkey AS district FROM supplier")
    at = lambda *ps: F.array(*[F.struct(F.lit(float(a)).alias("lat"), F.lit(float(b)).alias("lon")) for a, b in ps])
    ring = F.when(F.col("run_id") % 3 == 0, at((16.5, 82), (16.5, 82.12345678), (16.75, 82.12345678))).when(F.col("run_id") % 3 == 1, at((16.5, 82), (17.5, 82), (17, 83), (16.5, 82))).otherwise(at((16.5, 82), (17.5, 82)))
    info = lambda a, b: F.struct(F.lit(a).alias("language"), F.lit(b).alias("headline"))
    sent = F.timestamp_seconds(F.lit(1761451200) + F.col("run_id") % 9 * 3600)
    a = s.select("run_id", "district", sent.alias("sent"), F.when(F.col("run_id") % 4 > 0, F.timestamp_seconds(F.lit(1761624000))).alias("landfall"), F.array(info("en-IN", "Roads close"), info("hi-IN", "Roads")).alias("infos"), ring.alias("ring"))
    return T.alert_rows(a).select("identifier", "sent", "expires", "polygon", "language")


@query("SNK8_alert_rules", "SELECT s_suppkey, concat_ws('; ', CASE WHEN s_suppkey % 2 = 0 THEN 'restriction missing' END, CASE WHEN s_suppkey % 3 = 0 THEN 'bad time' END, CASE WHEN s_suppkey % 5 = 0 THEN 'polygon not closed' END) AS problems FROM supplier")
def snk8(spark, sf):
    s = sql(spark, sf, "SELECT s_suppkey, CASE WHEN s_suppkey % 3 = 0 THEN 'now' ELSE '2025-10-26T10:00:00+05:30' END AS sent, CASE WHEN s_suppkey % 5 = 0 THEN '1,1 2,2 1,2' ELSE '1,1 2,2 1,2 1,1' END AS polygon FROM supplier")
    p = T.alert_problems(F.col("s_suppkey") % 2 == 0, F.lit(None).cast("string"), F.col("sent"), F.col("polygon"), F.lit(16.0))
    return s.select("s_suppkey", F.array_join(p, "; ").alias("problems"))


@query("AG30_label_agreement", "SELECT count(*) FILTER (WHERE quality = toxic) AS agree, count(*) AS total, CAST(least(12, count(*) FILTER (WHERE quality <> toxic)) AS BIGINT) AS shown, (SELECT string_agg(CAST(doc_id AS VARCHAR), ',' ORDER BY doc_id) FROM (SELECT doc_id FROM labels WHERE quality <> toxic ORDER BY doc_id LIMIT 12)) AS ids FROM labels")
def ag30(spark, sf):
    t = sql(spark, sf, "SELECT doc_id AS id, quality = toxic AS ok FROM labels")
    return T.label_agreement(t).select("agree", "total", F.size("differing").cast("long").alias("shown"), F.array_join(F.transform("differing", lambda x: x.cast("string")), ",").alias("ids"))


@query("J23_label_comparison", "SELECT coalesce(a.doc_id, b.doc_id) AS doc_id, a.doc_id IS NULL OR b.doc_id IS NULL AS missing, coalesce(a.quality = b.n % 2, false) AS ok FROM labels a FULL OUTER JOIN (SELECT doc_id, n_chars AS n FROM documents) b ON a.doc_id = b.doc_id")
def j23(spark, sf):
    a = sql(spark, sf, "SELECT doc_id, quality FROM labels").withColumn("in_a", F.lit(True))
    b = sql(spark, sf, "SELECT doc_id, n_chars AS n FROM documents").withColumn("in_b", F.lit(True))
    j = a.join(b, "doc_id", "full_outer")
    return j.select("doc_id", (F.col("in_a").isNull() | F.col("in_b").isNull()).alias("missing"), F.coalesce(F.col("quality") == F.col("n") % 2, F.lit(False)).alias("ok"))


@query("J26_name_lookup", """WITH q AS (SELECT c_custkey, CASE c_custkey % 4 WHEN 0 THEN upper(n_name) || ' District' WHEN 1 THEN substr(lower(n_name), 2, 4) WHEN 2 THEN 'united ' ELSE 'nowhere' END AS q FROM customer JOIN nation ON c_nationkey = n_nationkey),
h AS (SELECT c_custkey, n_nationkey, n_name FROM q, nation WHERE contains(lower(n_name), trim(replace(lower(trim(q)), ' district', '')))) SELECT c_custkey, min(n_nationkey) AS n_nationkey, arg_min(n_name, n_nationkey) AS n_name FROM h GROUP BY 1""")
def j26(spark, sf):
    q = sql(spark, sf, "SELECT c_custkey AS query_id, CASE c_custkey % 4 WHEN 0 THEN upper(n_name) || ' District' WHEN 1 THEN substr(lower(n_name), 2, 4) WHEN 2 THEN 'united ' ELSE 'nowhere' END AS q FROM customer JOIN nation ON c_nationkey = n_nationkey")
    names = sql(spark, sf, "SELECT n_nationkey AS name_id, n_name AS name FROM nation").withColumn("variants", F.array().cast("array<string>"))
    out = T.find_by_name(q, names)
    return out.select(F.col("query_id").alias("c_custkey"), F.col("name_id").alias("n_nationkey"), F.col("name").alias("n_name"))
