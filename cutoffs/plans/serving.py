"""Serving views, documents and scans over suppliers, orders and lineitem."""

from __future__ import annotations

from pyspark.sql import functions as F

from cutoffs.operators import views
from cutoffs.registry import query, sql
from cutoffs.sources import sinks

SITES = "SELECT s_suppkey AS id, s_nationkey AS district, CAST(s_suppkey % 10 AS DOUBLE) / 10 AS p, s_suppkey % 60 AS hour, CAST(floor(abs(s_acctbal)) AS BIGINT) AS people FROM supplier"


@query("T1_rank_sites", f"WITH s AS ({SITES}), r AS (SELECT *, row_number() OVER (PARTITION BY district ORDER BY p DESC, id) AS rank FROM s) SELECT district, id, CAST(rank AS INTEGER) AS rank FROM r WHERE rank <= 3")
def t1(spark, sf):
    return views.ranked(sql(spark, sf, SITES), "district", "p", 3).select("district", "id", "rank")


@query("T7_serving_cap", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 50")
def t7(spark, sf):
    return sql(spark, sf, "SELECT o_orderkey, o_totalprice FROM orders").orderBy(F.desc("o_totalprice"), "o_orderkey").limit(50)


@query("T6_total_order", "SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice) AS k FROM lineitem")
def t6(spark, sf):
    from pyspark.sql import Window

    w = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice")
    return sql(spark, sf, "SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice FROM lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", F.row_number().over(w).cast("long").alias("k"))


@query("Q4_district_summary", f"WITH s AS ({SITES}) SELECT district, count(*) AS sites, count(*) FILTER (WHERE p >= 0.3) AS at_risk, max(p) AS max_p, sum(people)::BIGINT AS people, count(*) FILTER (WHERE hour <= 30) AS by_landfall FROM s GROUP BY 1")
def q4(spark, sf):
    return views.district_summary(sql(spark, sf, SITES), 30)


_AT_RISK = """SELECT s_nationkey AS district, s_suppkey AS id, CASE s_suppkey % 3 WHEN 0 THEN 'phc' WHEN 1 THEN 'chc' ELSE 'shelter' END AS type, CASE WHEN s_suppkey % 11 > 0 THEN (s_suppkey % 37) / 37e0 END AS p,
 CASE WHEN s_suppkey % 4 > 0 THEN TIMESTAMP '2025-10-26 05:00:00' + INTERVAL 1 HOUR * (s_suppkey % 60) END AS t10, TIMESTAMP '2025-10-29 00:00:00' AS t90, s_suppkey % 5 = 0 AS simulated FROM supplier"""


@query(
    "Q4_sites_at_risk",
    f"""WITH s AS ({_AT_RISK}), l AS (SELECT *, unnest(['any', type]) AS asked FROM s WHERE p IS NOT NULL), r AS (SELECT *, row_number() OVER (PARTITION BY district, asked ORDER BY p DESC, id) AS rank FROM l)
SELECT district, asked, rank, id, CASE WHEN p < 0.005 THEN '<1%' WHEN p > 0.995 THEN '>99%' ELSE CAST(CAST(round_even(p * 100, 0) AS BIGINT) AS VARCHAR) || '%' END AS chance,
 strftime(t10 + INTERVAL 330 MINUTE, '%-d %b, %H:%M IST') || ' to ' || strftime(t90 + INTERVAL 330 MINUTE, '%-d %b, %H:%M IST') AS "window", simulated FROM r WHERE rank <= 10""",
)
def q4_list(spark, sf):
    """The ten sites of each district and type that are likeliest to be cut off."""
    return views.at_risk(sql(spark, sf, _AT_RISK.replace("INTERVAL 1 HOUR * (s_suppkey % 60)", "make_interval(0, 0, 0, 0, CAST(s_suppkey % 60 AS INT))")))


@query("Q4_facility_timeline", "SELECT s_suppkey AS id, unnest([1, 2, 3]) * CAST(s_suppkey % 9 + 1 AS INTEGER) AS hour, unnest([0.1e0, 0.2e0, 0.3e0]) AS p FROM supplier")
def q4_timeline(spark, sf):
    s = sql(spark, sf, "SELECT s_suppkey AS id, CAST(s_suppkey % 9 + 1 AS INTEGER) AS k FROM supplier")
    d = F.array(F.col("k"), F.col("k") * 2, F.col("k") * 3, F.lit(999), F.lit(None).cast("int"))
    return views.timeline(s.withColumn("deciles", d))


ITEMS = "SELECT CAST(c_custkey % 3 AS INTEGER) AS run, c_custkey // 3 AS id, CASE c_custkey // 3 % 3 WHEN 0 THEN 'facility' WHEN 1 THEN 'district' ELSE 'crossing' END AS kind, CAST(c_custkey * 7 % 100 AS DOUBLE) / 100 AS p, c_custkey * 37 % 200000 AS people FROM customer"
_TRIG = "kind = 'facility' AND p >= 0.3 OR kind = 'district' AND people >= 100000 OR kind = 'crossing' AND p >= 0.3 AND people >= 10000"


@query("Q5_triggers", f"WITH i AS ({ITEMS}) SELECT kind, run, count(*) AS n FROM i WHERE {_TRIG} GROUP BY 1, 2")
def q5(spark, sf):
    return views.triggers(sql(spark, sf, ITEMS.replace("//", "DIV"))).groupBy("kind", "run").agg(F.count("*").alias("n"))


@query("Q5_stand_downs", f"WITH i AS ({ITEMS}) SELECT a.id, a.run, min(b.run) AS until FROM i a JOIN i b ON a.id = b.id AND b.run > a.run AND b.p < 0.15 WHERE {_TRIG.replace('kind', 'a.kind').replace('p >=', 'a.p >=').replace('people', 'a.people')} GROUP BY 1, 2")
def q5_down(spark, sf):
    return views.stand_downs(sql(spark, sf, ITEMS.replace("//", "DIV")))


@query("AG31_trigger_counts", f"WITH i AS ({ITEMS}) SELECT kind, count(*) AS n, max(p) AS max_p FROM i WHERE {_TRIG} GROUP BY 1")
def ag31(spark, sf):
    return views.triggers(sql(spark, sf, ITEMS.replace("//", "DIV"))).groupBy("kind").agg(F.count("*").alias("n"), F.max("p").alias("max_p"))


@query("Q7_storm_summary", "SELECT (SELECT count(*) FROM (SELECT DISTINCT event_type, user_id FROM events WHERE event_type <> 'purchase')) AS members, (SELECT max(event_id % 97) FROM events) AS lead_h, (SELECT count(DISTINCT c_nationkey) FROM customer) AS districts, (SELECT c_nationkey FROM customer GROUP BY 1 ORDER BY count(*) DESC, 1 DESC LIMIT 1) AS leading")
def q7(spark, sf):
    m = sql(spark, sf, "SELECT CASE WHEN event_type = 'purchase' THEN 'official' ELSE event_type END AS source, user_id AS member_no, event_id % 97 AS lead_h FROM events")
    d = sql(spark, sf, "SELECT c_nationkey AS district, count(*) AS people FROM customer GROUP BY 1")
    return views.storm_summary(m, d)


_FEAT = """SELECT p_partkey AS id, (p_partkey % 10) / 100e0 AS p, (p_partkey % 4) / 4e0 AS share, p_size FROM part WHERE p_partkey % 10 > 0 OR p_partkey % 4 = 3"""


@query("SNK5_map_features", f"""WITH f AS ({_FEAT}) SELECT id, CAST(CASE WHEN p_size > 40 OR id % 7 = 0 OR p > 0.05 THEN 6 ELSE 11 END AS INTEGER) AS min_zoom, CAST(p_size AS DOUBLE) AS d1, 999e0 AS d2, p, share > 0.5 AS no_route FROM f""")
def snk5(spark, sf):
    """The lines are read back from their JSON."""
    p = sql(spark, sf, "SELECT p_partkey AS id, (p_partkey % 10) / 100e0 AS p, (p_partkey % 4) / 4e0 AS no_route_share, p_size > 40 AS major, CASE WHEN p_partkey % 7 = 0 THEN 'bridge' ELSE 'none' END AS crossing_type, p_size FROM part")
    out = views.map_features(p.withColumn("deciles", F.array(F.col("p_size"), F.lit(None).cast("int"))))
    line = F.from_json("line", "id bigint, d array<double>, p double, no_route boolean")
    return out.select("min_zoom", line.alias("l")).select("l.id", "min_zoom", F.col("l.d")[0].alias("d1"), F.col("l.d")[1].alias("d2"), "l.p", "l.no_route")


@query("SNK6_track_lines", "SELECT event_type AS source, user_id AS member_no, count(*) AS n FROM events WHERE event_type = 'purchase' OR event_id % 3 = 0 GROUP BY 1, 2 HAVING count(*) >= 2")
def snk6(spark, sf):
    t = sql(spark, sf, "SELECT event_type AS source, user_id AS member_no, event_id, 80e0 + (event_id % 991) / 1e2 AS lon, 5e0 + (event_id % 997) / 1e2 AS lat FROM events")
    out = views.track_lines(t, ["source", "member_no"], F.col("source") == "purchase", F.col("event_id"))
    return out.select("source", "member_no", F.size("points").cast("long").alias("n"))


@query("SNK3_documents", "SELECT n_regionkey AS region, count(*) AS nations, string_agg(n_name, ',' ORDER BY n_nationkey) AS names FROM nation GROUP BY 1")
def snk3(spark, sf):
    n = sql(spark, sf, "SELECT n_regionkey AS region, n_nationkey, n_name FROM nation")
    docs = sinks.documents({"nations": n}, "region")
    back = F.from_json("document", "region int, nations array<struct<n_nationkey: int, n_name: string>>")
    d = docs.select(back.alias("d"))
    return d.select("d.region", F.size("d.nations").cast("long").alias("nations"), F.array_join(F.transform("d.nations", lambda x: x["n_name"]), ",").alias("names"))


@query("SNK4_manifest")
def snk4(spark, sf):
    return sinks.manifest(spark, sf, "*.parquet").select("bytes", "sha256")


@query("SNK9_product_index", "SELECT url, sha256(url) || '.pdf' AS file, sha256(html) AS sha256 FROM pages")
def snk9(spark, sf):
    p = sql(spark, sf, "SELECT url, html AS content, page_id AS listed_at, url AS title FROM pages")
    return sinks.product_index(p).select("url", "file", "sha256")


@query("SNK1_reference_tables", "SELECT c_nationkey, count(*) AS n, round(sum(c_acctbal), 2) AS total FROM customer GROUP BY 1")
def snk1(spark, sf):
    """Writes customers by nation and reads them back through partition pruning."""
    import uuid

    from cutoffs.session import shared_dir

    path = f"{shared_dir(spark)}/reference-{uuid.uuid4().hex}"
    sinks.write_table(sql(spark, sf, "SELECT c_custkey, c_nationkey, c_acctbal FROM customer"), path, ["c_nationkey"])
    return spark.read.schema("c_custkey bigint, c_acctbal double, c_nationkey int").parquet(path).groupBy("c_nationkey").agg(F.count("*").alias("n"), F.round(F.sum("c_acctbal"), 2).alias("total"))


@query("SNK2_run_tables", "SELECT CAST(l_linenumber AS INTEGER) AS run_id, count(*) AS n FROM lineitem GROUP BY 1")
def snk2(spark, sf):
    import uuid

    from cutoffs.session import shared_dir

    path = f"{shared_dir(spark)}/runs-{uuid.uuid4().hex}"
    sinks.write_table(sql(spark, sf, "SELECT l_linenumber AS run_id, l_orderkey FROM lineitem"), path, ["run_id"])
    return spark.read.schema("l_orderkey bigint, run_id int").parquet(path).groupBy("run_id").agg(F.count("*").alias("n"))


@query("SRC1_track_csv", "SELECT event_id AS member_no, round(value * 1852 / 3600, 6) AS vmax_ms FROM events WHERE event_type = 'click'")
def src1(spark, sf):
    """Writes events as track files into the shared folder and scans them for one storm id."""
    import uuid

    from cutoffs.session import shared_dir
    from cutoffs.sources import tracks

    path = f"{shared_dir(spark)}/tracks-{uuid.uuid4().hex}"
    e = sql(spark, sf, "SELECT CAST(ts AS TIMESTAMP) AS init_time, event_type AS track_id, event_id AS sample, CAST(ts AS TIMESTAMP) AS valid_time, '0' AS lead_time, 16e0 AS lat, 82e0 AS lon, 990e0 AS minimum_sea_level_pressure_hpa, value AS maximum_sustained_wind_speed_knots, 40e0 AS radius_of_maximum_winds_km FROM events")
    e.write.option("header", True).csv(path)
    return tracks.track_csv(spark, path, "events", "click").select("member_no", F.round("vmax_ms", 6).alias("vmax_ms"))


@query("SRC21_published_runs", "SELECT 'r' || r_regionkey AS run_id, n_name AS district, n_nationkey AS people FROM nation JOIN region ON n_regionkey = r_regionkey")
def src21(spark, sf):
    """Writes a document per nation under its region's run and scans all runs; names come from the files' places."""
    import uuid

    from cutoffs.session import shared_dir
    from cutoffs.sources import tracks

    path = f"{shared_dir(spark)}/published-{uuid.uuid4().hex}"
    n = sql(spark, sf, "SELECT n_regionkey, n_name, n_nationkey AS people FROM nation")
    for k in range(5):  # the five regions are the runs
        n.filter(F.col("n_regionkey") == k).select("n_name", "people").repartition(1).write.json(f"{path}/r{k}/districts")
    runs = tracks.published_runs(spark, path, "n_name string, people int")
    return runs.select("run_id", F.col("n_name").alias("district"), "people")
