"""Operators against cases worked by hand and against brute force on small tables."""

from __future__ import annotations

import math
from datetime import datetime, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from cutoffs.contraction import connected_components
from cutoffs.functions import geo, text, wind
from cutoffs.operators import impact, network, rainfall, raster, reach, series, spatial, stats, terrain
from cutoffs.session import materialize, scope
from cutoffs.sources import sinks, tracks
from cutoffs.streaming import rules

INF = float("inf")
EDGES = [(0, 0, 1, 10.0), (1, 1, 2, 5.0), (2, 0, 3, INF), (3, 3, 2, 8.0), (4, 2, 4, 20.0), (5, 4, 5, 3.0)]


def run_reach(spark, sources, edges=EDGES, extra=()):
    e = spark.createDataFrame([(0, *x) for x in edges], "member int, edge_id bigint, u bigint, v bigint, c double")
    s = spark.createDataFrame([(0, n, a) for n, a in sources], "member int, node bigint, a double")
    return {r["node"]: (r["b"], r["critical_edge"]) for r in reach.isolation_times(e, s, ["member"]).collect()}


def test_reach_graph(spark):
    got = run_reach(spark, [(0, INF)])
    assert [got[n][0] for n in range(6)] == [INF, 10, 8, INF, 8, 3]
    assert [got[n][1] for n in range(6)] == [-1, 0, 3, -1, 3, 5]
    got = run_reach(spark, [(0, 6.0)])
    assert [got[n][0] for n in range(6)] == [6, 6, 6, 6, 6, 3]
    got = run_reach(spark, [(0, INF), (5, 12.0)])
    assert (got[4][0], got[5][0]) == (8, 12)


def test_reach_is_dijkstra_and_closing_never_helps(spark):
    rng = np.random.default_rng(5)
    edges = [(k, int(rng.integers(200)), int(rng.integers(200)), INF if rng.random() < 0.3 else float(rng.integers(0, 72))) for k in range(600)]

    def brute(es):
        b = {n: -INF for _, u, v, _ in es for n in (u, v)}
        b |= {0: INF, 1: INF, 2: INF}
        while True:
            new = dict(b)
            for _, u, v, c in es:
                for x, y in ((u, v), (v, u)):
                    new[y] = max(new[y], min(new[x], c))
            if new == b:
                return b
            b = new

    got = {n: b for n, (b, _) in run_reach(spark, [(0, INF), (1, INF), (2, INF)], edges).items()}
    assert got == brute(edges)
    fewer = {n: b for n, (b, _) in run_reach(spark, [(0, INF), (1, INF), (2, INF)], edges[:-60]).items()}
    assert all(b <= got[n] for n, b in fewer.items())


def test_open_edges_contract(spark):
    e = spark.createDataFrame([(m, k, u, v, c) for m in (0, 1) for k, u, v, c in EDGES], "member int, edge_id bigint, u bigint, v bigint, c double")
    rest, comp = reach.contract_open(e, ["member"])
    assert {r["node"]: r["super"] for r in comp.collect()} == {0: 0, 3: 0}
    s = spark.createDataFrame([(m, 0, INF) for m in (0, 1)], "member int, node bigint, a double")
    got = {(r["member"], r["node"]): r["b"] for r in reach.isolation_times(rest, s, ["member"]).collect()}
    assert got[0, 2] == 8 and got[1, 5] == 3


def test_scenarios_in_tasks_and_in_rounds_agree(spark):
    """Some scenarios lack edges that are open for good in others; ties everywhere; one scenario is large, one small."""
    rng = np.random.default_rng(12)
    shape = [(int(rng.integers(90)), int(rng.integers(90))) for _ in range(220)]
    rows = [(m, k, u, v, INF if (k % 3 == 0 or rng.random() < 0.2) else float(rng.integers(0, 6))) for m in range(3) for k, (u, v) in enumerate(shape) if rng.random() < (0.9, 0.6, 0.05)[m]]
    e = spark.createDataFrame(rows, "member int, edge_id bigint, u bigint, v bigint, c double")
    s = spark.createDataFrame([(m, n, a) for m in range(3) for n, a in ((3, 4.0), (8, INF), (200 + m, 2.0))], "member int, node bigint, a double")

    def brute(m):
        es = [r[1:] for r in rows if r[0] == m]
        b = {n: -INF for _, u, v, _ in es for n in (u, v)} | {3: 4.0, 8: INF, 200 + m: 2.0}
        for _ in range(len(b)):
            for _, u, v, c in es:
                b[u], b[v] = max(b[u], min(b[v], c)), max(b[v], min(b[u], c))
        return b

    want = {(m, n): b for m in range(3) for n, b in brute(m).items()}
    hours = {(m, k): c for m, k, _, _, c in rows}
    for bound in (10_000, 100, 0):
        got = reach.isolation_times(e, s, ["member"], group_edges=bound).collect()
        assert {(r["member"], r["node"]): r["b"] for r in got} == want and len(got) == len(want)
        assert all(hours[r["member"], r["critical_edge"]] == r["b"] for r in got if r["critical_edge"] >= 0)
        assert all(math.isinf(r["b"]) or r["b"] in (2.0, 4.0) for r in got if r["critical_edge"] < 0)
    assert reach.isolation_times(e.limit(0), s.limit(0), ["member"]).count() == 0


def test_a_scope_takes_its_tables_away(spark, tmp_path):
    with scope(spark):
        outer = materialize(spark.range(3))
        with pytest.raises(ValueError), scope(spark):
            inner = materialize(spark.range(4))
            raise ValueError
        with pytest.raises(Exception, match="(?i)exist"):
            inner.collect()
        outer.write.parquet(f"{tmp_path}/kept")
    kept = materialize(spark.range(5))  # outside of a scope tables stay
    with pytest.raises(Exception, match="(?i)exist"):
        spark.read.schema("id bigint").parquet(*outer.inputFiles()).collect()
    assert spark.read.parquet(f"{tmp_path}/kept").count() == 3 and kept.count() == 5


def test_components_of_chain_star_and_loop(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 100 + k) for k in range(1, 30)] + [(7, 7), (None, 3), (500, 500)]
    got = {r["node"]: r["component"] for r in connected_components(spark.createDataFrame(edges, "u bigint, v bigint")).collect()}
    assert all(got[i] == 0 for i in range(41)) and all(got[100 + k] == 100 for k in range(30)) and got[500] == 500


def test_isolation_summary(spark):
    b = [(0, 0, 2.0), (0, 1, INF), (0, 2, -INF), (1, 0, 5.0), (1, 1, INF), (1, 2, -INF), (2, 0, INF), (2, 1, 30.0), (2, 2, -INF)]
    df = spark.createDataFrame(b, "member int, node int, b double").withColumn("w", F.lit(1.0))
    got = {r["node"]: r for r in stats.isolation_summary(df, ["node"], "b", "w", 4.0).collect()}
    assert math.isclose(got[0]["p_landfall"], 1 / 3) and got[1]["p_landfall"] == 0 and got[2]["p_landfall"] is None and got[2]["no_route"]
    assert got[0]["t10"] == 2 and got[0]["t90"] == 5 and not got[0]["never"]
    two = spark.createDataFrame([(0, 1.0, 3.0), (0, INF, 1.0)], "node int, b double, w double")
    assert stats.isolation_summary(two, ["node"], "b", "w", 4.0).first()["p_landfall"] == 0.75


def test_member_weights(spark):
    rows = [("official", 0), ("a", 1), ("a", 2), ("b", 1), ("b", 2), ("b", 3), ("b", 4)]
    df = spark.createDataFrame(rows, "source string, member_no int")
    got = {(r["source"], r["member_no"]): r["weight"] for r in stats.member_weights(df).collect()}
    assert got["official", 0] == 0 and got["a", 1] == 0.25 and got["b", 4] == 0.125
    assert {r["weight"] for r in stats.member_weights(df, deterministic=True).collect()} == {0.0}


def test_tracks(spark):
    t0 = datetime(2025, 10, 25, 12)
    rows = [("official", 0, t0 + timedelta(hours=h), la, lo, v) for h, la, lo, v in ((0, 10.0, 88.0, 12.0), (24, 12.0, 86.0, 20.0), (48, 14.0, 84.0, 25.0))]
    df = spark.createDataFrame(rows, "source string, member_no bigint, valid_utc timestamp, lat double, lon double, vmax_ms double")
    h = series.hourly(df, metrics=["lat", "lon", "vmax_ms"]).orderBy("valid_utc").collect()
    assert len(h) == 49 and math.isclose(h[12]["lat"], 11) and math.isclose(h[12]["vmax_ms"], 16)
    at = spark.createDataFrame([("official", 0, t0 + timedelta(hours=x)) for x in (12, 60)], "source string, member_no bigint, t_ref timestamp")
    got = series.positions_at(df, at, ["source", "member_no"]).orderBy("t_ref").collect()
    assert got[0]["lat"] == 11 and got[1]["lat"] is None


def test_alignment_keeps_the_spread(spark):
    t0 = datetime(2025, 10, 25)
    off = spark.createDataFrame([(t0 + timedelta(hours=h), 10.0 + h / 10, 88.0, 20.0) for h in range(49)], "valid_utc timestamp, lat double, lon double, vmax_ms double")
    rows = [("a", m, t0 + timedelta(hours=h), 11.0 + d, 87.0, 10.0 + 2 * m) for m, d in enumerate((-0.5, 0.0, 0.5)) for h in range(73)]
    out = series.align(spark.createDataFrame(rows, "source string, member_no bigint, valid_utc timestamp, lat double, lon double, vmax_ms double"), off)
    per = {r["valid_utc"]: r for r in out.groupBy("valid_utc").agg(F.avg("lat").alias("m"), (F.max("lat") - F.min("lat")).alias("s"), F.percentile("vmax_ms", F.lit(0.5)).alias("v"), F.avg("dlat").alias("d")).collect()}
    assert math.isclose(per[t0 + timedelta(hours=48)]["m"], 14.8) and math.isclose(per[t0]["s"], 1.0) and math.isclose(per[t0]["v"], 20.0)
    full = per[t0 + timedelta(hours=48)]["d"]
    assert math.isclose(per[t0 + timedelta(hours=60)]["d"], full / 2) and math.isclose(per[t0 + timedelta(hours=72)]["d"], 0, abs_tol=1e-9)


def one(spark, col):
    return spark.range(1).select(col.alias("x")).first()["x"]


def test_scalars(spark):
    assert math.isclose(one(spark, geo.haversine_km(F.lit(10.0), F.lit(80.0), F.lit(11.0), F.lit(80.0))), 111.19, abs_tol=0.01)
    assert math.isclose(one(spark, wind.wind_to_ms(F.lit(100.0), F.lit("kt"))), 51.4444, abs_tol=1e-4)
    assert one(spark, wind.wind_to_ms(F.lit(90.0), F.lit("kmph"))) == 25 and one(spark, wind.wind_to_ms(F.lit(9.0), F.lit("mph"))) is None
    x, y = geo.to_utm(F.lit(81.0), F.lit(0.0))
    assert math.isclose(one(spark, x), 500000, abs_tol=1e-6) and math.isclose(one(spark, y), 0, abs_tol=1e-6)
    assert [one(spark, rainfall.rain_threshold_mm(F.lit(h))) for h in (0.0, 1.0, 4.8)] == [65.0, 115.0, None]
    assert math.isclose(one(spark, rainfall.rain_threshold_mm(F.lit(0.0), 0.6)), 95)
    curve = F.array(*[F.lit(v) for v in (0.0, 40.0, 80.0, 120.0)])
    assert [one(spark, rainfall.first_hour_reaching(curve, F.lit(t))) for t in (65.0, 115.0, 999.0)] == [2, 3, None]


def test_formatting(spark):
    assert [one(spark, text.indian_group(F.lit(n))) for n in (334619, 999, 12345678)] == ["3,34,619", "999", "1,23,45,678"]
    assert [one(spark, text.people(F.lit(n))) for n in (334619, 12345, 87)] == ["3.3 lakh", "12,300", "90"]
    assert [one(spark, text.probability(F.lit(p))) for p in (0.343, 0.001)] == ["34%", "<1%"]
    assert one(spark, text.ist_time(F.lit("2025-10-26 17:00:00").cast("timestamp"))) == "22:30 IST"


def test_people_in_lakh_are_rounded_as_doubles(spark):
    assert one(spark, text.people(F.lit(115000))) == "1.1 lakh"
    got = spark.range(100_000, 10_000_000, 250).select("id", text.people(F.col("id")).alias("t")).collect()
    assert [r["t"] for r in got] == [f"{r['id'] / 1e5:.1f} lakh" for r in got]
    assert one(spark, text.people(F.lit(123456789012.0))) == f"{123456789012.0 / 1e5:.1f} lakh"


def test_days_of_phrases(spark):
    days = lambda t: [d.day for d in one(spark, text.parse_days(F.lit(t), 2025, 10))]
    assert days("26th to 29th October") == [26, 27, 28, 29] and days("28th & 29th") == [28, 29] and days("27th") == [27] and days("soon") == []
    assert days("28 & 29 October") == [28, 29] and days("29-31 Oct") == [29, 30, 31] and days("30 \u2013 31 November") == [30] and days("30 to 28") == []


def test_number_safety(spark):
    p = lambda t: one(spark, text.number_problems(F.lit(t), F.array(F.lit("a")), F.array(F.lit("a"))))
    assert p("No one is safe {{a}}") == [] and p("5 people {{a}}") == ["digit"] and p("౫ {{a}}") == ["digit"] and p("five {{ a }}") == ["number word"]
    assert p("{{b}} %") == ["percent sign", "unknown: b", "missing: a"]


@pytest.mark.parametrize("words", ["thirteen people", "half the town", "a dozen roads", "zero risk", "Billions", "ninety per cent", "hundreds", "two"])
def test_number_words_are_unsafe(spark, words):
    none = F.array().cast("array<string>")
    assert one(spark, text.number_problems(F.lit(f"about {words} there"), none, none)) == ["number word"]


def test_words_with_number_words_inside_are_safe(spark):
    none = F.array().cast("array<string>")
    assert one(spark, text.number_problems(F.lit("no one often weighs a tenth behalf of seventh heaven"), none, none)) == []


def test_probability_limits_and_languages(spark):
    assert [one(spark, text.probability(F.lit(p))) for p in (0.004, 0.007, 0.994, 0.996)] == ["<1%", "1%", "99%", ">99%"]
    at = F.lit("2025-10-28 17:00:00").cast("timestamp")
    assert one(spark, text.local_time(at)) == "28 Oct, 22:30 IST" and one(spark, text.local_time(at, "hi-IN")) == "28 अक्टूबर, 22:30 IST"
    assert one(spark, text.people(F.lit(334619), "te-IN")) == "3.3 లక్షలు"
    assert one(spark, text.clean_name(F.lit("PHC,Rachapalli"))) == "PHC Rachapalli" and one(spark, text.clean_name(F.lit("A,B, C"))) == "A, B, C"
    assert one(spark, text.range_text(F.lit("1"), F.lit("2"))) == "1 to 2"


def test_sites_are_classified(spark):
    tags = [
        {"amenity": "hospital", "name": "Government General Hospital, Kakinada"},
        {"amenity": "hospital", "name": "Area Hospital Peddapuram"},
        {"amenity": "clinic", "name": "Community Health Centre Tuni"},
        {"name": "PHC Gollaprolu"},
        {"amenity": "hospital", "name": "Sri Sai Nursing Home"},
        {"amenity": "doctors", "name": "Dr. Clinic"},
        {"amenity": "shelter", "shelter_type": "public_transport", "name": "Bus stop"},
        {"name": "Cyclone Shelter Uppada"},
        {"power": "substation", "voltage": "132000;33000", "name": "Samalkot SS"},
    ]
    df = spark.createDataFrame([("node", k + 1, t) for k, t in enumerate(tags)], "osm_type string, osm_id bigint, tags map<string,string>")
    got = {r["poi_id"]: (r["type"], r["confidence"], r["voltage_kv"]) for r in text.classify_pois(df).collect()}
    assert got == {
        "osm_n1": ("district_hospital", "high", None),
        "osm_n2": ("sdh_area_hospital", "high", None),
        "osm_n3": ("chc", "high", None),
        "osm_n4": ("phc", "medium", None),
        "osm_n5": ("hospital_other", "low", None),
        "osm_n8": ("shelter", "medium", None),
        "osm_n9": (None, None, 132.0),
    }
    t = spark.createDataFrame([("phc",), ("district_hospital",), ("hospital_other",)], "tier string")
    assert [r["target_tier"] for r in text.referral_targets(t).collect()] == ["chc", "sdh_area_hospital", "district_hospital"]


def test_projection_of_known_points(spark):
    """On the meridian the northing is the scaled arc; a degree of longitude at the equator is 111,319.49 m less the scale."""
    r = spark.range(1).select(*geo.to_utm(F.lit(81.0), F.lit(16.0)), *geo.to_utm(F.lit(82.0), F.lit(0.0))).first()
    a, f = 6378137.0, 1 / 298.257223563
    e2 = f * (2 - f)
    p = math.radians(16)
    arc = a * ((1 - e2 / 4 - 3 * e2**2 / 64 - 5 * e2**3 / 256) * p - (3 * e2 / 8 + 3 * e2**2 / 32 + 45 * e2**3 / 1024) * math.sin(2 * p) + (15 * e2**2 / 256 + 45 * e2**3 / 1024) * math.sin(4 * p) - 35 * e2**3 / 3072 * math.sin(6 * p))
    assert math.isclose(r[0], 500000, abs_tol=1e-6) and math.isclose(r[1], 0.9996 * arc, abs_tol=0.001)
    assert math.isclose(r[2], 500000 + 0.9996 * 111319.49 * (1 + math.radians(1) ** 2 / 6 / (1 - e2)), abs_tol=0.5) and abs(r[3]) < 1e-6


def test_facts_of_an_official_run_have_no_probabilities(spark):
    from cutoffs.operators.facts import build_facts

    at = datetime(2025, 10, 28, 17)
    no = [None] * 3
    d = spark.createDataFrame([("r", 1, "Kakinada", m, "21", at, "tonight", {"IMD": 1, "x": 50}, 1000.0, 334619.0, 500000.0, *no) for m in ("official",)] + [("r", 2, "Elsewhere", "ensemble", "21", at, "tonight", {"IMD": 1, "x": 1062}, 1000.0, 334619.0, 500000.0, 1.0, 2.0, 3.0)], "run_id string, district int, district_name string, mode string, bulletin_no string, issued_at timestamp, landfall_text string, members map<string,int>, pop_p10 double, pop_p50 double, pop_p90 double, fac_p10 double, fac_p50 double, fac_p90 double")
    f = spark.createDataFrame([("r", k, f"f{j}", "chc", None, j == 2, p, at, None if j == 1 else at) for k in (1, 2) for j, p in ((1, 0.2), (2, 0.9), (3, None))], "run_id string, district int, facility_id string, type string, name string, simulated boolean, p double, t10 timestamp, t90 timestamp")
    a = spark.createDataFrame([("r", 1, 1, "a", "bridge", "NH 16", "Tuni", "తుని", None, at, "other", 87.0, 0.4)], "run_id string, district int, rank int, action_id string, crossing string, road string, place string, place_te string, place_hi string, deadline timestamp, basis string, people double, p_event double")
    got = {(r["district"], r["fact_id"]): r for r in build_facts(d, f, a).collect()}
    assert not [k for k in got if k[0] == 1 and (k[1].endswith("_p") or "range" in k[1] or k[1] == "ensemble_size")]
    assert {k[1] for k in got if k[0] == 2} == {"provenance", "provenance_short", "district", "landfall_window", "ensemble_size", "pop_cut_p50", "pop_cut_range", "fac_risk_p50", "fac_risk_range", "fac1_name", "fac1_p", "fac1_window", "fac2_name", "fac2_p"}
    assert got[1, "district"]["te"] == "కాకినాడ" and got[2, "district"]["hi"] == "Elsewhere"
    assert got[2, "pop_cut_range"]["hi"] == "1,000 से 5.0 लाख तक" and got[2, "fac_risk_range"]["en"] == "1 to 3"
    assert got[1, "fac1_name"]["en"] == "CHC (SIMULATED)" and got[1, "fac1_name"]["required"] and not got[1, "fac2_name"]["required"]
    assert got[1, "act1_site"]["en"] == "bridge near Tuni on NH 16" and got[1, "act1_site"]["te"] == "తుని సమీపంలోని వంతెన (NH 16)" and got[1, "act1_site"]["hi"] == "Tuni के पास पुल (NH 16)"
    assert got[1, "act1_deadline"]["en"] == "28 Oct, 22:30 IST (other)" and got[1, "act1_people"]["en"] == "90"


def test_areas_by_name_region_and_state(spark):
    areas = spark.createDataFrame(
        [("Kakinada", [], "Coastal Andhra Pradesh & Yanam", "north_coastal"), ("Krishna district", ["Krishna"], "Coastal Andhra Pradesh & Yanam", "south_coastal"), ("Tirupati", [], "Rayalaseema", "rayalaseema"), ("East Godavari", ["East & West Godavari"], "Coastal Andhra Pradesh & Yanam", "north_coastal")],
        "name string, variants array<string>, subdivision string, region string",
    )
    says = ["Andhra Pradesh & Yanam of Puducherry", "coastal Andhra Pradesh & Yanam", "north coastal Andhra Pradesh", "Rayalaseema", "Kakinada and Krishna", "Telangana", "East & West Godavari", None]
    got = {}
    for r in rainfall.match_areas(spark.createDataFrame(list(enumerate(says)), "text_id int, text string"), areas, "Andhra Pradesh").collect():
        got.setdefault(r["text_id"], set()).add(r["area"])
    coastal = {"Kakinada", "Krishna district", "East Godavari"}
    assert got == {0: coastal | {"Tirupati"}, 1: coastal, 2: {"Kakinada", "East Godavari"}, 3: {"Tirupati"}, 4: {"Kakinada", "Krishna district"}, 5: {None}, 6: {"East Godavari"}, 7: {None}}


def test_bed_and_speed_of_links(spark):
    assert [one(spark, rainfall.bed_allowance(F.lit(c))) for c in ("motorway_link", "tertiary_link", "service", None)] == [1.0, 0.6, 0.3, 0.3]
    assert [round(3.6 * 1000 / one(spark, network.travel_time_s(F.lit(1000.0), F.lit(c)))) for c in ("primary_link", "living_street", "ferry")] == [35, 10, 20]


def test_lines_merge_with_rings_and_forks(spark):
    ways = [(1, 10, 11), (2, 11, 12), (3, 12, 10), (5, 20, 21), (4, 21, 22), (9, 30, 30), (6, 40, 41), (7, 41, 42), (8, 50, 41)]
    df = spark.createDataFrame([(w, a, b, 1.0) for w, a, b in ways], "way_id bigint, first bigint, last bigint, length double")
    got = {r["way_id"]: (r["component"], r["seq"]) for r in network.merge_lines(df).collect()}
    assert got == {1: (1, 0), 2: (1, 1), 3: (1, 2), 5: (4, 0), 4: (4, 1), 9: (9, 0), 6: (6, 0), 7: (6, 1), 8: (8, 0)}


def test_pointers_in_a_circle_are_an_error(spark):
    df = spark.createDataFrame([(1, 2), (2, 3), (3, 1)], "cell bigint, down bigint")
    with pytest.raises(ValueError):
        terrain.accumulate(df)


def test_daily_cap_within_one_second(spark):
    rows = [(k, datetime(2025, 10, 26, 0, 0, min(k // 7, 3)) if k else None) for k in range(60)]
    df = spark.createDataFrame(rows, "event_id int, ts timestamp")
    for cap in (0, 1, 10, 25, 100):
        got = {r["event_id"] for r in rules.daily_cap(df, cap).filter("allowed").collect()}
        assert got == ({0} if cap else set()) | set(range(1, min(60, cap + 1)))


def test_culverts_only_on_plain_roads(spark):
    e = spark.createDataFrame([(1, 0, 1, 100.0, "none", False), (2, 2, 3, 100.0, "bridge", False), (3, 4, 5, 100.0, "none", True), (4, 6, 7, 100.0, "none", None)], "edge_id bigint, u bigint, v bigint, length double, crossing_type string, tunnel boolean")
    line = lambda y, a=0.0, b=100.0: [(a, y), (b, y)]
    roads = spark.createDataFrame([(k, line(float(k))) for k in (1, 2, 3)] + [(4, line(4.0, 200.0, 300.0))], "road_id bigint, line array<struct<x:double,y:double>>")
    water = spark.createDataFrame([(1, [(40.0, -5.0), (40.0, 9.0)]), (2, [(45.0, -5.0), (45.0, 9.0)])], "water_id bigint, line array<struct<x:double,y:double>>")
    got = sorted((r["edge_id"], r["from_m"], r["to_m"], r["crossing_type"]) for r in network.insert_culverts(e, roads, water, 50.0).collect())
    assert got == [(1, 0.0, 30.0, "none"), (1, 30.0, 55.0, "culvert"), (1, 55.0, 100.0, "none"), (2, 0.0, 100.0, "bridge"), (3, 0.0, 100.0, "none"), (4, 0.0, 100.0, "none")]


def test_surge_needs_a_way_from_the_sea(spark):
    coast = spark.createDataFrame([(k, k * 1.0, 0.0, k * 1.0) for k in range(5)], "coast_id bigint, x_km double, y_km double, s_km double")
    # a low basin behind a ridge stays dry; the cells beside the sea flood
    cells = spark.createDataFrame([(r, c, 9.0 if r == 1 and c == 2 else 0.5, r * 1.0, c, r == 0) for r in range(3) for c in (2,)] + [(r, 4, 0.5, r * 1.0, 4, r == 0) for r in range(3)], "row int, col int, elev double, d_km double, coast_id bigint, seed boolean")
    m = spark.createDataFrame([(0, 3.0, 2.0, 1, 20.0), (1, 3.0, None, 1, 20.0)], "member int, peak_m double, s_landfall_km double, right_sign int, rmax_km double")
    track = spark.createDataFrame([(0, h, 2.0, 200.0 - 20 * h) for h in range(12)], "member int, hour int, x_km double, y_km double")
    got = {(r["member"], r["row"], r["col"]): (r["depth"], r["onset"]) for r in rainfall.member_surge(m, coast, cells, track, ["member"]).collect()}
    assert set(got) == {(0, 0, 2), (0, 0, 4), (0, 1, 4), (0, 2, 4)} and {t for _, t in got.values()} == {7.0}
    h = 3.0 * math.exp(-0.5 * ((4 - 22) / 40) ** 2)
    assert math.isclose(got[0, 2, 4][0], h - 0.083 * 2 - 0.5)


def test_report_routing(spark):
    rows = [(1, "road", True, "open", 0.8, None), (1, "road", True, "open", 0.79, None), (1, "bridge", True, "open", 0.9, "closed"), (9, "road", False, "unknown", 0.9, None)]
    df = spark.createDataFrame(rows, "asset_id int, kind string, location_ok boolean, passability string, confidence double, previous string")
    got = [r["decision"] for r in text.route_reports(df, spark.createDataFrame([(1,)], "asset_id int")).orderBy("asset_id", F.desc("confidence")).collect()]
    assert sorted(got) == ["auto_apply", "queue", "queue", "queue"]


def test_patch_draws_match_their_fractions(spark):
    cats = spark.createDataFrame([(0, 200.0, 300.0, 0.125), (0, 60.0, 200.0, 0.38), (0, 10.0, 60.0, 0.1)], "area int, lo double, hi double, frac double").withColumn("day", F.lit("2025-10-26").cast("date"))
    p = spark.range(20000).select(F.col("id").alias("patch"), F.lit(0).alias("area"), F.lit("2025-10-26").cast("date").alias("day"), rainfall.uniform(F.lit("r"), F.col("id")).alias("u"), F.lit(1.0).alias("q"))
    got = {r["total_mm"]: r["count"] / 20000 for r in rainfall.draw_totals(p, cats, ["patch"]).groupBy("total_mm").count().collect()}
    assert abs(got[300.0] - 0.125) < 0.012 and abs(got[200.0] - 0.255) < 0.015 and abs(got[0.0] - 0.62) < 0.015 and 60.0 not in got


def test_hourly_rain(spark):
    t = spark.createDataFrame([(1, datetime(2025, 10, 26).date(), 115.5)], "patch int, day date, total_mm double")
    cum = rainfall.hourly_curve(t, ["patch"], 30, F.lit("2025-10-26 00:00:00").cast("timestamp")).first()["cum"]
    assert cum[3] == 0 and math.isclose(cum[4], 115.5 / 24) and math.isclose(cum[27], 115.5)


def test_wind_profile_fits(spark):
    rows = [(40.0, 5.0, 40.0, 16.0, 960.0), (30.0, 4.0, 50.0, 15.0, None)]
    df = spark.createDataFrame(rows, "v_sfc double, v_trans double, rmax_km double, lat double, pc_hpa double")
    for r in wind.fit_holland(df).collect():
        peak = wind._peak(np.array([r["rmax_km"] * 1000]), np.array([r["b"]]), np.array([r["dp"]]), np.array([2 * 7.2921e-5 * math.sin(math.radians(r["lat"]))]))[0]
        assert 1.0 <= r["b"] <= 2.5
        if r["b_source"] == "default":
            assert math.isclose(peak * 0.8 + 0.5 * r["v_trans"], r["v_sfc"], rel_tol=0.02)


def test_valley_heights(spark):
    n, mid = 21, 10
    cells = [(r, c, float(abs(c - mid) + (n - 1 - r) * 0.05 + 1), r == n - 1 or c in (0, n - 1) or r == 0, False) for r in range(n) for c in range(n)]
    df = spark.createDataFrame(cells, "row int, col int, elev double, outlet boolean, water boolean")
    got = {(r["row"], r["col"]): r for r in terrain.height_above_drainage(df, stream_cells=15).collect()}
    assert got[15, mid]["hand"] == 0 and got[15, mid + 5]["hand"] > 4
    assert all(r["hand"] >= 0 and r["level"] >= r["elev"] for r in got.values())
    assert all(math.isfinite(r["level"]) for r in got.values())


def test_flow_directions_reach_outlets(spark):
    rng = np.random.default_rng(9)
    cells = [(r, c, float(rng.integers(0, 4)), r == 0) for r in range(12) for c in range(12)]
    lv = terrain.flood_levels(spark.createDataFrame(cells, "row int, col int, elev double, outlet boolean"))
    down = {r["cell"]: r["down"] for r in terrain.flow_directions(lv).collect()}
    for cell in down:
        seen = set()
        while down[cell] != cell:
            assert cell not in seen
            seen.add(cell)
            cell = down[cell]
        assert cell // terrain.WIDE == 0


def test_flood_fill_stops_at_a_ridge(spark):
    wet = [(0, r, c, c == 0) for r in range(5) for c in range(9) if c != 4]
    got = terrain.flood_fill(spark.createDataFrame(wet, "member int, row int, col int, seed boolean"), ["member"]).collect()
    assert {r["col"] for r in got} == {0, 1, 2, 3}


def test_suppression_is_greedy(spark):
    rng = np.random.default_rng(8)
    rows = [(i % 2, i, float(x), float(y), float(s)) for i, (x, y, s) in enumerate(zip(rng.random(120) * 50, rng.random(120) * 50, rng.integers(0, 9, 120)))]
    want = set()
    for k in (0, 1):
        kept = []
        for r in sorted((r for r in rows if r[0] == k), key=lambda r: (-r[4], r[1])):
            if all(math.hypot(r[2] - q[2], r[3] - q[3]) > 8 for q in kept):
                kept.append(r)
        want |= {r[1] for r in kept}
    df = spark.createDataFrame(rows, "district int, id bigint, x double, y double, score double")
    assert {r["id"] for r in spatial.suppress(df, 8.0, "score", ["district"]).collect()} == want


def test_names_merge_within_radius(spark):
    rows = [("phc", 1, 0.0, 0.0, "PHC Kota", 1), ("phc", 2, 100.0, 0.0, "phc  kota!", 0), ("phc", 3, 900.0, 0.0, "PHC Kota", 2), ("chc", 4, 0.0, 0.0, "PHC Kota", 2), ("phc", 5, 0.0, 0.0, "", 2)]
    df = spark.createDataFrame(rows, "kind string, id bigint, x double, y double, name string, rank int")
    assert {r["id"] for r in spatial.dedupe(df, 150.0, "rank").collect()} == {2, 3, 4, 5}


@pytest.mark.parametrize("dists, length", [([50.0], 100.0), ([5.0, 95.0], 100.0), ([20.0, 30.0, 30.04], 60.0), ([], 40.0), ([10.2], 20.6)])
def test_culvert_pieces_cover_their_edge(spark, dists, length):
    df = spark.createDataFrame([(1, 10, 11, length, dists)], "edge_id bigint, u bigint, v bigint, length double, dists array<double>")
    p = network.culvert_pieces(df).orderBy("k").collect()
    assert p[0]["a"] == 0 and p[-1]["b"] == length and p[0]["from_node"] == 10 and p[-1]["to_node"] == 11
    assert all(x["b"] == y["a"] and x["to_node"] == y["from_node"] for x, y in zip(p, p[1:])) and all(x["b"] - x["a"] >= 0.5 for x in p)
    assert all(any(x["culvert"] and x["a"] <= d <= x["b"] for x in p) for d in dists) and all(x["from_node"] < 0 for x in p[1:])


def test_graph_of_ways(spark):
    xy = lambda ids: [(float(i), 0.0) for i in ids]
    rows = [(1, False, False, False, [1, 2, 3, 4]), (2, True, False, False, [3, 5]), (3, False, True, False, [5, 5]), (4, False, False, False, [6, 7, 6])]
    df = spark.createDataFrame([(*r, xy(r[4])) for r in rows], "way_id bigint, bridge boolean, ford boolean, tunnel boolean, node_refs array<bigint>, coords array<struct<x: double, y: double>>")
    got = {(r["u"], r["v"], r["crossing_type"], r["length"]) for r in network.build_graph(df).collect()}
    assert got == {(1, 3, "none", 2.0), (3, 4, "none", 1.0), (3, 5, "bridge", 2.0), (6, 6, "none", 2.0)}


def test_snap_flags_far_points(spark):
    nodes = spark.createDataFrame([(1, 0.0, 0.0, True), (2, 100.0, 0.0, True), (3, 95.0, 0.0, False)], "node_id bigint, x double, y double, component_main boolean")
    pts = spark.createDataFrame([(1, 96.0, 1.0), (2, 0.0, 9000.0)], "id bigint, x double, y double")
    got = {r["id"]: (r["node_id"], r["unsnapped"]) for r in spatial.snap(pts, nodes).collect()}
    assert got == {1: (2, False), 2: (1, True)}


def test_nearest_without_targets(spark):
    pts = spark.createDataFrame([(1, 1.0, 1.0)], "id bigint, x double, y double")
    none = spark.createDataFrame([], "rid bigint, rx double, ry double")
    assert spatial.nearest(pts, none, 1.0).first()["rid"] is None


def test_rate_limit_counts_accepted_hits_only(spark):
    times = [0, 1, 2, 61, 62, 62.5, 200]
    df = spark.createDataFrame([("k", float(t)) for t in times], "key string, s double").select("key", F.timestamp_seconds("s").alias("ts"))
    got = [r["allowed"] for r in rules.rate_limit(df, limit=2).orderBy("ts").collect()]
    want, _ = rules.accepted([float(t) for t in times], [], 2)
    assert got == want == [True, True, False, True, True, False, True]


def test_contingency(spark):
    df = spark.createDataFrame([("a", True, True), ("a", True, False), ("b", False, True)], "d string, p boolean, o boolean")
    got = {r["d"]: (r["pod"], r["far"], r["csi"]) for r in impact.contingency(df, F.col("p"), F.col("o"), ["d"]).collect()}
    assert got == {"a": (1.0, 0.5, 0.5), "b": (0.0, None, 0.0), None: (0.5, 0.5, 0.333)}


def test_track_csv_and_sinks(spark, tmp_path):
    (tmp_path / "t.csv").write_text("# note\n" + "init_time,track_id,sample,valid_time,lead_time,lat,lon,minimum_sea_level_pressure_hpa,maximum_sustained_wind_speed_knots,radius_of_maximum_winds_km\n" + "2025-10-25 00:00:00,A,1,2025-10-25 00:00:00,0,10,88,990,29,40\n2025-10-25 00:00:00,A,1,2025-10-25 06:00:00,6,11,87,985,31,40\n2025-10-25 00:00:00,B,1,2025-10-25 06:00:00,6,11,87,985,31,40\n")
    got = tracks.track_csv(spark, str(tmp_path / "t.csv"), "s", "A").orderBy("lead_h").collect()
    assert [r["lead_h"] for r in got] == [0, 6] and math.isclose(got[0]["vmax_ms"], 29 * 1852 / 3600)
    docs = sinks.documents({"rows": spark.createDataFrame([("a", 2), ("a", 1)], "k string, v int")}, "k")
    assert docs.first()["document"] == '{"k":"a","rows":[{"v":1},{"v":2}]}'
    sinks.write_documents(docs.withColumnRenamed("k", "district"), str(tmp_path / "runs/r1/x"), "district")
    m = sinks.manifest(spark, str(tmp_path), "*.csv").first()
    assert m["bytes"] == (tmp_path / "t.csv").stat().st_size and len(m["sha256"]) == 64


def test_missing_shape_is_an_error(spark):
    c = spark.createDataFrame([("x",), ("y",)], "k string")
    with pytest.raises(ValueError):
        tracks.all_found(c, spark.createDataFrame([("x", 1)], "k string, v int"), "k")


def test_bulletin_checks(spark):
    r = spark.createDataFrame([(1, "Wind over the bay", ["over the  bay"]), (2, "Wind", ["alien"])], "bulletin_id int, text string, quotes array<string>")
    f = spark.createDataFrame([(1, 0, 0.0, 15.0, 85.0, 40.0, "CS"), (1, 1, 6.0, 20.0, 85.0, 70.0, "CS"), (2, 0, 0.0, 15.0, 85.0, 40.0, "CS")], "bulletin_id int, seq int, lead_h double, lat double, lon double, wind_kt double, category string")
    got = {(x["bulletin_id"], x["check"]): x["status"] for x in text.reading_checks(r, f).collect()}
    assert got[1, "speed_plausible"] == "fail" and got[1, "wind_matches_category"] == "fail" and got[1, "quotes_verbatim"] == "pass" and got[2, "quotes_verbatim"] == "fail"


def test_population_is_conserved(spark):
    p = spark.range(400).select((F.col("id") % 7).alias("cell"), F.when(F.col("id") % 9 == 0, None).otherwise(F.col("id") % 5).cast("double").alias("value"), F.lit(0.0).alias("x"), F.lit(0.0).alias("y"))
    total = p.agg(F.sum("value")).first()[0]
    assert raster.population_cells(p, 0.0).agg(F.sum("population")).first()[0] == total
