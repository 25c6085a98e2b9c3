"""Steps whose faults only show on larger tables, held against brute force on small ones."""

from __future__ import annotations

import math
from datetime import datetime, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from cutoffs.functions import text
from cutoffs.operators import criticality, network, raster, series, spatial


def test_near_dedup_of_the_pipeline_takes_its_bands_from_superminhash(spark, monkeypatch):
    import corpus_pipeline
    from cutoffs.llm import neardup, superminhash

    seen = []
    write = neardup.nodes
    monkeypatch.setattr(neardup, "nodes", lambda d, words, keys_of=neardup.bands: seen.append(keys_of) or write(d, words, keys_of))
    body = " ".join(f"w{k}" for k in range(200))
    docs = spark.createDataFrame([(1, body), (2, body + " end"), (3, "another text of a few words")], "doc_id bigint, text string")
    assert sorted(r["doc_id"] for r in corpus_pipeline.near_dedup(spark, docs, "").collect()) == [1, 3]
    assert seen == [superminhash.bands]


def test_people_that_round_up_to_a_thousand_are_grouped(spark):
    df = spark.createDataFrame([(n,) for n in (4, 994, 995, 996, 999, 1000, 99_960)], "n long")
    got = {r["n"]: r["p"] for r in df.select("n", text.people(F.col("n")).alias("p")).collect()}
    assert got == {4: "4", 994: "990", 995: "1,000", 996: "1,000", 999: "1,000", 1000: "1,000", 99_960: "1,00,000"}


def test_minutes_of_a_lead_are_exact(spark):
    t0 = datetime(2024, 1, 1)
    us = [0, 59_999_970, 60_000_000, 43_199 * 60_000_000 - 1]
    rows = [(1, [(t0 + timedelta(microseconds=u), 16.0, 82.0, 10.0, 20.0, "kt") for u in us])]
    df = spark.createDataFrame(rows, "bulletin_id int, forecast array<struct<valid_utc: timestamp, lat: double, lon: double, wind_min: double, wind_max: double, unit: string>>")
    got = series.official_track(df).selectExpr("lead_us", "lead_us div 60000000 AS m").orderBy("lead_us").collect()
    assert [tuple(r) for r in got] == list(zip(us, [0, 0, 1, 43_198]))


def test_positions_run_forwards_and_in_slices(spark):
    rng = np.random.default_rng(4)
    t0 = datetime(2024, 1, 1)
    fix = [(1, t0 + timedelta(hours=int(h)), float(h) ** 1.5, float(-h)) for h in (0, 1, 2, 7, 8, 30)]
    ask = [(1, t0 + timedelta(minutes=int(m))) for m in {*rng.integers(-90, 2000, 300), 0, 60, 420, 1800}]
    tracks = spark.createDataFrame(fix, "k int, valid_utc timestamp, lat double, lon double")
    times = spark.createDataFrame(ask, "k int, t_ref timestamp")
    df = series.positions_at(tracks, times, ["k"])
    assert "unboundedfollowing" not in df._jdf.queryExecution().toString().lower()
    want = sorted(map(repr, df.collect()))
    h, lat = [(f[1] - t0).total_seconds() for f in fix], [f[2] for f in fix]
    for r in df.collect():
        s = (r["t_ref"] - t0).total_seconds()
        assert (r["lat"] is None) if s < 0 or s > h[-1] else math.isclose(r["lat"], np.interp(s, h, lat), abs_tol=1e-9)
    assert sorted(map(repr, series.positions_at(tracks, times, ["k"], slice_s=3600.0).collect())) == want


def test_every_edge_that_closes_at_an_hour_sets_it(spark):
    times = spark.createDataFrame([(0, 1, 5.0, 7), (0, 2, 5.0, 7), (0, 3, 6.5, -1), (1, 1, 5.0, 9)], "member int, node bigint, b double, critical_edge bigint")
    edges = spark.createDataFrame([(0, 7, 5.0), (0, 8, 5.0), (0, 9, 6.0), (1, 9, 5.0)], "member int, edge_id bigint, c double")
    people = spark.createDataFrame([(1, 10), (2, 20), (3, 40)], "node bigint, population bigint")
    weights = spark.createDataFrame([(0, 0.75), (1, 0.25)], "member int, weight double")
    got = {r["edge_id"]: (r["people"], r["members"]) for r in criticality.criticality(times, people, weights, edges=edges).collect()}
    assert got == {7: (22.5, 1), 8: (22.5, 1), 9: (2.5, 1)}


def _apart(px, py, ax, ay, bx, by):
    d = (bx - ax) ** 2 + (by - ay) ** 2
    t = min(1.0, max(0.0, ((px - ax) * (bx - ax) + (py - ay) * (by - ay)) / d)) if d else 0.0
    return math.hypot(px - ax - t * (bx - ax), py - ay - t * (by - ay))


def test_long_segments_go_only_to_the_cells_that_they_pass(spark):
    rng = np.random.default_rng(5)
    pts = [(i, float(x), float(y)) for i, (x, y) in enumerate(rng.normal(0, 100, (400, 2)))]
    pts += [(400, 5000.0, -3000.0), (401, *pts[0][1:])]
    seg = [(k, *map(float, s)) for k, s in enumerate(rng.normal(0, 150, (60, 4)))]
    seg += [(60, 7.0, -900.0, 7.0, 900.0), (61, -900.0, 3.0, 900.0, 3.0), (62, 1.0, 1.0, 1.0, 1.0), (63, -1e6, -1e6, 1e6, 1e6 + 5)]
    s = spark.createDataFrame(seg, "line_id int, ax double, ay double, bx double, by double")
    p = spark.createDataFrame(pts, "id int, x double, y double")
    got = {r["id"]: r["dist"] for r in spatial.segment_nearest(p, s, 20.0).collect()}
    assert set(got) == {i for i, _, _ in pts}
    for i, x, y in pts:
        assert math.isclose(got[i], min(_apart(x, y, *q[1:]) for q in seg), abs_tol=1e-6)
    long = s.filter("line_id = 63")
    assert spatial.passed(long, 4.0, 1.0, -100.0, 100.0, -100.0, 100.0).count() < 300  # its box has 2,500 cells there


def test_each_crossing_is_made_once_in_any_number_of_parts(spark):
    rng = np.random.default_rng(6)
    line = lambda q: [(float(q[0]), float(q[1])), (float(q[2]), float(q[3]))]
    r, w = ([(k, line(q)) for k, q in enumerate(rng.normal(0, 100, (n, 4)))] for n in (90, 40))
    want = set()
    for i, ((ax, ay), (bx, by)) in r:
        for j, ((cx, cy), (dx, dy)) in w:
            det = (bx - ax) * (dy - cy) - (by - ay) * (dx - cx)
            t, u = ((cx - ax) * (dy - cy) - (cy - ay) * (dx - cx)) / det, ((cx - ax) * (by - ay) - (cy - ay) * (bx - ax)) / det
            if 0 <= t <= 1 and 0 <= u <= 1:
                want.add((i, j))
    roads = spark.createDataFrame(r, "road_id int, line array<struct<x: double, y: double>>")
    waters = spark.createDataFrame(w, "water_id int, line array<struct<x: double, y: double>>")
    for parts in (7, 10**7):
        got = [tuple(x) for x in spatial.crossings(roads, waters, 10.0, task_pairs=parts).select("road_id", "water_id").collect()]
        assert len(got) == len(want) and set(got) == want


def test_suppression_makes_no_pairs_of_all_points(spark):
    rng = np.random.default_rng(7)
    rows = [(i, float(x), float(y), float(s)) for i, (x, y, s) in enumerate(zip(rng.normal(0, 3, 4000), rng.normal(0, 3, 4000), rng.integers(0, 50, 4000)))]
    kept = []
    for r in sorted(rows, key=lambda r: (-r[3], r[0])):
        if all(math.hypot(r[1] - q[1], r[2] - q[2]) > 4 for q in kept):
            kept.append(r)
    df = spark.createDataFrame(rows, "id bigint, x double, y double, score double")
    met = spatial.near_pairs
    spatial.near_pairs = None  # 16 million pairs before
    try:
        assert {r["id"] for r in spatial.suppress(df, 4.0, "score", []).collect()} == {r[0] for r in kept}
    finally:
        spatial.near_pairs = met


def test_first_passes_are_found_before_orbits_are_joined(spark):
    t = lambda h: datetime(2024, 1, 1) + timedelta(hours=h)
    rows = [(1, t(-5), 0, 0, 1.0), (2, t(-9), 9, 9, 1.0), (3, t(1), 0, 0, 5.0), (1, t(4), 0, 0, 6.0), (2, t(4), 0, 0, 3.0), (1, t(3), 0, 1, 8.0), (1, t(3), 0, 1, 7.0)]
    df = spark.createDataFrame(rows, "orbit int, acquired timestamp, row int, col int, vv double")
    out = raster.observed_mosaic(df, F.lit("2024-01-01").cast("timestamp"))
    assert sorted(map(tuple, out.collect())) == [(0, 0, 1, 4, 6.0), (0, 1, 1, 3, 7.0)]
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("Aggregate [row") < plan.index("Join LeftSemi") < plan.index("Aggregate [row", plan.index("Join LeftSemi"))


def test_graph_building_takes_more_tasks_for_more_points(spark, monkeypatch):
    monkeypatch.setattr(spark.conf, "get", lambda k, *d, _get=spark.conf.get: "2" if k == "spark.sql.shuffle.partitions" else _get(k, *d))
    rows = [(w, w % 7 == 0, w % 11 == 0, False, [w, 1000 + w, 2000 + w, w + 1], [(float(w), float(k)) for k in (0, 3, 5, 9)]) for w in range(300)]
    way = spark.createDataFrame(rows, "way_id bigint, bridge boolean, ford boolean, tunnel boolean, node_refs array<bigint>, coords array<struct<x: double, y: double>>")
    out = network.build_graph(way, task_points=100)
    assert out.rdd.getNumPartitions() == 12 and network.build_graph(way).rdd.getNumPartitions() == 2
    assert out._jdf.queryExecution().executedPlan().toString().count(", 12)") >= 3  # both sides of the join, and the ways
    kind = lambda w: "ford" if w % 11 == 0 else "bridge" if w % 7 == 0 else "none"
    got = sorted((r["way_id"], r["u"], r["v"], r["length"], r["crossing_type"]) for r in out.collect())
    assert got == [(w, w, w + 1, 9.0, kind(w)) for w in range(300)]


def test_groups_of_block_keys_are_not_broadcast(spark, monkeypatch):
    """A plan takes them for as few as the fingerprints, which have 5 keys and more each."""
    from cutoffs import contraction
    from cutoffs.llm import simhash

    plans = []
    write = simhash.materialize
    monkeypatch.setattr(contraction, "BROADCAST_ROWS", 0, raising=False)
    monkeypatch.setattr(simhash, "materialize", lambda df: plans.append(df._jdf.queryExecution().executedPlan().toString()) or write(df))
    rng = np.random.default_rng(3)
    base = rng.integers(0, 1 << 62, 200).tolist()
    fps = spark.createDataFrame(list(enumerate(base + [b ^ 5 for b in base])), "doc_id bigint, fp bigint")
    got = {r["doc_id"]: r["component_id"] for r in simhash.components(fps).collect()}
    assert got == {k: k % 200 for k in range(400)}
    assert plans and not any("BroadcastHashJoin" in p for p in plans)


def test_manifest_hashes_files_that_are_too_large_for_one_value(spark, tmp_path):
    import hashlib

    from cutoffs.sources import sinks

    rng = np.random.default_rng(4)
    body = rng.integers(0, 256, 300_000, dtype=np.uint8).tobytes()
    mark = b"\xef\xbb\xbf"
    files = {"a b.bin": body, "end.bin": body + b"\n", "ends.bin": body + b"\r\n\n\n", "mark.bin": mark + body, "both.bin": mark + mark + body + b"\n", "lines.bin": b"\n" * 5000, "one.bin": b"x" * 5000, "short.bin": b"\r\nx"}
    (tmp_path / "sub dir").mkdir()
    for name, data in files.items():
        (tmp_path / ("sub dir" if name < "c" else ".") / name).write_bytes(data)
    conf = {"spark.sql.sources.binaryFile.maxLength": "4000", "spark.sql.files.maxPartitionBytes": "70000"}
    old = {k: spark.conf.get(k) for k in conf}
    for k, v in conf.items():
        spark.conf.set(k, v)
    try:
        whole = {"whole": 4000} if hasattr(sinks, "WHOLE") else {}
        got = sorted((r["bytes"], r["sha256"]) for r in sinks.manifest(spark, str(tmp_path), "*.bin", **whole).collect())
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)
    assert got == sorted((len(d), hashlib.sha256(d).hexdigest()) for d in files.values())


def test_segments_are_copied_for_blocks_and_not_for_each_task(spark, monkeypatch):
    rng = np.random.default_rng(8)
    kind = "array<struct<x: double, y: double>>"
    line = lambda q: [(float(q[0]), float(q[1])), (float(q[2]), float(q[3]))]
    r, w = ([(k, line(q)) for k, q in enumerate(rng.uniform(0, 1, (n, 4)))] for n in (900, 400))
    roads, waters = spark.createDataFrame(r, f"road_id int, line {kind}"), spark.createDataFrame(w, f"water_id int, line {kind}")
    want = spatial.crossings(roads, waters, 10.0).count()
    rows, dealt = [], type(roads).repartition
    monkeypatch.setattr(type(roads), "repartition", lambda df, *by: rows.append(df.count()) or dealt(df, *by))
    got = spatial.crossings(roads, waters, 10.0, task_pairs=100)
    # 360,000 pairs in blocks of 10 by 10: before, 3,600 tasks got 400 waters each
    assert len(rows) == 2 and sum(rows) <= 2 * 360_000 / 10
    assert got.count() == want


@pytest.mark.parametrize("most", [1, 256])
def test_near_copies_that_share_no_band_are_found(spark, monkeypatch, most):
    from cutoffs.llm import neardup

    monkeypatch.setattr(neardup, "PAIRS", most, raising=False)
    rng = np.random.default_rng(9)
    rows = []
    for base in range(12):
        words = [f"w{k}" for k in rng.integers(0, 10**6, 120)]
        for _ in range(4):
            copy = list(words)
            for k in rng.integers(0, 120, rng.integers(0, 5)):
                copy[k] = f"x{rng.integers(0, 10**6)}"
            rows.append((len(rows), " ".join([*copy, "a line of twelve words that most of the texts have in common"])))
    sets = neardup.shingles([t.encode() for _, t in rows])
    root = list(range(len(rows)))
    for _ in rows:
        root = [min(root[j] for j in range(len(rows)) if len(np.intersect1d(a, sets[j])) >= 0.8 * len(np.union1d(a, sets[j]))) for a in sets]
    alone = lambda sets: np.array([[int(neardup.mixed(s.sum(keepdims=True))[0] >> np.uint64(1)) + k for k in range(20)] for s in sets], dtype=np.int64).reshape(-1, 20)
    got = neardup.keep_one(spark.createDataFrame(rows, "doc_id int, text string"), keys_of=alone)
    assert sorted(r["doc_id"] for r in got.collect()) == sorted(set(root)) and len(set(root)) < 40
