"""Steps that have to follow the size of their input, held against the plain way on small tables."""

from __future__ import annotations

from datetime import datetime, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from cutoffs.operators import network, reach, series

INF = float("inf")


def _hours(df, keys, edges):
    """Sorted (keys, node, hour); the edge that is said to set an hour closes then (edges at one hour may stand for another)."""
    closes = {(*[r[k] for k in keys], r["edge_id"]): r["c"] for r in edges.collect()}
    rows = df.collect()
    assert all(closes[(*[r[k] for k in keys], r["critical_edge"])] == r["b"] for r in rows if r["critical_edge"] >= 0)
    return sorted((*[r[k] for k in keys], r["node"], r["b"]) for r in rows)


def _network(spark, seed=3, nodes=60, n=200, share=0.25):
    rng = np.random.default_rng(seed)
    rows = [(k, int(rng.integers(nodes)), int(rng.integers(nodes)), INF if rng.random() < share else float(rng.integers(0, 9))) for k in range(n)]
    return spark.createDataFrame([*rows, (n, 300, 300, 1.0), (n + 1, 301, 301, INF), (n + 2, 302, 303, 4.0), (n + 3, 302, None, 4.0)], "edge_id bigint, u bigint, v bigint, c double")


@pytest.mark.parametrize("bound", [10_000, 0])
def test_edges_that_serve_all_scenarios_are_not_copied_before_they_are_contracted(spark, monkeypatch, bound):
    """The same as with a copy of all edges for each scenario, from few rows."""
    e = _network(spark)
    s = spark.createDataFrame([(m, node, a) for m in range(4) for node, a in ((3, 5.0 + m), (8, INF), (400 + m, 2.0))], "member int, node bigint, a double")
    hour = F.when(F.col("c") == INF, F.col("c")).otherwise((F.col("c") * 5 + F.col("member") * 2) % 9)
    copied = e.join(s.select("member").distinct()).withColumn("c", hour)
    want = _hours(reach.isolation_times(copied, s, ["member"], bound), ["member"], copied)
    seen = []
    rows = reach._rows
    monkeypatch.setattr(reach, "_rows", lambda edges, sources, keys: seen.append(edges.count()) or rows(edges, sources, keys))
    assert _hours(reach.isolation_times(e, s, ["member"], bound, hour), ["member"], copied) == want
    assert 0 < max(seen) < 0.6 * copied.count()


def test_large_scenarios_lose_what_is_open_in_one_of_them(spark, monkeypatch):
    """Members have other edges, so none is open in all; each is contracted by itself, and fits a task then."""
    e = _network(spark, 5, share=0.6).withColumn("member", (F.col("edge_id") % 2).cast("int"))
    s = spark.createDataFrame([(m, node, a) for m in range(2) for node, a in ((3, 5.0), (8, INF), (400, 2.0))], "member int, node bigint, a double")
    want = _hours(reach.isolation_times(e, s, ["member"]), ["member"], e)
    monkeypatch.setattr(reach, "isolation_in_rounds", lambda *a: pytest.fail("rounds as joins"))
    assert _hours(reach.isolation_times(e, s, ["member"], 40), ["member"], e) == want


def test_classes_of_targets_are_runs_of_their_own(spark):
    e = _network(spark, 6).withColumn("member", (F.col("edge_id") % 2).cast("int"))
    s = spark.createDataFrame([(k, m, node, a) for k in ("far", "near") for m in range(2) for node, a in ((3, 5.0), (8, INF), (401 + m, 2.0)) if k == "far" or node == 3], "target_class string, member int, node bigint, a double")
    copied = e.crossJoin(s.select("target_class").distinct())
    keys = ["member", "target_class"]
    for bound in (10_000, 0):
        want = _hours(reach.isolation_times(copied, s, keys, bound), keys, copied)
        assert _hours(reach.isolation_times(e, s, keys, bound), keys, copied) == want


def test_boxes_of_tracks_are_named_by_numbers(spark):
    """Names of boxes go through each shuffle; long ones were most of what it carried."""
    fixes = spark.createDataFrame([(1, float(k % 7) - 3, float(k % 11) * 40) for k in range(50)], "track int, lat double, lon double")
    places = spark.createDataFrame([(5, 1.0, 90.0), (6, -20.0, 359.0)], "place int, lat double, lon double")
    for step in series.approach_steps(fixes, places, ["track"])[:-1]:
        assert all(t == "bigint" for c, t in step.dtypes if c.startswith("_b"))


def _chains(ways):
    """{way: (component, seq)} by walking."""
    prev = {w: min(x for x, _, b in ways if b == a) for w, a, _ in ways if any(b == a for _, _, b in ways) and w == min(x for x, c, _ in ways if c == a)}
    prev = {w: p for w, p in prev.items() if w != p}
    out, heads = {}, {}
    for w, _, _ in ways:
        walk = [w]
        while walk[-1] in prev and prev[walk[-1]] not in walk:
            walk.append(prev[walk[-1]])
        ring = prev.get(walk[-1]) == w
        out[w] = (min(walk), walk.index(min(walk))) if ring else (walk[-1], len(walk) - 1)
        heads.setdefault(out[w][0], []).append(w)
    return {w: (min(heads[h]), k) for w, (h, k) in out.items()}


def test_rings_are_told_after_as_many_rounds_as_they_are_long(spark, monkeypatch):
    """Rings and chains of all lengths, in any order of ids; a table of many short ones takes few rounds."""
    rng = np.random.default_rng(7)
    ids, ways, node = iter(rng.permutation(5000).tolist()), [], 0
    for length in [*range(1, 20), 31, 32, 33, 64, 65, 100]:
        for ring in (False, True):
            ways += [(next(ids), node + k, node + (0 if ring and k + 1 == length else k + 1)) for k in range(length)]
            node += length + 1
    ways += [(next(ids), int(a), int(b)) for a, b in rng.integers(node, node + 60, (80, 2))]
    df = spark.createDataFrame([(*w, 1.0) for w in ways], "way_id bigint, first bigint, last bigint, length double")
    assert {r["way_id"]: (r["component"], r["seq"]) for r in network.merge_lines(df).collect()} == _chains(ways)
    short = spark.range(3000).selectExpr("id AS way_id", "id AS first", "CASE WHEN id % 3 = 2 THEN id - 2 ELSE id + 1 END AS last", "1d AS length")
    seen = []
    isempty = type(short).isEmpty
    monkeypatch.setattr(type(short), "isEmpty", lambda self: seen.append(1) or isempty(self))
    assert network.merge_lines(short).groupBy("seq").count().orderBy("seq").collect() == [(0, 1000), (1, 1000), (2, 1000)]
    assert len(seen) <= 5


def test_hours_between_fixes_are_made_after_the_last_shuffle(spark):
    """Hours are many times the fixes; each metric is linear between its own fixes, flat beyond, whole hours included."""
    rng, t0 = np.random.default_rng(8), datetime(2024, 1, 1)
    rows, want = [], {}
    for k in range(12):
        at = sorted({*rng.integers(0, 90 * 60, 7).tolist(), 600, 1200}) if k else [600]
        fix = [(m, None if rng.random() < 0.4 else float(rng.integers(50)), None if rng.random() < 0.9 else 1.5) for m in at]
        rows += [(k, t0 + timedelta(minutes=m), x, y) for m, x, y in fix]
        for h in range(-(-at[0] // 60), at[-1] // 60 + 1):
            value = []
            for c in (1, 2):
                own = [(f[0], f[c]) for f in fix if f[c] is not None]
                value.append(float(np.interp(h * 60, *zip(*own))) if len(own) > 1 else None)
            want[k, t0 + timedelta(hours=h)] = value
    df = series.hourly(spark.createDataFrame(rows, "k int, valid_utc timestamp, x double, y double"), ["k"], ["x", "y"])
    got = {(r["k"], r["valid_utc"]): [r["x"], r["y"]] for r in df.collect()}
    assert got.keys() == want.keys()
    assert all(g == pytest.approx(w) if w is not None else g is None for n in want for g, w in zip(got[n], want[n], strict=True))
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    assert 0 <= plan.index("Generate") < plan.index("Window")


def test_nodes_are_counted_by_supernode_and_not_copied_for_scenarios(spark, monkeypatch):
    e = _network(spark, share=0.7)
    s = spark.createDataFrame([(m, node, a) for m in range(5) for node, a in ((3, 5.0 + m), (8, INF), (400 + m, 2.0))], "member int, node bigint, a double")
    hour = F.when(F.col("c") == INF, F.col("c")).otherwise((F.col("c") * 5 + F.col("member") * 2) % 9)
    every = reach.isolation_times(e, s, ["member"], hour=hour).groupBy("member", "b").count()
    spread = []
    monkeypatch.setattr(reach, "_spread", lambda *x: spread.append(x))
    got = reach.hours_counted(e.drop("edge_id"), s, ["member"], hour)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, every.collect())) and not spread
