"""Catchments, service areas and criticality against brute force on random graphs, in tasks and as joins."""

from __future__ import annotations

import heapq
import random

import pytest

from cutoffs.operators import catchments, criticality, reach

INF = float("inf")


def graph(seed, nodes, edges, loops=True):
    rng = random.Random(seed)
    out = [(rng.randrange(nodes), rng.randrange(nodes), float(rng.choice([0, 1, 1, 2, 3, 7, 40]))) for _ in range(edges)]
    return out + ([(5, 5, 1.0), (nodes + 7, nodes + 7, 2.0)] if loops else [])


def dijkstra(edges, sites):
    """{node: (seconds, site)}, the smallest of both."""
    nbr: dict = {}
    for u, v, s in edges:
        nbr.setdefault(u, []).append((v, s))
        nbr.setdefault(v, []).append((u, s))
    best = {n: (None, None) for n in nbr} | {n: (None, None) for n, _ in sites}
    heap = [(0.0, t, n) for n, t in sites]
    heapq.heapify(heap)
    while heap:
        d, t, n = heapq.heappop(heap)
        if best[n][0] is None or (d, t) < best[n]:
            best[n] = (d, t)
            for m, s in nbr.get(n, []):
                heapq.heappush(heap, (d + s, t, m))
    return best


@pytest.mark.parametrize(("bound", "delta"), [(10_000, None), (0, 15.0), (300, 100.0)])
def test_nearest_sites_are_dijkstra(spark, bound, delta):
    shapes = {0: graph(1, 120, 260), 1: graph(2, 60, 500), 2: graph(3, 150, 110)}
    sites = {0: [(3, "b"), (3, "a"), (50, "c"), (900, "d")], 1: [(0, "z")], 2: [(k, f"s{k % 7}") for k in range(0, 150, 11)]}
    e = spark.createDataFrame([(k, *r) for k, g in shapes.items() for r in g] + [(0, None, 3, 1.0), (0, 3, 4, None), (0, 3, 6, INF)], "member int, u bigint, v bigint, seconds double")
    t = spark.createDataFrame([(k, *r) for k, g in sites.items() for r in g] + [(1, None, "y"), (1, 7, None)], "member int, node bigint, site string")
    got = {(r["member"], r["node"]): (r["seconds"], r["site"]) for r in catchments.nearest_sites(e, t, ["member"], bound, delta).collect()}
    assert got == {(k, n): x for k in shapes for n, x in dijkstra(shapes[k], sites[k]).items()}


def test_one_network_serves_all_scenarios(spark):
    g = graph(4, 80, 160)
    e = spark.createDataFrame(g, "u bigint, v bigint, seconds double")
    sites = [("far", 3, 9), ("far", 60, 2), ("near", 11, 1)]
    t = spark.createDataFrame(sites, "class string, node bigint, site bigint")
    near = catchments.nearest_sites(e, t, ["class"])
    got = {(r["class"], r["node"]): (r["seconds"], r["site"]) for r in near.collect()}
    want = {(c, n): x for c in ("far", "near") for n, x in dijkstra(g, [(n, s) for k, n, s in sites if k == c]).items()}
    assert got == want
    people = spark.createDataFrame([(n, n % 7) for n in range(80)], "node bigint, population bigint")
    lost = spark.createDataFrame([*sites, ("near", 500, 77)], "class string, node bigint, site bigint")
    sizes = {(r["class"], r["site"]): (r["nodes"], r["people"], r["max_seconds"]) for r in catchments.catchment_sizes(near, people, lost, ["class"]).collect()}
    mine = [(n, d) for (c, n), (d, s) in want.items() if c == "near" and s == 1]
    assert sizes["near", 1] == (len(mine), sum(n % 7 for n, _ in mine), max(d for _, d in mine)) and sizes["near", 77] == (0, 0, None)


def test_no_edges_and_no_sites(spark):
    e = spark.createDataFrame([(0, 1, 2, 3.0)], "member int, u bigint, v bigint, seconds double")
    t = spark.createDataFrame([(0, 9, 4)], "member int, node bigint, site bigint")
    for bound in (10, 0):
        assert sorted(map(tuple, catchments.nearest_sites(e, t.limit(0), ["member"], bound).select("node", "seconds", "site").collect())) == [(1, None, None), (2, None, None)]
        assert [tuple(r) for r in catchments.nearest_sites(e.limit(0), t, ["member"], bound).select("node", "seconds", "site").collect()] == [(9, 0.0, 4)]
    with pytest.raises(Exception, match="negative"):
        catchments.nearest_sites(e.selectExpr("member", "u", "v", "-1d as seconds"), t, ["member"]).collect()


def plain_areas(edges, substations, demand):
    room = {s: INF if c is None else c for _, s, c in substations}
    at = {s: [n for n, x, _ in substations if x == s] for s in room}
    out, asking, step = {n: (None, None, None) for n in demand}, dict(demand), 0
    while room and asking:
        step += 1
        near = dijkstra(edges, [(n, s) for s in room for n in at[s]])
        full = set()
        for s in list(room):
            used = 0.0
            for n, d in sorted(((n, near[n][0]) for n in asking if n in near and near[n][1] == s), key=lambda x: (x[1], x[0])):
                used += asking[n]
                if used <= room[s]:
                    out[n] = (s, near[n][0], step)
                else:
                    full.add(s)
            room[s] -= sum(demand[n] for n, x in out.items() if x[0] == s and x[2] == step)
        asking = {n: a for n, a in asking.items() if out[n][0] is None}
        if not full:
            break
        room = {s: r for s, r in room.items() if s not in full}
    return out


@pytest.mark.parametrize("scale", [None, 40.0, 3.0])
def test_service_areas_are_brute_force(spark, scale):
    rng = random.Random(6)
    g = [(u, v, float(rng.randrange(30, 400))) for u, v, _ in graph(5, 150, 320, loops=False)]
    subs = [(n, s, None if scale is None else scale * k) for k, (n, s) in enumerate([(3, "a"), (40, "b"), (90, "c"), (141, "d"), (141, "e")], 1)]
    demand = {n: float(rng.randrange(1, 6)) for n in range(0, 150, 2)} | {999: 1.0}
    e = spark.createDataFrame(g, "u bigint, v bigint, seconds double")
    t = spark.createDataFrame(subs, "node bigint, site string, capacity double")
    d = spark.createDataFrame(list(demand.items()), "node bigint, amount double")
    got = {r["node"]: (r["site"], r["seconds"], r["round"]) for r in catchments.service_areas(e, t, d).collect()}
    assert got == plain_areas(g, subs, demand)


def scenarios(seed, ties):
    rng = random.Random(seed)
    rows, ends = [], []
    for m, (n, k) in enumerate([(40, 70), (90, 400), (60, 45), (2, 1)]):
        for e in range(k):
            rows.append((m, e + 1000 * m, rng.randrange(n), rng.randrange(n), float(rng.randrange(5)) if ties else rng.random() * 50))
        ends += [(m, x, rng.choice([INF, 3.0, 30.0])) for x in rng.sample(range(n), min(n, 4))]
    return rows, ends


def plain_behind(rows, ends, people):
    """{edge: people} of one scenario by Kruskal and by cutting each edge of the forest."""
    order = sorted([(-a, -2 - n, n, "*") for n, a in ends] + [(-c, e, u, v) for e, u, v, c in rows])
    up: dict = {}

    def root(x):
        while up.setdefault(x, x) != x:
            x = up[x]
        return x

    tree = []
    for _, e, u, v in order:
        if root(u) != root(v):
            up[root(u)] = root(v)
            tree.append((e, u, v))
    nbr: dict = {}
    for e, u, v in tree:
        nbr.setdefault(u, []).append((v, e))
        nbr.setdefault(v, []).append((u, e))
    out, stack, parent, seen = {}, ["*"], {}, []
    while stack:
        x = stack.pop()
        seen.append(x)
        for y, e in nbr.get(x, []):
            if y != parent.get(x, (None,))[0] and y not in parent and y != "*":
                parent[y] = (x, e)
                stack.append(y)
    total = {x: people.get(x, 0) for x in seen}
    for x in reversed(seen):
        if x != "*":
            p, e = parent[x]
            total[p] += total[x]
            if p != "*":
                out[e] = total[x]
    return out


@pytest.mark.parametrize(("bound", "ties"), [(10_000, True), (10_000, False), (0, True), (60, False)])
def test_people_behind_are_brute_force(spark, bound, ties):
    rows, ends = scenarios(7, ties)
    people = {n: n * n % 23 for n in range(80)}
    e = spark.createDataFrame(rows, "member int, edge_id bigint, u bigint, v bigint, c double")
    s = spark.createDataFrame(ends, "member int, node bigint, a double")
    p = spark.createDataFrame(list(people.items()), "node bigint, population bigint")
    got = {(r["member"], r["edge_id"]): r["people"] for r in criticality.people_behind(e, s, p, ["member"], bound).collect()}
    want = {(m, k): n for m in range(4) for k, n in plain_behind([r[1:] for r in rows if r[0] == m], [x[1:] for x in ends if x[0] == m], people).items()}
    assert got == want and len(got) > 60


def test_a_long_chain_takes_few_rounds(spark):
    n = 3000
    e = spark.createDataFrame([(0, k, k, k + 1, 5.0) for k in range(n)], "member int, edge_id bigint, u bigint, v bigint, c double")
    s = spark.createDataFrame([(0, 0, INF)], "member int, node bigint, a double")
    p = spark.createDataFrame([(k, 1) for k in range(n + 1)], "node bigint, population bigint")
    got = {r["edge_id"]: r["people"] for r in criticality.people_behind(e, s, p, ["member"]).collect()}
    assert got == {k: n - k for k in range(n)}


def test_criticality_is_the_mean_over_members(spark):
    times = spark.createDataFrame([(0, 1, 7), (0, 2, 7), (0, 3, -1), (1, 1, 7), (1, 2, 8), (2, 1, -1)], "member int, node bigint, critical_edge bigint")
    people = spark.createDataFrame([(1, 10), (2, 20), (3, 40)], "node bigint, population bigint")
    weights = spark.createDataFrame([(0, 0.5), (1, 0.25), (2, 0.25)], "member int, weight double")
    got = {r["edge_id"]: (r["people"], r["members"]) for r in criticality.criticality(times, people, weights).collect()}
    assert got == {7: (17.5, 2), 8: (5.0, 1)}


def test_forests_before_the_shuffle_change_nothing(spark, monkeypatch):
    """Thinning in small steps, and moving on what doesn't shrink, gives the hours and edges of one step."""
    rows, ends = scenarios(8, True)
    e = spark.createDataFrame(rows, "member int, edge_id bigint, u bigint, v bigint, c double")
    s = spark.createDataFrame(ends, "member int, node bigint, a double")
    one = sorted(map(tuple, reach.isolation_times(e, s, ["member"]).collect()))
    monkeypatch.setattr(reach, "HELD", 50)
    assert sorted(map(tuple, reach.isolation_times(e, s, ["member"]).collect())) == one


def test_arcs_longer_than_the_bound_of_their_end_go(spark, monkeypatch):
    """A large scenario whose sites are near loses most arcs, fits a task then, and is the same."""
    rng = random.Random(9)
    g = [(u, 1000 + v, float(rng.randrange(10, 910))) for u in range(150) for v in rng.sample(range(40), 20)]
    sites = [("any", 1000 + v, v) for v in range(0, 40, 3)] + [("higher", 1000 + v, v) for v in range(0, 40, 7)]
    e = spark.createDataFrame(g, "u bigint, v bigint, seconds double")
    t = spark.createDataFrame(sites, "class string, node bigint, site bigint")
    monkeypatch.setattr(catchments, "_waves", lambda *a: pytest.fail("rounds as joins"))
    got = {(r["class"], r["node"]): (r["seconds"], r["site"]) for r in catchments.nearest_sites(e, t, ["class"], 2000).collect()}
    assert got == {(c, n): x for c in ("any", "higher") for n, x in dijkstra(g, [(n, s) for k, n, s in sites if k == c]).items()}


def test_rounds_of_service_areas_read_the_edges_once(spark):
    g = [(u, v, s + 1) for u, v, s in graph(8, 60, 150, loops=False)]
    seen = spark.sparkContext.accumulator(0)

    def counted(frames):
        for f in frames:
            seen.add(len(f))
            yield f

    e = spark.createDataFrame(g, "u bigint, v bigint, seconds double").mapInPandas(counted, "u bigint, v bigint, seconds double")
    subs, demand = [(3, "a", 4.0), (40, "b", 8.0), (50, "c", 90.0)], {n: 1.0 for n in range(60)}
    areas = catchments.service_areas(e, spark.createDataFrame(subs, "node bigint, site string, capacity double"), spark.createDataFrame(list(demand.items()), "node bigint, amount double"))
    got = {r["node"]: (r["site"], r["seconds"], r["round"]) for r in areas.collect()}
    assert got == plain_areas(g, subs, demand) and max(r for _, _, r in got.values() if r) > 1
    assert seen.value == len(g)
