"""Needs, births, timed actions and staging by hand and against plain greedy and Dijkstra."""

from __future__ import annotations

import math
import random

import pytest

from cutoffs.operators import catchments, impact, moves
from tests.test_networks import dijkstra, graph

INF = float("inf")


def test_reachable_is_a_bounded_dijkstra_of_each_site(spark):
    g = graph(11, 90, 200)
    sites = [(3, "a"), (40, "b"), (41, "c"), (3, "d"), (7000, "e")]
    e = spark.createDataFrame(g, "u bigint, v bigint, seconds double")
    t = spark.createDataFrame(sites, "node bigint, site string")
    got = {(r["site"], r["node"]): r["seconds"] for r in catchments.reachable(e, t, 6.0, 2.5).collect()}
    want = {(s, n): d for node, s in sites for n, (d, _) in dijkstra(g, [(node, s)]).items() if d is not None and d <= 6}
    assert got == want


def plain_cover(covers, weights, most):
    sets: dict = {}
    for s, i in covers:
        if weights.get(i, 0) > 0:
            sets.setdefault(s, set()).add(i)
    out, have = [], set()
    while len(out) < most:
        best = min(((-sum(weights[i] for i in x - have), s) for s, x in sets.items()), default=(0, None))
        if best[0] == 0:
            break
        out.append((len(out) + 1, best[1], -best[0]))
        have |= sets[best[1]]
    return out


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_cover_is_sequential_greedy(spark, seed):
    rng = random.Random(seed)
    weights = {i: float(rng.randrange(0, 9)) for i in range(60)}
    covers = [(s, rng.randrange(60)) for s in range(25) for _ in range(rng.randrange(1, 9))] + [(99, 1), (98, 1), (97, 500)]
    c = spark.createDataFrame([*covers, (None, 3), (5, None)], "site int, item int")
    w = spark.createDataFrame(list(weights.items()), "item int, weight double")
    for most in (3, 100):
        assert [tuple(r) for r in moves.cover(c, w, most).orderBy("place").collect()] == plain_cover(covers, weights, most)
    assert moves.cover(c.limit(0), w, 3).count() == 0


def test_births_and_needs(spark):
    times = spark.createDataFrame([(0, 1, 24.0), (1, 1, INF), (2, 1, -INF), (0, 2, 200.0)], "member int, site int, b double")
    sites = spark.createDataFrame([(1, 36500), (2, 1000)], "site int, people bigint")
    weights = spark.createDataFrame([(0, 0.5), (1, 0.25), (2, 0.25)], "member int, weight double")
    got = {r["site"]: tuple(r)[1:] for r in moves.expected_births(times, sites, weights, 96.0, 20.0).collect()}
    assert all(math.isclose(a, b) for a, b in zip(got[1], (0.0, 6.0, 8.0), strict=True)) and got[2] == (0, 0, 0)
    df = spark.createDataFrame([(1, True, None, 0.5, 0.49), (2, None, 0.6, None, 0.9), (3, False, 0.1, 0.1, 0.1)], "site int, power_likely boolean, p_power double, p_referral double, p_access double")
    assert sorted(map(tuple, moves.needs(df).collect())) == [(1, "delivery_kit", "referral"), (1, "dg_set", "power"), (2, "dg_set", "power"), (2, "outreach_camp", "access")]


def test_deadlines(spark):
    rows = [("d", "evacuate", 1, 100, 0.5, 20.0), ("d", "stage_machine", 2, 100, 0.5, 3.0), ("d", "move_births", 3, 10, 1.0, 40.0), ("d", "other", 4, 9, 1.0, 1.0), ("d", "dg_set", 5, 9, 1.0, None)]
    df = spark.createDataFrame(rows, "district string, type string, target int, people int, p_event double, p10_h double")
    got = {r["target"]: (r["deadline_h"], r["basis"], r["rank"]) for r in moves.timed(df, ["district"]).collect()}
    assert got == {1: (14.0, "P10 shelter access closure − 6 h", 1), 2: (0.0, "P10 closure − 6 h", 2), 3: (16.0, "P10 referral isolation − 24 h", 3)}
    assert moves.timed(df, ["district"], True).filter("target = 1").first()["basis"] == "official track shelter access closure − 6 h"


def test_ranked_actions_by_hand(spark):
    """People within 5 km, at least one; score = people x probability; a kilometre apart; six hours before closing."""
    c = spark.createDataFrame([("d", 1, 0.0, 0.0, 0.5, 20.0), ("d", 2, 500.0, 0.0, 0.9, 3.0), ("d", 3, 9000.0, 0.0, 0.4, 10.0), ("d", 4, 90000.0, 0.0, 1.0, 10.0), ("e", 5, 0.0, 0.0, 0.1, 7.0)], "district string, id int, x double, y double, p double, p10_close double")
    p = spark.createDataFrame([(1, 0.0, 100.0, 100.0), (2, 9000.0, 0.0, 500.0), (3, 4000.0, 0.0, 7.0)], "rid int, rx double, ry double, population double")
    got = sorted((r["district"], r["rank"], r["id"], r["people"], round(r["score"], 6), r["deadline_h"]) for r in impact.actions(c, p).collect())
    # 3 reaches the second and third settlement; 2 beats 1, which is too near it; nobody is near 4
    assert got == [("d", 1, 3, 507.0, 202.8, 4.0), ("d", 2, 2, 107.0, 96.3, 0.0), ("e", 1, 5, 107.0, 10.7, 1.0)]
