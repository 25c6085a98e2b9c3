"""Branch and bound, distributed selection and sorted unions against plain brute force, with counts of what they compare."""

from __future__ import annotations

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from cutoffs.operators import raster, series


def km(a, b, c, d):
    p, q = math.radians(a), math.radians(c)
    h = math.sin((q - p) / 2) ** 2 + math.cos(p) * math.cos(q) * math.sin(math.radians(d - b) / 2) ** 2
    return 2 * 6371.0088 * math.asin(math.sqrt(min(1.0, h)))


def tracks_and_places(seed):
    rng = random.Random(seed)
    fixes = []
    for t in range(12):
        lat, lon = rng.uniform(-60, 80), rng.uniform(-180, 180)
        for _ in range(200):
            fixes.append((t, lat, lon))
            lat, lon = max(-89.0, min(89.0, lat + rng.gauss(0, 0.4))), (lon + rng.gauss(0.3, 0.4) + 180) % 360 - 180
    return fixes, [(k, rng.uniform(-85, 85), rng.uniform(-180, 180)) for k in range(40)] + [(90, 89.9, 10.0), (91, 0.0, 179.99), (92, 0.0, -179.99)]


def test_closest_approach_is_brute_force_and_makes_few_pairs(spark):
    fixes, places = tracks_and_places(1)
    t = spark.createDataFrame([*fixes, (3, None, 1.0)], "track int, lat double, lon double")
    p = spark.createDataFrame(places, "place int, lat double, lon double")
    want: dict = {}
    for k, a, b in fixes:
        for n, c, d in places:
            want[k, n] = min(km(a, b, c, d), want.get((k, n), math.inf))
    got = {(r["track"], r["place"]): r["km"] for r in series.closest_approach(t, p, ["track"]).collect()}
    assert got.keys() == want.keys() and all(math.isclose(got[k], want[k], abs_tol=1e-6) for k in want)
    counts = [x.count() for x in series.approach_steps(t, p, ["track"])]
    assert counts[0] == len(want)  # a row for each track and place, as in the result
    assert counts[-1] < 0.02 * len(fixes) * len(places) and sum(counts) < 0.3 * len(fixes) * len(places)


def test_box_bound_is_below_every_point(spark):
    rng = random.Random(2)
    rows = []
    for _ in range(400):
        s, w = rng.uniform(-90, 85), rng.uniform(-180, 175)
        n, e = min(90, s + rng.choice([0, 1, 20])), min(180, w + rng.choice([0, 1, 60]))
        lat, lon = rng.uniform(-90, 90), rng.uniform(-180, 180)
        least = min(km(lat, lon, s + (n - s) * i / 12, w + (e - w) * j / 12) for i in range(13) for j in range(13))
        rows.append((lat, lon, s, n, w, e, least))
    df = spark.createDataFrame([tuple(map(float, r)) for r in rows], "lat double, lon double, s double, n double, w double, e double, least double")
    got = df.select("least", series.box_km(*[F.col(c) for c in ("lat", "lon", "s", "n", "w", "e")]).alias("b")).collect()
    assert all(r["b"] <= r["least"] for r in got) and sum(r["b"] > 0.5 * r["least"] for r in got) > 200


@pytest.mark.parametrize("cells", [4096, 3])
def test_selection_by_histograms_is_the_sorted_list(spark, cells):
    rng = random.Random(3)
    values = [rng.gauss(0, 1) for _ in range(3000)] + [1e18, -1e300, 1e300, 5e-324] + [0.25] * 2000 + [rng.lognormvariate(0, 9) for _ in range(500)]
    df = spark.createDataFrame([(float(v),) for v in values] + [(None,), (float("nan"),)], "value double")
    order = sorted(values)
    ranks = [0, 1, 777, 2500, 3100, 4000, len(values) - 2, len(values) - 1]
    assert raster.order_statistics(df, "value", ranks, cells) == {r: order[r] for r in ranks}


def test_percentiles_are_linear(spark):
    values = [float(v) for v in np.random.default_rng(4).normal(size=501)]
    got = raster.percentiles(spark.createDataFrame([(v,) for v in values], "value double"), [0.0, 0.1, 0.333, 1.0]).first()
    assert np.allclose([got[c] for c in ("p0", "p10", "p33", "p100")], np.quantile(values, [0, 0.1, 0.333, 1]))
    assert raster.percentiles(spark.createDataFrame([], "value double"), [0.5]).first()["p50"] is None


def test_exceedance_is_brute_force(spark):
    rng = random.Random(5)
    pixels = [(r, c, r % 3, rng.choice([None, round(rng.uniform(-1, 4), 1)])) for r in range(20) for c in range(20)] + [(99, 99, 7, 1.0)]
    floods = [(rng.randrange(3), m, round(rng.uniform(-1, 5), 1), float(rng.randrange(1, 6))) for m in range(90)] + [(0, 90, None, 3.0), (1, 91, 2.0, None)]
    p = spark.createDataFrame([(a, b, c, None if h is None else h) for a, b, c, h in pixels], "row int, col int, patch int, hand double")
    f = spark.createDataFrame(floods, "patch int, member int, h double, w double")
    got = {(r["row"], r["col"]): r["p"] for r in raster.exceedance(p, f).collect()}
    want = {(a, b): sum(w for q, _, x, w in floods if q == c and h is not None and x is not None and w is not None and x > h + 0.3) for a, b, c, h in pixels if c < 3}
    assert got == want
