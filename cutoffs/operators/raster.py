"""Rasters as pixel tables (tile, row, col, value): resampling, sampling, masks, neighbourhoods, scene statistics."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Offsets to the eight neighbours of a cell.
NEIGHBOURS = [(i, j) for i in (-1, 0, 1) for j in (-1, 0, 1) if (i, j) != (0, 0)]


def clip(pixels: DataFrame, west: float, east: float, south: float, north: float) -> DataFrame:
    return pixels.filter(F.col("lon").between(west, east) & F.col("lat").between(south, north))


def mosaic(pixels: DataFrame, factor: int, how: str = "avg", keys: list[str] | None = None) -> DataFrame:
    """Coarser pixels: average or maximum of factor x factor cells; missing values do not count."""
    agg = {"avg": F.avg, "max": F.max}[how]("value").alias("value")
    return pixels.groupBy(*(keys or []), F.floor(F.col("row") / factor).alias("row"), F.floor(F.col("col") / factor).alias("col")).agg(agg)


def cell_of(lon: Column, lat: Column, west: float, north: float, step: float) -> tuple[Column, Column]:
    """(row, col) of the cell that holds a point; rows count from the north."""
    return F.floor((north - lat) / step), F.floor((lon - west) / step)


def sample(points: DataFrame, pixels: DataFrame, default: float | None = None, name: str = "value") -> DataFrame:
    """points (row, col) with the value of their cell; `default` outside and where the cell has none."""
    p = pixels.select("row", "col", F.col("value").alias(name))
    out = points.join(p, ["row", "col"], "left")
    return out if default is None else out.withColumn(name, F.coalesce(name, F.lit(default)))


def neighbours(cells: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Pairs of adjacent cells, both in the table: keys, row, col, nrow, ncol."""
    keys = keys or []
    offs = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i, j in NEIGHBOURS])
    out = cells.select(*keys, "row", "col", F.explode(offs).alias("o"))
    out = out.select(*keys, "row", "col", (F.col("row") + F.col("o.i")).alias("nrow"), (F.col("col") + F.col("o.j")).alias("ncol"))
    return out.join(cells.select(*keys, F.col("row").alias("nrow"), F.col("col").alias("ncol")), [*keys, "nrow", "ncol"])


def terrain_masks(pixels: DataFrame, low_m: float = 4.0, water_share: float = 80.0) -> DataFrame:
    """pixels (row, col, elev, occurrence) with outlet (no elevation, or at or under 0), water, candidate and seed.

    A candidate lies low; a seed is a candidate next to an outlet.
    """
    p = pixels.withColumn("outlet", F.col("elev").isNull() | (F.col("elev") <= 0)).withColumn("water", F.coalesce(F.col("occurrence") >= water_share, F.lit(False)))
    p = p.withColumn("candidate", ~F.col("outlet") & (F.col("elev") <= low_m))
    sea = p.filter("outlet").select(F.col("row").alias("nrow"), F.col("col").alias("ncol"), F.lit(True).alias("_sea"))
    offs = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i, j in NEIGHBOURS])
    near = p.filter("candidate").select("row", "col", F.explode(offs).alias("o")).select("row", "col", (F.col("row") + F.col("o.i")).alias("nrow"), (F.col("col") + F.col("o.j")).alias("ncol"))
    seeds = near.join(sea, ["nrow", "ncol"]).groupBy("row", "col").agg(F.bool_or("_sea").alias("seed"))
    return p.join(seeds, ["row", "col"], "left").withColumn("seed", F.coalesce("seed", F.lit(False)))


def pixel_median(scenes: DataFrame, start: Column, stop: Column) -> DataFrame:
    """Median backscatter per pixel of the scenes in [start, stop)."""
    return scenes.filter((F.col("acquired") >= start) & (F.col("acquired") < stop)).groupBy("orbit", "row", "col").agg(F.percentile("vv", F.lit(0.5)).alias("median_vv"))


def focal_median(pixels: DataFrame, reach: int = 1) -> DataFrame:
    """Median over the square of cells up to `reach` away, the cell itself included."""
    offs = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in range(-reach, reach + 1) for j in range(-reach, reach + 1)])
    spread = pixels.select("row", "col", "value", F.explode(offs).alias("o")).select((F.col("row") + F.col("o.i")).alias("row"), (F.col("col") + F.col("o.j")).alias("col"), "value")
    med = spread.groupBy("row", "col").agg(F.percentile("value", F.lit(0.5)).alias("focal"))
    return pixels.join(med, ["row", "col"])


def flooded(pre: Column, post: Column, water: Column, slope: Column, hand: Column) -> Column:
    """Radar flood rule: dropped by over 3 dB to under -16 dB, no permanent water, flat, low above drainage."""
    return (post - pre < -3) & (post < -16) & ~water & (slope < 5) & (hand < 15)


def observed_mosaic(scenes: DataFrame, event: Column) -> DataFrame:
    """Per pixel the first scene after `event` of any orbit that has a scene before: obs_h (0 to 254) and vv."""
    before = scenes.filter(F.col("acquired") < event).select("orbit").distinct()
    hours = F.floor((F.unix_micros(F.col("acquired").cast("timestamp")) - F.unix_micros(event.cast("timestamp"))) / 3.6e9)
    after = scenes.filter(F.col("acquired") >= event).withColumn("obs_h", F.least(F.lit(254), F.greatest(F.lit(0), hours)).cast("int"))
    # orbits are few: scenes joined on them would be a task for each, so that a pixel's first scene of each is taken before
    first = after.groupBy("row", "col", "orbit").agg(F.min(F.struct("acquired", "orbit", "obs_h", "vv")).alias("m")).join(before, "orbit", "left_semi")
    return first.groupBy("row", "col").agg(F.min("m").alias("m")).select("row", "col", "m.orbit", "m.obs_h", "m.vv")


def observed_edges(samples: DataFrame) -> DataFrame:
    """Edges from samples (edge_id, k of 0 to 4, value 0/1/255): flooded at the middle or at two samples; null if unseen."""
    seen = F.col("value") != 255
    wet = (F.col("value") == 1).cast("int")
    agg = samples.groupBy("edge_id").agg(F.sum(F.when(seen, wet)).alias("_n"), F.max(F.when(F.col("k") == 2, F.when(seen, wet))).alias("_mid"), F.sum(seen.cast("int")).alias("observed"))
    return agg.select("edge_id", "observed", F.when(F.col("observed") > 0, (F.coalesce("_mid", F.lit(0)) == 1) | (F.col("_n") >= 2)).alias("flooded"))


def population_cells(pixels: DataFrame, least: float = 25.0) -> DataFrame:
    """(cell, population, x, y): positive pixel values by cell (weighted centroid), cells of at least `least`."""
    p = pixels.filter("value > 0")
    return p.groupBy("cell").agg(F.sum("value").alias("population"), (F.sum(F.col("x") * F.col("value")) / F.sum("value")).alias("x"), (F.sum(F.col("y") * F.col("value")) / F.sum("value")).alias("y")).filter(F.col("population") >= least)


def edge_minima(samples: DataFrame, end_m: float = 200.0) -> DataFrame:
    """(edge_id, min_hand_m, hand_u_end_m, hand_v_end_m) from samples (edge_id, dist, length, value) in one pass."""
    v = F.col("value")
    return samples.groupBy("edge_id").agg(F.min(v).alias("min_hand_m"), F.min(F.when(F.col("dist") <= end_m, v)).alias("hand_u_end_m"), F.min(F.when(F.col("dist") >= F.col("length") - end_m, v)).alias("hand_v_end_m"))


#: Metres of a step of heights; pixels and heights meet in order within a step.
STEP_M = 0.25


def exceedance(pixels: DataFrame, floods: DataFrame) -> DataFrame:
    """(row, col, p): weight of the members (patch, member, h, w) whose flood height is over hand + 0.3, by pixel patch.

    Pixels and heights of a patch are merged into one sorted list from the highest down, along which the weights add up, so
    that no pixel meets a height. A list is cut into steps of STEP_M metres, whose sums are added up first: a patch that
    holds much of the table is many lists. Patches without heights are left out; a pixel without a value has 0.
    """
    step = lambda t: F.floor(t / STEP_M).alias("_s")
    t = F.col("hand") + 0.3
    high = floods.groupBy("patch", "h").agg(F.sum("w").alias("w")).filter(F.col("h").isNotNull() & F.col("w").isNotNull())
    high = high.select("patch", F.lit(None).cast("int").alias("row"), F.lit(None).cast("int").alias("col"), F.col("h").alias("t"), "w", step(F.col("h")), F.lit(1).alias("_k"))
    kinds = {f.name: f.dataType for f in pixels.schema}
    high = high.withColumns({c: F.col(c).cast(kinds[c]) for c in ("row", "col")})
    low = pixels.join(floods.select("patch").distinct(), "patch", "left_semi").select("patch", "row", "col", t.alias("t"), F.lit(0.0).alias("w"), step(t), F.lit(0).alias("_k"))
    both = high.union(low)
    sums = both.groupBy("patch", "_s").agg(F.sum("w").alias("_w"))
    above = sums.select("patch", "_s", F.coalesce(F.sum("_w").over(Window.partitionBy("patch").orderBy(F.desc_nulls_last("_s")).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)).alias("_above"))
    # of equal heights the pixel comes first: its flood has to be higher
    down = Window.partitionBy("patch", "_s").orderBy(F.desc("t"), "_k").rowsBetween(Window.unboundedPreceding, 0)
    out = both.withColumn("_in", F.sum("w").over(down)).filter("_k = 0").join(above.withColumnRenamed("_s", "_s2").withColumnRenamed("patch", "_p2"), F.col("patch").eqNullSafe(F.col("_p2")) & F.col("_s").eqNullSafe(F.col("_s2")))
    return out.select("row", "col", F.when(F.col("t").isNull() | F.isnan("t"), 0.0).otherwise(F.col("_above") + F.col("_in")).alias("p"))


#: Cells of a histogram pass.
CELLS = 4096


def order_statistics(rows: DataFrame, value: str, ranks: list[int], cells: int = CELLS) -> dict[int, float]:
    """The values at the given ranks (from 0) among the values that are neither null nor NaN, which have to be finite.

    Distributed selection: a pass counts the values by cells of the interval in which a rank must be, keeps the cell that
    holds it, and takes that cell's smallest and largest value as the next interval, until they are one value. The driver
    sees `cells` counts for each interval; no task gets the values together. All ranks are followed in the same passes.
    """
    v = rows.select(F.col(value).cast("double").alias("v")).filter(F.col("v").isNotNull() & ~F.isnan("v"))
    low, high = v.agg(F.min("v"), F.max("v")).first()
    open_ = {r: (low, high, r) for r in ranks}
    found: dict[int, float] = {}
    while open_:
        for r, (a, b, _) in list(open_.items()):
            if a == b:
                found[r] = a
                del open_[r]
        spans = sorted({(a, b) for a, b, _ in open_.values()})
        if not spans:
            break
        cell = lambda a, b: F.least(F.floor((F.col("v") / 2 - a / 2) / (b / 2 - a / 2) * cells), F.lit(cells - 1))
        hits = F.array(*[F.when(F.col("v").between(a, b), F.struct(F.lit(i).alias("i"), cell(a, b).alias("cell"))) for i, (a, b) in enumerate(spans)])
        counted = v.select("v", F.explode(F.array_compact(hits)).alias("h")).groupBy("h.i", "h.cell").agg(F.count("*").alias("n"), F.min("v").alias("a"), F.max("v").alias("b")).orderBy("i", "cell").collect()
        for r, (a, b, k) in list(open_.items()):
            for c in counted:
                if (a, b) != spans[c["i"]]:
                    continue
                if k < c["n"]:
                    open_[r] = (c["a"], c["b"], k)
                    break
                k -= c["n"]
    return found


def percentiles(pixels: DataFrame, shares: list[float], value: str = "value", cells: int = CELLS) -> DataFrame:
    """One row of linear percentiles p10, p50 and so on (null without values), by `order_statistics`."""
    spark = pixels.sparkSession
    names = [f"p{round(100 * x)}" for x in shares]
    kept = pixels.filter(F.col(value).isNotNull() & ~F.isnan(F.col(value).cast("double")))
    n = kept.count()
    at = [x * (n - 1) for x in shares]
    ranks = sorted({k for x in at for k in (math.floor(x), math.ceil(x))}) if n else []
    got = order_statistics(kept, value, ranks, cells) if n else {}
    out = [got[math.floor(x)] + (got[math.ceil(x)] - got[math.floor(x)]) * (x - math.floor(x)) if n else None for x in at]
    return spark.range(1).select(*[F.lit(x).cast("double").alias(name) for x, name in zip(out, names, strict=True)])


def surge_summary(cells: DataFrame) -> DataFrame:
    """(row, col, p, depth_max_m, onset_h_mean) over members' wet cells (row, col, w, depth, onset)."""
    return cells.groupBy("row", "col").agg(F.sum("w").alias("p"), F.max("depth").alias("depth_max_m"), (F.sum(F.col("w") * F.col("onset")) / F.nullif(F.sum("w"), F.lit(0.0))).alias("onset_h_mean"))


