"""Rainfall and surge hazards: warnings to coverage, category draws, hourly curves, closure hours, weights of effects."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cutoffs.session import materialize

#: Rain that roads bear without flooding (mm), depth per mm, largest depth, margin for a closed road (m).
R0_MM, K_M_PER_MM, H_MAX_M, CLOSED_M = 50.0, 0.02, 5.0, 0.3
#: Height of the road bed over the ground by class of road, in metres.
BED = {"motorway": 1.0, "motorway_link": 1.0, "trunk": 1.0, "trunk_link": 1.0, "primary": 1.0, "primary_link": 1.0, "secondary": 0.6, "secondary_link": 0.6, "tertiary": 0.6, "tertiary_link": 0.6}
BED_OTHER = 0.3
SURGE_DECAY_M_PER_KM = 0.083


def rain_threshold_mm(hand: Column, allowance: Column | float = 0.0) -> Column:
    """Rain that closes a road: null if none does (no height known, or more than the largest depth needed)."""
    need = hand + allowance + CLOSED_M
    return F.when(need < H_MAX_M, R0_MM + need / K_M_PER_MM)


def site_threshold_mm(hand: Column) -> Column:
    """As for roads, without allowance and without the largest depth."""
    return R0_MM + (hand + CLOSED_M) / K_M_PER_MM


def bed_allowance(road_class: Column) -> Column:
    table = F.create_map(*[x for k, v in BED.items() for x in (F.lit(k), F.lit(v))])
    return F.coalesce(F.try_element_at(table, F.coalesce(road_class, F.lit(""))), F.lit(BED_OTHER))


def flood_height(rain: Column) -> Column:
    return F.least(F.lit(H_MAX_M), F.greatest(F.lit(0.0), K_M_PER_MM * (rain - R0_MM)))


def uniform(*parts: Column) -> Column:
    """A number in [0, 1) that depends on the parts alone: 52 bits of their SHA-256."""
    text = F.concat_ws("|", *[p.cast("string") for p in parts])
    return F.conv(F.substring(F.sha2(text, 256), 1, 13), 16, 10).cast("double") / float(1 << 52)


def alongshore_profile(s: Column, peak: Column, s_peak: Column, rmax: Column) -> Column:
    d = (s - s_peak) / (2 * rmax)
    return peak * F.exp(-0.5 * d * d)


def surge_depth(profile: Column, coast_km: Column, elev: Column) -> Column:
    """Depth of water over a cell, null where it stays dry."""
    level = profile - SURGE_DECAY_M_PER_KM * coast_km
    return F.when(elev < level, level - elev)


def member_peak(guidance: Column, v: Column, v0: Column, landfall: Column) -> Column:
    return F.when(landfall, guidance * F.pow(v / v0, 2)).otherwise(F.lit(0.0))


def member_rmax_km(rmw_km: Column, v: Column, lat: Column) -> Column:
    from cutoffs.functions.wind import willoughby_rmax_km

    return F.when(rmw_km > 5, rmw_km).otherwise(willoughby_rmax_km(F.coalesce(v, F.lit(25.0)), lat))


#: Phrases for parts of a state, and the regions that they mean.
REGION_PHRASES = {"north coastal": "north_coastal", "south coastal": "south_coastal", "rayalaseema": "rayalaseema"}


def match_areas(texts: DataFrame, areas: DataFrame, state: str, phrases: dict[str, str] = REGION_PHRASES) -> DataFrame:
    """Which areas a text names: (text_id, area, tier), or a null area for a text to be reviewed.

    areas: name, variants ARRAY, subdivision, region. Only the best tier of a text counts. Tier 1: an area's name or
    variant stands in the text as words; 2: a phrase for a region, the first in the order given; 3: "coastal" and the
    state, for the areas of a coastal subdivision or region; 4: the state, for all areas. Names meet texts by their
    words, so that no text is held against the whole list.
    """
    norm = lambda c: F.trim(F.regexp_replace(F.regexp_replace(F.lower(c), "[^a-z ]", " "), " +", " "))
    padded = lambda c: F.concat(F.lit(" "), c, F.lit(" "))
    t = texts.select("text_id", norm(F.coalesce("text", F.lit(""))).alias("t"))
    names = areas.select(F.col("name").alias("area"), F.explode(F.concat(F.array("name"), F.coalesce("variants", F.array().cast("array<string>")))).alias("n")).select("area", norm(F.col("n")).alias("n")).filter("n <> ''").distinct()
    first_word = names.withColumn("w", F.split("n", " ")[0])
    words = t.select("text_id", "t", F.explode(F.array_distinct(F.split("t", " "))).alias("w"))
    named = words.join(first_word, "w").filter(F.contains(padded(F.col("t")), padded(F.col("n")))).select("text_id", "area").distinct().withColumn("tier", F.lit(1))
    # other texts: one of the regions, or a part of the state
    rest = t.join(named.select("text_id"), "text_id", "left_anti")
    region = F.lit(None).cast("string")
    for phrase, name in reversed(phrases.items()):
        region = F.when(F.contains("t", F.lit(phrase)), name).otherwise(region)
    whole = F.contains("t", norm(F.lit(state)))
    group = F.when(region.isNotNull(), F.concat(F.lit("region "), region)).when(whole & F.contains("t", F.lit("coastal")), "coastal").when(whole, "state")
    rest = rest.select("text_id", group.alias("g"), F.when(region.isNotNull(), 2).when(whole & F.contains("t", F.lit("coastal")), 3).when(whole, 4).alias("tier"))
    coastal = F.coalesce(F.startswith("subdivision", F.lit("Coastal")), F.lit(False)) | F.coalesce(F.endswith("region", F.lit("coastal")), F.lit(False))
    of = areas.select(F.col("name").alias("area"), F.explode(F.array_compact(F.array(F.concat(F.lit("region "), F.col("region")), F.when(coastal, "coastal"), F.lit("state")))).alias("g"))
    return named.union(rest.join(of.distinct(), "g", "left").select("text_id", "area", F.when(F.col("area").isNotNull(), F.col("tier"))))


def member_surge(members: DataFrame, coast: DataFrame, cells: DataFrame, track: DataFrame, keys: list[str], timing_km: float = 50.0, stretch_km: float = 25.0) -> DataFrame:
    """Surge of each member over low cells: (keys, row, col, depth, onset) of the cells that flood.

    members: keys, peak_m, s_landfall_km, right_sign, rmax_km. coast: coast_id, x_km, y_km, s_km. cells: row, col, elev,
    d_km, coast_id, seed. track: keys, hour, x_km, y_km. The peak stands rmax to the right of the landfall and falls off
    along the coast; the level falls with the distance from the coast; a cell floods where the level is over its
    elevation and wet cells join it to a seed. Onset is the first hour at which the member's centre is within
    rmax + timing_km of the cell's coast point, infinity if it never is. Members without a landfall (no s_landfall_km)
    flood nothing.
    """
    from cutoffs.operators import spatial, terrain

    # along the coast a member reaches as far as its water is over the lowest cell; places meet in stretches of the coast
    low = cells.groupBy("coast_id").agg(F.min(F.col("elev") + SURGE_DECAY_M_PER_KM * F.col("d_km")).alias("_low"))
    least = max(1e-3, low.agg(F.min("_low")).first()[0] or 0.0)
    peak_at = F.col("s_landfall_km") + F.col("right_sign") * F.col("rmax_km")
    reach = 2 * F.col("rmax_km") * F.sqrt(2 * F.log(F.col("peak_m") / least))
    m = members.filter(F.col("s_landfall_km").isNotNull() & (F.col("peak_m") > least)).withColumns({"_at": peak_at, "_reach": reach})
    m = m.withColumn("_b", F.explode(F.sequence(F.floor((F.col("_at") - F.col("_reach")) / stretch_km), F.floor((F.col("_at") + F.col("_reach")) / stretch_km))))
    line = coast.join(low, "coast_id").withColumn("_b", F.floor(F.col("s_km") / stretch_km))
    hit = m.join(line, "_b").withColumn("h", alongshore_profile(F.col("s_km"), F.col("peak_m"), F.col("_at"), F.col("rmax_km")))
    hit = hit.filter("h > _low").select(*keys, "coast_id", "h", "rmax_km", "x_km", "y_km")
    hit = materialize(hit)
    level = hit.select(*keys, "coast_id", "h").join(cells, "coast_id").withColumn("depth", surge_depth(F.col("h"), F.col("d_km"), F.col("elev")))
    wet = materialize(level.filter("depth is not null").select(*keys, "row", "col", "seed", "coast_id", "depth"))
    flooded = terrain.flood_fill(wet, keys)
    width = (members.agg(F.max("rmax_km")).first()[0] or 0.0) + timing_km
    left = hit.select(*keys, F.col("coast_id").alias("id"), F.col("x_km").alias("x"), F.col("y_km").alias("y"), "rmax_km")
    right = track.select(*keys, "hour", F.col("x_km").alias("rx"), F.col("y_km").alias("ry"))
    near = spatial.near_pairs(left, right, width, keys).filter(F.col("dist") <= F.col("rmax_km") + timing_km)
    onset = near.groupBy(*keys, F.col("id").alias("coast_id")).agg(F.min("hour").cast("double").alias("onset"))
    out = wet.join(flooded, [*keys, "row", "col"]).join(onset, [*keys, "coast_id"], "left")
    return out.select(*keys, "row", "col", "depth", F.coalesce("onset", F.lit(float("inf"))).alias("onset"))


def coverage_table(warnings: DataFrame, fractions: dict[str, float]) -> DataFrame:
    """(area, day, category, frac, needs_review): largest coverage of the warnings (area, days ARRAY, category, coverage)."""
    table = F.create_map(*[x for k, v in fractions.items() for x in (F.lit(k), F.lit(v))])
    w = warnings.select("area", F.explode("days").alias("day"), "category", F.try_element_at(table, F.col("coverage")).alias("frac"))
    return w.groupBy("area", "day", "category").agg(F.max("frac").alias("frac"), F.bool_or(F.col("frac").isNull()).alias("needs_review"))


def draw_totals(patches: DataFrame, table: DataFrame, keys: list[str]) -> DataFrame:
    """Rain of each patch (keys, area, day, u, q): categories (area, day, lo, hi, frac) nested from the heaviest down.

    The running maximum of the fractions is each category's limit; the first limit over u gives lo + q (hi - lo), or 0.
    """
    order = Window.partitionBy("area", "day").orderBy(F.desc("hi"), F.desc("lo"))
    limits = table.withColumn("cum", F.max("frac").over(order.rowsBetween(Window.unboundedPreceding, 0))).withColumn("k", F.row_number().over(order))
    nested = limits.groupBy("area", "day").agg(F.array_sort(F.collect_list(F.struct("k", "cum", "lo", "hi"))).alias("c"))
    hit = F.filter("c", lambda x: F.col("u") < x["cum"])
    total = F.when(F.size(hit) > 0, hit[0]["lo"] + F.col("q") * (hit[0]["hi"] - hit[0]["lo"])).otherwise(0.0)
    out = patches.join(nested, ["area", "day"], "left")
    return out.select(*keys, "area", "day", F.coalesce(F.when(F.col("c").isNotNull(), total), F.lit(0.0)).alias("total_mm"))


def hourly_curve(totals: DataFrame, keys: list[str], hours: int, now: Column, day_start_h: float = 3.0) -> DataFrame:
    """(keys, cum ARRAY): rain up to hour 0..hours after now; a day runs for 24 hours from day_start_h UTC of its date.

    Each hour takes 1/24 of the day that its end lies in.
    """
    start = (F.unix_date("day") * 24 + day_start_h) - F.unix_micros(now.cast("timestamp")) / 3.6e9
    spread = totals.select(*keys, F.explode(F.sequence(F.lit(1), F.lit(hours))).alias("h"), start.alias("s"), (F.col("total_mm") / 24).alias("r"))
    part = spread.filter((F.col("h") > F.col("s")) & (F.col("h") <= F.col("s") + 24)).groupBy(*keys, "h").agg(F.sum("r").alias("r"))
    by = part.groupBy(*keys).agg(F.map_from_entries(F.collect_list(F.struct("h", "r"))).alias("m"))
    every = totals.select(*keys).distinct().join(by, keys, "left")
    step = F.transform(F.sequence(F.lit(1), F.lit(hours)), lambda h: F.coalesce(F.try_element_at("m", h), F.lit(0.0)))
    cum = F.aggregate(step, F.array(F.lit(0.0)), lambda a, r: F.concat(a, F.array(F.element_at(a, -1) + r)))
    return every.select(*keys, F.when(F.col("m").isNull(), F.array_repeat(F.lit(0.0), hours + 1)).otherwise(cum).alias("cum"))


def first_hour_reaching(curve: Column, threshold: Column) -> Column:
    """First hour at which a rising curve reaches the threshold, null if it never does or there is none."""
    n = F.size(F.filter(curve, lambda x: x < threshold))
    return F.when(threshold.isNotNull() & (n < F.size(curve)), n)


def approach_heights(edges: DataFrame) -> DataFrame:
    """Adds hand_m: of a crossing the smallest height of the plain edges that meet its ends, of others their own."""
    plain = edges.filter("crossing_type = 'none'")
    ends = plain.select(F.col("u").alias("node"), F.col("hand_u_end_m").alias("h")).union(plain.select("v", "hand_v_end_m"))
    low = materialize(ends.groupBy("node").agg(F.min("h").alias("h")))
    out = edges.join(low.toDF("u", "_hu"), "u", "left").join(low.toDF("v", "_hv"), "v", "left")
    return out.withColumn("hand_m", F.when(F.col("crossing_type") == "none", F.col("min_hand_m")).otherwise(F.least("_hu", "_hv"))).drop("_hu", "_hv")


def edge_closures(edges: DataFrame, curves: DataFrame, onsets: DataFrame) -> DataFrame:
    """(member, edge_id, t_close) where there is one: the earlier of rain over the threshold and surge over the road bed.

    edges: edge_id, patch, threshold_mm, surge_cell, need_m. curves: member, patch, cum. onsets: member, surge_cell, depth, onset.
    """
    rain = edges.join(curves, "patch").select("member", "edge_id", first_hour_reaching(F.col("cum"), F.col("threshold_mm")).cast("double").alias("t"))
    surge = edges.join(onsets, "surge_cell").filter(F.col("depth") > F.col("need_m")).select("member", "edge_id", F.col("onset").cast("double").alias("t"))
    return rain.unionByName(surge).filter("t is not null").groupBy("member", "edge_id").agg(F.min("t").alias("t_close"))


def site_availability(sites: DataFrame, curves: DataFrame, onsets: DataFrame, landfall_h: int) -> DataFrame:
    """(member, site_id, avail, rain_at_landfall): first hour of rain or surge at a site, null for never."""
    both = sites.join(curves, "patch").join(onsets, ["member", "surge_cell"], "left")
    surge = F.when(F.col("depth") > CLOSED_M, F.col("onset").cast("double"))
    rain = first_hour_reaching(F.col("cum"), F.col("threshold_mm")).cast("double")
    return both.select("member", "site_id", F.least(rain, surge).alias("avail"), F.try_element_at("cum", F.lit(landfall_h + 1)).alias("rain_at_landfall"))


def combine(*hours: Column) -> Column:
    """The earliest of several hours; null is never."""
    return F.least(*hours)
