"""Serving views over published tables: rankings, timelines, summaries, triggers, map features, track lines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cutoffs.functions import text


def ranked(df: DataFrame, key: str, value: str, n: int, tie: str = "id") -> DataFrame:
    """The n largest values of each key with their rank (ties by id); a report, so that n is its feature."""
    return df.withColumn("rank", F.row_number().over(Window.partitionBy(key).orderBy(F.desc_nulls_last(value), tie))).filter(F.col("rank") <= n)


def timeline(df: DataFrame, deciles: str = "deciles") -> DataFrame:
    """A row for each decile that is reached: id, hour, p = k / 10."""
    return df.select("id", F.posexplode(deciles).alias("k", "hour")).filter((F.col("hour").isNotNull()) & (F.col("hour") < 999)).select("id", "hour", ((F.col("k") + 1) / 10).alias("p"))


def district_summary(sites: DataFrame, landfall: float) -> DataFrame:
    """Per district: sites, sites at risk at landfall (p >= 0.3), largest p, people of the sites."""
    return sites.groupBy("district").agg(F.count("*").alias("sites"), F.count(F.when(F.col("p") >= 0.3, 1)).alias("at_risk"), F.max("p").alias("max_p"), F.sum("people").alias("people"), F.count(F.when(F.col("hour") <= landfall, 1)).alias("by_landfall"))


def at_risk(sites: DataFrame, most: int = 10, lang: str = "en-IN") -> DataFrame:
    """(district, asked, rank, id, chance, window, simulated): sites by their chance of being cut off by landfall, the highest first.

    sites: district, id, type, p, t10, t90, simulated. A list for each type, and one for "any"; `most` rows of each, which is
    the feature of a spoken answer. Sites without a chance are in none; ties are in the order of ids. The window is the
    likely time among members in which the site is cut off, null if one of its ends is.
    """
    long = sites.filter("p is not null").withColumn("asked", F.explode(F.array(F.lit("any"), F.col("type")))).filter("asked is not null")
    top = long.withColumn("rank", F.row_number().over(Window.partitionBy("district", "asked").orderBy(F.desc("p"), "id"))).filter(F.col("rank") <= most)
    window = F.when(F.col("t10").isNotNull() & F.col("t90").isNotNull(), text.range_text(text.local_time(F.col("t10"), lang), text.local_time(F.col("t90"), lang), lang))
    return top.select("district", "asked", "rank", "id", text.probability(F.col("p")).alias("chance"), window.alias("window"), F.coalesce("simulated", F.lit(False)).alias("simulated"))


#: Facility and crossing probability, people of a district and near a crossing, stand-down.
FACILITY_P, DISTRICT_PEOPLE, CROSSING_P, CROSSING_PEOPLE, STAND_DOWN = 0.3, 100_000, 0.3, 10_000, 0.15


def triggers(items: DataFrame) -> DataFrame:
    """Items (run, id, kind, p, people) that call for action, by kind."""
    k = F.col("kind")
    hit = F.when(k.isin("facility", "shelter"), F.col("p") >= FACILITY_P).when(k == "district", F.col("people") >= DISTRICT_PEOPLE).when(k == "crossing", (F.col("p") >= CROSSING_P) & (F.col("people") >= CROSSING_PEOPLE)).otherwise(False)
    return items.filter(hit)


def stand_downs(items: DataFrame) -> DataFrame:
    """Items triggered in a run whose probability falls under STAND_DOWN in a later run: id, run, until."""
    later = items.select("id", F.col("run").alias("until"), F.col("p").alias("_p")).filter(F.col("_p") < STAND_DOWN)
    t = triggers(items).select("id", "run")
    return t.join(later, "id").filter("until > run").groupBy("id", "run").agg(F.min("until").alias("until"))


def map_features(edges: DataFrame) -> DataFrame:
    """JSON lines of map features: deciles with 999 for never, no-route flag, least zoom; never affected ones are left out.

    edges: id, deciles ARRAY, p, no_route_share, major, crossing_type.
    """
    zoom = F.when(F.col("major") | (F.col("crossing_type") != "none") | (F.col("p") > 0.05), 6).otherwise(11)
    kept = edges.filter((F.col("p") > 0) | (F.col("no_route_share") > 0.5))
    d = F.transform("deciles", lambda x: F.coalesce(x.cast("double"), F.lit(999.0)))
    return kept.select("id", zoom.alias("min_zoom"), F.to_json(F.struct("id", d.alias("d"), "p", (F.col("no_route_share") > 0.5).alias("no_route"))).alias("line"))


def track_lines(tracks: DataFrame, keys: list[str], official: Column, hour: Column) -> DataFrame:
    """(keys, points): tracks in order, the ensemble thinned to every third hour; two points at least."""
    t = tracks.withColumn("_h", hour).filter(official | (F.col("_h") % 3 == 0))
    line = t.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("_h", "lon", "lat"))).alias("p"))
    return line.filter(F.size("p") >= 2).select(*keys, F.transform("p", lambda x: F.struct(x["lon"].alias("x"), x["lat"].alias("y"))).alias("points"))


def storm_summary(members: DataFrame, districts: DataFrame) -> DataFrame:
    """One row: members without the official one, longest lead, districts by people, the leading district."""
    m = members.agg(F.countDistinct(F.when(F.col("source") != "official", F.struct("source", "member_no"))).alias("members"), F.max("lead_h").alias("lead_h"))
    d = districts.agg(F.count("*").alias("districts"), F.max_by("district", F.struct("people", "district")).alias("leading"))
    return m.join(F.broadcast(d))
