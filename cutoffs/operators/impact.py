"""Impact: people and sites cut off by hour, actions, and scores against what was observed."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cutoffs.operators.spatial import radius_sum, suppress
from cutoffs.operators.stats import weighted_quantiles


def people_cut(cut: DataFrame, weights: DataFrame, hours: list[int], deterministic: bool = False) -> DataFrame:
    """(district, hour, p10, p50, p90) of the people cut off by each hour over members.

    cut: district, member, b (hour), population. People are first summed by the hour at which they are cut off, then run
    up over the hours. In deterministic mode the official member's value stands for all three.
    """
    last = max(hours)
    per = cut.filter(F.col("b") <= last).groupBy("district", "member", F.greatest(F.ceil("b"), F.lit(min(hours))).cast("int").alias("h")).agg(F.sum("population").alias("n"))
    by = per.groupBy("district", "member").agg(F.map_from_entries(F.collect_list(F.struct("h", "n"))).alias("m"))
    members = weights.select("member", "weight")
    grid = cut.select("district").distinct().join(F.broadcast(members)).join(by, ["district", "member"], "left")
    grid = grid.select("district", "member", "weight", "m", F.explode(F.array(*[F.lit(h) for h in hours])).alias("hour"))
    total = F.aggregate(F.map_values(F.map_filter("m", lambda k, _: k <= F.col("hour"))), F.lit(0.0), lambda a, x: a + x)
    flat = grid.select("district", "member", "hour", "weight", F.coalesce(total, F.lit(0.0)).alias("people"))
    if deterministic:
        return flat.filter("member = 0").select("district", "hour", *[F.col("people").alias(c) for c in ("p10", "p50", "p90")])
    return weighted_quantiles(flat.filter("weight > 0"), ["district", "hour"], "people", "weight", [0.1, 0.5, 0.9], ["p10", "p50", "p90"])


def sites_at_risk(iso: DataFrame, landfall_h: float) -> DataFrame:
    """(district, member, at_landfall, by_hour_rule): the two counts in use, on purpose not the same.

    iso: district, member, site, b. The headline leaves out sites without a route; the hourly rule (b <= t) counts them.
    """
    b = F.col("b")
    routed = (b > float("-inf")) & (b <= landfall_h)
    return iso.groupBy("district", "member").agg(F.count(F.when(routed, 1)).alias("at_landfall"), F.count(F.when(b <= landfall_h, 1)).alias("by_hour_rule"))


def closing_probability(closures: DataFrame, weights: DataFrame, least: float = 0.0) -> DataFrame:
    """(edge_id, p): weight of the members in which an edge closes, at least `least`."""
    return closures.join(weights, "member").groupBy("edge_id").agg(F.sum("weight").alias("p")).filter(F.col("p") >= least)


def actions(crossings: DataFrame, people: DataFrame, radius: float = 5000.0, apart: float = 1000.0, most: int = 25, lead_h: float = 6.0) -> DataFrame:
    """Ranked actions: score = people nearby x probability, at least one person, spread out, deadline before closing.

    crossings: district, id, x, y, p, p10_close. people: rid, rx, ry, population.
    """
    near = radius_sum(crossings, people, radius, "population").withColumnRenamed("total", "people")
    scored = crossings.join(near, "id").filter("people >= 1").withColumn("score", F.col("people") * F.col("p"))
    kept = suppress(scored, apart, "score", ["district"], most)
    rank = F.row_number().over(Window.partitionBy("district").orderBy(F.desc("score"), "id"))
    return kept.withColumn("deadline_h", F.greatest(F.col("p10_close") - lead_h, F.lit(0.0))).withColumn("rank", rank)


def badges(df: DataFrame) -> DataFrame:
    """Adds badges ARRAY and hides the probability in deterministic mode (kind, p, no_route, reachable, deterministic)."""
    b = F.array_compact(F.array(F.when((F.col("kind") == "hospital") & F.col("reachable"), "possible delivery point"), F.when(~F.col("reachable"), "referral isolation"), F.when(F.col("no_route"), "no mapped route")))
    return df.withColumn("badges", b).withColumn("p", F.when(~F.col("deterministic"), F.col("p")))


def contingency(df: DataFrame, pred: Column, obs: Column, keys: list[str]) -> DataFrame:
    """hits, misses, false alarms, POD, FAR and CSI (3 digits, null without cases) by keys, and in total (null keys)."""
    c = df.select(*keys, pred.alias("_p"), obs.alias("_o"))
    out = c.rollup(*keys).agg(F.count(F.when(F.col("_p") & F.col("_o"), 1)).alias("hits"), F.count(F.when(~F.col("_p") & F.col("_o"), 1)).alias("misses"), F.count(F.when(F.col("_p") & ~F.col("_o"), 1)).alias("false_alarms"))
    h, m, f = F.col("hits"), F.col("misses"), F.col("false_alarms")
    ratio = lambda a, b: F.round(a / F.nullif(b, F.lit(0)), 3)
    return out.withColumns({"pod": ratio(h, h + m), "far": ratio(f, h + f), "csi": ratio(h, h + m + f)})


def flag_top(df: DataFrame, keys: list[str], value: str, k: Column | str, smallest: bool = True, tie: str = "id") -> DataFrame:
    """Adds `flagged`: the k smallest (or largest) values of each key; nulls last, ties by id; k may differ by key."""
    order = F.asc_nulls_last(value) if smallest else F.desc_nulls_last(value)
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(order, tie))
    return df.withColumn("flagged", rank <= (F.col(k) if isinstance(k, str) else k))


def validation_report(edges: DataFrame, methods: list[str], district: str = "district") -> DataFrame:
    """District x method scores with totals; edges hold one boolean column per method and `observed` (null if unseen)."""
    long = edges.filter("observed is not null").select(district, "observed", F.explode(F.array(*[F.struct(F.lit(m).alias("method"), F.col(m).alias("pred")) for m in methods])).alias("m"))
    flat = long.select(F.col("m.method").alias("method"), district, "observed", F.col("m.pred").alias("pred"))
    per = contingency(flat, F.col("pred"), F.col("observed"), ["method", district]).filter("method is not null")
    unseen = edges.filter("observed is null").groupBy(district).agg(F.count("*").alias("not_observed"))
    return per.join(unseen, district, "left").withColumn("not_observed", F.coalesce("not_observed", F.lit(0)))
