"""What to move before the roads close: needs of sites, births expected, timed actions, and where to stage machines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cutoffs.operators.catchments import nearest_sites, reachable
from cutoffs.operators.stats import weighted_quantiles
from cutoffs.session import materialize

#: Hours before an event by which an action has to be done, and what the event is called.
LEAD_H = {"stage_machine": 6.0, "dg_set": 12.0, "move_births": 24.0, "evacuate": 6.0}
EVENT = {"stage_machine": "closure", "dg_set": "power risk", "move_births": "referral isolation", "evacuate": "shelter access closure"}


def expected_births(times: DataFrame, sites: DataFrame, weights: DataFrame, end_h: float, rate: float) -> DataFrame:
    """(site, births_p10, births_p50, births_p90): births between a site's isolation and the end of the horizon.

    times: member, site, b (hour of isolation; infinity for never, minus infinity for no route from the beginning). sites:
    site, people. weights: member, weight. rate: births a year for 1000 people. A member in which a site keeps its route
    until end_h expects none there; one without a route expects them from hour 0 on.
    """
    days = F.greatest(F.lit(0.0), F.lit(end_h) - F.greatest(F.col("b"), F.lit(0.0))) / 24
    per = times.filter("b is not null").join(sites.select("site", "people"), "site").join(weights.filter("weight > 0"), "member")
    per = per.select("site", "weight", (F.col("people") * (rate / 1000) * days / 365).alias("births"))
    return weighted_quantiles(per, ["site"], "births", "weight", [0.1, 0.5, 0.9], ["births_p10", "births_p50", "births_p90"])


def needs(sites: DataFrame, least: float = 0.5) -> DataFrame:
    """(site, need, reason) by rule. sites: site, power_likely BOOLEAN, p_power, p_referral, p_access; null is no risk.

    Power at risk asks for a generator, referral isolation for a delivery kit and ambulance, lost patient access for a camp.
    """
    over = lambda c: F.coalesce(F.col(c) >= least, F.lit(False))
    rules = [("dg_set", "power", F.coalesce(F.col("power_likely"), F.lit(False)) | over("p_power")), ("delivery_kit", "referral", over("p_referral")), ("outreach_camp", "access", over("p_access"))]
    found = F.array_compact(F.array(*[F.when(c, F.struct(F.lit(n).alias("need"), F.lit(r).alias("reason"))) for n, r, c in rules]))
    return sites.select("site", F.explode(found).alias("n")).select("site", "n.need", "n.reason")


def evacuations(edges: DataFrame, shelters: DataFrame, settlements: DataFrame, closures: DataFrame) -> DataFrame:
    """(type, target, to, seconds, people, p_event, p10_h): each settlement to its nearest shelter by network time.

    edges: u, v, seconds. shelters: node, site. settlements: node, population. closures: node, p_event, p10_h of access to
    shelters. Settlements that nobody lives in, without a shelter in reach, or whose access never closes, need no move.
    """
    near = nearest_sites(edges, shelters, []).filter("site is not null")
    rows = settlements.filter("population > 0").join(near, "node").join(closures.filter("p_event > 0"), "node")
    return rows.select(F.lit("evacuate").alias("type"), F.col("node").alias("target"), F.col("site").alias("to"), "seconds", F.col("population").alias("people"), "p_event", "p10_h")


def timed(actions: DataFrame, keys: list[str], deterministic: bool = False) -> DataFrame:
    """Adds deadline_h, basis, score and rank to actions (keys, type, target, people, p_event, p10_h).

    The deadline is the hour that one in ten members has the event by, less the type's lead, now at the earliest; in
    deterministic mode p10_h is the official track's hour and the basis says so. Ranked by people x probability in each key,
    ties by type and target; types without a lead are left out.
    """
    lead = F.create_map(*[F.lit(x) for kv in LEAD_H.items() for x in kv])
    what = F.create_map(*[F.lit(x) for kv in EVENT.items() for x in kv])
    h = F.try_element_at(lead, F.col("type"))
    out = actions.withColumn("deadline_h", F.greatest(F.lit(0.0), F.col("p10_h") - h)).filter(h.isNotNull() & F.col("p10_h").isNotNull())
    hours = F.concat(F.lit("" if deterministic else "P10 "), F.try_element_at(what, F.col("type")), F.lit(" − "), h.cast("int").cast("string"), F.lit(" h"))
    out = out.withColumn("basis", F.concat(F.lit("official track ") if deterministic else F.lit(""), hours)).withColumn("score", F.col("people") * F.col("p_event"))
    return out.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("score"), "type", "target")))


def cover(covers: DataFrame, weights: DataFrame, most: int) -> DataFrame:
    """(place, site, gain): the first `most` sites of the greedy cover, each with what it adds to those before it.

    covers: site, item. weights: item, weight (above zero). Greedy takes the site that adds most, ties by smaller site, which
    is within 1 - 1/e of the best choice. A site whose gain is the largest at each of its open items is taken before any
    site that shares one with it, whatever happens elsewhere, so that a round takes all such sites together; gains are
    then worked out anew for what is still open. A site's gain never rises, so the order of gains is the greedy order.
    """
    left = materialize(covers.select("site", "item").dropna().distinct().join(weights.filter("weight > 0").select("item", "weight"), "item"))
    taken: DataFrame | None = None
    while True:
        gain = left.groupBy("site").agg(F.sum("weight").alias("gain"))
        rows = left.join(gain, "site")
        best = rows.groupBy("item").agg(F.min(F.struct((-F.col("gain")).alias("g"), "site")).getField("site").alias("best"))
        won = rows.join(best, "item").groupBy("site").agg(F.bool_and(F.col("site") == F.col("best")).alias("_all"), F.first("gain").alias("gain")).filter("_all").select("site", "gain")
        won = materialize(won)
        if won.isEmpty():
            break
        taken = materialize(won if taken is None else taken.union(won))
        left = materialize(left.join(left.join(won.select("site"), "site", "left_semi").select("item").distinct(), "item", "left_anti"))
        open_ = left.groupBy("site").agg(F.sum("weight").alias("gain")).agg(F.max("gain")).first()[0]
        if open_ is None or taken.filter(F.col("gain") > open_).count() >= most:
            break
    if taken is None:
        return left.select(F.lit(0).alias("place"), "site", F.col("weight").alias("gain")).limit(0)
    first = taken.orderBy(F.desc("gain"), "site").limit(most)
    return first.withColumn("place", F.row_number().over(Window.orderBy(F.desc("gain"), "site"))).select("place", "site", "gain")


def staging(edges: DataFrame, depots: DataFrame, critical: DataFrame, most: int, within: float = 3600.0) -> DataFrame:
    """(place, site, gain): depots for machines, so that much criticality is in reach of one in time.

    edges: u, v, seconds. depots: node, site. critical: edge_id, u, v, people, p10_h. A depot covers an edge if an end of it is
    within so many seconds, and the edge closes no sooner.
    """
    near = reachable(edges, depots, within)
    ends = critical.select("edge_id", "people", "p10_h", F.explode(F.array(F.col("u").cast("long"), F.col("v").cast("long"))).alias("node"))
    in_time: Column = F.col("seconds") <= F.col("p10_h") * 3600
    return cover(near.join(ends, "node").filter(in_time).select("site", F.col("edge_id").alias("item")), critical.select(F.col("edge_id").alias("item"), F.col("people").alias("weight")), most)
