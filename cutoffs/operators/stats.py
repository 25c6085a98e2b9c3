"""Weighted ensemble statistics: member weights, quantiles, deciles, isolation summaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Weight that may be missing at a decile, against rounding in the running sum.
TOLERANCE = 1e-12


def member_weights(members: DataFrame, source: str = "source", member: str = "member_no", official: str = "official", deterministic: bool = False) -> DataFrame:
    """Adds `weight`: every source but the official one counts the same, and so does every member in a source."""
    ids = members.select(source, member).distinct()
    others = ids.filter(F.col(source) != official)
    size = others.groupBy(source).agg(F.count("*").alias("_n"))
    n_sources = size.agg(F.count("*").alias("_k"))
    share = size.join(F.broadcast(n_sources)).select(source, (1.0 / (F.col("_k") * F.col("_n"))).alias("weight"))
    joined = members.join(share, source, "left")
    return joined.withColumn("weight", F.lit(0.0) if deterministic else F.coalesce("weight", F.lit(0.0)))


def cumulative(df: DataFrame, keys: list[str], value: str, weight: str) -> DataFrame:
    """(keys, value, w, cum, total): weights summed by value first, then along the values of each key.

    The first sum is a map-side combine, so that the window sorts one row per distinct value of a key.
    """
    per = df.filter(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.sum(weight).alias("w"))
    by = Window.partitionBy(*keys)
    run = by.orderBy(value).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return per.withColumn("cum", F.sum("w").over(run)).withColumn("total", F.sum("w").over(by))


def weighted_quantiles(df: DataFrame, keys: list[str], value: str, weight: str, qs: list[float], names: list[str] | None = None) -> DataFrame:
    """Smallest value whose share of the weight reaches q (inverse weighted distribution, from the left)."""
    names = names or [f"q{round(100 * q):02d}" for q in qs]
    cdf = cumulative(df, keys, value, weight).filter("total > 0").withColumn("cdf", F.col("cum") / F.col("total"))
    return cdf.groupBy(*keys).agg(*[F.min(F.when(F.col("cdf") >= q, F.col(value))).alias(n) for q, n in zip(qs, names, strict=True)])


def _finite(b: Column) -> Column:
    return (b > float("-inf")) & (b < float("inf"))


def isolation_summary(df: DataFrame, keys: list[str], b: str, weight: str, landfall_h: float) -> DataFrame:
    """Per key: p_landfall over members with a route, never (share >= 0.9), no_route (share > 0.5), deciles if cut off.

    b: +infinity for never cut off, -infinity for no route at the start.
    """
    v, w = F.col(b), F.col(weight)
    routed = F.sum(F.when(v > float("-inf"), w).otherwise(0.0))
    head = df.groupBy(*keys).agg(
        (F.sum(F.when((v > float("-inf")) & (v <= landfall_h), w).otherwise(0.0)) / F.nullif(routed, F.lit(0.0))).alias("p_landfall"),
        (F.sum(F.when(v == float("inf"), w).otherwise(0.0)) / F.nullif(routed, F.lit(0.0)) >= 0.9).alias("never"),
        (F.sum(F.when(v == float("-inf"), w).otherwise(0.0)) / F.sum(w) > 0.5).alias("no_route"),
    )
    deciles = weighted_quantiles(df.filter(_finite(v)), keys, b, weight, [k / 10 for k in range(1, 10)], [f"t{k}0" for k in range(1, 10)])
    return head.join(deciles, keys, "left").withColumn("never", F.coalesce("never", F.lit(False)))


def isolated_share(df: DataFrame, keys: list[str], b: str, weight: str, hours: list[int]) -> DataFrame:
    """(keys, hour, p): share of the routed weight cut off at each hour or before.

    One pass: weights are first summed by the hour at which they begin to count, then run up over the hours.
    """
    last = max(hours)
    v = F.col(b)
    per = df.filter(v > float("-inf")).groupBy(*keys, F.when(v <= last, F.ceil(v).cast("int")).otherwise(last + 1).alias("_h")).agg(F.sum(weight).alias("_w"))
    grid = per.groupBy(*keys).agg(F.sum("_w").alias("_total"), F.map_from_entries(F.collect_list(F.struct("_h", "_w"))).alias("_by"))
    out = grid.select(*keys, "_total", "_by", F.explode(F.array(*[F.lit(h) for h in hours])).alias("hour"))
    cut = F.aggregate(F.map_entries(F.map_filter("_by", lambda k, _: k <= F.col("hour"))), F.lit(0.0), lambda a, e: a + e["value"])
    return out.select(*keys, "hour", (cut / F.col("_total")).alias("p"))


def published_stats(df: DataFrame, keys: list[str], b: str, weight: str, landfall_h: float) -> DataFrame:
    """Deciles over all routed members (those never cut off included), and the P10/P50/P90 window of those cut off.

    The window is given if at least a tenth of the routed weight is cut off; deciles beyond the cut-off share are null.
    """
    routed = df.filter(F.col(b) > float("-inf"))
    cdf = cumulative(routed, keys, b, weight).filter("total > 0").withColumn("cdf", F.col("cum") / F.col("total"))
    finite = F.col(b) < float("inf")
    aggs = [F.min(F.when(finite & (F.col("cdf") >= k / 10 - TOLERANCE), F.col(b))).alias(f"d{k}") for k in range(1, 10)]
    unconditional = cdf.groupBy(*keys).agg(*aggs, F.max(F.when(finite, F.col("cdf"))).alias("_cut"))
    window = weighted_quantiles(routed.filter(finite), keys, b, weight, [0.1, 0.5, 0.9], ["p10", "p50", "p90"])
    v, w = F.col(b), F.col(weight)
    flags = df.groupBy(*keys).agg(
        (F.sum(F.when(v == float("-inf"), w).otherwise(0.0)) / F.sum(w) > 0.5).alias("no_route"),
        (F.sum(F.when((v > float("-inf")) & (v <= landfall_h), w).otherwise(0.0)) / F.nullif(F.sum(F.when(v > float("-inf"), w)), F.lit(0.0))).alias("p_landfall"),
    )
    out = flags.join(unconditional, keys, "left").join(window, keys, "left")
    enough = F.col("_cut") >= 0.1
    return out.withColumns({c: F.when(enough, F.col(c)) for c in ("p10", "p50", "p90")}).drop("_cut")


def decile_hours(events: DataFrame, keys: list[str], hour: str, weight: str) -> DataFrame:
    """Sparse events (a member is absent if nothing happens): first hour at which k/10 of all weight (1) is reached, and p."""
    per = events.groupBy(*keys, hour).agg(F.sum(weight).alias("w"))
    run = Window.partitionBy(*keys).orderBy(hour).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    cdf = per.withColumn("cum", F.sum("w").over(run))
    return cdf.groupBy(*keys).agg(*[F.min(F.when(F.col("cum") >= k / 10 - TOLERANCE, F.col(hour))).alias(f"d{k}") for k in range(1, 10)], F.sum("w").alias("p"))


def average_rank_share(df: DataFrame, keys: list[str], value: str, name: str = "q") -> DataFrame:
    """1 - rank / (n - 1) with ties at their average rank (0 for the smallest); one row alone gets 0.5."""
    by = Window.partitionBy(*keys)
    rank = F.rank().over(by.orderBy(value)) - 1 + (F.count("*").over(Window.partitionBy(*keys, value)) - 1) / 2
    n = F.count("*").over(by)
    return df.withColumn(name, F.when(n > 1, 1 - rank / (n - 1)).otherwise(0.5))


def source_shares(df: DataFrame, keys: list[str], source: str, flag: Column) -> DataFrame:
    """Unweighted mean of a flag by source, as one map per key."""
    per = df.groupBy(*keys, source).agg(F.avg(flag.cast("double")).alias("_p"))
    return per.groupBy(*keys).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct(source, "_p")))).alias("p_by_source"))
