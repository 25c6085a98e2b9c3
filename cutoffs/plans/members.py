"""Ensemble statistics over lineitem: supplier = place, part modulo 50 = member, quantity = weight."""

from __future__ import annotations

from pyspark.sql import functions as F

from cutoffs.operators import stats
from cutoffs.registry import query, sql

#: Place, member, hour and weight; infinities mark "never" and "no route".
MEMBERS = """SELECT l_suppkey AS place, l_partkey % 50 AS member, CAST(l_quantity AS DOUBLE) AS w, CAST((l_orderkey * 7 + l_linenumber * 13) % 73 AS DOUBLE) AS hour,
  CASE WHEN l_returnflag = 'N' AND l_linenumber = 1 THEN CAST('Infinity' AS DOUBLE) WHEN l_linestatus = 'F' AND l_linenumber = 7 THEN CAST('-Infinity' AS DOUBLE) ELSE CAST((l_orderkey * 7 + l_linenumber * 13) % 73 AS DOUBLE) END AS b
FROM lineitem"""
_CDF = f"""WITH m AS ({MEMBERS}), p AS (SELECT place, hour, sum(w) AS w FROM m GROUP BY place, hour),
c AS (SELECT place, hour, sum(w) OVER (PARTITION BY place ORDER BY hour) / sum(w) OVER (PARTITION BY place) AS cdf FROM p)"""
_DECILES = ", ".join(f"min(hour) FILTER (WHERE cdf >= {k / 10}) AS q{k}0" for k in range(1, 10))


@query(
    "AG10_member_weights",
    """WITH m AS (SELECT DISTINCT event_type AS source, user_id AS member_no FROM events), o AS (SELECT * FROM m WHERE source <> 'purchase'),
 s AS (SELECT source, count(*) AS n FROM o GROUP BY source)
SELECT m.source, m.member_no, round(coalesce(1.0 / ((SELECT count(*) FROM s) * s.n), 0.0), 9) AS weight FROM m LEFT JOIN s ON m.source = s.source""",
)
def ag10(spark, sf):
    m = sql(spark, sf, "SELECT DISTINCT event_type AS source, user_id AS member_no FROM events")
    return stats.member_weights(m, official="purchase").select("source", "member_no", F.round("weight", 9).alias("weight"))


@query("AG11_weighted_quantiles", f"{_CDF} SELECT place, {_DECILES} FROM c GROUP BY place")
def ag11(spark, sf):
    return stats.weighted_quantiles(sql(spark, sf, MEMBERS), ["place"], "hour", "w", [k / 10 for k in range(1, 10)])


@query("W8_weighted_distribution", f"{_CDF} SELECT place, hour, round(cdf, 9) AS cdf FROM c")
def w8(spark, sf):
    out = stats.cumulative(sql(spark, sf, MEMBERS), ["place"], "hour", "w")
    return out.select("place", "hour", F.round(F.col("cum") / F.col("total"), 9).alias("cdf"))


@query(
    "AG12_isolation_summary",
    f"""WITH m AS ({MEMBERS}), f AS (SELECT place, b, sum(w) AS w FROM m WHERE isfinite(b) GROUP BY place, b),
c AS (SELECT place, b, sum(w) OVER (PARTITION BY place ORDER BY b) / sum(w) OVER (PARTITION BY place) AS cdf FROM f),
d AS (SELECT place, {", ".join(f"min(b) FILTER (WHERE cdf >= {k / 10}) AS t{k}0" for k in range(1, 10))} FROM c GROUP BY place),
h AS (SELECT place, sum(w) FILTER (WHERE b <> CAST('-Infinity' AS DOUBLE) AND b <= 36) / sum(w) FILTER (WHERE b <> CAST('-Infinity' AS DOUBLE)) AS p,
 coalesce(sum(w) FILTER (WHERE b = CAST('Infinity' AS DOUBLE)), 0) / sum(w) FILTER (WHERE b <> CAST('-Infinity' AS DOUBLE)) >= 0.9 AS never,
 coalesce(sum(w) FILTER (WHERE b = CAST('-Infinity' AS DOUBLE)), 0) / sum(w) > 0.5 AS no_route FROM m GROUP BY place)
SELECT h.place, round(p, 9) AS p_landfall, never, no_route, t10, t20, t30, t40, t50, t60, t70, t80, t90 FROM h LEFT JOIN d ON h.place = d.place""",
)
def ag12(spark, sf):
    return stats.isolation_summary(sql(spark, sf, MEMBERS), ["place"], "b", "w", 36.0).withColumn("p_landfall", F.round("p_landfall", 9))


@query(
    "AG13_isolated_share_by_hour",
    f"""WITH m AS ({MEMBERS}), h AS (SELECT unnest([0, 12, 24, 36, 48, 60, 72]) AS hour)
SELECT place, CAST(h.hour AS INTEGER) AS hour, round(coalesce(sum(w) FILTER (WHERE b <= h.hour), 0) / sum(w), 9) AS p FROM m, h WHERE b <> CAST('-Infinity' AS DOUBLE) GROUP BY place, h.hour""",
)
def ag13(spark, sf):
    return stats.isolated_share(sql(spark, sf, MEMBERS), ["place"], "b", "w", [0, 12, 24, 36, 48, 60, 72]).withColumn("p", F.round("p", 9))


@query(
    "AG14_published_stats",
    f"""WITH m AS ({MEMBERS}), r AS (SELECT place, b, sum(w) AS w FROM m WHERE b <> CAST('-Infinity' AS DOUBLE) GROUP BY place, b),
c AS (SELECT place, b, sum(w) OVER (PARTITION BY place ORDER BY b) / sum(w) OVER (PARTITION BY place) AS cdf FROM r),
u AS (SELECT place, {", ".join(f"min(b) FILTER (WHERE isfinite(b) AND cdf >= {k / 10} - 1e-12) AS d{k}" for k in range(1, 10))}, max(cdf) FILTER (WHERE isfinite(b)) AS cut FROM c GROUP BY place),
g AS (SELECT place, b, sum(w) OVER (PARTITION BY place ORDER BY b) / sum(w) OVER (PARTITION BY place) AS cdf FROM r WHERE isfinite(b)),
q AS (SELECT place, min(b) FILTER (WHERE cdf >= 0.1) AS p10, min(b) FILTER (WHERE cdf >= 0.5) AS p50, min(b) FILTER (WHERE cdf >= 0.9) AS p90 FROM g GROUP BY place),
f AS (SELECT place, coalesce(sum(w) FILTER (WHERE b = CAST('-Infinity' AS DOUBLE)), 0) / sum(w) > 0.5 AS no_route,
 round(coalesce(sum(w) FILTER (WHERE b <> CAST('-Infinity' AS DOUBLE) AND b <= 36), 0) / sum(w) FILTER (WHERE b <> CAST('-Infinity' AS DOUBLE)), 9) AS p_landfall FROM m GROUP BY place)
SELECT f.place, no_route, p_landfall, d1, d2, d3, d4, d5, d6, d7, d8, d9, CASE WHEN cut >= 0.1 THEN p10 END AS p10, CASE WHEN cut >= 0.1 THEN p50 END AS p50, CASE WHEN cut >= 0.1 THEN p90 END AS p90
FROM f LEFT JOIN u ON f.place = u.place LEFT JOIN q ON f.place = q.place""",
)
def ag14(spark, sf):
    return stats.published_stats(sql(spark, sf, MEMBERS), ["place"], "b", "w", 36.0).withColumn("p_landfall", F.round("p_landfall", 9))


_SPARSE = """SELECT l_suppkey AS place, CAST((l_orderkey * 7 + l_linenumber * 13) % 73 AS DOUBLE) AS hour, l_quantity / 65536e0 AS w FROM lineitem WHERE l_linenumber <= 3"""


@query(
    "AG15_decile_hours",
    f"""WITH e AS ({_SPARSE}), p AS (SELECT place, hour, sum(w) AS w FROM e GROUP BY place, hour), c AS (SELECT place, hour, w, sum(w) OVER (PARTITION BY place ORDER BY hour) AS cum FROM p)
SELECT place, {", ".join(f"min(hour) FILTER (WHERE cum >= {k / 10} - 1e-12) AS d{k}" for k in range(1, 10))}, sum(w) AS p FROM c GROUP BY place""",
)
def ag15(spark, sf):
    return stats.decile_hours(sql(spark, sf, _SPARSE), ["place"], "hour", "w")


@query(
    "W3_average_rank",
    """WITH d AS (SELECT c_nationkey AS place, c_custkey AS member, floor(c_acctbal / 100) AS dist FROM customer),
r AS (SELECT place, member, (rank() OVER (PARTITION BY place ORDER BY dist) - 1 + (count(*) OVER (PARTITION BY place, dist) - 1) / 2e0) AS k, count(*) OVER (PARTITION BY place) AS n FROM d)
SELECT place, member, round(CASE WHEN n > 1 THEN 1 - k / (n - 1) ELSE 0.5 END, 9) AS q FROM r""",
)
def w3(spark, sf):
    d = sql(spark, sf, "SELECT c_nationkey AS place, c_custkey AS member, floor(c_acctbal / 100) AS dist FROM customer")
    return stats.average_rank_share(d, ["place"], "dist").select("place", "member", F.round("q", 9).alias("q"))


@query(
    "AG18_shares_by_source",
    "SELECT l_suppkey AS place, l_returnflag AS source, round(avg(CASE WHEN l_quantity > 25 THEN 1e0 ELSE 0e0 END), 9) AS p FROM lineitem GROUP BY 1, 2",
)
def ag18(spark, sf):
    d = sql(spark, sf, "SELECT l_suppkey AS place, l_returnflag AS source, l_quantity FROM lineitem")
    out = stats.source_shares(d, ["place"], "source", F.col("l_quantity") > 25)
    return out.select("place", F.explode("p_by_source").alias("source", "p")).withColumn("p", F.round("p", 9))
