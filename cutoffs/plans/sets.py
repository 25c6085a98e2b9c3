"""Set operations, plain joins and pruned scans."""

from __future__ import annotations

from pyspark.sql import functions as F

from cutoffs.registry import query, sql, table


@query("U1_concatenate", "SELECT c_custkey AS id, c_nationkey AS nation, c_mktsegment AS segment FROM customer UNION ALL SELECT s_suppkey, s_nationkey, NULL FROM supplier")
def u1(spark, sf):
    a = sql(spark, sf, "SELECT c_custkey AS id, c_nationkey AS nation, c_mktsegment AS segment FROM customer")
    return a.unionByName(sql(spark, sf, "SELECT s_suppkey AS id, s_nationkey AS nation FROM supplier"), allowMissingColumns=True)


@query("U2_distinct_keys", "SELECT DISTINCT l_partkey, l_suppkey FROM lineitem")
def u2(spark, sf):
    return sql(spark, sf, "SELECT l_partkey, l_suppkey FROM lineitem").distinct()


@query("U3_common_hours", "SELECT date_trunc('day', o_orderdate)::DATE AS d FROM orders INTERSECT SELECT date_trunc('day', l_shipdate)::DATE FROM lineitem")
def u3(spark, sf):
    return sql(spark, sf, "SELECT CAST(o_orderdate AS DATE) AS d FROM orders").intersect(sql(spark, sf, "SELECT CAST(l_shipdate AS DATE) AS d FROM lineitem"))


@query("U4_difference", "SELECT p_partkey FROM part EXCEPT SELECT l_partkey FROM lineitem WHERE l_quantity > 45")
def u4(spark, sf):
    return sql(spark, sf, "SELECT p_partkey FROM part").subtract(sql(spark, sf, "SELECT l_partkey FROM lineitem WHERE l_quantity > 45"))


@query("U5_set_equality", "WITH s AS (SELECT o_custkey, o_orderkey, list_sort(list(DISTINCT l_returnflag)) AS f FROM orders JOIN lineitem ON o_orderkey = l_orderkey GROUP BY 1, 2) SELECT o_custkey, count(*) FILTER (WHERE f = ['A', 'N']) AS n FROM s GROUP BY 1")
def u5(spark, sf):
    j = sql(spark, sf, "SELECT o_custkey, o_orderkey, l_returnflag FROM orders JOIN lineitem ON o_orderkey = l_orderkey")
    s = j.groupBy("o_custkey", "o_orderkey").agg(F.array_sort(F.collect_set("l_returnflag")).alias("f"))
    return s.groupBy("o_custkey").agg(F.count(F.when(F.col("f") == F.array(F.lit("A"), F.lit("N")), 1)).alias("n"))


@query("J2_inner_equi", "SELECT n_nationkey, n_name, r_name FROM nation JOIN region ON n_regionkey = r_regionkey")
def j2(spark, sf):
    r = sql(spark, sf, "SELECT r_regionkey AS n_regionkey, r_name FROM region")
    return sql(spark, sf, "SELECT n_nationkey, n_name, n_regionkey FROM nation").join(r, "n_regionkey").select("n_nationkey", "n_name", "r_name")


@query("J12_hash_equi", "SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, p_name FROM lineitem LEFT JOIN part ON l_partkey = p_partkey")
def j12(spark, sf):
    p = sql(spark, sf, "SELECT p_partkey AS l_partkey, p_name FROM part")
    return sql(spark, sf, "SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey FROM lineitem").join(p, "l_partkey", "left").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "p_name")


@query("J24_semi_anti", "SELECT c_custkey, EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey) AS used FROM customer")
def j24(spark, sf):
    c, o = sql(spark, sf, "SELECT c_custkey FROM customer"), sql(spark, sf, "SELECT o_custkey AS c_custkey FROM orders")
    return c.join(o, "c_custkey", "left_semi").withColumn("used", F.lit(True)).union(c.join(o, "c_custkey", "left_anti").withColumn("used", F.lit(False)))


@query("SRC6_pruned_scan", "SELECT l_orderkey, l_quantity FROM lineitem WHERE l_shipdate >= TIMESTAMP '1997-01-01' AND l_returnflag = 'R'")
def src6(spark, sf):
    return table(spark, sf, "lineitem").filter((F.col("l_shipdate") >= F.lit("1997-01-01").cast("timestamp_ntz")) & (F.col("l_returnflag") == "R")).select("l_orderkey", "l_quantity")


@query("SRC7_config_join", "SELECT n_name, r_name FROM nation JOIN region ON n_regionkey = r_regionkey")
def src7(spark, sf):
    from cutoffs.sources.tracks import all_found

    n = sql(spark, sf, "SELECT n_name, CAST(n_regionkey AS VARCHAR(3)) AS k FROM nation")
    return all_found(n, sql(spark, sf, "SELECT CAST(r_regionkey AS VARCHAR(3)) AS k, r_name FROM region"), "k").select("n_name", "r_name")


@query("AG25_pivot", "SELECT o_orderpriority, count(*) FILTER (WHERE o_orderstatus = 'F') AS f, count(*) FILTER (WHERE o_orderstatus = 'O') AS o FROM orders GROUP BY 1")
def ag25(spark, sf):
    p = sql(spark, sf, "SELECT o_orderpriority, o_orderstatus FROM orders").groupBy("o_orderpriority").pivot("o_orderstatus", ["F", "O"]).count()
    return p.select("o_orderpriority", F.coalesce("F", F.lit(0)).alias("f"), F.coalesce("O", F.lit(0)).alias("o"))


@query("AG26_build_counts", "SELECT count(*) AS edges, count(*) FILTER (WHERE l_returnflag = 'A') AS bridges, count(*) FILTER (WHERE l_returnflag = 'R') AS culverts, count(DISTINCT l_suppkey) AS nodes FROM lineitem")
def ag26(spark, sf):
    t = sql(spark, sf, "SELECT l_returnflag, l_suppkey FROM lineitem")
    return t.agg(F.count("*").alias("edges"), F.count(F.when(F.col("l_returnflag") == "A", 1)).alias("bridges"), F.count(F.when(F.col("l_returnflag") == "R", 1)).alias("culverts"), F.countDistinct("l_suppkey").alias("nodes"))


@query("W11_first_per_group", "SELECT o_custkey, min(o_orderkey) AS o_orderkey FROM orders GROUP BY 1")
def w11(spark, sf):
    return sql(spark, sf, "SELECT o_custkey, o_orderkey FROM orders").groupBy("o_custkey").agg(F.min("o_orderkey").alias("o_orderkey"))
