"""Event rules over events: batch forms with SQL, streaming forms run once over the table as a file stream."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from cutoffs.registry import query, sql, table
from cutoffs.session import shared_dir
from cutoffs.streaming import rules


def _run(df, mode="append"):
    """Runs a stream to the end of its input into the shared folder (append) and reads the result."""
    spark = df.sparkSession
    at = f"{shared_dir(spark)}/stream-{uuid.uuid4().hex}"
    df.writeStream.outputMode(mode).format("parquet").option("checkpointLocation", f"{at}/state").trigger(availableNow=True).start(f"{at}/out").awaitTermination()
    return spark.read.schema(df.schema).parquet(f"{at}/out")


def _stream(spark, sf):
    schema = table(spark, sf, "events").schema
    e = spark.readStream.schema(schema).option("pathGlobFilter", "events*.parquet").parquet(sf)
    return e.withColumn("ts", F.col("ts").cast("timestamp"))


@query("ST1_rate_limit")
def st1(spark, sf):
    return rules.rate_limit(sql(spark, sf, "SELECT event_type AS key, event_id, ts FROM events"), limit=2, span=1800.0)


@query("ST1_rate_limit_stream")
def st1_stream(spark, sf):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    return _run(rules.rate_limit_stream(_stream(spark, sf).select(F.col("user_id").alias("key"), "ts")))


@query("ST2_daily_cap", "WITH r AS (SELECT event_id, row_number() OVER (PARTITION BY CAST(ts AS DATE) ORDER BY ts, event_id) AS k FROM events) SELECT event_id, k <= 300 AS allowed FROM r")
def st2(spark, sf):
    return rules.daily_cap(sql(spark, sf, "SELECT event_id, ts FROM events")).select("event_id", "allowed")


@query(
    "ST2_daily_cap_stream",
    "WITH r AS (SELECT event_id, CAST(ts AS DATE) AS day, row_number() OVER (PARTITION BY CAST(ts AS DATE) ORDER BY ts, event_id) AS k FROM events) SELECT event_id, k <= 300 AS allowed FROM r WHERE k > 300 OR day + INTERVAL 1 DAY <= (SELECT max(ts) FROM events) - INTERVAL 1 HOUR",
)
def st2_stream(spark, sf):
    """Each event's decision: rejections at once, allowances when the watermark has passed the day."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    return _run(rules.daily_cap_stream(_stream(spark, sf).select("event_id", "ts")))


@query("ST3_first_write_wins", "SELECT event_type, user_id, min(event_id) AS event_id FROM events GROUP BY 1, 2")
def st3(spark, sf):
    return rules.first_write_wins(sql(spark, sf, "SELECT event_type, user_id, event_id FROM events"), ["event_type", "user_id"], ["event_id"]).select("event_type", "user_id", "event_id")


@query("ST3_first_write_wins_stream", "SELECT count(DISTINCT event_id) AS n FROM events")
def st3_stream(spark, sf):
    return _run(rules.first_write_wins_stream(_stream(spark, sf), ["event_id"])).agg(F.count("*").alias("n"))


@query("ST5_field_reports_stream")
def st5(spark, sf):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    e = _stream(spark, sf).select(F.col("user_id").alias("asset_id"), "ts", F.lit(True).alias("location_ok"), F.when(F.col("event_id") % 2 == 0, "open").otherwise("closed").alias("passability"), F.lit(0.9).alias("confidence"))
    assets = sql(spark, sf, "SELECT DISTINCT user_id AS asset_id, CASE WHEN user_id % 2 = 0 THEN 'bridge' ELSE 'road' END AS kind FROM events")
    return _run(rules.reports_stream(e, assets))


@query("ST6_new_files", "SELECT event_type, count(*) AS n FROM events GROUP BY 1")
def st6(spark, sf):
    at = f"{shared_dir(spark)}/new-{uuid.uuid4().hex}"
    rules.on_new_files(_stream(spark, sf), lambda df, _: df.groupBy("event_type").count().write.mode("append").parquet(f"{at}/out"), f"{at}/state")
    return spark.read.parquet(f"{at}/out").groupBy("event_type").agg(F.sum("count").alias("n"))


@query("ST7_active_season", "SELECT TIMESTAMP '2024-02-01' - max(ts) <= INTERVAL 36 HOUR AS active FROM events")
def st7(spark, sf):
    return rules.active_season(sql(spark, sf, "SELECT ts FROM events"), F.lit("2024-02-01").cast("timestamp")).select("active")
