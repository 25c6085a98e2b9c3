"""Scans: track files, configuration, published runs, bulletins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

KNOT_MS = 1852 / 3600
TRACK_CSV = "init_time timestamp, track_id string, sample bigint, valid_time timestamp, lead_time string, lat double, lon double, minimum_sea_level_pressure_hpa double, maximum_sustained_wind_speed_knots double, radius_of_maximum_winds_km double"
TRACK_COLUMNS = "source string, member_no bigint, init_utc timestamp, valid_utc timestamp, lead_h double, lat double, lon double, vmax_ms double, pmin_hpa double, rmw_km double"
BULLETIN = "bulletin_id string, issued_utc timestamp, current struct<lat: double, lon: double>, forecast array<struct<valid_utc: timestamp, lat: double, lon: double, wind_min: double, wind_max: double, unit: string, category: string>>, source_quotes array<string>"


def track_csv(spark: SparkSession, path: str, source: str, track_id: str) -> DataFrame:
    """Rows of one storm in a track file: comment lines skipped, knots to m/s, lead from the two times."""
    raw = spark.read.schema(TRACK_CSV).option("header", True).option("comment", "#").csv(path).filter(F.col("track_id") == track_id)
    lead = (F.unix_micros("valid_time") - F.unix_micros("init_time")) / 3.6e9
    return raw.select(F.lit(source).alias("source"), F.col("sample").alias("member_no"), F.col("init_time").alias("init_utc"), F.col("valid_time").alias("valid_utc"), lead.alias("lead_h"), "lat", "lon", (F.col("maximum_sustained_wind_speed_knots") * KNOT_MS).alias("vmax_ms"), F.col("minimum_sea_level_pressure_hpa").alias("pmin_hpa"), F.col("radius_of_maximum_winds_km").alias("rmw_km"))


def bulletins(spark: SparkSession, path: str) -> DataFrame:
    """Bulletin readings; a file that does not fit the schema has its text in _corrupt."""
    return spark.read.schema(BULLETIN + ", _corrupt string").option("multiLine", True).option("columnNameOfCorruptRecord", "_corrupt").json(path)


def config_csv(spark: SparkSession, path: str, names: list[str]) -> DataFrame:
    """A configuration file with every value a string and missing ones empty."""
    return spark.read.schema(", ".join(f"{n} string" for n in names)).option("header", True).csv(path).fillna("")


def all_found(config: DataFrame, shapes: DataFrame, key: str) -> DataFrame:
    """config joined to shapes; fails if a configured key has no shape."""
    missing = config.join(shapes, key, "left_anti").select(key).limit(5).collect()  # a report of the first few
    if missing:
        raise ValueError(f"no shape for {[r[0] for r in missing]}")
    return config.join(shapes, key)


def published_runs(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Documents of all runs (…/run_id/districts/name.json) with run_id and district taken from their place."""
    docs = spark.read.schema(schema).json(f"{path}/*/districts/*.json")
    place = F.col("_metadata.file_path")
    return docs.withColumn("run_id", F.regexp_extract(place, r"([^/]+)/districts/", 1)).withColumn("district", F.regexp_extract(place, r"([^/]+)\.json$", 1))
