"""Track series: selection, as-of interpolation, matching, hourly resampling, alignment, velocity."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cutoffs.functions.geo import EARTH_KM, haversine_km
from cutoffs.session import materialize

METRICS = ["lat", "lon", "vmax_ms", "pmin_hpa", "rmw_km"]
KEYS = ["source", "member_no"]


def epoch(ts: str | Column) -> Column:
    """Seconds since 1970 of a time, with or without a zone (then UTC, the zone of the session)."""
    return F.unix_micros((F.col(ts) if isinstance(ts, str) else ts).cast("timestamp")) / 1e6


def latest_runs(files: DataFrame, issued: Column, delays: dict[str, float], source: str = "source", name: str = "file_name") -> DataFrame:
    """Point-in-time choice: per source the newest run whose start, read from its file name, plus delay is not after `issued`."""
    init = F.to_timestamp(F.regexp_extract(name, r"(\d{8}T?\d{2})", 1), "yyyyMMdd'T'HH")
    delay = F.create_map(*[x for k, v in delays.items() for x in (F.lit(k), F.lit(v))])
    out = files.withColumn("init_utc", init).withColumn("_h", F.coalesce(F.try_element_at(delay, F.col(source)), F.lit(0.0)))
    out = out.filter(F.col("init_utc").isNotNull() & (epoch("init_utc") + F.col("_h") * 3600 <= epoch(issued)))
    newest = Window.partitionBy(source).orderBy(F.desc("init_utc"), name)
    return out.withColumn("_r", F.row_number().over(newest)).filter("_r = 1").drop("_r", "_h")


def first_members(df: DataFrame, n: int) -> DataFrame:
    """The first n members of each source."""
    return df.withColumn("_d", F.dense_rank().over(Window.partitionBy("source").orderBy("member_no"))).filter(F.col("_d") <= n).drop("_d")


def positions_at(tracks: DataFrame, times: DataFrame, keys: list[str], at: str = "t_ref", metrics: list[str] | None = None, slice_s: float | None = None) -> DataFrame:
    """As-of interpolation: each of times (keys, at) with the metrics between the fixes around it; null outside a track.

    Fixes and times are merged and ordered in one window per track, so that no pairs of rows are formed. With slice_s the
    windows are those of slices of so many seconds, for a track that is asked for many times: the last fix before a slice
    and the first after it come from one row for each slice.
    """
    metrics = metrics or ["lat", "lon"]
    fix = tracks.groupBy(*keys, "valid_utc").agg(*[F.first(m, ignorenulls=True).alias(m) for m in metrics]).select(*keys, epoch("valid_utc").alias("_t"), F.struct(epoch("valid_utc").alias("t"), *metrics).alias("_f"), F.lit(0).alias("_q"), F.lit(None).cast("timestamp").alias(at))
    ask = times.select(*keys, epoch(at).alias("_t"), F.lit(None).cast(fix.schema["_f"].dataType).alias("_f"), F.lit(1).alias("_q"), at)
    both = fix.unionByName(ask)
    cut = [] if slice_s is None else ["_k"]
    if cut:
        both = both.withColumn("_k", F.floor(F.col("_t") / slice_s))
    by = Window.partitionBy(*keys, *cut)
    # both orders run forwards, as a frame that ends at the last row is gone through anew for each row
    before = F.last("_f", ignorenulls=True).over(by.orderBy("_t", "_q").rowsBetween(Window.unboundedPreceding, 0))
    after = F.last("_f", ignorenulls=True).over(by.orderBy(F.desc("_t"), "_q").rowsBetween(Window.unboundedPreceding, 0))
    out = both.withColumn("_a", before).withColumn("_b", after).filter("_q = 1")
    if cut:
        ends = both.groupBy(*keys, "_k").agg(F.max("_f").alias("_l"), F.min("_f").alias("_n"))
        over = Window.partitionBy(*keys)
        carried = lambda c, order: F.last(c, ignorenulls=True).over(over.orderBy(order).rowsBetween(Window.unboundedPreceding, -1))
        ends = ends.select(*keys, "_k", carried("_l", F.asc("_k")).alias("_l"), carried("_n", F.desc("_k")).alias("_n"))
        out = out.join(ends, [*keys, "_k"]).withColumns({"_a": F.coalesce("_a", "_l"), "_b": F.coalesce("_b", "_n")})
    t = F.when(F.col("_b.t") > F.col("_a.t"), (F.col("_t") - F.col("_a.t")) / (F.col("_b.t") - F.col("_a.t"))).otherwise(F.lit(0.0))
    value = lambda m: F.when(F.col("_a.t").isNotNull() & F.col("_b.t").isNotNull(), F.col(f"_a.{m}") + t * (F.col(f"_b.{m}") - F.col(f"_a.{m}")))
    return out.select(*keys, at, *[value(m).alias(m) for m in metrics])


def match_members(tracks: DataFrame, official: DataFrame, radius_km: float = 300.0) -> DataFrame:
    """Rows of the members that are within radius_km of the official track at the later of the two starts.

    A member with several storms keeps the nearest (ties: smallest storm_id).
    """
    keys = [*KEYS, "storm_id"]
    span = official.agg(F.min("valid_utc").alias("_o0"))
    start = tracks.groupBy(*keys).agg(F.min("valid_utc").alias("_s")).join(F.broadcast(span)).withColumn("t_ref", F.greatest("_s", "_o0"))
    mine = positions_at(tracks, start.select(*keys, "t_ref"), keys)
    ref = start.select("t_ref").distinct().withColumn("_one", F.lit(1))
    theirs = positions_at(official.withColumn("_one", F.lit(1)), ref, ["_one"], slice_s=3600.0).select("t_ref", F.col("lat").alias("_lat"), F.col("lon").alias("_lon"))
    near = mine.join(theirs, "t_ref").withColumn("_km", haversine_km(F.col("lat"), F.col("lon"), F.col("_lat"), F.col("_lon"))).filter(F.col("_km") <= radius_km)
    best = near.withColumn("_r", F.row_number().over(Window.partitionBy(*KEYS).orderBy("_km", "storm_id"))).filter("_r = 1").select(*keys)
    return tracks.join(best, keys, "left_semi")


def hourly(tracks: DataFrame, keys: list[str] | None = None, metrics: list[str] | None = None) -> DataFrame:
    """Whole hours from the first to the last fix of each track, each metric linear between its own fixes.

    Beyond its first or last fix a metric stays flat; with fewer than two fixes it is null. Fixes at one time count once.
    """
    keys, metrics = keys or KEYS, metrics or METRICS
    fix = tracks.groupBy(*keys, "valid_utc").agg(*[F.first(m, ignorenulls=True).alias(m) for m in metrics])
    fix = fix.select(*keys, epoch("valid_utc").alias("_s"), *metrics)
    whole = Window.partitionBy(*keys)
    up = whole.orderBy("_s")
    down = whole.orderBy(F.desc("_s")).rowsBetween(Window.unboundedPreceding, -1)
    point = lambda m: F.when(F.col(m).isNotNull() & F.col("_s").isNotNull(), F.struct(F.col("_s").alias("t"), F.col(m).alias("v")))
    # only fixes are ordered: the hours from a fix to the next all lie between the same points, and are made last
    fix = fix.withColumns({f"_b_{m}": F.last(point(m), ignorenulls=True).over(down) for m in metrics})
    fix = fix.withColumns({f"_a_{m}": F.last(point(m), ignorenulls=True).over(up.rowsBetween(Window.unboundedPreceding, 0)) for m in metrics} | {"_e": F.lead("_s").over(up)})
    fix = fix.withColumns({f"_n_{m}": F.count(m).over(whole) for m in metrics})
    fix = fix.withColumn("_from", F.ceil(F.col("_s") / 3600)).withColumn("_to", F.coalesce(F.ceil(F.col("_e") / 3600) - 1, F.floor(F.col("_s") / 3600))).filter("_from <= _to")
    grid = fix.withColumn("_h", F.explode(F.sequence("_from", "_to"))).withColumn("_t", (F.col("_h") * 3600).cast("double"))

    def value(m: str) -> Column:
        a, b = F.col(f"_a_{m}"), F.col(f"_b_{m}")
        line = a["v"] + (F.col("_t") - a["t"]) / (b["t"] - a["t"]) * (b["v"] - a["v"])
        return F.when(F.col(f"_n_{m}") >= 2, F.when(a.isNull(), b["v"]).when(b.isNull() | (a["t"] == F.col("_t")), a["v"]).otherwise(line))

    return grid.select(*keys, F.timestamp_seconds("_t").alias("valid_utc"), *[value(m).alias(m) for m in metrics])


def source_reference(members: DataFrame) -> DataFrame:
    """Per source and hour: mean position and median wind of its members."""
    return members.groupBy("source", "valid_utc").agg(F.avg("lat").alias("mean_lat"), F.avg("lon").alias("mean_lon"), F.percentile("vmax_ms", F.lit(0.5)).alias("median_v"))


def align(members: DataFrame, official: DataFrame, taper_h: float = 24.0) -> DataFrame:
    """Shifts each source's members by (official - source mean) at each hour and scales winds by official / median.

    After the last common hour the last correction fades to nothing over taper_h hours. Adds dlat, dlon, vscale.
    """
    off = official.select("valid_utc", F.col("lat").alias("_olat"), F.col("lon").alias("_olon"), F.col("vmax_ms").alias("_ov"))
    ref = source_reference(members).join(off, "valid_utc")
    ratio = F.col("_ov") / F.nullif(F.col("median_v"), F.lit(0.0))
    corr = ref.select("source", "valid_utc", (F.col("_olat") - F.col("mean_lat")).alias("dlat"), (F.col("_olon") - F.col("mean_lon")).alias("dlon"), F.coalesce(ratio, F.lit(1.0)).alias("vscale"))
    last = corr.groupBy("source").agg(F.max_by(F.struct("valid_utc", "dlat", "dlon", "vscale"), "valid_utc").alias("_l"))
    out = members.join(corr, ["source", "valid_utc"], "left").join(last, "source", "left")
    past = (epoch("valid_utc") - epoch(F.col("_l.valid_utc"))) / 3600
    fade = F.when(past > 0, F.greatest(F.lit(0.0), 1 - past / taper_h)).otherwise(0.0)
    out = out.withColumns(
        {
            "dlat": F.coalesce("dlat", F.col("_l.dlat") * fade, F.lit(0.0)),
            "dlon": F.coalesce("dlon", F.col("_l.dlon") * fade, F.lit(0.0)),
            "vscale": F.coalesce("vscale", 1 + (F.col("_l.vscale") - 1) * fade, F.lit(1.0)),
        }
    )
    return out.withColumns({"lat": F.col("lat") + F.col("dlat"), "lon": F.col("lon") + F.col("dlon"), "vmax_ms": F.col("vmax_ms") * F.col("vscale")}).drop("_l")


def alignment_report(aligned: DataFrame, official: DataFrame) -> DataFrame:
    """Per source: common hours, largest shift in km, median wind factor."""
    both = aligned.join(official.select("valid_utc").distinct(), "valid_utc", "left_semi")
    shift = F.hypot(F.col("dlat") * 111.195, F.col("dlon") * 111.195 * F.cos(F.radians("lat")))
    # a source has one factor for each hour
    per = both.groupBy("source", "valid_utc").agg(F.max(shift).alias("_shift"), F.max("vscale").alias("_v"))
    return per.groupBy("source").agg(F.count("*").alias("hours"), F.max("_shift").alias("max_shift_km"), F.percentile("_v", F.lit(0.5)).alias("median_vscale"))


def gradient(value: Column, hour: Column, by: Window) -> Column:
    """Second-order difference of value by hour on uneven steps, one-sided at the ends, 0 for a single row."""
    h0, h1 = hour - F.lag(hour).over(by), F.lead(hour).over(by) - hour
    d0, d1 = value - F.lag(value).over(by), F.lead(value).over(by) - value
    inner = (h0 * h0 * d1 + h1 * h1 * d0) / (h0 * h1 * (h0 + h1))
    return F.coalesce(F.when(h0.isNotNull() & h1.isNotNull(), inner).when(h1.isNotNull(), d1 / h1).when(h0.isNotNull(), d0 / h0), F.lit(0.0))


def translation_velocity(tracks: DataFrame, keys: list[str] | None = None, hour: str = "hour") -> DataFrame:
    """Adds u and v, the east and north speed of the centre in m/s."""
    by = Window.partitionBy(*(keys or KEYS)).orderBy(hour)
    k = 111194.9 / 3600
    return tracks.withColumn("u", gradient(F.col("lon"), F.col(hour), by) * k * F.cos(F.radians("lat"))).withColumn("v", gradient(F.col("lat"), F.col(hour), by) * k)


def fix_speeds(fixes: DataFrame, keys: list[str], lead: str = "lead_h") -> DataFrame:
    """Per key: largest speed in km/h from fix to fix, and whether leads rise throughout."""
    by = Window.partitionBy(*keys).orderBy("seq")
    km = haversine_km(F.lag("lat").over(by), F.lag("lon").over(by), F.col("lat"), F.col("lon"))
    step = F.col(lead) - F.lag(lead).over(by)
    out = fixes.withColumn("_v", km / F.nullif(F.abs(step), F.lit(0.0))).withColumn("_up", F.coalesce(step > 0, F.lit(True)))
    return out.groupBy(*keys).agg(F.max("_v").alias("max_kmh"), F.bool_and("_up").alias("monotone"))


#: Degrees of the boxes of a track, from level to level; the box above them all is the whole track's.
BOX_DEGREES = (8.0, 1.0, 0.125)
#: Places that a copy of the tracks' outer boxes meets at once.
BLOCK_PLACES = 1000


def closest_approach(tracks: DataFrame, places: DataFrame, keys: list[str], place: str = "place", boxes: tuple[float, ...] = BOX_DEGREES) -> DataFrame:
    """(keys, place, km): smallest distance of each track to each place of a stated set.

    Branch and bound on a tree of boxes of each track. No fix of a box is nearer than the box, and the nearest fix is no
    further than one fix that each box names; so boxes that are further than the nearest named fix are left, the others are
    opened. Only the track's outer box meets every place, as the result has a row for both; fixes meet the places for which
    their last box stays. `approach_steps` gives the rows of each level.
    """
    return approach_steps(tracks, places, keys, place, boxes)[-1].groupBy(*keys, place).agg(F.min("_km").alias("km"))


def approach_steps(tracks: DataFrame, places: DataFrame, keys: list[str], place: str = "place", boxes: tuple[float, ...] = BOX_DEGREES) -> list[DataFrame]:
    """The rows that each level of `closest_approach` compares: boxes with places, and fixes with places at last."""
    fixes = tracks.select(*keys, "lat", "lon").dropna(subset=["lat", "lon"])
    at = [F.lit(0).cast("long")]  # a hash of where a box is on all levels down to its own; boxes that share one are one box
    for d in boxes:
        at.append(F.xxhash64(at[-1], F.floor(F.col("lat") / d), F.floor(F.col("lon") / d)))
    fixes = materialize(fixes.withColumns({f"_b{i}": a for i, a in enumerate(at)}))
    finest = [f"_b{i}" for i in range(len(at))]
    # each level's boxes from those of the level below
    last = fixes.groupBy(*keys, *finest).agg(F.min("lat").alias("_s"), F.max("lat").alias("_n"), F.min("lon").alias("_w"), F.max("lon").alias("_e"), F.min(F.struct("lat", "lon")).alias("_f"))
    levels = [materialize(last)]
    for i in range(len(boxes) - 1, -1, -1):
        up = levels[0].groupBy(*keys, *finest[: i + 1]).agg(F.min("_s").alias("_s"), F.max("_n").alias("_n"), F.min("_w").alias("_w"), F.max("_e").alias("_e"), F.min("_f").alias("_f"))
        levels.insert(0, materialize(up))
    blocks = max(1, -(-places.count() // BLOCK_PLACES))
    salts = max(1, int(tracks.sparkSession.conf.get("spark.sql.shuffle.partitions")) // blocks)
    p = places.select(place, F.col("lat").alias("_plat"), F.col("lon").alias("_plon"), F.pmod(F.xxhash64(place), F.lit(blocks)).alias("_block"), F.explode(F.sequence(F.lit(0), F.lit(salts - 1))).alias("_salt"))
    outer = levels[0].withColumn("_salt", F.pmod(F.xxhash64(*keys), F.lit(salts)).cast("int")).withColumn("_block", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long"))))
    named = haversine_km(F.col("_f.lat"), F.col("_f.lon"), F.col("_plat"), F.col("_plon"))
    met = outer.join(p, ["_block", "_salt"]).select(*keys, place, "_plat", "_plon", "_b0", named.alias("_ub"))
    steps = [met]
    for i in range(1, len(levels)):
        met = met.join(levels[i], [*keys, *finest[:i]]).withColumn("_ub", F.least("_ub", named))
        met = materialize(met.withColumn("_lb", box_km(F.col("_plat"), F.col("_plon"), *[F.col(c) for c in ("_s", "_n", "_w", "_e")])).select(*keys, place, "_plat", "_plon", *finest[: i + 1], "_ub", "_lb"))
        steps.append(met)
        met = met.withColumn("_ub", F.min("_ub").over(Window.partitionBy(*keys, place))).filter(F.col("_lb") <= F.col("_ub")).drop("_lb")
    near = met.join(fixes, [*keys, *finest])
    return [*steps, near.select(*keys, place, haversine_km(F.col("lat"), F.col("lon"), F.col("_plat"), F.col("_plon")).alias("_km"))]


def box_km(lat: Column, lon: Column, south: Column, north: Column, west: Column, east: Column) -> Column:
    """A bound that no point of a box is nearer than, in km.

    The largest of three: its distance in latitude, that to its nearer side as a meridian, and that to its middle less the
    way from there to a corner along a meridian and a parallel, which is close for boxes that are far off.
    """
    zero = F.lit(0.0)
    aside = [F.greatest(zero, west - (lon + k), (lon + k) - east) for k in (-360, 0, 360)]  # both ways round
    dlon = F.least(*aside)
    up = F.greatest(zero, south - lat, lat - north)
    side = F.when(dlon <= 90, F.degrees(F.asin(F.least(F.lit(1.0), F.sin(F.radians(dlon)) * F.cos(F.radians(lat)))))).otherwise(90 - F.abs(lat))
    k = EARTH_KM * math.pi / 180
    widest = F.cos(F.radians(F.when((south <= 0) & (north >= 0), 0.0).otherwise(F.least(F.abs(south), F.abs(north)))))
    middle = haversine_km(lat, lon, (south + north) / 2, (west + east) / 2) - (north - south + (east - west) * widest) / 2 * k
    return F.greatest(F.greatest(up, side) * k, middle) * (1 - 1e-9) - 1e-6


def normalise_tracks(raw: DataFrame) -> DataFrame:
    """Decoded member tracks: values beyond 1e10 are missing, pascal to hectopascal, valid time from lead, complete rows only."""
    clean = lambda c: F.when(F.abs(F.col(c)) <= 1e10, F.col(c))
    out = raw.withColumns({c: clean(c) for c in ("lat", "lon", "vmax_ms", "pmin_pa", "lead_h")}).dropna(subset=["lat", "lon", "lead_h"])
    valid = F.timestamp_seconds(epoch("init_utc") + F.col("lead_h") * 3600)
    return out.withColumn("pmin_hpa", F.col("pmin_pa") / 100).withColumn("valid_utc", valid).withColumn("rmw_km", F.lit(None).cast("double")).drop("pmin_pa")


def official_track(reading: DataFrame) -> DataFrame:
    """Forecast rows of a bulletin as a track: wind is the middle of its bounds in m/s, start is the first valid time.

    lead_h is a double of hours; lead_us is the same in whole microseconds, from which minutes can be told exactly.
    """
    from cutoffs.functions.wind import wind_to_ms

    f = reading.select("bulletin_id", F.posexplode("forecast").alias("seq", "f"))
    mid = (F.col("f.wind_min") + F.coalesce("f.wind_max", "f.wind_min")) / 2
    out = f.select("bulletin_id", "seq", F.col("f.valid_utc").alias("valid_utc"), F.col("f.lat").alias("lat"), F.col("f.lon").alias("lon"), wind_to_ms(mid, F.col("f.unit")).alias("vmax_ms"))
    init = F.min("valid_utc").over(Window.partitionBy("bulletin_id"))
    return out.withColumn("init_utc", init).withColumn("lead_us", F.unix_micros(F.col("valid_utc").cast("timestamp")) - F.unix_micros(F.col("init_utc").cast("timestamp"))).withColumn("lead_h", F.col("lead_us") / 3.6e9).withColumn("source", F.lit("official")).withColumn("member_no", F.lit(0).cast("long"))
