"""Raster and terrain operators over a 64 x 64 grid made of lineitem."""

from __future__ import annotations

from pyspark.sql import functions as F

from cutoffs.operators import raster, terrain
from cutoffs.registry import query, sql

#: Elevation of each cell, and the sea along one side.
GRID = "SELECT CAST(l_orderkey % 64 AS INTEGER) AS row, CAST(l_partkey % 64 AS INTEGER) AS col, CAST(sum(l_quantity) % 97 AS DOUBLE) AS value FROM lineitem GROUP BY 1, 2"
SCENES = "SELECT CAST(l_suppkey % 3 AS INTEGER) AS orbit, l_shipdate AS acquired, CAST(l_orderkey % 64 AS INTEGER) AS row, CAST(l_partkey % 64 AS INTEGER) AS col, -l_quantity / 2 AS vv FROM lineitem"
G = f"g AS ({GRID})"
OFFSETS = "o AS (SELECT i.i, j.j FROM (SELECT unnest([-1, 0, 1]) AS i) i, (SELECT unnest([-1, 0, 1]) AS j) j)"


def grid(spark, sf):
    return sql(spark, sf, GRID)


def terrain_grid(spark, sf):
    """The grid with its first column as outlet and some permanent water."""
    return grid(spark, sf).select("row", "col", F.col("value").alias("elev"), (F.col("col") == 0).alias("outlet"), (F.col("value") % 31 == 0).alias("water"))


_SMALL = f"{G}, s AS (SELECT row, col, value AS elev, col = 0 AS outlet, value % 31 = 0 AS water, CAST(row AS BIGINT) * 1048576 + col AS cell FROM g)"


@query("SRC14_window_clip", f"WITH {G} SELECT row, col, value FROM g WHERE 80 + col * 0.1e0 BETWEEN 81 AND 83 AND 20 - row * 0.1e0 BETWEEN 15 AND 18")
def src14(spark, sf):
    p = grid(spark, sf).withColumn("lon", 80 + F.col("col") * 0.1).withColumn("lat", 20 - F.col("row") * 0.1)
    return raster.clip(p, 81, 83, 15, 18).select("row", "col", "value")


@query("SRC15_mosaic_average", f"WITH {G} SELECT CAST(row // 3 AS BIGINT) AS row, CAST(col // 3 AS BIGINT) AS col, round(avg(value), 6) AS value FROM g GROUP BY 1, 2")
def src15(spark, sf):
    return raster.mosaic(grid(spark, sf), 3).withColumn("value", F.round("value", 6))


@query("SRC15_mosaic_max", f"WITH {G} SELECT CAST(row // 3 AS BIGINT) AS row, CAST(col // 3 AS BIGINT) AS col, max(value) AS value FROM g GROUP BY 1, 2")
def src15_max(spark, sf):
    return raster.mosaic(grid(spark, sf), 3, "max")


_PTS = "SELECT event_id, 5e0 + (event_id % 997) / 1e2 AS lat, 80e0 + (event_id % 991) / 1e2 AS lon FROM events"


@query("SRC16_point_sample", f"WITH {G}, e AS ({_PTS}) SELECT event_id, coalesce(value, 255.0) AS value FROM e LEFT JOIN g ON g.row = floor((15 - lat) / 0.125) AND g.col = floor((lon - 80) / 0.125)")
def src16(spark, sf):
    row, col = raster.cell_of(F.col("lon"), F.col("lat"), 80.0, 15.0, 0.125)
    p = sql(spark, sf, _PTS).select("event_id", row.alias("row"), col.alias("col"))
    return raster.sample(p, grid(spark, sf), 255.0).select("event_id", "value")


@query("SRC17_cell_lookup", f"WITH {G}, e AS ({_PTS}) SELECT event_id, coalesce(CAST(g.row AS BIGINT) * 64 + g.col, -1) AS cell FROM e LEFT JOIN g ON g.row = floor((15 - lat) / 0.125) AND g.col = floor((lon - 80) / 0.125) AND value <= 40")
def src17(spark, sf):
    row, col = raster.cell_of(F.col("lon"), F.col("lat"), 80.0, 15.0, 0.125)
    p = sql(spark, sf, _PTS).select("event_id", row.alias("row"), col.alias("col"))
    ids = grid(spark, sf).filter("value <= 40").select("row", "col", (F.col("row").cast("long") * 64 + F.col("col")).alias("value"))
    return raster.sample(p, ids, name="cell").select("event_id", F.coalesce("cell", F.lit(-1)).cast("long").alias("cell"))


@query("J19_neighbour_join", f"WITH {G}, {OFFSETS} SELECT a.row, a.col, b.row AS nrow, b.col AS ncol FROM g a, o, g b WHERE b.row = a.row + i AND b.col = a.col + j AND NOT (i = 0 AND j = 0)")
def j19(spark, sf):
    return raster.neighbours(grid(spark, sf).select("row", "col"))


@query("SC29_terrain_masks", f"""WITH {G}, p AS (SELECT row, col, CASE WHEN value > 90 THEN NULL ELSE value - 5 END AS elev, value % 100 AS occ FROM g), m AS (SELECT *, elev IS NULL OR elev <= 0 AS outlet, occ >= 80 AS water FROM p), {OFFSETS},
s AS (SELECT DISTINCT a.row, a.col FROM m a, o, m b WHERE b.row = a.row + i AND b.col = a.col + j AND NOT (i = 0 AND j = 0) AND b.outlet AND NOT a.outlet AND a.elev <= 20)
SELECT m.row, m.col, outlet, water, NOT outlet AND elev <= 20 AS candidate, s.row IS NOT NULL AS seed FROM m LEFT JOIN s ON m.row = s.row AND m.col = s.col""")
def sc29(spark, sf):
    p = grid(spark, sf).select("row", "col", F.when(F.col("value") <= 90, F.col("value") - 5).alias("elev"), (F.col("value") % 100).alias("occurrence"))
    out = raster.terrain_masks(p, low_m=20.0)
    return out.select("row", "col", "outlet", "water", F.coalesce("candidate", F.lit(False)).alias("candidate"), "seed")


@query("AG22_pixel_median", f"WITH s AS ({SCENES}) SELECT orbit, row, col, quantile_cont(vv, 0.5) AS median_vv FROM s WHERE acquired >= TIMESTAMP '1995-01-01' AND acquired < TIMESTAMP '1996-01-01' GROUP BY 1, 2, 3")
def ag22(spark, sf):
    return raster.pixel_median(sql(spark, sf, SCENES), F.lit("1995-01-01").cast("timestamp"), F.lit("1996-01-01").cast("timestamp"))


@query("AG23_focal_median", f"WITH {G}, {OFFSETS} SELECT a.row, a.col, quantile_cont(b.value, 0.5) AS focal FROM g a, o, g b WHERE b.row = a.row + i AND b.col = a.col + j GROUP BY 1, 2")
def ag23(spark, sf):
    return raster.focal_median(grid(spark, sf)).select("row", "col", "focal")


@query("SC26_flood_rule", "SELECT l_orderkey, l_linenumber, count(*) FILTER (WHERE -l_quantity / 2 + l_discount * 100 < -3 AND -l_quantity / 2 < -16 AND l_returnflag <> 'A' AND l_tax * 100 < 5 AND l_partkey % 40 < 15) AS wet FROM lineitem GROUP BY 1, 2")
def sc26(spark, sf):
    t = sql(spark, sf, "SELECT l_orderkey, l_linenumber, -l_quantity / 2 AS post, -l_discount * 100 AS pre, l_returnflag = 'A' AS water, l_tax * 100 AS slope, l_partkey % 40 AS hand FROM lineitem")
    wet = raster.flooded(*(F.col(c) for c in ("pre", "post", "water", "slope", "hand")))
    return t.groupBy("l_orderkey", "l_linenumber").agg(F.count(F.when(wet, 1)).alias("wet"))


@query("W12_earliest_pass_mosaic", f"""WITH s AS ({SCENES}), b AS (SELECT DISTINCT orbit FROM s WHERE acquired < TIMESTAMP '1996-01-01'),
a AS (SELECT row, col, orbit, acquired, vv, CAST(least(254, greatest(0, floor((epoch_us(acquired) - epoch_us(TIMESTAMP '1996-01-01')) / 3.6e9))) AS INTEGER) AS h FROM s WHERE acquired >= TIMESTAMP '1996-01-01' AND orbit IN (SELECT orbit FROM b)),
r AS (SELECT *, row_number() OVER (PARTITION BY row, col ORDER BY acquired, orbit, h, vv) AS k FROM a) SELECT row, col, orbit, h AS obs_h, vv FROM r WHERE k = 1""")
def w12(spark, sf):
    s = sql(spark, sf, SCENES).withColumn("acquired", F.col("acquired").cast("timestamp"))
    return raster.observed_mosaic(s, F.lit("1996-01-01").cast("timestamp"))


_SAMPLES = "SELECT l_orderkey AS edge_id, l_linenumber % 5 AS k, CASE WHEN l_quantity > 45 THEN 255 WHEN l_quantity > 25 THEN 1 ELSE 0 END AS value FROM lineitem"


@query("SC27_observed_edges", f"""WITH s AS ({_SAMPLES}), a AS (SELECT edge_id, count(*) FILTER (WHERE value <> 255) AS observed, count(*) FILTER (WHERE value = 1) AS n, coalesce(max(CASE WHEN value = 1 THEN 1 ELSE 0 END) FILTER (WHERE k = 2 AND value <> 255), 0) AS mid FROM s GROUP BY 1)
SELECT edge_id, observed, CASE WHEN observed > 0 THEN mid = 1 OR n >= 2 END AS flooded FROM a""")
def sc27(spark, sf):
    return raster.observed_edges(sql(spark, sf, _SAMPLES))


@query("AG1_population_cells", f"WITH {G}, p AS (SELECT row // 8 * 8 + col // 8 AS cell, value, CAST(col AS DOUBLE) AS x, CAST(row AS DOUBLE) AS y FROM g WHERE value > 0) SELECT CAST(cell AS BIGINT) AS cell, sum(value) AS population, round(sum(x * value) / sum(value), 6) AS x, round(sum(y * value) / sum(value), 6) AS y FROM p GROUP BY 1 HAVING sum(value) >= 3000")
def ag1(spark, sf):
    p = grid(spark, sf).select((F.floor(F.col("row") / 8) * 8 + F.floor(F.col("col") / 8)).alias("cell"), "value", F.col("col").cast("double").alias("x"), F.col("row").cast("double").alias("y"))
    return raster.population_cells(p, 3000.0).withColumn("x", F.round("x", 6)).withColumn("y", F.round("y", 6))


_ES = "SELECT l_orderkey AS edge_id, l_linenumber * 100e0 AS dist, 700e0 AS length, l_quantity AS value FROM lineitem"


@query("AG2_edge_minima", f"WITH s AS ({_ES}) SELECT edge_id, min(value) AS min_hand_m, min(value) FILTER (WHERE dist <= 200) AS hand_u_end_m, min(value) FILTER (WHERE dist >= length - 200) AS hand_v_end_m FROM s GROUP BY 1")
def ag2(spark, sf):
    return raster.edge_minima(sql(spark, sf, _ES))


@query("AG3_min_elevation", "SELECT l_orderkey AS edge_id, min(l_extendedprice) AS min_elev_m FROM lineitem GROUP BY 1")
def ag3(spark, sf):
    return sql(spark, sf, "SELECT l_orderkey, l_extendedprice FROM lineitem").groupBy(F.col("l_orderkey").alias("edge_id")).agg(F.min("l_extendedprice").alias("min_elev_m"))


@query("AG4_lowest_cell", "WITH r AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_quantity, l_linenumber, l_partkey) AS k FROM lineitem) SELECT l_orderkey AS edge_id, l_partkey AS cell FROM r WHERE k = 1")
def ag4(spark, sf):
    t = sql(spark, sf, "SELECT l_orderkey, l_quantity, l_linenumber, l_partkey FROM lineitem")
    return t.groupBy(F.col("l_orderkey").alias("edge_id")).agg(F.min(F.struct("l_quantity", "l_linenumber", "l_partkey")).alias("m")).select("edge_id", F.col("m.l_partkey").alias("cell"))


_FL = "SELECT c_nationkey AS patch, c_custkey % 8 AS member, CAST(floor(abs(c_acctbal) / 1000) AS DOUBLE) AS h, CAST(c_custkey % 5 + 1 AS DOUBLE) AS w FROM customer"


@query("AG21_exceedance", f"WITH {G}, f AS ({_FL}), p AS (SELECT row, col, (row + col) % 25 AS patch, value / 10 AS hand FROM g) SELECT row, col, coalesce(sum(w) FILTER (WHERE h > hand + 0.3), 0) + 0e0 AS p FROM p JOIN f ON p.patch = f.patch GROUP BY 1, 2")
def ag21(spark, sf):
    p = grid(spark, sf).select("row", "col", ((F.col("row") + F.col("col")) % 25).alias("patch"), (F.col("value") / 10).alias("hand"))
    return raster.exceedance(p, sql(spark, sf, _FL))


_WET = "SELECT CAST(l_orderkey % 64 AS INTEGER) AS row, CAST(l_partkey % 64 AS INTEGER) AS col, l_quantity AS w, l_discount AS depth, CAST(l_linenumber AS DOUBLE) AS onset FROM lineitem"


@query("AG20_surge_summary", f"WITH c AS ({_WET}) SELECT row, col, sum(w) AS p, max(depth) AS depth_max_m, round(sum(w * onset) / sum(w), 6) AS onset_h_mean FROM c GROUP BY 1, 2")
def ag20(spark, sf):
    return raster.surge_summary(sql(spark, sf, _WET)).withColumn("onset_h_mean", F.round("onset_h_mean", 6))


@query("AG27_percentiles", f"WITH {G} SELECT round(quantile_cont(value, 0.1), 6) AS p10, round(quantile_cont(value, 0.5), 6) AS p50, round(quantile_cont(value, 0.9), 6) AS p90 FROM g")
def ag27(spark, sf):
    p = raster.percentiles(grid(spark, sf), [0.1, 0.5, 0.9])
    return p.select(*[F.round(n, 6).alias(n) for n in ("p10", "p50", "p90")])


_LEVEL = f"""{_SMALL}, {OFFSETS}, e AS (SELECT a.cell AS x, b.cell AS y, greatest(a.elev, b.elev) AS c FROM s a, o, s b WHERE b.row = a.row + i AND b.col = a.col + j AND NOT (i = 0 AND j = 0)),
r(cell, b) AS (SELECT cell, elev FROM s WHERE outlet UNION SELECT e.y, greatest(r.b, e.c) FROM r JOIN e ON r.cell = e.x), l AS (SELECT cell, min(b) AS level FROM r GROUP BY cell)"""


@query("G9_flood_levels", f"WITH RECURSIVE {_LEVEL} SELECT s.row, s.col, l.level FROM s JOIN l ON s.cell = l.cell")
def g9(spark, sf):
    return terrain.flood_levels(terrain_grid(spark, sf)).select("row", "col", "level")


@query("G10_flow_directions")
def g10(spark, sf):
    return terrain.flow_directions(terrain.flood_levels(terrain_grid(spark, sf)))


_DOWN = "SELECT DISTINCT l_partkey AS cell, l_partkey // 2 AS down FROM lineitem"


@query("G11_flow_accumulation", f"WITH RECURSIVE d AS ({_DOWN}), n AS (SELECT cell FROM d UNION SELECT down FROM d), r(cell, up) AS (SELECT cell, cell FROM n UNION SELECT d.down, r.up FROM r JOIN d ON r.cell = d.cell WHERE d.down <> d.cell) SELECT cell, count(*) AS acc FROM r GROUP BY cell")
def g11(spark, sf):
    d = sql(spark, sf, "SELECT DISTINCT l_partkey AS cell, l_partkey DIV 2 AS down FROM lineitem")
    ends = d.select(F.col("down").alias("cell")).distinct().join(d, "cell", "left_anti").select("cell", F.col("cell").alias("down"))
    return terrain.accumulate(d.unionByName(ends))


@query("G12_height_above_drainage")
def g12(spark, sf):
    return terrain.height_above_drainage(terrain_grid(spark, sf), stream_cells=20)


_FILL = f"{G}, c AS (SELECT DISTINCT m.m AS member, row, col FROM g, (SELECT unnest([0, 1, 2]) AS m) m WHERE value < 35 + 10 * m.m)"


@query("G7_flood_fill", f"""WITH RECURSIVE {_FILL}, {OFFSETS}, r(member, row, col) AS (SELECT member, row, col FROM c WHERE col = 0 UNION SELECT c.member, c.row, c.col FROM r, o, c WHERE c.member = r.member AND c.row = r.row + i AND c.col = r.col + j) SELECT CAST(member AS INTEGER) AS member, row, col FROM r""")
def g7(spark, sf):
    members = spark.range(3).select(F.col("id").cast("int").alias("member"))
    wet = grid(spark, sf).join(F.broadcast(members)).filter("value < 35 + 10 * member").withColumn("seed", F.col("col") == 0)
    return terrain.flood_fill(wet, ["member"])
