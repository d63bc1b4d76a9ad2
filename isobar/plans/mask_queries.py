"""Masks, nearest points and areas."""

from __future__ import annotations

from pyspark.sql import functions as F

from isobar.operators import masks as M
from isobar.operators.label import components as labelled
from isobar.plans.adapters import FIELD_SQL, OBS_SQL, SHAPE, field, obs
from isobar.plans.grid_queries import POINTS_SQL, field_points
from isobar.plans.registry import query
from isobar.plans.track_queries import REGION_SQL, hav, region_view

GRID_SQL = "gr AS (SELECT CAST(i // 32 AS INTEGER) AS y, CAST(i % 32 AS INTEGER) AS x, (i // 32)*2e0 - 8 AS lat, (i*37 % 2000)*1e0 AS z FROM range(1024) t(i))"


def grid(spark):
    """Latitude and elevation of the field view's cells."""
    i = F.col("id")
    return spark.range(SHAPE[0] * SHAPE[1]).select((i / 32).cast("int").alias("y"), (i % 32).cast("int").alias("x"), ((i / 32).cast("int") * 2.0 - 8).alias("lat"), (i * 37 % 2000 * 1.0).alias("z"))


@query(f"WITH {OBS_SQL} SELECT tid, time, CASE WHEN p_cent BETWEEN 96000 AND 100000 THEN p_cent END AS p_cent FROM obs")
def validity_mask(spark, sf_dir):
    return obs(spark, sf_dir).select("tid", "time", M.valid_range(F.col("p_cent"), 96000.0, 100000.0).alias("p_cent"))


@query(f"WITH {FIELD_SQL}, {GRID_SQL} SELECT f.t, f.y, f.x, v, z > 1500 OR lat < 5 AS mask FROM field f JOIN gr USING (y, x)")
def elevation_mask(spark, sf_dir):
    return M.ground_mask(field(spark, sf_dir), grid(spark))


@query(f"WITH {FIELD_SQL}, {GRID_SQL} SELECT f.t, f.y, f.x, CASE WHEN lat >= 0 THEN v END AS v FROM field f JOIN gr USING (y, x)")
def hemisphere_cut(spark, sf_dir):
    return M.hemisphere_cut(field(spark, sf_dir), grid(spark))


@query(f"WITH {REGION_SQL} SELECT y, x FROM region WHERE region BETWEEN 1 AND 5 AND region IN (2, 5, 6)")
def class_mask(spark, sf_dir):
    return M.class_mask(region_view(spark), 1, 5, [2, 5, 6])


@query(f"""WITH {OBS_SQL}, s AS (SELECT DISTINCT id % 40 AS target, 25 + (id % 40) AS lat, (id % 40)*9 - 180 AS lon FROM obs), p AS (SELECT o.id, s.target, {hav('o.lat', 's.lat', 'o.lon', 's.lon')} AS d FROM obs o JOIN s ON true),
 b AS (SELECT id, arg_min(target, {{'d': d, 't': target}}) AS target, min(d) AS distance FROM p WHERE d <= 800 GROUP BY id) SELECT o.id, target, round(distance, 5) AS distance FROM obs o LEFT JOIN b USING (id)""")
def nearest_point_join(spark, sf_dir):
    stations = spark.range(40).select(F.col("id").alias("target"), (F.col("id") + 25.0).alias("lat"), (F.col("id") * 9.0 - 180).alias("lon"))
    got = M.nearest_point(obs(spark, sf_dir).select("id", "lat", "lon"), stations, 800.0)
    return got.select("id", "target", F.round("distance", 5).alias("distance"))


@query(f"""WITH RECURSIVE {FIELD_SQL}, {POINTS_SQL}, c AS (SELECT t, y, x, y*32 + x AS k FROM field WHERE v < -0.15e0), q(t, y, x, k) AS (SELECT t, y, x, k FROM c UNION SELECT c.t, c.y, c.x, q.k FROM q JOIN c ON c.t = q.t AND abs(c.y - q.y) + abs(c.x - q.x) = 1 AND q.k < c.k),
 l AS (SELECT t, y, x, min(k) AS label FROM q GROUP BY t, y, x), b AS (SELECT p.t, p.y, p.x, min((l.y - p.y)**2 + (l.x - p.x)**2) AS d2, arg_min(label, {{'d': (l.y - p.y)**2 + (l.x - p.x)**2, 'k': label}}) AS label FROM (SELECT DISTINCT * FROM pts) p JOIN l ON l.t = p.t AND abs(l.y - p.y) <= 4 AND abs(l.x - p.x) <= 4 GROUP BY ALL)
 SELECT p.t, p.y, p.x, CAST(label AS INTEGER) AS label, round(sqrt(d2), 9) AS distance FROM pts p LEFT JOIN b USING (t, y, x)""")
def nearest_area_join(spark, sf_dir):
    areas = labelled(field(spark, sf_dir).where("v < -0.15"), SHAPE)
    return M.nearest_area(field_points(spark, sf_dir), areas, 4).withColumn("distance", F.round("distance", 9))


@query(f"""WITH {OBS_SQL}, s AS (SELECT DISTINCT id % 40 AS target, 25 + (id % 40)*0.3e0 AS lat, (id % 40)*2e0 - 180 AS lon FROM obs)
 SELECT o.id, arg_min(s.target, {{'d': {hav('o.lat', 's.lat', 'o.lon', 's.lon')}, 't': s.target}}) AS target, round(min({hav('o.lat', 's.lat', 'o.lon', 's.lon')}), 5) AS distance FROM obs o JOIN s ON true GROUP BY o.id""")
def nearest_point_anywhere(spark, sf_dir):
    """The nearest of stations that are far from most points: no bound on the distance."""
    stations = spark.range(40).select(F.col("id").alias("target"), (F.col("id") * 0.3 + 25.0).alias("lat"), (F.col("id") * 2.0 - 180).alias("lon"))
    got = M.nearest_point(obs(spark, sf_dir).select("id", "lat", "lon"), stations)
    return got.select("id", "target", F.round("distance", 5).alias("distance"))


@query(f"""WITH {FIELD_SQL}, {POINTS_SQL}, l AS (SELECT t, y, x, y*32 + x AS label FROM field WHERE v < -0.3e0), b AS (SELECT p.t, p.y, p.x, min((l.y - p.y)**2 + (l.x - p.x)**2) AS d2, arg_min(label, {{'d': (l.y - p.y)**2 + (l.x - p.x)**2, 'k': label}}) AS label FROM (SELECT DISTINCT * FROM pts) p JOIN l ON l.t = p.t GROUP BY ALL)
 SELECT p.t, p.y, p.x, CAST(label AS INTEGER) AS label, round(sqrt(d2), 9) AS distance FROM pts p LEFT JOIN b USING (t, y, x)""")
def nearest_area_anywhere(spark, sf_dir):
    areas = field(spark, sf_dir).where("v < -0.3").select("t", "y", "x", (F.col("y") * 32 + F.col("x")).alias("label"))
    return M.nearest_area(field_points(spark, sf_dir), areas, shape=SHAPE).withColumn("distance", F.round("distance", 9))


@query(f"WITH {OBS_SQL} SELECT DISTINCT y, x FROM obs WHERE type = 1 EXCEPT SELECT y, x FROM obs WHERE type = 2")
def cells_except(spark, sf_dir):
    rows = obs(spark, sf_dir)
    return rows.where("type = 1").select("y", "x").subtract(rows.where("type = 2").select("y", "x"))


@query(f"WITH {OBS_SQL} SELECT y, x FROM obs WHERE type = 1 INTERSECT SELECT y, x FROM obs WHERE type = 2")
def cells_intersect(spark, sf_dir):
    rows = obs(spark, sf_dir)
    return rows.where("type = 1").select("y", "x").intersect(rows.where("type = 2").select("y", "x"))


@query(f"WITH {OBS_SQL} SELECT tid, k, time, lat, lon FROM obs QUALIFY row_number() OVER (PARTITION BY tid ORDER BY time DESC) = 1")
def latest_rows(spark, sf_dir):
    return M.latest_of(obs(spark, sf_dir), ["tid"], "time").select("tid", "k", "time", "lat", "lon")


@query(f"WITH {FIELD_SQL} SELECT t, y, x, v FROM field WHERE y BETWEEN 2 AND 29")
def rows_trimmed(spark, sf_dir):
    """A field without its outermost rows of latitude."""
    return M.trim_rows(field(spark, sf_dir), SHAPE[0], 2, 2)


@query(f"WITH {OBS_SQL} SELECT tid, time, lat, lon, p_cent FROM obs WHERE tid = 3")
def storm_extract(spark, sf_dir):
    return M.storm_rows(obs(spark, sf_dir), F.col("tid") == 3, ["tid", "time", "lat", "lon", "p_cent"])
