"""Back-trajectories: parcels, uptake of moisture along them, and gridding of the uptakes."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from isobar.functions.geo import haversine
from isobar.operators.raster import gaussian_filter

#: Starting height in metres to pressure level in hPa.
LEVELS = {1500: 850, 2250: 770, 2625: 735, 3000: 700, 5500: 500}


def level_pressure(level: int) -> int:
    if level not in LEVELS:
        raise ValueError(f"no pressure level for a height of {level} m; one of {sorted(LEVELS)}")
    return LEVELS[level]


def points_within(centers: DataFrame, radius_km: float = 500.0, step_lat: float = 0.5, step_lon: float = 1.0) -> DataFrame:
    """Grid points within a great-circle radius of each centre (lat, lon), longitudes wrapped, poles left out.

    The distance is that of a sphere, within half a percent of the ellipsoid's.
    """
    reach = radius_km / 111.0
    rows = math.ceil(reach / step_lat)
    grid = centers.withColumn("_i", F.explode(F.sequence(F.lit(-rows), F.lit(rows))))
    grid = grid.withColumn("plat", F.round(F.col("lat") / step_lat) * step_lat + F.col("_i") * step_lat).where(F.abs(F.col("plat")) < 90)
    wide = F.least(F.ceil(F.lit(reach / step_lon) / F.greatest(F.cos(F.radians("plat")), F.lit(0.01))), F.lit(int(180 / step_lon))).cast("int")
    grid = grid.withColumn("_j", F.explode(F.sequence(-wide, wide)))
    lon = F.round(F.col("lon") / step_lon) * step_lon + F.col("_j") * step_lon
    grid = grid.withColumn("plon", F.pmod(lon + 180, F.lit(360.0)) - 180)
    near = haversine(F.col("lat"), F.col("plat"), F.col("lon"), F.col("plon"), "km") <= radius_km
    return grid.where(near).drop("_i", "_j").dropDuplicates()


def geodesic_circle(lat: float, lon: float, radius_km: float, azimuths: int = 72) -> list[tuple[float, float]]:
    """Points of a circle on the sphere, from north clockwise, closed."""
    d, out = radius_km / 6371.0, []
    for k in range(azimuths + 1):
        b, p = math.radians(k % azimuths * 360 / azimuths), math.radians(lat)
        q = math.asin(math.sin(p) * math.cos(d) + math.cos(p) * math.sin(d) * math.cos(b))
        away = math.atan2(math.sin(b) * math.sin(d) * math.cos(p), math.cos(d) - math.sin(p) * math.sin(q))
        out.append((math.degrees(q), (lon + math.degrees(away) + 180) % 360 - 180))
    return out


def precipitating(rows: DataFrame, tp_mm: float = 0.1, cwc_mg: float = 10.0, drop_g: float = 0.1) -> DataFrame:
    """Parcels (tp in m, cwc and q, q_before in kg/kg) where it rains, there is cloud water, and humidity fell within the hour."""
    return rows.where((F.col("tp") * 1000 > tp_mm) & (F.col("cwc") * 1e6 > cwc_mg) & ((F.col("q_before") - F.col("q")) * 1000 >= drop_g))


def uptakes(traj: DataFrame, least_g: float = 0.025, key: str = "traj_id", order: str = "time", scale: float = 1000.0) -> DataFrame:
    """Trajectory steps whose humidity q rose by at least so much (g/kg) since the step before."""
    before = F.lag("q").over(W.partitionBy(key).orderBy(order))
    return traj.withColumn("dq", (F.col("q") - before) * scale).where(F.col("dq") >= least_g)


#: Rows of an axis that is broadcast; longer ones are shuffled.
BROADCAST_ROWS = 200_000


def nearest_axis(points: DataFrame, axis: DataFrame, value: str, coordinate: str, out: str) -> DataFrame:
    """The axis point nearest to each value, the first on ties; null for a null value or an empty axis.

    Neighbouring axis points make brackets, the first and the last being open.  Brackets and values meet by buckets of the
    axis's mean spacing: a bracket lies in as many buckets as it is wide, together at most twice as many as there are
    axis points.  A value is in one bracket, whose nearer end it takes.
    """
    distinct = axis.select(F.col(coordinate).cast("double").alias("_low")).where("_low IS NOT NULL").distinct()
    span = distinct.agg(F.min("_low").alias("a"), F.max("_low").alias("b"), F.count(F.lit(1)).alias("n")).first()
    if not span["n"]:
        return points.withColumn(out, F.lit(None).cast("double"))
    first, width, last = span["a"], (span["b"] - span["a"]) / max(1, span["n"] - 1) or 1.0, span["n"]
    bucket = lambda c: F.floor(F.least(F.greatest((c - first) / width, F.lit(-1.0)), F.lit(float(last)))).cast("bigint")
    # an axis is a list of coordinates, however many points there are
    order = W.orderBy("_low")
    brackets = distinct.withColumn("_high", F.lead("_low").over(order))
    below = distinct.agg(F.lit(None).cast("double").alias("_low"), F.min("_low").alias("_high"))
    brackets = brackets.unionByName(below)
    # greatest and least pass over nulls
    open_or = lambda c, end: F.when(F.col(c).isNull(), F.lit(end)).otherwise(bucket(F.col(c)))
    ends = F.sequence(open_or("_low", -1), open_or("_high", last))
    placed = brackets.withColumn("_bucket", F.explode(ends))
    if last <= BROADCAST_ROWS:
        placed = F.broadcast(placed)
    at = F.col(value).cast("double")
    inside = (F.col("_low").isNull() | (at >= F.col("_low"))) & (F.col("_high").isNull() | (at < F.col("_high")))
    pick = F.when(F.col("_low").isNull() | (F.abs(F.col("_high") - at) < F.abs(at - F.col("_low"))), F.col("_high")).otherwise(F.col("_low"))
    met = points.withColumn("_at", bucket(at)).join(placed, (F.col("_at") == F.col("_bucket")) & inside, "left")
    return met.withColumn(out, pick).drop("_at", "_bucket", "_low", "_high")


def humidity_at(points: DataFrame, humidity: DataFrame, axes: Sequence[str] = ("plev", "lat", "lon")) -> DataFrame:
    """Humidity of the nearest grid point on every axis at the point's time (ts)."""
    out = points
    for a in axes:
        out = nearest_axis(out, humidity, a, a, f"near_{a}")
    grid = humidity.select("ts", *[F.col(a).cast("double").alias(f"near_{a}") for a in axes], "q", *[c for c in ("cwc",) if c in humidity.columns])
    return out.join(grid, ["ts", *[f"near_{a}" for a in axes]], "left")


def diagnose_uptakes(traj: DataFrame, humidity: DataFrame, least_g: float = 0.025, axes: Sequence[str] = ("plev", "lat", "lon"), key: str = "traj_id", order: str = "time") -> DataFrame:
    """Uptake events of trajectories: humidity is sampled at the nearest grid point of each step's time, and steps where it
    rose by at least ``least_g`` g/kg since the step before are events, with q and dq (g/kg).

    traj: key, order, ts and the axes; humidity: ts, the axes, q in kg/kg.  Steps without humidity aren't events, nor are steps behind one.
    """
    return uptakes(humidity_at(traj, humidity, axes), least_g, key, order)


def uptake_maps(events: DataFrame, marks: DataFrame, shape: tuple[int, int], hours: Sequence[int] = (-24, 0, 24), sigma: float = 5.0, cell_km: float = 31.0) -> DataFrame:
    """hours, y, x, v: the smoothed density of the uptakes within the hour ``hours`` away from each storm's mark, as :func:`uptake_map`.

    events: storm, ts, y, x; marks: storm, ts.  An event counts for each of the hours it fits.
    """
    each = marks.select("storm", F.explode(F.array(*[F.lit(h) for h in hours])).alias("hours"), F.col("ts").alias("_mark"))
    target = F.date_trunc("hour", F.col("_mark") + F.make_interval(hours=F.col("hours")))
    met = events.withColumn("_hour", F.date_trunc("hour", "ts")).join(each.withColumn("_target", target), "storm").where(F.col("_hour") == F.col("_target"))
    return uptake_map(met.select("y", "x", "hours"), shape, sigma, cell_km, "hours").withColumnRenamed("t", "hours")


def uptake_percent(points: DataFrame, step_lat: float = 0.5, step_lon: float = 1.0) -> DataFrame:
    """Uptakes per half-degree cell and their percentage of all."""
    row, col = F.floor(F.col("lat") / step_lat + 0.5).cast("int"), F.floor(F.col("lon") / step_lon + 0.5).cast("int")
    made = points.groupBy(row.alias("row"), col.alias("col")).agg(F.count(F.lit(1)).alias("n"))
    return made.withColumn("percent", 100 * F.col("n") / F.sum("n").over(W.partitionBy(F.lit(0))))


def uptake_map(points: DataFrame, shape: tuple[int, int], sigma: float = 5.0, cell_km: float = 31.0, times: str | None = None) -> DataFrame:
    """Smoothed uptake density per 1e5 square kilometres: percent per cell, Gaussian on the torus, scaled by the cell's area.

    points: y, x, with the time column named by ``times`` for separate maps.
    """
    t = F.col(times) if times else F.lit(0)
    made = points.groupBy(t.alias("t"), "y", "x").agg(F.count(F.lit(1)).alias("n"))
    made = made.withColumn("v", 100.0 * F.col("n") / F.sum("n").over(W.partitionBy("t"))).drop("n")
    return gaussian_filter(made, sigma, shape).withColumn("v", F.col("v") * 1e5 / cell_km**2)


def entry_windows(rows: DataFrame, key: str = "tid", around: int = 8) -> DataFrame:
    """Row numbers (from 0) of a track's first entry into the mask (inside = 1), so many rows either side, its middle and its end."""
    n = F.row_number().over(W.partitionBy(key).orderBy("time")) - 1
    made = rows.withColumn("_n", n).groupBy(key).agg(F.min(F.when(F.col("inside") == 1, F.col("_n"))).alias("entry"), F.max("_n").alias("last"))
    made = made.where(F.col("entry").isNotNull())
    return made.select(key, "entry", F.greatest(F.col("entry") - around, F.lit(0)).alias("before"), F.least(F.col("entry") + around, F.col("last")).alias("after"), F.floor((F.col("entry") + F.col("last")) / 2).cast("int").alias("middle"), F.col("last").alias("end"))


def every_nth(traj: DataFrame, n: int, key: str = "traj_id") -> DataFrame:
    return traj.where(F.col(key) % n == 0)


def point_of_each(traj: DataFrame, seed: int = 0, key: str = "traj_id", order: str = "time") -> DataFrame:
    """One point of each trajectory, picked by hash, the same in each run."""
    pick = W.partitionBy(key).orderBy(F.xxhash64(F.lit(seed), F.col(key), F.col(order)), order)
    return traj.withColumn("_r", F.row_number().over(pick)).where("_r = 1").drop("_r")


def total_cloud_water(frame: DataFrame) -> DataFrame:
    """cwc = ice + liquid cloud water, which both go."""
    return frame.withColumn("cwc", F.col("ciwc") + F.col("clwc")).drop("ciwc", "clwc")


def control_text(ts: Column, lat: Column, lon: Column, height: Column, hours: int, met_folder: str, met_files: Column, out_folder: str, name: Column) -> Column:
    """Text of a trajectory model's control file for one start."""
    start = F.date_format(ts, "yy MM dd HH")
    point = F.concat_ws(" ", lat.cast("string"), lon.cast("string"), height.cast("string"))
    files = F.concat_ws("\n", F.transform(met_files, lambda f: F.concat(F.lit(f"{met_folder}\n"), f)))
    return F.concat_ws("\n", start, F.lit("1"), point, F.lit(str(hours)), F.lit("0"), F.lit("10000.0"), F.size(met_files).cast("string"), files, F.lit(out_folder), name)


def met_files(ts: Column, hours_back: int = 120) -> Column:
    """Monthly files that a backward run needs: its month's, and the one before if the run reaches into it."""
    from_ts = ts - F.make_interval(hours=F.lit(hours_back))
    month = lambda c: F.date_format(c, "yyyyMM")
    return F.when(month(ts) == month(from_ts), F.array(month(ts))).otherwise(F.array(month(from_ts), month(ts)))
