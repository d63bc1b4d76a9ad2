"""Scalar functions over the views."""

from __future__ import annotations

from pyspark.sql import functions as F

from isobar.functions import caltime as C, geo as G
from isobar.plans.adapters import OBS_SQL, obs, read, season_rows
from isobar.plans.registry import query
from isobar.plans.track_queries import hav


@query(f"WITH {OBS_SQL} SELECT tid, time, round({hav('lat', '60e0', 'lon', '10e0')}, 6) AS km, round({hav('lat', '60e0', 'lon', '10e0')}*1000*0.000621371e0, 6) AS mi FROM obs")
def haversine_distance(spark, sf_dir):
    d = lambda u: F.round(G.haversine(F.col("lat"), F.lit(60.0), F.col("lon"), F.lit(10.0), u), 6)
    return obs(spark, sf_dir).select("tid", "time", d("km").alias("km"), d("mi").alias("mi"))


@query(f"""WITH {OBS_SQL}, q AS (SELECT *, (pow(sin(area*20/6371e0/2), 2) - pow(sin((radians(lat + 0.1e0) - radians(lat))/2), 2))/(cos(radians(lat))*cos(radians(lat + 0.1e0))) AS s FROM obs)
 SELECT tid, time, round(degrees(area*20/6371e0), 9) AS dlat, CASE WHEN s BETWEEN 0 AND 1 THEN round(degrees(2*asin(sqrt(CASE WHEN s BETWEEN 0 AND 1 THEN s END))), 8) END AS dlon FROM q""")
def distance_to_degrees(spark, sf_dir):
    d = F.col("area") * 20
    return obs(spark, sf_dir).select("tid", "time", F.round(G.dist2lat(d), 9).alias("dlat"), F.round(G.dist2long(d, F.col("lat"), F.col("lat") + 0.1), 8).alias("dlon"))


@query(f"""WITH {OBS_SQL}, q AS (SELECT *, lat + area*3 AS a, lon + area*20 AS b FROM obs) SELECT tid, time, round(CASE WHEN a > 90 THEN 180 - a WHEN a < -90 THEN -180 - a ELSE a END, 9) AS lat2, round(CASE WHEN b > 180 THEN b - 360 WHEN b < -180 THEN b + 360 ELSE b END, 9) AS lon2 FROM q""")
def shifted_positions(spark, sf_dir):
    return obs(spark, sf_dir).select("tid", "time", F.round(G.add_lat(F.col("lat"), F.col("area") * 3), 9).alias("lat2"), F.round(G.add_long(F.col("lon"), F.col("area") * 20), 9).alias("lon2"))


@query(f"""WITH {OBS_SQL}, q AS (SELECT *, CASE WHEN id % 17 = 0 THEN 0 ELSE lat - 45 END AS v, CASE WHEN id % 17 = 0 THEN 0 ELSE lon END AS u FROM obs), r AS (SELECT *, 90 - degrees(atan2(0 - v, 0 - u)) AS d FROM q)
 SELECT tid, time, round(CASE WHEN u = 0 AND v = 0 THEN 0 WHEN d <= 0 THEN d + 360 ELSE d END, 8) AS direction FROM r""")
def direction_from(spark, sf_dir):
    still = F.col("id") % 17 == 0
    u, v = F.when(still, 0.0).otherwise(F.col("lon")), F.when(still, 0.0).otherwise(F.col("lat") - 45)
    return obs(spark, sf_dir).select("tid", "time", F.round(G.direction_from(u, v), 8).alias("direction"))


@query(f"WITH {OBS_SQL} SELECT tid, time, round(lon*cos(0.7e0) + lat*sin(0.7e0), 8) AS x2, round(lat*cos(0.7e0) - lon*sin(0.7e0), 8) AS y2 FROM obs")
def rotated_coordinates(spark, sf_dir):
    x, y = G.rotate(F.col("lon"), F.col("lat"), F.lit(0.7))
    return obs(spark, sf_dir).select("tid", "time", F.round(x, 8).alias("x2"), F.round(y, 8).alias("y2"))


@query("""SELECT event_id, round(epoch_us(ts)/86400e6 + 25567, 8) AS days, CAST(year(ts) % 4 = 0 AND (year(ts) % 100 <> 0 OR year(ts) % 400 = 0) AS BOOLEAN) AS leap, CAST(day(last_day(ts))*4 AS INTEGER) AS steps FROM events""")
def calendar_fields(spark, sf_dir):
    e = read(spark, sf_dir, "events")
    y, m = F.year("ts"), F.month("ts")
    return e.select("event_id", F.round(C.days_since(F.col("ts")), 8).alias("days"), C.is_leap(y).alias("leap"), C.steps_in_month(y, m, 6).cast("int").alias("steps"))


@query("SELECT CAST(month(o_orderdate) AS INTEGER) AS month, lpad(CAST(month(o_orderdate) AS VARCHAR), 2, '0') AS mm, count(*) AS n FROM orders GROUP BY ALL")
def padded_months(spark, sf_dir):
    o = read(spark, sf_dir, "orders").select(F.month("o_orderdate").alias("month"))
    return o.groupBy("month", C.two_digits(F.col("month")).alias("mm")).agg(F.count(F.lit(1)).alias("n"))


@query("""SELECT DISTINCT CAST(n_regionkey AS INTEGER) AS region, CAST(CASE WHEN month(o_orderdate) >= 11 THEN year(o_orderdate) + 1 ELSE year(o_orderdate) END AS INTEGER) AS syear FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey""")
def season_years(spark, sf_dir):
    return season_rows(spark, sf_dir).select("region", C.season_year(F.col("year"), F.col("month")).alias("syear")).distinct()
