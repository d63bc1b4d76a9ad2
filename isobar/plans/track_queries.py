"""Per-track queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from isobar.operators import summary as S
from isobar.plans.adapters import CELLS, EVENTS_SQL, OBS_SQL, obs, track_events
from isobar.plans.registry import query

#: Cell size of exports, in kilometres.
CELL_KM = 100.0


def hav(a: str, b: str, c: str, d: str) -> str:
    """DuckDB text of the great-circle distance in km (lat, lat, lon, lon)."""
    h = f"least(pow(sin((radians({b}) - radians({a}))/2), 2e0) + cos(radians({a}))*cos(radians({b}))*pow(sin((radians({d}) - radians({c}))/2), 2e0), 1e0)"
    return f"(2*atan2(sqrt({h}), sqrt(1 - {h}))*6371e0)"


SHAPE_SQL = OBS_SQL + ", shp AS (SELECT *, p_edge - p_cent AS depth, sqrt(area/pi()) AS radius FROM obs)"
KIN_SQL = f"""{OBS_SQL}, l AS (SELECT *, nullif(time - lag(time) OVER w, 0) AS dt, lag(lat) OVER w AS lat0, lag(lon) OVER w AS lon0, p_cent - lag(p_cent) OVER w AS dp, x - lag(x) OVER w AS dx, y - lag(y) OVER w AS dy
  FROM obs WINDOW w AS (PARTITION BY tid ORDER BY time)),
kin AS (SELECT * EXCLUDE (dt, lat0, lon0), {hav('lat', 'lat', 'lon0', 'lon')}/(dt*24) AS u, {hav('lat0', 'lat', 'lon', 'lon')}/(dt*24) AS v, {hav('lat0', 'lat', 'lon0', 'lon')}/(dt*24) AS uv,
  dp/dt*(sin(pi()/3)/nullif(sin(radians(lat)), 0)) AS dpdt, p_edge - p_cent AS depth, sqrt(area/pi()) AS radius FROM l)"""

FACTS_SQL = f"""{KIN_SQL}, n AS (SELECT *, row_number() OVER w AS rn, time - lag(time) OVER w AS step FROM kin WINDOW w AS (PARTITION BY tid ORDER BY time)),
facts AS (SELECT tid, max(time) - min(time) FILTER (type <> 0) AS lifespan, max(step) FILTER (rn = 2)*24*sum(uv) FILTER (type <> 0) AS trlen, avg(uv) AS avguv, max(lat) AS top FROM n GROUP BY tid),
disp AS (SELECT tid, max(d) AS maxdisp FROM (SELECT tid, {hav('first_value(lat) OVER w', 'lat', 'first_value(lon) OVER w', 'lon')} AS d FROM obs WINDOW w AS (PARTITION BY tid ORDER BY time)) GROUP BY tid)"""


@query(f"""WITH {SHAPE_SQL} SELECT tid, count(*) AS n_obs, max(time) - min(time) FILTER (type <> 0) AS lifespan, min(p_cent) AS minp, avg(p_cent) AS avgp, max(depth) AS maxdepth, avg(depth) AS avgdepth,
 max(dsqp) AS maxdsqp, avg(dsqp) AS avgdsqp, avg(area) FILTER (type <> 0) AS avgarea, max(area) AS maxarea, max(CASE WHEN type <> 0 AND centers <> 1 THEN 1 ELSE 0 END) AS mcc FROM shp GROUP BY tid""")
def track_summary(spark, sf_dir):
    return S.track_summary(obs(spark, sf_dir))


@query(f"WITH {KIN_SQL} SELECT tid, time, dp, dx, dy, round(u, 6) AS u, round(v, 6) AS v, round(uv, 6) AS uv, round(dpdt, 6) AS dpdt FROM kin")
def track_kinematics(spark, sf_dir):
    rows = S.kinematics(obs(spark, sf_dir))
    return rows.select("tid", "time", "dp", "dx", "dy", *[F.round(c, 6).alias(c) for c in ("u", "v", "uv", "dpdt")])


@query(f"WITH {FACTS_SQL} SELECT tid, round(trlen, 5) AS trlen, round(avguv, 6) AS avguv FROM facts")
def track_length(spark, sf_dir):
    return S.track_length(obs(spark, sf_dir)).select("tid", F.round("trlen", 5).alias("trlen"), F.round("avguv", 6).alias("avguv"))


@query(f"WITH {FACTS_SQL} SELECT tid, round(maxdisp, 5) AS maxdisp FROM disp")
def max_displacement(spark, sf_dir):
    return S.max_displacement(obs(spark, sf_dir)).select("tid", F.round("maxdisp", 5).alias("maxdisp"))


@query(f"""WITH {KIN_SQL}, r AS (SELECT tid, time, y, x, round(uv, 6) AS uv, round(dpdt, 6) AS dpdt, depth, p_cent, dsqp FROM kin), e AS (
 SELECT tid, 'max_uv' AS extreme, uv AS value, time, y, x FROM r QUALIFY uv = max(uv) OVER (PARTITION BY tid) UNION ALL
 SELECT tid, 'max_dpdt', dpdt, time, y, x FROM r QUALIFY dpdt = min(dpdt) OVER (PARTITION BY tid) UNION ALL
 SELECT tid, 'max_depth', depth, time, y, x FROM r QUALIFY depth = max(depth) OVER (PARTITION BY tid) UNION ALL
 SELECT tid, 'min_p', p_cent, time, y, x FROM r QUALIFY p_cent = min(p_cent) OVER (PARTITION BY tid) UNION ALL
 SELECT tid, 'max_dsqp', dsqp, time, y, x FROM r QUALIFY dsqp = max(dsqp) OVER (PARTITION BY tid)) SELECT * FROM e""")
def extremes_with_ties(spark, sf_dir):
    return S.extremes(obs(spark, sf_dir)).withColumn("value", F.when(F.col("extreme").isin("max_uv", "max_dpdt"), F.round("value", 6)).otherwise(F.col("value")))


@query(f"WITH {FACTS_SQL} SELECT tid, lifespan, round(trlen, 5) AS trlen, round(maxdisp, 5) AS maxdisp FROM facts JOIN disp USING (tid) WHERE lifespan >= 12 AND trlen >= 2000 AND maxdisp >= 1000 AND top >= 45")
def track_filter(spark, sf_dir):
    kept = S.track_filter(obs(spark, sf_dir), 12, 2000, 1000, 45)
    return kept.select("tid", "lifespan", F.round("trlen", 5).alias("trlen"), F.round("maxdisp", 5).alias("maxdisp"))


@query(f"""WITH {OBS_SQL} SELECT tid, count(*) AS n_inside, min(time) AS first_inside FROM obs WHERE type <> 0 AND lat BETWEEN 35 AND 55 AND (lon >= 150 OR lon <= -150) GROUP BY tid HAVING count(*) >= 2""")
def box_crossing(spark, sf_dir):
    return S.box_crossing(obs(spark, sf_dir), 35, 55, 150, -150, least=2)


def region_view(spark):
    """A region raster: classes 0 to 6 over the cells."""
    cells = spark.range(CELLS[0] * CELLS[1]).select((F.col("id") / CELLS[1]).cast("int").alias("y"), (F.col("id") % CELLS[1]).cast("int").alias("x"))
    return cells.withColumn("region", ((F.col("y") * 3 + F.col("x")) % 7).cast("int"))


REGION_SQL = f"region AS (SELECT CAST(i // {CELLS[1]} AS INTEGER) AS y, CAST(i % {CELLS[1]} AS INTEGER) AS x, CAST(((i // {CELLS[1]})*3 + i % {CELLS[1]}) % 7 AS INTEGER) AS region FROM range({CELLS[0] * CELLS[1]}) t(i))"
HOURLY_SQL = """hr AS (SELECT tid, time + (nt - time)*(p/6e0) AS time, CAST(p AS INTEGER) AS part, lat + (nlat - lat)*(p/6e0) AS lat, lon + (nlon - lon)*(p/6e0) AS lon, CAST(trunc(y + (ny - y)*(p/6e0)) AS INTEGER) AS y, CAST(trunc(x + (nx - x)*(p/6e0)) AS INTEGER) AS x
  FROM (SELECT tid, time, lat, lon, y, x, lead(time) OVER w AS nt, lead(lat) OVER w AS nlat, lead(lon) OVER w AS nlon, lead(y) OVER w AS ny, lead(x) OVER w AS nx FROM obs WINDOW w AS (PARTITION BY tid ORDER BY time)), range(6) q(p) WHERE nt IS NOT NULL)"""


@query(f"WITH {OBS_SQL}, {HOURLY_SQL} SELECT tid, round(time, 9) AS time, part, round(lat, 9) AS lat, round(lon, 9) AS lon, y, x FROM hr")
def hourly_interpolation(spark, sf_dir):
    return S.hourly(obs(spark, sf_dir)).select("tid", F.round("time", 9).alias("time"), "part", F.round("lat", 9).alias("lat"), F.round("lon", 9).alias("lon"), "y", "x")


@query(f"WITH {OBS_SQL}, {HOURLY_SQL}, {REGION_SQL} SELECT tid, round(min(time), 9) AS first_inside, count(*) AS n_inside FROM hr JOIN region USING (y, x) WHERE region IN (2, 5) GROUP BY tid")
def mask_crossing(spark, sf_dir):
    return S.mask_crossing(obs(spark, sf_dir), region_view(spark), [2, 5]).withColumn("first_inside", F.round("first_inside", 9))


@query(f"WITH {OBS_SQL}, {REGION_SQL} SELECT tid, time, obs.y, obs.x, region FROM obs LEFT JOIN region USING (y, x)")
def region_gather(spark, sf_dir):
    return S.region_of(obs(spark, sf_dir).select("tid", "time", "y", "x"), region_view(spark))


@query(f"""WITH {OBS_SQL}, {REGION_SQL}, e AS (SELECT tid, arg_min({{'y': y, 'x': x}}, time) FILTER (type > 0) AS g, arg_max({{'y': y, 'x': x}}, time) AS l FROM obs GROUP BY tid)
 SELECT tid, a.region AS gen_reg, b.region AS lys_reg FROM e LEFT JOIN region a ON a.y = g.y AND a.x = g.x LEFT JOIN region b ON b.y = l.y AND b.x = l.x""")
def end_regions(spark, sf_dir):
    return S.end_regions(obs(spark, sf_dir), region_view(spark))


COUNT_SQL = ", ".join(f"CAST(count(*) FILTER (event = '{k}' AND etype = {t}) AS BIGINT) AS {n}{t}" for k, n in (("mg", "mrg"), ("sp", "spl")) for t in (1, 2, 3))


@query(f"""WITH {EVENTS_SQL}, c AS (SELECT tid, {COUNT_SQL}, CAST(count(*) FILTER (event = 'rg' AND etype = 2) AS BIGINT) AS rge2 FROM ev GROUP BY tid)
 SELECT *, CAST(mrg2 >= 1 OR mrg3 >= 1 AS INTEGER) AS mrg, CAST(spl2 >= 1 OR spl3 >= 1 AS INTEGER) AS spl, CAST(NOT (mrg2 >= 1 OR mrg3 >= 1) AND NOT (spl2 >= 1 OR spl3 >= 1) AS INTEGER) AS nonint FROM c""")
def event_counts_by_type(spark, sf_dir):
    return S.event_counts(track_events(spark, sf_dir))


@query(f"WITH {EVENTS_SQL} SELECT tid, CAST(coalesce(sum(CASE WHEN event = 'ge' THEN etype END), 0) AS BIGINT) AS ge, CAST(coalesce(sum(CASE WHEN event = 'ly' THEN etype END), 0) AS BIGINT) AS ly, CAST(coalesce(sum(CASE WHEN event = 'sp' THEN etype END), 0) AS BIGINT) AS sp, CAST(coalesce(sum(CASE WHEN event = 'mg' THEN etype END), 0) AS BIGINT) AS mg FROM ev GROUP BY tid")
def event_pivot(spark, sf_dir):
    return track_events(spark, sf_dir).groupBy("tid").pivot("event", ["ge", "ly", "sp", "mg"]).sum("etype").fillna(0)


KEPT_SQL = f"""{FACTS_SQL.replace(OBS_SQL, EVENTS_SQL)}, kept AS (SELECT tid FROM facts JOIN disp USING (tid) WHERE lifespan >= 12 AND trlen >= 2000)"""


def kept_tracks(spark, sf_dir):
    return S.track_filter(obs(spark, sf_dir), 12, 2000)


@query(f"WITH {KEPT_SQL} SELECT tid, time, id, event, etype, otid, y, x FROM ev WHERE tid IN (FROM kept) AND otid IN (FROM kept) AND event IN ('sp', 'mg')")
def events_related_semi_join(spark, sf_dir):
    events = track_events(spark, sf_dir).where(F.col("event").isin("sp", "mg"))
    return S.related_events(events, kept_tracks(spark, sf_dir)).select("tid", "time", "id", "event", "etype", "otid", "y", "x")


@query(f"""WITH {KIN_SQL}, d AS (SELECT *, make_timestamp(CAST(round((time - 25567e0)*86400e6) AS BIGINT)) AS ts FROM kin)
 SELECT tid, CAST(year(ts) AS INTEGER) AS year, CAST(month(ts) AS INTEGER) AS month, CAST(day(ts) AS INTEGER) AS day, CAST(hour(ts) AS INTEGER) AS hour, p_cent/100 AS p_cent, p_edge/100 AS p_edge, depth/100 AS depth, dsqp/100 AS dsqp,
 round(radius*100, 6) AS radius, area*10000e0 AS area, dp/100 AS dp, round(dpdt/100, 8) AS dpdt, time, lat, lon, x, y, round(u, 6) AS u, round(v, 6) AS v, round(uv, 6) AS uv, id, type, centers FROM d""")
def csv_export_units(spark, sf_dir):
    rows = S.export_rows(obs(spark, sf_dir), CELL_KM)
    return rows.withColumns({"radius": F.round("radius", 6), "dpdt": F.round("dpdt", 8), "u": F.round("u", 6), "v": F.round("v", 6), "uv": F.round("uv", 6)})


@query(f"""WITH {OBS_SQL}, m AS (SELECT *, CASE WHEN id % 13 < 10 THEN tid ELSE tid + 1 END AS ptid FROM obs), o AS (SELECT *, CAST(ptid = tid AND type <> 0 AS INTEGER) AS own FROM m),
 b AS (SELECT *, coalesce(lag(own) OVER (PARTITION BY tid ORDER BY time), 0) AS bef FROM o), r AS (SELECT *, CAST(sum(CASE WHEN own = 1 AND bef = 0 THEN 1 ELSE 0 END) OVER (PARTITION BY tid ORDER BY time ROWS UNBOUNDED PRECEDING) - 1 AS BIGINT) AS run FROM b)
 SELECT tid, time, run, own = 0 AS closes FROM r WHERE own = 1 OR bef = 1""")
def independent_runs(spark, sf_dir):
    rows = obs(spark, sf_dir).withColumn("ptid", F.when(F.col("id") % 13 < 10, F.col("tid")).otherwise(F.col("tid") + 1))
    return S.independent_runs(rows).select("tid", "time", "run", "closes")


@query(f"""WITH {OBS_SQL}, a AS (SELECT tid AS a, round(time*24, 3) AS h, lat, lon, p_cent FROM obs WHERE type <> 0), b AS (SELECT tid AS b, round(time*24, 3) AS h, lat + 0.5e0 AS lat2, lon AS lon2, p_cent + 10 AS p2 FROM obs WHERE type <> 0 AND id % 3 <> 0),
 na AS (SELECT a, count(*) AS n_a FROM a GROUP BY a), nb AS (SELECT b, count(*) AS n_b FROM b GROUP BY b),
 m AS (SELECT a, b, count(*) AS shared, avg({hav('lat', 'lat2', 'lon', 'lon2')}) AS separation, avg(p2 - p_cent) AS dp FROM a JOIN b USING (h) GROUP BY a, b),
 g AS (SELECT m.*, row_number() OVER (PARTITION BY a ORDER BY separation, b) AS r FROM m JOIN na USING (a) JOIN nb USING (b) WHERE 2e0*shared/(n_a + n_b) >= 0.6e0 AND separation < 500)
 SELECT na.a AS tid, b AS match, shared, round(separation, 5) AS separation, round(dp, 5) AS dp FROM na LEFT JOIN g ON g.a = na.a AND r = 1""")
def compare_tracks(spark, sf_dir):
    first = obs(spark, sf_dir)
    second = first.where(F.col("id") % 3 != 0).withColumns({"lat": F.col("lat") + 0.5, "p_cent": F.col("p_cent") + 10})
    return S.compare_tracks(first, second).withColumns({"separation": F.round("separation", 5), "dp": F.round("dp", 5)})


PROJECTED_SQL = """q AS (SELECT k AS t, tid AS id, lat, lon, CASE WHEN tv > 90 THEN 180 - tv WHEN tv < -90 THEN -180 - tv ELSE tv END AS latq, CASE WHEN tu > 180 THEN tu - 360 WHEN tu < -180 THEN tu + 360 ELSE tu END AS lonq
  FROM (SELECT *, lat + degrees(coalesce(v, 0)*0.75e0*6e0/6371e0) AS tv, lon + coalesce(CASE WHEN s <= 1 THEN degrees(2*asin(sqrt(s))) END, 0) AS tu
   FROM (SELECT *, pow(sin(coalesce(u, 0)*0.75e0*6e0/6371e0/2), 2)/(cos(radians(lat))*cos(radians(lat))) AS s FROM kin) WHERE type <> 0))"""


@query(f"""WITH {KIN_SQL}, {PROJECTED_SQL}, p AS (SELECT a.t, a.id AS id1, b.id AS id2, {hav('a.lat', 'b.lat', 'a.lon', 'b.lon')} AS distance, {hav('a.latq', 'b.lat', 'a.lonq', 'b.lon')} AS projected FROM q a JOIN q b ON b.t = a.t + 1)
 SELECT t, id1, id2, round(distance, 5) AS distance, round(projected, 5) AS projected FROM (SELECT *, row_number() OVER (PARTITION BY t, id1 ORDER BY projected, id2) AS r, bool_or(distance <= 600 AND projected <= 600) OVER (PARTITION BY t, id1) AS lives FROM p) WHERE r = 1 AND lives""")
def track_matching_step(spark, sf_dir):
    centers = S.kinematics(obs(spark, sf_dir)).where("type <> 0").select(F.col("k").alias("t"), F.col("tid").alias("id"), "lat", "lon", "u", "v")
    return S.match_step(centers, centers, 600.0).withColumns({"distance": F.round("distance", 5), "projected": F.round("projected", 5)})


@query(f"""WITH {FACTS_SQL}, a AS (SELECT tid FROM facts WHERE lifespan > 16), o AS (SELECT * FROM obs WHERE tid NOT IN (FROM a)) SELECT CAST(tid AS BIGINT) AS tid, count(*) AS n FROM o GROUP BY tid""")
def inactive_tracks(spark, sf_dir):
    rows = obs(spark, sf_dir)
    active = S.track_summary(rows).where("lifespan > 16").select("tid")
    return rows.join(active, "tid", "left_anti").groupBy("tid").agg(F.count(F.lit(1)).alias("n"))


@query(f"""WITH {OBS_SQL}, m AS (SELECT *, id % 9 = 0 AS w FROM obs) SELECT tid, time, CASE WHEN w THEN NULL ELSE p_cent END AS p_cent, CASE WHEN w THEN NULL ELSE p_edge END AS p_edge, CASE WHEN w THEN NULL ELSE dsqp END AS dsqp,
 CASE WHEN w THEN 0 ELSE area END AS area, CASE WHEN w THEN 0 ELSE centers END AS centers, CASE WHEN w THEN 0 ELSE type END AS type, CASE WHEN w THEN tid + 1 END AS ptid FROM m""")
def nullified_rows(spark, sf_dir):
    rows = S.nullify(obs(spark, sf_dir), F.col("id") % 9 == 0, F.col("tid") + 1)
    return rows.select("tid", "time", "p_cent", "p_edge", "dsqp", "area", "centers", "type", "ptid")


@query(f"""WITH {SHAPE_SQL}, s AS (SELECT tid, min(p_cent) AS minp, avg(p_cent) AS avgp, max(depth) AS maxdepth, avg(depth) AS avgdepth, max(dsqp) AS maxdsqp, avg(dsqp) AS avgdsqp, avg(area) FILTER (type <> 0) AS avgarea, max(area) AS maxarea FROM shp GROUP BY tid)
 SELECT tid, minp*0.01e0 AS minp, avgp*0.01e0 AS avgp, maxdepth*0.01e0 AS maxdepth, avgdepth*0.01e0 AS avgdepth, maxdsqp*0.01e0 AS maxdsqp, avgdsqp*0.01e0 AS avgdsqp, avgarea*1e4 AS avgarea, maxarea*1e4 AS maxarea FROM s""")
def summary_units(spark, sf_dir):
    rows = S.summary_units(S.track_summary(obs(spark, sf_dir)), CELL_KM)
    return rows.select("tid", "minp", "avgp", "maxdepth", "avgdepth", "maxdsqp", "avgdsqp", "avgarea", "maxarea")


@query(f"WITH {OBS_SQL} SELECT tid, coalesce(sum(dsqp) FILTER (type <> 0), 0e0) AS cap FROM obs GROUP BY tid")
def track_precipitation(spark, sf_dir):
    return S.precipitation(obs(spark, sf_dir), column="dsqp")
