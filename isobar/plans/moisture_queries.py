"""Moisture along tracks and back-trajectories."""

from __future__ import annotations

from pyspark.sql import functions as F

from isobar.operators import moisture as M, traj as J
from isobar.operators.raster import circle
from isobar.plans.adapters import OBS_SQL, SHAPE, field, obs
from isobar.plans.grid_queries import NEAR_SQL, field_points, rounded
from isobar.plans.registry import query
from isobar.plans.track_queries import REGION_SQL, hav, region_view
from isobar.plans.source_queries import folder
from isobar.sources.readers import files_for, read_dumps

AGE_SQL = f"{OBS_SQL}, ag AS (SELECT *, (time - min(time) OVER w)/nullif(max(time) OVER w - min(time) OVER w, 0) AS age FROM obs WINDOW w AS (PARTITION BY tid))"
FLAG_SQL = f"{AGE_SQL}, {REGION_SQL}, fl AS (SELECT ag.*, CAST(coalesce(region IN (1, 4), false) AS INTEGER) AS regflag FROM ag LEFT JOIN region USING (y, x) WHERE age > 0 AND age < 1)"


def flagged(spark, sf_dir):
    """Rows inside their life with age and whether they are in region 1 or 4."""
    rows = M.ages(obs(spark, sf_dir)).join(region_view(spark), ["y", "x"], "left")
    return rows.withColumn("regflag", F.coalesce(F.col("region").isin(1, 4), F.lit(False)).cast("int"))


@query(f"WITH {AGE_SQL} SELECT tid, time, round(age, 9) AS age FROM ag WHERE age > 0 AND age < 1")
def relative_age(spark, sf_dir):
    return M.ages(obs(spark, sf_dir)).select("tid", "time", F.round("age", 9).alias("age"))


@query(f"WITH {FLAG_SQL}, m AS (SELECT *, max(age) FILTER (regflag = 1) OVER (PARTITION BY tid) AS maxage FROM fl) SELECT tid, time, regflag, round(age, 9) AS age, round(maxage, 9) AS maxage FROM m WHERE age <= maxage")
def age_in_region(spark, sf_dir):
    return M.age_in_region(flagged(spark, sf_dir)).select("tid", "time", "regflag", F.round("age", 9).alias("age"), F.round("maxage", 9).alias("maxage"))


@query(f"""WITH {FLAG_SQL}, g AS (SELECT tid, regflag, avg(lat) AS lat, avg(dsqp) AS dsqp, count(*) AS n FROM fl GROUP BY ALL) SELECT i.tid, round(i.lat, 6) AS lat_in, round(i.dsqp, 6) AS dsqp_in, i.n AS n_in, round(coalesce(o.lat, 0), 6) AS lat_out, round(coalesce(o.dsqp, 0), 6) AS dsqp_out, coalesce(o.n, 0) AS n_out
 FROM (FROM g WHERE regflag = 1) i LEFT JOIN (FROM g WHERE regflag = 0) o USING (tid)""")
def in_out_split(spark, sf_dir):
    return rounded(M.in_out_split(flagged(spark, sf_dir), ["lat", "dsqp"]), "tid")


@query(f"WITH {FLAG_SQL} SELECT DISTINCT tid FROM fl WHERE regflag = 1")
def tracks_in_region(spark, sf_dir):
    rows = flagged(spark, sf_dir)
    return obs(spark, sf_dir).select("tid").distinct().join(rows.where("regflag = 1").select("tid"), "tid", "left_semi")


BUDGET = {"tcw_first": "first_lat", "tcw_last": "last_lat", "e_in": "sum_dsqp", "e_out": "n", "adv_in": "avg_lat", "adv_out": "minp", "tp_in": "sum_area"}
BUDGET_SQL = f"""{OBS_SQL}, b AS (SELECT tid, arg_min(lat, time) AS tcw_first, arg_max(lat, time) AS tcw_last, sum(dsqp) AS e_in, count(*)/10e0 AS e_out, avg(lat) AS adv_in, min(p_cent)/1e5 AS adv_out, sum(area)/100e0 AS tp_in FROM obs GROUP BY tid),
 c AS (SELECT *, tcw_first + e_out + adv_out AS max_out, tcw_last - tcw_first AS tcw_diff, greatest(adv_in, 0) AS min_out FROM b), d AS (SELECT *, greatest(max_out, min_out) AS most_out, greatest(max_out, min_out) + greatest(e_in, 0) AS supply FROM c),
 e AS (SELECT *, tp_in*(most_out/supply) AS final_out, tp_in*(1 - most_out/supply) AS final_in FROM d)"""


@query(f"""WITH {BUDGET_SQL} SELECT tid, round(max_out, 6) AS max_out, round(tcw_diff, 6) AS tcw_diff, round(min_out, 6) AS min_out, round(most_out, 6) AS most_out, round(supply, 6) AS supply, round(final_out, 6) AS final_out, round(final_in, 6) AS final_in,
 round(supply - tp_in - tcw_diff, 6) AS final_resid FROM e""")
def budget_terms(spark, sf_dir):
    rows = obs(spark, sf_dir).groupBy("tid").agg(
        F.min_by("lat", "time").alias("tcw_first"), F.max_by("lat", "time").alias("tcw_last"), F.sum("dsqp").alias("e_in"), (F.count(F.lit(1)) / 10).alias("e_out"),
        F.avg("lat").alias("adv_in"), (F.min("p_cent") / 1e5).alias("adv_out"), (F.sum("area") / 100).alias("tp_in"),
    )
    return rounded(M.budget_terms(rows), "tid").select("tid", "max_out", "tcw_diff", "min_out", "most_out", "supply", "final_out", "final_in", "final_resid")


@query(f"WITH {OBS_SQL} SELECT tid, time, round(dsqp/nullif(lat, 0), 9) AS peff, round(dsqp/nullif(-(area - 3e0), 0), 9) AS pratio FROM obs")
def precipitation_efficiency(spark, sf_dir):
    rows = obs(spark, sf_dir).select("tid", "time", F.col("dsqp").alias("tp"), F.col("lat").alias("tcw"), F.col("area").cast("double").alias("e"), F.lit(-3.0).alias("viwvd"))
    return M.efficiency(rows).select("tid", "time", F.round("peff", 9).alias("peff"), F.round("pratio", 9).alias("pratio"))


@query(f"""WITH {NEAR_SQL}, e AS (SELECT DISTINCT p.t, p.y, p.x, p.y + oy AS cy, p.x + ox AS cx FROM pts p, disk), a AS (SELECT e.t, e.y, e.x, avg(v) AS env FROM e JOIN field f ON f.t = e.t AND f.y = cy AND f.x = cx GROUP BY ALL)
 SELECT p.t, p.y, p.x, round(env, 9) AS env FROM pts p LEFT JOIN a USING (t, y, x)""")
def environment_samples(spark, sf_dir):
    made = M.environment_samples(field_points(spark, sf_dir), field(spark, sf_dir), circle(2))
    return made.withColumn("env", F.round("env", 9))


@query(f"""WITH {OBS_SQL}, q AS (SELECT tid, time, y, x, coalesce(lag(y) OVER w, y) AS y0, coalesce(lag(x) OVER w, x) AS x0 FROM obs WINDOW w AS (PARTITION BY tid ORDER BY time)) SELECT tid, time, CAST(trunc(y*(1 - 0.33e0) + y0*0.33e0) AS INTEGER) AS y_prior, CAST(trunc(x*(1 - 0.33e0) + x0*0.33e0) AS INTEGER) AS x_prior FROM q""")
def prior_position(spark, sf_dir):
    return M.prior_position(obs(spark, sf_dir), 0.33).select("tid", "time", "y_prior", "x_prior")


@query(f"""WITH {OBS_SQL} SELECT tid, arg_min(lat, time) AS lat_first, arg_max(lat, time) AS lat_last, sum(area) AS area_sum, round(avg(lon), 6) AS lon_avg, max(lon) AS lon_max, min(lon) AS lon_min FROM obs GROUP BY tid""")
def track_table(spark, sf_dir):
    return M.track_table(obs(spark, sf_dir), ["lat"], ["area"], ["lon"]).withColumn("lon_avg", F.round("lon_avg", 6))


def trajectories(spark, sf_dir):
    return obs(spark, sf_dir).select(F.col("tid").alias("traj_id"), "time", "k", "lat", "lon", "id", (100.0 * F.coalesce("dsqp", F.lit(0.0))).alias("q"))


TRAJ_SQL = f"{OBS_SQL}, tr AS (SELECT tid AS traj_id, time, k, lat, lon, id, 100.0*coalesce(dsqp, 0) AS q FROM obs), up AS (SELECT * FROM (SELECT *, (q - lag(q) OVER (PARTITION BY traj_id ORDER BY time))*1000 AS dq FROM tr) WHERE dq >= 25000)"


@query(f"WITH {TRAJ_SQL} SELECT traj_id, time, lat, lon, round(dq, 4) AS dq FROM up")
def moisture_uptake(spark, sf_dir):
    return J.uptakes(trajectories(spark, sf_dir), 25000).select("traj_id", "time", "lat", "lon", F.round("dq", 4).alias("dq"))


@query(f"""WITH {TRAJ_SQL}, p AS (SELECT *, lag(q) OVER (PARTITION BY traj_id ORDER BY time) AS qb, id % 10/1000e0 AS tp, id % 7*5/1e6 AS cwc FROM tr) SELECT traj_id, time FROM p WHERE tp*1000 > 0.1e0 AND cwc*1e6 > 10 AND (qb - q)*1000 >= 0.1e0""")
def precipitating_parcels(spark, sf_dir):
    from pyspark.sql import Window as W

    rows = trajectories(spark, sf_dir).withColumn("q_before", F.lag("q").over(W.partitionBy("traj_id").orderBy("time")))
    rows = rows.withColumns({"tp": F.col("id") % 10 / F.lit(1000.0), "cwc": F.col("id") % 7 * 5 / F.lit(1e6)})
    return J.precipitating(rows).select("traj_id", "time")


@query(f"""WITH {TRAJ_SQL}, g AS (SELECT CAST(floor(lat/0.5e0 + 0.5e0) AS INTEGER) AS row, CAST(floor(lon/1e0 + 0.5e0) AS INTEGER) AS col, count(*) AS n FROM up GROUP BY ALL) SELECT row, col, n, round(100e0*n/sum(n) OVER (), 7) AS percent FROM g""")
def uptake_grid_percent(spark, sf_dir):
    made = J.uptake_percent(J.uptakes(trajectories(spark, sf_dir), 25000))
    return made.withColumn("percent", F.round("percent", 7))


@query(f"""WITH {OBS_SQL}, k AS (SELECT d, exp(-0.5e0*d*d)/(SELECT sum(exp(-0.5e0*e*e)) FROM range(-4, 5) r(e)) AS w FROM range(-4, 5) r(d)), c AS (SELECT y % 32 AS y, x % 32 AS x, count(*) AS n FROM obs GROUP BY 1, 2), f AS (SELECT y, x, 100e0*n/sum(n) OVER () AS v FROM c),
 a AS (SELECT CAST((y - d + 32) % 32 AS INTEGER) AS y, x, sum(v*w) AS v FROM f, k GROUP BY 1, 2) SELECT 0 AS t, y, CAST((x - d + 32) % 32 AS INTEGER) AS x, round(sum(v*w)*1e5/961, 7) AS v FROM a, k GROUP BY 2, 3""")
def uptake_map(spark, sf_dir):
    points = obs(spark, sf_dir).select((F.col("y") % 32).alias("y"), (F.col("x") % 32).alias("x"))
    return rounded(J.uptake_map(points, SHAPE, sigma=1.0), "t", "y", "x", digits=7)


@query(f"""WITH {OBS_SQL}, {REGION_SQL}, n AS (SELECT tid, row_number() OVER (PARTITION BY tid ORDER BY time) - 1 AS n, CAST(region = 3 AS INTEGER) AS inside FROM obs LEFT JOIN region USING (y, x)), m AS (SELECT tid, min(n) FILTER (inside = 1) AS entry, max(n) AS last FROM n GROUP BY tid)
 SELECT tid, CAST(entry AS INTEGER) AS entry, CAST(greatest(entry - 8, 0) AS INTEGER) AS before, CAST(least(entry + 8, last) AS INTEGER) AS after, CAST((entry + last)//2 AS INTEGER) AS middle, CAST(last AS INTEGER) AS "end" FROM m WHERE entry IS NOT NULL""")
def entry_windows(spark, sf_dir):
    rows = obs(spark, sf_dir).join(region_view(spark), ["y", "x"], "left").withColumn("inside", (F.col("region") == 3).cast("int"))
    made = J.entry_windows(rows)
    return made.select("tid", *[F.col(c).cast("int").alias(c) for c in ("entry", "before", "after", "middle", "end")])


@query(f"WITH {TRAJ_SQL} SELECT traj_id, count(*) AS n FROM tr WHERE traj_id % 4 = 0 GROUP BY traj_id")
def sampled_trajectories(spark, sf_dir):
    return J.every_nth(trajectories(spark, sf_dir), 4).groupBy("traj_id").agg(F.count(F.lit(1)).alias("n"))


@query(f"""WITH {OBS_SQL}, c AS (SELECT DISTINCT tid, round(arg_min(lat, time) OVER (PARTITION BY tid)) AS lat, round(arg_min(lon, time) OVER (PARTITION BY tid)) AS lon FROM obs), g AS (SELECT DISTINCT tid, lat, lon, plat, plon FROM c, (SELECT i*0.5e0 - 90 AS plat FROM range(1, 360) a(i)) p, (SELECT j*1e0 - 180 AS plon FROM range(360) b(j)) q
  WHERE abs(plat - lat) <= 2.5e0 AND plat > -90) SELECT tid, lat, lon, plat, plon FROM g WHERE {hav('lat', 'plat', 'lon', 'plon')} <= 200""")
def points_within_radius(spark, sf_dir):
    starts = obs(spark, sf_dir).groupBy("tid").agg(F.round(F.min_by("lat", "time")).alias("lat"), F.round(F.min_by("lon", "time")).alias("lon"))
    return J.points_within(starts, 200.0)


@query(f"""WITH {OBS_SQL}, ax AS (SELECT 20 + 3e0*i AS a FROM range(20) r(i)) SELECT tid, time, (SELECT arg_min(a, {{'d': abs(a - lat), 'a': a}}) FROM ax) AS near FROM obs""")
def nearest_axis_value(spark, sf_dir):
    axis = spark.range(20).select((F.lit(20.0) + 3.0 * F.col("id")).alias("a"))
    return J.nearest_axis(obs(spark, sf_dir), axis, "lat", "a", "near").select("tid", "time", "near")


@query("""WITH c AS (SELECT 'pl' AS variable, y AS year, m AS month, d AS first_day, d + 9 AS last_day, 'pl_' || y || '_' || m || '_' || d AS path FROM (VALUES (2024)) a(y), (VALUES (1), (2)) b(m), (VALUES (1), (11), (21)) e(d))
 SELECT 'pl' AS variable, ts, (SELECT min(path) FROM c WHERE year = year(ts) AND month = month(ts) AND day(ts) BETWEEN first_day AND last_day) AS path FROM (SELECT DISTINCT date_trunc('hour', ts) AS ts FROM events)""")
def file_catalogue_lookup(spark, sf_dir):
    rows = [("pl", 2024, m, d, d + 9, f"pl_2024_{m}_{d}") for m in (1, 2) for d in (1, 11, 21)]
    catalogue = spark.createDataFrame(rows, "variable string, year int, month int, first_day int, last_day int, path string")
    times = spark.read.parquet(f"{sf_dir}/events.parquet").select(F.lit("pl").alias("variable"), F.date_trunc("hour", "ts").alias("ts")).distinct()
    return files_for(times, catalogue)


@query(f"""WITH {OBS_SQL} SELECT CAST(tid AS VARCHAR) AS file, CAST(k AS INTEGER) AS seq, make_timestamp(2024, 1 + k % 12, 1 + k % 28, k % 24, 0, 0) AS ts, round(lat, 2) AS lat, round(lon, 2) AS lon, CAST(1000 + k AS DOUBLE) AS height, CAST(800 + k % 100 AS DOUBLE) AS pressure FROM obs""")
def fixed_width_load(spark, sf_dir):
    r = obs(spark, sf_dir)
    num = lambda c, w, d: F.lpad(F.format_string(f"%.{d}f", c), w, " ")
    k = F.col("k")
    text = F.concat(
        F.lit(" " * 16), F.lpad(F.lit("24"), 3, " "), F.lit(" " * 3), F.lpad((1 + k % 12).cast("string"), 4, " "), F.lit(" " * 2), F.lpad((1 + k % 28).cast("string"), 2, " "), F.lit(" " * 4),
        F.lpad((k % 24).cast("string"), 2, " "), F.lit(" " * 23), num(F.round("lat", 2), 6, 2), F.lit(" " * 1), num(F.round("lon", 2), 8, 2), F.lit(" " * 3), F.lpad((1000 + k).cast("string"), 6, " "), F.lit(" " * 1), F.lpad((800 + k % 100).cast("string"), 8, " "),
    )
    # a file for each trajectory: its header and lines in order are one value, so that no later sort can change their order
    path = folder(spark)
    lines = r.groupBy("tid").agg(F.array_sort(F.collect_list(F.struct(k.alias("k"), text.alias("value")))).alias("lines"))
    whole = F.concat(F.array_repeat(F.lit("header"), 5), F.transform("lines", lambda line: line["value"]))
    lines.select("tid", F.array_join(whole, "\n").alias("value")).write.partitionBy("tid").text(path)
    made = read_dumps(spark, f"{path}/tid=*/*.txt", 2)
    return made.withColumn("file", F.regexp_extract("file", r"tid=(-?[0-9]+)/", 1))


_NEAR = "(SELECT arg_min(a, {{'d': abs(a - {0}), 'a': a}}) FROM {0}_axis)"
CHAIN_SQL = f"""{OBS_SQL}, lat_axis AS (SELECT 15 + 10e0*i AS a FROM range(9) r(i)), lon_axis AS (SELECT 30e0*i - 180 AS a FROM range(13) r(i)), plev_axis AS (SELECT 500 + 250e0*i AS a FROM range(3) r(i)),
 tr AS (SELECT tid AS traj_id, time, lat, lon, 480 + 40e0*(id % 13) AS plev FROM obs), near AS (SELECT *, {_NEAR.format('lat')} AS a, {_NEAR.format('lon')} AS b, {_NEAR.format('plev')} AS c FROM tr),
 sampled AS (SELECT *, ((time*4 + a*7 + b*3 + c) % 50)/1000 AS q FROM near)"""


@query(f"WITH {CHAIN_SQL} SELECT traj_id, time, lat, lon, round(q, 9) AS q, round(dq, 6) AS dq FROM (SELECT *, (q - lag(q) OVER (PARTITION BY traj_id ORDER BY time))*1000 AS dq FROM sampled) WHERE dq >= 0.025e0")
def uptakes_diagnosed(spark, sf_dir):
    """From trajectories and a humidity field on levels and a grid to uptake events."""
    traj = obs(spark, sf_dir).select(F.col("tid").alias("traj_id"), "time", F.col("time").alias("ts"), "lat", "lon", (480 + 40.0 * (F.col("id") % 13)).alias("plev"))
    axes = {"lat": (15, 10, 9), "lon": (-180, 30, 13), "plev": (500, 250, 3)}
    grid = traj.select("ts").distinct()
    for name, (first, step, n) in axes.items():
        grid = grid.withColumn(name, F.explode(F.array(*[F.lit(float(first + step * i)) for i in range(n)])))
    humidity = grid.withColumn("q", ((F.col("ts") * 4 + F.col("lat") * 7 + F.col("lon") * 3 + F.col("plev")) % 50) / 1000)
    return J.diagnose_uptakes(traj, humidity).select("traj_id", "time", "lat", "lon", F.round("q", 9).alias("q"), F.round("dq", 6).alias("dq"))


@query("""WITH e AS (SELECT user_id % 3 AS storm, ts, CAST(event_id*7 % 32 AS INTEGER) AS y, CAST(event_id*3 % 32 AS INTEGER) AS x FROM events), m AS (SELECT storm, h, date_trunc('hour', min(ts) + INTERVAL 15 DAY + to_hours(h)) AS target FROM e, (VALUES (-24), (0), (24)) v(h) GROUP BY storm, h),
 k AS (SELECT d, exp(-0.5e0*d*d)/(SELECT sum(exp(-0.5e0*g*g)) FROM range(-4, 5) r(g)) AS w FROM range(-4, 5) r(d)), c AS (SELECT h, y, x, count(*) AS n FROM e JOIN m ON m.storm = e.storm AND date_trunc('hour', e.ts) = m.target GROUP BY 1, 2, 3), f AS (SELECT h, y, x, 100e0*n/sum(n) OVER (PARTITION BY h) AS v FROM c),
 a AS (SELECT h, CAST((y - d + 32) % 32 AS INTEGER) AS y, x, sum(v*w) AS v FROM f, k GROUP BY 1, 2, 3) SELECT CAST(h AS INTEGER) AS hours, y, CAST((x - d + 32) % 32 AS INTEGER) AS x, round(sum(v*w)*1e5/961, 7) AS v FROM a, k GROUP BY 1, 2, 3""")
def uptake_maps_by_hour(spark, sf_dir):
    """Maps a day before, at and a day after each storm's mark."""
    events = spark.read.parquet(f"{sf_dir}/events.parquet").select((F.col("user_id") % 3).alias("storm"), "ts", (F.col("event_id") * 7 % 32).cast("int").alias("y"), (F.col("event_id") * 3 % 32).cast("int").alias("x"))
    marks = events.groupBy("storm").agg((F.min("ts") + F.make_interval(days=F.lit(15))).alias("ts"))
    return rounded(J.uptake_maps(events, marks, SHAPE, sigma=1.0), "hours", "y", "x", digits=7)
