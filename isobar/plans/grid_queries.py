"""Gridded statistics of tracks."""

from __future__ import annotations

from pyspark.sql import functions as F

from isobar.operators import gridstats as G, tiles
from isobar.operators.raster import box, circle
from isobar.plans.adapters import CELLS, FIELD_SQL, OBS_SQL, SHAPE, field, obs, track_events
from isobar.plans.registry import ORACLE_SQL, QUERIES, query
from isobar.plans.track_queries import HOURLY_SQL, KEPT_SQL, KIN_SQL, kept_tracks

#: Time steps of the period.
STEPS = 120.0
INSIDE = f"y BETWEEN 0 AND {CELLS[0] - 1} AND x BETWEEN 0 AND {CELLS[1] - 1}"
DISK = "disk AS (SELECT oy, ox FROM range(-2, 3) a(oy), range(-2, 3) b(ox) WHERE oy*oy + ox*ox <= 4)"
SQUARE = "sq AS (SELECT oy, ox FROM range(-1, 2) a(oy), range(-1, 2) b(ox))"


def rounded(frame, *keys, digits=6, shift=0.0):
    """Sums of doubles don't depend on their order beyond these digits; ``shift`` moves values off exact halves."""
    return frame.select(*keys, *[F.round(F.col(c) + shift if shift else F.col(c), digits).alias(c) if t == "double" else F.col(c) for c, t in frame.dtypes if c not in keys])


def near(expr: str, digits: int = 4) -> str:
    """DuckDB text of :func:`rounded` with the shift of SHIFT."""
    return f"round({expr} + {SHIFT}, {digits})"


#: Off any half of the digits kept.
SHIFT = 3.1e-7


EVENT_DENSITY_SQL = f"""{KEPT_SQL}, e AS (SELECT tid, arg_min({{'y': y, 'x': x}}, time) AS g, arg_max({{'y': y, 'x': x}}, time) AS l FROM obs WHERE tid IN (FROM kept) GROUP BY tid),
 r AS (SELECT g.y AS y, g.x AS x, 'gen' AS w FROM e UNION ALL SELECT l.y, l.x, 'lys' FROM e UNION ALL
 SELECT y, x, CASE event WHEN 'sp' THEN 'spl' ELSE 'mrg' END FROM ev WHERE etype <> 2 AND event IN ('sp', 'mg') AND tid IN (FROM kept) AND otid IN (FROM kept)),
 density AS (SELECT y, x, CAST(count(*) FILTER (w = 'gen') AS BIGINT) AS gen, CAST(count(*) FILTER (w = 'lys') AS BIGINT) AS lys, CAST(count(*) FILTER (w = 'spl') AS BIGINT) AS spl, CAST(count(*) FILTER (w = 'mrg') AS BIGINT) AS mrg FROM r GROUP BY y, x)"""


@query(f"WITH {EVENT_DENSITY_SQL} SELECT * FROM density")
def event_density_grid(spark, sf_dir):
    return G.event_density(obs(spark, sf_dir), track_events(spark, sf_dir), kept_tracks(spark, sf_dir))


@query(f"WITH {OBS_SQL}, {HOURLY_SQL} SELECT y, x, count(DISTINCT tid) AS trkden FROM hr GROUP BY y, x")
def track_density(spark, sf_dir):
    return G.track_density(obs(spark, sf_dir))


def _smoothed_sql(columns: list[str], size: int) -> str:
    """DuckDB text of the box means of ``density``, edges repeated, where one isn't 0."""
    down = size // 2
    return f"""g AS (SELECT y, x FROM range({CELLS[0]}) a(y), range({CELLS[1]}) b(x)), o AS (SELECT oy, ox FROM range({-down}, {size - down}) a(oy), range({-down}, {size - down}) b(ox)),
 m AS (SELECT g.y, g.x, {', '.join(f'sum(coalesce({c}, 0))/{size * size}.0e0 AS {c}' for c in columns)} FROM g CROSS JOIN o LEFT JOIN density d ON d.y = greatest(0, least({CELLS[0] - 1}, g.y + oy)) AND d.x = greatest(0, least({CELLS[1] - 1}, g.x + ox)) GROUP BY g.y, g.x)
 SELECT CAST(y AS INTEGER) AS y, CAST(x AS INTEGER) AS x, {', '.join(columns)} FROM m WHERE {' + '.join(columns)} > 0"""


#: Cells a side of the boxes that densities are smoothed over.
BOX = 8


@query(f"WITH {EVENT_DENSITY_SQL}, {_smoothed_sql(['gen', 'lys', 'spl', 'mrg'], BOX)}")
def event_density_smoothed(spark, sf_dir):
    made = G.event_density(obs(spark, sf_dir), track_events(spark, sf_dir), kept_tracks(spark, sf_dir))
    return G.smoothed_density(made, ["gen", "lys", "spl", "mrg"], BOX, CELLS)


@query(f"WITH {OBS_SQL}, {HOURLY_SQL}, density AS (SELECT y, x, count(DISTINCT tid) AS trkden FROM hr GROUP BY y, x), {_smoothed_sql(['trkden'], BOX)}")
def track_density_smoothed(spark, sf_dir):
    return G.smoothed_density(G.track_density(obs(spark, sf_dir)), ["trkden"], BOX, CELLS)


@query(f"""WITH {FIELD_SQL}, d AS (SELECT oy, ox FROM range(-12, 13) a(oy), range(-12, 13) b(ox) WHERE oy*oy + ox*ox <= 144)
 SELECT t, CAST(y + oy AS INTEGER) AS y, CAST(x + ox AS INTEGER) AS x, round(avg(v) + {SHIFT}, 6) + 0e0 AS v, count(*) AS n FROM field, d WHERE y + oy BETWEEN 0 AND 31 AND x + ox BETWEEN 0 AND 31 GROUP BY 1, 2, 3""")
def wide_disk_means(spark, sf_dir):
    """Means over disks of 12 cells, 441 a disk."""
    return rounded(tiles.footprint_means(field(spark, sf_dir), ["v"], circle(12), SHAPE, ["t"]), "t", "y", "x", digits=6, shift=SHIFT).withColumn("v", F.col("v") + 0.0)


@query(f"""WITH {KIN_SQL}, f AS (SELECT * FROM kin WHERE p_cent IS NOT NULL QUALIFY row_number() OVER (PARTITION BY tid ORDER BY time DESC) > 1), {DISK},
 s AS (SELECT y + oy AS y, x + ox AS x, p_cent, depth, dsqp, radius, area FROM f, disk) SELECT CAST(y AS INTEGER) AS y, CAST(x AS INTEGER) AS x, {near('avg(p_cent)')} AS p_cent, {near('avg(depth)')} AS depth, {near('avg(dsqp)')} AS dsqp,
 {near('avg(radius)')} AS radius, {near('avg(area)')} AS area, {near('count(*)/120.0*100')} AS pct_steps FROM s WHERE {INSIDE} GROUP BY y, x""")
def intensity_grid(spark, sf_dir):
    return rounded(G.intensity_grid(obs(spark, sf_dir), circle(2), CELLS, STEPS), "y", "x", digits=4, shift=SHIFT)


@query(f"""WITH {KIN_SQL}, f AS (SELECT *, CASE WHEN uv > 0 THEN abs(v/uv) END AS vratio, CASE WHEN uv > 0 THEN pow(v/uv, 2) END AS mci FROM kin WHERE u IS NOT NULL QUALIFY row_number() OVER (PARTITION BY tid ORDER BY time DESC) > 1), {SQUARE},
 s AS (SELECT y + oy AS y, x + ox AS x, u, v, uv, dpdt, vratio, mci FROM f, sq) SELECT CAST(y AS INTEGER) AS y, CAST(x AS INTEGER) AS x, {near('avg(u)')} AS u, {near('avg(v)')} AS v, {near('avg(uv)')} AS uv, {near('avg(dpdt)')} AS dpdt,
 {near('avg(vratio)')} AS vratio, {near('avg(mci)')} AS mci, {near('count(*)/120.0*100')} AS pct_steps FROM s WHERE {INSIDE} GROUP BY y, x""")
def rate_grid(spark, sf_dir):
    return rounded(G.rate_grid(obs(spark, sf_dir), box(1), CELLS, STEPS), "y", "x", digits=4, shift=SHIFT)


@query(f"""WITH {KIN_SQL}, f AS (SELECT * FROM kin QUALIFY row_number() OVER (PARTITION BY tid ORDER BY time DESC) > 1)
 SELECT y, x, count(DISTINCT tid) AS trkden, {near(f'count(*)/{STEPS}')} AS sysden, {near(f'count(p_cent)/{STEPS}')} AS pden, {near(f'count(uv)/{STEPS}')} AS uden, {near(f'count(*) FILTER (radius <> 0)/{STEPS}')} AS aden,
 {near(f'count(*) FILTER (centers > 1)/{STEPS}')} AS mccden, {near('coalesce(sum(uv), 0)/nullif(count(uv), 0)')} AS uvab, {near('coalesce(sum(radius), 0)/nullif(count(p_cent), 0)')} AS radius, {near('coalesce(sum(area), 0)/nullif(count(p_cent), 0)')} AS area,
 {near('coalesce(sum(depth), 0)/nullif(count(*) FILTER (radius <> 0), 0)')} AS depth, {near('coalesce(sum(depth/nullif(radius, 0)), 0)/nullif(count(*) FILTER (radius <> 0), 0)')} AS dpdr,
 {near('coalesce(sum(dpdt), 0)/nullif(count(uv), 0)')} AS dpdt, {near('coalesce(sum(p_cent), 0)/nullif(count(p_cent), 0)')} AS pcent, {near('coalesce(sum(dsqp), 0)/nullif(count(p_cent), 0)')} AS dsqp FROM f GROUP BY y, x""")
def pointwise_stats(spark, sf_dir):
    return rounded(G.pointwise(obs(spark, sf_dir), STEPS), "y", "x", digits=4, shift=SHIFT).drop("uvdi")


DIRECTION = "CASE WHEN u = 0 AND v = 0 THEN 0 WHEN 90 - degrees(atan2(-v, -u)) <= 0 THEN 450 - degrees(atan2(-v, -u)) ELSE 90 - degrees(atan2(-v, -u)) END"


@query(f"""WITH RECURSIVE {KIN_SQL}, r AS (SELECT * FROM kin QUALIFY row_number() OVER (PARTITION BY tid ORDER BY time DESC) > 1), cells AS (SELECT DISTINCT y, x FROM r),
 d AS (SELECT y, x, tid, sum({DIRECTION}) AS v FROM r WHERE uv IS NOT NULL GROUP BY ALL HAVING sum({DIRECTION}) <> 0), o AS (SELECT y, x, v, row_number() OVER (PARTITION BY y, x ORDER BY v DESC) AS i FROM d),
 f(y, x, i, mean) AS (SELECT y, x, i, CAST(v AS DOUBLE) FROM o WHERE i = 1 UNION ALL SELECT y, x, i, CASE WHEN m < 0 THEN 360 + m WHEN m > 360 THEN m - 360 ELSE m END
  FROM (SELECT o.y, o.x, o.i, f.mean*(o.i - 1)/o.i + (CASE WHEN (f.mean - o.v)/360 < 0.5e0 THEN o.v ELSE o.v + 360 END)/o.i AS m FROM f JOIN o ON o.y = f.y AND o.x = f.x AND o.i = f.i + 1))
 SELECT c.y, c.x, round(CASE WHEN l.mean = 0 THEN 360 ELSE l.mean END, 5) AS uvdi FROM cells c LEFT JOIN (SELECT y, x, arg_max(mean, i) AS mean FROM f GROUP BY y, x) l USING (y, x)""")
def pointwise_direction(spark, sf_dir):
    return G.pointwise(obs(spark, sf_dir), STEPS).select("y", "x", F.round("uvdi", 5).alias("uvdi"))


@query(f"""WITH {KIN_SQL}, r AS (SELECT tid, y, x, round(uv, 6) AS uv, round(dpdt, 6) AS dpdt, depth, p_cent, dsqp FROM kin), e AS (
 SELECT 'max_uv' AS extreme, y, x FROM r QUALIFY uv = max(uv) OVER (PARTITION BY tid) UNION ALL
 SELECT 'max_dpdt', y, x FROM r QUALIFY dpdt = min(dpdt) OVER (PARTITION BY tid) UNION ALL
 SELECT 'max_depth', y, x FROM r QUALIFY depth = max(depth) OVER (PARTITION BY tid) UNION ALL
 SELECT 'min_p', y, x FROM r QUALIFY p_cent = min(p_cent) OVER (PARTITION BY tid) UNION ALL
 SELECT 'max_dsqp', y, x FROM r QUALIFY dsqp = max(dsqp) OVER (PARTITION BY tid)) SELECT extreme, y, x, count(*) AS n FROM e GROUP BY ALL""")
def extreme_location_grid_all(spark, sf_dir):
    """How often each cell is where a track has each of its five extremes; uv and dpdt are rounded before ties are taken."""
    return G.extreme_locations(obs(spark, sf_dir), digits=6)


# the earlier name of the same query
QUERIES["extreme_location_grid"], ORACLE_SQL["extreme_location_grid"] = extreme_location_grid_all, ORACLE_SQL["extreme_location_grid_all"]


def samples(spark, sf_dir):
    return obs(spark, sf_dir).select("tid", "time", "y", "x", F.col("lat").alias("tcw"), F.col("p_cent").alias("pw"))


@query(f"""WITH {OBS_SQL}, {DISK}, s AS (SELECT y + oy AS y, x + ox AS x, lat AS tcw, p_cent AS pw FROM obs, disk)
 SELECT CAST(y AS INTEGER) AS y, CAST(x AS INTEGER) AS x, {near('nullif(avg(tcw), 0)')} AS tcw, {near('nullif(avg(pw), 0)')} AS pw FROM s WHERE {INSIDE} GROUP BY y, x""")
def environment_grid(spark, sf_dir):
    return rounded(G.environment_grid(samples(spark, sf_dir), ("tcw", "pw"), circle(2), CELLS), "y", "x", digits=4, shift=SHIFT)


def field_points(spark, sf_dir):
    """Two points for each step of the field view."""
    t = field(spark, sf_dir).select("t").distinct()
    return t.select("t", F.explode(F.array(*[F.struct((F.col("t") * a % 32).cast("int").alias("y"), (F.col("t") * b % 32).cast("int").alias("x")) for a, b in ((5, 7), (11, 3))])).alias("p")).select("t", "p.y", "p.x")


POINTS_SQL = "pts AS (SELECT DISTINCT t, CAST(t*5 % 32 AS INTEGER) AS y, CAST(t*7 % 32 AS INTEGER) AS x FROM field UNION ALL SELECT DISTINCT t, CAST(t*11 % 32 AS INTEGER), CAST(t*3 % 32 AS INTEGER) FROM field)"
NEAR_SQL = f"{FIELD_SQL}, {POINTS_SQL}, {DISK}, near AS (SELECT DISTINCT t, y + oy AS y, x + ox AS x FROM pts, disk)"


@query(f"""WITH {NEAR_SQL} SELECT f.y, f.x, round(coalesce(sum(v) FILTER (n.t IS NOT NULL), 0), 6) AS total, round(avg(v) FILTER (n.t IS NOT NULL), 6) AS mean, count(n.t) AS times, round(sum(v), 6) AS total_all
 FROM field f LEFT JOIN near n ON n.t = f.t AND n.y = f.y AND n.x = f.x GROUP BY f.y, f.x""")
def presence_composite(spark, sf_dir):
    return rounded(G.presence_composite(field(spark, sf_dir), field_points(spark, sf_dir), circle(2), SHAPE), "y", "x")


@query(f"""WITH {NEAR_SQL}, g AS (SELECT t, y, x, CASE WHEN v > 0.1e0 THEN v ELSE 0 END AS v FROM field) SELECT f.y, f.x, round(coalesce(sum(v) FILTER (n.t IS NOT NULL), 0), 6) AS total, round(avg(v) FILTER (n.t IS NOT NULL), 6) AS mean, count(n.t) AS times, round(sum(v), 6) AS total_all
 FROM g f LEFT JOIN near n ON n.t = f.t AND n.y = f.y AND n.x = f.x GROUP BY f.y, f.x""")
def presence_above_threshold(spark, sf_dir):
    return rounded(G.presence_composite(field(spark, sf_dir), field_points(spark, sf_dir), circle(2), SHAPE, minimum=0.1), "y", "x")


@query(f"WITH {FIELD_SQL} SELECT y, x, round(sum(least(v, 0)), 6) AS negative, round(sum(greatest(v, 0)), 6) AS positive FROM field GROUP BY y, x")
def signed_split(spark, sf_dir):
    rows = G.signed_parts(field(spark, sf_dir))
    return rounded(rows.groupBy("y", "x").agg(F.sum("negative").alias("negative"), F.sum("positive").alias("positive")), "y", "x")


@query(f"""WITH {FIELD_SQL}, {POINTS_SQL}, cells AS (SELECT t, y, x, (y // 8)*4 + x // 8 AS area_id FROM field WHERE v < 0), s AS (SELECT DISTINCT c.t, c.area_id, p.y AS py, p.x AS px FROM pts p JOIN cells c ON c.t = p.t AND c.y = p.y AND c.x = p.x)
 SELECT c.y, c.x, round(count(*)/32e0, 6) AS share FROM cells c JOIN (SELECT t, area_id FROM pts p JOIN cells USING (t, y, x)) s ON s.t = c.t AND s.area_id = c.area_id GROUP BY c.y, c.x""")
def area_frequency(spark, sf_dir):
    cells = field(spark, sf_dir).where("v < 0").select("t", "y", "x", F.expr("(y div 8)*4 + x div 8").alias("area_id"))
    return rounded(G.area_frequency(cells, field_points(spark, sf_dir).withColumn("type", F.lit(1)), 32), "y", "x")
