"""What follows from tracks: active ones, systems, regenesis and comparison, over tracks made of ``events``."""

from __future__ import annotations

from pyspark.sql import functions as F

from isobar.operators import summary as S, track as T
from isobar.plans.adapters import OBS_SQL, obs
from isobar.plans.registry import query
from isobar.plans.track_queries import hav

#: Of seven steps a track follows another parent for a while; a few rows are lyses and regeneses.
_LIFE = (
    "'g' as grid", "tid", "k", "time", "id", "y", "x", "lat", "lon", "p_cent", "p_edge", "area", "dsqp", "type", "centers", "case when floor(k/7.0e0) % 3 = 1 then tid + 1 else tid end as ptid",
    "case when k = 0 then 3 else 0 end as ege", "case when id % 97 = 0 then cast(1 + id % 3 as int) else 0 end as ely", "case when id % 17 = 0 then 2 else 0 end as erg",
)
#: What is kept of a row, of systems and of tracks.
KEPT = ["grid", "tid", "time", "id", "type", "area", "centers", "p_cent", "p_edge", "dsqp", "ptid", "ege", "ely", "erg"]
LIFE_SQL = OBS_SQL + ", life AS (SELECT " + ", ".join(_LIFE) + " FROM obs)"
RUNS_SQL = (
    LIFE_SQL
    + """, own AS (SELECT *, CASE WHEN ptid = tid AND type <> 0 THEN 1 ELSE 0 END AS own FROM life), bef AS (SELECT *, coalesce(lag(own) OVER (PARTITION BY tid ORDER BY time), 0) AS bef FROM own),
runs AS (SELECT *, CAST(sum(CASE WHEN own = 1 AND bef = 0 THEN 1 ELSE 0 END) OVER (PARTITION BY tid ORDER BY time ROWS UNBOUNDED PRECEDING) - 1 AS BIGINT) AS run FROM bef),
sys AS (SELECT *, 'g:' || tid || ':' || run AS sid, own = 0 AS closes FROM runs WHERE own = 1 OR bef = 1)"""
)
_ROW_SQL = """grid, CAST(tid AS BIGINT) AS tid, time, id, CASE WHEN closes THEN 0 ELSE type END AS type, CASE WHEN closes THEN 0 ELSE area END AS area, CASE WHEN closes THEN 0 ELSE centers END AS centers,
 CASE WHEN closes THEN NULL ELSE p_cent END AS p_cent, CASE WHEN closes THEN NULL ELSE p_edge END AS p_edge, CASE WHEN closes THEN NULL ELSE dsqp END AS dsqp, ptid"""
#: Where a stretch closes and the track 12 numbers before leads its own system at that time, it is revived by that.
REVIVED_SQL = """, ev AS (SELECT a.tid, a.time, c.tid AS otid, a.sid AS heir, c.sid AS dead FROM sys c JOIN sys a ON a.tid = c.tid - 12 AND a.time = c.time AND NOT a.closes WHERE c.closes),
up(dead, heir, until) AS (SELECT dead, heir, time FROM ev UNION ALL SELECT up.dead, ev.heir, up.until FROM up JOIN ev ON ev.dead = up.heir),
ends AS (SELECT dead, heir, until FROM up WHERE heir NOT IN (SELECT dead FROM ev))"""


def life(spark, sf_dir):
    return obs(spark, sf_dir).select(*[F.expr(e) for e in _LIFE])


def revivals(rows):
    """The regenesis events of these tracks."""
    runs = T._runs(rows.withColumn("key", F.col("tid")))
    closed, own = runs.where("closes").select(F.col("tid").alias("otid"), "time"), runs.where("NOT closes").select("grid", "tid", "time", "id", "y", "x")
    met = own.join(closed.withColumn("tid", F.col("otid") - 12), ["tid", "time"])
    return met.select("grid", "tid", "time", "id", F.lit("rg").alias("event"), F.lit(2).alias("etype"), "otid", "y", "x")


@query(f"""WITH {LIFE_SQL}, e AS (SELECT DISTINCT tid FROM life WHERE ely IN (1, 3)), ids AS (SELECT tid, row_number() OVER (ORDER BY tid) - 1 AS new FROM (SELECT DISTINCT tid FROM life WHERE tid NOT IN (FROM e)))
 SELECT grid, i.new AS tid, CAST(l.tid AS BIGINT) AS ftid, coalesce(p.new, l.ptid) AS ptid, time, id, type, ely FROM life l JOIN ids i ON i.tid = l.tid LEFT JOIN ids p ON p.tid = l.ptid""")
def tracks_going_on(spark, sf_dir):
    """Tracks without a lysis, numbered anew."""
    return T.split_active(life(spark, sf_dir))[0].select("grid", "tid", "ftid", "ptid", "time", "id", "type", "ely")


@query(f"WITH {LIFE_SQL} SELECT grid, CAST(tid AS BIGINT) AS tid, time, id, type, ely, ptid FROM life WHERE tid IN (SELECT tid FROM life WHERE ely IN (1, 3))")
def tracks_ended(spark, sf_dir):
    return T.split_active(life(spark, sf_dir))[1].select("grid", "tid", "time", "id", "type", "ely", "ptid")


@query(f"WITH RECURSIVE {RUNS_SQL} SELECT {_ROW_SQL}, ege, ely, erg, sid FROM sys")
def systems_of_tracks(spark, sf_dir):
    """Each stretch in which a track leads its own system, closed by a placeholder."""
    rows = life(spark, sf_dir)
    return T.systems(rows, revivals(rows), regenesis=False)[0].select(*KEPT, "sid")


@query(f"""WITH RECURSIVE {RUNS_SQL}{REVIVED_SQL} SELECT {_ROW_SQL}, CASE WHEN erg > 0 THEN 0 ELSE ege END AS ege, CASE WHEN erg > 0 THEN 0 ELSE ely END AS ely, erg, coalesce(heir, sid) AS sid
 FROM sys LEFT JOIN ends ON dead = sid WHERE until IS NULL OR time < until""")
def systems_revived(spark, sf_dir):
    """Dead systems joined to those that revived them, along chains of any length."""
    rows = life(spark, sf_dir)
    return T.systems(rows, revivals(rows), regenesis=True)[0].select(*KEPT, "sid")


@query(f"""WITH RECURSIVE {RUNS_SQL}{REVIVED_SQL}, s AS (SELECT tid, sid, min(time) AS f, max(time) AS t FROM sys GROUP BY tid, sid)
 SELECT CAST(ev.tid AS BIGINT) AS tid, ev.time, ev.otid, coalesce(ends.heir, s.sid) AS sid FROM ev JOIN s ON s.tid = ev.tid AND ev.time BETWEEN s.f AND s.t LEFT JOIN ends ON ends.dead = s.sid WHERE ends.until IS NULL OR ev.time < ends.until""")
def system_events(spark, sf_dir):
    rows = life(spark, sf_dir)
    return T.systems(rows, revivals(rows), regenesis=True)[1].select("tid", "time", "otid", "sid")


_MONTH = "((year(d) - 1900)*12 + month(d) - 1)"
_FACTS = "count(*) AS n, {0} AS m, {1} AS begins".format(*[_MONTH.replace("d)", f"DATE '1900-01-01' + CAST(floor({f}(time)) AS INTEGER))") for f in ("max", "min")])


@query(f"""WITH {OBS_SQL}, o AS (SELECT *, time + 12 AS tm FROM obs WHERE type <> 0), e AS (SELECT tid, max(tm) AS last FROM o GROUP BY tid),
 a AS (SELECT tid AS a, tm AS time, round(tm*24, 3) AS h, lat, lon, p_cent, area, p_edge - p_cent AS depth, dsqp FROM o),
 b AS (SELECT tid AS b, tm AS time, round(tm*24, 3) AS h, lat + 0.5e0 AS lat, lon, p_cent + 10 AS p_cent, area + 1 AS area, p_edge - p_cent - 10 AS depth, dsqp*2 AS dsqp FROM o JOIN e USING (tid)
  WHERE id % 5 <> 0 AND NOT (tid % 2 = 0 AND date_trunc('month', DATE '1900-01-01' + CAST(floor(tm) AS INTEGER)) = date_trunc('month', DATE '1900-01-01' + CAST(floor(last) AS INTEGER)))),
 fa AS (SELECT a, {_FACTS} FROM a GROUP BY a), fb AS (SELECT b, {_FACTS} FROM b GROUP BY b),
 p AS (SELECT a.a, b.b, fa.m AS ma, fb.m AS mb, fa.n AS na, fb.n AS nb, count(*) AS shared, avg({hav('a.lat', 'b.lat', 'a.lon', 'b.lon')}) AS dist, avg(a.p_cent - b.p_cent) AS p_cent_diff, avg(a.area - b.area) AS area_diff, avg(a.depth - b.depth) AS depth_diff, avg(a.dsqp - b.dsqp) AS dsqp_diff
  FROM a JOIN b USING (h) JOIN fa ON fa.a = a.a JOIN fb ON fb.b = b.b WHERE fb.m = fa.m OR (fb.m = fa.m - 1 AND fa.begins < fa.m) GROUP BY 1, 2, 3, 4, 5, 6),
 g AS (SELECT *, count(*) OVER (PARTITION BY a) AS matches, row_number() OVER (PARTITION BY a ORDER BY dist, ma - mb, b) AS r FROM p WHERE 2e0*shared/(na + nb) >= 0.6e0 AND dist < 1500)
 SELECT CAST(fa.a AS BIGINT) AS tid1, CAST(fa.m // 12 + 1900 AS INTEGER) AS year1, CAST(fa.m % 12 + 1 AS INTEGER) AS month1, coalesce(matches, 0) AS num_matches, CAST(g.b AS BIGINT) AS tid2, CAST(mb // 12 + 1900 AS INTEGER) AS year2, CAST(mb % 12 + 1 AS INTEGER) AS month2,
  round(dist, 5) AS dist, round(p_cent_diff, 6) AS p_cent_diff, round(area_diff, 6) AS area_diff, round(depth_diff, 6) AS depth_diff, round(dsqp_diff, 6) AS dsqp_diff FROM fa LEFT JOIN g ON g.a = fa.a AND r = 1""")
def compare_months(spark, sf_dir):
    """Tracks against a version of them that lacks rows, half of which end a month earlier."""
    first = obs(spark, sf_dir).withColumn("time", F.col("time") + 12)
    month = lambda c: F.trunc(F.date_add(F.lit("1900-01-01").cast("date"), F.floor(c).cast("int")), "month")
    ends = first.where("type <> 0").groupBy("tid").agg(F.max("time").alias("last"))
    shorter = first.join(ends, "tid").where((F.col("id") % 5 != 0) & ~((F.col("tid") % 2 == 0) & (month("time") == month("last")))).drop("last")
    second = shorter.withColumns({"lat": F.col("lat") + 0.5, "p_cent": F.col("p_cent") + 10, "area": F.col("area") + 1, "dsqp": F.col("dsqp") * 2})
    digits = {"dist": 5, "p_cent_diff": 6, "area_diff": 6, "depth_diff": 6, "dsqp_diff": 6}
    return S.compare_months(first, second, max_separation=1500).withColumns({c: F.round(c, n) for c, n in digits.items()})
