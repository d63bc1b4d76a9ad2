"""Stencils, labels and tracking over the field view."""

from __future__ import annotations

from pyspark.sql import functions as F

from isobar.operators import label as L, raster as R, seams as S, track as T
from isobar.plans.adapters import FIELD_SQL, SHAPE, field
from isobar.plans.grid_queries import rounded
from isobar.plans.registry import query
from isobar.plans.track_queries import hav

KEYS = ("t", "y", "x")


def _window(agg: str, half: int = 1, extra: str = "") -> str:
    return f"""WITH {FIELD_SQL}, o AS (SELECT dy, dx FROM range({-half}, {half + 1}) a(dy), range({-half}, {half + 1}) b(dx)), m AS (SELECT t, y - dy AS y, x - dx AS x, v FROM field, o)
 SELECT t, CAST(y AS INTEGER) AS y, CAST(x AS INTEGER) AS x, {agg} AS v FROM m WHERE y BETWEEN 0 AND 31 AND x BETWEEN 0 AND 31 GROUP BY t, y, x {extra}"""


@query(_window("round(avg(v), 9)"))
def filter_mean(spark, sf_dir):
    return rounded(R.filter_field(field(spark, sf_dir), 1, SHAPE, "mean"), *KEYS, digits=9)


@query(_window("round(sum(v), 9)"))
def filter_sum(spark, sf_dir):
    return rounded(R.filter_field(field(spark, sf_dir), 1, SHAPE, "sum"), *KEYS, digits=9)


@query(_window("round(median(v), 9)"))
def filter_median(spark, sf_dir):
    return rounded(R.filter_field(field(spark, sf_dir), 1, SHAPE, "median"), *KEYS, digits=9)


@query(_window("min(v)"))
def filter_min(spark, sf_dir):
    return R.filter_field(field(spark, sf_dir), 1, SHAPE, "min")


@query(_window("max(v)"))
def filter_max(spark, sf_dir):
    return R.filter_field(field(spark, sf_dir), 1, SHAPE, "max")


@query(_window("CASE WHEN count(v) = 9 THEN round(stddev_pop(v), 8) END"))
def filter_std(spark, sf_dir):
    return rounded(R.filter_field(field(spark, sf_dir), 1, SHAPE, "std", missing_edge=True), *KEYS, digits=8)


@query(_window("CASE WHEN count(v) = 25 THEN round(avg(v), 9) END", 2))
def box_smooth(spark, sf_dir):
    return rounded(R.filter_field(field(spark, sf_dir), 2, SHAPE, "mean", missing_edge=True), *KEYS, digits=9)


CLAMPED_SQL = f"{FIELD_SQL}, grid AS (SELECT t, y, x FROM (SELECT DISTINCT t FROM field) a, range(32) b(y), range(32) c(x))"


@query(f"""WITH {CLAMPED_SQL}, o AS (SELECT dy, dx FROM range(-2, 2) a(dy), range(-2, 2) b(dx))
 SELECT g.t, CAST(g.y AS INTEGER) AS y, CAST(g.x AS INTEGER) AS x, round(sum(v)/16, 9) AS v FROM grid g, o JOIN field f ON f.t = g.t AND f.y = greatest(0, least(31, g.y + dy)) AND f.x = greatest(0, least(31, g.x + dx)) GROUP BY ALL""")
def uniform_edge_clamped(spark, sf_dir):
    return rounded(R.uniform_filter(field(spark, sf_dir), 4, SHAPE), *KEYS, digits=9)


@query(f"""WITH {CLAMPED_SQL}, o AS (SELECT dy, dx FROM range(-2, 3) a(dy), range(-2, 3) b(dx) WHERE dy*dy + dx*dx <= 4)
 SELECT g.t, CAST(g.y AS INTEGER) AS y, CAST(g.x AS INTEGER) AS x, round(sum(v), 9) AS v FROM grid g, o JOIN field f ON f.t = g.t AND f.y = greatest(0, least(31, g.y + dy)) AND f.x = greatest(0, least(31, g.x + dx)) GROUP BY ALL""")
def circular_smooth(spark, sf_dir):
    return rounded(R.footprint_sum(field(spark, sf_dir), R.circle(2), SHAPE), *KEYS, digits=9)


@query(f"""WITH {FIELD_SQL}, k AS (SELECT d, exp(-0.5e0*d*d)/(SELECT sum(exp(-0.5e0*e*e)) FROM range(-4, 5) r(e)) AS w FROM range(-4, 5) r(d)),
 a AS (SELECT t, CAST((y - d + 32) % 32 AS INTEGER) AS y, x, sum(v*w) AS v FROM field, k GROUP BY ALL) SELECT t, y, CAST((x - d + 32) % 32 AS INTEGER) AS x, round(sum(v*w), 9) AS v FROM a, k GROUP BY t, y, 3""")
def gaussian_wrapped(spark, sf_dir):
    return rounded(R.gaussian_filter(field(spark, sf_dir), 1.0, SHAPE), *KEYS, digits=9)


def _extreme(best: str) -> str:
    return f"""WITH {FIELD_SQL}, o AS (SELECT dy, dx FROM range(-1, 2) a(dy), range(-1, 2) b(dx)), m AS (SELECT f.t, f.y, f.x, f.v, {best}(g.v) AS best FROM field f, o JOIN field g ON g.t = f.t AND g.y = f.y + dy AND g.x = f.x + dx GROUP BY ALL)
 SELECT t, y, x, v FROM m WHERE v = best"""


@query(_extreme("min"))
def local_minima(spark, sf_dir):
    return R.extrema(field(spark, sf_dir), shape=SHAPE)


@query(_extreme("max"))
def local_maxima(spark, sf_dir):
    return R.extrema(field(spark, sf_dir), shape=SHAPE, largest=True)


SOBEL_SQL = """sb AS (SELECT dy, dx, dy*(2 - abs(dx)) AS wy, dx*(2 - abs(dy)) AS wx FROM range(-1, 2) a(dy), range(-1, 2) b(dx)),
 g AS (SELECT t, y - dy AS y, x - dx AS x, sum(v*wy)/8e0 AS sy, sum(v*wx)/8e0 AS sx, count(*) AS n FROM field, sb WHERE y - dy BETWEEN 0 AND 31 AND x - dx BETWEEN 0 AND 31 GROUP BY 1, 2, 3)"""


@query(f"""WITH {FIELD_SQL}, {SOBEL_SQL}, h AS (SELECT t, y - dy AS y, x - dx AS x, sum(CASE WHEN n = 9 THEN sy*wy + sx*wx END)/8e0 AS v, count(*) FILTER (n = 9) AS m FROM g, sb WHERE y - dy BETWEEN 0 AND 31 AND x - dx BETWEEN 0 AND 31 GROUP BY 1, 2, 3)
 SELECT t, CAST(y AS INTEGER) AS y, CAST(x AS INTEGER) AS x, round(v, 9) AS v FROM h WHERE m = 9""")
def laplacian(spark, sf_dir):
    return rounded(R.laplacian(field(spark, sf_dir), SHAPE).where("v IS NOT NULL"), *KEYS, digits=9)


@query(f"WITH {FIELD_SQL}, {SOBEL_SQL} SELECT t, CAST(y AS INTEGER) AS y, CAST(x AS INTEGER) AS x, round(-sy, 9) AS gy, round(sx, 9) AS gx, round(sqrt(sy*sy + sx*sx), 9) AS magnitude FROM g WHERE n = 9")
def sobel_gradient(spark, sf_dir):
    return rounded(R.gradient_xy(field(spark, sf_dir), SHAPE).where("magnitude IS NOT NULL"), *KEYS, digits=9)


RING_SQL = "rg AS (SELECT dy, dx, sqrt(dy*dy + dx*dx) AS d FROM range(-2, 3) a(dy), range(-2, 3) b(dx) WHERE dy*dy + dx*dx > 0 AND dy*dy + dx*dx <= 4)"


@query(f"""WITH {FIELD_SQL}, {RING_SQL}, c AS (SELECT f.t, f.y, f.x, f.v FROM field f, rg JOIN field g ON g.t = f.t AND g.y = f.y + dy AND g.x = f.x + dx GROUP BY ALL HAVING f.v < min(g.v)) SELECT c.t, c.y, c.x, round(avg((f.v - c.v)/d), 9) AS gradient FROM c, rg JOIN field f ON f.t = c.t AND f.y = c.y + dy AND f.x = c.x + dx GROUP BY c.t, c.y, c.x""")
def ring_gradient(spark, sf_dir):
    """The gradient around every cell that is lower than its ring."""
    f = field(spark, sf_dir)
    ring = R.ring(0, 2)
    lower = R.neighbours(f, ring, SHAPE).groupBy(*KEYS).agg(F.min("v").alias("least")).join(f, list(KEYS)).where("v < least").select(*KEYS)
    return rounded(R.ring_gradient(f, lower, ring), *KEYS, digits=9)


@query(f"""WITH {FIELD_SQL}, {RING_SQL} SELECT c.t, c.y, c.x, round(avg((f.v - c.v)/d), 9) AS gradient FROM field c, rg JOIN field f ON f.t = c.t AND f.y = c.y + dy AND f.x = c.x + dx GROUP BY c.t, c.y, c.x""")
def ring_gradient_everywhere(spark, sf_dir):
    """As :func:`ring_gradient`, for every cell, those at the edge with what there is of their ring."""
    return rounded(R.ring_gradient_field(field(spark, sf_dir), R.ring(0, 2), SHAPE), *KEYS, digits=9)


@query(f"""WITH {FIELD_SQL}, {RING_SQL}, o AS (SELECT dy, dx FROM range(-2, 3) a(dy), range(-2, 3) b(dx)), m AS (SELECT f.t, f.y, f.x, f.v, min(g.v) AS best FROM field f, o JOIN field g ON g.t = f.t AND g.y = f.y + dy AND g.x = f.x + dx GROUP BY ALL),
 c AS (SELECT * FROM m WHERE v = best), g AS (SELECT c.t, c.y, c.x, c.v, avg((f.v - c.v)/d) AS gradient FROM c, rg JOIN field f ON f.t = c.t AND f.y = c.y + dy AND f.x = c.x + dx GROUP BY ALL)
 SELECT t, y, x, v, round(gradient, 9) AS gradient, CAST(row_number() OVER (PARTITION BY t ORDER BY y, x) - 1 AS INTEGER) AS id FROM g WHERE gradient >= 0.12e0""")
def find_centers(spark, sf_dir):
    found = R.find_centers(field(spark, sf_dir), SHAPE, 5, 1.0, 0.12, R.ring(0, 2)).select("t", "y", "x", "v", "gradient", "id")
    return found.withColumn("gradient", F.round("gradient", 9))


def regrid_table(spark):
    dst = [(r, c, 0.4 + 1.9 * r, 0.7 + 1.7 * c) for r in range(16) for c in range(18)]
    return spark.createDataFrame(R.bilinear_weights(list(range(32)), list(range(32)), dst), "dst_y int, dst_x int, src_y int, src_x int, w double")


@query(f"""WITH {FIELD_SQL}, p AS (SELECT r, c, 0.4e0 + 1.9e0*r AS py, 0.7e0 + 1.7e0*c AS px FROM range(16) a(r), range(18) b(c)), q AS (SELECT * FROM p WHERE py <= 31 AND px <= 31),
 w AS (SELECT r, c, CAST(floor(py) AS INTEGER) + i AS sy, CAST(floor(px) AS INTEGER) + j AS sx, abs(1 - i - (py - floor(py)))*abs(1 - j - (px - floor(px))) AS w FROM q, range(2) m(i), range(2) n(j)),
 k AS (SELECT r, c, count(*) AS k FROM w WHERE w > 0 GROUP BY r, c) SELECT t, CAST(w.r AS INTEGER) AS y, CAST(w.c AS INTEGER) AS x, round(sum(v*w), 8) AS v FROM w JOIN field f ON f.y = sy AND f.x = sx WHERE w > 0 GROUP BY t, w.r, w.c""")
def regrid_weights(spark, sf_dir):
    return rounded(R.regrid(field(spark, sf_dir), regrid_table(spark)), *KEYS, digits=8)


@query(f"""WITH {FIELD_SQL}, p AS (SELECT r, c, 0.4e0 + 1.9e0*r AS py, 0.7e0 + 1.7e0*c AS px FROM range(16) a(r), range(18) b(c))
 SELECT t, CAST(r AS INTEGER) AS y, CAST(c AS INTEGER) AS x, round(v, 8) AS v FROM p JOIN field f ON f.y = least(greatest(CAST(ceil(py - 0.5e0) AS INTEGER), 0), 31) AND f.x = least(greatest(CAST(ceil(px - 0.5e0) AS INTEGER), 0), 31)""")
def regrid_nearest(spark, sf_dir):
    dst = [(r, c, 0.4 + 1.9 * r, 0.7 + 1.7 * c) for r in range(16) for c in range(18)]
    table = spark.createDataFrame(R.nearest_weights(list(range(32)), list(range(32)), dst), "dst_y int, dst_x int, src_y int, src_x int, w double")
    return rounded(R.regrid(field(spark, sf_dir), table), *KEYS, digits=8)


def latlong_grid(spark):
    """y, x, lat, lon of the field's cells: rows 0.9 degrees apart from 45 N, columns 1.5 degrees from 20 W."""
    cells = spark.range(SHAPE[0] * SHAPE[1]).select((F.col("id") / SHAPE[1]).cast("int").alias("y"), (F.col("id") % SHAPE[1]).cast("int").alias("x"))
    return cells.withColumns({"lat": F.lit(45.0) + F.col("y") * 0.9, "lon": F.lit(-20.0) + F.col("x") * 1.5})


def slope_sql(source: str, out: str) -> str:
    """DuckDB text of the gradient per kilometre of ``source`` (t, y, x, v) on that grid; null next to an edge or a missing value."""
    lat = lambda y: f"(45e0 + ({y})*0.9e0)"
    sums = f"{out}_s AS (SELECT t, y - dy AS y, x - dx AS x, sum(v*wy)/8e0 AS sy, sum(v*wx)/8e0 AS sx, count(v) AS n FROM {source}, sb WHERE y - dy BETWEEN 0 AND 31 AND x - dx BETWEEN 0 AND 31 GROUP BY 1, 2, 3)"
    return f"{sums}, {out} AS (SELECT t, y, x, CASE WHEN n = 9 THEN sy/({hav(lat('y - 1'), lat('y + 1'), '0e0', '0e0')}/2) END AS gy, CASE WHEN n = 9 THEN sx/({hav(lat('y'), lat('y'), '0e0', '3e0')}/2) END AS gx FROM {out}_s)"


@query(f"WITH {FIELD_SQL}, {SOBEL_SQL}, {slope_sql('field', 'a')} SELECT t, CAST(y AS INTEGER) AS y, CAST(x AS INTEGER) AS x, round(gy, 10) AS gy, round(gx, 10) AS gx, round(sqrt(gy*gy + gx*gx), 10) AS magnitude FROM a")
def slope_latlong(spark, sf_dir):
    return rounded(R.slope_latlong(field(spark, sf_dir), latlong_grid(spark), SHAPE), *KEYS, digits=10)


@query(f"""WITH {FIELD_SQL}, {SOBEL_SQL}, {slope_sql('field', 'a')}, ax AS (SELECT t, y, x, gx AS v FROM a), ay AS (SELECT t, y, x, gy AS v FROM a), {slope_sql('ax', 'b')}, {slope_sql('ay', 'c')}
 SELECT t, CAST(y AS INTEGER) AS y, CAST(x AS INTEGER) AS x, round(b.gx + c.gy, 12) AS v FROM b JOIN c USING (t, y, x)""")
def laplacian_latlong(spark, sf_dir):
    return rounded(R.laplacian_latlong(by_step(spark, sf_dir), latlong_grid(spark), SHAPE), *KEYS, digits=12)


@query(f"""WITH {FIELD_SQL}, o AS (SELECT * FROM (SELECT dy, dx, sqrt(pow(dy*25e0, 2) + pow(dx*30e0, 2)) AS w FROM range(-8, 9) a(dy), range(-8, 9) b(dx)) WHERE w > 172.5e0 AND w <= 200e0)
 SELECT t, CAST(y - dy AS INTEGER) AS y, CAST(x - dx AS INTEGER) AS x, round(sum(v*w), 6) + 0e0 AS v FROM field, o WHERE y - dy BETWEEN 0 AND 31 AND x - dx BETWEEN 0 AND 31 GROUP BY 1, 2, 3""")
def ring_by_distance(spark, sf_dir):
    """Sums over the ring 200 km away in cells of 25 by 30 km, weighted by distance."""
    made = R.stencil_sum(field(spark, sf_dir), R.ring_distance(25.0, 30.0, 200.0), shape=SHAPE)
    return made.withColumn("v", F.round("v", 6) + 0.0)


@query(f"""WITH {FIELD_SQL} SELECT CASE WHEN v >= -0.2e0 AND v < -0.1e0 THEN 1 WHEN v >= -0.1e0 AND v < 0 THEN 2 WHEN v >= 0 AND v < 0.1e0 THEN 3 WHEN v >= 0.1e0 AND v <= 0.2e0 THEN 4 END AS bin, count(*) AS n FROM field GROUP BY 1""")
def discretise(spark, sf_dir):
    bins = R.discretise(F.col("v"), [-0.2, -0.1, 0.0, 0.1, 0.2])
    return field(spark, sf_dir).groupBy(bins.alias("bin")).agg(F.count(F.lit(1)).alias("n"))


@query(f"""WITH RECURSIVE {FIELD_SQL}, c AS (SELECT t, y, x, y*32 + x AS k FROM field WHERE v < -0.1e0), p(t, y, x, k) AS (SELECT t, y, x, k FROM c UNION SELECT c.t, c.y, c.x, p.k FROM p JOIN c ON c.t = p.t AND abs(c.y - p.y) + abs(c.x - p.x) = 1 AND p.k < c.k)
 SELECT t, y, x, CAST(min(k) AS INTEGER) AS label FROM p GROUP BY t, y, x""")
def components(spark, sf_dir):
    return L.components(field(spark, sf_dir).where("v < -0.1"), SHAPE)


def by_step(spark, sf_dir):
    """The field view dealt by step, so that stencils over it find all their cells in one task.

    With a number, as tasks would be put together by the bytes they read, which are few for the cells they hold.
    """
    return field(spark, sf_dir).repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "t")


def pressure(spark, sf_dir):
    """The field view smoothed and scaled to Pa."""
    smooth = R.uniform_filter(by_step(spark, sf_dir), 3, SHAPE)
    return smooth.withColumn("v", 100000 + 20000 * F.col("v"))


def typed_centers(spark, sf_dir):
    """Centres with closed areas of the scaled field, on a grid of 100 km cells around 60 N."""
    p = pressure(spark, sf_dir)
    centers = R.find_centers(p, SHAPE, 5, 1.0, 0.0, R.ring(0, 2))
    placed = centers.withColumns({"lat": F.lit(45.0) + F.col("y") * 0.9, "lon": F.lit(-20.0) + F.col("x") * 1.5})
    return L.find_areas(p, placed, SHAPE, 200.0, 0.5, 600_000.0, R.extrema(p, 5, shape=SHAPE, largest=True))


@query()
def contour_areas(spark, sf_dir):
    return typed_centers(spark, sf_dir)


def tracked(spark, sf_dir):
    """Segments of two days, each warmed up by the day before."""
    steps = typed_centers(spark, sf_dir).withColumns({"time": F.col("t") * 0.25, "grid": F.lit("0")})
    return S.track_by_segments(steps, T.Settings(reach=700_000.0), 1.0, lambda time: F.floor(time / 2).cast("bigint"))


@query()
def tracking_lifecycle(spark, sf_dir):
    return tracked(spark, sf_dir)[0]


@query()
def tracking_events(spark, sf_dir):
    return tracked(spark, sf_dir)[1]


@query()
def system_tracks(spark, sf_dir):
    return T.systems(*tracked(spark, sf_dir), regenesis=False)[0]


@query()
def regenesis(spark, sf_dir):
    return T.systems(*tracked(spark, sf_dir), regenesis=True)[0]


@query()
def active_tracks(spark, sf_dir):
    return T.split_active(tracked(spark, sf_dir)[0])[0]
