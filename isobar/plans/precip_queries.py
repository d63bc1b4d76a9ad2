"""Precipitation of storms, with totals for each centre."""

from __future__ import annotations

from pyspark.sql import functions as F

from isobar.operators import label as L, precip as P
from isobar.plans.adapters import FIELD_SQL, SHAPE, field
from isobar.plans.raster_queries import latlong_grid, pressure, typed_centers
from isobar.plans.registry import query
from isobar.plans.track_queries import hav

#: Metres.
RADIUS = 250_000.0


def sized_grid(spark):
    """The field's cells with latitude, longitude and the lengths of their sides in metres."""
    return latlong_grid(spark).withColumns({"y_size": F.lit(6371000.0) * F.radians(F.lit(0.9)), "x_size": F.lit(6371000.0) * F.radians(F.lit(1.5)) * F.cos(F.radians("lat"))})


def parts(spark, sf_dir):
    """(rain, areas, centers, grid): rain where the field is positive, storms where it is below -0.1."""
    f = field(spark, sf_dir)
    areas = L.components(f.where("v < -0.1"), SHAPE).withColumnRenamed("label", "area_id")
    rain = f.select("t", "y", "x", F.greatest(F.col("v"), F.lit(0.0)).alias("large"), F.abs("v").alias("total"))
    return rain, areas, P.lowest_centers(areas, f), sized_grid(spark)


def _components(name: str, where: str) -> str:
    """DuckDB text of ``name`` (t, y, x, label): the components of the field's cells, by the first cell in row order."""
    return f"""{name}_c AS (SELECT t, y, x, y*32 + x AS k FROM field WHERE {where}),
{name}_p(t, y, x, k) AS (SELECT t, y, x, k FROM {name}_c UNION SELECT c.t, c.y, c.x, p.k FROM {name}_p p JOIN {name}_c c ON c.t = p.t AND abs(c.y - p.y) + abs(c.x - p.x) = 1 AND p.k < c.k),
{name} AS (SELECT t, y, x, min(k) AS label FROM {name}_p GROUP BY t, y, x)"""


def _given(wet: str, sphere: bool) -> str:
    away = f"round({hav('45e0 + m.y*0.9e0', '45e0 + s.y*0.9e0', '-20e0 + m.x*1.5e0', '-20e0 + s.x*1.5e0')}, 6)" if sphere else "(m.y - s.y)*(m.y - s.y) + (m.x - s.x)*(m.x - s.x)"
    return f"""WITH RECURSIVE {FIELD_SQL}, {_components('area', 'v < -0.1e0')}, {_components('region', wet)},
n AS (SELECT t, y, x, label, row_number() OVER (PARTITION BY t, label ORDER BY v, y, x) AS r, count(*) OVER (PARTITION BY t, label) AS size FROM area JOIN field USING (t, y, x)),
k AS (SELECT *, CAST(row_number() OVER (PARTITION BY t ORDER BY y, x) - 1 AS INTEGER) AS id FROM n WHERE r = 1 OR (r <= 2 AND size >= 6)),
centers AS (SELECT t, y, x, label, id, CASE WHEN r = 1 THEN 1 ELSE 2 END AS type, min(CASE WHEN r = 1 THEN id END) OVER (PARTITION BY t, label) AS parent FROM k),
sides AS (SELECT c.t, c.parent AS id, c.y, c.x, 6371000e0*radians(0.9e0) AS ys, 6371000e0*radians(1.5e0)*cos(radians(45e0 + p.y*0.9e0)) AS xs FROM centers c JOIN centers p ON p.t = c.t AND p.id = c.parent),
reach AS (SELECT c.t, c.id, a.y, a.x FROM centers c JOIN area a ON a.t = c.t AND a.label = c.label WHERE c.type = 1
  UNION SELECT t, id, y + dy, x + dx FROM sides, range(-6, 7) g(dy), range(-6, 7) h(dx) WHERE sqrt(pow(dx*xs, 2) + pow(dy*ys, 2)) <= {RADIUS}::DOUBLE),
meets AS (SELECT DISTINCT t, g.label, r.id FROM region g JOIN reach r USING (t, y, x)),
met AS (SELECT t, g.label, g.y, g.x, count(*) AS n, min(id) AS id FROM region g JOIN meets m USING (t, label) GROUP BY t, g.label, g.y, g.x),
near AS (SELECT m.t, m.y, m.x, c.id, row_number() OVER (PARTITION BY m.t, m.y, m.x ORDER BY min({away}), c.id) AS first FROM met m JOIN meets e ON e.t = m.t AND e.label = m.label JOIN centers c ON c.t = m.t AND c.id = e.id JOIN area s ON s.t = c.t AND s.label = c.label
  WHERE m.n > 1 GROUP BY m.t, m.y, m.x, c.id),
given AS (SELECT t, y, x, abs(v) AS total, id FROM (SELECT t, y, x, id FROM met WHERE n = 1 UNION ALL SELECT t, y, x, id FROM near WHERE first = 1) JOIN field USING (t, y, x))"""


SUMS_SQL = ", sums AS (SELECT t, id, sum(total) AS precip, count(*) AS precip_area FROM given GROUP BY t, id)"
TOTALS = "SELECT c.t, c.id, CAST(c.y AS INTEGER) AS y, CAST(c.x AS INTEGER) AS x, c.type, c.parent, round(coalesce(s.precip, 0), 9) AS precip, coalesce(s.precip_area, 0) AS precip_area FROM centers c LEFT JOIN sums s ON s.t = c.t AND s.id = "
LOCAL = "v >= 0.04e0 + 0.002e0*y AND v > 0"


@query(_given("v >= 0.05e0", False) + " SELECT t, y, x, round(total, 9) AS total, id FROM given")
def precip_cells(spark, sf_dir):
    rain, areas, centers, grid = parts(spark, sf_dir)
    return P.attribute(rain, areas, centers, grid, SHAPE, 0.05, RADIUS).withColumn("total", F.round("total", 9))


@query(_given("v >= 0.05e0", False) + SUMS_SQL + TOTALS + "CASE WHEN c.type = 1 THEN c.id END")
def precip_by_center(spark, sf_dir):
    rain, areas, centers, grid = parts(spark, sf_dir)
    return P.totals(P.attribute(rain, areas, centers, grid, SHAPE, 0.05, RADIUS), centers).withColumn("precip", F.round("precip", 9))


@query(_given(LOCAL, True) + SUMS_SQL + TOTALS + "c.parent")
def precip_by_system(spark, sf_dir):
    """Cells by great circle, a minimum that differs from cell to cell, and secondaries with what their primary has."""
    rain, areas, centers, grid = parts(spark, sf_dir)
    local = F.lit(0.04) + F.lit(0.002) * F.col("y")
    return P.totals(P.attribute(rain, areas, centers, grid, SHAPE, local, RADIUS, sphere=True), centers, handed_on=True).withColumn("precip", F.round("precip", 9))


@query()
def precip_attribution(spark, sf_dir):
    """Rain of the centres whose closed contours were found in the scaled field."""
    centers, grid = typed_centers(spark, sf_dir), sized_grid(spark)
    areas = L.area_cells(pressure(spark, sf_dir), centers, SHAPE)
    rain = field(spark, sf_dir).select("t", "y", "x", F.greatest(F.col("v"), F.lit(0.0)).alias("large"), F.abs("v").alias("total"))
    return P.attribute(rain, areas, centers, grid, SHAPE, 0.05, RADIUS)
