"""Masks of fields and the nearest points and areas of others."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from isobar.functions.geo import haversine
from isobar.sources.shared import written


def valid_range(v: Column, low: float = 80000.0, high: float = 200000.0) -> Column:
    """The value, null outside the range (and where it isn't a number)."""
    return F.when(v.between(low, high) & ~F.isnan(v), v)


def ground_mask(field: DataFrame, grid: DataFrame, max_elevation: float = 1500.0, min_latitude: float = 5.0) -> DataFrame:
    """``field`` with ``mask``: true on high ground and beyond the least latitude (the greatest, if it is negative).

    ``grid`` (y, x, lat, z) is one row for each cell.
    """
    beyond = F.col("lat") < min_latitude if min_latitude >= 0 else F.col("lat") > min_latitude
    hidden = grid.select("y", "x", ((F.col("z") > max_elevation) | beyond).alias("mask"))
    return field.join(hidden, ["y", "x"]).select(*field.columns, "mask")


def hemisphere_cut(field: DataFrame, grid: DataFrame, north: bool = True) -> DataFrame:
    """The field with the other hemisphere's values null."""
    keep = F.col("lat") >= 0 if north else F.col("lat") <= 0
    return field.join(grid.select("y", "x", "lat"), ["y", "x"]).withColumn("v", F.when(keep, F.col("v"))).select(*field.columns)


def class_mask(region: DataFrame, low: float, high: float, values: Sequence[int] | None = None) -> DataFrame:
    """Cells whose class is in a range, and of the listed ones if any are."""
    inside = F.col("region").between(low, high)
    return region.where(inside & F.col("region").isin(list(values)) if values else inside).select("y", "x")


#: Half of the Earth's circumference in kilometres: no two points are farther apart.
HALF_WAY_KM = 20_016.0


def nearest_point(points: DataFrame, targets: DataFrame, reach_km: float | None = None, key: str = "id", start_km: float = 500.0) -> DataFrame:
    """``points`` (key, lat, lon) with the nearest of ``targets`` (target, lat, lon): ``target`` and ``distance``.

    With ``reach_km`` only targets so near count, and none is null.  Without, the search goes on with
    twice the reach for the points that found nothing.  Latitude bands of the reach's width are the
    join key; the first target wins ties.
    """
    if reach_km is not None:
        found = _nearest_within(points, targets, reach_km, key)
    else:
        # each round is written, or the next would do it again
        points = written(points)
        left, parts, reach = points.select(key, "lat", "lon"), [], start_km
        while True:
            part = written(_nearest_within(left, targets, min(reach, HALF_WAY_KM), key))
            parts.append(part)
            if reach >= HALF_WAY_KM:
                break
            left = written(left.join(part.select(key), key, "left_anti"))
            if left.isEmpty():
                break
            reach *= 4
        found = parts[0]
        for part in parts[1:]:
            found = found.unionByName(part)
    return points.join(found, key, "left")


def _nearest_within(points: DataFrame, targets: DataFrame, reach_km: float, key: str) -> DataFrame:
    band = F.floor((F.col("lat") + 90) / (reach_km / 6371.0 * 180 / math.pi)).cast("int")
    # points in the order of their key: where the targets are broadcast the pairs keep it, so the least is taken as they come and none is held
    left = points.select(key, F.col("lat").alias("lat1"), F.col("lon").alias("lon1"), band.alias("band")).repartition(key).sortWithinPartitions(key)
    # always true; a sort right below a join is dropped, and the pairs would be sorted instead
    left = left.where(F.spark_partition_id() >= 0)
    right = targets.select("target", F.col("lat").alias("lat2"), F.col("lon").alias("lon2"), F.explode(F.array(band - 1, band, band + 1)).alias("band"))
    pairs = left.join(right, "band").withColumn("distance", haversine(F.col("lat1"), F.col("lat2"), F.col("lon1"), F.col("lon2"), "km"))
    best = pairs.where(F.col("distance") <= reach_km).groupBy(key).agg(F.min(F.struct("distance", "target")).alias("b"))
    return best.select(key, F.col("b.target").alias("target"), F.col("b.distance").alias("distance"))


def nearest_area(points: DataFrame, areas: DataFrame, reach: int | None = None, shape: tuple[int, int] | None = None) -> DataFrame:
    """``points`` (t, y, x, ...) with the label of the nearest area cell and its ``distance`` in cells; ties to the smaller label.

    Only cells within ``reach`` rows and columns count, and none is null.  With ``shape`` instead,
    the search widens four times over until every point has an area or the whole grid was searched.
    """
    at = points.select("t", F.col("y").alias("py"), F.col("x").alias("px")).distinct()
    if reach is not None:
        best = _nearest_cells(at, areas, reach)
    else:
        reach, left, best = 4, at, None
        while True:
            found = _nearest_cells(left, areas, reach)
            # a cell beyond the square can be nearer than its corner: only what is within the reach itself is settled
            done = reach >= max(shape)
            part = found if done else found.where(F.col("d2") <= reach * reach)
            best = part if best is None else best.unionByName(part)
            left = left.join(part.select("t", "py", "px"), ["t", "py", "px"], "left_anti")
            if done or left.isEmpty():
                break
            reach *= 4
    named = best.select("t", F.col("py").alias("y"), F.col("px").alias("x"), "label", F.sqrt(F.col("d2")).alias("distance"))
    return points.join(named, ["t", "y", "x"], "left")


def _nearest_cells(at: DataFrame, areas: DataFrame, reach: int) -> DataFrame:
    """(t, py, px, d2, label) by squares of ``reach`` cells: each point meets its own square and the eight around it."""
    square = lambda c: F.floor(F.col(c) / reach).cast("int")
    near = F.array(F.lit(-1), F.lit(0), F.lit(1))
    left = at.withColumn("sy", F.explode(F.transform(near, lambda k: square("py") + k))).withColumn("sx", F.explode(F.transform(near, lambda k: square("px") + k)))
    right = areas.select("t", "y", "x", "label", square("y").alias("sy"), square("x").alias("sx"))
    pairs = left.join(right, ["t", "sy", "sx"]).where((F.abs(F.col("y") - F.col("py")) <= reach) & (F.abs(F.col("x") - F.col("px")) <= reach))
    d2 = (F.col("y") - F.col("py")) * (F.col("y") - F.col("py")) + (F.col("x") - F.col("px")) * (F.col("x") - F.col("px"))
    best = pairs.groupBy("t", "py", "px").agg(F.min(F.struct(d2.alias("d2"), "label")).alias("b"))
    return best.select("t", "py", "px", F.col("b.d2").alias("d2"), F.col("b.label").alias("label"))


def trim_rows(field: DataFrame, rows: int, south: int, north: int) -> DataFrame:
    """A field of ``rows`` rows without so many at either end."""
    return field.where(F.col("y").between(south, rows - 1 - north))


def storm_rows(rows: DataFrame, storm: Column, columns: Sequence[str]) -> DataFrame:
    """The listed columns of one storm's rows."""
    return rows.where(storm).select(*columns)


def latest_of(rows: DataFrame, key: Sequence[str], order: str) -> DataFrame:
    """The last row of each key."""
    w = W.partitionBy(*key).orderBy(F.desc(order))
    return rows.withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r")
