"""Precipitation of storms: contiguous rain given to the centres whose areas or disks it meets.

Which region meets which centre is a join of cells: the cells of a centre's area and of a disk around
it against the cells of the rain.  A region that one centre alone meets is that centre's.  Cells of contested
regions go to the nearest area, region by region: both sides are packed into boxes, and a pair of boxes
is only looked at while it can hold something nearer than what is known.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from isobar.operators.label import components, dealt, whole_steps

#: Points of a box.
LEAF = 32
#: Great-circle distances (km) are compared at a millimetre, so that ties are ties in any arithmetic.
DIGITS = 6


def regions(precip: DataFrame, minimum: Column | float, shape: tuple[int, int]) -> DataFrame:
    """(t, y, x, total, region): cells with ``large`` of at least ``minimum``, a number or a column of ``precip``; missing counts as 0."""
    zero = lambda c: F.when(F.col(c).isNull() | F.isnan(c), 0.0).otherwise(F.col(c))
    wet = precip.select("t", "y", "x", zero("total").alias("total"), (zero("large") >= minimum).alias("wet")).where("wet").drop("wet")
    return components(wet, shape).withColumnRenamed("label", "region").join(wet, ["t", "y", "x"])


def disks(centers: DataFrame, grid: DataFrame, radius: float, shape: tuple[int, int], kernel: tuple[str, str] = ("y", "x")) -> DataFrame:
    """(t, id, y, x): cells within ``radius`` metres of each centre, by the cell size (``grid``: y, x, y_size, x_size) at its ``kernel`` cell."""
    ky, kx = kernel
    sized = centers.join(grid.select(F.col("y").alias("ky"), F.col("x").alias("kx"), "y_size", "x_size"), (centers[ky] == F.col("ky")) & (centers[kx] == F.col("kx")))
    across = F.ceil(F.lit(radius) / F.least("y_size", "x_size")).cast("int")
    sized = sized.select("t", "id", "y", "x", "y_size", "x_size", across.alias("k"))
    offset = lambda: F.explode(F.sequence(-F.col("k"), F.col("k")))
    around = sized.withColumn("dy", offset()).withColumn("dx", offset())
    inside = F.sqrt(F.pow(F.col("dx") * F.col("x_size"), 2) + F.pow(F.col("dy") * F.col("y_size"), 2)) <= radius
    cells = around.where(inside).select("t", "id", (F.col("y") + F.col("dy")).alias("y"), (F.col("x") + F.col("dx")).alias("x"))
    return cells.where((F.col("y") >= 0) & (F.col("y") < shape[0]) & (F.col("x") >= 0) & (F.col("x") < shape[1]))


def boxes(points: np.ndarray) -> list[np.ndarray]:
    """Indices of the points in boxes of at most LEAF, by halving the longest side."""
    out, open_ = [], [np.arange(len(points))]
    while open_:
        own = open_.pop()
        if len(own) <= LEAF:
            out.append(own)
            continue
        side = int(np.ptp(points[own], axis=0).argmax())
        order = own[np.argsort(points[own, side], kind="stable")]
        open_ += [order[: len(order) // 2], order[len(order) // 2 :]]
    return out


def nearest_owner(points: np.ndarray, seats: np.ndarray, owner: np.ndarray, sphere: bool) -> np.ndarray:
    """The owner of the seat nearest to each point, the smallest on ties.

    Coordinates are rows and columns, or unit vectors if ``sphere``: chords grow with great-circle distances.
    """
    order = np.argsort(owner, kind="stable")
    seats, owner = seats[order], owner[order]
    held = [np.sort(b) for b in boxes(seats)]
    low, high = (np.array([f(seats[b], axis=0) for b in held]) for f in (np.min, np.max))
    out = np.zeros(len(points), owner.dtype)
    for block in boxes(points):
        own = points[block]
        gap = np.maximum(0, np.maximum(low - own.max(0), own.min(0) - high))
        bound = np.sqrt((gap**2).sum(1))
        best, name = np.full(len(block), np.inf), np.zeros(len(block), owner.dtype)
        for leaf in np.argsort(bound, kind="stable"):
            if bound[leaf] > best.max() + 1e-9:
                break
            away = np.sqrt(((own[:, None, :] - seats[held[leaf]][None]) ** 2).sum(2))
            at = _told(away, sphere).argmin(1)
            near, who = away[np.arange(len(block)), at], owner[held[leaf]][at]
            told, known = _told(near, sphere), _told(best, sphere)
            better = (told < known) | ((told == known) & (who < name))
            best, name = np.where(better, near, best), np.where(better, who, name)
        out[block] = name
    return out


def _told(away: np.ndarray, sphere: bool) -> np.ndarray:
    if not sphere:
        return away
    return np.round(2 * 6371.0 * np.arcsin(np.minimum(away / 2, 1.0)), DIGITS)


def attribute(precip: DataFrame, areas: DataFrame, centers: DataFrame, grid: DataFrame, shape: tuple[int, int], minimum: Column | float, radius: float, sphere: bool = False) -> DataFrame:
    """(t, y, x, total, id): the cells of rain that a primary centre has.

    precip: t, y, x, large, total; areas: t, y, x, area_id, contiguous areas; centers: t, id, y, x, type and
    parent (a secondary's primary); grid: y, x, lat, lon, y_size, x_size in metres.  A region, contiguous cells with large >= minimum,
    meets a primary by its area's cells or those within ``radius`` of the centre, or of one of its
    secondaries, there by the primary's cell size.  A region that several meet is shared out by the
    nearest area, in cells or by great circle if ``sphere``, ties to the first centre; a centre outside of any
    area has its own cell.  What meets none isn't given to any.
    """
    first = centers.where("type = 1").select("t", "id", "y", "x")
    second = centers.where("type = 2").select("t", F.col("parent").alias("id"), "y", "x")
    placed = first.join(areas, ["t", "y", "x"], "left").select("t", "id", "y", "x", "area_id")
    seats = placed.where("area_id IS NOT NULL").select("t", "id", "area_id").join(areas, ["t", "area_id"]).select("t", "id", "y", "x").unionByName(placed.where("area_id IS NULL").drop("area_id"))
    by_primary = second.join(first.select("t", "id", F.col("y").alias("py"), F.col("x").alias("px")), ["t", "id"])
    reach = seats.unionByName(disks(first, grid, radius, shape)).unionByName(disks(by_primary, grid, radius, shape, ("py", "px")))
    rain = regions(precip, minimum, shape)
    meets = rain.select("t", "y", "x", "region").join(reach, ["t", "y", "x"]).select("t", "region", "id").distinct()
    count = meets.groupBy("t", "region").agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("id"))
    met = rain.join(count, ["t", "region"])
    alone = met.where("n = 1").select("t", "y", "x", "total", "id")
    spots = lambda frame: frame.join(grid.select("y", "x", "lat", "lon"), ["y", "x"])
    cells = spots(met.where("n > 1").select("t", "region", "y", "x", "total"))
    sides = spots(meets.join(count.where("n > 1").select("t", "region"), ["t", "region"]).join(seats, ["t", "id"]))
    # both sides of a region in one run of rows: a task goes through the regions of its steps without a call of Spark's for each
    rows = lambda frame, **fill: frame.select("t", F.col("region").cast("int").alias("region"), "y", "x", "lat", "lon", *[(fill[n] if n in fill else F.col(n)).cast(kind).alias(n) for n, kind in (("total", "double"), ("id", "int"))])
    both = rows(cells, id=F.lit(None)).unionByName(rows(sides, total=F.lit(None)).withColumn("seat", F.lit(True)), allowMissingColumns=True)
    schema = pa.schema([("t", pa.int64()), ("y", pa.int32()), ("x", pa.int32()), ("total", pa.float64()), ("id", pa.int32())])

    def share(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in whole_steps(batches):
            held = {c: part.column(c).to_numpy() for c in ("t", "region", "y", "x", "lat", "lon", "total")}
            seat, owner = part.column("seat").is_valid().to_numpy(), part.column("id").fill_null(0).to_numpy()
            places = _spots(held, sphere)
            cuts = np.flatnonzero(np.diff(held["t"]) | np.diff(held["region"])) + 1
            given = np.zeros(len(seat), np.int32)
            for a, b in zip([0, *cuts.tolist()], [*cuts.tolist(), len(seat)], strict=True):
                own = seat[a:b]
                if own.any() and not own.all():
                    given[a:b][~own] = nearest_owner(places[a:b][~own], places[a:b][own], owner[a:b][own], sphere)
            wet = np.flatnonzero(~seat)
            yield pa.RecordBatch.from_arrays([pa.array(held[c][wet]).cast(schema.field(c).type) for c in ("t", "y", "x", "total")] + [pa.array(given[wet])], schema=schema)

    contested = dealt(both, "t", "region").sortWithinPartitions("t", "region").mapInArrow(share, "t bigint, y int, x int, total double, id int")
    return alone.unionByName(contested)


def _spots(held: dict[str, np.ndarray], sphere: bool) -> np.ndarray:
    if not sphere:
        return np.column_stack([held["y"], held["x"]]).astype(float)
    lat, lon = np.radians(held["lat"]), np.radians(held["lon"])
    return np.column_stack([np.cos(lat) * np.cos(lon), np.cos(lat) * np.sin(lon), np.sin(lat)])


def totals(given: DataFrame, centers: DataFrame, handed_on: bool = False) -> DataFrame:
    """``centers`` with precip and precip_area (cells), 0 without any; secondaries have 0, or what their primary has if ``handed_on``."""
    sums = given.groupBy("t", "id").agg(F.sum("total").alias("precip"), F.count(F.lit(1)).alias("precip_area"))
    of = F.when(F.col("type") == 2, F.col("parent") if handed_on else F.lit(None)).otherwise(F.col("id"))
    named = centers.withColumn("_of", of)
    joined = named.join(sums.select(F.col("t").alias("_t"), F.col("id").alias("_id"), "precip", "precip_area"), (named["t"] == F.col("_t")) & (named["_of"] == F.col("_id")), "left")
    return joined.withColumns({"precip": F.coalesce("precip", F.lit(0.0)), "precip_area": F.coalesce("precip_area", F.lit(0)).cast("bigint")}).drop("_of", "_t", "_id")


def lowest_centers(areas: DataFrame, field: DataFrame, most: int = 2, least: int = 6) -> DataFrame:
    """(t, id, y, x, type, parent) of areas (t, y, x, area_id): the lowest cell of each is its primary; areas of ``least`` cells have the next ones, up to ``most``, as secondaries.

    Ids count the centres of a step in row order from 0.
    """
    cells = areas.join(field, ["t", "y", "x"])
    w = W.partitionBy("t", "area_id")
    ranked = cells.withColumn("rank", F.row_number().over(w.orderBy("v", "y", "x"))).withColumn("size", F.count(F.lit(1)).over(w))
    kept = ranked.where((F.col("rank") == 1) | ((F.col("rank") <= most) & (F.col("size") >= least)))
    named = kept.withColumn("id", (F.row_number().over(W.partitionBy("t").orderBy("y", "x")) - 1).cast("int"))
    heads = F.min(F.when(F.col("rank") == 1, F.col("id"))).over(w)
    return named.select("t", "id", "y", "x", F.when(F.col("rank") == 1, 1).otherwise(2).alias("type"), heads.alias("parent"))
