"""Stencils over gridded fields in the long layout (t, y, x, v).

A stencil is a short list of offsets; each cell is sent to the cells it counts for and summed
there, so the field is shuffled once, on (t, y, x), and no task holds a whole time step, unless the
field comes dealt by t: then it isn't shuffled again, and a task has all cells of its steps.  Missing
cells are null or absent.  Offsets are literals of the plan: nothing is broadcast or collected.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

Offset = tuple[int, int, float]

SOBEL_Y: tuple[Offset, ...] = tuple((dy, dx, float(dy * (2 - abs(dx)))) for dy in (-1, 1) for dx in (-1, 0, 1))
SOBEL_X: tuple[Offset, ...] = tuple((dy, dx, float(dx * (2 - abs(dy)))) for dx in (-1, 1) for dy in (-1, 0, 1))


def box(half_y: int, half_x: int | None = None) -> list[Offset]:
    half_x = half_y if half_x is None else half_x
    return [(dy, dx, 1.0) for dy in range(-half_y, half_y + 1) for dx in range(-half_x, half_x + 1)]


def circle(radius: float) -> list[Offset]:
    """Cells whose centres are within the radius, in cells."""
    n = math.ceil(radius)
    return [(dy, dx, 1.0) for dy in range(-n, n + 1) for dx in range(-n, n + 1) if math.hypot(dy, dx) <= radius]


def ring(inner: float, outer: float) -> list[Offset]:
    """Cells more than ``inner`` and at most ``outer`` away; the weight is the distance in cells."""
    n = int(outer)
    return [(dy, dx, math.hypot(dy, dx)) for dy in range(-n, n + 1) for dx in range(-n, n + 1) if inner < math.hypot(dy, dx) <= outer]


def ring_distance(y_size: float, x_size: float, radius: float) -> list[Offset]:
    """Cells within the last mean cell size before the radius; the weight is the distance in its unit."""
    n = math.ceil(radius / min(y_size, x_size))
    out = [(dy, dx, math.hypot(dy * y_size, dx * x_size)) for dy in range(-n, n + 1) for dx in range(-n, n + 1)]
    return [o for o in out if radius - (y_size + x_size) / 2 < o[2] <= radius]


def combined(first: Sequence[Offset], second: Sequence[Offset], scale: float = 1.0) -> list[Offset]:
    """One stencil with the effect of two in turn."""
    total: dict[tuple[int, int], float] = {}
    for ay, ax, a in first:
        for by, bx, b in second:
            total[ay + by, ax + bx] = total.get((ay + by, ax + bx), 0.0) + a * b * scale
    return [(dy, dx, w) for (dy, dx), w in sorted(total.items()) if w]


def _literal(offsets: Sequence[Offset]) -> Column:
    return F.array(*[F.struct(F.lit(dy).alias("dy"), F.lit(dx).alias("dx"), F.lit(float(w)).alias("w")) for dy, dx, w in offsets])


def neighbours(field: DataFrame, offsets: Sequence[Offset], shape: tuple[int, int] | None = None, edge_y: str = "none", edge_x: str = "none") -> DataFrame:
    """(t, y, x, v, w): for each cell, the values of the cells at its offsets.

    ``edge`` is what lies beyond the grid: none, wrap, nearest (the edge cell again) or reflect
    (the edge cell and on inwards); all but none need ``shape``.
    """
    if edge_y == edge_x == "none":
        moved = field.select("t", "y", "x", "v", F.explode(_literal(offsets)).alias("o"))
        out = moved.select("t", (F.col("y") - F.col("o.dy")).alias("y"), (F.col("x") - F.col("o.dx")).alias("x"), "v", F.col("o.w").alias("w"))
        return out.where((F.col("y") >= 0) & (F.col("y") < shape[0]) & (F.col("x") >= 0) & (F.col("x") < shape[1])) if shape else out
    # beyond the edge a cell counts several times: list, for each place a cell can be seen from, the cells that see it
    sizes = dict(zip("yx", shape, strict=True))
    extent = {"y": max(abs(o[0]) for o in offsets), "x": max(abs(o[1]) for o in offsets)}

    def places(axis: str, mode: str) -> Column:
        """Positions, also beyond the grid, at which a cell of this index is found."""
        n, k, at = sizes[axis], extent[axis], F.col(axis)
        if mode == "none":
            return F.array(at)
        folded = {
            "wrap": lambda p: F.pmod(p, F.lit(n)),
            "nearest": lambda p: F.greatest(F.lit(0), F.least(F.lit(n - 1), p)),
            "reflect": lambda p: (lambda q: F.when(q < n, q).otherwise(2 * n - 1 - q))(F.pmod(p, F.lit(2 * n))),
        }[mode]
        inner = F.array(at)
        rim = F.array(*[F.lit(p) for p in [*range(-k, 0), *range(n, n + k)]]) if k else F.array().cast("array<int>")
        return F.concat(inner, F.filter(rim, lambda p: folded(p) == at))

    seen = field.select("t", "v", F.explode(places("y", edge_y)).alias("y"), "x").select("t", "v", "y", F.explode(places("x", edge_x)).alias("x"))
    return neighbours(seen, offsets, shape)


def stencil_sum(field: DataFrame, offsets: Sequence[Offset], out: str = "v", complete: bool = False, **edges) -> DataFrame:
    """Weighted sum over the offsets; with ``complete`` null unless every cell of the stencil has a value."""
    total = F.sum(F.col("v") * F.col("w"))
    made = neighbours(field, offsets, **edges).groupBy("t", "y", "x").agg(total.alias(out), F.count("v").alias("n"))
    return made.select("t", "y", "x", (F.when(F.col("n") == len(offsets), F.col(out)) if complete else F.col(out)).alias(out))


STYLES = {
    "mean": F.avg, "average": F.avg, "sum": F.sum, "total": F.sum, "median": F.median, "max": F.max, "maximum": F.max,
    "min": F.min, "minimum": F.min, "std": F.stddev_pop, "sd": F.stddev_pop, "stdev": F.stddev_pop, "stddev": F.stddev_pop, "standard deviation": F.stddev_pop,
}


def filter_field(field: DataFrame, half: int | tuple[int, int], shape: tuple[int, int], style: str = "mean", missing_edge: bool = False) -> DataFrame:
    """Box filter of a half-width, over the values that are there.

    With ``missing_edge`` a cell is null if its box leaves the grid or has a missing value.  A
    deviation has no form that leaves missing values out.
    """
    if style.lower() not in STYLES:
        raise ValueError(f"unknown style {style!r}; one of {', '.join(STYLES)}")
    if style.lower() in ("std", "sd", "stdev", "stddev", "standard deviation") and not missing_edge:
        raise ValueError("a deviation can't leave missing values out")
    offsets = box(*(half if isinstance(half, tuple) else (half, half)))
    made = neighbours(field, offsets, shape).groupBy("t", "y", "x").agg(STYLES[style.lower()](F.col("v")).alias("v"), F.count("v").alias("n"))
    return made.select("t", "y", "x", (F.when(F.col("n") == len(offsets), F.col("v")) if missing_edge else F.col("v")).alias("v"))


def uniform_filter(field: DataFrame, size: int, shape: tuple[int, int]) -> DataFrame:
    """Mean over a box of ``size`` cells a side, edges repeated; an even size reaches one further down than up."""
    down = size // 2
    offsets = [(dy, dx, 1.0) for dy in range(-down, size - down) for dx in range(-down, size - down)]
    made = neighbours(field, offsets, shape, "nearest", "nearest").groupBy("t", "y", "x").agg((F.sum("v") / len(offsets)).alias("v"))
    return made


def footprint_sum(field: DataFrame, offsets: Sequence[Offset], shape: tuple[int, int]) -> DataFrame:
    """Sum over a footprint, edges repeated, missing values left out (0 where all are missing)."""
    return neighbours(field, offsets, shape, "nearest", "nearest").groupBy("t", "y", "x").agg(F.coalesce(F.sum("v"), F.lit(0.0)).alias("v"))


def gaussian_filter(field: DataFrame, sigma: float, shape: tuple[int, int], reach: float = 4.0) -> DataFrame:
    """Gaussian smoothing on a torus, one axis after the other, cut at ``reach`` deviations."""
    k = int(reach * sigma + 0.5)
    raw = [math.exp(-0.5 * (i / sigma) ** 2) for i in range(-k, k + 1)]
    weights = [w / sum(raw) for w in raw]
    for axis in (0, 1):
        n = shape[axis]
        folded: dict[int, float] = {}
        for i, w in zip(range(-k, k + 1), weights, strict=True):
            folded[i % n] = folded.get(i % n, 0.0) + w
        offsets = [(i, 0, w) if axis == 0 else (0, i, w) for i, w in folded.items()]
        moved = field.select("t", "y", "x", "v", F.explode(_literal(offsets)).alias("o"))
        y, x = (F.pmod(F.col("y") - F.col("o.dy"), F.lit(shape[0])), F.pmod(F.col("x") - F.col("o.dx"), F.lit(shape[1])))
        field = moved.select("t", y.alias("y"), x.alias("x"), (F.col("v") * F.col("o.w")).alias("v")).groupBy("t", "y", "x").agg(F.sum("v").alias("v"))
    return field


def extrema(field: DataFrame, size: int = 3, missing_share: float = 1.0, largest: bool = False, shape: tuple[int, int] | None = None) -> DataFrame:
    """Cells equal to the least (or largest) value of their square neighbourhood.

    The grid is reflected at its edge; of the box, less than ``missing_share`` may be missing;
    plateaus give several cells.  ``mask`` marks cells to leave out, if the field has that column.
    """
    half = size // 2
    offsets = box(half)
    masked = F.col("mask") if "mask" in field.columns else F.col("v").isNull()
    cells = field.select("t", "y", "x", "v", masked.alias("gone"))
    packed = cells.select("t", "y", "x", F.struct("v", "gone").alias("v"))
    edge = {"shape": shape, "edge_y": "reflect", "edge_x": "reflect"} if shape else {"shape": None}
    best = (F.max if largest else F.min)(F.col("v.v"))
    # the own cell is the one with offset 0: its weight is marked
    marked = [(dy, dx, 2.0 if (dy, dx) == (0, 0) else 1.0) for dy, dx, _ in offsets]
    around = neighbours(packed, marked, **edge)
    own = F.col("w") == 2.0
    made = around.groupBy("t", "y", "x").agg(
        best.alias("best"), F.max(F.when(own, F.col("v.v"))).alias("v"), F.max(F.when(own, F.col("v.gone"))).alias("gone"),
        (F.sum(F.col("v.gone").cast("int")) / len(offsets)).alias("share"),
    )
    return made.where((F.col("v") == F.col("best")) & ~F.col("gone") & (F.col("share") < missing_share)).select("t", "y", "x", "v")


def gradient_xy(field: DataFrame, shape: tuple[int, int]) -> DataFrame:
    """Sobel gradient (gy, gx, magnitude) per cell; null next to a missing value or the edge."""
    offsets = [(dy, dx, 0.0) for dy in (-1, 0, 1) for dx in (-1, 0, 1)]
    index = {(dy, dx): i for i, (dy, dx, _) in enumerate(offsets)}
    numbered = [(dy, dx, float(i)) for (dy, dx), i in index.items()]
    wy, wx = ({index[dy, dx]: w / 8 for dy, dx, w in s} for s in (SOBEL_Y, SOBEL_X))
    pick = lambda weights: F.sum(F.col("v") * F.element_at(F.array(*[F.lit(weights.get(i, 0.0)) for i in range(9)]), F.col("w").cast("int") + 1))
    made = neighbours(field, numbered, shape).groupBy("t", "y", "x").agg(pick(wy).alias("gy"), pick(wx).alias("gx"), F.count("v").alias("n"))
    full = F.col("n") == 9
    gy, gx = F.when(full, -F.col("gy")), F.when(full, F.col("gx"))
    return made.select("t", "y", "x", gy.alias("gy"), gx.alias("gx"), F.sqrt(gy * gy + gx * gx).alias("magnitude"))


def laplacian_offsets() -> list[Offset]:
    """Sobel of Sobel over 64, both axes together: the Laplacian as one five-by-five stencil."""
    both: dict[tuple[int, int], float] = {}
    for part in (SOBEL_Y, SOBEL_X):
        for dy, dx, w in combined(part, part, 1 / 64):
            both[dy, dx] = both.get((dy, dx), 0.0) + w
    # cells of weight 0 stay, so that a missing value anywhere in the window is seen
    return [(dy, dx, both.get((dy, dx), 0.0)) for dy in range(-2, 3) for dx in range(-2, 3)]


def laplacian(field: DataFrame, shape: tuple[int, int], multiplier: float = 1.0) -> DataFrame:
    """Divergence of the Sobel gradient; null within two cells of the edge or of a missing value."""
    offsets = [(dy, dx, w * multiplier) for dy, dx, w in laplacian_offsets()]
    return stencil_sum(field, offsets, complete=True, shape=shape)


def slope_latlong(field: DataFrame, grid: DataFrame, shape: tuple[int, int], wrap_x: bool = False) -> DataFrame:
    """Sobel gradient per kilometre on a latitude-longitude grid (gy northwards, gx eastwards, magnitude).

    ``grid`` has y, x, lat, lon.  The cell size is the great-circle distance between a cell's
    neighbours, halved; cells nearer than 0.05 degrees to a pole get 0, edges null, unless ``wrap_x``
    joins the left and right edge.
    """
    from isobar.functions.geo import haversine

    offsets = [(dy, dx, float(3 * (dy + 1) + dx + 1)) for dy in (-1, 0, 1) for dx in (-1, 0, 1)]
    cells = grid.join(field, ["y", "x"]).select("t", "y", "x", F.struct("v", "lat", "lon").alias("v"))
    around = neighbours(cells, offsets, shape, "none", "wrap" if wrap_x else "none")
    at = lambda dy, dx, f: F.max(F.when(F.col("w") == 3 * (dy + 1) + dx + 1, F.col(f"v.{f}")))
    sums = {name: sum((F.sum(F.when(F.col("w") == 3 * (dy + 1) + dx + 1, F.col("v.v") * w)) for dy, dx, w in part[1:]), F.sum(F.when(F.col("w") == 3 * (part[0][0] + 1) + part[0][1] + 1, F.col("v.v") * part[0][2]))) for name, part in (("sy", SOBEL_Y), ("sx", SOBEL_X))}
    made = around.groupBy("t", "y", "x").agg(
        sums["sy"].alias("sy"), sums["sx"].alias("sx"), F.count("v.v").alias("n"), at(0, 0, "lat").alias("lat"),
        at(-1, 0, "lat").alias("lat_a"), at(1, 0, "lat").alias("lat_b"), at(-1, 0, "lon").alias("lon_a"), at(1, 0, "lon").alias("lon_b"),
        at(0, -1, "lat").alias("lat_l"), at(0, 1, "lat").alias("lat_r"), at(0, -1, "lon").alias("lon_l"), at(0, 1, "lon").alias("lon_r"),
    )
    c = F.col
    dy = haversine(c("lat_a"), c("lat_b"), c("lon_a"), c("lon_b"), "km") / 2
    dx = haversine(c("lat_l"), c("lat_r"), c("lon_l"), c("lon_r"), "km") / 2
    pole, full = F.abs(c("lat")) > 89.95, c("n") == 9
    # rows can run north or south: the sign of the latitude step decides
    north = F.signum(c("lat_b") - c("lat_a"))
    gy = F.when(full, F.when(pole, 0.0).otherwise(F.try_divide(c("sy") * north, 4 * 2 * dy)))
    gx = F.when(full, F.when(pole, 0.0).otherwise(F.try_divide(c("sx"), 4 * 2 * dx)))
    return made.select("t", "y", "x", gy.alias("gy"), gx.alias("gx"), F.sqrt(gy * gy + gx * gx).alias("magnitude"))


def laplacian_latlong(field: DataFrame, grid: DataFrame, shape: tuple[int, int], wrap_x: bool = False) -> DataFrame:
    """Divergence of :func:`slope_latlong`."""
    first = slope_latlong(field, grid, shape, wrap_x)
    across = slope_latlong(first.select("t", "y", "x", F.col("gx").alias("v")), grid, shape, wrap_x)
    along = slope_latlong(first.select("t", "y", "x", F.col("gy").alias("v")), grid, shape, wrap_x)
    both = across.select("t", "y", "x", "gx").join(along.select("t", "y", "x", "gy"), ["t", "y", "x"])
    return both.select("t", "y", "x", (F.col("gx") + F.col("gy")).alias("v"))


def ring_gradient(field: DataFrame, centers: DataFrame, offsets: Sequence[Offset]) -> DataFrame:
    """``centers`` (t, y, x, ...) with ``gradient``: mean of (neighbour - centre) / distance over the ring's values."""
    # offset 0 brings the centre's own value; the field is never broadcast, as its size is guessed too small
    at = centers.select("t", F.col("y").alias("cy"), F.col("x").alias("cx"), F.explode(_literal([(0, 0, 0.0), *offsets])).alias("o"))
    at = at.select("t", "cy", "cx", (F.col("cy") + F.col("o.dy")).alias("y"), (F.col("cx") + F.col("o.dx")).alias("x"), F.col("o.w").alias("w"))
    values = at.join(field.select("t", "y", "x", "v").hint("merge"), ["t", "y", "x"])
    made = values.groupBy("t", "cy", "cx").agg(*_slope(F.col("w"))).select("t", F.col("cy").alias("y"), F.col("cx").alias("x"), _gradient())
    return centers.join(made.hint("merge"), ["t", "y", "x"], "left")


def ring_gradient_field(field: DataFrame, offsets: Sequence[Offset], shape: tuple[int, int]) -> DataFrame:
    """(t, y, x, gradient) as :func:`ring_gradient` has it for every cell of the field: one shuffle of partial sums and no join."""
    around = neighbours(field, [(0, 0, 0.0), *offsets], shape)
    made = around.groupBy("t", "y", "x").agg(*_slope(F.col("w")), F.count(F.when(F.col("w") == 0, 1)).alias("there"))
    return made.where("there > 0").select("t", "y", "x", _gradient())


def _slope(w: Column) -> list[Column]:
    """Partial sums of a ring gradient; the own value has distance 0."""
    known = (w > 0) & F.col("v").isNotNull()
    return [F.max(F.when(w == 0, F.col("v"))).alias("v0"), F.sum(F.when(known, F.col("v") / w)).alias("sv"), F.sum(F.when(known, 1 / w)).alias("sw"), F.count(F.when(known, 1)).alias("n")]


def _gradient() -> Column:
    return F.when(F.col("n") > 0, (F.col("sv") - F.col("v0") * F.col("sw")) / F.col("n")).alias("gradient")


def find_centers(field: DataFrame, shape: tuple[int, int], size: int = 3, missing_share: float = 0.5, least_gradient: float = 0.0, offsets: Sequence[Offset] | None = None) -> DataFrame:
    """Minima steep enough, with ``id`` numbered in row order within each time step, ``gradient`` and ``dsqp`` (Laplacian).

    A minimum whose gradient can't be computed stays.
    """
    from pyspark.sql import Window as W

    found = ring_gradient(field, extrema(field, size, missing_share, shape=shape), offsets or ring(0, 2))
    kept = found.where(F.col("gradient").isNull() | (F.col("gradient") >= least_gradient))
    curved = laplacian(field, shape).withColumnRenamed("v", "dsqp")
    number = F.row_number().over(W.partitionBy("t").orderBy("y", "x")) - 1
    return kept.join(curved, ["t", "y", "x"], "left").withColumn("id", number.cast("int"))


def stamp(points: DataFrame, offsets: Sequence[Offset], shape: tuple[int, int]) -> DataFrame:
    """Each point row once for every cell of the stamp around it, inside the grid; y and x are the cell's."""
    moved = points.withColumn("o", F.explode(_literal(offsets)))
    out = moved.withColumn("y", F.col("y") + F.col("o.dy")).withColumn("x", F.col("x") + F.col("o.dx")).withColumn("w", F.col("o.w")).drop("o")
    return out.where((F.col("y") >= 0) & (F.col("y") < shape[0]) & (F.col("x") >= 0) & (F.col("x") < shape[1]))


def discretise(v: Column, breaks: Sequence[float]) -> Column:
    """Bin 1, 2, ... of a value: closed below, open above, the last closed on both sides; null outside."""
    last = len(breaks) - 1
    out = F.when((v >= breaks[last - 1]) & (v <= breaks[last]), last)
    for b in range(last - 1, 0, -1):
        out = F.when((v >= breaks[b - 1]) & (v < breaks[b]), b).otherwise(out)
    return out


def bilinear_weights(src_y: Sequence[float], src_x: Sequence[float], dst: Sequence[tuple[int, int, float, float]], periodic: float | None = None) -> list[tuple[int, int, int, int, float]]:
    """(dst_y, dst_x, src_y, src_x, weight) of a regular source grid; target cells outside it have none.

    ``dst`` lists (row, column, coordinate y, coordinate x).  ``periodic`` is the x period.  The list
    is a small table to be stored once and joined.
    """
    import bisect

    out = []
    for row, col, y, x in dst:
        ways = []
        for value, axis, period in ((y, src_y, None), (x, src_x, periodic)):
            rising = list(axis) if axis[0] < axis[-1] else list(axis)[::-1]
            flip = (lambda i, n=len(axis), up=axis[0] < axis[-1]: i if up else n - 1 - i)
            if period:
                value = (value - rising[0]) % period + rising[0]
                rising = [*rising, rising[0] + period]
            if not rising[0] <= value <= rising[-1]:
                ways = []
                break
            i = min(max(bisect.bisect_right(rising, value) - 1, 0), len(rising) - 2)
            part = (value - rising[i]) / (rising[i + 1] - rising[i])
            ways.append([(flip(i % len(axis)), 1 - part), (flip((i + 1) % len(axis)), part)])
        for sy, wy in ways[0] if len(ways) == 2 else []:
            out += [(row, col, sy, sx, wy * wx) for sx, wx in ways[1] if wy * wx > 0]
    return out


def nearest_weights(src_y: Sequence[float], src_x: Sequence[float], dst: Sequence[tuple[int, int, float, float]], periodic: float | None = None) -> list[tuple[int, int, int, int, float]]:
    """As :func:`bilinear_weights`, with the whole weight on the nearest cell of each axis, the first on ties; cells outside get the edge."""

    def place(value: float, axis: Sequence[float], period: float | None) -> int:
        away = [abs((value - a + period / 2) % period - period / 2) if period else abs(value - a) for a in axis]
        return away.index(min(away))

    rows = {y: place(y, src_y, None) for y in {d[2] for d in dst}}
    cols = {x: place(x, src_x, periodic) for x in {d[3] for d in dst}}
    return [(row, col, rows[y], cols[x], 1.0) for row, col, y, x in dst]


def regrid(field: DataFrame, weights: DataFrame) -> DataFrame:
    """The field on another grid by sparse weights (dst_y, dst_x, src_y, src_x, w); null where a source cell is missing."""
    joined = field.withColumnsRenamed({"y": "src_y", "x": "src_x"}).join(weights, ["src_y", "src_x"])
    made = joined.groupBy("t", "dst_y", "dst_x").agg(F.sum(F.col("v") * F.col("w")).alias("v"), (F.count("v") == F.count("w")).alias("whole"))
    return made.select("t", F.col("dst_y").alias("y"), F.col("dst_x").alias("x"), F.when(F.col("whole"), F.col("v")).alias("v"))


def nearest_index(value: Column, start: float, step: float, count: int) -> Column:
    """Index of the nearest point of a regular axis; halfway goes to the first."""
    place = (value - start) / step
    return F.greatest(F.lit(0), F.least(F.lit(count - 1), F.ceil(place - 0.5))).cast("int")
