"""Gridded (Eulerian) statistics of tracks: one row for each cell, in the sparse long layout."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window as W, functions as F

from isobar.functions.geo import direction_from
from isobar.functions.stats import mean_circular
from isobar.operators import tiles
from isobar.operators.raster import Offset, stamp
from isobar.operators.summary import extremes, hourly, kinematics, related_events, with_shape
from isobar.sources.shared import written


def event_density(obs: DataFrame, events: DataFrame, kept: DataFrame, excluded: int = 2, kept_before: DataFrame | None = None, month_start: float | None = None, key: str = "tid") -> DataFrame:
    """gen, lys, spl, mrg per cell: first and last rows of kept tracks, and their splits and merges with kept tracks.

    ``excluded`` is the event type left out: 2 for centre tracks, 1 for system tracks.
    """
    # a row for each track, written once: it is asked for three times, and what it is made of would be sorted beside what it meets
    kept = written(kept.select(key))
    own = obs.join(kept, key, "left_semi").groupBy(key).agg(F.min(F.struct("time", "y", "x")).alias("g"), F.max(F.struct("time", "y", "x")).alias("l"))
    ends = own.select(F.explode(F.array(F.struct(F.col("g.y").alias("y"), F.col("g.x").alias("x"), F.lit("gen").alias("what")), F.struct(F.col("l.y").alias("y"), F.col("l.x").alias("x"), F.lit("lys").alias("what")))).alias("e")).select("e.*")
    other = related_events(events.where((F.col("etype") != excluded) & F.col("event").isin("sp", "mg")), kept, kept_before, month_start, key)
    rows = ends.unionByName(other.select("y", "x", F.when(F.col("event") == "sp", "spl").otherwise("mrg").alias("what")))
    return rows.groupBy("y", "x").agg(*[F.sum((F.col("what") == w).cast("int")).cast("bigint").alias(w) for w in ("gen", "lys", "spl", "mrg")])


def extreme_locations(obs: DataFrame, key: str = "tid", digits: int | None = None) -> DataFrame:
    """How often each cell is where a track has each of its extremes."""
    return extremes(obs, key, digits).groupBy("extreme", "y", "x").agg(F.count(F.lit(1)).alias("n"))


def without_last(obs: DataFrame, key: str = "tid") -> DataFrame:
    return obs.withColumn("_r", F.row_number().over(W.partitionBy(key).orderBy(F.desc("time")))).where("_r > 1").drop("_r")


def pointwise(obs: DataFrame, steps: float, key: str = "tid") -> DataFrame:
    """Counts per step and means per cell over all rows but each track's last."""
    rows = without_last(with_shape(kinematics(obs, key)), key)
    moved, sized, valid = F.col("uv").isNotNull(), F.col("radius") != 0, F.col("p_cent").isNotNull()
    total = lambda c: F.coalesce(F.sum(c), F.lit(0.0))
    number = lambda c: F.sum(c.cast("int")) / F.lit(float(steps))
    per = lambda c, cond: F.try_divide(total(c), F.sum(cond.cast("int")))
    made = rows.groupBy("y", "x").agg(
        F.countDistinct(key).alias("trkden"), number(F.lit(True)).alias("sysden"), number(valid).alias("pden"), number(moved).alias("uden"), number(F.coalesce(sized, F.lit(False))).alias("aden"),
        number(F.col("centers") > 1).alias("mccden"), per(F.col("uv"), moved).alias("uvab"), per(F.col("radius"), valid).alias("radius"), per(F.col("area").cast("double"), valid).alias("area"),
        per(F.col("depth"), F.coalesce(sized, F.lit(False))).alias("depth"), per(F.try_divide(F.col("depth"), F.nullif("radius", F.lit(0.0))), F.coalesce(sized, F.lit(False))).alias("dpdr"),
        per(F.col("dpdt"), moved).alias("dpdt"), per(F.col("p_cent"), valid).alias("pcent"), per(F.col("dsqp"), valid).alias("dsqp"),
    )
    # the direction of each track in a cell is the sum over its rows there; the cell has their circular mean
    turn = rows.where(moved).groupBy("y", "x", key).agg(F.sum(direction_from(F.col("u"), F.col("v"))).alias("d")).where("d <> 0")
    mean = turn.groupBy("y", "x").agg(mean_circular(F.collect_list("d"), 0.0, 360.0).alias("uvdi"))
    return made.join(mean, ["y", "x"], "left")


def track_density(obs: DataFrame, parts: int = 6, key: str = "tid") -> DataFrame:
    """Tracks per cell, each counted once, by hourly positions."""
    return hourly(obs, parts=parts, key=key).select(key, "y", "x").distinct().groupBy("y", "x").agg(F.count(F.lit(1)).alias("trkden"))


def smoothed_density(density: DataFrame, columns: Sequence[str], size: int, shape: tuple[int, int]) -> DataFrame:
    """Densities averaged over a box of ``size`` cells a side, edges repeated; cells that are 0 are left out."""
    return tiles.box_means(density, columns, size, shape)


def _finite_but_last(obs: DataFrame, column: str, key: str) -> DataFrame:
    """Rows with a value, then without each track's last of them."""
    return without_last(obs.where(F.col(column).isNotNull()), key)


def footprint_means(rows: DataFrame, columns: Sequence[str], offsets: Sequence[Offset], shape: tuple[int, int], steps: float) -> DataFrame:
    """Means over all rows whose footprint has the cell, and their share of the steps in percent."""
    made = tiles.footprint_means(rows.select("y", "x", *columns), columns, offsets, shape)
    return made.select("y", "x", *columns, (F.col("n") / F.lit(float(steps)) * 100).alias("pct_steps"))


def intensity_grid(obs: DataFrame, offsets: Sequence[Offset], shape: tuple[int, int], steps: float, key: str = "tid") -> DataFrame:
    """Mean pressure, depth, intensity, radius and area of the centres around each cell."""
    rows = _finite_but_last(with_shape(obs), "p_cent", key)
    return footprint_means(rows, ("p_cent", "depth", "dsqp", "radius", "area"), offsets, shape, steps)


def rate_grid(obs: DataFrame, offsets: Sequence[Offset], shape: tuple[int, int], steps: float, key: str = "tid") -> DataFrame:
    """Mean speeds, deepening, and the meridional share of the motion around each cell."""
    rows = _finite_but_last(kinematics(obs, key), "u", key)
    rows = rows.withColumn("vratio", F.when(F.col("uv") > 0, F.abs(F.col("v") / F.nullif("uv", F.lit(0.0))))).withColumn("mci", F.when(F.col("uv") > 0, F.pow(F.col("v") / F.nullif("uv", F.lit(0.0)), 2.0)))
    return footprint_means(rows, ("u", "v", "uv", "dpdt", "vratio", "mci"), offsets, shape, steps)


def environment_grid(samples: DataFrame, columns: Sequence[str], offsets: Sequence[Offset], shape: tuple[int, int]) -> DataFrame:
    """Mean of sampled environment values over the circular stamps that cover each cell; zero counts as missing."""
    made = tiles.footprint_means(samples.select("y", "x", *columns), columns, offsets, shape)
    return made.select("y", "x", *[F.nullif(F.col(c), F.lit(0.0)).alias(c) for c in columns])


def area_frequency(area_cells: DataFrame, obs: DataFrame, steps: float) -> DataFrame:
    """Share of steps in which a cell lies in the area of a tracked live centre.

    area_cells: t, y, x, area_id; obs: t, y, x, type.
    """
    seeds = obs.where(F.col("type") != 0).join(area_cells, ["t", "y", "x"]).select("t", "area_id")
    return area_cells.join(seeds, ["t", "area_id"]).groupBy("y", "x").agg((F.count(F.lit(1)) / F.lit(float(steps))).alias("share"))


def presence_composite(values: DataFrame, points: DataFrame, offsets: Sequence[Offset], shape: tuple[int, int], minimum: float | None = None) -> DataFrame:
    """Sum and mean of a variable where any centre is near, with the number of such times, and its sum over all times.

    values: t, y, x, v; points: t, y, x.  Overlapping stamps count a cell once.  With ``minimum``
    smaller values count as 0.
    """
    near = stamp(points.select("t", "y", "x"), offsets, shape).select("t", "y", "x").distinct().withColumn("near", F.lit(1))
    v = F.when(F.col("v") > minimum, F.col("v")).otherwise(0.0) if minimum is not None else F.col("v")
    joined = values.withColumn("v", v).join(near, ["t", "y", "x"], "left")
    inside = F.when(F.col("near") == 1, F.col("v"))
    return joined.groupBy("y", "x").agg(F.coalesce(F.sum(inside), F.lit(0.0)).alias("total"), F.avg(inside).alias("mean"), F.count("near").alias("times"), F.sum("v").alias("total_all"))


def signed_parts(values: DataFrame) -> DataFrame:
    """The negative and the positive part of a field, side by side."""
    return values.withColumns({"negative": F.least(F.col("v"), F.lit(0.0)), "positive": F.greatest(F.col("v"), F.lit(0.0))})
