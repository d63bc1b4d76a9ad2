"""Plans and operators that have to hold when the tables are larger than they are guessed to be."""

from __future__ import annotations

import random
import re

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from isobar.functions.geo import haversine
from isobar.operators import raster as R
from isobar.operators.label import Contours, components, label_cells, label_grid, whole_steps
from isobar.operators.masks import _nearest_within, nearest_point


def executed(frame) -> str:
    return frame._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", ["compare_months", "ring_gradient_everywhere"])
def test_nothing_exploded_is_broadcast(spark, data, name):
    """An exploded table is guessed far too small, so a join on that guess sends it through the driver."""
    joins = executed(entry.queries()[name](spark, data)).count("BroadcastHashJoin")
    # the ends of tracks, a row for each track and no explode, may be, in each of three places
    assert joins <= (3 if name == "compare_months" else 0)


def test_ring_gradient_of_every_cell(spark):
    """The stencil gives what the join gives, also beside missing and absent cells and at the edge."""
    draw = random.Random(4)
    rows = [(t, y, x, None if draw.random() < 0.1 else draw.uniform(-5, 5)) for t in range(2) for y in range(6) for x in range(7) if draw.random() < 0.8]
    field = spark.createDataFrame(rows, "t bigint, y int, x int, v double")
    told = lambda frame: {(r["t"], r["y"], r["x"]): None if r["gradient"] is None else round(r["gradient"], 9) for r in frame.collect()}
    ring = R.ring(0, 2)
    want = {}
    known = {r[:3]: r[3] for r in rows}
    for (t, y, x), v in known.items():
        parts = [(known[t, y + dy, x + dx] - v) / w for dy, dx, w in ring if v is not None and known.get((t, y + dy, x + dx)) is not None]
        want[t, y, x] = round(sum(parts) / len(parts), 9) if parts else None
    assert told(R.ring_gradient_field(field, ring, (6, 7))) == want
    assert told(R.ring_gradient(field, field.select("t", "y", "x"), ring)) == want


def test_stencils_over_the_pressure_send_no_exploded_rows(spark, data):
    """Dealt by step once, before the smoothing; extrema over it need no further shuffle."""
    from isobar.plans.raster_queries import SHAPE, pressure

    for made in (R.extrema(pressure(spark, data), 5, shape=SHAPE), R.laplacian(pressure(spark, data), SHAPE)):
        assert executed(made).count("Exchange ") == 1


def test_pairs_of_points_and_targets_are_not_sorted(spark):
    """The one sort before the least distance is that of the points; pairs, up to a row for each target, come in its order."""
    points = spark.range(50).select("id", (F.col("id") * 1.5 - 40).alias("lat"), (F.col("id") * 7 % 360 - 180.0).alias("lon"))
    targets = spark.range(4).select(F.col("id").alias("target"), (F.col("id") * 20.0 - 30).alias("lat"), (F.col("id") * 5.0).alias("lon"))
    made = _nearest_within(points, targets, 8000.0, "id")
    plan = executed(made)
    assert plan.count("Sort ") == plan.count("BroadcastHashJoin ") == 1 and plan.index("BroadcastHashJoin ") < plan.index("Sort ")
    got = {r["id"]: r["target"] for r in nearest_point(points, targets).collect()}
    km = haversine(F.col("p.lat"), F.col("t.lat"), F.col("p.lon"), F.col("t.lon"), "km")
    every = points.alias("p").crossJoin(targets.alias("t")).groupBy("p.id").agg(F.min(F.struct(km.alias("d"), "target"))["target"].alias("target"))
    assert got == {r["id"]: r["target"] for r in every.collect()}


def test_the_laplacian_sends_cells_only_for_the_join_of_its_halves(spark, data):
    plan = executed(entry.queries()["laplacian_latlong"](spark, data))
    assert len(re.findall(r"Exchange hashpartitioning\(t#\d+L?, y#\d+, x#\d+", plan)) == 2


@pytest.mark.parametrize("name", ["event_density_grid", "event_density_smoothed"])
def test_observations_of_a_density_are_made_once_for_each_use(spark, data, name):
    """Once for the ends of tracks and once for their events; the kept tracks are read from a table."""
    plan = executed(entry.queries()[name](spark, data))
    assert len(re.findall(r"Window \[row_number", plan)) == 2


def test_a_filter_of_tracks_holds_one_measure_at_a_time(spark, data):
    """Its own plan only joins a row for each track; the rows were sorted in jobs of their own."""
    from isobar.plans.track_queries import kept_tracks

    assert "Window" not in executed(kept_tracks(spark, data))


def test_floods_against_levels_by_relaxation():
    """Cells in the order of the least possible largest value on a way from the seed, also beside missing cells."""
    draw = np.random.default_rng(3)
    for _ in range(40):
        grid = draw.normal(size=(5, 6)).round(1)
        grid[draw.random(grid.shape) < 0.1] = np.nan
        grid[2, 3] = 0.0
        level = np.full((7, 8), np.inf)
        level[3, 4] = 0.0
        for _ in range(30):
            around = np.minimum.reduce([level[:-2, 1:-1], level[2:, 1:-1], level[1:-1, :-2], level[1:-1, 2:]])
            inner = np.minimum(level[1:-1, 1:-1], np.where(np.isnan(grid), np.inf, np.maximum(around, grid)))
            level[1:-1, 1:-1] = inner
        limit = float(draw.uniform(0.1, 1.5))
        flood = Contours(grid, (2, 3), limit)
        assert np.array_equal(flood.level, np.where(inner < limit, inner, np.inf))
        assert np.all(np.diff(inner.ravel()[flood.cells]) >= 0) and len(flood.cells) == (inner < limit).sum()


def test_labels_of_many_steps_at_once():
    """As the grids one by one, whatever the order of the cells; steps are never cut."""
    rng = np.random.default_rng(1)
    for _ in range(40):
        mask = rng.random((rng.integers(1, 5), *rng.integers(1, 20, 2))) < rng.random()
        want = np.zeros(mask.shape, int)
        for step, names in zip(mask, want, strict=True):
            labels = label_grid(step)
            for n in range(1, labels.max() + 1):
                names[labels == n] = np.flatnonzero(labels == n)[0]
        t, y, x = np.nonzero(mask)
        mixed = rng.permutation(len(t))
        assert (label_cells(t[mixed], y[mixed], x[mixed], mask.shape[2]) == want[mask][mixed]).all()
    t = np.sort(rng.integers(0, 9, 100))
    for most in (1, 5, 50):
        parts = [p.column("t").to_numpy() for p in whole_steps((pa.record_batch({"t": t[a : a + 7]}) for a in range(0, 100, 7)), most)]
        assert (np.concatenate(parts) == t).all() and sum(len(set(p)) for p in parts) == len(set(t))


def test_halves_of_a_union_meet_in_a_task(spark):
    """Both halves of a grid are dealt by step already; adaptive plans read each in pieces of its own."""
    half = lambda x, wide: spark.range(20_000).groupBy((F.col("id") % 2_000).alias("t")).agg(F.max(wide).alias("s")).select("t", F.lit(0).alias("y"), (F.lit(x) + 0 * F.length("s")).alias("x"))
    small = {"shuffle.partitions": "16", "adaptive.advisoryPartitionSizeInBytes": "16k", "adaptive.coalescePartitions.minPartitionSize": "1k", "adaptive.coalescePartitions.parallelismFirst": "false"}
    before = {k: spark.conf.get(f"spark.sql.{k}") for k in small}
    try:
        for k, v in small.items():
            spark.conf.set(f"spark.sql.{k}", v)
        got = components(half(0, F.lit("")).unionByName(half(1, F.sha2(F.col("id").cast("string"), 512))), (1, 2)).groupBy("label").count().collect()
    finally:
        for k, v in before.items():
            spark.conf.set(f"spark.sql.{k}", v)
    assert [tuple(r) for r in got] == [(0, 4_000)]


def test_regions_are_dealt_by_a_key_of_their_own(spark, data):
    """A repartition by the columns of the joins below would be left out, and rain and areas of a region be shared out apart."""
    assert "Exchange hashpartitioning(xxhash64(t" in executed(entry.queries()["precip_cells"](spark, data)).split("MapInArrow share")[1].split("Union")[0]
