"""Footprint sums by tiles against sums over all pairs of cells."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from isobar.operators import tiles
from isobar.operators.raster import circle


def by_hand(cells, offsets, shape, edge):
    ny, nx = shape
    out = {}
    for y in range(ny):
        for x in range(nx):
            total = 0.0
            for dy, dx, _ in offsets:
                a, b = y + dy, x + dx
                if edge == "nearest":
                    a, b = min(max(a, 0), ny - 1), min(max(b, 0), nx - 1)
                total += cells.get((a, b), 0.0)
            if total:
                out[y, x] = total
    return out


@pytest.mark.parametrize("edge", ["none", "nearest"])
@pytest.mark.parametrize(("offsets", "tile"), [(circle(3), 4), (circle(5), 64), ([(0, 0, 1.0), (0, 2, 1.0), (-3, 1, 1.0)], 5), ([(dy, dx, 1.0) for dy in range(-4, 4) for dx in range(-4, 4)], 8)])
def test_footprint_sums(spark, edge, offsets, tile):
    rng = np.random.default_rng(1)
    shape = (23, 31)
    cells = {(int(y), int(x)): float(v) for y, x, v in zip(rng.integers(0, 23, 200), rng.integers(0, 31, 200), rng.normal(1e5, 10, 200), strict=True)}
    frame = spark.createDataFrame([(y, x, v, None if y % 5 else 2) for (y, x), v in cells.items()], "y int, x int, v double, n int").repartition(3)
    got = tiles.footprint_sums(frame, ["v", "n"], offsets, shape, edge=edge, tile=tile).collect()
    want = by_hand(cells, offsets, shape, edge)
    whole = by_hand({c: 2.0 for c in cells if c[0] % 5 == 0}, offsets, shape, edge)
    assert {(r["y"], r["x"]): r["v"] for r in got} == pytest.approx(want, rel=1e-12)
    assert {(r["y"], r["x"]): r["n"] for r in got if r["n"]} == whole


def test_footprint_means_of_rows_that_share_cells(spark):
    rows = [(0, 1, 1, 2.0), (0, 1, 1, 4.0), (0, 2, 2, None), (1, 0, 0, 6.0), (1, -1, 0, 9.0), (1, 50, 0, 9.0)]
    got = tiles.footprint_means(spark.createDataFrame(rows, "t int, y int, x int, v double"), ["v"], [(0, 0, 1.0), (1, 0, 1.0)], (4, 4), ["t"]).collect()
    assert {(r["t"], r["y"], r["x"]): (r["v"], r["n"]) for r in got} == {(0, 1, 1): (3.0, 2), (0, 2, 1): (3.0, 2), (0, 2, 2): (None, 1), (0, 3, 2): (None, 1), (1, 0, 0): (6.0, 1), (1, 1, 0): (6.0, 1)}


def test_what_is_shuffled_does_not_grow_with_the_reach(spark):
    cells = spark.range(300 * 300).select((F.col("id") / 300).cast("int").alias("y"), (F.col("id") % 300).cast("int").alias("x"), F.lit(1.0).alias("v"))
    for reach in (4, 16, 60):
        made = tiles.footprint_sums(cells, ["v"], circle(reach), (300, 300))
        text = made._jdf.queryExecution().executedPlan().toString()
        assert text.count("Exchange") == 1
        # the cells and their halos: (1 + 2 reach / side) squared, and a side is at least twice the reach
        side = max(tiles.TILE, 2 * reach)
        before = cells.withColumn("ty", F.explode(F.sequence(F.floor(F.greatest(F.lit(0), F.col("y") - reach) / side), F.floor(F.least(F.lit(299), F.col("y") + reach) / side))))
        assert before.count() <= 2 * 300 * 300
        middle = made.where("y = 150 AND x = 150").first()["v"]
        assert middle == len(circle(reach))
