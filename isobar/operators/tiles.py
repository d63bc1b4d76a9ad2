"""Footprint sums over wide neighbourhoods, by tiles with halos.

A cell goes to its tile and to those neighbours whose halo it is in, at most four for tiles of twice the
reach: what is shuffled doesn't grow with the footprint.  Inside a tile each row of the footprint is a difference of
two running sums, so the work grows with the footprint's rows and not with its cells.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

#: Least side of a tile, in cells.
TILE = 64
Offset = tuple[int, int, float]


def spans(offsets: Sequence[Offset]) -> list[tuple[int, int, int]]:
    """(dy, first dx, last dx) of the unbroken rows of a footprint; weights don't count."""
    out: list[tuple[int, int, int]] = []
    for dy, dx in sorted({(o[0], o[1]) for o in offsets}):
        if out and out[-1][0] == dy and out[-1][2] == dx - 1:
            out[-1] = (dy, out[-1][1], dx)
        else:
            out.append((dy, dx, dx))
    return out


def _summed(plane: np.ndarray, rows: list[tuple[int, int, int]], ry: int, rx: int, height: int, width: int) -> np.ndarray:
    # about the mean, so that differences of running sums stay small; whole numbers need no such care
    mean = 0.0 if _exact(plane) else plane.mean()
    held = np.zeros((plane.shape[0], plane.shape[1] + 1))
    np.cumsum(plane - mean, axis=1, out=held[:, 1:])
    out = np.zeros((height, width))
    for dy, first, last in rows:
        line = held[ry + dy : ry + dy + height]
        out += line[:, rx + last + 1 : rx + last + 1 + width] - line[:, rx + first : rx + first + width] + mean * (last - first + 1)
    return out


def _exact(values: np.ndarray) -> bool:
    return bool((values == np.round(values)).all() and np.abs(values).sum() < 2**52)


def footprint_sums(cells: DataFrame, columns: Sequence[str], offsets: Sequence[Offset], shape: tuple[int, int], keys: Sequence[str] = (), edge: str = "none", tile: int = TILE) -> DataFrame:
    """keys, y, x and the sums of ``columns`` over the cells at the offsets, for cells with a sum that isn't 0.

    cells: keys, y, x (each once, in the grid) and numbers; absent and missing ones count as 0.  Beyond the grid is
    nothing, or the edge cell again if ``edge`` is "nearest".  Whole numbers are summed exactly.
    """
    ny, nx = shape
    ry, rx = (max(abs(o[i]) for o in offsets) for i in (0, 1))
    sy, sx = max(tile, 2 * ry), max(tile, 2 * rx)
    rows = spans(offsets)

    def held(at: str, reach: int, side: int, n: int) -> Column:
        first, last = F.greatest(F.lit(0), F.col(at) - reach), F.least(F.lit(n - 1), F.col(at) + reach)
        return F.explode(F.sequence(F.floor(first / side).cast("int"), F.floor(last / side).cast("int")))

    placed = cells.select(*keys, F.col("y").cast("int"), F.col("x").cast("int"), *[F.col(c).cast("double") for c in columns])
    placed = placed.withColumn("ty", held("y", ry, sy, ny)).withColumn("tx", held("x", rx, sx, nx))
    schema = ", ".join([*(f"`{k}` {cells.schema[k].dataType.simpleString()}" for k in keys), "y int", "x int", *(f"`{c}` double" for c in columns)])

    def run(key: tuple, group: pd.DataFrame) -> pd.DataFrame:
        y0, x0 = key[-2] * sy, key[-1] * sx
        height, width = min(sy, ny - y0), min(sx, nx - x0)
        top, left, bottom, right = max(0, y0 - ry), max(0, x0 - rx), min(ny, y0 + height + ry), min(nx, x0 + width + rx)
        margin = ((top - (y0 - ry), y0 + height + ry - bottom), (left - (x0 - rx), x0 + width + rx - right))
        y, x = group["y"].to_numpy() - top, group["x"].to_numpy() - left
        rim = lambda plane: np.pad(plane, margin, mode="edge") if edge == "nearest" else np.pad(plane, margin)
        sums = []
        for c in columns:
            plane = np.zeros((bottom - top, right - left))
            plane[y, x] = group[c].fillna(0.0)
            out = _summed(rim(plane), rows, ry, rx, height, width)
            # where no value is near the sum is 0, and not what running sums leave over
            sums.append(np.where(_summed(rim((plane != 0).astype(float)), rows, ry, rx, height, width) > 0, out, 0.0))
        some = np.logical_or.reduce([s != 0 for s in sums])
        at, to = np.nonzero(some)
        made = {"y": at + y0, "x": to + x0, **{c: s[at, to] for c, s in zip(columns, sums, strict=True)}}
        return pd.DataFrame({**{k: key[i] for i, k in enumerate(keys)}, **made})

    return placed.groupBy(*keys, "ty", "tx").applyInPandas(run, schema)


def footprint_means(rows: DataFrame, columns: Sequence[str], offsets: Sequence[Offset], shape: tuple[int, int], keys: Sequence[str] = ()) -> DataFrame:
    """keys, y, x, the means of ``columns`` over all rows whose footprint has the cell, and n, the number of these rows.

    Rows may share a cell and lie beyond the grid, then they play no part; missing values are left out of their column's mean.
    """
    inside = (F.col("y") >= 0) & (F.col("y") < shape[0]) & (F.col("x") >= 0) & (F.col("x") < shape[1])
    sums = [F.sum(c).alias(c) for c in columns] + [F.count(c).alias(f"{c}_n") for c in columns]
    cells = rows.where(inside).groupBy(*keys, "y", "x").agg(*sums, F.count(F.lit(1)).alias("n"))
    # a row counts for the cells at its offsets, so a cell looks back along them
    back = [(-dy, -dx, w) for dy, dx, w in offsets]
    made = footprint_sums(cells, [*columns, *[f"{c}_n" for c in columns], "n"], back, shape, keys)
    return made.select(*keys, "y", "x", *[F.try_divide(F.col(c), F.col(f"{c}_n")).alias(c) for c in columns], F.col("n").cast("bigint").alias("n"))


def box_means(cells: DataFrame, columns: Sequence[str], size: int, shape: tuple[int, int], keys: Sequence[str] = ()) -> DataFrame:
    """Means over a box of ``size`` cells a side, edges repeated, absent cells 0; an even size reaches one further down than up."""
    down = size // 2
    offsets = [(dy, dx, 1.0) for dy in range(-down, size - down) for dx in range(-down, size - down)]
    made = footprint_sums(cells, columns, offsets, shape, keys, "nearest")
    return made.select(*keys, "y", "x", *[(F.col(c) / float(size * size)).alias(c) for c in columns])
