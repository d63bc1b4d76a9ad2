"""Nearest matches between two sets of tracks, by blocks of time and space.

Tracks that are near on average are so at some time that both have.  Whole tracks go to the blocks that they
pass, those of the second set also to blocks within that distance; pairs are made inside a block alone and
belong to the one in which the first track is when they first are near.  What is sent grows with the
tracks, not with their pairs; a task holds the second set's tracks of one block.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from isobar.functions.geo import EARTH_M
from isobar.operators.label import dealt

EARTH_KM = EARTH_M / 1000
#: Hours of a block, and the least side of its cube in kilometres.
HOURS, SIDE = 720.0, 2000.0
#: Times in a box that is looked at before the times themselves.
BOX = 8
#: Cells (a track at a time) of the grid that a block's second tracks are laid out in at once.
CELLS = 2_000_000
#: Mean distances (km) that differ by less are told by the great-circle formula.
CLOSE = 1e-6


def as_rows(live: DataFrame, key: str, month: Column | None = None, begins: Column | None = None) -> DataFrame:
    """A row for each track of ``live`` (key, h, lat, lon): id, size, two numbers to match months by (aggregates) and its positions in the order of time."""
    # a missing position is not measured; one that is no number makes the mean none, as averages have it
    position = [F.when(F.isnan(c), float("inf")).otherwise(F.col(c)).alias(c) for c in ("lat", "lon")]
    at = F.struct(F.when(F.isnan("h"), 1e300).otherwise(F.col("h")).alias("h"), *position)
    numbers = [(F.lit(0) if n is None else n).cast("int").alias(name) for n, name in ((month, "month"), (begins, "begins"))]
    made = live.where(F.col(key).isNotNull()).groupBy(F.col(key).alias("id")).agg(F.count(F.lit(1)).alias("size"), *numbers, F.sort_array(F.collect_list(F.when(F.col("h").isNotNull(), at))).alias("at"))
    return made.select("id", "size", "month", "begins", *[F.col(f"at.{c}").alias(c) for c in ("h", "lat", "lon")])


def places(lat: np.ndarray, lon: np.ndarray) -> np.ndarray:
    """Unit vectors; nan where a coordinate is missing or infinite."""
    with np.errstate(invalid="ignore"):
        a, b = np.radians(lat), np.radians(lon)
        return np.column_stack([np.cos(a) * np.cos(b), np.cos(a) * np.sin(b), np.sin(a)])


def blocks(h: np.ndarray, place: np.ndarray, side: float, shift: tuple[float, ...]) -> np.ndarray:
    """Number of the block of each row, moved by ``shift`` km along the axes."""
    cube = np.floor((place * EARTH_KM + np.array(shift)) / side).astype(np.int64) + 32
    span = np.floor(np.minimum(h, 1e12) / HOURS).astype(np.int64)
    return ((span * 64 + cube[:, 0]) * 64 + cube[:, 1]) * 64 + cube[:, 2]


def _flat(batch: pa.RecordBatch, name: str) -> np.ndarray:
    return batch.column(name).flatten().to_numpy(zero_copy_only=False).astype(float)


def _to_blocks(tracks: DataFrame, km: float, side: float, second: bool) -> DataFrame:
    """``tracks`` once for each block that they pass, those of the second set within ``km``."""
    margin = (km + 0.001) if second else 0.0
    signs = [(i, j, k) for i in (-1, 1) for j in (-1, 1) for k in (-1, 1)] if second else [(0, 0, 0)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            h, place = _flat(batch, "h"), places(_flat(batch, "lat"), _flat(batch, "lon"))
            track = np.repeat(np.arange(batch.num_rows), np.diff(batch.column("h").offsets.to_numpy()))
            if ((h[1:] == h[:-1]) & (track[1:] == track[:-1])).any():
                raise ValueError("a track has several rows of one time")
            known = np.isfinite(place).all(1)
            h, place, track = h[known], place[known], track[known]
            every = []
            for sign in signs:
                block = blocks(h, place, side, tuple(margin * s for s in sign))
                new = np.concatenate([[True], (block[1:] != block[:-1]) | (track[1:] != track[:-1])])[: len(block)]
                every.append(np.column_stack([track[new], block[new]]))
            passed = np.unique(np.concatenate(every), axis=0)
            for a in range(0, len(passed), 2_000):
                part = passed[a : a + 2_000]
                own = batch.take(pa.array(part[:, 0]))
                yield pa.RecordBatch.from_arrays([pa.array(part[:, 1]), *own.columns], ["block", *own.schema.names])

    schema = f"block bigint, {tracks._jdf.schema().toDDL()}"
    return tracks.mapInArrow(run, schema).withColumn("first", F.lit(not second))


def _one(parts: list[pa.RecordBatch]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.concat_arrays([p.column(i) for p in parts]) for i in range(parts[0].num_columns)], schema=parts[0].schema)


class _Tracks:
    """Tracks of Arrow batches: rows in the order of track and time."""

    def __init__(self, batch: pa.RecordBatch, far: float) -> None:
        self.batch = batch
        self.size = batch.column("size").to_numpy()
        self.month, self.begins = (batch.column(c).to_numpy() for c in ("month", "begins"))
        self.h, self.lat, self.lon = (_flat(batch, c) for c in ("h", "lat", "lon"))
        self.place = places(self.lat, self.lon)
        # what is no number is infinitely far from all, on opposite sides for the two sets
        self.place[np.isinf(self.lat) | np.isinf(self.lon)] = far
        self.lat, self.lon = np.radians(self.lat), np.radians(self.lon)
        counts = np.diff(batch.column("h").offsets.to_numpy())
        self.begin = np.concatenate([[0], np.cumsum(counts)])


class _Grid:
    """Tracks a to b of ``tracks`` laid out by track and time, with boxes around BOX times each."""

    def __init__(self, tracks: _Tracks, a: int, b: int) -> None:
        rows = slice(tracks.begin[a], tracks.begin[b])
        self.times, column = np.unique(tracks.h[rows], return_inverse=True)
        row = np.repeat(np.arange(b - a), np.diff(tracks.begin[a : b + 1]))
        wide = -(-len(self.times) // BOX) * BOX
        self.there = np.zeros((b - a, wide), bool)
        self.there[row, column] = True
        self.place, self.lat, self.lon = np.full((b - a, wide, 3), np.nan), np.full((b - a, wide), np.nan), np.full((b - a, wide), np.nan)
        self.place[row, column], self.lat[row, column], self.lon[row, column] = tracks.place[rows], tracks.lat[rows], tracks.lon[rows]
        self.low, self.high = (f.reduce(self.place.reshape(b - a, -1, BOX, 3), axis=2) for f in (np.fmin, np.fmax))
        self.begin, self.size, self.month = a, tracks.size[a:b], tracks.month[a:b]


def grids(tracks: _Tracks, a: int, b: int) -> Iterator[_Grid]:
    """Tracks a to b, as many at once as make CELLS cells."""
    if b - a > 1 and (b - a) * len(np.unique(tracks.h[tracks.begin[a] : tracks.begin[b]])) > CELLS:
        yield from grids(tracks, a, (a + b) // 2)
        yield from grids(tracks, (a + b) // 2, b)
    else:
        yield _Grid(tracks, a, b)


def _mean(lat1: np.ndarray, lat2: np.ndarray, lon1: np.ndarray, lon2: np.ndarray) -> np.ndarray:
    """Mean great-circle distance (km) of rows of shared times, added up in the order of time."""
    h = np.sin((lat2 - lat1) / 2) ** 2 + np.cos(lat1) * np.cos(lat2) * np.sin((lon2 - lon1) / 2) ** 2
    h = np.minimum(h, 1.0)
    away = 2 * np.arctan2(np.sqrt(h), np.sqrt(1 - h)) * EARTH_KM
    known = ~np.isnan(away)
    return np.cumsum(np.where(known, away, 0.0), axis=1)[:, -1] / known.sum(1)


def _matches(first: _Tracks, i: int, grid: _Grid, block: int, km: float, side: float, least: float, monthly: bool) -> tuple[int, tuple | None]:
    """How many tracks of the grid match track i and belong to the block, and the best: (mean, months back, number, shared times)."""
    rows = slice(first.begin[i], first.begin[i + 1])
    h, place = first.h[rows], first.place[rows]
    column = np.searchsorted(grid.times, h)
    met = (column < len(grid.times)) & (grid.times[np.minimum(column, len(grid.times) - 1)] == h)
    if not met.any():
        return 0, None
    column, h, place, size = column[met], h[met], place[met], int(first.size[i])
    lo, hi = column[0] // BOX * BOX, (column[-1] // BOX + 1) * BOX
    at = column - lo
    fits = 2 * np.minimum(np.minimum(grid.size, size), len(h)) / (grid.size + size) >= least
    if monthly:
        fits &= (grid.month == first.month[i]) | ((grid.month == first.month[i] - 1) & (first.begins[i] < first.month[i]))
    fits = np.flatnonzero(fits)
    own = np.full((hi - lo, 3), np.nan)
    own[at] = place
    low, high = (f.reduce(own.reshape(-1, BOX, 3), axis=1) for f in (np.fmin, np.fmax))
    # the square of the chord, with some room for rounding
    limit = (2 * math.sin(km / EARTH_KM / 2)) ** 2 * (1 + 1e-9) if km < math.pi * EARTH_KM else 9.0
    gap = np.maximum(grid.low[fits, lo // BOX : hi // BOX] - high, low - grid.high[fits, lo // BOX : hi // BOX])
    np.maximum(gap, 0, out=gap)
    fits = fits[(np.einsum("nsk,nsk->ns", gap, gap) < limit).any(1)]
    if not len(fits):
        return 0, None
    apart = grid.place[fits, lo:hi]
    apart -= own
    squared = np.einsum("ntk,ntk->nt", apart, apart)
    near = squared < limit
    # the first time that both are near, in the block of the first track there
    of = np.full(hi - lo, -1, np.int64)
    known = np.isfinite(place).all(1)
    of[at[known]] = blocks(h[known], place[known], side, (0.0, 0.0, 0.0))
    mine = near.any(1) & (of[near.argmax(1)] == block)
    fits, squared = fits[mine], squared[mine]
    shared = grid.there[fits, lo:hi][:, at].sum(1)
    measured = ~np.isnan(squared)
    away = np.where(np.isinf(squared), np.inf, 2 * EARTH_KM * np.arcsin(np.minimum(np.sqrt(squared) / 2, 1.0)))
    mean = np.where(measured, away, 0.0).sum(1) / measured.sum(1)
    good = (2 * shared / (grid.size[fits] + size) >= least) & (mean < km + CLOSE)
    fits, mean, shared = fits[good], mean[good], shared[good]
    if not len(fits):
        return 0, None
    told = (mean <= mean.min() + CLOSE) | (np.abs(mean - km) <= CLOSE)
    lat, lon = first.lat[rows][met], first.lon[rows][met]
    mean[told] = _mean(lat, grid.lat[fits[told], lo:hi][:, at], lon, grid.lon[fits[told], lo:hi][:, at])
    good = mean < km
    if not good.any():
        return 0, None
    fits, mean, shared = fits[good], mean[good], shared[good]
    back = first.month[i] - grid.month[fits]
    best = np.lexsort((fits, back, mean))[0]
    return len(fits), (float(mean[best]), int(back[best]), int(fits[best]) + grid.begin, int(shared[best]))


def nearest(first: DataFrame, second: DataFrame, km: float, least: float, monthly: bool = False) -> DataFrame:
    """(a, matches, separation, back, b, shared) for the tracks of ``first`` that match any of ``second``, both from ``as_rows`` with integers month and begins.

    Tracks match if twice their shared times is at least ``least`` of their sizes and their mean distance is less than ``km``; if
    ``monthly``, also by month as ``compare_months`` has it.  The nearest is the best, ties by months back and id.
    """
    side = max(SIDE, 3 * km)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, others, held = None, [], None
        for batch in batches:
            keys, sides = batch.column("block").to_numpy(), batch.column("first").to_numpy(zero_copy_only=False)
            cuts = [0, *(np.flatnonzero((np.diff(keys) != 0) | (sides[1:] != sides[:-1])) + 1).tolist(), len(keys)]
            for a, b in zip(cuts, cuts[1:]):
                if a == b:
                    continue
                part = batch.slice(a, b - a)
                if keys[a] != block:
                    block, others, held = int(keys[a]), [], None
                if not sides[a]:
                    others.append(part)
                elif others or held:
                    if held is None:
                        held, others = _Tracks(_one(others), math.inf), []
                    made = best_of(_Tracks(_one([part]), -math.inf), held, block)
                    if made is not None:
                        yield made

    def best_of(tracks: _Tracks, others: _Tracks, block: int) -> pa.RecordBatch | None:
        found, best = np.zeros(len(tracks.size), np.int64), {}
        for grid in grids(others, 0, len(others.size)):
            for i in range(len(tracks.size)):
                count, one = _matches(tracks, i, grid, block, km, side, least, monthly)
                if one is not None:
                    found[i] += count
                    best[i] = min(best.get(i, one), one)
        if not best:
            return None
        who = sorted(best)
        values = [pa.array([best[i][k] for i in who]) for k in (0, 1, 3)]
        b = others.batch.column("id").take(pa.array([best[i][2] for i in who]))
        return pa.RecordBatch.from_arrays([tracks.batch.column("id").take(pa.array(who)), pa.array(found[who]), values[0], values[1].cast(pa.int32()), b, values[2]], ["a", "matches", "separation", "back", "b", "shared"])

    both = _to_blocks(first, km, side, False).unionByName(_to_blocks(second, km, side, True))
    kind = both.schema["id"].dataType.simpleString()
    found = dealt(both, "block").sortWithinPartitions("block", "first", "id").mapInArrow(run, f"a {kind}, matches bigint, separation double, back int, b {kind}, shared bigint")
    one = F.min(F.struct("separation", "back", "b", "shared"))
    return found.groupBy("a").agg(F.sum("matches").alias("matches"), one.alias("best")).select("a", "matches", "best.*")
