import itertools
import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from isobar.operators import label as L, precip as P, raster as R

SHAPE = (9, 11)


@pytest.fixture(scope="module")
def grid():
    rng = np.random.default_rng(7)
    field = rng.normal(size=SHAPE).round(2)
    field[2, 3] = field[6, 7] = np.nan
    return field


@pytest.fixture(scope="module")
def field(spark, grid):
    rows = [(0, y, x, None if math.isnan(v) else float(v)) for (y, x), v in np.ndenumerate(grid)]
    return spark.createDataFrame(rows, "t bigint, y int, x int, v double").cache()


def dense(frame, value="v"):
    out = np.full(SHAPE, np.nan)
    for r in frame.select("y", "x", value).collect():
        out[r[0], r[1]] = np.nan if r[2] is None else r[2]
    return out


def windows(grid, half, mode=None):
    padded = np.pad(grid, half, constant_values=np.nan) if mode is None else np.pad(grid, half, mode=mode)
    return {(y, x): padded[y : y + 2 * half + 1, x : x + 2 * half + 1] for y, x in np.ndindex(*SHAPE)}


@pytest.mark.parametrize(("style", "f"), [("mean", np.nanmean), ("sum", np.nansum), ("median", np.nanmedian), ("max", np.nanmax), ("min", np.nanmin)])
def test_filters(field, grid, style, f):
    want = np.array([f(w) for w in windows(grid, 1).values()]).reshape(SHAPE)
    assert np.allclose(dense(R.filter_field(field, 1, SHAPE, style)), want)


def test_filter_deviation_needs_whole_windows(field, grid):
    want = np.array([np.std(w) for w in windows(grid, 1).values()]).reshape(SHAPE)
    assert np.allclose(dense(R.filter_field(field, 1, SHAPE, "std", missing_edge=True)), want, equal_nan=True)
    with pytest.raises(ValueError):
        R.filter_field(field, 1, SHAPE, "std")
    with pytest.raises(ValueError):
        R.filter_field(field, 1, SHAPE, "mode")


def test_uniform_keeps_a_constant(spark):
    cells = spark.createDataFrame([(0, y, x, 3.5) for y, x in np.ndindex(*SHAPE)], "t bigint, y int, x int, v double")
    for size in (3, 4, 8):
        assert np.allclose(dense(R.uniform_filter(cells, size, SHAPE)), 3.5)
    assert np.allclose(dense(R.gaussian_filter(cells, 2.0, SHAPE)), 3.5)


def test_minima_reflect_at_the_edge(field, grid):
    filled = np.where(np.isnan(grid), np.inf, grid)
    want = {(y, x) for (y, x), w in windows(filled, 1, "symmetric").items() if not math.isnan(grid[y, x]) and filled[y, x] == w.min()}
    assert {(r["y"], r["x"]) for r in R.extrema(field, shape=SHAPE).collect()} == want
    strict = {(r["y"], r["x"]) for r in R.extrema(field, missing_share=1e-9, shape=SHAPE).collect()}
    near = {(y, x) for (y, x), w in windows(grid, 1, "symmetric").items() if np.isnan(w).any()}
    assert strict == want - near


def sobel(grid, axis):
    out = np.full(grid.shape, np.nan)
    for y, x in itertools.product(range(1, grid.shape[0] - 1), range(1, grid.shape[1] - 1)):
        w = grid[y - 1 : y + 2, x - 1 : x + 2]
        step = (w[2] - w[0]) @ [1, 2, 1] if axis == 0 else (w[:, 2] - w[:, 0]) @ [1, 2, 1]
        out[y, x] = np.nan if np.isnan(w).any() else step
    return out


def test_laplacian(field, grid):
    twice = lambda a: sobel(sobel(grid, a) / 8, a) / 8
    assert np.allclose(dense(R.laplacian(field, SHAPE)), twice(0) + twice(1), equal_nan=True)


def test_gradient_of_a_plane_in_kilometres(spark):
    lat, lon = lambda y: 60 - y, lambda x: 2.0 * x
    cells = spark.createDataFrame([(0, y, x, float(10 * lat(y))) for y, x in np.ndindex(*SHAPE)], "t bigint, y int, x int, v double")
    grid = spark.createDataFrame([(y, x, float(lat(y)), lon(x)) for y, x in np.ndindex(*SHAPE)], "y int, x int, lat double, lon double")
    out = R.slope_latlong(cells, grid, SHAPE).where("gy IS NOT NULL").collect()
    assert len(out) == (SHAPE[0] - 2) * (SHAPE[1] - 2)
    assert all(r["gy"] == pytest.approx(10 / 111.19492664, rel=1e-6) and abs(r["gx"]) < 1e-9 for r in out)
    flat = R.laplacian_latlong(cells, grid, SHAPE).where("v IS NOT NULL").collect()
    assert flat and all(abs(r["v"]) < 1e-6 for r in flat)


def test_kernels():
    assert len(R.circle(1)) == 5 and len(R.circle(2)) == 13
    assert all(1 < w <= 2 for _, _, w in R.ring(1, 2))
    assert all(150 < w <= 250 for _, _, w in R.ring_distance(100, 100, 250))
    assert sum(w for *_, w in R.laplacian_offsets()) == pytest.approx(0)


def test_bilinear_weights_sum_to_one():
    dst = [(0, k, y, x) for k, (y, x) in enumerate([(0.0, 0.0), (1.25, 2.5), (3.0, 359.5), (9.0, 1.0)])]
    weights = R.bilinear_weights([0, 1, 2, 3], list(range(360)), dst, periodic=360)
    total = {}
    for _, col, *_, w in weights:
        total[col] = total.get(col, 0) + w
    assert total == pytest.approx({0: 1, 1: 1, 2: 1})
    assert {sx for _, c, _, sx, _ in weights if c == 2} == {359, 0}


def test_discretise(spark):
    rows = spark.createDataFrame([(v,) for v in (-1.0, 0.0, 0.5, 1.0, 2.0, 2.5)], "v double").select(R.discretise(F.col("v"), [0, 1, 2]).alias("b")).collect()
    assert [r["b"] for r in rows] == [None, 1, 1, 2, 2, None]


def flood(mask):
    labels, n = np.zeros(mask.shape, int), 0
    for start in np.argwhere(mask):
        if labels[tuple(start)]:
            continue
        n += 1
        stack = [tuple(start)]
        while stack:
            y, x = stack.pop()
            if 0 <= y < mask.shape[0] and 0 <= x < mask.shape[1] and mask[y, x] and not labels[y, x]:
                labels[y, x] = n
                stack += [(y + 1, x), (y - 1, x), (y, x + 1), (y, x - 1)]
    return labels


@pytest.mark.parametrize("share", [0.2, 0.5, 0.6, 0.9])
def test_labels_against_flood_fill(share):
    rng = np.random.default_rng(int(share * 10))
    for _ in range(20):
        mask = rng.random((13, 17)) < share
        assert (L.label_grid(mask) == flood(mask)).all()
        turned = L.label_grid(mask.T).T
        assert len(np.unique(turned)) == len(np.unique(flood(mask)))


def test_contours_enclose_the_component_below_each_level():
    rng = np.random.default_rng(4)
    field = rng.normal(size=(12, 12))
    seed = np.unravel_index(field.argmin(), field.shape)
    for contour in (-1.5, -0.5, 0.0, 0.7, 3.0):
        labels = flood(field < contour)
        want = labels == labels[seed] if labels[seed] else np.zeros(field.shape, bool)
        assert (L.Contours(field, seed).area(contour) == want).all()


def test_areas_of_two_lows_in_one_basin():
    y, x = np.indices((20, 30))
    well = lambda cy, cx, d: -d * np.exp(-((y - cy) ** 2 + (x - cx) ** 2) / 12)
    rim = 100000 + 4 * ((y - 10) ** 2 + (x - 15) ** 2)
    field = rim + well(10, 12, 2500) + well(10, 19, 2000)
    centers = pd.DataFrame({"id": [0, 1], "y": [10, 10], "x": [12, 19], "lat": [50.0, 50.0], "lon": [0.0, 5.0], "p_cent": [field[10, 12], field[10, 19]]})
    near, _ = L.closed_areas(field, centers, 100.0, 0.99, 2e6, np.zeros(field.shape, bool))
    assert near["type"].tolist() == [1, 2] and near["parent"].tolist() == [0, 0]
    assert near["area"].nunique() == 1
    far, _ = L.closed_areas(field, centers, 100.0, 0.99, 1e5, np.zeros(field.shape, bool))
    assert far["type"].tolist() == [1, 1] and (far["area"] < near["area"]).all()


def test_precipitation_goes_to_the_nearest_area(spark):
    shape = (5, 9)
    grid = spark.createDataFrame([(y, x, float(y), float(x), 1.0, 1.0) for y in range(5) for x in range(9)], "y int, x int, lat double, lon double, y_size double, x_size double")
    areas = spark.createDataFrame([(0, 2, 1, 1), (0, 2, 7, 7)], "t bigint, y int, x int, area_id int")
    centers = spark.createDataFrame([(0, 0, 2, 1, 1, 0), (0, 1, 2, 7, 1, 1), (0, 2, 0, 0, 2, 1), (0, 3, 4, 8, 1, 3)], "t bigint, id int, y int, x int, type int, parent int")
    rain = spark.createDataFrame([(0, 2, x, 1.0, 2.0) for x in range(9)] + [(0, 0, 4, 1.0, 5.0), (0, 4, 0, None, 3.0), (0, 0, 0, 0.6, float("nan"))], "t bigint, y int, x int, large double, total double")
    given = P.attribute(rain, areas, centers, grid, shape, 0.5, 1.0)
    got = {(r["y"], r["x"]): r["id"] for r in given.collect()}
    # the middle is as far from both; the secondary's disk meets the corner; nothing meets (0, 4), nor what has no large rain
    assert got == {(2, x): int(x > 4) for x in range(9)} | {(0, 0): 1}
    plain = {r["id"]: (r["precip"], r["precip_area"]) for r in P.totals(given, centers).collect()}
    assert plain == {0: (10.0, 5), 1: (8.0, 5), 2: (0.0, 0), 3: (0.0, 0)}
    assert {r["id"]: r["precip"] for r in P.totals(given, centers, handed_on=True).collect()}[2] == 8.0


def test_disks_follow_the_cell_size_of_their_centre(spark):
    grid = spark.createDataFrame([(y, x, 0.0, 0.0, 10.0, 10.0 / (1 + y)) for y in range(9) for x in range(9)], "y int, x int, lat double, lon double, y_size double, x_size double")
    centers = spark.createDataFrame([(0, 0, 0, 4), (0, 1, 1, 4), (0, 2, 8, 0)], "t bigint, id int, y int, x int")
    got = P.disks(centers, grid, 10.0, (9, 9)).collect()
    cells = {i: {(r["y"], r["x"]) for r in got if r["id"] == i} for i in range(3)}
    assert cells[0] == {(0, 3), (0, 4), (0, 5), (1, 4)}
    assert cells[1] == {(1, x) for x in range(2, 7)} | {(0, 4), (2, 4)}
    assert cells[2] == {(8, x) for x in range(9)} | {(7, 0)}


@pytest.mark.parametrize("sphere", [False, True])
def test_nearest_owner_by_brute_force(sphere):
    rng = np.random.default_rng(3)
    for n, m in ((1, 1), (50, 300), (700, 90), (400, 1000)):
        if sphere:
            seats, points = (v / np.linalg.norm(v, axis=1)[:, None] for v in (rng.normal(size=(m, 3)), rng.normal(size=(n, 3))))
        else:
            seats, points = rng.integers(0, 25, (m, 2)).astype(float), rng.integers(0, 25, (n, 2)).astype(float)
        owner = rng.integers(0, 9, m)
        away = P._told(np.sqrt(((points[:, None] - seats[None]) ** 2).sum(2)), sphere)
        want = [owner[away[i] == away[i].min()].min() for i in range(n)]
        assert P.nearest_owner(points, seats, owner, sphere).tolist() == want


def _field(seed):
    rng = np.random.default_rng(seed)
    field = rng.normal(size=(14, 14))
    for _ in range(2):
        field = (field + np.roll(field, 1, 0) + np.roll(field, -1, 0) + np.roll(field, 1, 1) + np.roll(field, -1, 1)) / 5
    field = np.round(field / np.abs(field).max() * 2000 + 100000, 1)
    around = np.stack([np.pad(field, 1, constant_values=np.nan)[1 + a : 15 + a, 1 + b : 15 + b] for a in (-1, 0, 1) for b in (-1, 0, 1) if a or b])
    y, x = np.nonzero(field < np.nanmin(around, 0))
    maxima = (field > np.nanmax(around, 0)) & (seed % 4 > 0)
    return field, maxima, pd.DataFrame({"id": range(len(y)), "y": y, "x": x, "lat": 45 + y * 0.9, "lon": -20 + x * 1.5, "p_cent": field[y, x]})


def test_closed_areas_are_the_highest_admissible_edges():
    """What defines an edge, looked up for all contours at once.

    Contour k holds the cells around the centre that are connected below p + k * interval.  An edge is
    the last contour before the rise is over or the last before a centre comes in, and it is admissible if no centre
    is in it or the latest one came in after less than ``ratio`` of its contours.  The highest admissible edge counts.
    """
    interval, ratio, reach = 150.0, 0.6, 900e3
    seen = set()
    for seed in range(60):
        field, maxima, centers = _field(seed)
        got, _ = L.closed_areas(field, centers, interval, ratio, reach, maxima)
        n = len(centers)
        order = sorted(range(n), key=lambda i: (centers["p_cent"][i], i))
        for place, me in enumerate(order):
            row, parents = got.iloc[me], got["parent"].astype(int).tolist()
            seen.add(int(row["type"]))
            if parents[me] != me:
                head = got.iloc[parents[me]]
                assert row["type"] == 2 and head["type"] == 1 and row["p_edge"] == head["p_edge"]
                continue
            free = {i for i in range(n) if i != me and order.index(parents[i]) >= place}
            near = {i for i in free if L._distance(centers["lat"][me], centers["lat"][i], centers["lon"][me], centers["lon"][i]) <= reach}
            top = math.ceil((field.max() - centers["p_cent"][me]) / interval)
            contours = [L.label_grid(field < centers["p_cent"][me] + k * interval) for k in range(top + 1)]
            inside = [(c == c[centers["y"][me], centers["x"][me]]) & (c > 0) for c in contours]
            held = [{i for i in range(n) if i != me and a[centers["y"][i], centers["x"][i]]} for a in inside]
            over = next((k for k in range(1, top + 1) if (inside[k] & maxima).any() or held[k] - near), top)
            came = {i: min(k for k in range(over + 1) if i in held[k]) for i in held[over]} if top else {}
            edges = {over - 1} | {k - 1 for k in came.values()}
            fit = [e for e in edges if not held[max(e, 0)] or max(came[i] for i in held[e]) - 1 < ratio * e]
            system = near and over > 1 and (len(held[over]) > 1 or held[over] & near)
            edge = max(fit) if system else over - 1
            assert row["p_edge"] == pytest.approx(centers["p_cent"][me] + edge * interval)
            assert set(got.index[got["parent"] == me]) == {me} | (held[max(edge, 0)] if system else set())
            assert row["area"] == max(int(inside[max(edge, 0)].sum()), 1)
    assert seen == {1, 2}


def test_closed_areas_worked_by_hand():
    """Two hollows in a basin: 0 and 10 with a saddle at 45, walls of 100; contours every 10."""
    row = [100, 40, 0, 30, 45, 30, 10, 40, 100]
    field = np.array([[100.0] * 9, [float(v) for v in row], [100.0] * 9])
    centers = pd.DataFrame({"id": [0, 1], "y": [1, 1], "x": [2, 6], "lat": [0.0, 0.0], "lon": [2.0, 6.0], "p_cent": [0.0, 10.0]})
    none = np.zeros(field.shape, bool)
    # contour 5 (50) takes the second hollow in, the rise ends with 10 (100): 4 of 9 contours lie below it
    for ratio, edge, mates, area in ((0.5, 90.0, [0, 0], 7), (0.4, 40.0, [0, 1], 2)):
        got, _ = L.closed_areas(field, centers, 10.0, ratio, 1e9, none)
        assert (got["p_edge"][0], got["parent"].tolist(), got["area"][0]) == (edge, mates, area)
    # out of reach it ends the rise, and each has its own hollow: below 40 are two cells, the hill between not
    got, _ = L.closed_areas(field, centers, 10.0, 0.5, 1.0, none)
    assert got["parent"].tolist() == [0, 1] and got["p_edge"].tolist() == [40.0, 40.0] and got["area"].tolist() == [2, 2]
    # a maximum at the saddle does so as well
    hill = none.copy()
    hill[1, 4] = True
    got, _ = L.closed_areas(field, centers, 10.0, 0.5, 1e9, hill)
    assert got["p_edge"].tolist() == [40.0, 40.0] and got["type"].tolist() == [1, 1]
