import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from isobar.functions import caltime as C, geo as G, stats as S


@pytest.mark.parametrize(
    ("start", "step", "want"),
    [
        ([2012, 10, 31, 17, 44, 54], [0, 0, 0, 6, 15, 30], [2012, 11, 1, 0, 0, 24]),
        ([1988, 2, 25], [0, 0, 150], [1988, 7, 24, 0, 0, 0]),
        ([1989, 2, 25], [0, 0, 150], [1989, 7, 25, 0, 0, 0]),
        ([-1, 12, 31, 23, 59, 59], [0, 0, 0, 0, 0, 1], [1, 1, 1, 0, 0, 0]),
        ([1900, 9, 30, 12, 0, 0], [0, 0, 0.25], [1900, 9, 30, 18, 0, 0]),
        ([1988, 7, 25], [0, 0, -150], [1988, 2, 26, 0, 0, 0]),
        ([2011, 12, 1], [0, 1, 0], [2012, 1, 1, 0, 0, 0]),
        ([2012, 1, 31], [0, 1, 0], [2012, 2, 29, 0, 0, 0]),
        ([1, 1, 1], [0, 0, -1], [-1, 12, 31, 0, 0, 0]),
    ],
)
def test_time_add(start, step, want):
    assert C.time_add(start, step) == want


def test_other_calendars():
    assert C.time_add([2012, 2, 28], [0, 0, 1], leap_years=False) == [2012, 3, 1, 0, 0, 0]
    assert C.time_add([2012, 2, 30], [0, 0, 1], days_per_year=360) == [2012, 3, 1, 0, 0, 0]
    assert C.days_between([2012, 1, 1], [2013, 1, 1]) == 366
    assert C.days_between([2012, 1, 1], [2013, 1, 1], leap_years=False) == 365
    assert C.days_between([2012, 1, 1], [2013, 1, 1], days_per_year=360) == 360
    assert C.days_between([-1, 12, 31], [1, 1, 1]) == 1
    with pytest.raises(ValueError):
        C.days_between([0, 1, 1], [1, 1, 1])


def test_add_and_between_agree():
    rng = np.random.default_rng(1)
    for _ in range(200):
        start = [int(rng.integers(-30, 2100)) or 1, int(rng.integers(1, 13)), int(rng.integers(1, 29))]
        days = int(rng.integers(-20000, 20000))
        assert C.days_between(start, C.time_add(start, [0, 0, days])) == days


def test_seasons():
    assert C.SEASONS[0] == "NDJ" and C.SEASONS[1] == "DJF" and C.SEASONS[7] == "JJA"


def test_distribution():
    assert S.t_two_sided(2.228138852, 10) == pytest.approx(0.05, abs=1e-7)
    assert S.t_two_sided(0.0, 5) == pytest.approx(1.0)
    assert S.t_quantile(0.95, 10) == pytest.approx(2.228138852, abs=1e-6)


def test_geo(spark):
    row = spark.range(1).select(
        G.haversine(F.lit(0.0), F.lit(0.0), F.lit(0.0), F.lit(90.0), "km").alias("quarter"), G.add_lat(F.lit(85.0), F.lit(10.0)).alias("lat"), G.add_long(F.lit(175.0), F.lit(10.0)).alias("lon"),
        G.add_long(F.lit(355.0), F.lit(10.0), False).alias("lon360"), G.direction_from(F.lit(0.0), F.lit(0.0)).alias("still"), G.direction_from(F.lit(0.0), F.lit(-1.0)).alias("north"),
        G.dist2lat(F.lit(111.19492664)).alias("one"), G.dist2long(F.lit(1.0), F.lit(0.0), F.lit(10.0)).alias("far"),
    ).first()
    assert row["quarter"] == pytest.approx(math.pi / 2 * 6371)
    assert (row["lat"], row["lon"], row["lon360"], row["still"], row["north"]) == (85.0, -175.0, 5.0, 0.0, 360.0)
    assert row["one"] == pytest.approx(1, abs=1e-6)
    assert row["far"] is None


def test_trend_against_numpy(spark):
    rng = np.random.default_rng(2)
    x, y = np.arange(20.0), rng.normal(size=20).cumsum()
    got = S.trend(spark.createDataFrame([("a", float(a), float(b)) for a, b in zip(x, y, strict=True)] + [("a", 30.0, None), ("b", 1.0, 1.0)], "k string, x double, y double"), ["k"], "x", "y", 10, p_values=True)
    rows = {r["k"]: r for r in got.collect()}
    slope, intercept = np.polyfit(x, y, 1)
    assert (rows["a"]["trend"], rows["a"]["yint"], rows["a"]["n"]) == (pytest.approx(slope), pytest.approx(intercept), 20)
    error = math.sqrt(((y - slope * x - intercept) ** 2).sum() / 18 / ((x - x.mean()) ** 2).sum())
    assert rows["a"]["stderr"] == pytest.approx(error)
    assert rows["a"]["pvalue"] == pytest.approx(S.t_two_sided(slope / error, 18))
    assert rows["b"]["trend"] is None


def test_multi_ols_against_numpy(spark):
    rng = np.random.default_rng(3)
    a, b = rng.normal(size=50), rng.normal(size=50)
    y = 2 * a - b + rng.normal(size=50)
    frame = spark.createDataFrame([tuple(map(float, r)) for r in zip(y, a, b, strict=True)], "y double, a double, b double")
    z = lambda v: (v - v.mean()) / v.std()
    want, *_ = np.linalg.lstsq(np.column_stack([z(a), z(b)]), z(y), rcond=None)
    got = {r["term"]: r for r in S.multi_ols(frame, [], "y", ["a", "b"]).collect()}
    assert [got["a"]["coef"], got["b"]["coef"]] == pytest.approx(want.tolist())
    assert got["a"]["low"] < got["a"]["coef"] < got["a"]["high"] and got["a"]["pvalue"] < 1e-6


def test_circular_mean(spark):
    cases = [[350.0, 10.0], [90.0], [], [0.0, 360.0], [1.0, 2.0, 3.0]]
    rows = spark.createDataFrame([(i, c) for i, c in enumerate(cases)], "i int, v array<double>")
    got = {r["i"]: r["m"] for r in rows.select("i", S.mean_circular(F.col("v"), 0.0, 360.0).alias("m")).collect()}
    assert got[0] == pytest.approx(360.0) and got[1] == 90.0 and got[2] is None and got[4] == pytest.approx(2.0)


@pytest.mark.parametrize(("days_per_year", "leap_years"), [(365, True), (365, False), (360, False)])
def test_calendar_add_against_exact_fractions(spark, days_per_year, leap_years):
    import random

    rng = random.Random(1)
    rows = [
        (i, rng.choice([rng.randint(-10, 10) or 1, rng.randint(1600, 2100), -1, 1, 2000, 1900]), rng.randint(1, 12), rng.randint(1, 28), float(rng.randint(0, 86399)), rng.choice([0, rng.randint(-30, 30)]), rng.choice([0, rng.randint(-40, 40)]),
         rng.choice([0.0, 0.25, -0.5, float(rng.randint(-800, 800))]), rng.choice([0.0, float(rng.randint(-200_000, 200_000))]))
        for i in range(500)
    ]
    rows += [(900, -1, 12, 31, 86399.0, 0, 0, 0.0, 1.0), (901, 2012, 10, 31, 63894.0, 0, 0, 0.0, 22530.0), (902, 1900, 9, 30, 43200.0, 0, 0, 0.25, 0.0), (903, 1996, 2, 29 if leap_years else 28, 0.0, 1, 0, 0.0, 0.0)]
    frame = spark.createDataFrame(rows, "i int, y int, m int, d int, s double, ys int, ms int, ds double, ss double")
    step = {"years": F.col("ys"), "months": F.col("ms"), "days": F.col("ds"), "seconds": F.col("ss")}
    got = {r["i"]: r["a"] for r in frame.select("i", C.calendar_add(F.col("y"), F.col("m"), F.col("d"), F.col("s"), step, days_per_year, leap_years).alias("a")).collect()}
    for i, y, m, d, s, ys, ms, ds, ss in rows:
        want = C.time_add([y, m, d, 0, 0, s], [ys, ms, ds, 0, 0, ss], leap_years, days_per_year)
        assert (got[i]["year"], got[i]["month"], got[i]["day"]) == tuple(want[:3])
        assert got[i]["seconds"] == pytest.approx(want[3] * 3600 + want[4] * 60 + want[5])
    assert (got[900]["year"], got[900]["seconds"]) == (1, 0.0)


def test_there_is_no_year_0(spark):
    row = spark.range(1).select(C.calendar_add(F.lit(0), F.lit(1), F.lit(1), F.lit(0), {"days": F.lit(1)}).alias("a")).first()["a"]
    assert row["year"] is None


def test_nearest_axis_meets_by_buckets(spark):
    from isobar.operators.traj import nearest_axis

    axis = spark.createDataFrame([(v,) for v in (0.0, 1.0, 1.5, 40.0, 1000.0, 1000.0)] + [(None,)], "a double")
    points = spark.createDataFrame([(v,) for v in (-1e9, 0.5, 0.5000001, 1.25, 1.26, 20.0, 20.75, 520.0, 520.1, 1e12)] + [(None,)], "v double")
    made = nearest_axis(points, axis, "v", "a", "near")
    assert {r["v"]: r["near"] for r in made.collect()} == {-1e9: 0.0, 0.5: 0.0, 0.5000001: 1.0, 1.25: 1.0, 1.26: 1.5, 20.0: 1.5, 20.75: 1.5, 520.0: 40.0, 520.1: 1000.0, 1e12: 1000.0, None: None}
    text = made._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in text and "CartesianProduct" not in text
    assert nearest_axis(points, axis.limit(0), "v", "a", "near").where("near IS NOT NULL").count() == 0
    assert {r["near"] for r in nearest_axis(points, axis.where("a = 40"), "v", "a", "near").collect()} == {40.0, None}


def test_cubes_hold_what_is_near(spark):
    from isobar.functions.geo import haversine, near_cells, space_cell

    rows = [(0, 89.9, 0.0), (1, 89.9, 180.0), (2, 0.0, 179.9), (3, 0.0, -179.9), (4, 60.0, 10.0), (5, 61.0, 12.0), (6, -45.0, 0.0)]
    points = spark.createDataFrame(rows, "i int, lat double, lon double")
    a = points.select("i", "lat", "lon", near_cells(space_cell(F.col("lat"), F.col("lon"), 200.0)).alias("c")).select("i", "lat", "lon", "c.*")
    b = points.select(F.col("i").alias("j"), F.col("lat").alias("lat2"), F.col("lon").alias("lon2"), *[c.alias(n) for c, n in zip(space_cell(F.col("lat"), F.col("lon"), 200.0), ("cx", "cy", "cz"), strict=True)])
    met = a.join(b, ["cx", "cy", "cz"]).where(haversine(F.col("lat"), F.col("lat2"), F.col("lon"), F.col("lon2"), "km") < 200)
    assert {(r["i"], r["j"]) for r in met.select("i", "j").collect()} == {(i, i) for i in range(7)} | {(0, 1), (1, 0), (2, 3), (3, 2), (4, 5), (5, 4)}
