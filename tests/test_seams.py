"""Tracking by segments and by months against one run over all time."""

from __future__ import annotations

import math
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from isobar.operators import seams as S, track as T
from tests.test_tracking import SCHEMA, center


@pytest.fixture(autouse=True)
def folder(spark, tmp_path):
    spark.sparkContext.setCheckpointDir(str(tmp_path))


def drifting(seed, steps, grid="g", empty=()):
    """Centres that wander, appear, vanish, meet and share systems."""
    rng = random.Random(seed)
    held = [[rng.uniform(50, 70), rng.uniform(-40, 40)] for _ in range(8)]
    out = []
    for step in range(steps):
        for h in held:
            h[0] = min(75.0, max(45.0, h[0] + rng.uniform(-1, 1)))
            h[1] += rng.uniform(-1, 3)
        if rng.random() < 0.3:
            held.pop(rng.randrange(len(held)))
        if rng.random() < 0.35 or not held:
            near = rng.choice(held) if held else [60.0, 0.0]
            held.append([near[0] + rng.uniform(-3, 3), near[1] + rng.uniform(-5, 5)])
        if step in empty:
            continue
        system = list(range(len(held)))
        for k in range(1, len(held)):
            close = [j for j in range(k) if system[j] == j and math.dist(held[k], held[j]) < 5]
            if close:
                system[k] = close[0]
        sizes = Counter(system)
        for k, (lat, lon) in enumerate(held):
            row = center(step, k, lon, 98000.0 - 50 * k + rng.randrange(40), 1 if system[k] == k else 2, system[k], sizes[system[k]], lat)
            out.append((grid, *row[1:]))
    return out


def counted(frame):
    return Counter(tuple(r) for r in frame.collect())


def single(spark, rows, **settings):
    return [counted(f) for f in T.track(spark.createDataFrame(rows, SCHEMA), T.Settings(reach=500_000.0, **settings))]


@pytest.mark.parametrize(("seed", "days", "overlap", "signed"), [(1, 2.0, 1.0, False), (2, 0.5, 0.25, False), (3, 3.0, 2.5, True), (4, 5.0, 0.0, False)])
def test_segments_equal_one_run(spark, seed, days, overlap, signed):
    rows = drifting(seed, 60) + drifting(seed + 50, 40, "h", empty={9, 10, 30})
    cut = lambda time: F.floor(time / days).cast("bigint")
    frame = spark.createDataFrame(rows, SCHEMA).repartition(3)
    got = S.track_by_segments(frame, T.Settings(reach=500_000.0, signed=signed), overlap, cut)
    want = single(spark, rows, signed=signed)
    assert [counted(f) for f in got] == want
    assert len({tuple(r) for r in frame.select("grid", cut(F.col("time"))).distinct().collect()}) > 4
    kinds = Counter(k[4] for k in want[1])
    assert kinds["mg"] and kinds["sp"] and kinds["ly"]


def test_a_warm_segment_is_not_tracked_again(spark, monkeypatch):
    rows = drifting(7, 80)
    again = []
    plain = S._resumed_runs

    def seen(centers, states):
        again.append({(r["grid"], r["segment"]) for r in states.collect()})
        return plain(centers, states)

    monkeypatch.setattr(S, "_resumed_runs", seen)
    cut = lambda time: F.floor(time / 4).cast("bigint")
    frame = spark.createDataFrame(rows, SCHEMA)
    cold = S.track_by_segments(frame, T.Settings(reach=500_000.0), 0.0, cut)
    cold_again, again[:] = set().union(*again), []
    warm = S.track_by_segments(frame, T.Settings(reach=500_000.0), 3.75, cut)
    assert [counted(f) for f in warm] == [counted(f) for f in cold] == single(spark, rows)
    assert len(cold_again) == 4 and len(set().union(*again)) < 4


def test_segments_of_nothing(spark):
    rows, events = S.track_by_segments(spark.createDataFrame([], SCHEMA))
    assert rows.count() == 0 and events.count() == 0


def test_months_resume_and_are_replaced(spark, tmp_path):
    # 36,500 days after 1900 is in the month 1199; steps of six hours, so a month is 124 steps
    rows = [(g, 36_520 + t, *r) for g, t, *r in drifting(11, 150)] + [(g, 36_520 + t, *r) for g, t, *r in drifting(12, 30, "h")]
    frame = spark.createDataFrame(rows, SCHEMA)
    months = sorted(r[0] for r in frame.select(S.month_of(F.col("time"))).distinct().collect())
    assert len(months) == 3
    store = S.MonthStore(spark, str(tmp_path / "store"))
    settings = T.Settings(reach=500_000.0)
    for month in months:
        store.advance(frame, month, settings)
        store.write_systems(month)
    whole = single(spark, rows)
    assert [counted(store.rows().drop("month")), counted(store.events().drop("month"))] == whole
    before = counted(store.systems())
    for month in months[1:]:
        store.advance(frame, month, settings)
        store.write_systems(month)
    assert [counted(store.rows().drop("month")), counted(store.events().drop("month"))] == whole
    assert counted(store.systems()) == before
    # one conversion of all tracks that have ended gives the same systems, but for revivals that are still under way
    obs, events = T.track(frame, settings)
    ended = obs.where(F.col("ely").isin(1, 3)).select("grid", "tid").distinct()
    made, _ = T.systems(obs.join(ended, ["grid", "tid"], "left_semi"), events.join(ended, ["grid", "tid"], "left_semi"))
    assert counted(store.systems().select(*made.columns)) == counted(made)


def test_a_dead_system_leaves_the_month_before_when_it_is_revived(spark, tmp_path):
    first, second = 1190, 1191
    last = spark.range(1).select((F.datediff(F.lit("1999-04-01").cast("date"), F.lit("1900-01-01").cast("date"))).alias("d")).first()["d"]
    assert spark.range(1).select(S.month_of(F.lit(last - 1.0)), S.month_of(F.lit(float(last)))).first()[:] == (first, second)
    pair = lambda k, a, b: [(*r[:1], last - 0.5 + k * 0.25, *r[2:]) for r in (center(0, 0, a, 97000.0, 1, 0, 2), center(0, 1, b, 97500.0, 2, 0, 2))]
    only = lambda k, lon: [("g", last - 0.5 + k * 0.25, *center(0, 0, lon, 97500.0)[2:])]
    rows = pair(0, 0.0, 20.0) + pair(1, 1.0, 20.5) + only(2, 21.0) + only(3, 21.5) + [("g", last + 0.5, *center(0, 0, 120.0)[2:])]
    frame = spark.createDataFrame(rows, SCHEMA)
    store = S.MonthStore(spark, str(tmp_path / "store"))
    for month in (first, second):
        store.advance(frame, month, T.Settings(reach=300_000.0))
        store.write_systems(month)
    kept = {r["sid"]: r["month"] for r in store.systems().collect()}
    events = counted(store.events().where("event = 'rg'").select("tid", "otid"))
    assert events and set(kept.values()) == {second}
