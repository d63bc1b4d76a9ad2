"""Nearest matches of tracks against all pairs, and what is sent for them."""

from __future__ import annotations

import math
import random
import re

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from isobar.operators import match as M, summary as S


def made(draw: random.Random, count: int, odd: bool) -> list[tuple]:
    """Tracks (tid, time, lat, lon, ...) that wander, over a pole and the date line too; ``odd`` ones lack positions or have one that is no number."""
    rows = []
    for tid in range(count):
        lat, lon, begin = draw.choice([0.0, 50.0, 88.5, -70.0]) + draw.uniform(-4, 4), draw.choice([-179.0, 0.0, 179.0]) + draw.uniform(-6, 6), draw.randrange(6)
        for k in range(draw.randrange(3, 14)):
            lat, lon = max(-90.0, min(90.0, lat + draw.uniform(-1, 1))), (lon + draw.uniform(-2, 2) + 180) % 360 - 180
            place = (None, lon) if odd and draw.random() < 0.1 else (float("nan"), lon) if odd and draw.random() < 0.01 else (lat, lon)
            if draw.random() < 0.85:
                rows.append((tid, 45_290 + (begin + k) * 0.25, *place, 100_000.0 + draw.randrange(2_000)))
    return rows


def test_nearest_tracks_against_all_pairs(spark):
    draw = random.Random(5)
    first, second = made(draw, 60, True), made(draw, 80, True)
    frame = lambda rows: spark.createDataFrame(rows, "tid bigint, time double, lat double, lon double, p_cent double").withColumn("type", F.lit(1))
    got = {r["tid"]: (r["match"], r["shared"], round(r["separation"], 6), round(r["dp"], 6)) if r["match"] is not None else None for r in S.compare_tracks(frame(first), frame(second), 0.4, 900).collect()}

    def away(p, q):
        a, b = math.radians(p[2]), math.radians(q[2])
        h = math.sin((b - a) / 2) ** 2 + math.cos(a) * math.cos(b) * math.sin(math.radians(q[3] - p[3]) / 2) ** 2
        return 2 * math.atan2(math.sqrt(min(h, 1)), math.sqrt(1 - min(h, 1))) * 6371

    want = {}
    tracks = lambda rows: {t: {r[1]: r for r in rows if r[0] == t} for t in {r[0] for r in rows}}
    others = tracks(second)
    for tid, own in tracks(first).items():
        found = []
        for b, other in others.items():
            times = own.keys() & other.keys()
            far = [away(own[t], other[t]) for t in times if own[t][2] is not None and other[t][2] is not None]
            if far and 2 * len(times) / (len(own) + len(other)) >= 0.4 and sum(far) / len(far) < 900:
                found.append((sum(far) / len(far), b, len(times), sum(other[t][4] - own[t][4] for t in times) / len(times)))
        want[tid] = (min(found)[1], min(found)[2], round(min(found)[0], 6), round(min(found)[3], 6)) if found else None
    assert got == want and sum(v is not None for v in want.values()) > 20


def test_a_block_is_laid_out_in_parts_that_hold_all_tracks(monkeypatch):
    batch = pa.record_batch({"id": list(range(9)), "size": [2] * 9, "month": [0] * 9, "begins": [0] * 9, "h": [[i / 2, i / 2 + 1] for i in range(9)], "lat": [[1.0, None]] * 9, "lon": [[2.0, 3.0]] * 9})
    tracks = M._Tracks(batch, math.inf)
    for cells in (1, 12, 1_000):
        monkeypatch.setattr(M, "CELLS", cells)
        parts = list(M.grids(tracks, 0, 9))
        assert [p.begin + i for p in parts for i in range(len(p.size))] == list(range(9)) and sum(p.there.sum() for p in parts) == 18
        assert all(len(p.size) == 1 or len(p.size) * len(p.times) <= cells for p in parts)
    assert np.isnan(parts[0].lat[:, 0]).sum() == 8


@pytest.mark.parametrize("name", ["compare_tracks", "compare_months"])
def test_pairs_of_tracks_are_not_sent(spark, data, name):
    plan = entry.queries()[name](spark, data)._jdf.queryExecution().executedPlan().toString()
    assert not re.search(r"Exchange hashpartitioning\(a#\d+L?, b#\d+L?, \d+\)", plan) and "MapInArrow" in plan


def test_a_track_with_two_rows_of_one_time_is_refused(spark):
    rows = spark.createDataFrame([(1, 45_290.0, 10.0, 10.0, 1e5)] * 2, "tid bigint, time double, lat double, lon double, p_cent double").withColumn("type", F.lit(1))
    with pytest.raises(Exception, match="several rows of one time"):
        S.compare_tracks(rows, rows).collect()
