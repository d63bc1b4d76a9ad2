"""Tracking as a stream: steps of centres arrive, observations leave as they are settled.

The state of a grid is one :class:`~isobar.operators.track.Tracker` plus the steps that wait for
the watermark; a step is taken once nothing earlier can come.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from isobar.operators.track import EVENT_SCHEMA, OBS_SCHEMA, Settings, Tracker, centers_of


class TrackingProcessor(StatefulProcessor):
    def __init__(self, settings: Settings | None = None, part: int = 0) -> None:
        self.settings, self.part = settings or Settings(), part

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("tracker", "state binary")

    def _load(self, grid: str) -> tuple[Tracker, pd.DataFrame]:
        found = self.state.get()
        return pickle.loads(found[0]) if found else (Tracker(self.settings, grid), pd.DataFrame())

    def _taken(self, grid: str, until: float) -> pd.DataFrame:
        tracker, held = self._load(grid)
        if len(held):
            for _, step in held[held["time"] <= until].sort_values(["time", "id"]).groupby("time"):
                tracker.step(centers_of(step))
            held = held[held["time"] > until]
        rows = tracker.take()[self.part]
        self.state.update((pickle.dumps((tracker, held)),))
        return rows

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        tracker, held = self._load(key[0])
        new = pd.concat([held, *rows]) if len(held) else pd.concat(list(rows))
        self.state.update((pickle.dumps((tracker, new.drop(columns="ts", errors="ignore"))),))
        mark = timerValues.getCurrentWatermarkInMs()
        for day in sorted(set(new["time"])):
            self.handle.registerTimer(int(_millis(day)))
        yield self._taken(key[0], _days(mark))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        yield self._taken(key[0], _days(expiredTimerInfo.getExpiryTimeInMs()))

    def close(self) -> None:
        pass


EPOCH_DAYS = 25567.0  #: days from 1900-01-01 to 1970-01-01


def _millis(days: float) -> float:
    return (days - EPOCH_DAYS) * 86_400_000


def _days(millis: int) -> float:
    return millis / 86_400_000 + EPOCH_DAYS + 1e-9


def track_stream(centers: DataFrame, delay: str = "12 hours", settings: Settings | None = None) -> DataFrame:
    """Observations (columns of OBS_SCHEMA) from a stream of typed centres with grid and ts; steps later than ``delay`` are dropped."""
    marked = centers.withWatermark("ts", delay)
    return marked.groupBy("grid").transformWithStateInPandas(TrackingProcessor(settings), OBS_SCHEMA, "Append", "EventTime")


def track_event_stream(centers: DataFrame, delay: str = "12 hours", settings: Settings | None = None) -> DataFrame:
    """Life-cycle events (columns of EVENT_SCHEMA) of the same stream, as a query of its own."""
    marked = centers.withWatermark("ts", delay)
    return marked.groupBy("grid").transformWithStateInPandas(TrackingProcessor(settings, 1), EVENT_SCHEMA, "Append", "EventTime")


def window_counts(events: DataFrame, delay: str = "1 hour", width: str = "6 hours", slide: str | None = None) -> DataFrame:
    """Life-cycle events per window and kind, with late rows allowed for ``delay``."""
    window = F.window("ts", width, slide) if slide else F.window("ts", width)
    return events.withWatermark("ts", delay).groupBy(window.alias("w"), "event").agg(F.count(F.lit(1)).alias("n")).select("w.start", "w.end", "event", "n")
