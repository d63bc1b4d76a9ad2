"""Tracking of many segments of time at once, joined at their seams.

A segment (a month) is tracked on its own by one task, after a warm-up over the steps before it.  At
a seam the state in which a segment began is held against the one in which the segment before it
ended: if what the coming steps depend on is the same, the segment is what a run over all time would have given, but for the
numbers of its tracks.  Segments that began otherwise are tracked again from the true state, as long
as there are any; with each round at least the first of them is settled.  Tracks that cross a seam are then one
track: their numbers are resolved from segment to segment by doubling, births are counted through,
and so rows, events and numbers are those of a single run, wherever the cuts are.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window as W, functions as F

from isobar.operators.track import BOTH, CENTER, EVENT_SCHEMA, OBS_SCHEMA, Settings, Tracker, centers_of, systems
from isobar.sources.shared import written

ROW, EVENT, STATE = "row", "event", "state"
_STATE = "began string, ended string, begin_tids array<bigint>, end_tids array<bigint>, begin_next bigint, end_next bigint, state binary"
_names = lambda schema: [c.split()[0] for c in schema.split(", ")]
_MORE = [c for c in EVENT_SCHEMA.split(", ") if c.split()[0] not in _names(OBS_SCHEMA)]
#: Rows, events and the state of each segment in one table.
SEGMENT_SCHEMA = ", ".join(["kind string, segment bigint", OBS_SCHEMA, *_MORE, _STATE])
CENTER_COLUMNS = ["time", "id", "y", "x", "lat", "lon", "p_cent", "p_edge", "area", "dsqp", "type", "parent", "centers"]


def month_of(time: Column) -> Column:
    """Months since January 1900 of a time in days since 1900-01-01."""
    day = F.date_add(F.lit("1900-01-01").cast("date"), F.floor(time).cast("int"))
    return ((F.year(day) - 1900) * 12 + F.month(day) - 1).cast("bigint")


def _digest(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def _run(tracker: Tracker, segment: int, warm: pd.DataFrame, own: pd.DataFrame) -> Iterator[pd.DataFrame]:
    for _, step in warm.groupby("time"):
        tracker.step(centers_of(step))
    tracker.take()
    began, first, before = *tracker.joints(), tracker.next
    for _, step in own.groupby("time"):
        tracker.step(centers_of(step))
    rows, events = tracker.take()
    ended, last = tracker.joints()
    state = {"grid": [tracker.grid], "began": [_digest(began)], "ended": [_digest(ended)], "begin_tids": [first], "end_tids": [last], "begin_next": [before], "end_next": [tracker.next], "state": [tracker.save()]}
    for kind, part in ((ROW, rows), (EVENT, events), (STATE, pd.DataFrame(state))):
        yield part.assign(kind=kind, segment=segment).reindex(columns=_names(SEGMENT_SCHEMA))


def _whole(frames: Iterator[pd.DataFrame]) -> pd.DataFrame:
    # missing numbers as None, so that integers stay integers
    return pd.concat([f.astype(object).where(f.notna(), None) if not f.empty else f.astype(object) for f in frames])


def _fresh_runs(centers: DataFrame, settings: Settings) -> DataFrame:
    def run(key: tuple, group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(["time", "id"])
        return _whole(_run(Tracker(settings, key[0]), key[1], group[~group["own"]], group[group["own"]]))

    return centers.groupBy("grid", "segment").applyInPandas(run, SEGMENT_SCHEMA)


def _resumed_runs(centers: DataFrame, states: DataFrame) -> DataFrame:
    """Segments of ``centers`` from the state that ``states`` (grid, segment, state) has for them."""

    def run(key: tuple, group: pd.DataFrame, before: pd.DataFrame) -> pd.DataFrame:
        if group.empty or before.empty:
            return pd.DataFrame(columns=_names(SEGMENT_SCHEMA))
        return _whole(_run(Tracker.load(before["state"].iloc[0]), key[1], group.iloc[:0], group.sort_values(["time", "id"])))

    return centers.groupBy("grid", "segment").cogroup(states.groupBy("grid", "segment")).applyInPandas(run, SEGMENT_SCHEMA)


def _seams(table: DataFrame) -> DataFrame:
    """The segments of a grid with what the one before ended in; a grid has as many rows as segments."""
    w = W.partitionBy("grid").orderBy("segment")
    states = table.where(F.col("kind") == STATE).select("grid", "segment", *_names(_STATE))
    last = {f"last_{c}": F.lag(c).over(w) for c in ("segment", "ended", "end_tids", "begin_next")}
    return states.drop("state").withColumns(last).withColumn("births", F.col("end_next") - F.col("begin_next"))


def _placed(centers: DataFrame, segment: Column, ahead: Column) -> DataFrame:
    """Each row in its own segment, and as warm-up in the next one if that begins within the overlap."""
    rows = centers.withColumn("home", segment).withColumn("segment", F.explode(F.array_distinct(F.array("home", ahead))))
    return rows.withColumn("own", F.col("segment") == F.col("home")).drop("home")


def track_segments(centers: DataFrame, settings: Settings | None = None, overlap: float = 5.0, segment=month_of, grid: str = "grid") -> DataFrame:
    """The settled segments of all grids: SEGMENT_SCHEMA, with numbers of tracks that hold within their segment.

    centers: grid, time in days and the columns of a typed centre; ``segment`` gives the number of a time's
    segment, which has to rise with time.  ``overlap`` days before a segment warm it up; they should be
    less than a segment and only bear on how many segments are tracked twice.
    """
    settings = settings or Settings()
    rows = centers.withColumn("grid", F.col(grid).cast("string")).select("grid", *CENTER_COLUMNS)
    rows = written(_placed(rows, segment(F.col("time")), segment(F.col("time") + F.lit(overlap))))
    alone = rows.where("own").select("grid", "segment").distinct()
    table = written(_fresh_runs(rows.join(alone, ["grid", "segment"], "left_semi"), settings))
    own = rows.where("own").drop("own")
    while True:
        wrong = _seams(table).where(~F.col("began").eqNullSafe(F.coalesce("last_ended", F.lit(_digest("")))))
        wrong = written(wrong.select("grid", "segment", "last_segment"))
        if wrong.isEmpty():
            return table
        states = table.where(F.col("kind") == STATE).select(F.col("grid").alias("_grid"), F.col("segment").alias("_last"), "state")
        before = wrong.join(states, (F.col("grid") == F.col("_grid")) & (F.col("last_segment") == F.col("_last"))).select("grid", "segment", "state")
        again = _resumed_runs(own.join(wrong.select("grid", "segment"), ["grid", "segment"], "left_semi"), before)
        table = written(table.join(wrong.select("grid", "segment"), ["grid", "segment"], "left_anti").select(_names(SEGMENT_SCHEMA)).unionByName(again))


def joined(table: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(observations, events) of settled segments under the numbers of a single run: OBS_SCHEMA and EVENT_SCHEMA."""
    seams = written(_seams(table))
    ahead = W.partitionBy("grid").orderBy("segment").rowsBetween(W.unboundedPreceding, -1)
    counted = seams.select("grid", "segment", "begin_next", F.coalesce(F.sum("births").over(ahead), F.lit(0)).alias("offset"))
    # a track at a seam has two names
    pairs = seams.where("last_segment IS NOT NULL").select("grid", "segment", "last_segment", F.explode(F.arrays_zip("begin_tids", F.col("last_end_tids").alias("end_tids"))).alias("p"))
    links = pairs.select("grid", "segment", F.col("p.begin_tids").alias("tid"), F.col("last_segment").alias("to_segment"), F.col("p.end_tids").alias("to_tid"))
    links = written(_resolved(links))
    home = counted.select("grid", F.col("segment").alias("to_segment"), F.col("begin_next").alias("to_next"), F.col("offset").alias("to_offset"))
    numbers = links.join(home, ["grid", "to_segment"]).select("grid", "segment", "tid", (F.col("to_offset") + F.col("to_tid") - F.col("to_next")).alias("number"))
    names = numbers.groupBy("grid", "segment").agg(F.map_from_entries(F.collect_list(F.struct("tid", "number"))).alias("names"))
    known = counted.join(names, ["grid", "segment"], "left")

    def numbered(kind: str, schema: str, columns: list[str]) -> DataFrame:
        rows = table.where(F.col("kind") == kind).select("segment", *_names(schema)).join(known, ["grid", "segment"])
        name = lambda c: F.when(F.col(c) >= F.col("begin_next"), F.col("offset") + F.col(c) - F.col("begin_next")).otherwise(F.try_element_at("names", F.col(c)))
        return rows.withColumns({c: name(c) for c in columns}).select(_names(schema))

    return numbered(ROW, OBS_SCHEMA, ["tid", "ptid"]), numbered(EVENT, EVENT_SCHEMA, ["tid", "otid"])


def _resolved(links: DataFrame) -> DataFrame:
    """Links (grid, segment, tid) -> (to_segment, to_tid) that lead to the segment of birth, by doubling."""
    out = links
    while True:
        further = out.select("grid", F.col("segment").alias("to_segment"), F.col("tid").alias("to_tid"), F.col("to_segment").alias("next_segment"), F.col("to_tid").alias("next_tid"))
        step = out.join(further, ["grid", "to_segment", "to_tid"], "left")
        moved = F.col("next_tid").isNotNull()
        step = written(step.select("grid", "segment", "tid", F.coalesce("next_segment", "to_segment").alias("to_segment"), F.coalesce("next_tid", "to_tid").alias("to_tid"), moved.alias("moved")))
        out = step.drop("moved")
        if step.where("moved").isEmpty():
            return out


def track_by_segments(centers: DataFrame, settings: Settings | None = None, overlap: float = 5.0, segment=month_of, grid: str = "grid") -> tuple[DataFrame, DataFrame]:
    """(observations, events) of all tracks, as :func:`isobar.operators.track.track` gives them, one task a segment."""
    return joined(track_segments(centers, settings, overlap, segment, grid))


# -- month by month


class MonthStore:
    """Tracks and systems in a folder, month by month: each month is a folder that is replaced as a whole."""

    def __init__(self, spark: SparkSession, folder: str) -> None:
        self.spark, self.folder = spark, folder.rstrip("/")

    def _read(self, name: str, schema: str) -> DataFrame:
        try:
            return self.spark.read.schema(f"{schema}, month bigint").parquet(f"{self.folder}/{name}")
        except AnalysisException as error:
            if error.getCondition() != "PATH_NOT_FOUND":
                raise
            return self.spark.createDataFrame([], f"{schema}, month bigint")

    def _replace(self, frame: DataFrame, name: str, month: int) -> None:
        # a whole folder, so that a month without rows is replaced too
        frame.write.mode("overwrite").parquet(f"{self.folder}/{name}/month={month}")

    def rows(self) -> DataFrame:
        """Observations; month is the one that was tracked (the placeholder of a track that split off in its first step is a step earlier)."""
        return self._read("rows", OBS_SCHEMA)

    def events(self) -> DataFrame:
        return self._read("events", EVENT_SCHEMA)

    def systems(self) -> DataFrame:
        """Observations of systems with sid, in the month in which they end."""
        return self._read("systems", f"{OBS_SCHEMA}, sid string")

    def advance(self, centers: DataFrame, month: int, settings: Settings | None = None) -> None:
        """Track one month from the state in which the latest month before it ended, and put it in place of what is there.

        ``centers`` of other months are left out; grids without any in this month carry their state on.  Running
        the latest month again changes nothing.  A month before the latest can be run again as well, the later ones then follow.
        """
        settings = settings or Settings()
        rows = centers.withColumn("grid", F.col("grid").cast("string")).where(month_of(F.col("time")) == F.lit(month)).select("grid", *CENTER_COLUMNS, F.lit(month).cast("bigint").alias("segment"))
        states = self._read("states", "grid string, state binary").where(F.col("month") < F.lit(month))
        latest = written(states.groupBy("grid").agg(F.max_by("state", "month").alias("state")))
        fresh = rows.join(latest, "grid", "left_anti").withColumn("own", F.lit(True))
        begun = latest.select("grid", F.lit(month).cast("bigint").alias("segment"), "state")
        table = written(_fresh_runs(fresh, settings).unionByName(_resumed_runs(rows.join(latest, "grid", "left_semi"), begun)))
        state = table.where(F.col("kind") == STATE).select("grid", "state")
        self._replace(table.where(F.col("kind") == ROW).select(_names(OBS_SCHEMA)), "rows", month)
        self._replace(table.where(F.col("kind") == EVENT).select(_names(EVENT_SCHEMA)), "events", month)
        self._replace(state.unionByName(latest.join(state, "grid", "left_anti")), "states", month)

    def write_systems(self, month: int, regenesis: bool = True) -> None:
        """Systems of the tracks that end in ``month``, and those of the month before anew.

        A system of this month that revives a dead one takes over its rows, so the dead one leaves the month in which
        it had ended.  Tracks that were revived earlier are read as well, however far back.
        """
        rows, events = self.rows(), self.events()
        ended = rows.where(F.col("ely").isin(CENTER, BOTH)).select("grid", "tid", month_of(F.col("time")).alias("ends")).distinct()
        wanted = written(ended.where(F.col("ends").between(month - 1, month)).select("grid", "tid"))
        revived = events.where("event = 'rg'").select("grid", "tid", "otid")
        while True:
            more = written(revived.join(wanted, ["grid", "tid"], "left_semi").select("grid", F.col("otid").alias("tid")).distinct().join(wanted, ["grid", "tid"], "left_anti"))
            if more.isEmpty():
                break
            wanted = written(wanted.unionByName(more))
        made, _ = systems(rows.drop("month").join(wanted, ["grid", "tid"], "left_semi"), events.drop("month").join(wanted, ["grid", "tid"], "left_semi"), regenesis)
        made = written(made.withColumn("ends", F.max(month_of(F.col("time"))).over(W.partitionBy("sid"))))
        for m in (month - 1, month):
            self._replace(made.where(F.col("ends") == F.lit(m)).select(*_names(OBS_SCHEMA), "sid"), "systems", m)
