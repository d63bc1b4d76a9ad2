"""Tracking: centres of successive time steps linked into tracks with a life cycle.

A :class:`Tracker` takes one time step of typed centres at a time and emits the observations and
events of that step; it holds only the latest step and what is open, so it runs alike over a
sorted batch, month by month with saved state, or in a stream.  Detection, the expensive part, is
done before, for all steps in parallel; here a step is tens of rows.
"""

from __future__ import annotations

import copy
import math
import pickle
from collections.abc import Iterator
from dataclasses import dataclass, field as of

import pandas as pd
from pyspark.sql import DataFrame, Window as W, functions as F

from isobar.sources.shared import written

GE, LY, SP, MG, RG = "ge", "ly", "sp", "mg", "rg"
#: Event types: of the centre, of the area, of both.
CENTER, AREA, BOTH = 1, 2, 3
FLAGS = {GE: "ege", LY: "ely", SP: "esp", MG: "emg", RG: "erg"}

OBS_SCHEMA = "grid string, tid bigint, time double, id int, pid int, y int, x int, lat double, lon double, p_cent double, p_edge double, area bigint, dsqp double, type int, centers int, ptid bigint, u double, v double, uv double, dpdt double, ege int, ely int, esp int, emg int, erg int"
EVENT_SCHEMA = "grid string, tid bigint, time double, id int, event string, etype int, otid bigint, y int, x int"


def distance(lat1: float, lat2: float, lon1: float, lon2: float) -> float:
    """Metres on the sphere."""
    a, b = math.radians(lat1), math.radians(lat2)
    h = math.sin((b - a) / 2) ** 2 + math.cos(a) * math.cos(b) * math.sin(math.radians(lon2 - lon1) / 2) ** 2
    return 2 * 6371000.0 * math.asin(math.sqrt(min(h, 1.0)))


@dataclass
class Center:
    """A centre of one step; ``parent`` is the id of its system's primary, itself if it is one."""

    time: float
    id: int
    y: int
    x: int
    lat: float
    lon: float
    p_cent: float
    p_edge: float
    area: int
    dsqp: float
    type: int
    parent: int
    centers: int
    tid: int = -1

    @property
    def depth(self) -> float:
        return self.p_edge - self.p_cent


@dataclass
class Row:
    """A track's observation of one step, still open to changes."""

    center: Center
    ptid: int | None
    u: float | None = None
    v: float | None = None
    uv: float | None = None
    dpdt: float | None = None
    dead: bool = False
    flags: dict = of(default_factory=dict)


@dataclass
class Settings:
    reach: float = 900_000.0  #: metres a centre can move in a step
    red: float = 0.75  #: share of the last motion that the projection keeps
    hours: float = 6.0
    signed: bool = False  #: project along the true direction; otherwise north and east, as speeds are unsigned


class Tracker:
    """State between two steps: the latest centres, each open track's latest row, and the next id."""

    def __init__(self, settings: Settings | None = None, grid: str = "0") -> None:
        self.settings, self.grid = settings or Settings(), grid
        self.centers: list[Center] = []
        self.rows: dict[int, Row] = {}
        self.last: dict[int, Row] = {}
        self.parents: dict[int, int | None] = {}
        #: Time and place among the births of its step, of tracks that are open or somebody's parent.
        self.born: dict[int, tuple[float, int]] = {}
        self.next = self.first = 0
        self.time: float | None = None
        self.out_rows: list[tuple] = []
        self.out_events: list[tuple] = []
        self.events: list[list] = []

    def save(self) -> bytes:
        return pickle.dumps(self)

    @staticmethod
    def load(state: bytes) -> Tracker:
        return pickle.loads(state)

    # -- parts of a step

    def _birth(self) -> int:
        tid, self.next = self.next, self.next + 1
        self.born[tid] = self.time, tid - self.first
        return tid

    def _new(self, c: Center, etype: int, ptid: int | None) -> int:
        tid = self._birth()
        c.tid = tid
        self.rows[tid] = Row(c, ptid)
        self.parents[tid] = ptid
        self._event(tid, c, GE, etype)
        return tid

    def _extend(self, tid: int, c: Center) -> None:
        before = self.last[tid].center
        days = c.time - before.time
        row = Row(c, self.parents[tid])
        if days:
            km = lambda *a: distance(*a) / 1000 / 24 / days
            row.u, row.v, row.uv = km(c.lat, c.lat, before.lon, c.lon), km(before.lat, c.lat, c.lon, c.lon), km(before.lat, c.lat, before.lon, c.lon)
            if math.sin(math.radians(c.lat)) and not self.last[tid].dead:
                row.dpdt = (c.p_cent - before.p_cent) / days * math.sin(math.pi / 3) / math.sin(math.radians(c.lat))
        c.tid = tid
        self.rows[tid] = row

    def _event(self, tid: int, c: Center, event: str, etype: int, otid: int | None = None) -> None:
        self.events.append([tid, c, event, etype, otid])
        self.rows[tid].flags[FLAGS[event]] = etype

    def _bury(self, tid: int, ptid: int | None) -> None:
        row = self.rows[tid]
        row.dead, row.ptid, row.dpdt = True, ptid, None

    def _alive(self, tid: int, rows: dict[int, Row]) -> bool:
        return tid in rows and not rows[tid].dead

    def _projected(self, c: Center) -> tuple[float, float]:
        row, s = self.last[c.tid], self.settings
        if row.u is None:
            return c.lat, c.lon
        per = math.degrees(s.red * s.hours / 6371.0)
        north, east = row.v * per, 2 * math.degrees(math.asin(min(1.0, math.sin(math.radians(row.u * per) / 2) / max(math.cos(math.radians(c.lat)), 1e-9))))
        if s.signed:
            north, east = north * row.flags.get("_north", 1), east * row.flags.get("_east", 1)
        lat, lon = c.lat + north, c.lon + east
        lat = 180 - lat if lat > 90 else -180 - lat if lat < -90 else lat
        return lat, lon - 360 if lon > 180 else lon + 360 if lon < -180 else lon

    # -- a step

    def step(self, centers: list[Center], time: float | None = None) -> None:
        """Advance to the next time step; ``centers`` come in the order of id, which is their place.

        An empty step (its ``time`` has to be given) ends all tracks.  So does a gap: where ``centers``
        come later than one step after the latest, the step in between counts as empty.
        """
        time = centers[0].time if centers else time
        if time is None:
            raise ValueError("an empty step needs its time")
        due = None if self.time is None else self.time + self.settings.hours / 24
        if due is not None and centers and time > due + self.settings.hours / 48:
            self._step([], due)
        self._step(centers, time)

    def _step(self, centers: list[Center], time: float) -> None:
        self.rows, self.events, self.time, self.first = {}, [], time, self.next
        before, self.centers = self.centers, centers
        if not self.last:
            for c in centers:
                self._new(c, BOTH if c.type != 2 else CENTER, None)
            for c in centers:  # a system's parent is its primary's track
                self.parents[c.tid] = self.rows[c.tid].ptid = centers[c.parent].tid
        else:
            came, ways = self._match(before, centers, time)
            self._seat(before, centers, came, ways)
            self._beginnings(before, centers, came, ways)
            self._regroup(before, centers)
            self._primaries(centers)
            tids = [c.tid for c in centers]
            if len(set(tids)) != len(tids):
                raise RuntimeError("two centres share a track")
        self._finish(time)

    def _match(self, before: list[Center], centers: list[Center], time: float) -> tuple[list[list[int]], dict[int, list[tuple[float, int]]]]:
        """(the former centres that each centre is nearest to, by projection; the other places each former centre could go, nearest first)."""
        came: list[list[int]] = [[] for _ in centers]
        ways: dict[int, list[tuple[float, int]]] = {}
        reach = self.settings.reach
        for i, c in enumerate(before):
            guess = self._projected(c)
            moves = [(distance(guess[0], d.lat, guess[1], d.lon), distance(c.lat, d.lat, c.lon, d.lon)) for d in centers]
            fits = sum(max(m) <= reach for m in moves)
            if not fits:
                gone = copy.copy(c)
                gone.time = time
                self._extend(c.tid, gone)
                self._bury(c.tid, c.tid)
                self._event(c.tid, gone, LY, BOTH)
                continue
            best = min(range(len(centers)), key=lambda k: (moves[k][0], k))
            self._extend(c.tid, centers[best])
            came[best].append(i)
            ways[i] = sorted((m[1], k) for k, m in enumerate(moves) if k != best)[: fits - 1]
        return came, ways

    def _seat(self, before: list[Center], centers: list[Center], came: list[list[int]], ways: dict) -> None:
        """Of several former centres at one place, one stays; the others go to a free place they could reach, or merge."""
        for k, here in enumerate(centers):
            if len(came[k]) < 2:
                continue
            stays = self._survivor(before, came[k], here)
            here.tid = before[stays].tid
            for i in [j for j in came[k] if j != stays]:
                free = next((to for _, to in ways.get(i, ()) if not came[to]), None)
                if free is not None:
                    self._extend(before[i].tid, centers[free])
                    came[free].append(i)
                    came[k].remove(i)
                else:
                    self._merge(before[i], before[stays], here)
            here.tid = before[stays].tid

    def _survivor(self, before: list[Center], arrivals: list[int], here: Center) -> int:
        """The nearest arrival, or the deepest if two are nearest; its parent track instead, if that arrives as well."""
        away = sorted((distance(before[i].lat, here.lat, before[i].lon, here.lon), i) for i in arrivals)
        tie = away[0][0] == away[1][0]
        first = min(arrivals, key=lambda i: (-before[i].depth, i)) if tie else away[0][1]
        heads = {before[i].tid: i for i in arrivals if i != first}
        return heads.get(self.last[before[first].tid].ptid, first)

    def _merge(self, lost: Center, into: Center, here: Center) -> None:
        etype = CENTER if lost.parent == into.parent else BOTH
        for a, b in ((into.tid, lost.tid), (lost.tid, into.tid)):
            self._event(a, here, MG, etype, b)
        self._event(lost.tid, here, LY, etype)
        self._bury(lost.tid, into.tid)

    def _beginnings(self, before: list[Center], centers: list[Center], came: list[list[int]], ways: dict) -> None:
        """Tracks of the centres that no former one came to: split off from the nearest that could have, or born."""
        sources: dict[int, list[tuple[float, int]]] = {}
        for i, places in ways.items():
            for d, k in places:
                if not came[k]:
                    sources.setdefault(k, []).append((d, i))
        for k, here in enumerate(centers):
            if came[k]:
                continue
            if k in sources:
                self._split(before[min(sources[k])[1]], here, centers)
                continue
            mates = [m for m, c in enumerate(centers) if c.parent == here.parent]
            joins = len(mates) > 1 and (here.type == 2 or any(came[m] or m in sources for m in mates))
            tid = self._new(here, CENTER if joins else BOTH, None)
            if not joins:
                self.parents[tid] = self.rows[tid].ptid = tid

    def _split(self, source: Center, here: Center, centers: list[Center]) -> None:
        tid = self._birth()
        # the new track begins a step earlier, as a placeholder where it split off
        start = Row(copy.copy(source), source.tid, dead=True)
        self.last[tid], self.parents[tid] = start, source.tid
        self._emit(tid, start)
        self._extend(tid, here)
        other = here if self.rows[source.tid].dead else centers[self.rows[source.tid].center.id]
        same = other is not here and other.parent == here.parent
        etype = CENTER if same else BOTH
        self._event(tid, here, GE, etype)
        self._event(source.tid, other, SP, etype, tid)
        self._event(tid, here, SP, etype, source.tid)
        if not same:
            self.parents[tid] = self.rows[tid].ptid = tid

    def _regroup(self, before: list[Center], centers: list[Center]) -> None:
        """Events of areas, from which tracks shared a system before and which share one now."""
        was, now = ({c.tid: c for c in step} for step in (before, centers))
        go_on = [t for t in now if t in was]

        def pairs(own: dict[int, Center], other: dict[int, Center]) -> Iterator[tuple[int, int]]:
            """Ordered pairs of lasting tracks that share a system in ``own`` and don't in ``other``."""
            systems: dict[int, list[int]] = {}
            for t in go_on:
                systems.setdefault(own[t].parent, []).append(t)
            return ((a, b) for mates in systems.values() for a in mates for b in mates if a != b and other[a].parent != other[b].parent)

        for a, b in pairs(now, was):
            self._event(a, now[a], MG, AREA, b)
        for a, b in pairs(was, now):
            self._event(a, now[a], SP, AREA, b)
            if self.last[a].ptid != a:
                self._own(a, GE, AREA)
        for c in before:
            if c.centers == 1 or c.tid in now:
                continue
            if self.last[c.tid].ptid != c.tid:
                # a secondary's end is one of its centre alone
                self.rows[c.tid].flags[FLAGS[LY]] = CENTER
                for e in self.events:
                    if e[0] == c.tid and e[2] == LY:
                        e[3] = CENTER
                continue
            left = [m.tid for m in before if m.parent == c.parent and m.tid in now]
            if left:
                heir = min(left, key=lambda t: (now[t].p_cent, was[t].id))
                self._own(heir, GE, AREA)
                self._event(heir, now[heir], RG, AREA, c.tid)

    def _own(self, tid: int, event: str, etype: int) -> None:
        """A track heads a system of its own from here on."""
        self.rows[tid].ptid = self.parents[tid] = tid
        self._event(tid, self.rows[tid].center, event, etype)

    def _primaries(self, centers: list[Center]) -> None:
        """The parent of each system's tracks: of those that lasted, the deepest one's; of new ones the deepest itself."""
        systems: dict[int, list[Center]] = {}
        for c in centers:
            if c.centers > 1:
                systems.setdefault(c.parent, []).append(c)
        for mates in systems.values():
            lasted = [m for m in mates if self._alive(m.tid, self.last)]
            deepest = min(lasted or mates, key=lambda m: (-m.depth, m.id)).tid
            primary = deepest if len(lasted) < 2 or self.rows[deepest].ptid is None else self.rows[deepest].ptid
            for m in mates:
                row = self.rows[m.tid]
                row.ptid = self.parents[m.tid] = primary
                if m.tid != primary and row.flags.get(FLAGS[MG]) == AREA and row.flags.get(FLAGS[LY]) != AREA:
                    self._event(m.tid, m, LY, AREA, primary)

    def _emit(self, tid: int, r: Row) -> None:
        c, dead = r.center, r.dead
        self.out_rows.append((
            self.grid, tid, c.time, c.id, c.parent, c.y, c.x, c.lat, c.lon, None if dead else c.p_cent, None if dead else c.p_edge, 0 if dead else c.area,
            None if dead else c.dsqp, 0 if dead else c.type, 0 if dead else c.centers, r.ptid, r.u, r.v, r.uv, r.dpdt, *(r.flags.get(f, 0) for f in ("ege", "ely", "esp", "emg", "erg")),
        ))

    def _finish(self, time: float | None) -> None:
        for tid, r in self.rows.items():
            if self.settings.signed and tid in self.last:
                old = self.last[tid].center
                r.flags["_north"] = -1 if r.center.lat < old.lat else 1
                r.flags["_east"] = -1 if (r.center.lon - old.lon + 540) % 360 - 180 < 0 else 1
            self._emit(tid, r)
        for tid, c, event, etype, otid in self.events:
            self.out_events.append((self.grid, tid, time, c.id, event, etype, otid, c.y, c.x))
        ended = [tid for tid, r in self.rows.items() if r.dead]
        self.last = {tid: r for tid, r in self.rows.items() if not r.dead}
        for tid in ended:
            self.parents.pop(tid, None)
        known = {*self.last, *self.parents.values(), *(r.ptid for r in self.last.values())}
        self.born = {tid: when for tid, when in self.born.items() if tid in known}

    def joints(self) -> tuple[str, list[int]]:
        """(what the coming steps depend on, without names of tracks; the tracks that it speaks of).

        Two trackers with equal texts go on alike, with the n-th track of one list as the n-th of the other.
        """
        if not self.last:
            return "", []
        tids = [c.tid for c in self.centers]
        place = {tid: k for k, tid in enumerate(tids)}

        def of(tid: int | None) -> object:
            if tid is None or tid in place:
                return None if tid is None else place[tid]
            if tid not in tids:
                tids.append(tid)
            # a parent that has ended is known by its birth
            return self.born[tid], tids.index(tid)

        rows = [self.last[c.tid] for c in self.centers]
        parts = [(of(self.parents[c.tid]), of(r.ptid), r.u, r.v, r.flags.get("_north"), r.flags.get("_east")) for c, r in zip(self.centers, rows, strict=True)]
        return repr((self.time, parts)), tids

    def take(self) -> tuple[pd.DataFrame, pd.DataFrame]:
        """What was emitted since the last call."""
        rows, events = self.out_rows, self.out_events
        self.out_rows, self.out_events = [], []
        names = lambda s: [c.split()[0] for c in s.split(", ")]
        return pd.DataFrame(rows, columns=names(OBS_SCHEMA)), pd.DataFrame(events, columns=names(EVENT_SCHEMA))


def centers_of(frame: pd.DataFrame) -> list[Center]:
    """Centres of one step, numbered anew by id so that a centre's id is its place."""
    frame = frame.sort_values("id")
    place = {int(i): k for k, i in enumerate(frame["id"])}
    return [
        Center(float(r.time), k, int(r.y), int(r.x), float(r.lat), float(r.lon), float(r.p_cent), float(r.p_edge), int(r.area), float(r.dsqp) if r.dsqp is not None else math.nan, int(r.type), place.get(int(r.parent), k), int(r.centers))
        for k, r in enumerate(frame.itertuples())
    ]


def track(centers: DataFrame, settings: Settings | None = None, grid: str = "grid") -> tuple[DataFrame, DataFrame]:
    """(observations, events) of all tracks; columns of OBS_SCHEMA and EVENT_SCHEMA.

    centers: grid, time and the columns of a typed centre.  Steps of a grid follow each other every
    ``hours``; one that is missing ends all tracks.  They are read in time order, one step in memory
    at a time; grids (regions, data sets, members) are independent and run in parallel.
    """
    rows_of, events_of = (_tracked(centers, settings or Settings(), grid, part) for part in (0, 1))
    return rows_of, events_of


def _tracked(centers: DataFrame, settings: Settings, grid: str, part: int) -> DataFrame:
    schema = (OBS_SCHEMA, EVENT_SCHEMA)[part]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        tracker, held = None, pd.DataFrame()
        for batch in batches:
            held = pd.concat([held, batch]) if len(held) else batch
            if not len(held):
                continue
            latest = (held["grid"] == held["grid"].iloc[-1]) & (held["time"] == held["time"].iloc[-1])
            for key, step in held[~latest].groupby(["grid", "time"], sort=False):
                tracker = _stepped(tracker, key[0], step, settings)
            held = held[latest]
            if tracker is not None:
                yield tracker.take()[part]
        if len(held):
            was = tracker
            tracker = _stepped(tracker, held["grid"].iloc[0], held, settings)
            if was is not None and was is not tracker:
                yield was.take()[part]
            yield tracker.take()[part]

    def _stepped(tracker: Tracker | None, name: str, step: pd.DataFrame, settings: Settings) -> Tracker:
        if tracker is None or tracker.grid != name:
            fresh = Tracker(settings, name)
            if tracker is not None:
                fresh.out_rows, fresh.out_events = tracker.out_rows, tracker.out_events
            tracker = fresh
        tracker.step(centers_of(step))
        return tracker

    ordered = centers.withColumn("grid", F.col(grid).cast("string")).repartition("grid").sortWithinPartitions("grid", "time", "id")
    return ordered.mapInPandas(run, schema)


def split_active(obs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(active, inactive): tracks without and with a lysis of the centre; active ones numbered anew, the old id in ftid."""
    ended = obs.where(F.col("ely").isin(CENTER, BOTH)).select("grid", "tid").distinct()
    active = obs.join(ended, ["grid", "tid"], "left_anti")
    ids = active.select("grid", "tid").distinct()
    numbered = ids.withColumn("new", F.row_number().over(W.partitionBy("grid").orderBy("tid")) - 1)
    parents = numbered.select("grid", F.col("tid").alias("ptid"), F.col("new").alias("newp"))
    out = active.join(numbered, ["grid", "tid"]).join(parents, ["grid", "ptid"], "left")
    out = out.withColumn("ftid", F.col("tid")).withColumn("tid", F.col("new").cast("bigint")).withColumn("ptid", F.coalesce("newp", "ptid").cast("bigint")).drop("new", "newp")
    return out, obs.join(ended, ["grid", "tid"], "left_semi")


def realign(tracks: DataFrame, centers: DataFrame) -> DataFrame:
    """Centres of a final step with the tid of the track that has them there; fails if their numbers differ."""
    last = tracks.groupBy("grid", "tid").agg(F.max(F.struct("time", "id")).alias("l")).select("grid", "tid", F.col("l.time").alias("time"), F.col("l.id").alias("id"))
    if last.count() != centers.count():
        raise ValueError("the number of tracks isn't that of the centres")
    return centers.drop("tid").join(last, ["grid", "time", "id"], "left")


def systems(obs: DataFrame, events: DataFrame, regenesis: bool = True) -> tuple[DataFrame, DataFrame]:
    """(observations, events) of system tracks: each follows the primary centre.

    A track is cut into the stretches in which it is its own parent; each is a system and ends in a
    placeholder.  With ``regenesis``, a system that revives a dead one is spliced to its end: the dead
    one's rows but the last come first, and both have one id, that of the reviving system.
    """
    from isobar.operators.summary import nullify

    keyed = obs.withColumn("key", F.concat_ws(":", "grid", F.col("tid").cast("string")))
    rows = nullify(_runs(keyed), F.col("closes"), F.col("ptid")).drop("closes")
    rows = rows.withColumn("sid", F.concat_ws(":", "key", F.col("run").cast("string")))
    marks = events.withColumn("key", F.concat_ws(":", "grid", F.col("tid").cast("string")))
    spans = rows.groupBy("key", "sid").agg(F.min("time").alias("from"), F.max("time").alias("to"))
    placed = marks.join(spans, "key").where((F.col("time") >= F.col("from")) & (F.col("time") <= F.col("to")))
    if regenesis:
        dead = spans.select(F.col("key").alias("dead_key"), F.col("sid").alias("dead_sid"), F.col("to").alias("at"))
        revived = placed.where("event = 'rg'").select("sid", F.concat_ws(":", "grid", F.col("otid").cast("string")).alias("dead_key"), F.col("time").alias("at"))
        links = revived.join(dead, ["dead_key", "at"]).select("dead_sid", F.col("sid").alias("heir"), "at")
        names = _chains(links)
        moved = rows.join(names, rows["sid"] == names["dead_sid"], "left")
        rows = moved.where(F.col("at").isNull() | (F.col("time") < F.col("at"))).withColumn("sid", F.coalesce("heir", "sid")).drop("dead_sid", "heir", "at")
        rows = rows.withColumns({c: F.when(F.col("erg") > 0, 0).otherwise(F.col(c)).cast("int") for c in ("ely", "ege")})
        moved = placed.join(names, placed["sid"] == names["dead_sid"], "left")
        placed = moved.where(F.col("at").isNull() | (F.col("time") < F.col("at"))).withColumn("sid", F.coalesce("heir", "sid")).drop("dead_sid", "heir", "at")
    return rows.drop("key", "run"), placed.drop("key", "from", "to")


def _runs(keyed: DataFrame) -> DataFrame:
    w = W.partitionBy("key").orderBy("time")
    own = (F.col("ptid") == F.col("tid")) & (F.col("type") != 0)
    marked = keyed.withColumn("_own", F.coalesce(own.cast("int"), F.lit(0))).withColumn("_before", F.coalesce(F.lag("_own").over(w), F.lit(0)))
    run = F.sum(F.when((F.col("_own") == 1) & (F.col("_before") == 0), 1).otherwise(0)).over(w.rowsBetween(W.unboundedPreceding, 0)) - 1
    kept = marked.withColumn("run", run).where((F.col("_own") == 1) | (F.col("_before") == 1))
    return kept.withColumn("closes", F.col("_own") == 0).drop("_own", "_before")


def _chains(links: DataFrame) -> DataFrame:
    """dead_sid, heir, at with heirs that died and were revived themselves resolved, by doubling until no heir is dead."""
    out = links
    while True:
        further = out.select(F.col("dead_sid").alias("heir"), F.col("heir").alias("next"))
        if out.join(further, "heir", "left_semi").isEmpty():
            return out
        out = out.join(further, "heir", "left").select("dead_sid", F.coalesce("next", "heir").alias("heir"), "at")
        out = written(out)
