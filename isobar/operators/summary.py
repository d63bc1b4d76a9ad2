"""Per-track measures over observations (tid, time, lat, lon, ...), one shuffle on the track id."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from isobar.functions.geo import haversine, in_box
from isobar.operators import match as M
from isobar.sources.shared import written

#: Extremes of a track: name, column, whether the largest counts.
EXTREMES = (("max_uv", "uv", True), ("max_dpdt", "dpdt", False), ("max_depth", "depth", True), ("min_p", "p_cent", False), ("max_dsqp", "dsqp", True))


def with_shape(obs: DataFrame) -> DataFrame:
    """Adds depth and radius; both null where the pressure or area is missing."""
    return obs.withColumn("depth", F.col("p_edge") - F.col("p_cent")).withColumn("radius", F.sqrt(F.col("area") / math.pi))


def kinematics(obs: DataFrame, key: str = "tid") -> DataFrame:
    """Adds Dp, Dx, Dy, speeds u, v, uv (km/h, unsigned) and the latitude-scaled dpdt (per day) against the step before.

    Null on a track's first row and where the time doesn't move.
    """
    w = W.partitionBy(key).orderBy("time")
    last = lambda c: F.lag(c).over(w)
    out = obs.withColumn("_dt", F.nullif(F.col("time") - last("time"), F.lit(0.0)))
    out = out.withColumns({"_lat": last("lat"), "_lon": last("lon"), "dp": F.col("p_cent") - last("p_cent"), "dx": F.col("x") - last("x"), "dy": F.col("y") - last("y")})
    hours = F.col("_dt") * 24
    speed = lambda a, b, c, d: haversine(a, b, c, d, "km") / hours
    lat, lon, lat0, lon0 = (F.col(c) for c in ("lat", "lon", "_lat", "_lon"))
    out = out.withColumns({"u": speed(lat, lat, lon0, lon), "v": speed(lat0, lat, lon, lon), "uv": speed(lat0, lat, lon0, lon)})
    scale = math.sin(math.pi / 3) / F.nullif(F.sin(F.radians(lat)), F.lit(0.0))
    return out.withColumn("dpdt", F.col("dp") / F.col("_dt") * scale).drop("_dt", "_lat", "_lon")


def nullify(obs: DataFrame, when: Column, ptid: Column) -> DataFrame:
    """Rows where ``when`` holds become placeholders: no area, no pressure, position and flags kept."""
    zero = {c: F.when(when, F.lit(0).cast(obs.schema[c].dataType)).otherwise(F.col(c)) for c in ("area", "centers", "radius", "type") if c in obs.columns}
    gone = {c: F.when(~when, F.col(c)) for c in ("dpdt", "dsqp", "depth", "p_cent", "p_edge") if c in obs.columns}
    return obs.withColumns(zero | gone | {"ptid": F.when(when, ptid).otherwise(F.col("ptid")) if "ptid" in obs.columns else F.when(when, ptid)})


def track_summary(obs: DataFrame, key: str = "tid") -> DataFrame:
    """One row for each track: lifespan, pressure, depth, intensity, area, multi-centre flag."""
    live = F.col("type") != 0
    return with_shape(obs).groupBy(key).agg(
        F.count(F.lit(1)).alias("n_obs"), (F.max("time") - F.min(F.when(live, F.col("time")))).alias("lifespan"),
        F.min("p_cent").alias("minp"), F.avg("p_cent").alias("avgp"), F.max("depth").alias("maxdepth"), F.avg("depth").alias("avgdepth"),
        F.max("dsqp").alias("maxdsqp"), F.avg("dsqp").alias("avgdsqp"), F.avg(F.when(live, F.col("area"))).alias("avgarea"), F.max("area").alias("maxarea"),
        F.max(F.when(live & (F.col("centers") != 1), 1).otherwise(0)).alias("mcc"),
    )


def track_length(obs: DataFrame, key: str = "tid") -> DataFrame:
    """trlen: hours of the first step times the summed speed of live rows and lysis rows (km)."""
    first = W.partitionBy(key).orderBy("time")
    counted = (F.col("type") != 0) | (F.col("ely") > 0 if "ely" in obs.columns else F.lit(False))
    moved = kinematics(obs, key).withColumn("_n", F.row_number().over(first)).withColumn("_t0", F.lag("time").over(first))
    step = F.max(F.when(F.col("_n") == 2, (F.col("time") - F.col("_t0")) * 24))
    return moved.groupBy(key).agg((step * F.sum(F.when(counted, F.col("uv")))).alias("trlen"), F.avg("uv").alias("avguv"))


def max_displacement(obs: DataFrame, key: str = "tid") -> DataFrame:
    """maxdisp: the farthest a track ever is from its first row (km)."""
    w = W.partitionBy(key).orderBy("time").rowsBetween(W.unboundedPreceding, 0)
    from_start = haversine(F.first("lat").over(w), F.col("lat"), F.first("lon").over(w), F.col("lon"), "km")
    return obs.withColumn("_d", from_start).groupBy(key).agg(F.max("_d").alias("maxdisp"))


def precipitation(obs: DataFrame, key: str = "tid", column: str = "precip") -> DataFrame:
    """cap: precipitation of a track's live rows, missing values left out."""
    return obs.groupBy(key).agg(F.coalesce(F.sum(F.when(F.col("type") != 0, F.col(column))), F.lit(0.0)).alias("cap"))


def extremes(obs: DataFrame, key: str = "tid", digits: int | None = None) -> DataFrame:
    """(key, extreme, value, time, y, x): where each track has its extremes, all ties; ``digits`` rounds uv and dpdt before."""
    rows = with_shape(kinematics(obs, key))
    if digits is not None:
        rows = rows.withColumns({c: F.round(c, digits) for c in ("uv", "dpdt")})
    w = W.partitionBy(key)
    best = rows.withColumns({f"_{name}": (F.max if largest else F.min)(column).over(w) for name, column, largest in EXTREMES})
    hits = F.array(*[F.when(F.col(column) == F.col(f"_{name}"), F.struct(F.lit(name).alias("extreme"), F.col(column).cast("double").alias("value"))) for name, column, _ in EXTREMES])
    return best.select(key, "time", "y", "x", F.explode(F.filter(hits, lambda h: h.isNotNull())).alias("h")).select(key, "h.extreme", "h.value", "time", "y", "x")


def track_filter(obs: DataFrame, lifespan: float = 1, length: float = 1000, displacement: float = 0, max_lat: float | None = None, strict: bool = False, key: str = "tid") -> DataFrame:
    """Ids of tracks that last, run and get far enough; ``strict`` asks for more than the lifespan."""
    # a row for each track, written, so that a task holds the sorted rows of one measure and not of all three
    lasts, lengths, farthest = (written(f) for f in (track_summary(obs, key).select(key, "lifespan"), track_length(obs, key), max_displacement(obs, key)))
    facts = lasts.join(lengths, key).join(farthest, key)
    long = F.col("lifespan") > lifespan if strict else F.col("lifespan") >= lifespan
    kept = facts.where(long & (F.col("trlen") >= length) & (F.col("maxdisp") >= displacement))
    if max_lat is not None:
        kept = kept.join(obs.groupBy(key).agg(F.max("lat").alias("top")).where(F.col("top") >= max_lat), key)
    return kept.select(key, "lifespan", "trlen", "maxdisp")


def hourly(obs: DataFrame, step: float = 0.25, parts: int = 6, key: str = "tid", columns: Sequence[str] = ("lat", "lon")) -> DataFrame:
    """Positions at ``parts`` points of each step, by straight lines to the next row; the end isn't included.

    y and x are interpolated and cut to whole cells.
    """
    w = W.partitionBy(key).orderBy("time")
    names = [*columns, "y", "x"]
    rows = obs.select(key, "time", *names, *[F.lead(c).over(w).alias(f"_{c}") for c in ("time", *names)]).where(F.col("_time").isNotNull())
    cut = rows.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))))
    share = F.col("part") / F.lit(float(parts))
    at = lambda c: F.col(c) + (F.col(f"_{c}") - F.col(c)) * share
    return cut.select(key, at("time").alias("time"), "part", *[at(c).alias(c) for c in columns], *[at(c).cast("int").alias(c) for c in ("y", "x")])


def box_crossing(obs: DataFrame, south: float, north: float, west: float, east: float, least: int = 1, key: str = "tid") -> DataFrame:
    """Tracks with at least so many live rows inside a box, which may cross the antimeridian."""
    inside = obs.where((F.col("type") != 0) & in_box(F.col("lat"), F.col("lon"), south, north, west, east))
    return inside.groupBy(key).agg(F.count(F.lit(1)).alias("n_inside"), F.min("time").alias("first_inside")).where(F.col("n_inside") >= least)


def mask_crossing(obs: DataFrame, region: DataFrame, values: Sequence[int], key: str = "tid", parts: int = 6) -> DataFrame:
    """Tracks whose hourly positions touch a cell of one of the region values."""
    wanted = region.where(F.col("region").isin(list(values))).select("y", "x").distinct()
    return hourly(obs, parts=parts, key=key).join(wanted, ["y", "x"], "left_semi").groupBy(key).agg(F.min("time").alias("first_inside"), F.count(F.lit(1)).alias("n_inside"))


def region_of(points: DataFrame, region: DataFrame, out: str = "region") -> DataFrame:
    """Region value of each point's cell; null outside."""
    return points.join(region.select("y", "x", F.col("region").alias(out)), ["y", "x"], "left")


def end_regions(obs: DataFrame, region: DataFrame, key: str = "tid") -> DataFrame:
    """gen_reg and lys_reg: the region of a track's first live row and of its last row."""
    rows = obs.groupBy(key).agg(F.min(F.when(F.col("type") > 0, F.struct("time", "y", "x"))).alias("g"), F.max(F.struct("time", "y", "x")).alias("l"))
    reg = region.select("y", "x", "region")
    one = rows.select(key, F.col("g.y").alias("y"), F.col("g.x").alias("x"), F.col("l.y").alias("ly"), F.col("l.x").alias("lx"))
    first = one.join(reg.withColumnRenamed("region", "gen_reg"), ["y", "x"], "left").drop("y", "x")
    return first.withColumnsRenamed({"ly": "y", "lx": "x"}).join(reg.withColumnRenamed("region", "lys_reg"), ["y", "x"], "left").select(key, "gen_reg", "lys_reg")


def related_events(events: DataFrame, kept: DataFrame, kept_before: DataFrame | None = None, month_start: float | None = None, key: str = "tid") -> DataFrame:
    """Events of kept tracks whose other track is kept too: this month's against ``kept``, earlier ones against ``kept_before``."""
    own = events.join(kept.select(key), key, "left_semi")
    ids = lambda frame: frame.select(F.col(key).alias("otid")).distinct()
    if kept_before is None:
        return own.join(ids(kept), "otid", "left_semi")
    now = own.where(F.col("time") >= month_start).join(ids(kept), "otid", "left_semi")
    return now.unionByName(own.where(F.col("time") < month_start).join(ids(kept_before), "otid", "left_semi"))


def event_counts(events: DataFrame, key: str = "tid", compat: bool = False) -> DataFrame:
    """mrg1-3, spl1-3, rge2 of each track and the flags mrg, spl, nonint.

    ``compat`` counts a split of type 2 twice, one of type 3 three times, and no regenesis.
    """
    one = lambda kind, t, w=1: F.sum(F.when((F.col("event") == kind) & (F.col("etype") == t), w).otherwise(0)).cast("bigint")
    counts = {f"{n}{t}": one(kind, t, t if compat and kind == "sp" else 1) for kind, n in (("mg", "mrg"), ("sp", "spl")) for t in (1, 2, 3)}
    made = events.groupBy(key).agg(*[c.alias(n) for n, c in counts.items()], (one("rg", 2) * (0 if compat else 1)).alias("rge2"))
    mrg, spl = ((F.col(f"{n}2") >= 1) | (F.col(f"{n}3") >= 1) for n in ("mrg", "spl"))
    return made.withColumns({"mrg": mrg.cast("int"), "spl": spl.cast("int"), "nonint": (~mrg & ~spl).cast("int")})


def summary_units(summary: DataFrame, cell_km: float) -> DataFrame:
    """Summary columns in hPa and square kilometres."""
    scale = {c: 0.01 for c in ("avgp", "minp", "avgdepth", "maxdepth")} | {c: cell_km**2 for c in ("avgarea", "maxarea")} | {c: 0.01 * (100 / cell_km) ** 2 for c in ("avgdsqp", "maxdsqp")}
    return summary.withColumns({c: F.col(c) * f for c, f in scale.items() if c in summary.columns})


def export_rows(obs: DataFrame, cell_km: float, key: str = "tid") -> DataFrame:
    """Observation rows for export: date parts, hPa, km, km2, hPa per (100 km)2, flags last."""
    from isobar.functions.caltime import timestamp_of

    rows = with_shape(kinematics(obs, key))
    ts = timestamp_of(F.col("time"))
    out = {
        "year": F.year(ts), "month": F.month(ts), "day": F.dayofmonth(ts), "hour": F.hour(ts),
        "p_cent": F.col("p_cent") / 100, "p_edge": F.col("p_edge") / 100, "depth": F.col("depth") / 100, "dsqp": F.col("dsqp") / 100 * (100 / cell_km) ** 2,
        "radius": F.col("radius") * cell_km, "area": F.col("area") * cell_km**2, "dp": F.col("dp") / 100, "dpdt": F.col("dpdt") / 100,
    }
    return rows.select(key, *[c.alias(n) for n, c in out.items()], "time", "lat", "lon", "x", "y", "u", "v", "uv", "id", "type", "centers")


def independent_runs(obs: DataFrame, key: str = "tid") -> DataFrame:
    """Gaps and islands: the stretches in which a track is its own parent (ptid = tid) and live, numbered from 0.

    The row after a stretch closes it as a placeholder.
    """
    w = W.partitionBy(key).orderBy("time")
    own = (F.col("ptid") == F.col(key)) & (F.col("type") != 0)
    marked = obs.withColumn("_own", own.cast("int")).withColumn("_before", F.coalesce(F.lag("_own").over(w), F.lit(0)))
    kept = marked.withColumn("run", F.sum(F.when((F.col("_own") == 1) & (F.col("_before") == 0), 1).otherwise(0)).over(w.rowsBetween(W.unboundedPreceding, 0)) - 1)
    rows = kept.where((F.col("_own") == 1) | (F.col("_before") == 1)).withColumn("closes", F.col("_own") == 0)
    return rows.drop("_own", "_before")


def compare_tracks(first: DataFrame, second: DataFrame, min_match: float = 0.6, max_separation: float = 500, key: str = "tid") -> DataFrame:
    """Each track of the first set with its nearest match in the second.

    Two tracks match if twice their shared times is at least ``min_match`` of all their times and
    they are nearer than ``max_separation`` km on average; the nearest wins, ties by id.  Tracks
    without a match have a null ``match``.
    """
    a, b = (s.where(F.col("type") != 0).select(F.col(key).alias(n), F.round(F.col("time") * 24, 3).alias("h"), "lat", "lon", "p_cent") for s, n in ((first, "a"), (second, "b")))
    best = M.nearest(M.as_rows(a, "a"), M.as_rows(b, "b"), float(max_separation), min_match)
    rows = best.join(a.select("a", "h", "p_cent").hint("merge"), "a").join(b.select("b", "h", F.col("p_cent").alias("p2")).hint("merge"), ["b", "h"])
    found = rows.groupBy("a", "b", "shared", "separation").agg(F.avg(F.col("p2") - F.col("p_cent")).alias("dp"))
    return a.select("a").distinct().join(found.hint("merge"), "a", "left").select(F.col("a").alias(key), F.col("b").alias("match"), "shared", "separation", "dp")


def compare_months(first: DataFrame, second: DataFrame, min_match: float = 0.6, max_separation: float = 500, key: str = "tid") -> DataFrame:
    """Each track of the first set with its best match among the second set's tracks of the same month, or of the month before.

    A track is of the month in which it ends; the month before is looked at if the track began before its
    own.  Tracks match if twice their shared times is at least ``min_match`` of all their times and they are less than
    ``max_separation`` km apart on average; the nearest is the best, ties by month (its own first) and id.
    Differences are first less second, averaged over the shared times where both are known.  A pair that is
    near enough on average is so at some time, so pairs are found by time and cubes of that width.
    """
    from isobar.operators.seams import month_of

    def rows(tracks: DataFrame, n: str) -> DataFrame:
        return with_shape(tracks.where(F.col("type") != 0)).select(F.col(key).alias(n), F.round(F.col("time") * 24, 3).alias("h"), "time", "lat", "lon", "p_cent", "area", "depth", "dsqp")

    a, b = rows(first, "a"), rows(second, "b")
    month, begins = month_of(F.max("time")), month_of(F.min("time"))
    best = M.nearest(M.as_rows(a, "a", month, begins), M.as_rows(b, "b", month, begins), float(max_separation), min_match, monthly=True)
    values = ["p_cent", "area", "depth", "dsqp"]
    # sizes after Python are guesses, so nothing here may be broadcast on one
    pairs = best.join(a.select("a", "h", *values).hint("merge"), "a").join(b.select("b", "h", *[F.col(c).alias(f"{c}2") for c in values]).hint("merge"), ["b", "h"])
    found = pairs.groupBy("a", "b", "matches", "separation", "back").agg(*[F.avg(F.col(c) - F.col(f"{c}2")).alias(f"{c}_diff") for c in values])
    out = a.groupBy("a").agg(month.alias("month_a")).join(found.hint("merge"), "a", "left")
    year = lambda c: F.floor(c / 12).cast("int") + 1900
    calendar = lambda c: (c % 12 + 1).cast("int")
    month_a, month_b = F.col("month_a"), F.col("month_a") - F.col("back")
    return out.select(
        F.col("a").alias(f"{key}1"), year(month_a).alias("year1"), calendar(month_a).alias("month1"), F.coalesce("matches", F.lit(0)).cast("bigint").alias("num_matches"),
        F.col("b").alias(f"{key}2"), year(month_b).alias("year2"), calendar(month_b).alias("month2"), F.col("separation").alias("dist"), *[f"{c}_diff" for c in values],
    )


def match_step(before: DataFrame, after: DataFrame, reach_km: float, red: float = 0.75) -> DataFrame:
    """One tracking step as a join: centres (t, id, lat, lon[, u, v in km/h, hours]) against those of the next t.

    A centre goes on if some centre is within reach of both its position and its projection; it then
    goes to the one nearest to the projection of all, ties by id.  Cubes of the reach's width are the
    join key, so that a projection meets its own and the neighbouring ones alone.
    """
    from isobar.functions.geo import add_lat, add_long, dist2lat, dist2long, near_cells, space_cell

    hours = F.coalesce(F.col("hours"), F.lit(6.0)) if "hours" in before.columns else F.lit(6.0)
    move = lambda c: F.coalesce(F.col(c), F.lit(0.0)) * red * hours if c in before.columns else F.lit(0.0)
    lat_q, lon_q = add_lat(F.col("lat"), dist2lat(move("v"))), add_long(F.col("lon"), F.coalesce(dist2long(move("u"), F.col("lat"), F.col("lat")), F.lit(0.0)))
    left = before.select("t", F.col("id").alias("id1"), F.col("lat").alias("lat1"), F.col("lon").alias("lon1"), lat_q.alias("latq"), lon_q.alias("lonq"))
    place = ["t", "lat1", "lon1", "latq", "lonq"]
    # centres of one place and projection share their answer, and of those in one place the first id alone can be it
    asked = left.select(*place).distinct().withColumn("c", near_cells(space_cell(F.col("latq"), F.col("lonq"), reach_km))).select(*place, "c.*")
    cell = [c.alias(n) for c, n in zip(space_cell(F.col("lat2"), F.col("lon2"), reach_km), ("cx", "cy", "cz"), strict=True)]
    right = after.groupBy((F.col("t") - 1).alias("t"), F.col("lat").alias("lat2"), F.col("lon").alias("lon2")).agg(F.min("id").alias("id2")).select("*", *cell)
    # sizes after an explode are guessed too small: nothing may be broadcast on a guess
    pairs = asked.join(right.hint("merge"), ["t", "cx", "cy", "cz"])
    d = haversine(F.col("lat1"), F.col("lat2"), F.col("lon1"), F.col("lon2"), "km")
    dq = haversine(F.col("latq"), F.col("lat2"), F.col("lonq"), F.col("lon2"), "km")
    near = pairs.withColumns({"distance": d, "projected": dq}).where(F.col("projected") <= reach_km)
    # the nearest to the projection is among these, as there is one within reach of it
    best = near.groupBy(*place).agg(F.min(F.struct("projected", "id2", "distance")).alias("b"), F.min("distance").alias("least")).where(F.col("least") <= reach_km)
    return left.join(best.hint("merge"), place).select("t", "id1", F.col("b.id2").alias("id2"), F.col("b.distance").alias("distance"), F.col("b.projected").alias("projected"))
