"""Moisture along tracks: samples, ages, regions, budget terms, attribution of parts."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window as W, functions as F

from isobar.operators.raster import Offset, _literal

def environment_samples(points: DataFrame, values: DataFrame, offsets: Sequence[Offset]) -> DataFrame:
    """``points`` (t, y, x, ...) with ``env``: mean of the variable over the disk around, missing cells left out."""
    at = points.select("t", F.col("y").alias("cy"), F.col("x").alias("cx")).distinct().withColumn("o", F.explode(_literal(offsets)))
    at = at.select("t", "cy", "cx", (F.col("cy") + F.col("o.dy")).alias("y"), (F.col("cx") + F.col("o.dx")).alias("x"))
    made = at.join(values, ["t", "y", "x"]).groupBy("t", "cy", "cx").agg(F.avg("v").alias("env")).withColumnsRenamed({"cy": "y", "cx": "x"})
    return points.join(made, ["t", "y", "x"], "left")


def ages(rows: DataFrame, key: str = "tid", inner: bool = True) -> DataFrame:
    """Adds age, 0 at a track's first row and 1 at its last; ``inner`` leaves out both ends."""
    w = W.partitionBy(key)
    out = rows.withColumn("age", F.try_divide(F.col("time") - F.min("time").over(w), F.max("time").over(w) - F.min("time").over(w)))
    return out.where((F.col("age") > 0) & (F.col("age") < 1)) if inner else out


def prior_position(rows: DataFrame, share: float, columns: Sequence[str] = ("y", "x"), key: str = "tid") -> DataFrame:
    """Positions a share of the step back, as whole cells; the first row has no earlier one and stays."""
    w = W.partitionBy(key).orderBy("time")
    back = lambda c: F.coalesce(F.lag(c).over(w), F.col(c))
    return rows.withColumns({f"{c}_prior": (F.col(c) * (1 - share) + back(c) * share).cast("int") for c in columns})


def age_in_region(rows: DataFrame, key: str = "tid") -> DataFrame:
    """Rows up to each track's latest age in the region; tracks that never are there go.  Needs age and regflag."""
    last = F.max(F.when(F.col("regflag") == 1, F.col("age"))).over(W.partitionBy(key))
    return rows.withColumn("maxage", last).where(F.col("age") <= F.col("maxage"))


def in_out_split(rows: DataFrame, columns: Sequence[str], key: str = "tid") -> DataFrame:
    """Per track: means of each column inside and before the region, side by side, with the numbers of rows.

    A track with no rows before the region has 0 there.
    """
    made = rows.groupBy(key, "regflag").agg(*[F.avg(c).alias(c) for c in columns], F.count(F.lit(1)).alias("n"))
    side = lambda flag, end: made.where(F.col("regflag") == flag).select(key, *[F.col(c).alias(f"{c}_{end}") for c in (*columns, "n")])
    both = side(1, "in").join(side(0, "out"), key, "left")
    return both.withColumns({f"{c}_out": F.coalesce(F.col(f"{c}_out"), F.lit(0)) for c in (*columns, "n")})


def budget_terms(frame: DataFrame) -> DataFrame:
    """Local and imported water of storms from tcw_first, tcw_last, e_in, e_out, adv_in, adv_out, tp_in.

    ``final_in`` and ``final_out`` share the precipitation by where its water came from.
    """
    c = F.col
    out = frame.withColumns({
        "max_out": c("tcw_first") + c("e_out") + c("adv_out"), "tcw_diff": c("tcw_last") - c("tcw_first"), "min_out": F.greatest(c("adv_in"), F.lit(0.0)),
    })
    out = out.withColumn("most_out", F.greatest(c("max_out"), c("min_out"))).withColumn("supply", c("most_out") + F.greatest(c("e_in"), F.lit(0.0)))
    share = F.try_divide(c("most_out"), c("supply"))
    out = out.withColumns({"final_out": c("tp_in") * share, "final_in": c("tp_in") * (1 - share)})
    return out.withColumns({"final_resid": c("supply") - c("tp_in") - c("tcw_diff"), "tp_resid": c("tp_in") - c("final_in") - c("final_out")})


def efficiency(frame: DataFrame) -> DataFrame:
    """peff = tp / tcw; pratio = tp / (-(e + viwvd)); null where the divisor is 0."""
    return frame.withColumns({"peff": F.try_divide(F.col("tp"), F.col("tcw")), "pratio": F.try_divide(F.col("tp"), -(F.col("e") + F.col("viwvd")))})


def track_table(rows: DataFrame, firsts: Sequence[str], sums: Sequence[str], means: Sequence[str], key: str = "tid") -> DataFrame:
    """Per track: first and last (by time), sum, mean, largest and least of columns."""
    made = [F.min_by(c, "time").alias(f"{c}_first") for c in firsts] + [F.max_by(c, "time").alias(f"{c}_last") for c in firsts]
    made += [F.sum(c).alias(f"{c}_sum") for c in sums]
    made += [f(c).alias(f"{c}_{n}") for c in means for f, n in ((F.avg, "avg"), (F.max, "max"), (F.min, "min"))]
    return rows.groupBy(key).agg(*made)


def by_seasons(rows: DataFrame, keys: Sequence[str], columns: Sequence[str], how: str = "mean") -> DataFrame:
    """Means or sums of months over the overlapping three-month seasons, by end month; a row belongs to three seasons."""
    ends = rows.withColumn("k", F.explode(F.array(F.lit(0), F.lit(1), F.lit(2)))).withColumn("_m", F.col("month") - 1 + F.col("k"))
    ends = ends.withColumns({"endmonth": (F.col("_m") % 12 + 1).cast("int"), "season_year": (F.col("year") + F.floor(F.col("_m") / 12)).cast("int")})
    agg = F.avg if how == "mean" else F.sum
    return ends.groupBy(*keys, "season_year", "endmonth").agg(*[agg(c).alias(c) for c in columns])
