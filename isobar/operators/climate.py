"""Seasons, climatologies and trends of monthly values."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window as W, functions as F

from isobar.functions.caltime import month_index
from isobar.functions.stats import trend


def monthly(rows: DataFrame, keys: Sequence[str], value: str = "value") -> DataFrame:
    """total, mean and n of each month."""
    return rows.groupBy(*keys, "year", "month").agg(F.sum(value).alias("total"), F.avg(value).alias("mean"), F.count(value).alias("n"))


def three_month(months: DataFrame, keys: Sequence[str], value: str = "total") -> DataFrame:
    """Sum over each month and the two before, across years; only where all three months are there."""
    i = month_index(F.col("year"), F.col("month"))
    w = W.partitionBy(*keys).orderBy("_i").rangeBetween(-2, 0)
    out = months.withColumn("_i", i).withColumn("season_total", F.sum(value).over(w)).withColumn("_n", F.count(F.lit(1)).over(w))
    return out.where("_n = 3").drop("_i", "_n")


def seasonal_climatology(months: DataFrame, keys: Sequence[str], first_year: int, last_year: int) -> DataFrame:
    """Per end month: the mean three-month sum over the years, and their number."""
    seasons = three_month(months, keys).where(F.col("year").between(first_year, last_year))
    return seasons.groupBy(*keys, "month").agg(F.avg("season_total").alias("clim"), F.count(F.lit(1)).alias("years"))


def pooled_climatology(months: DataFrame, keys: Sequence[str], first_year: int, last_year: int, weight: str | None = None) -> DataFrame:
    """Per end month: the mean of the monthly means of its three months over the years, weighted if asked."""
    ends = months.where(F.col("year").between(first_year, last_year)).withColumn("endmonth", F.explode(F.transform(F.array(F.lit(0), F.lit(1), F.lit(2)), lambda k: (F.col("month") - 1 + k) % 12 + 1)))
    mean = F.try_divide(F.sum(F.col("mean") * F.col(weight)), F.sum(F.when(F.col("mean").isNotNull(), F.col(weight)))) if weight else F.avg("mean")
    return ends.groupBy(*keys, "endmonth").agg(mean.alias("clim"), F.count("mean").alias("months"))


def seasonal_trend(months: DataFrame, keys: Sequence[str], min_n: int = 10, p_values: bool = False) -> DataFrame:
    """Least-squares trend of the three-month sums over the years, by end month."""
    return trend(three_month(months, keys).select(*keys, "month", "year", "season_total"), [*keys, "month"], "year", "season_total", min_n, p_values)


def monthly_trend(months: DataFrame, keys: Sequence[str], value: str = "total", min_n: int = 10, p_values: bool = False) -> DataFrame:
    return trend(months, [*keys, "month"], "year", value, min_n, p_values)


def cap_decomposition(cells: DataFrame, keys: Sequence[str] = ("y", "x")) -> DataFrame:
    """Per cell: precipitation events, total and rate; storms, storm hours, mean speed and its inverse; what the product leaves.

    cells: one row for each time a storm precipitates on a cell, with cap, sid, uv.
    """
    made = cells.groupBy(*keys).agg(
        F.count("cap").alias("ncap"), F.sum("cap").alias("captot"), F.avg("cap").alias("caprate"), F.countDistinct("sid").alias("ncyc"),
        F.count("sid").alias("hcyc"), F.avg("uv").alias("uv"),
    )
    inverse = F.try_divide(F.lit(1.0), F.col("uv"))
    return made.withColumn("uvinv", inverse).withColumn("capresid", F.col("captot") - F.col("ncyc") * F.col("caprate") * F.try_divide(F.col("hcyc"), F.col("ncyc")))


def cyclone_share(part, whole):
    """Share of a total; +inf counts as 1, anything else undefined is null."""
    return F.when((whole == 0) & (part > 0), F.lit(1.0)).otherwise(F.try_divide(part, whole))
