"""Readers and writers, by what comes back from files they wrote."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from isobar.functions.caltime import calendar_add, fixed_calendar_date, fixed_calendar_days
from isobar.operators.traj import LEVELS, level_pressure, total_cloud_water
from isobar.plans.adapters import FIELD_SQL, OBS_SQL, SHAPE, field, obs, read
from isobar.plans.climate_queries import MONTH_SQL, months
from isobar.plans.registry import query
from isobar.sources import readers as R, writers as W
from isobar.sources.geotiff import GeoTiff
from isobar.sources.npz import NpzTrajectories
from isobar.sources.shared import shared_folder


def folder(spark) -> str:
    """A fresh folder in the one that all executors share."""
    return f"{shared_folder(spark)}/files-{uuid.uuid4().hex}"


ROWS_SQL = "SELECT tid, id, event_type, lat, lon, p_cent FROM obs"


def event_rows(spark, sf_dir):
    return obs(spark, sf_dir).select("tid", "id", "event_type", "lat", "lon", "p_cent")


SCHEMA = "tid bigint, id bigint, event_type string, lat double, lon double, p_cent double"


@query(f"WITH {OBS_SQL} {ROWS_SQL}")
def csv_round_trip(spark, sf_dir):
    """Written in files of 1,000 rows and read again by schema."""
    path = folder(spark)
    W.write_csv(event_rows(spark, sf_dir), path, rows_per_file=1000)
    return R.read_table(spark, path, SCHEMA)


@query(f"WITH {OBS_SQL} {ROWS_SQL} WHERE p_cent IS NOT NULL")
def csv_skip_and_drop(spark, sf_dir):
    """Files that begin with two lines of remarks; rows with a missing value are left out."""
    path = folder(spark)
    cells = [F.coalesce(F.col(c).cast("string"), F.lit("nan")) for c in ("tid", "id", "event_type", "lat", "lon", "p_cent")]
    lines = event_rows(spark, sf_dir).select(F.concat_ws(",", *cells).alias("value"), F.lit(1).alias("kind"), "tid")
    heads = spark.range(4).select(F.explode(F.array(F.lit("# made"), F.lit("# of rows"))).alias("value"), F.lit(0).alias("kind"), F.col("id").alias("tid"))
    # the file of each remainder begins with its own remarks
    whole = lines.withColumn("part", F.col("tid") % 4).unionByName(heads.withColumn("part", F.col("tid") % 4))
    whole.repartition(4, "part").sortWithinPartitions("part", "kind").select("part", "value").write.partitionBy("part").text(path)
    return R.read_table(spark, f"{path}/part=*/*.txt", SCHEMA, skip=2, drop_incomplete=True)


@query(f"WITH {OBS_SQL} {ROWS_SQL}")
def csv_parts_by_pattern(spark, sf_dir):
    """Several tables of one pattern, read as one."""
    path = folder(spark)
    rows = event_rows(spark, sf_dir)
    for k in range(2):
        W.write_csv(rows.where(F.col("tid") % 2 == k), f"{path}/table_{k}")
    return R.read_parts(spark, f"{path}/table_*", SCHEMA)


MONTHS_SQL = f"{MONTH_SQL}, base AS (SELECT region, year, month, round(total, 3) AS total FROM mo WHERE year BETWEEN 1995 AND 2001)"


def month_rows(spark, sf_dir):
    return months(spark, sf_dir).where(F.col("year").between(1995, 2001)).select("region", "year", "month", F.round("total", 3).alias("total"))


@query(f"WITH {MONTHS_SQL} SELECT region, year, month, CASE WHEN year = 1996 AND month = 2 THEN -total ELSE total END AS total FROM base")
def months_overwritten(spark, sf_dir):
    """A table by month, of which one month is written anew; the others stay."""
    path, rows = folder(spark), month_rows(spark, sf_dir)
    W.write_months(rows, path)
    W.write_months(rows.where("year = 1996 AND month = 2").withColumn("total", -F.col("total")), path)
    return R.read_months(spark, path, (1995, 1), (2001, 12), rows.schema).select(*rows.columns)


@query(f"WITH {MONTHS_SQL} SELECT region, year, month, total FROM base WHERE year*12 + month BETWEEN 1995*12 + 12 AND 1996*12 + 2")
def months_with_neighbours(spark, sf_dir):
    path, rows = folder(spark), month_rows(spark, sf_dir)
    W.write_months(rows, path)
    return R.with_neighbour_months(spark, path, 1996, 1, rows.schema).select(*rows.columns)


@query(f"WITH {MONTHS_SQL} SELECT region, year, month, total FROM base WHERE year = 1996 AND month % 3 > 0")
def months_missing(spark, sf_dir):
    """Months that were never written are empty, wherever they lie in the range that is read."""
    path, rows = folder(spark), month_rows(spark, sf_dir)
    W.write_months(rows.where("year = 1996 AND month % 3 > 0"), path)
    return R.read_months(spark, path, (1890, 1), (1997, 2), rows.schema).select(*rows.columns)


@query(f"""WITH {FIELD_SQL}, c AS (SELECT 2000 + CAST(t // 12 AS INTEGER) AS year, CAST(t % 12 + 1 AS INTEGER) AS month, y, x, CASE WHEN x = 0 THEN NULL ELSE v END AS v FROM field)
 SELECT 'p' AS variable, 'Pa' AS units, year, month, y, x, v FROM c""")
def cube_appended(spark, sf_dir):
    """A cube written by years, the later one first; zeros are missing; the units come from the table beside it."""
    path = folder(spark)
    rows = field(spark, sf_dir).select(F.lit("p").alias("variable"), (2000 + F.expr("t div 12")).cast("int").alias("year"), (F.col("t") % 12 + 1).cast("int").alias("month"), "y", "x", F.when(F.col("x") == 0, 0.0).otherwise(F.col("v")).alias("v"))
    for part in (F.col("year") > 2000, F.col("year") == 2000):
        W.write_cube(rows.where(part), path, {"p": {"units": "Pa", "long_name": "pressure"}})
    names = spark.read.parquet(f"{path}_variables").select(F.col("name").alias("variable"), "units")
    return R.read_cube(spark, [f"{path}-none", path]).join(F.broadcast(names), "variable").select("variable", "units", "year", "month", "y", "x", "v")


@query(f"WITH {FIELD_SQL} SELECT t, y, x, CASE WHEN t IN (1, 3) THEN v + 1 ELSE v END AS v FROM field")
def times_replaced(spark, sf_dir):
    cube = field(spark, sf_dir)
    return W.replace_times(cube, cube.where("t IN (1, 3)").withColumn("v", F.col("v") + 1))


@query("SELECT o_orderkey, CAST(year(o_orderdate)*365 + [0, 31, 59, 90, 120, 151, 181, 212, 243, 273, 304, 334][month(o_orderdate)] + least(day(o_orderdate), 28) - 366 AS BIGINT) AS n365, CAST((year(o_orderdate) - 1)*360 + (month(o_orderdate) - 1)*30 + least(day(o_orderdate), 28) - 1 AS BIGINT) AS n360, CAST(year(o_orderdate) AS INTEGER) AS year, CAST(month(o_orderdate) AS INTEGER) AS month, CAST(least(day(o_orderdate), 28) AS INTEGER) AS day, true AS back FROM orders")
def fixed_calendars(spark, sf_dir):
    """Days of calendars of 365 and 360 days a year, and the way back."""
    d = F.col("o_orderdate")
    dates = read(spark, sf_dir, "orders").select("o_orderkey", F.year(d).alias("year"), F.month(d).alias("month"), F.least(F.dayofmonth(d), F.lit(28)).alias("day"))
    made = dates.withColumns({f"n{k}": fixed_calendar_days(F.col("year"), F.col("month"), F.col("day"), k) for k in (365, 360)})
    same = F.lit(True)
    for k in (365, 360):
        same = same & (fixed_calendar_date(F.col(f"n{k}"), k) == F.struct("year", "month", "day"))
    return made.withColumn("back", same)


@query(f"WITH {OBS_SQL} SELECT tid, k, [1500, 2250, 2625, 3000, 5500][1 + id % 5] AS height, [850, 770, 735, 700, 500][1 + id % 5] AS pressure FROM obs")
def level_pressures(spark, sf_dir):
    heights = F.element_at(F.array(*[F.lit(h) for h in LEVELS]), (F.col("id") % len(LEVELS) + 1).cast("int"))
    levels = F.create_map(*[F.lit(v) for h in LEVELS for v in (h, level_pressure(h))])
    return obs(spark, sf_dir).select("tid", "k", heights.alias("height")).withColumn("pressure", F.element_at(levels, F.col("height")))


@query("SELECT l_orderkey, l_linenumber, round(l_tax + l_discount, 9) AS cwc FROM lineitem")
def cloud_water(spark, sf_dir):
    rows = read(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_tax").alias("ciwc"), F.col("l_discount").alias("clwc"))
    return total_cloud_water(rows).withColumn("cwc", F.round("cwc", 9))


@query(f"WITH {MONTH_SQL} SELECT a.region, a.year, a.month, round(a.total + b.mean, 4) AS both FROM mo a JOIN mo b USING (region, year, month)")
def month_tables_merged(spark, sf_dir):
    """Two tables merged on region, year and month."""
    rows = months(spark, sf_dir)
    keys = ["region", "year", "month"]
    return rows.select(*keys, "total").join(rows.select(*keys, "mean"), keys).select(*keys, F.round(F.col("total") + F.col("mean"), 4).alias("both"))


@query(f"WITH {FIELD_SQL} SELECT t, y, x, v FROM field")
def geotiff_round_trip(spark, sf_dir):
    """A raster for each step; cells that a step lacks are no data."""
    spark.dataSource.register(GeoTiff)
    path = folder(spark)
    cells = field(spark, sf_dir).repartition("t").sortWithinPartitions("t", "y", "x")
    cells.write.format("geotiff").mode("append").options(rows=SHAPE[0], columns=SHAPE[1], scale="1.5,0.9", corner="-20,45").save(path)
    return spark.read.format("geotiff").load(path).where("v IS NOT NULL")


@query(f"WITH {OBS_SQL} SELECT CAST(tid AS DOUBLE) AS traj_id, CAST(k AS DOUBLE) AS step, lat, lon, p_cent AS pressure FROM obs")
def npz_round_trip(spark, sf_dir):
    """Archives of ranges of trajectories, about 500 rows each, read in runs of 200 rows."""
    spark.dataSource.register(NpzTrajectories)
    path = folder(spark)
    rows = obs(spark, sf_dir).select(F.col("tid").alias("traj_id"), F.col("k").alias("step"), "lat", "lon", F.col("p_cent").alias("pressure"))
    rows.repartitionByRange("traj_id").sortWithinPartitions("traj_id", "step").write.format("npz").mode("append").option("rows", 500).save(path)
    return spark.read.format("npz").option("rows", 200).load(path).drop("archive", "row")


STEP_SQL = "s AS (SELECT o_orderkey AS k, year(o_orderdate) - o_custkey % 3000 AS y, month(o_orderdate) AS m, day(o_orderdate) AS d, hour(o_orderdate)*3600 AS sec, o_orderkey % 7 - 3 AS ys, o_orderkey % 50 - 25 AS ms, (o_orderkey % 1000 - 500)*0.25e0 AS ds FROM orders)"


def _fixed_sql(days_per_year: int) -> str:
    """DuckDB text of a step in a calendar of so many days; there is no year 0."""
    starts = "[0, 31, 59, 90, 120, 151, 181, 212, 243, 273, 304, 334]"
    start = f"{starts}[mm]" if days_per_year == 365 else "(mm - 1)*30"
    length = "[31, 28, 31, 30, 31, 30, 31, 31, 30, 31, 30, 31][mm]" if days_per_year == 365 else "30"
    month = f"len(list_filter({starts}, lambda z: z <= r))" if days_per_year == 365 else "r // 30 + 1"
    day = f"r - {starts}[len(list_filter({starts}, lambda z: z <= r))] + 1" if days_per_year == 365 else "r % 30 + 1"
    return f"""WITH {STEP_SQL}, a AS (SELECT *, CASE WHEN y > 0 THEN y - 1 ELSE y END*12 + m - 1 + ys*12 + ms AS n FROM s WHERE y <> 0), b AS (SELECT *, CAST(floor(n/12.0e0) AS BIGINT) AS yy, CAST(n - 12*floor(n/12.0e0) AS BIGINT) + 1 AS mm FROM a),
 c AS (SELECT *, yy*{days_per_year} + {start} + CASE WHEN ys <> 0 OR ms <> 0 THEN least(d, {length}) ELSE d END - 1 + CAST(floor((ds*86400 + sec)/86400) AS BIGINT) AS days, (ds*86400 + sec) - 86400*floor((ds*86400 + sec)/86400) AS seconds FROM b),
 e AS (SELECT *, CAST(floor(days/{days_per_year}.0e0) AS BIGINT) AS q, CAST(days - {days_per_year}*floor(days/{days_per_year}.0e0) AS BIGINT) AS r FROM c)
 SELECT k, CAST(CASE WHEN q >= 0 THEN q + 1 ELSE q END AS INTEGER) AS year, CAST({month} AS INTEGER) AS month, CAST({day} AS INTEGER) AS day, seconds FROM e"""


def _stepped(spark, sf_dir, back: int, days_per_year: int, leap_years: bool):
    d = F.col("o_orderdate")
    rows = read(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("k"), (F.year(d) - F.col("o_custkey") % back).alias("y"), F.month(d).alias("m"), F.dayofmonth(d).alias("d"), (F.hour(d) * 3600).alias("sec"),
        (F.col("o_orderkey") % 7 - 3).alias("ys"), (F.col("o_orderkey") % 50 - 25).alias("ms"), ((F.col("o_orderkey") % 1000 - 500) * 0.25).alias("ds"),
    ).where("y <> 0")
    if leap_years:
        rows = rows.withColumn("d", F.least("d", F.lit(28)))
    step = {"years": F.col("ys"), "months": F.col("ms"), "days": F.col("ds")}
    return rows.select("k", calendar_add(F.col("y"), F.col("m"), F.col("d"), F.col("sec"), step, days_per_year, leap_years).alias("a")).select("k", "a.*")


@query(_fixed_sql(360))
def calendar_step_360(spark, sf_dir):
    return _stepped(spark, sf_dir, 3000, 360, False)


@query(_fixed_sql(365))
def calendar_step_365(spark, sf_dir):
    return _stepped(spark, sf_dir, 3000, 365, False)


@query(f"""WITH {STEP_SQL.replace('% 3000', '% 300')}, a AS (SELECT k, make_timestamp(y, m, least(d, 28), 0, 0, 0) + to_years(CAST(ys AS INTEGER)) + to_months(CAST(ms AS INTEGER)) + to_seconds(ds*86400 + sec) AS ts FROM s)
 SELECT k, CAST(year(ts) AS INTEGER) AS year, CAST(month(ts) AS INTEGER) AS month, CAST(day(ts) AS INTEGER) AS day, CAST(hour(ts)*3600 + minute(ts)*60 + second(ts) AS DOUBLE) AS seconds FROM a""")
def calendar_step_gregorian(spark, sf_dir):
    return _stepped(spark, sf_dir, 300, 365, True)
