"""Readers: stored cubes and months, text tables, trajectory dumps, file catalogues."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window as W, functions as F, types as T

from isobar.functions.caltime import expanded_year


def path_exists(spark: SparkSession, path: str) -> bool:
    """Whether a path or pattern names something, in any store that Spark reads."""
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    found = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).globStatus(where)
    return found is not None and len(found) > 0


def first_path(spark: SparkSession, paths: Sequence[str]) -> str:
    """The first of several folders that is there."""
    for p in paths:
        if path_exists(spark, p):
            return p
    raise FileNotFoundError(f"none of {list(paths)}")


def read_cube(spark: SparkSession, paths: str | Sequence[str], hours: Sequence[int] | None = None, columns: Sequence[str] | None = None) -> DataFrame:
    """A stored cube; times and columns are pruned in the scan.  ``valid_time`` is read as ``time``."""
    cube = spark.read.parquet(first_path(spark, [paths] if isinstance(paths, str) else paths))
    if "time" not in cube.columns and "valid_time" in cube.columns:
        cube = cube.withColumnRenamed("valid_time", "time")
    if hours is not None:
        cube = cube.where(F.col("hour").isin([int(h) for h in hours]))
    return cube.select(*columns) if columns else cube


def read_months(spark: SparkSession, path: str, first: tuple[int, int], last: tuple[int, int], schema: T.StructType | str) -> DataFrame:
    """Rows of the months from first to last (year, month) of a table partitioned by both; missing months give none."""
    if not path_exists(spark, path):
        return spark.createDataFrame([], schema)
    i = F.col("year") * 12 + F.col("month")
    low, high = (y * 12 + m for y, m in (first, last))
    years = F.col("year").between(first[0], last[0])
    return spark.read.parquet(path).where(years & i.between(low, high))


def with_neighbour_months(spark: SparkSession, path: str, year: int, month: int, schema, before: int = 1, after: int = 1) -> DataFrame:
    i = year * 12 + month - 1
    at = lambda k: ((i + k) // 12, (i + k) % 12 + 1)
    return read_months(spark, path, at(-before), at(after), schema)


def read_table(spark: SparkSession, path: str, schema: T.StructType | str, header: bool = True, delimiter: str = ",", skip: int = 0, drop_incomplete: bool = False) -> DataFrame:
    """A delimited table of fixed columns; ``skip`` header lines of each file, rows with a missing value dropped if asked."""
    options = {"header": header and not skip, "sep": delimiter, "mode": "PERMISSIVE", "nanValue": "nan"}
    if skip:
        # header lines are in the first split of a file, so only its lines are numbered
        lines = _lines(spark, path)
        head = lines.where("block = 0").withColumn("line", F.row_number().over(W.partitionBy("file").orderBy("at"))).where(F.col("line") <= skip).select("file", "at")
        rows = lines.join(head, ["file", "at"], "left_anti").where(F.trim("value") != "").select(F.col("value").alias("col"))
        parsed = F.from_csv("col", schema if isinstance(schema, str) else schema.simpleString()[7:-1].replace(":", " "), {"sep": delimiter, "nanValue": "nan"})
        table = rows.select(parsed.alias("r")).select("r.*")
    else:
        table = spark.read.options(**options).schema(schema).csv(path)
    if not drop_incomplete:
        return table
    doubles = [f.name for f in table.schema if isinstance(f.dataType, (T.DoubleType, T.FloatType))]
    return table.dropna(how="any").where(~F.greatest(*[F.isnan(c) for c in doubles], F.lit(False), F.lit(False)) if doubles else F.lit(True))


def read_parts(spark: SparkSession, pattern: str, schema: T.StructType | str) -> DataFrame:
    """All files of a pattern as one table, in no order; fails if there is none."""
    if not path_exists(spark, pattern):
        raise FileNotFoundError(f"no file matches {pattern}")
    return spark.read.schema(schema).csv(pattern, header=True)


#: Columns of a trajectory dump line, from and to (end not included, None: to the end of the line).
DUMP_COLUMNS = (("year", 16, 19), ("month", 22, 26), ("day", 28, 30), ("hour", 34, 36), ("lat", 59, 65), ("lon", 66, 74), ("height", 77, 83), ("pressure", 84, None))


def read_dumps(spark: SparkSession, pattern: str, met_files: int, now_suffix: int = 99) -> DataFrame:
    """(file, seq, ts, lat, lon, height, pressure) of fixed-width trajectory dumps; ``met_files`` + 3 header lines each.

    Two-digit years beyond ``now_suffix`` are of the century before; incomplete lines are left out.
    """
    if not path_exists(spark, pattern):
        raise FileNotFoundError(f"no file matches {pattern}")
    number = F.row_number().over(W.partitionBy("file").orderBy("block", "at")) - 1
    lines = _lines(spark, pattern).select("file", number.cast("int").alias("line"), F.col("value").alias("text")).where(F.col("line") >= met_files + 3)
    return dump_rows(lines.withColumn("seq", F.col("line") - met_files - 3), now_suffix)


def _lines(spark: SparkSession, path: str) -> DataFrame:
    """(file, block, at, value): lines of text files, in the order of ``block`` (where the split begins) and ``at`` within a file."""
    return spark.read.text(path).select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("at"), F.rtrim(F.col("value"), F.lit("\r")).alias("value"))


def dump_rows(lines: DataFrame, now_suffix: int = 99) -> DataFrame:
    """Parsed lines from (file, seq, text)."""
    piece: dict[str, Column] = {n: F.trim(F.substring("text", a + 1, (b or 400) - a)) for n, a, b in DUMP_COLUMNS}
    number = {n: F.expr(f"try_cast(`_{n}` as double)") for n in piece}
    cut = lines.withColumns({f"_{n}": c for n, c in piece.items()})
    rows = cut.select("file", "seq", *[c.alias(n) for n, c in number.items()]).dropna()
    year = expanded_year(F.col("year").cast("int"), now_suffix)
    ts = F.try_make_timestamp(year, F.col("month").cast("int"), F.col("day").cast("int"), F.col("hour").cast("int"), F.lit(0), F.lit(0))
    return rows.select("file", "seq", ts.alias("ts"), "lat", "lon", "height", "pressure").where(F.col("ts").isNotNull())


def files_for(times: DataFrame, catalogue: DataFrame) -> DataFrame:
    """Each time (variable, ts) with the file whose days cover it: the one that starts first; none found is null.

    catalogue: variable, year, month, first_day, last_day, path.  The month is the join key.
    """
    day = times.withColumns({"year": F.year("ts"), "month": F.month("ts"), "_day": F.dayofmonth("ts")})
    fits = F.col("_day").between(F.col("first_day"), F.col("last_day"))
    found = day.join(catalogue, ["variable", "year", "month"]).where(fits)
    chosen = found.groupBy("variable", "ts").agg(F.min(F.struct("first_day", "path")).alias("f")).select("variable", "ts", F.col("f.path").alias("path"))
    return times.join(chosen, ["variable", "ts"], "left")


def written_range(spark: SparkSession, path: str) -> tuple[int, int] | None:
    """First and last month (year * 12 + month - 1) already in a cube; None if there is none."""
    if not path_exists(spark, path):
        return None
    found = spark.read.parquet(path).agg(F.min(F.col("year") * 12 + F.col("month") - 1), F.max(F.col("year") * 12 + F.col("month") - 1)).first()
    return None if found[0] is None else (found[0], found[1])
