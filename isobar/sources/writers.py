"""Writers: months, merged cubes, exports, control files."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, functions as F

from .readers import written_range


def write_months(frame: DataFrame, path: str) -> None:
    """Write by year and month; months present are replaced, the others stay."""
    frame.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("year", "month").parquet(path)


def append_months(frame: DataFrame, path: str) -> None:
    """Add months to a cube: before, after, around or inside what is there; written months are replaced.

    Fails if a gap would be left, before, after or among the new months, or if all of them are there already.
    """
    spark = frame.sparkSession
    i = F.col("year") * 12 + F.col("month") - 1
    low, high, n = frame.agg(F.min(i), F.max(i), F.countDistinct(i)).first()
    if low is None:
        return
    there = written_range(spark, path)
    if there is not None:
        if low >= there[0] and high <= there[1] and n == high - low + 1 and _covered(spark, path, low, high):
            raise ValueError("the cube has all these months already")
        if low > there[1] + 1 or high < there[0] - 1:
            raise ValueError(f"months {low}..{high} leave a gap to {there[0]}..{there[1]}")
    if n != high - low + 1:
        # what is missing between the new months has to be there
        own = frame.select(i.alias("i")).distinct()
        both = own if there is None else own.unionByName(spark.read.parquet(path).select(i.alias("i")).distinct()).distinct()
        if both.where(F.col("i").between(low, high)).count() != high - low + 1:
            raise ValueError(f"months {low}..{high} leave a gap among themselves")
    write_months(frame, path)


def _covered(spark, path: str, low: int, high: int) -> bool:
    i = F.col("year") * 12 + F.col("month") - 1
    return spark.read.parquet(path).where(i.between(low, high)).select(i.alias("i")).distinct().count() == high - low + 1


def write_cube(frame: DataFrame, path: str, attributes: dict[str, dict[str, str]], zero_is_missing: bool = True) -> None:
    """A cube (variable, year, month, y, x, v) with a table of its variables' units and names beside it."""
    v = F.nullif(F.col("v"), F.lit(0.0)) if zero_is_missing else F.col("v")
    append_months(frame.withColumn("v", v), path)
    rows = [(name, a.get("units", ""), a.get("long_name", ""), json.dumps(a, sort_keys=True)) for name, a in attributes.items()]
    frame.sparkSession.createDataFrame(rows, "name string, units string, long_name string, attributes string").coalesce(1).write.mode("overwrite").parquet(f"{path.rstrip('/')}_variables")


def replace_times(cube: DataFrame, new: DataFrame, key: str = "t") -> DataFrame:
    """The cube with all rows of the new times replaced."""
    return cube.join(new.select(key).distinct(), key, "left_anti").unionByName(new)


def write_csv(frame: DataFrame, path: str, rows_per_file: int | None = None, partitions: list[str] | None = None) -> None:
    writer = frame.write.mode("overwrite").option("header", True)
    if rows_per_file:
        writer = writer.option("maxRecordsPerFile", rows_per_file)
    (writer.partitionBy(*partitions) if partitions else writer).csv(path)


#: Fixed text of the trajectory model's surface file: grid start, spacing, size, land use, roughness, folder.
ASCDATA = "-90.0   -180.0\n1.0     1.0\n180     360\n2\n0.2\n'../bdyfiles/'\n"


def write_controls(controls: DataFrame, path: str, suffix: str = "") -> None:
    """One file ``name`` + ``suffix`` for each row of (name, text), with a log of the names and the surface file beside them.

    The tasks that hold the rows write the texts; the driver only renames the files, in any store
    that Spark writes.
    """
    spark = controls.sparkSession
    parts = f"{path.rstrip('/')}/_parts"
    controls.select("name", F.col("text").alias("value")).repartition("name").write.mode("overwrite").partitionBy("name").text(parts)
    jvm = spark.sparkContext._jvm
    folder = jvm.org.apache.hadoop.fs.Path(parts)
    store = folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    names = []
    for status in store.globStatus(jvm.org.apache.hadoop.fs.Path(f"{parts}/name=*/part-*")) or []:
        name = jvm.java.net.URLDecoder.decode(status.getPath().getParent().getName()[len("name=") :], "UTF-8") + suffix
        target = jvm.org.apache.hadoop.fs.Path(path, name)
        store.delete(target, False)
        store.rename(status.getPath(), target)
        names.append(name)
    store.delete(folder, True)
    for name, text in (("ASCDATA.CFG", ASCDATA), ("names.txt", "".join(f"{n}\n" for n in sorted(names)))):
        out = store.create(jvm.org.apache.hadoop.fs.Path(path, name), True)
        out.write(bytearray(text.encode()))
        out.close()
