import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from isobar.operators import traj as J
from isobar.sources import readers as R, writers as W


def months(spark, pairs, v=1.0):
    return spark.createDataFrame([("a", y, m, 0, 0, v) for y, m in pairs], "variable string, year int, month int, y int, x int, v double")


def test_append_months(spark, tmp_path):
    path = str(tmp_path / "cube")
    W.append_months(months(spark, [(2000, 11), (2000, 12)]), path)
    W.append_months(months(spark, [(2001, 1)]), path)
    W.append_months(months(spark, [(2000, 10)]), path)
    assert R.written_range(spark, path) == (2000 * 12 + 9, 2001 * 12)
    with pytest.raises(ValueError, match="gap"):
        W.append_months(months(spark, [(2002, 1)]), path)
    with pytest.raises(ValueError, match="already"):
        W.append_months(months(spark, [(2000, 12)]), path)
    with pytest.raises(ValueError, match="among themselves"):
        W.append_months(months(spark, [(2001, 1), (2001, 5)]), path)
    with pytest.raises(ValueError, match="among themselves"):
        W.append_months(months(spark, [(2001, 1), (2001, 5)]), str(tmp_path / "new"))
    assert spark.read.parquet(path).count() == 4
    got = R.read_months(spark, path, (2000, 12), (2001, 1), "variable string")
    assert got.count() == 2
    assert "PartitionFilters: [isnotnull" in got._jdf.queryExecution().toString()
    assert R.read_months(spark, path + "-none", (2000, 1), (2000, 2), "a int").count() == 0


def test_write_cube_hides_zeros(spark, tmp_path):
    W.write_cube(months(spark, [(2000, 1)], 0.0), str(tmp_path / "c"), {"a": {"units": "Pa", "long_name": "pressure"}})
    assert spark.read.parquet(str(tmp_path / "c")).first()["v"] is None
    assert spark.read.parquet(str(tmp_path / "c_variables")).first()["units"] == "Pa"


def test_paths_and_rename(spark, tmp_path):
    spark.createDataFrame([(1, 2.0)], "valid_time int, v double").write.parquet(str(tmp_path / "b"))
    cube = R.read_cube(spark, [str(tmp_path / "a"), str(tmp_path / "b")])
    assert cube.columns == ["time", "v"]
    with pytest.raises(FileNotFoundError):
        R.first_path(spark, [str(tmp_path / "x")])


def test_tables(spark, tmp_path):
    (tmp_path / "t.csv").write_text("# a\n# b\n1,2.5\n2,nan\n3,4.5\n")
    got = R.read_table(spark, str(tmp_path / "t.csv"), "a int, b double", skip=2, drop_incomplete=True).collect()
    assert [(r["a"], r["b"]) for r in got] == [(1, 2.5), (3, 4.5)]
    (tmp_path / "p_part1.csv").write_text("a,b\n1,2\n")
    (tmp_path / "p_part2.csv").write_text("a,b\n3,4\n")
    assert R.read_parts(spark, str(tmp_path / "p_part*.csv"), "a int, b int").count() == 2
    with pytest.raises(FileNotFoundError):
        R.read_parts(spark, str(tmp_path / "q_part*.csv"), "a int")


def test_csv_parts(spark, tmp_path):
    W.write_csv(spark.range(25).coalesce(1), str(tmp_path / "o"), rows_per_file=10)
    assert len(list((tmp_path / "o").glob("part-*.csv"))) == 3


def test_dumps(spark, tmp_path):
    line = " " * 16 + " 99" + " " * 3 + "  11" + "  " + " 7" + " " * 4 + " 6" + " " * 23 + " 60.25" + " " + " -10.500" + " " * 3 + "1500.0" + " " + "   850.0"
    late = line.replace(" 99", "  5", 1)
    (tmp_path / "tdump").write_text("h\n" * 5 + line + "\n" + late + "\nshort\n")
    got = R.read_dumps(spark, str(tmp_path / "tdump"), 2, now_suffix=30).orderBy("seq").collect()
    assert [(r["ts"].year, r["ts"].month, r["ts"].day, r["ts"].hour) for r in got] == [(1999, 11, 7, 6), (2005, 11, 7, 6)]
    assert (got[0]["lat"], got[0]["lon"], got[0]["height"], got[0]["pressure"]) == (60.25, -10.5, 1500.0, 850.0)


def test_controls(spark, tmp_path):
    starts = spark.sql("SELECT timestamp'2020-01-03 06:00:00' AS ts, 60.5D AS lat, 10D AS lon, 1500 AS height, 'c1' AS name")
    made = starts.select("name", J.control_text(F.col("ts"), F.col("lat"), F.col("lon"), F.col("height"), -120, "/met/", J.met_files(F.col("ts")), "/out/", F.col("name")).alias("text"))
    lines = made.first()["text"].split("\n")
    assert lines[0] == "20 01 03 06" and lines[2] == "60.5 10.0 1500" and lines[6] == "2" and "201912" in lines and "202001" in lines
    W.write_controls(made, str(tmp_path / "ctl"))
    assert (tmp_path / "ctl" / "c1").read_text() == made.first()["text"] + "\n"
    assert (tmp_path / "ctl" / "names.txt").read_text() == "c1\n" and (tmp_path / "ctl" / "ASCDATA.CFG").read_text() == W.ASCDATA
    assert not (tmp_path / "ctl" / "_parts").exists()
    assert J.level_pressure(1500) == 850
    with pytest.raises(ValueError):
        J.level_pressure(1)


def test_replace_times(spark):
    cube = spark.createDataFrame([(1, 1.0), (2, 2.0)], "t int, v double")
    assert sorted(map(tuple, W.replace_times(cube, spark.createDataFrame([(2, 5.0)], "t int, v double")).collect())) == [(1, 1.0), (2, 5.0)]


def classic(path, values):
    """A small classic NetCDF file with a record dimension."""
    name = lambda s: struct.pack(">i", len(s)) + s.encode() + b"\0" * (-len(s) % 4)
    n, ny, nx = values.shape
    dims = struct.pack(">ii", 10, 3) + b"".join(name(d) + struct.pack(">i", k) for d, k in (("time", 0), ("y", ny), ("x", nx)))
    fill = name("_FillValue") + struct.pack(">iif", 5, 1, -999.0)
    attrs = struct.pack(">ii", 12, 1) + fill
    none = struct.pack(">ii", 0, 0)
    size = ny * nx * 4

    def variables(begin):
        time = name("time") + struct.pack(">ii", 1, 0) + none + struct.pack(">iii", 6, 8, begin)
        v = name("slp") + struct.pack(">iiii", 3, 0, 1, 2) + attrs + struct.pack(">iii", 5, size, begin + 8)
        return struct.pack(">ii", 11, 2) + time + v

    head = b"CDF\x01" + struct.pack(">i", n) + dims + none
    begin = len(head) + len(variables(0))
    body = b"".join(struct.pack(">d", 10.0 + k) + values[k].astype(">f4").tobytes() for k in range(n))
    path.write_bytes(head + variables(begin) + body)


def test_netcdf(spark, tmp_path):
    from isobar.sources.netcdf import NetCDF3

    values = np.arange(24.0).reshape(2, 3, 4)
    values[1, 2, 3] = -999.0
    classic(tmp_path / "a.nc", values)
    spark.dataSource.register(NetCDF3)
    rows = spark.read.format("netcdf3").option("variable", "slp").load(str(tmp_path / "a.nc")).collect()
    assert len(rows) == 24
    got = {(r["t"], r["y"], r["x"]): r["v"] for r in rows}
    assert got[10.0, 1, 2] == 6.0 and got[11.0, 0, 0] == 12.0 and got[11.0, 2, 3] is None
