"""GeoTIFF and npz data sources: round trips, foreign files, and failures that leave nothing."""

from __future__ import annotations

import contextlib
import io
import struct
import threading
import time
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from isobar.sources import geotiff, npz
from isobar.sources.shared import Staged, discard, stage


@pytest.fixture(autouse=True)
def sources(spark):
    spark.dataSource.register(geotiff.GeoTiff)
    spark.dataSource.register(npz.NpzTrajectories)


def rasters(spark, steps=3, shape=(70, 5)):
    return spark.createDataFrame([(t, y, x, None if (y + x) % 7 == 0 else t + y / 10 + x / 1000) for t in range(steps) for y in range(shape[0]) for x in range(shape[1])], "t bigint, y int, x int, v double")


def test_rasters_round_trip_and_are_replaced(spark, tmp_path):
    path = str(tmp_path / "tif")
    frame = rasters(spark).repartition(4, "t").sortWithinPartitions("t")
    write = lambda f, mode: f.write.format("geotiff").mode(mode).options(rows=70, columns=5, scale="2,1", corner="-20,45").save(path)
    write(frame, "append")
    want = {tuple(r) for r in frame.collect()}
    assert {tuple(r) for r in spark.read.format("geotiff").load(path).collect()} == want
    with open(f"{path}/1.tif", "rb") as f:
        grid, tags = geotiff.read_raster(f)
    assert tags[geotiff.PIXEL_SCALE] == (2.0, 1.0, 0.0) and tags[geotiff.TIE_POINT] == (0.0, 0.0, 0.0, -20.0, 45.0, 0.0) and len(tags[geotiff.STRIP_OFFSETS]) == 2
    assert np.isnan(grid[0, 0]) and grid[1, 0] == 1.1
    write(frame.where("t = 2"), "overwrite")
    assert sorted(p.name for p in (tmp_path / "tif").iterdir()) == ["2.tif"]


def test_foreign_rasters(spark, tmp_path):
    """Big-endian tiles of 16-bit integers, and plain strips of floats without a no-data value."""
    grid = np.arange(20 * 20).reshape(20, 20).astype(">i2")
    tiles = [zlib.compress(np.pad(grid, ((0, 12), (0, 12)))[a : a + 16, b : b + 16].tobytes()) for a in (0, 16) for b in (0, 16)]
    at, body, offsets = 8, b"", []
    for t in tiles:
        offsets.append(at + len(body))
        body += t
    head = at + len(body)
    fields = [(256, 3, [20]), (257, 3, [20]), (258, 3, [16]), (259, 3, [8]), (277, 3, [1]), (322, 3, [16]), (323, 3, [16]), (324, 4, offsets), (325, 4, [len(t) for t in tiles]), (339, 3, [2])]
    more, entries, behind = b"", b"", head + 2 + 12 * len(fields) + 4
    for tag, kind, values in fields:
        raw = struct.pack(f">{('H' if kind == 3 else 'I') * len(values)}", *values)
        if len(raw) > 4:
            value, more = struct.pack(">I", behind + len(more)), more + raw
        else:
            value = raw.ljust(4, b"\0")
        entries += struct.pack(">HHI4s", tag, kind, len(values), value)
    (tmp_path / "slp_7.tif").write_bytes(b"MM" + struct.pack(">HI", 42, head) + body + struct.pack(">H", len(fields)) + entries + b"\0" * 4 + more)
    got = {(r["t"], r["y"], r["x"]): r["v"] for r in spark.read.format("geotiff").option("time", r"_(\d+)\.tif$").load(str(tmp_path)).collect()}
    assert got == {(7, y, x): float(grid[y, x]) for y in range(20) for x in range(20)}
    for broken, message in ((b"no tiff at all", "not a TIFF"), (b"II" + struct.pack("<HI", 43, 8), "not a TIFF")):
        with pytest.raises(ValueError, match=message):
            geotiff.read_raster(io.BytesIO(broken))


@pytest.mark.parametrize("kind", ["geotiff", "npz"])
def test_a_failed_job_leaves_nothing(spark, tmp_path, kind):
    path = tmp_path / "out"
    path.mkdir()
    frame = rasters(spark).repartition(3, "t").sortWithinPartitions("t")
    # cells beyond the grid, or rows that aren't sorted, in one task only
    bad = frame.withColumn("y", F.when(F.col("t") == 1, F.col("y") + 1000).otherwise(F.col("y"))) if kind == "geotiff" else frame.withColumn("t", F.when(F.col("t") == 1, -F.monotonically_increasing_id()).otherwise(F.col("t")))
    with pytest.raises(Exception, match="out of bounds|sorted"):
        bad.write.format(kind).mode("append").options(rows=70, columns=5).save(str(path))
    assert list(path.iterdir()) == []


def test_an_abort_ends_while_tasks_begin_files(tmp_path):
    stop = threading.Event()

    def task(folder):
        files = Staged(str(tmp_path), ".npz", folder)
        with contextlib.suppress(FileNotFoundError):
            while not stop.is_set():
                files.open("x").close()

    for _ in range(10):
        folder = stage(str(tmp_path))
        tasks = [threading.Thread(target=task, args=[folder]) for _ in range(3)]
        try:
            for t in tasks:
                t.start()
            time.sleep(0.01)
            discard(str(tmp_path), folder)
        finally:
            stop.set()
            for t in tasks:
                t.join()
            stop.clear()
        assert list(tmp_path.iterdir()) == []


def test_trajectories_round_trip(spark, tmp_path):
    path = str(tmp_path / "npz")
    rows = [(i, k, None if k == 3 else i + k / 10) for i in range(-2, 40) for k in range(30)]
    frame = spark.createDataFrame(rows, "traj_id bigint, step int, lat double")
    frame.repartitionByRange(3, "traj_id").sortWithinPartitions("traj_id", "step").write.format("npz").mode("append").option("rows", 100).save(path)
    read = spark.read.format("npz").option("rows", 70).load(path)
    assert read.columns == ["archive", "row", "traj_id", "step", "lat"]
    assert {tuple(r)[2:] for r in read.collect()} == {(float(i), float(k), v) for i, k, v in rows}
    # a trajectory is in one archive, its rows in order; archives hold 100 rows and what the last trajectory has besides
    spans = read.groupBy("traj_id").agg(F.countDistinct("archive").alias("n"), (F.max("row") - F.min("row")).alias("d")).collect()
    assert {(r["n"], r["d"]) for r in spans} == {(1, 29)}
    assert max(r["count"] for r in read.groupBy("archive").count().collect()) <= 130
    assert read.rdd.getNumPartitions() > read.select("archive").distinct().count()


def test_short_archives_share_tasks(spark, tmp_path):
    for i in range(3 * npz.TASKS):
        np.savez(tmp_path / f"{i:04}.npz", data=np.array([[i, 0.0], [i, 1.0], [i, 2.0]]), column_names=np.array(["traj_id", "step"]))
    read = spark.read.format("npz").option("rows", 2).load(str(tmp_path))
    assert read.rdd.getNumPartitions() <= npz.TASKS
    assert sorted((r["traj_id"], r["step"], r["row"]) for r in read.collect()) == [(float(i), float(k), k) for i in range(3 * npz.TASKS) for k in range(3)]


@pytest.mark.parametrize("kind", ["geotiff", "npz"])
def test_an_aborted_job_takes_what_running_tasks_staged(tmp_path, kind):
    path = str(tmp_path / "out")
    writer = geotiff.GeoTiffWriter({"path": path, "rows": "2", "columns": "2"}, False) if kind == "geotiff" else npz.NpzWriter({"path": path, "rows": "1"}, False)
    # two keys, so that the first file is staged while the task still waits for more
    batch = pa.RecordBatch.from_pydict({"t": pa.array([0, 1]), "y": pa.array([0, 0], pa.int32()), "x": pa.array([0, 1], pa.int32()), "v": pa.array([1.0, 2.0])})

    def batches():
        yield batch
        assert [p for p in (tmp_path / "out").rglob("*") if p.is_file()]
        writer.abort([None])
        assert list((tmp_path / "out").iterdir()) == []
        yield batch.set_column(0, "t", pa.array([2, 3]))

    with pytest.raises(FileNotFoundError):
        writer.write(batches())
    assert list((tmp_path / "out").iterdir()) == []


def test_archives_of_others_and_missing_ones(spark, tmp_path):
    table = np.arange(5000.0).reshape(1000, 5)
    np.savez(tmp_path / "a.npz", data=table, column_names=np.array(["traj_id", "a", "b", "c", "d"]))
    np.savez_compressed(tmp_path / "b.npz", data=-table[:, ::-1], column_names=np.array(["d", "c", "b", "a", "traj_id"]))
    got = spark.read.format("npz").option("rows", 300).load(str(tmp_path)).select("traj_id", "a", "b", "c", "d").collect()
    assert sorted(tuple(r) for r in got) == sorted([tuple(r) for r in table] + [tuple(-r) for r in table])
    with pytest.raises(Exception, match=r"no \.npz file"):
        spark.read.format("npz").load(str(tmp_path / "..")).collect()
