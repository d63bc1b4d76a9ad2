"""Rasters in GeoTIFF files, one a time step: a data source that reads strips or tiles and writes with commit and abort."""

from __future__ import annotations

import re
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage

from isobar.sources.shared import Staged, commit, discard, files_of, stage, store_of

#: Fixed values of the format: field types (code of struct, bytes) by number.
TYPES = {1: ("B", 1), 2: ("s", 1), 3: ("H", 2), 4: ("I", 4), 5: ("II", 8), 6: ("b", 1), 8: ("h", 2), 9: ("i", 4), 11: ("f", 4), 12: ("d", 8)}
#: Fixed values of the format: tags.
WIDTH, HEIGHT, BITS, COMPRESSION, PHOTOMETRIC, STRIP_OFFSETS, SAMPLES, STRIP_ROWS, STRIP_SIZES, PREDICTOR = 256, 257, 258, 259, 262, 273, 277, 278, 279, 317
TILE_WIDTH, TILE_HEIGHT, TILE_OFFSETS, TILE_SIZES, SAMPLE_FORMAT, PIXEL_SCALE, TIE_POINT, GEO_KEYS, NO_DATA = 322, 323, 324, 325, 339, 33550, 33922, 34735, 42113
#: Fixed values of the format: kinds of numbers, and what compressions are read (none, and deflate by two numbers).
KINDS, NONE, DEFLATE = {1: "u", 2: "i", 3: "f"}, 1, (8, 32946)
#: What stands for a missing value in files that are written.
MISSING = -99.0


def read_tags(file) -> tuple[str, dict[int, tuple]]:
    """(byte order, tags of the first directory)."""
    head = file.read(8)
    order = {b"II": "<", b"MM": ">"}.get(head[:2])
    if order is None or struct.unpack(f"{order}H", head[2:4])[0] != 42:
        raise ValueError("not a TIFF file of 32-bit offsets")
    file.seek(struct.unpack(f"{order}I", head[4:])[0])
    (n,) = struct.unpack(f"{order}H", file.read(2))
    tags = {}
    for tag, kind, count, value in struct.iter_unpack(f"{order}HHI4s", file.read(12 * n)):
        code, size = TYPES.get(kind, ("B", 1))
        if size * count > 4:
            file.seek(struct.unpack(f"{order}I", value)[0])
            value = file.read(size * count)
        raw = value[: size * count]
        tags[tag] = (raw,) if code == "s" else struct.unpack(f"{order}{code * count}", raw)
    return order, tags


def read_raster(file) -> tuple[np.ndarray, dict[int, tuple]]:
    """(values as doubles with NaN where missing, tags); strips or tiles are read one after the other."""
    order, tags = read_tags(file)
    ny, nx = tags[HEIGHT][0], tags[WIDTH][0]
    if tags.get(SAMPLES, (1,))[0] != 1 or tags.get(PREDICTOR, (1,))[0] != 1:
        raise ValueError("only rasters of one band without a predictor are read")
    packed = tags.get(COMPRESSION, (NONE,))[0]
    if packed != NONE and packed not in DEFLATE:
        raise ValueError(f"compression {packed} isn't read")
    kind = np.dtype(f"{order}{KINDS[tags.get(SAMPLE_FORMAT, (1,))[0]]}{tags[BITS][0] // 8}")
    if TILE_OFFSETS in tags:
        height, width, offsets, sizes = tags[TILE_HEIGHT][0], tags[TILE_WIDTH][0], tags[TILE_OFFSETS], tags[TILE_SIZES]
    else:
        height, width, offsets, sizes = tags.get(STRIP_ROWS, (ny,))[0], nx, tags[STRIP_OFFSETS], tags[STRIP_SIZES]
    across = -(-nx // width)
    out = np.full((ny, nx), np.nan)
    for k, (at, size) in enumerate(zip(offsets, sizes, strict=True)):
        y, x = k // across * height, k % across * width
        rows = height if TILE_OFFSETS in tags else min(height, ny - y)
        file.seek(at)
        raw = file.read(size)
        block = np.frombuffer(raw if packed == NONE else zlib.decompress(raw), kind)[: rows * width].reshape(rows, width)
        out[y : y + rows, x : x + width] = block[: ny - y, : nx - x]
    if NO_DATA in tags:
        out[out == float(tags[NO_DATA][0].split(b"\0")[0])] = np.nan
    return out, tags


def raster_bytes(grid: np.ndarray, scale: tuple[float, float] = (1.0, 1.0), corner: tuple[float, float] = (0.0, 0.0), strip_rows: int = 64) -> Iterator[bytes]:
    """A file of doubles in deflated strips, piece by piece; ``corner`` is longitude and latitude of the upper left, ``scale`` the cell's size."""
    ny, nx = grid.shape
    whole = np.where(np.isfinite(grid), grid, MISSING).astype("<f8")
    strips = [zlib.compress(whole[y : y + strip_rows].tobytes()) for y in range(0, ny, strip_rows)]
    starts = np.concatenate([[8], 8 + np.cumsum([len(s) for s in strips])]).tolist()
    fields = [
        (WIDTH, 4, (nx,)), (HEIGHT, 4, (ny,)), (BITS, 3, (64,)), (COMPRESSION, 3, (DEFLATE[0],)), (PHOTOMETRIC, 3, (1,)), (STRIP_OFFSETS, 4, tuple(starts[:-1])), (SAMPLES, 3, (1,)),
        (STRIP_ROWS, 4, (strip_rows,)), (STRIP_SIZES, 4, tuple(len(s) for s in strips)), (SAMPLE_FORMAT, 3, (3,)), (PIXEL_SCALE, 12, (*scale, 0.0)), (TIE_POINT, 12, (0.0, 0.0, 0.0, *corner, 0.0)),
        (GEO_KEYS, 3, (1, 1, 0, 1, 1024, 0, 1, 2)), (NO_DATA, 2, (f"{MISSING:g}".encode() + b"\0",)),
    ]
    pad = -starts[-1] % 2
    at = starts[-1] + pad
    yield b"II" + struct.pack("<HI", 42, at)
    yield from strips
    entries, more, behind = b"", b"", at + 2 + 12 * len(fields) + 4
    for tag, kind, values in fields:
        code, size = TYPES[kind]
        raw = values[0] if code == "s" else struct.pack(f"<{code * len(values)}", *values)
        if len(raw) > 4:
            where = struct.pack("<I", behind + len(more))
            more += raw + b"\0" * (len(raw) % 2)
        else:
            where = raw.ljust(4, b"\0")
        entries += struct.pack("<HHI4s", tag, kind, len(raw) // size, where)
    yield b"\0" * pad + struct.pack("<H", len(fields)) + entries + b"\0" * 4 + more


class Raster(InputPartition):
    def __init__(self, path: str, t: int) -> None:
        super().__init__((path, t))
        self.path, self.t = path, t


class GeoTiffReader(DataSourceReader):
    def __init__(self, options: dict) -> None:
        self.path, self.pattern = options["path"], re.compile(options.get("time", r"(-?\d+)\.tif$"))

    def partitions(self) -> list[Raster]:
        out = []
        for path in files_of(self.path, ".tif"):
            named = self.pattern.search(path)
            if named is None:
                raise ValueError(f"no time in the name {path}")
            out.append(Raster(path, int(named[1])))
        return out

    def read(self, partition: Raster) -> Iterator[pa.RecordBatch]:
        store, _ = store_of(self.path)
        with store.open_input_file(partition.path) as file:
            grid, _ = read_raster(file)
        ny, nx = grid.shape
        step = max(1, (1 << 18) // nx)
        for a in range(0, ny, step):
            part = grid[a : a + step]
            y, x = np.indices(part.shape)
            v = part.ravel()
            yield pa.RecordBatch.from_arrays([pa.array(np.full(v.size, partition.t)), pa.array((y.ravel() + a).astype(np.int32)), pa.array(x.ravel().astype(np.int32)), pa.array(v, mask=np.isnan(v))], ["t", "y", "x", "v"])


@dataclass
class Written(WriterCommitMessage):
    made: list[tuple[str, str]]


class GeoTiffWriter(DataSourceArrowWriter):
    def __init__(self, options: dict, replace: bool) -> None:
        self.path, self.replace, self.folder = options["path"], replace, stage(options["path"])
        self.shape = int(options["rows"]), int(options["columns"])
        number = lambda name, default: tuple(float(v) for v in options.get(name, default).split(","))
        self.scale, self.corner = number("scale", "1,1"), number("corner", "0,0")

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        files = Staged(self.path, ".tif", self.folder)
        t, grid, done = None, None, set()

        def end() -> None:
            if t is not None:
                if t in done:
                    raise ValueError(f"the cells of time {t} don't follow each other; sort them by time")
                done.add(t)
                with files.open(str(t)) as file:
                    for part in raster_bytes(grid, self.scale, self.corner):
                        file.write(part)

        try:
            for batch in iterator:
                times, y, x = (batch.column(c).to_numpy() for c in ("t", "y", "x"))
                v = batch.column("v").to_numpy(zero_copy_only=False).astype(float)
                cuts = [0, *(np.flatnonzero(np.diff(times)) + 1).tolist(), len(times)]
                for a, b in zip(cuts, cuts[1:], strict=False):
                    if a < b:
                        if times[a] != t:
                            end()
                            t, grid = int(times[a]), np.full(self.shape, np.nan)
                        grid[y[a:b], x[a:b]] = v[a:b]
            end()
        except BaseException:
            files.drop()
            raise
        return Written(files.made)

    def commit(self, messages: list[Written | None]) -> None:
        commit(self.path, ".tif", [m for message in messages if message for m in message.made], self.replace, self.folder)

    def abort(self, messages: list[Written | None]) -> None:
        discard(self.path, self.folder)


class GeoTiff(DataSource):
    """Rows (t, y, x, v) of files named by time in a folder that all executors share.

    Reading: option ``time``, a pattern whose first group is the time in a file's name; no-data values are null.  One
    task reads one raster.  Writing: options ``rows`` and ``columns``, the grid's shape, and ``scale`` and ``corner`` of its
    coordinates; a task's rows have to come time by time (repartition and sort by t).  Files appear when all tasks are done.
    """

    @classmethod
    def name(cls) -> str:
        return "geotiff"

    def schema(self) -> str:
        return "t bigint, y int, x int, v double"

    def reader(self, schema) -> GeoTiffReader:
        return GeoTiffReader(self.options)

    def writer(self, schema, overwrite: bool) -> GeoTiffWriter:
        return GeoTiffWriter(self.options, overwrite)
