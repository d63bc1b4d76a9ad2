"""A Spark data source for classic NetCDF files (CDF-1 and CDF-2): ``spark.read.format("netcdf3")``.

One partition for each step of the record dimension of a file, read by seeking; the row layout is
(t, y, x, v) of one variable, fill values null.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

#: External types of the format by number.
KINDS = {1: ">i1", 2: ">S1", 3: ">i2", 4: ">i4", 5: ">f4", 6: ">f8"}


class Header:
    """Dimensions, attributes and variables of a file."""

    def __init__(self, path: str) -> None:
        self.path = path
        with open(path, "rb") as f:
            self.data = f.read(1 << 22)
        if self.data[:3] != b"CDF" or self.data[3] not in (1, 2):
            raise ValueError(f"{path} isn't a classic NetCDF file")
        self.wide, self.at = self.data[3] == 2, 4
        self.records = self._int()
        self.dims = self._list(lambda: (self._name(), self._int()))
        self.attributes = dict(self._list(self._attribute))
        self.variables = {v["name"]: v for v in self._list(self._variable)}
        self.record_size = sum(v["size"] for v in self.variables.values() if v["record"])

    def _int(self) -> int:
        self.at += 4
        return struct.unpack(">i", self.data[self.at - 4 : self.at])[0]

    def _name(self) -> str:
        n = self._int()
        out = self.data[self.at : self.at + n].decode()
        self.at += n + -n % 4
        return out

    def _list(self, item) -> list:
        self._int()
        return [item() for _ in range(self._int())]

    def _attribute(self) -> tuple:
        name, kind, n = self._name(), self._int(), self._int()
        size = n * np.dtype(KINDS[kind]).itemsize
        raw = self.data[self.at : self.at + size]
        self.at += size + -size % 4
        return name, raw.decode(errors="replace") if kind == 2 else np.frombuffer(raw, KINDS[kind]).tolist()

    def _variable(self) -> dict:
        name, dims = self._name(), [self._int() for _ in range(self._int())]
        attributes = dict(self._list(self._attribute))
        kind, size = self._int(), self._int()
        begin = struct.unpack(">q", self.data[self.at : self.at + 8])[0] if self.wide else struct.unpack(">i", self.data[self.at : self.at + 4])[0]
        self.at += 8 if self.wide else 4
        record = bool(dims) and self.dims[dims[0]][1] == 0
        return {"name": name, "dims": dims, "attributes": attributes, "kind": kind, "size": size, "begin": begin, "record": record}

    def step(self, name: str, k: int) -> np.ndarray:
        """Values of one record, or of one index of the first dimension."""
        v = self.variables[name]
        shape = [self.dims[d][1] for d in v["dims"][1:]]
        kind = np.dtype(KINDS[v["kind"]])
        count = int(np.prod(shape)) if shape else 1
        at = v["begin"] + k * (self.record_size if v["record"] else count * kind.itemsize)
        with open(self.path, "rb") as f:
            f.seek(at)
            raw = np.frombuffer(f.read(count * kind.itemsize), kind).astype(float).reshape(shape)
        fill = v["attributes"].get("_FillValue", v["attributes"].get("missing_value"))
        out = np.where(np.isin(raw, fill), np.nan, raw) if fill else raw
        scale, offset = (v["attributes"].get(n, [d])[0] for n, d in (("scale_factor", 1.0), ("add_offset", 0.0)))
        return out * scale + offset

    def steps(self, name: str) -> int:
        v = self.variables[name]
        return self.records if v["record"] else self.dims[v["dims"][0]][1]


class Step(InputPartition):
    def __init__(self, path: str, k: int) -> None:
        super().__init__((path, k))
        self.path, self.k = path, k


class Reader(DataSourceReader):
    def __init__(self, options: dict) -> None:
        self.variable, self.pattern = options["variable"], options["path"].removeprefix("file:")

    def partitions(self) -> list[Step]:
        where = Path(self.pattern)
        files = sorted(where.parent.glob(where.name)) if not where.is_dir() else sorted(where.glob("*.nc"))
        if not files:
            raise FileNotFoundError(self.pattern)
        return [Step(str(f), k) for f in files for k in range(Header(str(f)).steps(self.variable))]

    def read(self, partition: Step) -> Iterator[pa.RecordBatch]:
        header = Header(partition.path)
        grid = header.step(self.variable, partition.k)
        clock = float(header.step("time", partition.k)) if "time" in header.variables else float(partition.k)
        y, x = np.indices(grid.shape)
        v = pa.array(grid.ravel(), mask=np.isnan(grid.ravel()))
        yield pa.RecordBatch.from_arrays([pa.array(np.full(grid.size, clock)), pa.array(y.ravel().astype(np.int32)), pa.array(x.ravel().astype(np.int32)), v], ["t", "y", "x", "v"])


class NetCDF3(DataSource):
    """Options: ``variable``; the path is a file, folder or pattern on a file system that all executors mount."""

    @classmethod
    def name(cls) -> str:
        return "netcdf3"

    def schema(self) -> str:
        return "t double, y int, x int, v double"

    def reader(self, schema) -> Reader:
        return Reader(self.options)
