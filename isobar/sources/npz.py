"""Trajectories in archives of arrays: a table of doubles (``data``) with ``column_names``, the first the trajectory's id."""

from __future__ import annotations

import io
import zipfile
from collections.abc import Iterator
from concurrent.futures import ThreadPoolExecutor

import numpy as np
import pyarrow as pa
from numpy.lib import format as npy
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition

from isobar.sources.geotiff import Written
from isobar.sources.shared import CALLS, Staged, commit, discard, files_of, stage, store_of

#: Rows of a run that is read at once, and that an archive has before the next key begins a new one.
READ_ROWS, ARCHIVE_ROWS = 1_000_000, 1_000_000
#: Tasks that short runs are shared out to; with more than READ_ROWS rows for each of them there are more tasks.
TASKS = 128


def _head(member) -> tuple[tuple[int, ...], np.dtype, int]:
    """(shape, type, where the values begin) of an array in C order."""
    version = npy.read_magic(member)
    shape, fortran, kind = npy.read_array_header_1_0(member) if version == (1, 0) else npy.read_array_header_2_0(member)
    if fortran or len(shape) != 2:
        raise ValueError("the table has to be two-dimensional and in C order")
    return shape, kind, member.tell()


def columns_of(archive: zipfile.ZipFile) -> list[str]:
    with archive.open("column_names.npy") as member:
        return [str(c) for c in np.load(io.BytesIO(member.read()))]


class Rows(InputPartition):
    """(path, first row, row after the last) of each run; runs of an archive that follow each other are one."""

    def __init__(self, runs: list[tuple[str, int, int]]) -> None:
        super().__init__(runs)
        self.runs = runs


def shared_out(runs: list[tuple[str, int, int]]) -> list[Rows]:
    """Runs in turn until a task has its share of all rows, so that tasks are as few for many short archives as for a long one."""
    share = min(READ_ROWS, -(-sum(b - a for _, a, b in runs) // TASKS))
    out: list[list[tuple[str, int, int]]] = []
    rows = share
    for path, a, b in runs:
        if rows >= share:
            out.append([])
            rows = 0
        rows += b - a
        if out[-1] and out[-1][-1][::2] == (path, a):
            a = out[-1].pop()[1]
        out[-1].append((path, a, b))
    return [Rows(runs) for runs in out]


class NpzReader(DataSourceReader):
    def __init__(self, options: dict, names: list[str]) -> None:
        self.path, self.names, self.rows = options["path"], names, int(options.get("rows", READ_ROWS))

    def partitions(self) -> list[Rows]:
        """Runs of rows, from the archives' directories and the arrays' heads alone."""
        store = store_of(self.path)[0]

        def length(path: str) -> int:
            with store.open_input_file(path) as file, zipfile.ZipFile(file) as archive, archive.open("data.npy") as member:
                return _head(member)[0][0]

        paths = files_of(self.path, ".npz")
        with ThreadPoolExecutor(CALLS) as calls:
            lengths = calls.map(length, paths)
            return shared_out([(path, a, min(n, a + self.rows)) for path, n in zip(paths, lengths, strict=True) for a in range(0, n, self.rows)])

    def read(self, partition: Rows) -> Iterator[pa.RecordBatch]:
        for path, first, last in partition.runs:
            yield from self._run(path, first, last)

    def _run(self, path: str, first: int, last: int) -> Iterator[pa.RecordBatch]:
        store = store_of(self.path)[0]
        with store.open_input_file(path) as file, zipfile.ZipFile(file) as archive:
            names = columns_of(archive)
            order = [names.index(c) for c in self.names]
            with archive.open("data.npy") as member:
                (_, width), kind, at = _head(member)
                member.seek(at + first * width * kind.itemsize)
                for a in range(first, last, 1 << 16):
                    n = min(1 << 16, last - a)
                    table = np.frombuffer(member.read(n * width * kind.itemsize), kind).reshape(n, width).astype(float)
                    values = [pa.array(table[:, k], mask=np.isnan(table[:, k])) for k in order]
                    yield pa.RecordBatch.from_arrays([pa.array([path.rsplit("/", 1)[1]] * n), pa.array(np.arange(a, a + n)), *values], ["archive", "row", *self.names])


class NpzWriter(DataSourceArrowWriter):
    def __init__(self, options: dict, replace: bool) -> None:
        self.path, self.replace, self.rows = options["path"], replace, int(options.get("rows", ARCHIVE_ROWS))
        self.folder = stage(self.path)

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        files = Staged(self.path, ".npz", self.folder)
        held: list[np.ndarray] = []
        names: list[str] = []
        rows = 0

        def end() -> None:
            table = np.concatenate(held)
            with files.open(f"trajectories-{int(table[0, 0])}-{int(table[-1, 0])}") as file:
                np.savez_compressed(file, data=table, column_names=np.array(names))
            held.clear()

        try:
            for batch in iterator:
                names = list(batch.schema.names)
                table = np.column_stack([c.to_numpy(zero_copy_only=False).astype(float) for c in batch.columns])
                if not len(table):
                    continue
                if np.any(np.diff(table[:, 0]) < 0) or (held and table[0, 0] < held[-1][-1, 0]):
                    raise ValueError("rows have to be sorted by the first column")
                cuts = [0, *(np.flatnonzero(np.diff(table[:, 0])) + 1).tolist(), len(table)]
                for a, b in zip(cuts, cuts[1:], strict=False):
                    # a trajectory stays in one archive
                    if rows >= self.rows and table[a, 0] != held[-1][-1, 0]:
                        end()
                        rows = 0
                    held.append(table[a:b])
                    rows += b - a
            if held:
                end()
        except BaseException:
            files.drop()
            raise
        return Written(files.made)

    def commit(self, messages: list[Written | None]) -> None:
        commit(self.path, ".npz", [m for message in messages if message for m in message.made], self.replace, self.folder)

    def abort(self, messages: list[Written | None]) -> None:
        discard(self.path, self.folder)


class NpzTrajectories(DataSource):
    """archive, row and the archives' columns as doubles; missing values are null.

    Reading: runs of ``rows`` rows of one archive, shared out to tasks.  Writing: numbers, the first column is the id, which rows
    have to be sorted by (repartitionByRange and sortWithinPartitions); a task begins a new archive with the next id once one has
    ``rows`` rows.  Files appear when all tasks are done.
    """

    @classmethod
    def name(cls) -> str:
        return "npz"

    def _names(self) -> list[str]:
        path = self.options["path"]
        with store_of(path)[0].open_input_file(files_of(path, ".npz")[0]) as file, zipfile.ZipFile(file) as archive:
            return columns_of(archive)

    def schema(self) -> str:
        return ", ".join(["archive string", "row bigint", *(f"`{c}` double" for c in self._names())])

    def reader(self, schema) -> NpzReader:
        return NpzReader(self.options, [f.name for f in schema.fields][2:])

    def writer(self, schema, overwrite: bool) -> NpzWriter:
        return NpzWriter(self.options, overwrite)
