"""The folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid
from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import DataFrame, SparkSession

#: Calls to a store that wait at a time.
CALLS = 32


def shared_folder(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``, or the context's checkpoint folder; a local session where neither is set gets one of its own."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        context = spark.sparkContext
        folder = context.getCheckpointDir()
        if not folder:
            if not context.master.startswith("local") or context.master.startswith("local-cluster"):
                raise ValueError("spark.checkpoint.dir has to name a folder that all executors share")
            context.setCheckpointDir(tempfile.mkdtemp(prefix="isobar-"))
            folder = context.getCheckpointDir()
    return folder.rstrip("/")


def written(frame: DataFrame) -> DataFrame:
    """The frame as a table in the shared folder: its lineage ends there, and a lost executor costs no second run."""
    path = f"{shared_folder(frame.sparkSession)}/table-{uuid.uuid4().hex}"
    frame.write.parquet(path)
    return frame.sparkSession.read.schema(frame.schema).parquet(path)


def store_of(path: str):
    """(file system, path in it) of a folder that driver and executors share; any store that pyarrow knows."""
    from pyarrow import fs

    if path.startswith("file:/") and not path.startswith("file://"):
        path = f"file://{path[5:]}"
    return fs.FileSystem.from_uri(path)


def files_of(path: str, suffix: str) -> list[str]:
    """The files of a folder that end in ``suffix``, by name; an error if there is none."""
    from pyarrow import fs

    store, base = store_of(path)
    found = sorted(f.path for f in store.get_file_info(fs.FileSelector(base)) if f.type == fs.FileType.File and f.base_name.endswith(suffix))
    if not found:
        raise FileNotFoundError(f"no {suffix} file in {path}")
    return found


def stage(path: str) -> str:
    """A new folder for the files of one job; its tasks don't make it, so that none can write there once it is gone."""
    store, base = store_of(path)
    folder = f"{base}/_{uuid.uuid4().hex}"
    store.create_dir(folder, recursive=True)
    return folder


class Staged:
    """Files of a task in the folder of its job until that commits: a task or job that fails leaves none."""

    def __init__(self, path: str, suffix: str, folder: str) -> None:
        self.store, self.base = store_of(path)
        self.suffix, self.folder, self.made = suffix, folder, []

    def open(self, name: str):
        staged = f"{self.folder}/{uuid.uuid4().hex}"
        self.made.append((staged, f"{self.base}/{name}{self.suffix}"))
        return self.store.open_output_stream(staged, compression=None)

    def drop(self) -> None:
        for staged, _ in self.made:
            self.store.delete_file(staged)
        self.made = []


def commit(path: str, suffix: str, made: list[tuple[str, str]], replace: bool, folder: str) -> None:
    """Give staged files their names; with ``replace`` other files of the suffix go."""
    from pyarrow import fs

    store, base = store_of(path)
    if len({name for _, name in made}) != len(made):
        raise ValueError("two tasks wrote a file of the same name")
    old = [f.path for f in store.get_file_info(fs.FileSelector(base)) if f.base_name.endswith(suffix)]
    with ThreadPoolExecutor(CALLS) as calls:
        list(calls.map(lambda m: store.move(*m), made))
        list(calls.map(store.delete_file, set(old) - {name for _, name in made} if replace else ()))
    discard(path, folder)


def discard(path: str, folder: str) -> None:
    """Whatever the job's tasks staged, also those that are still running: in a folder of another name they begin no more files."""
    store, gone = store_of(path)[0], f"{folder}-gone"
    try:
        store.move(folder, gone)
    except OSError:  # a store without folders has none to move
        gone = folder
    store.delete_dir(gone)
