"""What several corpus operators need: the shared folder, table reads, word splitting."""

from __future__ import annotations

import ctypes
import functools
import gc
import pickle
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, functions as F

#: A word is a run of characters other than blank and the five ASCII controls 9 to 13.
WORD_PATTERN = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def free_name(name: str, taken: set[str]) -> str:
    """``name``, with underscores in front while it is among the lower-case names ``taken``."""
    while name.lower() in taken:
        name = f"_{name}"
    return name


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir``, or the context's checkpoint folder.

    Where neither is set, a local session gets a folder of its own (tests); on a cluster that is an error.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder
    context = spark.sparkContext
    if context._jsc.sc().getCheckpointDir().isEmpty():
        if not context.master.startswith("local") or context.master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir has to name a folder that all executors share")
        context.setCheckpointDir(tempfile.mkdtemp(prefix="isobar-"))
    return context._jsc.sc().getCheckpointDir().get()


def durable(frame: DataFrame) -> DataFrame:
    """Cut the lineage with files in the shared folder, so that a lost executor costs no recomputation."""
    shared_dir(frame.sparkSession)
    return frame.checkpoint(eager=True)


def stored(frame: DataFrame, compression: str = "snappy") -> DataFrame:
    """As :func:`durable`, but as a compressed columnar table, for wide or array columns."""
    path = f"{shared_dir(frame.sparkSession).rstrip('/')}/table-{uuid.uuid4().hex}"
    frame.write.option("compression", compression).parquet(path)
    return frame.sparkSession.read.schema(frame.schema).parquet(path)


def word_count(text) -> F.Column:
    """Number of words of a text column; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD_PATTERN)), F.lit(0)).cast("long")


class Words:
    """The words of a batch of texts as dictionary codes.

    ``codes`` holds the vocabulary index of every word, text after text;
    ``starts`` (length n + 1) is where each text begins; ``vocab`` is the array
    of distinct words.  Null and empty texts have no words.
    """

    def __init__(self, texts: pa.Array, lower: bool = False) -> None:
        texts = pc.fill_null(texts.cast(pa.large_string()), "")
        parts = pc.ascii_split_whitespace(pc.ascii_trim_whitespace(texts))
        lengths = np.diff(parts.offsets.to_numpy())
        # an all-blank text splits into one empty part
        blank = pc.equal(pc.binary_length(pc.ascii_trim_whitespace(texts)), 0).to_numpy(zero_copy_only=False)
        flat = parts.flatten()
        if blank.any():
            flat = flat.filter(pa.array(np.repeat(~blank, lengths)))
            lengths = np.where(blank, 0, lengths)
        coded = flat.dictionary_encode()
        self.codes = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        # lower-cased, two codes can have equal words
        self.vocab = pc.ascii_lower(coded.dictionary) if lower else coded.dictionary
        self.starts = np.concatenate([[0], np.cumsum(lengths)]).astype(np.int64)


def masked(texts: pa.Array, mask: Callable[[np.ndarray], np.ndarray]) -> pa.Array:
    """The texts with each byte replaced by ``mask(bytes)``, a same-sized array that leaves UTF-8 valid; null texts are empty."""
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    _, offsets, data = texts.buffers()
    at = np.frombuffer(offsets, np.int64)[texts.offset : texts.offset + len(texts) + 1] if len(texts) else np.zeros(1, np.int64)
    held = np.frombuffer(data, np.uint8)[at[0] : at[-1]] if data is not None else np.zeros(0, np.uint8)
    return pa.LargeStringArray.from_buffers(len(texts), pa.py_buffer(at - at[0]), pa.py_buffer(np.ascontiguousarray(mask(held))))


def text_blocks(batch: pa.RecordBatch, most: int = 3_000_000, text: str = "text") -> Iterator[pa.RecordBatch]:
    """Slices of a batch with about ``most`` bytes of text; a single longer text is a slice of its own."""
    sizes = np.cumsum(pc.fill_null(pc.binary_length(batch.column(text)), 0).to_numpy(zero_copy_only=False))
    at = 0
    while at < batch.num_rows:
        base = sizes[at - 1] if at else 0
        end = max(at + 1, int(np.searchsorted(sizes, base + most, "right")))
        yield batch.slice(at, end - at)
        at = end


def give_back() -> None:
    """Return freed memory to the system: Python workers outlive their tasks, and what they keep adds to the next stage's."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # another C library
        pass


def tidy(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """A function over a task's batches that gives memory back when it begins and ends."""

    @functools.wraps(run)
    def wrapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        give_back()
        try:
            yield from run(batches)
        finally:
            give_back()

    return wrapped


def mix64(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (xor-shift and multiply) for arrays of uint64."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def string_hashes(words: pa.Array) -> np.ndarray:
    """A 64-bit hash of each string; equal strings get equal values on every machine."""
    import xxhash

    return np.fromiter((xxhash.xxh3_64_intdigest(w) for w in words.to_pylist()), np.uint64, len(words))


def fitted(docs: DataFrame, labels: DataFrame, label: str, folds: int, held: int, most: int, fit: Callable[[list[str], np.ndarray], object], balance: bool = False) -> object:
    """``fit(texts, labels)`` over at most ``most`` labelled documents outside the held-out fold.

    The fold is crc32(doc_id as text) mod ``folds``; the sample is the first rows in the order of
    the id's hash, the same in each run.  ``balance`` takes up to half of the bound from each class.
    One task gathers the sample and fits; only the model comes to the driver.
    """
    known = labels.where(F.col(label).isNotNull() & F.col("doc_id").isNotNull() & ~is_held(F.col("doc_id"), folds, held))
    known = known.groupBy("doc_id").agg(F.max(label).cast("int").alias("y"))
    order = [F.xxhash64(F.lit(11), "doc_id"), F.col("doc_id")]
    if balance:
        picks = known.where("y = 1").orderBy(*order).limit(most // 2).unionByName(known.where("y <> 1").orderBy(*order).limit(most // 2))
    else:
        picks = known.orderBy(*order).limit(most)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = list(batches)
        found = pa.Table.from_batches(held).sort_by([("doc_id", "ascending"), ("text", "ascending")]) if held else None
        texts = found.column("text").to_pylist() if held else []
        y = found.column("y").to_numpy().astype(np.int64) if held else np.zeros(0, np.int64)
        del held, found
        yield pa.RecordBatch.from_pydict({"model": pa.array([pickle.dumps(fit(texts, y))], pa.large_binary()).cast(pa.binary())})

    # at most ``most`` pairs of numbers are broadcast
    sample = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).join(F.broadcast(picks), "doc_id")
    row = sample.repartition(1).mapInArrow(tidy(run), "model binary").first()
    # a plan known to be empty has no task
    return pickle.loads(row["model"]) if row else fit([], np.zeros(0, np.int64))


def is_held(doc_id, folds: int, held: int):
    """Whether a document is in the held-out fold; a null id is not."""
    return F.coalesce(F.crc32(F.encode(doc_id.cast("string"), "UTF-8")) % folds == held, F.lit(False))


def with_score(docs: DataFrame, scorer: Callable[[pa.Array], np.ndarray], name: str = "score", text: str = "text", block: int = 3_000_000) -> DataFrame:
    """``docs`` with ``scorer(texts)`` added as a double; replaces a column of that name."""
    kept = docs.drop(name)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in text_blocks(whole, block, text):
                score = pa.array(np.asarray(scorer(batch.column(text)), np.float64))
                yield pa.RecordBatch.from_arrays([*batch.columns, score], [*batch.schema.names, name])

    return kept.mapInArrow(tidy(run), f"{kept._jdf.schema().toDDL()}, `{name}` double")


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * np.tanh(0.5 * x) + 0.5


def logistic_fit(x: np.ndarray, y: np.ndarray, ridge: float = 1e-2, steps: int = 50) -> np.ndarray:
    """Weights of a small logistic regression by Newton steps; the last one is the intercept."""
    x = np.column_stack([x, np.ones(len(x))])
    w = np.zeros(x.shape[1])
    for _ in range(steps):
        p = sigmoid(x @ w)
        grad = x.T @ (p - y) + ridge * w
        hess = (x * (p * (1 - p))[:, None]).T @ x + (ridge + 1e-9) * np.eye(len(w))
        step = np.linalg.solve(hess, grad)
        w -= np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-8:
            break
    return w
