"""Spelling variants: words one edit apart, by two-dimensional range reporting.

Words are points: their rank in forward order and their rank in the order of the reversed words.  A
word that differs from w by one edit at position p has w's characters before p as a prefix and those
behind as a suffix, so it is a point of the rectangle of the prefix's forward interval and the
suffix's reverse interval.  A wavelet tree over the reverse ranks in forward order reports the points
of a rectangle; words of equal length have one structure, so that a rectangle holds nothing else.

The vocabulary is cut for this: words are near within a class (length l, and l + 1 for insertions) and
a window of edit positions, outside of which they agree.  A class starts with two windows, the halves,
so each word is in four groups; a group of more than GROUP words is cut again, by the kind of edit and at
the middle of its window, down to single positions, where a group has at most one word for each letter.
Nothing is left out, and no group or structure grows with the corpus.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, functions as F

from .shared import Words, durable, masked, stored, table, text_blocks, tidy

#: Words of a group that is not cut further, and rows of a task on average.
GROUP, TASK_ROWS = 2_000, 150_000
#: Which edits a group is for: both kinds, replaced characters, inserted ones.
BOTH, REPLACED, INSERTED = 0, 1, 2
#: One in so many runs of letters loses a character.
ONE_IN = 199
#: Runs of up to so many bytes have their checksums combined by tables; longer ones are read.
SHORT_RUN = 64


def letters_only(held: np.ndarray) -> np.ndarray:
    """Bytes of UTF-8 with everything but A-Z, a-z and U+00C0 to U+00FF as blanks, A-Z in lower case."""
    lut = np.full(256, 0x20, np.uint8)
    small = np.arange(ord("a"), ord("z") + 1)
    lut[small] = lut[small - 32] = small
    lut[0xC3] = 0xC3  # leads U+00C0 to U+00FF and nothing else
    out = lut[held]
    behind = np.flatnonzero(held == 0xC3) + 1
    out[behind] = held[behind]
    return out


def _shift_tables(longest: int) -> np.ndarray:
    """tables[n, k, b]: what n more bytes make of a CRC-32 whose k-th byte is b and whose others are 0."""
    step = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        step = (step >> np.uint32(1)) ^ np.where(step & 1, np.uint32(0xEDB88320), np.uint32(0))
    tables = np.zeros((longest + 1, 4, 256), np.uint32)
    tables[0] = np.arange(256, dtype=np.uint32)[None] << (8 * np.arange(4, dtype=np.uint32))[:, None]
    for n in range(longest):
        tables[n + 1] = (tables[n] >> np.uint32(8)) ^ step[tables[n] & 255]
    return tables


def counted_runs(docs: DataFrame, least_size: int) -> DataFrame:
    """word, n: runs of letters of all texts in lower case, one in ONE_IN with a character less, of ``least_size`` code points or more.

    Which occurrences lose a character is fixed by the CRC-32 of id, colon and run: as equal runs of a
    document share their fate, each block of texts counts its runs and sums are shuffled.  The checksum of
    a run behind an id is combined from those of both, so none is taken for each occurrence.  A null id
    counts as an empty text.
    """
    schema = pa.schema([("word", pa.string()), ("n", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables = _shift_tables(SHORT_RUN)
        for whole in batches:
            for batch in text_blocks(whole, 8_000_000):
                words = Words(masked(batch.column("text"), letters_only))
                sizes = pc.utf8_length(words.vocab).to_numpy(zero_copy_only=False)
                bytes_ = pc.binary_length(words.vocab).to_numpy(zero_copy_only=False).astype(np.int64)
                long_enough = sizes >= least_size
                text_of = np.repeat(np.arange(batch.num_rows), np.diff(words.starts))
                own = long_enough[words.codes]
                codes, text_of = words.codes[own], text_of[own]
                heads = [f"{'' if i is None else i}:".encode() for i in batch.column("id").to_pylist()]
                a = np.fromiter(map(zlib.crc32, heads), np.uint32, len(heads))[text_of]
                spelled = words.vocab.to_pylist()
                tails = np.fromiter((zlib.crc32(w.encode()) if ok else 0 for w, ok in zip(spelled, long_enough.tolist(), strict=True)), np.uint32, len(spelled))
                size = np.minimum(bytes_[codes], SHORT_RUN)
                h = tails[codes]
                for k in range(4):
                    h = h ^ tables[size, k, (a >> np.uint32(8 * k)) & np.uint32(255)]
                for at in np.flatnonzero(bytes_[codes] > SHORT_RUN):
                    h[at] = zlib.crc32(spelled[codes[at]].encode(), zlib.crc32(heads[text_of[at]]))
                cut = h % np.uint32(ONE_IN) == 0
                n = np.bincount(codes[~cut], minlength=len(spelled))
                some = np.flatnonzero(n)
                yield pa.RecordBatch.from_arrays([words.vocab.take(pa.array(some)).cast(pa.string()), pa.array(n[some])], schema=schema)
                shorter = []
                for code, x in zip(codes[cut].tolist(), h[cut].tolist(), strict=True):
                    word = spelled[code]
                    at = x % len(word)
                    if len(word) > least_size:
                        shorter.append(word[:at] + word[at + 1 :])
                yield pa.RecordBatch.from_arrays([pa.array(shorter, pa.string()), pa.array(np.ones(len(shorter), np.int64))], schema=schema)

    rows = docs.select(F.col("doc_id").cast("string").alias("id"), "text").where(F.col("text").isNotNull())
    return rows.mapInArrow(tidy(run), "word string, n bigint").groupBy("word").agg(F.sum("n").alias("n"))


class WaveletTree:
    """A sequence of distinct numbers below ``2 ** bits``, level by level: at each the numbers are split by one bit, in stable order."""

    def __init__(self, values: np.ndarray) -> None:
        self.bits = max(1, int(len(values) - 1).bit_length())
        self.zeros_before, self.zeros = [], []
        for b in reversed(range(self.bits)):
            one = (values >> b) & 1 == 1
            self.zeros_before.append(np.concatenate([[0], np.cumsum(~one)]))
            self.zeros.append(len(values) - int(one.sum()))
            values = np.concatenate([values[~one], values[one]])

    def report(self, first: np.ndarray, last: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(query, value) of all values in [low, high) at the places [first, last), for arrays of queries."""
        query, value = np.arange(len(first)), np.zeros(len(first), np.int64)
        for level, b in enumerate(reversed(range(self.bits))):
            before = self.zeros_before[level]
            left, right = before[first], before[last]
            query, value = np.concatenate([query, query]), np.concatenate([value, value | (1 << b)])
            first, last = np.concatenate([left, self.zeros[level] + first - left]), np.concatenate([right, self.zeros[level] + last - right])
            open_ = (first < last) & (value < high[query]) & (value + (1 << b) > low[query])
            query, value, first, last = query[open_], value[open_], first[open_], last[open_]
        return query, value


class _Order:
    """Rows of (segment, word) in sorted order, with the interval of those that share a segment and the first characters."""

    def __init__(self, segment: np.ndarray, chars: np.ndarray) -> None:
        self.chars = chars
        keys = self._keys(segment, chars)
        self.rows = np.argsort(keys, kind="stable")
        self.keys = keys[self.rows]
        self.rank = np.empty(len(keys), np.int64)
        self.rank[self.rows] = np.arange(len(keys))

    @staticmethod
    def _keys(segment: np.ndarray, chars: np.ndarray) -> np.ndarray:
        held = np.concatenate([segment.astype(">u4").view(np.uint8).reshape(-1, 4), chars], axis=1)
        return np.ascontiguousarray(held).view(f"S{held.shape[1]}").ravel()

    def interval(self, segment: np.ndarray, rows: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
        """Places of the words of the segments that begin with the first ``size`` characters of ``rows``."""
        chars = self.chars[rows].copy()
        chars[:, size:] = 0
        low = np.searchsorted(self.keys, self._keys(segment, chars), "left")
        chars[:, size:] = 255
        return low, np.searchsorted(self.keys, self._keys(segment, chars), "right")


def near_pairs(size: int, group: np.ndarray, longer: np.ndarray, edit: np.ndarray, low: np.ndarray, high: np.ndarray, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Rows (a, b), both ways, of words of one group one edit apart within the window [low, high).

    Words have ``size`` characters, ``longer`` ones one more, each a byte.  An inserted character that
    equals the one before it could stand there too; only the first of such places counts, so that
    a pair comes once over all windows.
    """
    longest = size + 1
    chars = np.frombuffer(b"".join(w.ljust(longest, b"\0") for w in words), np.uint8).reshape(len(words), longest)
    backward = np.frombuffer(b"".join(w[::-1].ljust(longest, b"\0") for w in words), np.uint8).reshape(len(words), longest)
    segment = 2 * group + longer
    forward, reverse = _Order(segment, chars), _Order(segment, backward)
    tree = WaveletTree(reverse.rank[forward.rows])
    found: list[tuple[np.ndarray, np.ndarray]] = []
    base = forward.rows[~longer[forward.rows]]
    for p in range(size + 1):
        rows = base[(low[base] <= p) & (p < high[base])]
        for inserted in (0, 1):
            behind = size - p - (1 - inserted)
            asked = rows[edit[rows] != (REPLACED if inserted else INSERTED)]
            if behind < 0 or not len(asked):
                continue
            a, b = forward.interval(segment[asked] + inserted, asked, p)
            least = 1 if inserted else 2  # a replaced word finds itself
            some = b - a >= least
            asked, a, b = asked[some], a[some], b[some]
            c, d = reverse.interval(segment[asked] + inserted, asked, behind)
            some = d - c >= least
            asked, a, b, c, d = asked[some], a[some], b[some], c[some], d[some]
            query, value = tree.report(a, b, c, d)
            one, other = asked[query], reverse.rows[value]
            if inserted:
                first = np.ones(len(other), bool) if p == 0 else chars[other, p] != chars[other, p - 1]
                one, other = one[first], other[first]
                found.append((other, one))
            else:
                one, other = one[one != other], other[one != other]
            found.append((one, other))
    return np.concatenate([f[0] for f in found] or [np.zeros(0, np.int64)]), np.concatenate([f[1] for f in found] or [np.zeros(0, np.int64)])


def _group_key(word: Column, size: Column, edit: Column, low: Column, high: Column) -> Column:
    """Of class, kind, window, and the characters outside of it; behind an insertion one more is shared."""
    behind = F.greatest(size - high + F.when(edit == INSERTED, 1).otherwise(0), F.lit(0))
    return F.xxhash64(size, edit, low, high, F.substring(word, F.lit(1), low), F.substring(word, F.length(word) - behind + 1, behind))


def grouped(words: DataFrame, least_size: int, most: int) -> DataFrame:
    """word, n, size, longer, edit, low, high, key: each word in the groups in which it can have near words."""
    columns = ["word", "n", "size", "longer", "edit", "low", "high"]
    length = F.length("word")
    classes = F.array(F.struct(length.alias("size"), F.lit(False).alias("longer")), F.struct((length - 1).alias("size"), F.lit(True).alias("longer")))
    rows = words.select("word", "n", F.explode(classes).alias("c")).select("word", "n", "c.size", "c.longer", F.lit(BOTH).alias("edit"), F.lit(0).alias("low"), (F.col("c.size") + 1).alias("high"))

    def halved(rows: DataFrame, edits: Column) -> DataFrame:
        middle = F.floor((F.col("low") + F.col("high")) / 2).cast("int")
        window = F.explode(F.array(F.struct(F.col("low"), middle.alias("high")), F.struct(middle.alias("low"), F.col("high"))))
        cut = rows.withColumn("edit", F.explode(edits)).withColumn("w", window).where("w.low < w.high")
        return cut.select("word", "n", "size", "longer", "edit", "w.low", "w.high").where(f"NOT (longer AND edit = {REPLACED})").select(columns)

    rows = halved(rows.where(F.col("size") >= least_size), F.array("edit"))
    done = None
    while True:
        rows = rows.withColumn("key", _group_key(F.col("word"), F.col("size"), F.col("edit"), F.col("low"), F.col("high")))
        # at most one key for ``most`` rows
        large = durable(rows.where(f"high - low > 1 OR edit = {BOTH}").groupBy("key").count().where(F.col("count") > most).select("key"))
        if large.isEmpty():
            return rows if done is None else done.unionByName(rows)
        keep = rows.join(large, "key", "left_anti")
        done = keep if done is None else done.unionByName(keep)
        kinds = F.when(F.col("edit") == BOTH, F.array(F.lit(REPLACED), F.lit(INSERTED))).otherwise(F.array("edit"))
        rows = stored(halved(rows.join(large, "key", "left_semi"), kinds))


def near_words(words: DataFrame, least_size: int = 1, most: int = GROUP) -> DataFrame:
    """word, n_near, best: of each word that has near words, how many, and (n, word) of the most frequent, ties to the smaller.

    ``words`` has distinct words (characters up to U+00FF, ``least_size`` or more of them) and n.  Groups of a
    task are searched class by class in one structure; what tasks find is summed up for each word.
    """
    rows = stored(grouped(words, least_size, most))
    parts = max(int(words.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-rows.count() // TASK_ROWS))
    schema = pa.schema([("word", pa.string()), ("n_near", pa.int64()), ("n", pa.int64()), ("form", pa.string())])

    def search(held: list[pa.RecordBatch]) -> pa.RecordBatch:
        found = pa.Table.from_batches(held)
        spelled = [w.encode("latin-1") for w in found.column("word").to_pylist()]
        n, longer, edit, low, high = (found.column(c).to_numpy() for c in ("n", "longer", "edit", "low", "high"))
        group = np.unique(found.column("key").to_numpy(), return_inverse=True)[1]
        one, other = near_pairs(found.column("size")[0].as_py(), group, longer, edit, low, high, spelled)
        rank = np.empty(len(spelled), np.int64)
        rank[np.argsort(np.array(spelled), kind="stable")] = np.arange(len(spelled))
        order = np.lexsort((rank[other], -n[other], one))
        one, other = one[order], other[order]
        first = np.flatnonzero(np.concatenate([[True], one[1:] != one[:-1]])) if len(one) else np.zeros(0, np.int64)
        count = np.diff(np.append(first, len(one)))
        take = lambda rows: found.column("word").take(pa.array(rows)).combine_chunks()
        return pa.RecordBatch.from_arrays([take(one[first]), pa.array(count.astype(np.int64)), pa.array(n[other[first]]), take(other[first])], schema=schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            size = batch.column("size").to_numpy()
            cuts = [0, *(np.flatnonzero(np.diff(size)) + 1).tolist(), batch.num_rows]
            for a, b in zip(cuts, cuts[1:], strict=False):
                if held and a < b and held[0].column("size")[0].as_py() != size[a]:
                    yield search(held)
                    held = []
                if a < b:
                    held.append(batch.slice(a, b - a))
        if held:
            yield search(held)

    dealt = rows.repartition(parts, "key").sortWithinPartitions("size")
    found = dealt.mapInArrow(tidy(run), "word string, n_near bigint, n bigint, form string")
    best = F.min(F.struct((-F.col("n")).alias("minus"), "form"))
    sums = found.groupBy("word").agg(F.sum("n_near").alias("n_near"), best.alias("b"))
    return sums.select("word", "n_near", F.struct((-F.col("b.minus")).alias("n"), F.col("b.form").alias("form")).alias("best"))


def roots(forms: DataFrame) -> DataFrame:
    """word, root of rows (word, form): the last word reached by following forms, which never lead back, by doubling."""
    held = durable(forms.select("word", F.col("form").alias("root")))
    while True:
        ahead = held.select(F.col("word").alias("root"), F.col("root").alias("next"))
        step = held.join(ahead, "root", "left")
        held = durable(step.select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")))
        if held.where("moved").isEmpty():
            return held.select("word", "root")
        held = held.select("word", "root")


def spelling_variants(docs: DataFrame, least_size: int = 6, least_n: int = 5, ratio: int = 5) -> DataFrame:
    """word, n, n_near, form, form_n, root of the words of all texts.

    Near words differ by one inserted, deleted or replaced code point.  The form is the near word of
    largest n, ties to the smaller in code-point order, if that n is at least ``ratio`` times the word's; root is
    where the forms lead to, the word itself without one.  Null and empty texts have no words, runs of any
    length count, repeated rows count each, a null doc_id is an empty text in the checksum, other
    columns play no part; an empty table gives no rows.
    """
    if ratio < 2:
        raise ValueError("forms have to grow")
    words = stored(counted_runs(docs, least_size).where(F.col("n") >= least_n))
    near = near_words(words, least_size)
    rows = words.join(near, "word", "left")
    is_form = F.col("best.n") >= ratio * F.col("n")
    rows = stored(rows.select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(is_form, F.col("best.form")).alias("form"), F.when(is_form, F.col("best.n")).alias("form_n")))
    ends = roots(rows.where("form IS NOT NULL"))
    return rows.join(ends, "word", "left").select("word", "n", "n_near", "form", "form_n", F.coalesce("root", "word").alias("root"))


def op11_wavelet_spelling(spark, sf_dir: str) -> DataFrame:
    """Spelling variants of the words of all documents; cases as in :func:`spelling_variants`."""
    return spelling_variants(table(spark, sf_dir, "documents"))
