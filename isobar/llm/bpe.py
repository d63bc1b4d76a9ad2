"""BPE encoding with a minimal acyclic transducer for frequent words, and decoding.

The corpus is counted once; its most frequent words and their token ids are compiled on the
driver into a minimal acyclic automaton over UTF-8 bytes (equal suffixes share states).  Every
transition carries the number of words that sort before those behind it, so the sum along an
accepting path is the word's rank, which indexes the id outputs.  The arrays go to the executors
as one broadcast of a size bounded by ``LEXICON_WORDS``; Spark keeps it in one file for each
executor, which all its Python workers map read-only.  A batch's distinct words walk the automaton
together; words outside are merged by the BPE rules themselves.  Encoding and decoding share one
worker.  Ids equal those of the ``tokenizers`` library with special tokens recognised in the text
and none added.
"""

from __future__ import annotations

import functools
import heapq
import json
import os
import pickle
import struct
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame, SparkSession, functions as F

from .shared import Words, stored, table, text_blocks, tidy

#: Words compiled into the automaton at most, and bytes of the longest.
LEXICON_WORDS = 100_000
LONGEST = 64
#: Tokens that are turned into text at a time.
DECODED_TOKENS = 100_000
#: Bytes of words outside the lexicon that a worker remembers with their ids, and what an entry costs beside its text and ids.
REMEMBERED_BYTES, ENTRY = 32_000_000, 180
#: Symbols from which a piece is merged with a heap.
LONG_PIECE = 48
#: How a compiled automaton begins; where a file holds it, its arrays begin at a multiple of 8 bytes.
MAGIC = b"isobar lexicon 1"

#: White space as Unicode's White_Space has it.
_SPACE = "\\t-\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"
#: The tokenizer file's split pattern.
_PIECES = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^" + _SPACE + r"\p{L}\p{N}]+")
_PLAIN = regex.compile("[\x00-ɏ]*")


class Merger:
    """Exact BPE of single words, by a tokenizer file with word ends (normaliser NFC, lower case)."""

    def __init__(self, path: str) -> None:
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        self.vocab: dict[str, int] = model["vocab"]
        self.end = model["end_of_word_suffix"]
        pairs = (tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["merges"])
        self.ranks = {pair: rank for rank, pair in enumerate(pairs)}
        self.added = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.split = regex.compile("(" + "|".join(map(regex.escape, sorted(self.added, key=len, reverse=True))) + ")")
        self.byte_chars = _byte_chars()
        self.path = path
        self._library = None

    def _normal_pieces(self, text: str) -> list[str]:
        """Normalised pieces of a text without special tokens, still as ordinary characters."""
        if _PLAIN.fullmatch(text):
            return _PIECES.findall(text.lower().replace("\xa0", " "))
        if self._library is None:
            from tokenizers import Tokenizer

            self._library = Tokenizer.from_file(self.path)
        # characters outside Latin: the library's own Unicode tables decide
        normal = self._library.normalizer.normalize_str(text)
        return [normal[a:b] for _, (a, b) in self._library.pre_tokenizer.pre_tokenize_str(normal)]

    def merge(self, piece: str) -> list[int]:
        """Token ids of one piece: merge the adjacent pair of lowest rank, leftmost first, until none is left."""
        symbols = [self.byte_chars[b] for b in piece.encode("utf-8")]
        symbols[-1] += self.end
        if len(symbols) >= LONG_PIECE:
            return self._merge_long(symbols)
        rank, none = self.ranks.get, len(self.ranks)
        found = [rank(pair, none) for pair in zip(symbols, symbols[1:])]
        while found:
            best = min(found)
            if best == none:
                break
            # only the pairs beside the merged one change
            i = found.index(best)
            symbols[i] += symbols.pop(i + 1)
            del found[i]
            if i:
                found[i - 1] = rank((symbols[i - 1], symbols[i]), none)
            if i < len(found):
                found[i] = rank((symbols[i], symbols[i + 1]), none)
        return [self.vocab[s] for s in symbols]

    def _merge_long(self, symbols: list[str]) -> list[int]:
        """The same by a heap of pairs over a linked list, so that n symbols take n log n steps."""
        n, rank = len(symbols), self.ranks.get
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        queue = [(r, i) for i in range(n - 1) if (r := rank((symbols[i], symbols[i + 1]))) is not None]
        heapq.heapify(queue)
        while queue:
            r, i = heapq.heappop(queue)
            j = after[i]
            # out of date: the symbol is gone, or has another neighbour by now
            if not symbols[i] or j >= n or rank((symbols[i], symbols[j])) != r:
                continue
            symbols[i] += symbols[j]
            symbols[j] = ""
            k = after[i] = after[j]
            if k < n:
                before[k] = i
                if (r := rank((symbols[i], symbols[k]))) is not None:
                    heapq.heappush(queue, (r, i))
            h = before[i]
            if h >= 0 and (r := rank((symbols[h], symbols[i]))) is not None:
                heapq.heappush(queue, (r, h))
        return [self.vocab[s] for s in symbols if s]

    def word(self, word: str) -> list[int]:
        """Token ids of a run without ASCII white space."""
        ids: list[int] = []
        for part in self.split.split(word) if "<|" in word else [word]:
            if part in self.added:
                ids.append(self.added[part])
            elif part:
                for piece in self._normal_pieces(part):
                    ids += self.merge(piece)
        return ids


@functools.lru_cache(2)
def merger_of(path: str) -> Merger:
    """One merger for each file and Python worker."""
    return Merger(path)


def _byte_chars() -> list[str]:
    """The printable character that stands for each byte: itself where printable in Latin-1, else from 256 on."""
    kept = set(range(33, 127)) | set(range(161, 173)) | set(range(174, 256))
    spare = iter(range(256, 512))
    return [chr(b) if b in kept else chr(next(spare)) for b in range(256)]


def compile_automaton(words: Iterable[tuple[bytes, list[int]]]) -> bytes:
    """The transducer of distinct words with their ids, as one block of arrays.

    Words are added in sorted order; a finished branch is replaced by an equal registered
    state, so the automaton is minimal at every step.
    """
    entries = sorted(words)
    register: dict[tuple, int] = {}
    finals: list[bool] = []
    arcs: list[tuple] = []
    counts: list[int] = []

    def freeze(final: bool, out: list[tuple[int, int]]) -> int:
        key = (final, *out)
        state = register.get(key)
        if state is None:
            state = register[key] = len(finals)
            finals.append(final)
            arcs.append(tuple(out))
            counts.append(final + sum(counts[t] for _, t in out))
        return state

    path: list[list] = [[False, []]]  # the unfinished branch: final?, finished arcs
    before = b""
    for word, _ in entries:
        common = len(os.path.commonprefix([before, word]))
        for depth in range(len(before), common, -1):
            final, out = path.pop()
            path[-1][1].append((before[depth - 1], freeze(final, out)))
        path += [[False, []] for _ in word[common:]]
        path[-1][0] = True
        before = word
    for depth in range(len(before), 0, -1):
        final, out = path.pop()
        path[-1][1].append((before[depth - 1], freeze(final, out)))
    root = freeze(*path[0])
    keys, targets, skips = [], [], []
    for state, out in enumerate(arcs):
        skipped = int(finals[state])
        for label, target in out:
            keys.append(state << 8 | label)
            targets.append(target)
            skips.append(skipped)
            skipped += counts[target]
    if len(finals) >= 1 << 24:
        raise ValueError("the automaton has too many states")
    starts = np.cumsum([0] + [len(ids) for _, ids in entries])
    blocks = [np.array(x, "<u4") for x in ([root], keys, targets, skips, finals, starts, [i for _, ids in entries for i in ids])]
    head = np.array([len(b) for b in blocks], "<u4")
    return MAGIC + head.tobytes() + b"".join(b.tobytes() for b in blocks)


class Automaton:
    """A compiled transducer; its arrays are views of the given bytes, which may be a mapped file."""

    def __init__(self, block: bytes | np.ndarray) -> None:
        words = np.frombuffer(block, np.uint8)[len(MAGIC) :].view("<u4")
        lengths, at, parts = words[:7].tolist(), 7, []
        for n in lengths:
            parts.append(words[at : at + n])
            at += n
        self.root, self.keys, self.targets, self.skips, self.finals, self.starts, self.ids = parts

    @staticmethod
    def shipped(block: bytes) -> bytes:
        """``block`` behind so many blanks that its arrays are aligned in the file of a broadcast."""
        return b" " * (-pickle.dumps(block, 5).index(MAGIC) % 8) + block

    @classmethod
    def of(cls, broadcast) -> Automaton:
        """The automaton of a broadcast of :meth:`shipped` bytes: mapped from the executor's file of it, if there is one."""
        path = getattr(broadcast, "_path", None)
        if path and os.path.exists(path):
            mapped = np.memmap(path, np.uint8, "r")
            at, size = bytes(mapped[:256]).find(MAGIC), len(MAGIC)
            if at >= 0:
                head = mapped[at + size : at + size + 28].view("<u4").astype(np.int64)
                return cls(mapped[at : at + size + 28 + 4 * int(head.sum())])
        value = broadcast.value
        return cls(value[value.index(MAGIC) :])

    def ranks(self, words: pa.Array) -> np.ndarray:
        """Each word's rank in the lexicon, -1 if it isn't in it."""
        n = len(words)
        found = np.full(n, -1, np.int64)
        if not n or not len(self.keys):
            return found
        raw = words.cast(pa.large_binary())
        offsets = np.frombuffer(raw.buffers()[1], np.int64, n + 1, raw.offset * 8)
        data = np.frombuffer(raw.buffers()[2], np.uint8) if raw.buffers()[2] else np.zeros(1, np.uint8)
        lengths = np.diff(offsets)
        row = np.flatnonzero((lengths > 0) & (lengths <= LONGEST))
        state, rank = np.full(len(row), self.root[0], np.uint32), np.zeros(len(row), np.uint32)
        for step in range(LONGEST):
            if not len(row):
                break
            key = state << np.uint32(8) | data[offsets[row] + step]
            arc = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
            there = self.keys[arc] == key
            row, arc = row[there], arc[there]
            state, rank = self.targets[arc], rank[there] + self.skips[arc]
            ended = lengths[row] == step + 1
            good = ended & (self.finals[state] == 1)
            found[row[good]] = rank[good]
            row, state, rank = row[~ended], state[~ended], rank[~ended]
        return found


_WORKER: dict = {}


class Encoder:
    """Encodes batches of texts in one Python worker."""

    def __init__(self, path: str, automaton: Automaton) -> None:
        self.merger = merger_of(path)
        self.automaton = automaton
        self.known: dict[str, bytes] = {}
        self.held = 0

    def outside(self, word: str) -> bytes:
        """Ids of a word that the lexicon doesn't have."""
        ids = self.known.get(word)
        if ids is None:
            found = self.merger.word(word)
            ids = struct.pack(f"<{len(found)}I", *found)
            if len(word) <= LONGEST:
                self.held += len(word) + len(ids) + ENTRY
                if self.held > REMEMBERED_BYTES:
                    self.known.clear()
                    self.held = 0
                self.known[word] = ids
        return ids

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts one after the other, where each text begins)."""
        words = Words(texts)
        ranks = self.automaton.ranks(words.vocab)
        outside = np.flatnonzero(ranks < 0)
        lex = self.automaton
        lengths, begins = np.zeros(len(ranks), np.int32), np.zeros(len(ranks), np.int32)
        inside = np.flatnonzero(ranks >= 0)
        begins[inside] = lex.starts[ranks[inside]]
        lengths[inside] = lex.starts[ranks[inside] + 1] - lex.starts[ranks[inside]]
        more, at = [], len(lex.ids)
        for i, word in zip(outside.tolist(), words.vocab.take(pa.array(outside)).to_pylist(), strict=True):
            more.append(self.outside(word))
            lengths[i], begins[i] = len(more[-1]) // 4, at
            at += len(more[-1]) // 4
        pool = np.concatenate([lex.ids, np.frombuffer(b"".join(more), "<u4")])
        per_word = lengths[words.codes]
        ends = np.concatenate([[0], np.cumsum(per_word, dtype=np.int64)])
        picks = np.arange(ends[-1], dtype=np.int32)
        picks += np.repeat((begins[words.codes] - ends[:-1]).astype(np.int32), per_word)
        return pool[picks], ends[words.starts]


def _encoder(path: str, block) -> Encoder:
    # the broadcast is held with its encoder, so that no other one can take its identity
    if _WORKER.get("path") != path or _WORKER.get("block") is not block:
        _WORKER.update(path=path, block=block, encoder=Encoder(path, Automaton.of(block)))
    return _WORKER["encoder"]


def count_words(docs: DataFrame) -> DataFrame:
    """word, n: how often each run without ASCII white space occurs over all texts; counted in each task first."""

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.Table] = []
        rows = 0

        def merged() -> pa.Table:
            return pa.concat_tables(held).group_by("word", use_threads=False).aggregate([("n", "sum")]).rename_columns(["word", "n"])

        for whole in batches:
            for batch in text_blocks(whole):
                words = Words(batch.column("text"))
                n = np.bincount(words.codes, minlength=len(words.vocab)).astype(np.int64)
                held.append(pa.table({"word": words.vocab.cast(pa.string()), "n": n}))
                rows += len(n)
                if rows > 400_000:
                    held = [merged()]
                    rows = len(held[0])
                    if rows > 200_000:
                        yield from held[0].to_batches()
                        held, rows = [], 0
        if held:
            yield from merged().to_batches()

    return docs.select("text").mapInArrow(tidy(counted), "word string, n bigint").groupBy("word").agg(F.sum("n").alias("n"))


def build_lexicon(docs: DataFrame, path: str, size: int = LEXICON_WORDS) -> bytes:
    """The compiled automaton of the ``size`` most frequent words of ``docs``, ties to the smaller word.

    A histogram of the counts, some hundred rows, says from which count on the words are enough;
    only those are sorted, so that no task gathers ``size`` words of every partition.
    """
    counts = stored(count_words(docs).where(F.octet_length("word") <= LONGEST))
    bins = counts.groupBy(F.floor(F.log2("n") * 16).alias("bin")).agg(F.count(F.lit(1)).alias("k")).collect()
    least, total = 0, 0
    for row in sorted(bins, key=lambda r: -r["bin"]):
        least, total = row["bin"], total + row["k"]
        if total >= size:
            break
    top = counts.where(F.floor(F.log2("n") * 16) >= least).orderBy(F.desc("n"), "word").limit(size)
    merger = merger_of(path)
    return compile_automaton((r["word"].encode(), merger.word(r["word"])) for r in top.collect())


def encode(docs: DataFrame, path: str, lexicon: bytes | None = None, decoded: bool = False) -> DataFrame:
    """``docs`` with ``ids`` (binary, little-endian unsigned 32-bit) added; replaces a column of that name.

    Null, empty and blank texts give no ids, an empty table an empty one.  Texts and words of any
    length are read whole; repeated rows give equal ids; other columns pass through.  With
    ``decoded``, the same worker adds what :func:`decode` would (replacing that column).
    """
    block = docs.sparkSession.sparkContext.broadcast(Automaton.shipped(build_lexicon(docs, path) if lexicon is None else lexicon))
    added = {"ids": "binary"} | ({"decoded": "string"} if decoded else {})
    kept = docs.drop(*added)
    schema = ", ".join([kept._jdf.schema().toDDL()] * bool(kept.columns) + [f"{name} {kind}" for name, kind in added.items()])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in text_blocks(whole, 2_000_000):
                ids, starts = _encoder(path, block).encode(batch.column("text"))
                offsets = pa.py_buffer((starts * 4).astype(np.int64))
                out = pa.Array.from_buffers(pa.large_binary(), len(starts) - 1, [None, offsets, pa.py_buffer(ids)])
                more = [_decoder(path)(out)] if decoded else []
                yield pa.RecordBatch.from_arrays([*batch.columns, out.cast(pa.binary()), *more], [*batch.schema.names, *added])

    return kept.mapInArrow(tidy(run), schema)


@functools.lru_cache(1)
def _decoder(path: str) -> Callable[[pa.Array], pa.Array]:
    """A function from ids to texts."""
    merger = merger_of(path)
    tokens = {i: t for t, i in (merger.vocab | merger.added).items()}
    flat = [(tokens.get(i, "") + " ").encode() for i in range(max(tokens) + 1)]
    starts = np.concatenate([[0], np.cumsum([len(t) for t in flat])]).astype(np.int32)
    data, lengths = np.frombuffer(b"".join(flat), np.uint8), np.diff(starts)
    del tokens, flat

    def texts(raw: pa.Array) -> pa.Array:
        raw = pc.fill_null(raw.cast(pa.large_binary()), b"")
        offsets = np.frombuffer(raw.buffers()[1], np.int64, len(raw) + 1, raw.offset * 8)
        ids = np.frombuffer(raw.buffers()[2] or b"", "<u4", (offsets[-1] - offsets[0]) // 4, int(offsets[0]))
        ends = np.concatenate([[0], np.cumsum(lengths[ids], dtype=np.int64)])
        text = np.empty(ends[-1], np.uint8)
        for a in range(0, len(ids), DECODED_TOKENS):
            b = min(a + DECODED_TOKENS, len(ids))
            size = lengths[ids[a:b]]
            place = np.arange(ends[b] - ends[a], dtype=np.int32)
            place += np.repeat((starts[ids[a:b]] - (ends[a:b] - ends[a])).astype(np.int32), size)
            text[ends[a] : ends[b]] = data[place]
        cuts = ends[(offsets - offsets[0]) // 4]
        # each text ends in one blank too many
        some = np.diff(cuts) > 0
        text = np.delete(text, cuts[1:][some] - 1)
        cuts = cuts - np.concatenate([[0], np.cumsum(some)])
        return pa.Array.from_buffers(pa.large_string(), len(raw), [None, pa.py_buffer(cuts.astype(np.int64)), pa.py_buffer(text)]).cast(pa.string())

    return texts


def decode(frame: DataFrame, path: str) -> DataFrame:
    """``frame`` with ``decoded`` added: the tokens of ``ids`` joined by blanks, special tokens kept (the file names no decoder).

    Null and empty ids give an empty text; ids of any length are decoded whole, repeated rows
    alike; an empty table stays empty; other columns pass through, one of that name is replaced.
    """
    kept = frame.drop("decoded")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in [whole.slice(i, 256) for i in range(0, whole.num_rows, 256)]:
                yield pa.RecordBatch.from_arrays([*batch.columns, _decoder(path)(batch.column("ids"))], [*batch.schema.names, "decoded"])

    return kept.mapInArrow(tidy(run), f"{kept._jdf.schema().toDDL()}, decoded string")


def tokenizer_path(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op9_bpe_transducer(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of every document's ids and of the text they decode to; a null text counts as empty."""
    coded = encode(table(spark, sf_dir, "documents").select("doc_id", "text"), tokenizer_path(), decoded=True)
    return coded.select("doc_id", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"), F.sha2(F.encode("decoded", "UTF-8"), 256).alias("decoded_sha256"))
