"""Quality rules: a linear-chain conditional random field labels lines as content or boilerplate.

Lines are runs between line feeds.  Each line that has a word gets binary features (length,
signs, case, repetition, line endings, position).  The field is trained in numpy by maximum
likelihood with forward-backward sums.  Its line labels are weak ones (:func:`line_labels`): lines
repeated in their document or met in several surroundings are boilerplate wherever they stand,
those of a label-0 document are unless they read like the lines of label-1 documents.  Viterbi
decoding labels the lines of a document together, and the share of words in content lines decides
whether it is kept.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from .shared import Words, fitted, mix64, sigmoid, table, text_blocks, tidy

#: Labelled documents that the fit uses at most, and lines of a training chain (longer documents are several chains).
SAMPLE, CHAIN = 2000, 150
#: Different surroundings from which a line is a common one, and the chance from which a line of a label-0 document counts as content.
COMMON, CLEAN = 3, 0.9
#: Share of words in content lines from which a document is kept.
KEEP = 0.5
MIN_WORDS = 50
SIGNS = r"[#*$%&|<>]"


class Lines:
    """Words, lines and base counts of a batch of texts; null texts have none."""

    def __init__(self, texts: pa.Array) -> None:
        texts = pc.fill_null(texts.cast(pa.large_string()), "")
        n = len(texts)
        split = pc.split_pattern(texts, "\n")
        line_doc = np.repeat(np.arange(n), np.diff(split.offsets.to_numpy()))
        lines = split.flatten()
        words = Words(lines)
        self.size = np.diff(words.starts)
        used = self.size > 0
        coded = lines.filter(pa.array(used)).dictionary_encode()
        self.doc = line_doc[used]
        self.line = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        self.words, self.size = words, self.size[used]
        self.starts = np.concatenate([[0], np.cumsum(self.size)])
        word_doc = np.repeat(self.doc, self.size)
        vocab = words.vocab
        self.length = pc.utf8_length(vocab).to_numpy(zero_copy_only=False).astype(np.int64) if len(vocab) else np.zeros(0, np.int64)
        self.signs = pc.count_substring_regex(vocab, SIGNS).to_numpy(zero_copy_only=False).astype(np.int64) if len(vocab) else np.zeros(0, np.int64)
        code = words.codes
        self.n_words = np.bincount(word_doc, minlength=n)
        self.word_chars = np.bincount(word_doc, self.length[code], minlength=n).astype(np.int64)
        self.n_symbols = np.bincount(word_doc, self.signs[code], minlength=n).astype(np.int64)
        # a line equal to an earlier line of its document
        order = np.lexsort((np.arange(len(self.line)), self.line, self.doc))
        same = np.zeros(len(order), bool)
        same[1:] = (self.line[order][1:] == self.line[order][:-1]) & (self.doc[order][1:] == self.doc[order][:-1])
        self.repeated = np.zeros(len(order), bool)
        self.repeated[order] = same
        self.n_dup_lines = np.bincount(self.doc, self.repeated, minlength=n).astype(np.int64)
        self.in_repeat = self._repeats(code, word_doc)
        self.n_repeat_words = np.bincount(word_doc, self.in_repeat, minlength=n).astype(np.int64)

    @staticmethod
    def _repeats(code: np.ndarray, doc: np.ndarray) -> np.ndarray:
        """Whether each word is in a three-word window found twice or more in its text."""
        out = np.zeros(len(code), bool)
        if len(code) < 3:
            return out
        with np.errstate(over="ignore"):
            key = mix64(code[:-2].astype(np.uint64) + np.uint64(0x9E3779B97F4A7C15))
            key = mix64(key * np.uint64(3) + code[1:-1].astype(np.uint64))
            key = mix64(key * np.uint64(3) + code[2:].astype(np.uint64))
            key = mix64(key * np.uint64(3) + doc[2:].astype(np.uint64))
        at = np.flatnonzero(doc[:-2] == doc[2:])
        key = key[at]
        order = np.argsort(key)
        same = key[order][1:] == key[order][:-1]
        twice = np.zeros(len(at), bool)
        twice[order[1:][same]] = True
        twice[order[:-1][same]] = True
        hit = at[twice]
        for step in range(3):
            out[hit + step] = True
        return out

    def features(self) -> np.ndarray:
        """Binary features of the lines with a word, lines x FEATURES."""
        code, starts, size = self.words.codes, self.starts, self.size
        vocab = self.words.vocab

        def total(values: np.ndarray) -> np.ndarray:
            ends = np.concatenate([[0.0], np.cumsum(values)])
            return ends[starts[1:]] - ends[starts[:-1]]

        def of(pattern: str) -> np.ndarray:
            return (pc.count_substring_regex(vocab, pattern).to_numpy(zero_copy_only=False).astype(np.float64) if len(vocab) else np.zeros(0))[code]

        chars = np.maximum(total(self.length[code]), 1)
        letters = np.maximum(total(of(r"\p{L}")), 1)
        upper, digits, signs = total(of(r"\p{Lu}")) / letters, total(of(r"\p{N}")) / chars, total(self.signs[code]) / chars
        shout = total(of(r"!!")) / size
        same = np.zeros(len(code))
        same[1:] = code[1:] == code[:-1]
        same[starts[:-1][size > 0]] = 0
        same = total(same) / size
        mean = chars / size
        repeat = total(self.in_repeat) / size
        first = np.ones(len(size), bool)
        first[1:] = self.doc[1:] != self.doc[:-1]
        last = np.ones(len(size), bool)
        last[:-1] = first[1:]
        end = code[starts[1:] - 1] if len(size) else code[:0]
        stop = (pc.match_substring_regex(vocab, r"[.!?…:]$").to_numpy(zero_copy_only=False) if len(vocab) else np.zeros(0, bool))[end]
        cuts = lambda x, *at: [x >= a for a in at]
        return np.column_stack([
            np.ones(len(size), bool), *cuts(size, 2, 4, 8, 16, 40, 100), *cuts(upper, 0.1, 0.3, 0.6, 0.9), *cuts(digits, 0.02, 0.2), *cuts(signs, 0.005, 0.05, 0.15, 0.3),
            *cuts(shout, 0.1, 0.5), *cuts(same, 0.05, 0.2, 0.5), *cuts(mean, 3, 5, 8, 12), *cuts(repeat, 0.1, 0.5, 0.9), self.repeated, first, last, stop,
        ]).astype(np.float64)


class Field:
    """A two-label linear chain; label 1 is content.  ``unary`` is features x 2, ``pair`` 2 x 2."""

    def __init__(self, unary: np.ndarray, pair: np.ndarray) -> None:
        self.unary, self.pair = unary, pair

    def decode(self, features: np.ndarray, doc: np.ndarray) -> np.ndarray:
        """The best label of every line, all documents of the batch step by step together; a tie is content."""
        score = features @ self.unary
        labels = np.zeros(len(doc), np.int8)
        if not len(doc):
            return labels
        begins = np.flatnonzero(np.concatenate([[True], doc[1:] != doc[:-1]]))
        count = np.diff(np.concatenate([begins, [len(doc)]]))
        order = np.argsort(-count, kind="stable")
        begins, count = begins[order], count[order]
        back = np.zeros((len(doc), 2), np.int8)
        best = score[begins]
        final = np.zeros((len(begins), 2))
        for step in range(1, int(count[0]) + 1):
            live = int(np.searchsorted(-count, -step, "left"))  # those with more lines than step
            final[live : len(best)] = best[live:]
            if not live:
                break
            at = begins[:live] + step
            ways = best[:live, :, None] + self.pair
            came = (ways[:, 1] >= ways[:, 0]).astype(np.int8)
            back[at] = came
            best = np.take_along_axis(ways, came[:, None, :].astype(np.int64), 1)[:, 0] + score[at]
        now = (final[:, 1] >= final[:, 0]).astype(np.int8)
        for step in range(int(count[0]) - 1, -1, -1):
            live = int(np.searchsorted(-count, -step, "left"))
            at = begins[:live] + step
            labels[at] = now[:live]
            now[:live] = back[at, now[:live]]
        return labels


def train(features: np.ndarray, doc: np.ndarray, label: np.ndarray, rounds: int = 80, ridge: float = 1e-3) -> Field:
    """Adam on the mean log-likelihood of the label sequences; documents padded to the longest."""
    width = features.shape[1] if features.ndim == 2 else 1
    field = Field(np.zeros((width, 2)), np.zeros((2, 2)))
    if not len(doc) or len(set(label.tolist())) < 2:
        field.unary[0, 1] = 1.0
        return field
    begins = np.flatnonzero(np.concatenate([[True], doc[1:] != doc[:-1]]))
    count = np.diff(np.concatenate([begins, [len(doc)]]))
    steps, n = int(count.max()), len(begins)
    real = np.arange(steps)[:, None] < count
    at = np.minimum(begins + np.arange(steps)[:, None], len(doc) - 1)
    y = label[at]
    balance = np.where(label == 1, 0.5 / (label == 1).mean(), 0.5 / (label == 0).mean()) ** 0.5
    weight = np.array([balance[b : b + c].mean() / c for b, c in zip(begins, count, strict=True)])
    hot = np.eye(2)
    first, second = [0.0, 0.0], [0.0, 0.0]
    rows = at[real]
    for step in range(1, rounds + 1):
        score = (features @ field.unary)[at]
        forward, backward = np.zeros((steps, n, 2)), np.zeros((steps, n, 2))
        forward[0] = score[0]
        for t in range(1, steps):
            forward[t] = np.where(real[t][:, None], score[t] + np.logaddexp(forward[t - 1][:, :1] + field.pair[0], forward[t - 1][:, 1:] + field.pair[1]), forward[t - 1])
        for t in range(steps - 2, -1, -1):
            ahead = score[t + 1] + backward[t + 1]
            backward[t] = np.where(real[t + 1][:, None], np.logaddexp(field.pair[:, 0] + ahead[:, :1], field.pair[:, 1] + ahead[:, 1:]), 0.0)
        total = np.logaddexp(forward[-1, :, 0], forward[-1, :, 1])
        node = np.exp(forward + backward - total[:, None])
        lost = (node - hot[y]) * real[:, :, None] * weight[:, None]
        gradient = features[rows].T @ lost[real] / weight.sum() + ridge * field.unary
        both = np.zeros((2, 2))
        live = real[1:]
        edge = np.exp(forward[:-1, :, :, None] + field.pair + (score[1:] + backward[1:])[:, :, None, :] - total[:, None, None])
        truth = hot[y[:-1]][:, :, :, None] * hot[y[1:]][:, :, None, :]
        both = ((edge - truth) * (live * weight)[:, :, None, None]).sum((0, 1)) / weight.sum() + ridge * field.pair
        for k, (g, target) in enumerate(((gradient, field.unary), (both, field.pair))):
            first[k] = 0.9 * first[k] + 0.1 * g
            second[k] = 0.99 * second[k] + 0.01 * g * g
            target -= 0.1 * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.99**step)) + 1e-9)
    return field


def line_labels(lines: Lines, features: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Weak labels, 1 for content, of all lines of documents with labels ``y``.

    Boilerplate is what repeats an earlier line of its document, or nearly all of whose words are in
    repeated windows, or is met between COMMON different pairs of neighbouring lines (license and
    navigation lines; copies of a document have the same neighbours and don't count).  Other lines
    of label-1 documents are content.  Those of label-0 documents are content where a field without
    neighbours, fitted on the documents' labels, gives them a chance of CLEAN.
    """
    n = len(lines.doc)
    if not n:
        return np.zeros(0, np.int64)
    same = lines.doc[1:] == lines.doc[:-1]
    before, after = np.full(n, -1), np.full(n, -1)
    before[1:][same], after[:-1][same] = lines.line[:-1][same], lines.line[1:][same]
    places = np.unique(np.column_stack([lines.line, before, after]), axis=0)[:, 0]
    common = np.bincount(places, minlength=int(lines.line.max()) + 1)[lines.line] >= COMMON
    ends = np.concatenate([[0.0], np.cumsum(lines.in_repeat)])
    looped = ends[lines.starts[1:]] - ends[lines.starts[:-1]] >= 0.9 * lines.size
    plain = common | lines.repeated | looped
    label = y[lines.doc].astype(np.int64)
    alone = train(features, np.arange(n), label)
    score = features @ alone.unary
    clean = (label == 1) | (sigmoid(score[:, 1] - score[:, 0]) >= CLEAN)
    return (clean & ~plain).astype(np.int64)


def train_documents(texts: list[str], y: np.ndarray) -> Field:
    """The field from documents and their labels; each CHAIN lines of a document are a chain of their own."""
    lines = Lines(pa.array(texts, pa.large_string()))
    if not len(lines.doc):
        return train(np.zeros((0, 1)), np.zeros(0, np.int64), np.zeros(0, np.int64))
    features = lines.features()
    begins = np.searchsorted(lines.doc, np.arange(len(texts) + 1))
    chain = (np.arange(len(lines.doc)) - begins[lines.doc]) // CHAIN
    chain = np.cumsum(np.diff(lines.doc * (chain.max() + 1) + chain, prepend=0) != 0)
    return train(features, chain, line_labels(lines, features, y))


def trained(docs: DataFrame, labels: DataFrame, label: str = "quality", sample: int = SAMPLE) -> Field:
    """The field, from at most ``sample`` labelled documents, half of them of each class if there are so many."""
    return fitted(docs, labels, label, 1, -1, sample, train_documents, balance=True)


COLUMNS = (("n_words", "bigint"), ("word_chars", "bigint"), ("n_symbols", "bigint"), ("n_dup_lines", "bigint"), ("n_repeat_words", "bigint"), ("content_share", "double"), ("base_failed", "boolean"), ("kept", "boolean"))


def apply_rules(docs: DataFrame, labels: DataFrame, field: Field | None = None, lines: bool = False) -> DataFrame:
    """``docs`` with the columns of COLUMNS added, replacing any of those names; ``lines`` adds ``content_lines``.

    ``content_lines`` has the numbers, from 0, of the lines labelled content, counting lines with
    a word.  A text without words (null, empty or blank) has zero counts, share 0, fails the base
    rule and isn't kept.  Whole texts are read, of any length, repeated rows alike; a tie of two
    labellings goes to content; an empty table stays empty; other columns pass through.
    """
    kept = docs.drop(*[c for c, _ in COLUMNS], "content_lines")
    model = docs.sparkSession.sparkContext.broadcast(trained(docs, labels) if field is None else field)
    names = [c for c, _ in COLUMNS] + ["content_lines"] * lines
    schema = f"{kept._jdf.schema().toDDL()}, " + ", ".join(f"{c} {t}" for c, t in COLUMNS) + ", content_lines array<int>" * lines

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in text_blocks(whole):
                found = Lines(batch.column("text"))
                label = model.value.decode(found.features(), found.doc)
                content = np.bincount(found.doc, found.size * label, minlength=batch.num_rows)
                share = content / np.maximum(found.n_words, 1)
                failed = (found.n_words < MIN_WORDS) | (100 * found.n_repeat_words > 50 * found.n_words)
                out = [found.n_words, found.word_chars, found.n_symbols, found.n_dup_lines, found.n_repeat_words, share, failed, ~failed & (share >= KEEP)]
                columns = [pa.array(x) for x in out]
                if lines:
                    begins = np.searchsorted(found.doc, np.arange(batch.num_rows + 1))
                    place = np.arange(len(label)) - begins[found.doc]
                    good = label == 1
                    offsets = np.concatenate([[0], np.cumsum(np.bincount(found.doc[good], minlength=batch.num_rows))])
                    columns.append(pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(place[good], pa.int32())))
                yield pa.RecordBatch.from_arrays([*batch.columns, *columns], [*batch.schema.names, *names])

    return kept.mapInArrow(tidy(run), schema)


def op6_crf_line_rules(spark, sf_dir: str) -> DataFrame:
    """Counts, content share and verdict of every document; null and empty texts as in :func:`apply_rules`."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return apply_rules(docs, table(spark, sf_dir, "labels")).drop("text")
