"""Toxicity: a bidirectional gated recurrent network with attention pooling, trained in numpy.

Words are inputs of two kinds.  Word input: the class log-odds of the word as it stands, and of
its lower-case core.  Character input: the largest and the mean log-odds of the word's character
n-grams (3 to 6 long, word edges marked; those at its start apart, also in lower case) and a
learned embedding of its letters.  Words of any length are read whole, long ones in overlapping
pieces.  A text is cut into overlapping windows of words; in each, a forward and a backward gated recurrent layer read the inputs, attention pools
their states, and a linear layer gives the window's logit.  The network is trained on documents
as bags of windows through a smooth maximum, by back-propagation and Adam: of a training document,
all windows are searched for evidence and the BAG strongest are the bag.  A document's score
comes from its largest window logit, with a curve that allows for the number of windows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from .shared import Words, fitted, give_back, is_held, logistic_fit, mix64, sigmoid, string_hashes, table, with_score

#: Labelled documents that the fit uses at most.
SAMPLE = 6000
#: Words of a window, and from the start of one to the next.
WINDOW, STRIDE = 48, 32
WORD_BUCKETS, GRAM_BUCKETS = 1 << 16, 1 << 19
#: Bytes of a word that one row of its byte matrix holds; longer words are several rows.
READ = 24
#: From the start of a row of a longer word to the next: n-grams of 6 that start before the next row lie in this one.
STEP = READ + 2 - 5
#: Rows whose n-grams are held at a time.
ROWS = 10_000
HIDDEN, LETTERS, LETTER_SIZE, STATS = 8, 64, 4, 7
#: Windows of a labelled document, those of the largest evidence among all of its windows, that the network is fitted on.
BAG = 3
#: Documents that the fit goes through at least, in all its epochs together, and epochs at most.
PASSES, EPOCHS = 12_000, 60
#: Logit of a text without words.
NOTHING = -4.0
#: Words whose inputs a Python worker remembers.
REMEMBERED = 200_000


def _sizes(words: pa.Array) -> np.ndarray:
    """Bytes of each word."""
    return pc.binary_length(words).to_numpy(zero_copy_only=False).astype(np.int64)


def piece_counts(words: pa.Array) -> np.ndarray:
    """In how many overlapping pieces each word is read."""
    return 1 + np.maximum(0, -(-(_sizes(words) - READ) // STEP))


def _letters(words: pa.Array, owner: np.ndarray | None = None, nth: np.ndarray | None = None) -> np.ndarray:
    """Byte matrix of ^word$, padded by 0: the first READ + 2 bytes of each word, or the ``nth`` piece of each of ``owner``."""
    raw = words.cast(pa.large_binary())
    offsets = np.frombuffer(raw.buffers()[1], np.int64, len(raw) + 1, raw.offset * 8)
    data = np.frombuffer(raw.buffers()[2] or b"\0", np.uint8)
    owner = np.arange(len(words)) if owner is None else owner
    begin, size = offsets[owner, None], np.diff(offsets)[owner, None]
    place = np.arange(READ + 2) + (0 if nth is None else nth[:, None] * STEP)
    out = np.where(place <= size, data[np.clip(begin + place - 1, 0, len(data) - 1)], 3 * (place == size + 1)).astype(np.uint8)
    out[np.broadcast_to(place == 0, out.shape)] = 2
    return out


def gram_buckets(letters: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(bucket of each n-gram, -1 where none; whether it is at the word's start), both words x n-grams."""
    columns, edge = [], []
    x = letters.astype(np.uint64)
    with np.errstate(over="ignore"):
        for n in (3, 4, 5, 6):
            span = letters.shape[1] - n + 1
            h = np.zeros((len(letters), span), np.uint64)
            for j in range(n):
                h = h * np.uint64(263) + x[:, j : j + span]
            h = (mix64(h + np.uint64(n) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(40)).astype(np.int32) % GRAM_BUCKETS
            h[letters[:, n - 1 :] == 0] = -1
            columns.append(h)
            edge.append(np.arange(span) == 0)
    return np.hstack(columns), np.concatenate(edge)


def piece_grams(letters: np.ndarray, nth: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """As :func:`gram_buckets` for pieces: each n-gram of a word is in one piece only, and the first has the word's start."""
    grams, edge = gram_buckets(letters)
    if last.all() and not nth.any():
        return grams, np.broadcast_to(edge, grams.shape)
    start = np.concatenate([np.arange(letters.shape[1] - n + 1) for n in (3, 4, 5, 6)])
    return np.where(last[:, None] | (start < STEP), grams, -1), edge & (nth == 0)[:, None]


class Inputs:
    """Inputs of distinct words: the statistics and the letters' shares."""

    def __init__(self, word_odds: np.ndarray, gram_odds: np.ndarray) -> None:
        self.word_odds, self.gram_odds = word_odds, gram_odds

    def of(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        if not len(words):
            return np.zeros((0, STATS), np.float32), np.zeros((0, LETTERS), np.float32)
        count = piece_counts(words)
        ends = np.cumsum(count)
        # of all n-grams and of those at the start: the largest, the sum, and how many
        top, total, number = np.full((len(words), 2), -9, np.float32), np.zeros((len(words), 2)), np.zeros(len(words), np.int64)
        shares = np.zeros((len(words), LETTERS), np.float32)
        for a in range(0, int(ends[-1]), ROWS):
            row = np.arange(a, min(a + ROWS, int(ends[-1])))
            owner = np.searchsorted(ends, row, "right")
            nth = row - (ends[owner] - count[owner])
            last = nth == count[owner] - 1
            letters = _letters(words, owner, nth)
            grams, edge = piece_grams(letters, nth, last)
            there = grams >= 0
            odds = np.where(there, self.gram_odds[grams], -9).astype(np.float32)
            begins = np.flatnonzero(np.diff(owner, prepend=-1))
            own = owner[begins]
            some = edge.any(0)
            largest = np.column_stack([odds.max(1), np.where(edge[:, some], odds[:, some], -9).max(1, initial=-9)])
            summed = np.column_stack([np.where(there, odds, 0).sum(1), np.where(there[:, some] & edge[:, some], odds[:, some], 0).sum(1)])
            top[own] = np.maximum(top[own], np.maximum.reduceat(largest, begins))
            total[own] += np.add.reduceat(summed, begins)
            number[own] += np.add.reduceat(there.sum(1), begins)
            letters[~last, STEP:] = 0
            at, cols = np.nonzero(letters)
            counts = np.bincount((owner[at] - owner[0]) * LETTERS + letters[at, cols] % LETTERS, minlength=(owner[-1] - owner[0] + 1) * LETTERS)
            shares[owner[0] : owner[-1] + 1] += counts.reshape(-1, LETTERS)
        stats = np.column_stack([
            self.word_odds[word_buckets(words)],
            np.maximum(top, -3),
            total[:, 0] / np.maximum(number, 1),
            total[:, 1] / 4,
            self.word_odds[core_buckets(words)],
            np.where((plain := start_buckets(words)) >= 0, self.gram_odds[plain], 0).sum(1) / 4,
        ]).astype(np.float32)
        return stats, shares / np.maximum(_sizes(words), READ)[:, None].astype(np.float32)


def letter_counts(letters: np.ndarray) -> np.ndarray:
    """How often each letter class occurs in each word, over READ or its size; rows of bytes, or such shares as they are."""
    if letters.dtype == np.float32:
        return letters
    rows, cols = np.nonzero(letters)
    counts = np.bincount(rows * LETTERS + letters[rows, cols] % LETTERS, minlength=len(letters) * LETTERS).reshape(-1, LETTERS)
    return (counts / READ).astype(np.float32)


def word_buckets(words: pa.Array) -> np.ndarray:
    return (string_hashes(words) % np.uint64(WORD_BUCKETS)).astype(np.int64)


def _core(words: pa.Array) -> pa.Array:
    """Lower case, without what isn't a letter or digit at either end."""
    return pc.utf8_lower(pc.replace_substring_regex(words, r"^[^\p{L}\p{N}]+|[^\p{L}\p{N}]+$", ""))


def core_buckets(words: pa.Array) -> np.ndarray:
    return ((string_hashes(_core(words)) ^ np.uint64(0xC0DE)) % np.uint64(WORD_BUCKETS)).astype(np.int64)


def start_buckets(words: pa.Array) -> np.ndarray:
    """Buckets of the n-grams at the start of the word in lower case, apart from those of its own case."""
    grams, edge = gram_buckets(_letters(_core(words))[:, :8])
    grams = grams[:, edge]
    return np.where(grams >= 0, grams ^ 1, -1)


def class_counts(texts: list[str], y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """In how many documents of each class (rows) the word and n-gram buckets occur."""
    up, down = (np.zeros((2, n)) for n in (WORD_BUCKETS, GRAM_BUCKETS))
    for a in range(0, len(texts), 250):
        words = Words(pa.array(texts[a : a + 250], pa.large_string()))
        n = len(words.starts) - 1
        if not len(words.vocab):
            continue
        doc = np.repeat(np.arange(n), np.diff(words.starts))
        pairs = np.unique(doc * len(words.vocab) + words.codes)
        doc, code = pairs // len(words.vocab), pairs % len(words.vocab)
        own = y[a : a + 250]
        seen = np.unique(np.concatenate([doc * WORD_BUCKETS + b[code] for b in (word_buckets(words.vocab), core_buckets(words.vocab))]))
        up += np.bincount(own[seen // WORD_BUCKETS] * WORD_BUCKETS + seen % WORD_BUCKETS, minlength=up.size).reshape(up.shape)
        # the first pieces' n-grams are held, those of further pieces are few or made block by block
        count = piece_counts(words.vocab)
        first = np.zeros(len(count), np.int64)
        grams = np.hstack([piece_grams(_letters(words.vocab), first, count == 1)[0], start_buckets(words.vocab)])
        ends = np.cumsum(count[code])
        before = np.zeros(0, np.int64)
        for b in range(0, int(ends[-1]), 15_000):
            row = np.arange(b, min(b + 15_000, int(ends[-1])))
            pair = np.searchsorted(ends, row, "right")
            word = code[pair]
            nth = row - (ends[pair] - count[word])
            g = grams[word]
            more = np.flatnonzero(nth)
            if len(more):
                g[more] = -1
                g[more, :-4] = piece_grams(_letters(words.vocab, word[more], nth[more]), nth[more], nth[more] == count[word[more]] - 1)[0]
            seen = np.unique(np.where(g >= 0, doc[pair, None] * GRAM_BUCKETS + g, -1))
            # a document cut by the block border counts a bucket once
            seen = np.setdiff1d(seen[seen >= 0], before, assume_unique=True)
            down += np.bincount(own[seen // GRAM_BUCKETS] * GRAM_BUCKETS + seen % GRAM_BUCKETS, minlength=down.size).reshape(down.shape)
            before = np.concatenate([before, seen])
            before = before[before // GRAM_BUCKETS == doc[pair[-1]]]
    return up, down


def class_odds(counts: tuple[np.ndarray, np.ndarray], share: float) -> tuple[np.ndarray, np.ndarray]:
    """Log-odds of class 1 for each bucket against its share of the documents, drawn to 0 where few have the bucket."""
    prior = 4.0

    def odds(count: np.ndarray) -> np.ndarray:
        return (np.log(count[1] + prior * share) - np.log(count[0] + prior * (1 - share)) - np.log(share / (1 - share))).astype(np.float32)

    return odds(counts[0]), odds(counts[1])


SHAPES = {
    "letters": (LETTERS, LETTER_SIZE), "wf": (STATS + LETTER_SIZE, 3 * HIDDEN), "uf": (HIDDEN, 3 * HIDDEN), "bf": (3 * HIDDEN,),
    "wb": (STATS + LETTER_SIZE, 3 * HIDDEN), "ub": (HIDDEN, 3 * HIDDEN), "bb": (3 * HIDDEN,), "att": (2 * HIDDEN, HIDDEN), "pick": (HIDDEN,), "out": (2 * HIDDEN,), "bias": (1,),
}


def _gru(p: np.ndarray, u: np.ndarray, keep: bool):
    """States over time of a gated recurrent layer; p: time x windows x 3 hidden, the projected inputs."""
    h = np.zeros((p.shape[1], HIDDEN), np.float32)
    states, cache = np.empty((len(p), p.shape[1], HIDDEN), np.float32), []
    for t in range(len(p)):
        gates = p[t, :, : 2 * HIDDEN] + h @ u[:, : 2 * HIDDEN]
        gates = sigmoid(gates)
        z, r = gates[:, :HIDDEN], gates[:, HIDDEN:]
        c = np.tanh(p[t, :, 2 * HIDDEN :] + (r * h) @ u[:, 2 * HIDDEN :])
        if keep:
            cache.append((h, z, r, c))
        h = h + z * (c - h)
        states[t] = h
    return states, cache


def _gru_back(grad: np.ndarray, cache: list, u: np.ndarray):
    """Gradients of the projected inputs and of u, from those of the states."""
    dp, du = np.empty((*grad.shape[:2], 3 * HIDDEN), np.float32), np.zeros_like(u)
    carry = np.zeros_like(grad[0])
    for t in range(len(grad) - 1, -1, -1):
        h, z, r, c = cache[t]
        g = grad[t] + carry
        dc = g * z * (1 - c * c)
        dz = g * (c - h) * z * (1 - z)
        rh = dc @ u[:, 2 * HIDDEN :].T
        dr = rh * h * r * (1 - r)
        gates = np.hstack([dz, dr])
        carry = g * (1 - z) + rh * r + gates @ u[:, : 2 * HIDDEN].T
        du[:, : 2 * HIDDEN] += h.T @ gates
        du[:, 2 * HIDDEN :] += (r * h).T @ dc
        dp[t, :, : 2 * HIDDEN], dp[t, :, 2 * HIDDEN :] = gates, dc
    return dp, du


class Network:
    #: Largest log of the number of windows that the curve was fitted on.
    longest = np.inf

    def __init__(self, weights: dict[str, np.ndarray], inputs: Inputs, curve: np.ndarray, limit: int = REMEMBERED) -> None:
        self.w, self.inputs, self.curve = weights, inputs, curve
        self.limit = limit
        self.forget()

    def forget(self) -> None:
        """Drop the projected inputs of the words seen so far."""
        self.known: dict[str, int] = {}
        self.store = np.empty((16_384, 6 * HIDDEN), np.float32)

    def __getstate__(self) -> dict:
        return {"w": self.w, "inputs": self.inputs, "curve": self.curve, "limit": self.limit, "longest": self.longest}

    def __setstate__(self, state: dict) -> None:
        self.__dict__.update(state)
        self.forget()

    def pooled(self, forward: np.ndarray, backward: np.ndarray, real: np.ndarray):
        """(logits, states, attention parts) of windows from both layers' states over time."""
        both = np.concatenate([forward, backward], 2)
        hidden = np.tanh(both @ self.w["att"])
        weight = hidden @ self.w["pick"]
        weight = np.where(real, weight, -30)
        weight = np.exp(weight - weight.max(0))
        weight /= weight.sum(0)
        mean = np.einsum("tnh,tn->nh", both, weight, optimize=False)
        return mean @ self.w["out"] + self.w["bias"][0], both, hidden, weight, mean

    def projected(self, stats: np.ndarray, letters: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        x = np.hstack([stats, letter_counts(letters) @ self.w["letters"]])
        return x, x @ self.w["wf"] + self.w["bf"], x @ self.w["wb"] + self.w["bb"]

    def _rows(self, vocab: pa.Array) -> np.ndarray:
        """Where each word's projected inputs are in the worker's store."""
        words = vocab.to_pylist()
        if len(self.known) > self.limit:
            self.forget()
        at = np.array([self.known.get(w, -1) for w in words], np.int64)
        new = np.flatnonzero(at < 0)
        for a in range(0, len(new), 10_000):
            part = new[a : a + 10_000]
            _, f, b = self.projected(*self.inputs.of(vocab.take(pa.array(part))))
            first = len(self.known)
            if first + len(part) > len(self.store):
                self.store = np.concatenate([self.store, np.empty((max(len(self.store), len(part)), 6 * HIDDEN), np.float32)])
            self.store[first : first + len(part)] = np.hstack([f, b])
            at[part] = first + np.arange(len(part))
            self.known.update((words[i], int(at[i])) for i in part)
        return at

    def window_logits(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(largest window logit, number of windows) of each text; a text without words has one window of logit NOTHING."""
        words = Words(texts)
        owner, first, length = windows(words.starts)
        best = np.full(len(texts), -np.inf)
        if len(owner):
            at = self._rows(words.vocab)[words.codes]
            order = np.argsort(length, kind="stable")
            for a in range(0, len(order), 2048):
                part = order[a : a + 2048]
                span = int(length[part].max())
                step = np.arange(span)[:, None]
                real = step < length[part]
                pick = at[np.minimum(first[part] + np.minimum(step, length[part] - 1), len(at) - 1)]
                p = self.store[pick]
                p[~real] = 0
                forward, _ = _gru(p[:, :, : 3 * HIDDEN], self.w["uf"], False)
                backward, _ = _gru(p[::-1, :, 3 * HIDDEN :], self.w["ub"], False)
                np.maximum.at(best, owner[part], self.pooled(forward, backward[::-1], real)[0])
        count = np.bincount(owner, minlength=len(texts))
        return np.where(count > 0, best, NOTHING), np.maximum(count, 1)

    def score(self, texts: pa.Array) -> np.ndarray:
        logit, count = self.window_logits(texts)
        # no further than the longest document that the curve was fitted on
        return sigmoid(np.column_stack([logit, np.minimum(np.log(count), self.longest), np.ones(len(logit))]) @ self.curve)


def windows(starts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, first word, words) of all windows: every STRIDE words until the text's end is covered."""
    size = np.diff(starts)
    count = np.where(size > 0, 1 + np.maximum(0, -(-(size - WINDOW) // STRIDE)), 0)
    owner = np.repeat(np.arange(len(size)), count)
    nth = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
    offset = nth * STRIDE
    return owner, starts[owner] + offset, np.minimum(WINDOW, size[owner] - offset)


def _bags(texts: list[str], inputs: Inputs, per: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(statistics, letter shares, word ids) for training: each document's ``per`` windows of the largest evidence, ids -1 past the end."""
    stats, letters, ids, base = [], [], [], 0
    for a in range(0, len(texts), 250):
        words = Words(pa.array(texts[a : a + 250], pa.large_string()))
        s, c = inputs.of(words.vocab)
        strong = s[:, 0] + s[:, 1] + s[:, 4] + s[:, 5] + s[:, 6]
        owner, first, length = windows(words.starts)
        step = np.arange(WINDOW)
        grid = np.where(step < length[:, None], first[:, None] + np.minimum(step, length[:, None] - 1), -1)
        code = np.where(grid >= 0, words.codes[np.maximum(grid, 0)], -1)
        evidence = np.where(code >= 0, strong[np.maximum(code, 0)], -99).max(1) if len(code) else np.zeros(0)
        order = np.lexsort((-evidence, owner))
        begins = np.searchsorted(owner[order], np.arange(len(words.starts) - 1))
        rank = np.arange(len(order)) - begins[owner[order]]
        chosen = np.full((len(words.starts) - 1, per, WINDOW), -1)
        keep = rank < per
        chosen[owner[order][keep], rank[keep]] = code[order[keep]]
        used = np.unique(chosen[chosen >= 0])
        place = np.zeros(len(s) + 1, np.int64)
        place[used] = base + np.arange(len(used))
        ids.append(np.where(chosen >= 0, place[chosen], -1))
        stats.append(s[used])
        letters.append(c[used])
        base += len(used)
    return np.concatenate(stats), np.concatenate(letters), np.concatenate(ids)


def fit(weights: dict, stats: np.ndarray, letters: np.ndarray, bags: np.ndarray, y: np.ndarray, epochs: int, rng: np.random.Generator) -> None:
    """Adam on the bags' cross-entropy; weights change in place."""
    first, second, step, batch = {k: 0 * v for k, v in weights.items()}, {k: 0 * v for k, v in weights.items()}, 0, 96
    rate = np.where(y == 1, 0.5 / max((y == 1).mean(), 1e-3), 0.5 / max((y != 1).mean(), 1e-3)) ** 0.5
    for epoch in range(epochs):
        order = rng.permutation(len(y))
        for a in range(0, len(order), batch):
            part = order[a : a + batch]
            grads = _bag_gradients(weights, stats, letters, bags[part], y[part], rate[part])
            step += 1
            pace = 0.01 * (1 - 0.9 * epoch / max(epochs - 1, 1))
            for k, g in grads.items():
                first[k] = 0.9 * first[k] + 0.1 * g
                second[k] = 0.999 * second[k] + 0.001 * g * g
                weights[k] -= (pace * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.999**step)) + 1e-8)).astype(np.float32)


def _bag_gradients(w: dict, stats: np.ndarray, letters: np.ndarray, bags: np.ndarray, y: np.ndarray, rate: np.ndarray) -> dict:
    net = Network(w, None, np.zeros(3))  # type: ignore[arg-type]
    docs, per, _ = bags.shape
    flat = bags.reshape(docs * per, WINDOW)
    used, place = np.unique(np.maximum(flat, 0), return_inverse=True)
    place = place.reshape(flat.shape).T
    real = (flat >= 0).T
    x, pf, pb = net.projected(stats[used], letters[used])
    gate = real[:, :, None]
    forward, cf = _gru((pf[place] * gate).astype(np.float32), w["uf"], True)
    backward, cb = _gru((pb[place] * gate)[::-1].astype(np.float32), w["ub"], True)
    logit, both, hidden, weight, mean = net.pooled(forward, backward[::-1], real)
    grid = np.where(real.any(0).reshape(docs, per), logit.reshape(docs, per), -30)
    top = grid.max(1, keepdims=True)
    soft = np.exp(4 * (grid - top))
    soft /= soft.sum(1, keepdims=True)
    error = (sigmoid((soft * grid).sum(1)) - y) * rate / docs
    d = (error[:, None] * soft).reshape(-1).astype(np.float32)
    g: dict = {"bias": np.array([d.sum()], np.float32), "out": mean.T @ d}
    dmean = d[:, None] * w["out"]
    dweight = np.einsum("tnh,nh->tn", both, dmean)
    dboth = weight[:, :, None] * dmean
    dscore = weight * (dweight - (weight * dweight).sum(0))
    g["pick"] = np.einsum("tnk,tn->k", hidden, dscore)
    dhidden = dscore[:, :, None] * w["pick"] * (1 - hidden * hidden)
    g["att"] = np.einsum("tnh,tnk->hk", both, dhidden, optimize=True)
    dboth = dboth + dhidden @ w["att"].T
    dpf, g["uf"] = _gru_back(dboth[:, :, :HIDDEN], cf, w["uf"])
    dpb, g["ub"] = _gru_back(dboth[::-1, :, HIDDEN:], cb, w["ub"])
    dx = np.zeros_like(x)
    for name, dp in (("f", dpf), ("b", dpb[::-1])):
        dp = dp * gate
        summed = np.zeros((len(used), 3 * HIDDEN), np.float32)
        np.add.at(summed, place.reshape(-1), dp.reshape(-1, 3 * HIDDEN))
        g[f"w{name}"], g[f"b{name}"] = x.T @ summed, summed.sum(0)
        dx += summed @ w[f"w{name}"].T
    g["letters"] = letter_counts(letters[used]).T @ dx[:, STATS:]
    return {k: v.astype(np.float32) + np.float32(1e-5) * w[k] for k, v in g.items()}


def train(texts: list[str], y: np.ndarray, share: float, epochs: int = 8, seed: int = 5) -> Network:
    """Fit the network; ``share`` is class 1's share among all labels, for the score's level.

    The statistics that a training document sees come from the other half of the sample, so that
    the network learns how far to trust them; the final ones come from all of it.
    """
    rng = np.random.default_rng(seed)
    weights = {k: (rng.normal(0, 0.3, s) if len(s) > 1 or k in ("out", "pick") else np.zeros(s)).astype(np.float32) for k, s in SHAPES.items()}
    if len(y) < 4 or len(set(y.tolist())) < 2:
        share = min(max(share, 0.02), 0.98)
        return Network(weights, Inputs(np.zeros(WORD_BUCKETS, np.float32), np.zeros(GRAM_BUCKETS, np.float32)), np.array([0, 0, np.log(share / (1 - share))]))
    now = float((y == 1).mean())
    half = np.zeros(len(y), np.int64)
    for own in (np.flatnonzero(y == 1), np.flatnonzero(y != 1)):
        half[rng.permutation(own)] = np.arange(len(own)) % 2
    tallies = [class_counts([t for t, k in zip(texts, half, strict=True) if k == h], y[half == h]) for h in (0, 1)]
    others = [Inputs(*class_odds(tallies[1 - h], now)) for h in (0, 1)]
    parts = []
    for h, inputs in enumerate(others):
        mine = np.flatnonzero(half == h)
        parts.append((mine, *_bags([texts[i] for i in mine], inputs, BAG)))
    shift = len(parts[0][1])
    stats, letters = np.vstack([parts[0][1], parts[1][1]]), np.vstack([parts[0][2], parts[1][2]])
    bags = np.concatenate([parts[0][3], np.where(parts[1][3] >= 0, parts[1][3] + shift, -1)])
    order = np.concatenate([parts[0][0], parts[1][0]])
    del parts
    give_back()
    rounds = max(epochs, min(EPOCHS, PASSES // len(y)))
    fit(weights, stats, letters, bags, y[order], rounds, rng)
    del stats, letters, bags
    net = Network(weights, Inputs(*class_odds(tuple(a + b for a, b in zip(*tallies, strict=True)), now)), np.zeros(3))
    # the curve: documents under the other half's statistics, weighted to the true share by its intercept
    logits, number = np.zeros(len(y)), np.zeros(len(y))
    for h in (0, 1):
        mine = np.flatnonzero(half == h)
        own = Network(weights, others[h], np.zeros(3), limit=10_000)
        for a in range(0, len(mine), 250):
            block = mine[a : a + 250]
            logits[block], number[block] = own.window_logits(pa.array([texts[i] for i in block], pa.large_string()))
    net.curve = logistic_fit(np.column_stack([logits, np.log(number)]), y, ridge=0.5)
    net.longest = float(np.log(number).max())
    net.curve[2] += np.log(share / (1 - share)) - np.log(now / (1 - now))
    return net


def trained(docs: DataFrame, labels: DataFrame, label: str = "toxic", folds: int = 4, held: int = 2, sample: int = SAMPLE) -> Network:
    """The network, from at most ``sample`` labelled documents outside the held-out fold, half of them of each class if there are so many."""
    known = labels.where(~is_held(F.col("doc_id"), folds, held)).agg(F.avg((F.col(label) == 1).cast("double"))).first()[0]
    share = min(max(known or 0.1, 0.01), 0.99)
    return fitted(docs, labels, label, folds, held, sample, lambda texts, y: train(texts, y, share), balance=True)


def toxicity_scores(docs: DataFrame, labels: DataFrame, label: str = "toxic", folds: int = 4, held: int = 2, sample: int = SAMPLE, name: str = "score") -> DataFrame:
    """``docs`` with ``score`` (or ``name``), the probability of label 1 (0 to 1, also for null and empty texts).

    All overlapping windows of every text are scored, however long; equal texts and repeated rows
    get equal scores.  Without labels of both classes the score is one constant.  An empty table
    stays empty; other columns pass through, one of that name is replaced.
    """
    model = docs.sparkSession.sparkContext.broadcast(trained(docs, labels, label, folds, held, sample))
    return with_score(docs, lambda batch: model.value.score(batch), name, block=4_000_000)


def op5_bigru_toxicity(spark, sf_dir: str) -> DataFrame:
    """Every document's toxicity score; null, empty and repeated rows as in :func:`toxicity_scores`."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    scored = toxicity_scores(docs, table(spark, sf_dir, "labels"))
    return scored.select("doc_id", is_held(F.col("doc_id"), 4, 2).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))
