"""N-gram Jaccard join with count-vector R-trees, to connected components.

1.  Each text becomes its set of distinct word shingles, as 64-bit hashes.  Equal sets are one
    class from here on; a class of thousands of copies costs no more than one text.
2.  Hashing puts the tokens of a set into groups.  Two linked sets differ in few tokens, so they
    agree in whole groups, and a key made of a group's content brings them together without
    listing pairs.  Sizes are cut into bands; a set near a band's lower edge has keys in the one
    below as well.  Groups of a single token or none make common keys and are left out; each
    band has so many groups, over one or more groupings, that linked sets share no key with a
    chance of at most MISS, as with equal hashes of different tokens.
3.  The sets with a key in common are tied to the smallest id among them, the centre; a centre and
    the sets tied to it are a star.  Any two sets that can be linked are in one star.
4.  Stars are joined in chunks of CHUNK sets with their centre: the group counts of the sets are
    points of a packed R-tree, whose nodes hold the largest counts and the range of sizes below
    them.  The overlap of two sets is at most the sum of the coordinate minima, of a set and a node
    at most that with the node's largest counts; what survives is verified on the sets themselves.
    So a group of n copies costs n, not n * n.
5.  Only stars of more than one chunk whose sets are still in different components go on: their
    sets are cut into blocks, those of a large component apart, and each pair of blocks that
    aren't of one component is a task of its own with such a tree.
6.  Verified links give the final components.

Nothing is sampled or capped, and no link between different sets is lost (up to chances of
MISS and collisions of 64-bit hashes).
"""

from __future__ import annotations

import functools
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .shared import Words, durable, mix64, stored, string_hashes, table, text_blocks, tidy

#: Coordinates of a point, sets of an R-tree leaf and nodes of an inner node, and sets that walk the tree together.
AXES, LEAF, FAN, WALK = 32, 8, 8, 64
#: Size ratio of a band, tokens from which a group makes a key, and the chance that linked sets share no key.
BAND, SELECTIVE, MISS = 1.5, 2, 1e-12
#: Sets up to this size have groupings by trial, larger ones by the formula for independent groups.
SMALL = 64
#: Sets of a star that are joined with its centre at a time, sets of a block, and shingles of either.  A star of m sets that the chunks
#: leave unlinked goes to its pairs of blocks as m * m / BLOCK rows; a pair is a task of 2 * BLOCK points.
CHUNK, BLOCK, TASK_SHINGLES = 64, 512, 1_000_000
#: Edges that one task of the components' rounds takes.
EDGES_A_TASK = 100_000
#: Rows of (id, task, side) up to which they are broadcast: some 25 MB.
BROADCAST_ROWS = 500_000


def shingle_sets(texts: pa.Array, size: int) -> tuple[np.ndarray, np.ndarray]:
    """(sorted distinct shingle hashes of all texts one after the other, where each text begins).

    A text with fewer than ``size`` words has its whole sequence as one shingle; one without
    words has none.  A-Z are lower-cased.
    """
    words = Words(texts, lower=True)
    n = len(words.starts) - 1
    count = np.diff(words.starts)
    if not len(words.codes):
        return np.zeros(0, np.uint64), np.zeros(n + 1, np.int64)
    h = string_hashes(words.vocab)[words.codes]
    rolled = h.copy()
    with np.errstate(over="ignore"):
        for step in range(1, size):
            rolled = mix64(rolled[: len(h) - step] * np.uint64(0x9E3779B97F4A7C15) + h[step:]) if len(h) > step else rolled[:0]
        short = np.flatnonzero((count > 0) & (count < size))
        whole = []
        for i in short:
            x = np.uint64(count[i])
            for y in h[words.starts[i] : words.starts[i + 1]]:
                x = mix64(np.array([x * np.uint64(0x9E3779B97F4A7C15) + y]))[0]
            whole.append(x)
    doc = np.repeat(np.arange(n), count)
    inside = doc[: len(rolled)] == doc[size - 1 :][: len(rolled)] if len(rolled) else np.zeros(0, bool)
    hashes = np.concatenate([rolled[inside], np.array(whole, np.uint64)])
    owner = np.concatenate([doc[: len(rolled)][inside], short])
    order = np.lexsort((hashes, owner))
    hashes, owner = hashes[order], owner[order]
    new = np.ones(len(hashes), bool)
    new[1:] = (hashes[1:] != hashes[:-1]) | (owner[1:] != owner[:-1])
    hashes, owner = hashes[new], owner[new]
    return hashes, np.searchsorted(owner, np.arange(n + 1))


def bands(size: int, num: int, den: int) -> list[int]:
    """The bands in which a set has keys: its own, and the one below while a partner there can be similar."""
    own = int(math.log(size) / math.log(BAND) + 1e-9)
    return [own] + [own - 1] * (own > 0 and size * num <= BAND**own * den)


@functools.lru_cache(None)
def grouping(band: int, num: int, den: int) -> tuple[int, int]:
    """(groups, groupings) of a band; (0, 0) if only equal sets can link there.

    The hardest linked pair of a size n is a set and one with n (den - num) / num tokens more.
    A group serves if it has none of those and at least SELECTIVE of the common tokens.  The
    cheapest choice is taken for which all groups fail with a chance of at most MISS, at the
    band's lower and upper end.
    """
    low, high = math.ceil(BAND**band), max(math.ceil(BAND**band), math.ceil(BAND ** (band + 1)) - 1)
    cases = [(n, n * (den - num) // num) for n in (low, high)]
    cases = [(n, d) for n, d in cases if d > 0]
    if not cases:
        return 0, 0
    best = (math.inf, 0, 0)
    rng = np.random.default_rng(band)
    # up to one group a token, however large the band
    for groups in sorted({max(2, round(2 * 1.12**k)) for k in range(math.ceil(math.log(max(high, 4)) / math.log(1.12)))}):
        if groups > max(high, 4) or groups >= best[0]:
            break
        worst = 0.0
        for n, d in cases:
            if high <= SMALL:
                trials = 4000
                common, hit = (np.stack([np.bincount(row, minlength=groups) for row in rng.integers(0, groups, (trials, m))]) for m in (n, d))
                serves = ((common >= SELECTIVE) & (hit == 0)).any(1).mean()
                fails = math.log(max(1 - serves + 3 * math.sqrt(serves * (1 - serves) / trials) + 1e-3, 1e-9)) if serves > 0.02 else 0.0
            else:
                few = sum(math.comb(n, j) * (1 / groups) ** j * (1 - 1 / groups) ** (n - j) for j in range(SELECTIVE))
                fails = groups * math.log1p(-((1 - 1 / groups) ** d) * (1 - few))
            worst = fails if not worst else max(worst, fails)
        if worst < -1e-3:
            times = math.ceil(math.log(MISS) / worst)
            if times <= 40 and groups * times < best[0]:
                best = (groups * times, groups, times)
    if not best[1]:
        raise ValueError(f"no grouping for band {band} at similarity {num}/{den}")
    return best[1], best[2]


def _keys(tokens: np.ndarray, num: int, den: int) -> np.ndarray:
    """The keys of one sorted set.  Groups are ranges of a hash, so they are contiguous once sorted."""
    found = []
    for band in bands(len(tokens), num, den) if len(tokens) else ():
        groups, times = grouping(band, num, den)
        for nth in range(times):
            own = tokens if nth == 0 else np.sort(mix64(tokens + np.uint64(nth * 7919)))
            edges = np.linspace(0, 2.0**64, groups + 1)[1:-1].astype(np.uint64)
            cut = np.concatenate([[0], np.searchsorted(own, edges), [len(own)]])
            with np.errstate(over="ignore"):
                sums = np.concatenate([[np.uint64(0)], np.cumsum(mix64(own + np.uint64(0x51ED2701)), dtype=np.uint64)])
                content = sums[cut[1:]] - sums[cut[:-1]]
                name = np.arange(groups, dtype=np.uint64) + np.uint64((band * 64 + nth) << 32)
                key = mix64(content + mix64(name))
            found.append(key[np.diff(cut) >= SELECTIVE])
    return np.concatenate(found) if found else np.zeros(0, np.uint64)


def sketches(docs: DataFrame, size: int, num: int, den: int) -> DataFrame:
    """doc_id, n_shingles, two halves of a set's fingerprint, its keys; one row for each row of ``docs``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in text_blocks(whole):
                tokens, starts = shingle_sets(batch.column("text"), size)
                keys = [_keys(tokens[a:b], num, den).view(np.int64) for a, b in zip(starts[:-1], starts[1:], strict=True)]
                with np.errstate(over="ignore"):
                    sums = [np.concatenate([[np.uint64(0)], np.cumsum(mix64(tokens ^ np.uint64(s)), dtype=np.uint64)]) for s in (1, 2)]
                    prints = [(x[starts[1:]] - x[starts[:-1]]).view(np.int64) for x in sums]
                offsets = np.concatenate([[0], np.cumsum([len(k) for k in keys])])
                lists = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(np.concatenate(keys) if keys else np.zeros(0, np.int64)))
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(np.diff(starts)), *map(pa.array, prints), lists], ["doc_id", "n_shingles", "f1", "f2", "keys"])

    return docs.select(F.col("doc_id").cast("bigint"), "text").mapInArrow(tidy(run), "doc_id bigint, n_shingles bigint, f1 bigint, f2 bigint, keys array<bigint>")


def components(edges: DataFrame, limit: int = 60) -> DataFrame:
    """(id, component) of every id in ``edges`` (a, b): the smallest id it is connected to.

    Alternating large-star and small-star rounds; each is cut off with a checkpoint, and the
    number of rounds grows with the logarithm of the longest path.
    """
    edges = durable(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    n = edges.count()
    # few edges need few tasks: the files of a shuffle are counted by tasks, not by rows
    few = max(1, n // EDGES_A_TASK)
    edges = edges.coalesce(few)
    for _ in range(limit):
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).coalesce(few)
        low = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m")).coalesce(few)
        # large star: larger neighbours go to the smallest one
        large = both.where("b > a").join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").coalesce(few).distinct().coalesce(few)
        # small star: an id and its smaller neighbours go to the smallest of them
        least = large.groupBy("a").agg(F.min("b").alias("m")).coalesce(few)
        small = large.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(least.select("a", F.col("m").alias("b"))).coalesce(few)
        after = durable(small.where("a <> b").distinct().coalesce(few))
        m = after.count()
        same = m == n and after.join(edges, ["a", "b"], "left_anti").isEmpty()
        edges, n = after, m
        if same:
            break
    else:
        raise RuntimeError("components did not settle")
    return edges.select(F.col("a").alias("id"), F.col("b").alias("component")).unionByName(edges.select(F.col("b").alias("id"), F.col("b").alias("component")).distinct())


class Forest:
    """Union-find over the sets of a task; the root is the smallest index."""

    def __init__(self, n: int) -> None:
        self.parent = np.arange(n)

    def root(self, i: int) -> int:
        p = self.parent
        while p[i] != i:
            p[i] = p[p[i]]
            i = p[i]
        return int(i)

    def roots(self) -> np.ndarray:
        p = self.parent
        while True:
            q = p[p]
            if (q == p).all():
                return p
            p[:] = q


def counts_of(tokens: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Points: how many tokens of each set fall into each of AXES hash groups."""
    owner = np.repeat(np.arange(len(starts) - 1), np.diff(starts))
    axis = (mix64(tokens ^ np.uint64(77)) >> np.uint64(59)).astype(np.int64)
    return np.bincount(owner * AXES + axis, minlength=(len(starts) - 1) * AXES).reshape(-1, AXES)


class Tree:
    """A packed R-tree over points: levels of nodes with the largest counts, the size range and the last place below them."""

    def __init__(self, points: np.ndarray, size: np.ndarray) -> None:
        self.levels: list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]] = []
        top, least, most, fan = points, size, size, LEAF
        while len(top) > 1 or not self.levels:
            firsts = np.arange(0, len(top), fan)
            top, least, most = (f.reduceat(x, firsts, axis=0) for f, x in ((np.maximum, top), (np.minimum, least), (np.maximum, most)))
            self.levels.append((top, least, most, np.full(len(top), fan)))
            fan = FAN
        self.points, self.size = points, size

    def pairs(self, who: np.ndarray, num: int, den: int) -> tuple[np.ndarray, np.ndarray]:
        """(i, j) for i of ``who`` and each place j before i whose counts allow a similarity of num / den."""
        points, size = self.points, self.size
        n = len(who)
        i, at = np.repeat(who, len(self.levels[-1][0])), np.tile(np.arange(len(self.levels[-1][0])), n)
        span = LEAF * FAN ** (len(self.levels) - 1)
        for top, least, most, fan in reversed(self.levels):
            own = size[i]
            reach = (at * span < i) & (den * most[at] >= num * own) & (num * least[at] <= den * own)
            i, at = i[reach], at[reach]
            near = np.minimum(points[i], top[at]).sum(1) * (num + den) >= num * (size[i] + least[at])
            i, at = i[near], at[near]
            width = int(fan[0])
            below = span // width
            i, at = np.repeat(i, width), (at[:, None] * width + np.arange(width)).ravel()
            span = below
            there = at * span < len(points)
            i, at = i[there], at[there]
        return i, at

    @staticmethod
    def order(points: np.ndarray, size: np.ndarray, ids: np.ndarray) -> np.ndarray:
        """Places of the sets for packing: halves of halves along the widest axis down to a leaf."""
        out, todo = [], [np.lexsort((ids, size))]
        while todo:
            part = todo.pop()
            if len(part) <= LEAF:
                out.append(part)
                continue
            own = points[part]
            axis = int(np.argmax(own.max(0) - own.min(0)))
            part = part[np.argsort(own[:, axis], kind="stable")]
            # whole leaves on the left, so that leaves are the runs of LEAF
            cut = max(LEAF, len(part) // 2 // LEAF * LEAF)
            todo += [part[cut:], part[:cut]]
        return np.concatenate(out) if out else np.zeros(0, np.int64)


def verified_links(tokens: np.ndarray, starts: np.ndarray, ids: np.ndarray, num: int, den: int, known: np.ndarray | None = None) -> list[tuple[int, int]]:
    """A spanning set of the links among sets: pairs of ids whose similarity reaches num / den.

    Sets with one value of ``known`` are linked already; pairs of them aren't tested.
    """
    n = len(ids)
    if n < 2:
        return []
    points, size, forest, links = counts_of(tokens, starts), np.diff(starts), Forest(n), []
    order = Tree.order(points, size, ids)
    tree = Tree(points[order], size[order])
    if known is not None:
        first: dict[int, int] = {}
        for i, k in enumerate(known[order].tolist()):
            forest.parent[i] = first.setdefault(k, i)
    sets = [tokens[starts[k] : starts[k + 1]] for k in order]
    for a in range(0, n, WALK):
        who, what = tree.pairs(np.arange(a, min(a + WALK, n)), num, den)
        roots = forest.roots()
        apart = (roots[who] != roots[what]) & (what < who)
        who, what = who[apart], what[apart]
        close = np.minimum(tree.points[who], tree.points[what]).sum(1) * (num + den) >= num * (tree.size[who] + tree.size[what])
        for i, j in zip(who[close].tolist(), what[close].tolist(), strict=True):
            p, q = forest.root(i), forest.root(j)
            if p == q:
                continue
            x, y = sets[i], sets[j]
            place = np.minimum(y.searchsorted(x), len(y) - 1)
            shared = int((y[place] == x).sum())
            if den * shared >= num * (len(x) + len(y) - shared):
                links.append((int(ids[order[i]]), int(ids[order[j]])))
                forest.parent[max(p, q)] = min(p, q)
    return links


def _verify(members: DataFrame, size: int, num: int, den: int) -> DataFrame:
    """Links (a, b) from rows (task, known, doc_id, text); the rows of a task come one after the other."""
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def solved(rows: list[pa.RecordBatch]) -> pa.RecordBatch:
        held = pa.Table.from_batches(rows)
        parts, lengths = [], [np.zeros(1, np.int64)]
        for batch in held.to_batches():
            for block in text_blocks(batch):
                tokens, starts = shingle_sets(block.column("text"), size)
                parts.append(tokens)
                lengths.append(np.diff(starts))
        starts = np.cumsum(np.concatenate(lengths))
        links = verified_links(np.concatenate(parts), starts, held.column("doc_id").to_numpy(), num, den, held.column("known").to_numpy())
        return pa.RecordBatch.from_arrays([pa.array([x[k] for x in links], pa.int64()) for k in (0, 1)], schema=schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, rows = None, []
        for batch in batches:
            tasks = batch.column("task").to_numpy(zero_copy_only=False)
            cuts = np.concatenate([[0], np.flatnonzero(tasks[1:] != tasks[:-1]) + 1, [len(tasks)]])
            for a, b in zip(cuts[:-1], cuts[1:], strict=True):
                if a == b:
                    continue
                if task is not None and tasks[a] != task:
                    yield solved(rows)
                    rows = []
                task = tasks[a]
                rows.append(batch.slice(a, b - a))
        if rows:
            yield solved(rows)

    return members.repartition("task").sortWithinPartitions("task").select("task", "known", "doc_id", "text").mapInArrow(tidy(run), "a bigint, b bigint")


def _with_texts(places: DataFrame, texts: DataFrame) -> DataFrame:
    """Rows (id, task, known) with the id's text."""
    places = durable(places)
    # few rows of three numbers go to the texts; otherwise the texts move
    side = F.broadcast(places) if places.count() <= BROADCAST_ROWS else places
    return texts.join(side, places["id"] == texts["doc_id"]).select("task", "known", "doc_id", "text")


def _chunks(stars: DataFrame) -> DataFrame:
    """(id, task, known): each star's sets in chunks, and its centre in each of them; nothing is known of their links."""
    count = F.col("chunks")
    cut = stars.withColumn("chunk", F.pmod(F.xxhash64(F.lit(3), "a"), count))
    sets = cut.select(F.col("a").alias("id"), "b", "chunk")
    centres = stars.select("b", "chunks").distinct().select(F.col("b").alias("id"), "b", F.explode(F.sequence(F.lit(0).cast("bigint"), count - 1)).alias("chunk"))
    return sets.unionByName(centres).select("id", F.xxhash64("b", "chunk").alias("task"), F.col("id").alias("known"))


def _pairs_of_blocks(stars: DataFrame, joined: DataFrame) -> DataFrame:
    """(id, task, known): what the chunks leave of large stars, as pairs of blocks.

    ``joined`` (id, component) has the links of the chunks.  A component with BLOCK or more sets in
    a star has blocks of its own; the other sets share blocks.  Pairs of blocks of one component
    need no task.
    """
    large = stars.where("chunks > 1")
    sets = large.select("b", F.col("a").alias("id"), "n").unionByName(large.select("b", F.col("b").alias("id"), F.col("centre_n").alias("n")).distinct())
    sets = sets.join(joined, "id", "left").withColumn("component", F.coalesce("component", "id"))
    split = sets.groupBy("b").agg(F.min("component").alias("low"), F.max("component").alias("high")).where("low <> high").select("b")
    split = durable(split)
    sets = durable(sets.join(F.broadcast(split) if split.count() <= BROADCAST_ROWS else split, "b", "left_semi"))
    sizes = sets.groupBy("b", "component").agg(F.count(F.lit(1)).alias("m"), F.sum("n").alias("s"))
    # blocks without an owner have sets of several components
    owned = sizes.withColumn("owner", F.when(F.col("m") >= BLOCK, F.col("component")))
    counts = owned.groupBy("b", "owner").agg(F.greatest(F.ceil(F.sum("m") / BLOCK), F.ceil(F.sum("s") / TASK_SHINGLES)).alias("blocks"))
    lists = counts.select("b", "owner", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("blocks") - 1)).alias("nth")).withColumn("block", F.xxhash64(F.lit(5), "b", "owner", "nth"))
    first, second = (lists.select(*[F.col(c).alias(f"{c}{k}") for c in ("b", "owner", "block")]) for k in (1, 2))
    # one row for each pair of blocks: a square of the number of blocks in a star, not of its sets
    pairs = first.join(second, (F.col("b1") == F.col("b2")) & (F.col("block1") <= F.col("block2")) & ~F.coalesce(F.col("owner1") == F.col("owner2"), F.lit(False)))
    sides = pairs.select("block1", "block2", F.explode(F.array_distinct(F.array("block1", "block2"))).alias("block")).select("block", F.xxhash64("block1", "block2").alias("task"))
    owner_of = owned.select(F.col("b").alias("star"), F.col("component").alias("c"), "owner").join(
        counts.select(F.col("b").alias("cb"), F.col("owner").alias("co"), "blocks"), (F.col("star") == F.col("cb")) & F.col("owner").eqNullSafe(F.col("co"))
    ).select("star", "c", "owner", "blocks")
    placed = sets.join(owner_of, (sets["b"] == F.col("star")) & (sets["component"] == F.col("c")))
    nth = F.pmod(F.xxhash64(F.lit(7), "id"), F.col("blocks"))
    placed = placed.select("id", "component", F.xxhash64(F.lit(5), "b", "owner", nth).alias("block"))
    return placed.join(sides, "block").select("id", "task", F.col("component").alias("known"))


def linked(docs: DataFrame, size: int = 5, num: int = 4, den: int = 5) -> DataFrame:
    """doc_id, n_shingles, component_id for each row of ``docs`` (doc_id, text).

    Sets link when their Jaccard similarity is num / den or more; component_id is the smallest
    doc_id reachable over links, itself included.  Null, empty and blank texts have an empty set
    and link with nothing.  A row with a null doc_id makes no class; it gets the component of
    its set if another row has it.  Rows of one doc_id count as one document.  Texts of any length
    are read whole; an empty table gives an empty one; columns beside doc_id and text play no part.
    """
    sketch = stored(sketches(docs, size, num, den))
    classes = stored(sketch.where("n_shingles > 0 AND doc_id IS NOT NULL").groupBy("f1", "f2", "n_shingles").agg(F.min(F.struct("doc_id", "keys")).alias("x")).select("f1", "f2", "n_shingles", F.col("x.doc_id").alias("rep"), F.col("x.keys").alias("keys")))
    keyed = classes.select("rep", "n_shingles", F.explode("keys").alias("key")).repartition("key")
    shared = keyed.groupBy("key").agg(F.min(F.struct("rep", "n_shingles")).alias("c"), F.max("rep").alias("top")).where("c.rep <> top").select("key", "c")
    ties = keyed.join(shared.hint("shuffle_hash"), "key").where("rep <> c.rep")
    ties = stored(ties.groupBy(F.col("rep").alias("a"), F.col("c.rep").alias("b")).agg(F.first("n_shingles").alias("n"), F.first("c.n_shingles").alias("centre_n")))
    sizes = ties.groupBy("b").agg(F.greatest(F.ceil(F.count(F.lit(1)) / CHUNK), F.ceil(F.sum("n") / TASK_SHINGLES)).alias("chunks"))
    stars = stored(ties.join(sizes, "b"))
    texts = docs.select(F.col("doc_id").cast("bigint"), "text")
    links = stored(_verify(_with_texts(_chunks(stars), texts), size, num, den))
    joined = durable(components(links))
    rest = durable(_pairs_of_blocks(stars, joined))
    if not rest.isEmpty():
        more = _verify(_with_texts(rest, texts), size, num, den)
        joined = components(joined.select(F.col("id").alias("a"), F.col("component").alias("b")).unionByName(more))
    final = joined.withColumnRenamed("id", "rep")
    owners = classes.select("f1", "f2", F.col("n_shingles").alias("n"), "rep").join(final, "rep", "left").select("f1", "f2", "n", F.coalesce("component", "rep").alias("component"))
    rows = sketch.select("doc_id", "n_shingles", "f1", "f2")
    found = rows.join(owners, (rows["f1"] == owners["f1"]) & (rows["f2"] == owners["f2"]) & (rows["n_shingles"] == owners["n"]), "left")
    component = F.when(F.col("n_shingles") > 0, F.col("component")).otherwise(F.col("doc_id"))
    return found.select("doc_id", "n_shingles", component.alias("component_id"))


def op3_rtree_jaccard(spark, sf_dir: str) -> DataFrame:
    """Every document's set size and component at 3-word shingles and 90 in 100; cases as in :func:`linked`."""
    return linked(table(spark, sf_dir, "documents").select("doc_id", "text"), 3, 9, 10)
