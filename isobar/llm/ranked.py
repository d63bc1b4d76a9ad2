"""Ranked lexical search over a tiered index.

The index is cut into shards of about SHARD bytes of text; a shard has a posting list (documents,
occurrences) for each of its terms and the lengths of its documents.  It is written by the task that
reads the texts, without a shuffle, and knows nothing of queries.  For the terms of a query set, counts over the whole corpus
give each posting its impact, the part of a score that depends on the document.  The postings of a term are
cut into tiers by falling impact: the first tier has about TIERS[0] postings of the whole corpus, the
next reaches to TIERS[1], and so on; the last has the rest.  For each term and tier a residual bound
is known, the most that a posting in lower tiers can add to a score.

A search reads the first tier.  A document found there has a part of its score for sure, and at most
the residual bounds of its terms not yet found besides; one not found has at most the sum of the item's
bounds.  An item is proven when its k-th best sure score is above that sum: then nothing that was not
found can enter.  Items without proof fall through to the next tier, in the last of which all is known.  For
proven items, documents whose upper bound reaches the k-th best sure score are completed from the lower
tiers, for their shards and terms alone, and ranked.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window as W, functions as F

from .shared import Words, durable, masked, stored, table, text_blocks, tidy

#: Bytes of text of a shard, about.
SHARD = 16_000_000
#: Postings of a term down to the end of each tier but the last, about.
TIERS = (1_000, 30_000, 1_000_000)
#: Items that a task holds, shards that it takes in turn on average.
ITEMS, RUN = 4096, 16
#: Width of the bins in which impacts are counted.
BIN = 4096
#: Open documents of an item in a shard, packed.
OPEN = "row bigint, shard bigint, places binary, scores binary, terms array<string>, weights array<bigint>"
#: Rows of a broadcast table of terms.
BROADCAST_ROWS = 200_000


def terms_only(held: np.ndarray) -> np.ndarray:
    """Bytes of UTF-8 with ASCII other than letters and digits as blanks, A-Z in lower case; the rest is as it was."""
    lut = np.arange(256, dtype=np.uint8)
    lut[:128] = 0x20
    for first, last in ("09", "az"):
        lut[ord(first) : ord(last) + 1] = np.arange(ord(first), ord(last) + 1)
    lut[ord("A") : ord("Z") + 1] = np.arange(ord("a"), ord("z") + 1)
    return lut[held]


def _lists(values: np.ndarray, ends: np.ndarray) -> pa.Array:
    """Slices of an array as binary values; ``ends`` are the places behind each."""
    offsets = np.concatenate([[0], ends]).astype(np.int64) * values.itemsize
    return pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(ends), [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(values))]).cast(pa.binary())


def build_index(docs: DataFrame, shard: int = SHARD) -> DataFrame:
    """shard, term, places, counts, ids, held, length: postings of each shard's terms, and with a null term its documents.

    places are the documents of a posting list (unsigned 16-bit), counts their occurrences (unsigned, 8 or
    32-bit as the row's width says).  The row without a term has the ids, and as counts the number of terms
    of each document; held is the number of postings, or of documents with a term, length all their terms.
    """
    schema = pa.schema([("shard", pa.int64()), ("term", pa.string()), ("places", pa.binary()), ("counts", pa.binary()), ("width", pa.int32()), ("ids", pa.list_(pa.int64())), ("held", pa.int64()), ("length", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 24
        for whole in batches:
            for first in range(0, whole.num_rows, 1 << 16):
                for batch in text_blocks(whole.slice(first, 1 << 16), shard):
                    words = Words(masked(batch.column("text"), terms_only), lower=False)
                    lengths, total = np.diff(words.starts), batch.num_rows
                    both, n = np.unique(words.codes * total + np.repeat(np.arange(total), lengths), return_counts=True)
                    code, place = both // total, (both % total).astype("<u2")
                    ends = np.append(np.flatnonzero(np.diff(code)) + 1, len(code)) if len(code) else np.zeros(0, np.int64)
                    width = 1 if not len(n) or n.max() < 256 else 4
                    counts, rows = n.astype(f"<u{width}"), len(ends)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([number]), pa.nulls(1, pa.string()), pa.nulls(1, pa.binary()), pa.array([lengths.astype("<u4").tobytes()]), pa.array([4], pa.int32()),
                         pa.array([batch.column("doc_id").to_pylist()], pa.list_(pa.int64())), pa.array([int((lengths > 0).sum())]), pa.array([int(lengths.sum())])], schema=schema)
                    held = np.diff(np.concatenate([[0], ends])).astype(np.int64)
                    for a in range(0, rows, 50_000):
                        b = min(a + 50_000, rows)
                        x, y = (ends[a - 1] if a else 0), ends[b - 1]
                        yield pa.RecordBatch.from_arrays(
                            [pa.array(np.full(b - a, number)), words.vocab.take(pa.array(code[ends[a:b] - 1])).cast(pa.string()), _lists(place[x:y], ends[a:b] - x), _lists(counts[x:y], ends[a:b] - x),
                             pa.array(np.full(b - a, width), pa.int32()), pa.nulls(b - a, pa.list_(pa.int64())), pa.array(held[a:b]), pa.nulls(b - a, pa.int64())], schema=schema)
                    number += 1

    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    return rows.mapInArrow(tidy(run), "shard bigint, term string, places binary, counts binary, width int, ids array<bigint>, held bigint, length bigint")


def item_terms(items: DataFrame, item: str = "item_id", text: str = "text") -> DataFrame:
    """row, item, term: the distinct terms of each item; equal items are rows of their own."""
    schema = pa.schema([("row", pa.int64()), ("item", pa.int64()), ("term", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in text_blocks(whole):
                words = Words(masked(batch.column("text"), terms_only))
                owner = np.repeat(np.arange(batch.num_rows), np.diff(words.starts))
                both = np.unique(owner * max(1, len(words.vocab)) + words.codes)
                at, code = pa.array(both // max(1, len(words.vocab))), pa.array(both % max(1, len(words.vocab)))
                yield pa.RecordBatch.from_arrays([batch.column("row").take(at), batch.column("item").take(at), words.vocab.take(code).cast(pa.string())], schema=schema)

    rows = items.select(F.monotonically_increasing_id().alias("row"), F.col(item).cast("bigint").alias("item"), F.col(text).alias("text"))
    return rows.mapInArrow(tidy(run), "row bigint, item bigint, term string")


def _small(frame: DataFrame) -> DataFrame:
    """A durable table, marked for broadcast if it has few rows."""
    return F.broadcast(frame) if frame.count() <= BROADCAST_ROWS else frame


def _impacts(index: DataFrame, terms: DataFrame, documents: int, length: int) -> DataFrame:
    """shard, term, places, impacts, bins, sizes, ids: the index of ``terms`` with impacts instead of counts, and how many fall into each bin."""
    schema = pa.schema([("shard", pa.int64()), ("term", pa.string()), ("places", pa.binary()), ("impacts", pa.binary()), ("bins", pa.list_(pa.int64())), ("sizes", pa.list_(pa.int64()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, norm = None, np.zeros(0, np.int64)
        for batch in batches:
            out: list[tuple] = []
            columns = [batch.column(c) for c in ("shard", "term", "places", "counts", "width")]
            for at in range(batch.num_rows):
                own, term, places, counts, width = (c[at].as_py() for c in columns)
                if term is None:
                    shard, norm = own, 50 + (50 * np.frombuffer(counts, "<u4").astype(np.int64) * documents) // max(1, length)
                    continue
                if shard != own:
                    raise ValueError("a shard without its documents")
                tf = np.frombuffer(counts, f"<u{width}").astype(np.int64)
                impact = (1_000_000_000 * tf) // (1000 * tf + 20 * norm[np.frombuffer(places, "<u2")])
                bins, sizes = np.unique(impact // BIN, return_counts=True)
                out.append((own, term, places, impact.astype("<u4").tobytes(), bins, sizes))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(list(x), f.type) for x, f in zip(zip(*out, strict=True), schema, strict=True)], schema=schema)

    asked = index.where("term IS NOT NULL").join(_small(terms), "term", "left_semi").unionByName(index.where("term IS NULL"))
    dealt = asked.select("shard", "term", "places", "counts", "width").repartition("shard").sortWithinPartitions("shard", F.col("term").asc_nulls_first())
    return dealt.mapInArrow(tidy(run), "shard bigint, term string, places binary, impacts binary, bins array<bigint>, sizes array<bigint>")


def _cuts(impacts: DataFrame, tiers: tuple[int, ...]) -> DataFrame:
    """term, top, cuts: the largest bin's end, and for each tier but the last its lowest impact, 0 if nothing is left below."""
    bins = impacts.select("term", F.explode(F.arrays_zip("bins", "sizes")).alias("b")).groupBy("term", F.col("b.bins").alias("bin")).agg(F.sum("b.sizes").alias("n"))
    down = W.partitionBy("term").orderBy(F.desc("bin"))  # at most 1,000,000 / BIN bins
    reach = bins.withColumn("upto", F.sum("n").over(down))
    last = F.min("bin")
    cuts = [F.when(F.max("upto") <= F.lit(t), F.lit(0)).otherwise(F.coalesce(F.max(F.when(F.col("upto") >= F.lit(t), F.col("bin"))), last) * BIN) for t in tiers]
    return reach.groupBy("term").agg(((F.max("bin") + 1) * BIN - 1).alias("top"), F.array(*[c.cast("bigint") for c in cuts]).alias("cuts"))


def tiered(impacts: DataFrame, cuts: DataFrame) -> DataFrame:
    """tier, shard, term, places, impacts: each posting list cut by the impacts where its term's tiers end; tiers from 0."""
    schema = pa.schema([("tier", pa.int32()), ("shard", pa.int64()), ("term", pa.string()), ("places", pa.binary()), ("impacts", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple] = []
            columns = [batch.column(c) for c in ("shard", "term", "places", "impacts", "cuts")]
            for at in range(batch.num_rows):
                shard, term, places, impacts, ends = (c[at].as_py() for c in columns)
                place, impact = np.frombuffer(places, "<u2"), np.frombuffer(impacts, "<u4")
                tier = (impact[:, None] < np.array(ends, np.int64)[None]).sum(1)
                for t in np.unique(tier).tolist():
                    out.append((t, shard, term, place[tier == t].tobytes(), impact[tier == t].tobytes()))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(list(x), f.type) for x, f in zip(zip(*out, strict=True), schema, strict=True)], schema=schema)

    return impacts.join(_small(cuts), "term").select("shard", "term", "places", "impacts", "cuts").mapInArrow(tidy(run), "tier int, shard bigint, term string, places binary, impacts binary")


class _Items:
    """The items of a task: for each its terms with weight and residual bound, and what it is held against."""

    def __init__(self) -> None:
        self.rows: list[int] = []
        self.at: dict[int, int] = {}
        self.floor: list[int] = []
        self.bound: list[int] = []
        self.open_terms: list[dict[str, int]] = []
        self.by_term: dict[str, list[tuple[int, int, int]]] = {}

    def add(self, row: int, term: str, weight: int, left: int, floor: int) -> None:
        if row not in self.at:
            self.at[row] = len(self.rows)
            self.rows.append(row)
            self.floor.append(floor)
            self.bound.append(0)
            self.open_terms.append({})
        if left:
            self.open_terms[self.at[row]][term] = weight
        self.bound[self.at[row]] += left
        self.by_term.setdefault(term, []).append((self.at[row], weight, left))


def _over_shards(postings: DataFrame, asked: DataFrame, shards: int, kind: str, k: int, sets: int) -> DataFrame:
    """Run items over shards, set by set: ``asked`` has row, term, weight, left, floor; ``postings`` shard, term, places, impacts.

    ``kind`` "sure" gives row, score: each task's k best sure scores.  "open" gives row, shard, places, scores, terms, weights: for each
    item and shard the documents whose upper bound is at or above the floor, with their sure scores, and the terms that can add to them.
    """
    ranges = max(1, -(-shards // RUN))
    schema = "row bigint, score bigint" if kind == "sure" else OPEN
    fields = pa.schema([("row", pa.int64()), ("score", pa.int64())]) if kind == "sure" else pa.schema(
        [("row", pa.int64()), ("shard", pa.int64()), ("places", pa.binary()), ("scores", pa.binary()), ("terms", pa.list_(pa.string())), ("weights", pa.list_(pa.int64()))])

    def scored(items: _Items, shard: int, lists: list[tuple[str, bytes, bytes]], best: dict[int, np.ndarray]) -> Iterator[list]:
        gained: dict[int, list[tuple[np.ndarray, np.ndarray, int, int]]] = {}
        for term, places, impacts in lists:
            for item, weight, left in items.by_term.get(term, ()):
                gained.setdefault(item, []).append((np.frombuffer(places, "<u2"), np.frombuffer(impacts, "<u4").astype(np.int64), weight, left))
        size = 1 + max((int(p.max()) for parts in gained.values() for p, *_ in parts if len(p)), default=-1)
        for item, parts in gained.items():
            sure, seen = np.zeros(size, np.int64), np.zeros(size, np.int64)
            for places, impacts, weight, left in parts:
                sure[places] += weight * impacts  # a term has a document once
                seen[places] += left
            if kind == "sure":
                found = np.concatenate([best.get(item, np.zeros(0, np.int64)), sure[sure > 0]])
                best[item] = np.partition(found, len(found) - k)[len(found) - k :] if len(found) > k else found
            else:
                bound = sure + np.where(sure > 0, items.bound[item] - seen, 0)
                place = np.flatnonzero((sure > 0) & (bound >= items.floor[item]))
                if len(place):
                    more = items.open_terms[item]
                    yield [items.rows[item], shard, place.astype("<u2").tobytes(), sure[place].tobytes(), list(more), list(more.values())]

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, items, shard, lists, best = None, _Items(), None, [], {}

        def done(shard: int | None) -> Iterator[pa.RecordBatch]:
            if shard is not None and lists:
                out = list(scored(items, shard, lists, best))
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(list(x), f.type) for x, f in zip(zip(*out, strict=True), fields, strict=True)], schema=fields)

        def ended() -> Iterator[pa.RecordBatch]:
            if kind == "sure" and best:
                yield pa.RecordBatch.from_arrays([pa.array(np.repeat([items.rows[i] for i in best], [len(s) for s in best.values()])), pa.array(np.concatenate(list(best.values())))], schema=fields)

        for batch in batches:
            for r in batch.to_pylist():
                if (r["range"], r["set"]) != key:
                    yield from done(shard)
                    yield from ended()
                    key, items, shard, lists, best = (r["range"], r["set"]), _Items(), None, [], {}
                if r["shard"] is None:
                    items.add(r["row"], r["term"], r["weight"], r["left"], r["floor"])
                    continue
                if r["shard"] != shard:
                    yield from done(shard)
                    shard, lists = r["shard"], []
                lists.append((r["term"], r["places"], r["impacts"]))
        yield from done(shard)
        yield from ended()

    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    terms = durable(asked.select("term").distinct())
    lists = postings.join(_small(terms), "term", "left_semi").withColumn("range", F.pmod(F.xxhash64("shard"), F.lit(ranges)).cast("int")).withColumn("set", every(sets))
    queries = asked.withColumn("set", F.pmod(F.xxhash64("row"), F.lit(sets)).cast("int")).withColumn("range", every(ranges))
    rows = lists.unionByName(queries, allowMissingColumns=True)
    dealt = rows.repartition(max(1, min(ranges * sets, 20_000)), "range", "set").sortWithinPartitions("range", "set", F.col("shard").asc_nulls_first())
    return dealt.mapInArrow(tidy(search), schema)


def _left(cut: int, top: str = "top") -> str:
    """SQL of the most impact below a tier; places in the array count from 0."""
    return f"CASE WHEN cuts[{cut}] = 0 THEN 0 ELSE least({top}, cuts[{cut}] - 1) END"


def ranked_search(docs: DataFrame, items: DataFrame, k: int = 50, item: str = "item_id", tiers: tuple[int, ...] = TIERS, shard: int = SHARD) -> DataFrame:
    """item_id, rank, doc_id, score: for each row of ``items`` the k rows of ``docs`` of highest score above 0, ties to the smaller doc_id.

    Both have text, ``docs`` doc_id and ``items`` the column ``item``.  Null and empty texts have no terms; repeated
    rows are documents and items of their own, a null doc_id ranks behind equal scores, texts of any length count whole, other columns
    play no part, and without documents or items the result is empty.  The result doesn't depend on ``tiers`` or
    ``shard``; a tier costs no more than its postings, and lower tiers are read for items without proof and for
    open documents only.
    """
    index = stored(build_index(docs, shard), compression="zstd")
    counts = index.where("term IS NULL").agg(F.sum("held").alias("n"), F.sum("length").alias("l"), F.count(F.lit(1)).alias("shards")).first()
    n, length, shards = counts["n"] or 0, counts["l"] or 0, counts["shards"]
    words = stored(item_terms(items, item))
    asked = durable(words.select("term").distinct())
    weight = F.floor(1000 * F.log((2.0 * n + 2) / (2.0 * F.col("df") + 1))).cast("bigint")
    held = index.where("term IS NOT NULL").join(_small(asked), "term", "left_semi").groupBy("term").agg(F.sum("held").alias("df")).withColumn("weight", weight)
    terms = durable(held.where("weight > 0").select("term", "weight"))
    impacts = stored(_impacts(index, terms, n, length), compression="zstd")
    cuts = durable(_cuts(impacts, tiers))
    postings = stored(tiered(impacts, cuts), compression="zstd")
    state = stored(words.join(_small(terms), "term").join(_small(cuts), "term"))
    sets = max(1, -(-state.select("row").distinct().count() // ITEMS))

    # row, tier and k-th best sure score of proven items, tier after tier
    proven: DataFrame | None = None
    pending = state
    for tier in range(len(tiers) + 1):
        left = f"weight * ({_left(tier)})" if tier < len(tiers) else "0L"
        now = pending.select("row", "term", "weight", F.expr(left).cast("bigint").alias("left"), F.lit(0).cast("bigint").alias("floor"))
        sure = _over_shards(postings.where(F.col("tier") <= tier), now, shards, "sure", k, sets)
        kth = sure.withColumn("at", F.row_number().over(W.partitionBy("row").orderBy(F.desc("score")))).where(F.col("at") <= k).groupBy("row").agg(F.min("score").alias("score"), F.count(F.lit(1)).alias("n"))
        bounds = now.groupBy("row").agg(F.sum("left").alias("bound"))
        floors = bounds.join(kth, "row", "left").select("row", F.when(F.col("n") >= k, F.col("score")).otherwise(0).alias("floor"), "bound")
        settled = stored(floors.where("floor > bound OR bound = 0").select("row", F.lit(tier).alias("tier"), "floor"))
        proven = settled if proven is None else proven.unionByName(settled)
        if tier < len(tiers):
            pending = stored(pending.join(settled, "row", "left_anti"))
            if pending.isEmpty():
                break
    assert proven is not None

    best = None
    for tier in range(len(tiers) + 1):
        here = proven.where(F.col("tier") == tier)
        if here.isEmpty():
            continue
        left = f"weight * ({_left(tier)})" if tier < len(tiers) else "0L"
        now = state.join(here, "row").select("row", "term", "weight", F.expr(left).cast("bigint").alias("left"), "floor")
        opened = stored(_over_shards(postings.where(F.col("tier") <= tier), now, shards, "open", k, sets))
        found = _completed(postings.where(F.col("tier") > tier), opened, index, k)
        best = found if best is None else best.unionByName(found)
    if best is None:
        return docs.sparkSession.createDataFrame([], f"`{item}` bigint, rank int, doc_id bigint, score bigint")
    named = best.join(_small(durable(words.select("row", "item").distinct())), "row")
    rank = F.row_number().over(W.partitionBy("row").orderBy(F.desc("score"), F.col("doc_id").asc_nulls_last(), "shard", "place"))
    return named.withColumn("rank", rank).where(F.col("rank") <= k).select(F.col("item").alias(item), F.col("rank").cast("int").alias("rank"), "doc_id", "score")


def _completed(postings: DataFrame, opened: DataFrame, index: DataFrame, k: int) -> DataFrame:
    """row, doc_id, score, shard, place: open documents with what the lower tiers ``postings`` add, the k best of each item and task.

    Shards with open documents alone are read, and of their lower tiers the terms that can add to these.
    """
    schema = pa.schema([("row", pa.int64()), ("doc_id", pa.int64()), ("score", pa.int64()), ("shard", pa.int64()), ("place", pa.int64())])
    none = np.iinfo(np.int64).max
    needed = durable(opened.select("shard", F.explode("terms").alias("term")).distinct())
    ids = index.where("term IS NULL").select("shard", "ids").join(_small(durable(opened.select("shard").distinct())), "shard", "left_semi")
    lists = postings.select("shard", "term", "places", "impacts").join(_small(needed), ["shard", "term"], "left_semi")
    rows = ids.withColumn("kind", F.lit(0)).unionByName(opened.withColumn("kind", F.lit(1)), allowMissingColumns=True).unionByName(lists.withColumn("kind", F.lit(2)), allowMissingColumns=True)

    def batch_of(best: dict[int, np.ndarray]) -> pa.RecordBatch:
        whole = np.concatenate([np.column_stack([np.full(len(b), row), b]) for row, b in best.items()])
        return pa.RecordBatch.from_arrays([pa.array(whole[:, 0]), pa.array(whole[:, 1], mask=whole[:, 5] == 1), *[pa.array(whole[:, i]) for i in (2, 3, 4)]], schema=schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, ids, asked, lists = None, [], [], {}
        best: dict[int, np.ndarray] = {}

        def done() -> None:
            for r in asked:
                place, score = np.frombuffer(r["places"], "<u2").astype(np.int64), np.frombuffer(r["scores"], np.int64).copy()
                for term, weight in zip(r["terms"], r["weights"], strict=True):
                    if term in lists:
                        own, impact = lists[term]
                        spot = np.minimum(np.searchsorted(own, place), len(own) - 1)
                        score += np.where(own[spot] == place, weight * impact[spot], 0)
                names = [ids[p] for p in place.tolist()]
                unknown = np.array([n is None for n in names], np.int64)
                named = np.array([none if n is None else n for n in names], np.int64)
                found = np.column_stack([named, score, np.full(len(place), shard), place, unknown])
                found = np.concatenate([best[r["row"]], found]) if r["row"] in best else found
                best[r["row"]] = found[np.lexsort((found[:, 3], found[:, 2], found[:, 0], found[:, 4], -found[:, 1]))[:k]]

        for batch in batches:
            for r in batch.to_pylist():
                if r["shard"] != shard:
                    done()
                    shard, asked, lists = r["shard"], [], {}
                    if len(best) * k > 500_000:
                        yield batch_of(best)
                        best.clear()
                if r["kind"] == 0:
                    ids = r["ids"]
                elif r["kind"] == 1:
                    asked.append(r)
                else:
                    # of several tiers one list
                    place, impact = np.frombuffer(r["places"], "<u2").astype(np.int64), np.frombuffer(r["impacts"], "<u4").astype(np.int64)
                    if r["term"] in lists:
                        place, impact = np.concatenate([lists[r["term"]][0], place]), np.concatenate([lists[r["term"]][1], impact])
                    order = np.argsort(place)
                    lists[r["term"]] = place[order], impact[order]
        done()
        if best:
            yield batch_of(best)

    dealt = rows.repartition("shard").sortWithinPartitions("shard", "kind")
    return dealt.mapInArrow(tidy(run), "row bigint, doc_id bigint, score bigint, shard bigint, place bigint")


def op12_tiered_search(spark, sf_dir: str) -> DataFrame:
    """The 50 best documents for each benchmark item; cases as in :func:`ranked_search`."""
    return ranked_search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


OP12_SQL = r"""
WITH t AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS terms FROM documents),
q AS (SELECT DISTINCT i, item_id, term FROM (SELECT i, item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM (SELECT row_number() OVER () AS i, * FROM benchmark))),
c AS (SELECT count(*) AS nn, CAST(sum(len(terms)) AS BIGINT) AS ll FROM t WHERE len(terms) > 0),
p AS (SELECT r, term, count(*) AS tf FROM (SELECT r, unnest(terms) AS term FROM t) WHERE term IN (SELECT term FROM q) GROUP BY r, term),
w AS (SELECT term, CAST(floor(1000 * ln((2.0::DOUBLE * (SELECT nn FROM c) + 2) / (2.0::DOUBLE * count(*) + 1))) AS BIGINT) AS w FROM p GROUP BY term),
m AS (SELECT r, doc_id, 100 - 50 + (50 * len(terms) * (SELECT nn FROM c)) // (SELECT ll FROM c) AS m FROM t WHERE len(terms) > 0),
s AS (SELECT i, item_id, r, doc_id, CAST(sum(w * ((1000000000 * tf) // (1000 * tf + 20 * m))) AS BIGINT) AS score FROM q JOIN p USING (term) JOIN w USING (term) JOIN m USING (r) GROUP BY i, item_id, r, doc_id),
o AS (SELECT *, CAST(row_number() OVER (PARTITION BY i ORDER BY score DESC, doc_id, r) AS INTEGER) AS rank FROM s WHERE score > 0)
SELECT item_id, rank, doc_id, score FROM o WHERE rank <= 50
"""
