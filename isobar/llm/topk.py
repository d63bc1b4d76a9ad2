"""Exact top-k search by inner product with MaxScore, over shards of integer vectors.

A vector is a document over 2 d terms: the positive and the negative part of each component.  Both
terms of a component share one posting list, in the order of documents, with signed parts.  A query's
term for component j has a score bound: the most that any document of the shard gains from it.  A
query takes its terms by falling bound; the non-essential ones are the last, whose bounds together
stay below the current threshold, so that a document that gains nothing from the essential ones can't
enter.  The essential lists are traversed in single precision, whose rounding widens the bounds; a document
is dropped as soon as its sum so far and the bounds still to come stay below the threshold.  The other lists
follow in groups, while many documents are left.  Only for the few left after that are products of integers
taken, of the lists traversed first and then of the others, in groups, while they are competitive.  A shard
whose bounds together stay below the threshold is passed over.  Every shard hands its thresholds on to the
next; the shards' lists are merged by score, ties to the smaller id.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window as W, functions as F

#: Vectors of a shard, and queries that a task holds at most.
BLOCK, QUERIES = 8192, 8192
#: Shards that a task takes in turn, on average.
RUN = 4
#: Tasks that a small table is dealt to, as long as each has SHARE queries.
TASKS, SHARE = 16, 512
#: Non-essential components that are taken at a time, and the part of the documents (one in SPARSE) up to which products are taken.
PROBE, SPARSE = 8, 32


def quantised(vector: Column, scale: int = 64) -> Column:
    """floor(scale * x) of each component as bigint, null if the vector or any component is null or not finite."""
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return F.when(vector.isNotNull() & ~bad, F.transform(vector, lambda x: F.floor(x.cast("double") * scale).cast("bigint")))


class Shard:
    """Vectors with the posting list of each component, and its documents by rising value: the positive part's
    strongest documents are read from the back and the negative part's from the front."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray) -> None:
        self.ids, self.vectors = ids, vectors
        self.order = np.argsort(vectors, axis=0, kind="stable").T.astype(np.int32)
        self.most, self.least = vectors.max(0).astype(np.int64), vectors.min(0).astype(np.int64)
        self.lists = np.ascontiguousarray(vectors.T, np.float32)
        self.held = np.empty_like(self.lists)

    def sums(self, q: np.ndarray, part: np.ndarray) -> np.ndarray:
        """What each document gains from the lists of ``part``; they are gathered in one place that is used again."""
        return q[part] @ self.lists.take(part, 0, self.held[: len(part)], "clip")

    def search(self, query_id: int, q: np.ndarray, k: int, best: list[np.ndarray]) -> list[np.ndarray]:
        """Merge this shard into ``best`` (scores, ids), sorted by score descending and id ascending."""
        return self.search_all(np.array([query_id]), q[None], k, [best])[0]

    def search_all(self, query_ids: np.ndarray, queries: np.ndarray, k: int, best: list[list[np.ndarray]]) -> list[list[np.ndarray]]:
        """:meth:`search` for each row of ``queries`` (bigint)."""
        if not queries.size:
            return [self._merged(i, np.arange(len(self.ids)), np.zeros(len(self.ids), np.int64), k, b) for i, b in zip(query_ids, best, strict=True)]
        bound = np.maximum(queries * self.most, queries * self.least)
        terms = np.argsort(-bound, axis=1, kind="stable")
        # bounds of all terms from each place on
        rest = np.zeros((len(queries), queries.shape[1] + 1), np.int64)
        rest[:, :-1] = np.take_along_axis(bound, terms, 1)[:, ::-1].cumsum(1)[:, ::-1]
        # sums of integers are exact as far as a type holds all of them, in any order
        reach = np.abs(queries).astype(float) @ np.maximum(self.most, -self.least).astype(float)
        error = np.where(reach < 1 << 24, 0, (queries.shape[1] + 8) * 2.0**-23 * reach)
        exact = queries.astype(float) if reach.max() < 1 << 53 else queries
        return [self._one(*x, k) for x in zip(query_ids, exact, queries.astype(np.float32), terms, rest, error.tolist(), best, strict=True)]

    def _one(self, query_id: int, q: np.ndarray, single: np.ndarray, terms: np.ndarray, rest: np.ndarray, error: float, best: list[np.ndarray], k: int) -> list[np.ndarray]:
        used = q[terms] != 0
        terms, rest = terms[used], np.append(rest[:-1][used], 0)
        heads = None
        if len(best[0]) < k and len(terms):
            # no threshold yet: the heads of the strongest lists give one
            heads = np.unique(np.concatenate([self.order[j, -2 * k :] if q[j] > 0 else self.order[j, : 2 * k] for j in terms[:4]]))
            best = self._merged(query_id, heads, self.vectors[heads].astype(q.dtype) @ q, k, best)
        # a score equal to the threshold still enters by a smaller id; with fewer than k documents all enter
        theta = int(best[0][k - 1]) if len(best[0]) >= k else None
        least = [float("-inf") if theta is None else theta - r for r in rest.tolist()]
        place = next((a for a, x in enumerate(least) if x > 0), len(terms))
        if least[0] > 0:
            return best
        score = self.sums(single, terms[:place])
        live = score >= least[place] - error
        while place < len(terms) and np.count_nonzero(live) * SPARSE > len(live):
            part = terms[place : place + PROBE]
            score += self.sums(single, part)
            place += len(part)
            live = score >= least[place] - error
        if heads is not None:
            live[heads] = False
        rows = np.flatnonzero(live)
        score = self.vectors[rows[:, None], terms[:place]].astype(q.dtype) @ q[terms[:place]]
        for a in range(place, len(terms) + 1, PROBE):
            enough = score >= least[a]
            rows, score = rows[enough], score[enough]
            part = terms[a : a + PROBE]
            if not len(rows) or not len(part):
                break
            score = score + self.vectors[rows[:, None], part].astype(q.dtype) @ q[part]
        enough = score >= least[-1]
        return self._merged(query_id, rows[enough], score[enough], k, best)

    def _merged(self, query_id: int, rows: np.ndarray, score: np.ndarray, k: int, best: list[np.ndarray]) -> list[np.ndarray]:
        own = self.ids[rows] != query_id
        rows, score = rows[own], score[own].astype(np.int64)
        if not len(rows):
            return best
        if len(rows) > 4 * k:
            floor = np.partition(score, len(score) - k)[len(score) - k]
            rows, score = rows[score >= floor], score[score >= floor]
        scores, ids = np.concatenate([best[0], score]), np.concatenate([best[1], self.ids[rows]])
        first = np.lexsort((ids, -scores))[:k]
        return [scores[first], ids[first]]


def _smallest(vectors: np.ndarray) -> np.ndarray:
    """The same numbers in the smallest signed type that holds them."""
    for kind in (np.int8, np.int16, np.int32):
        limits = np.iinfo(kind)
        if vectors.size and limits.min <= vectors.min() and vectors.max() <= limits.max:
            return vectors.astype(kind)
    return vectors


def _packed(frame: DataFrame, key: str) -> DataFrame:
    """Rows (id, vector) as one row for each value of ``key``: ids and components as binary."""
    schema = "part bigint, size int, wide int, ids binary, data binary"  # a shorter vector is filled up with zeros

    def pack(keys: tuple[pa.Scalar, ...], groups: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = pa.Table.from_batches(list(groups))
        ids = held.column("id").to_numpy().astype(np.int64)
        listed = held.column("vector").to_pylist()
        vectors = np.zeros((len(listed), max(map(len, listed))), np.int64)
        for row, v in zip(vectors, listed, strict=True):
            row[: len(v)] = v
        vectors = _smallest(vectors)
        types = pa.schema([("part", pa.int64()), ("size", pa.int32()), ("wide", pa.int32()), ("ids", pa.binary()), ("data", pa.binary())])
        yield pa.RecordBatch.from_pydict({"part": [keys[0].as_py()], "size": [len(ids)], "wide": [vectors.itemsize], "ids": [ids.tobytes()], "data": [vectors.tobytes()]}, types)

    return frame.groupBy(key).applyInArrow(pack, schema)


def top_k(candidates: DataFrame, queries: DataFrame, k: int = 20) -> DataFrame:
    """query_id, rank, vec_id, score: for each row of ``queries`` the k rows of ``candidates`` of highest inner product.

    Both have id (bigint) and vector (array of bigint, products below 2^63; a shorter vector
    counts as filled up with zeros).  A query's own id is no candidate; null vectors take no part; with fewer than k
    candidates all are returned; repeated candidate rows count each.  Without candidates or queries
    the result is empty; vectors of any length count, other columns play no part.  Shards have about
    BLOCK rows by id hash, in the smallest integer type.  A task has up to QUERIES queries and takes RUN
    shards in turn, carrying the thresholds along: of n rows with m queries, n m / QUERIES shard
    rows and n m / (BLOCK RUN) query rows are shuffled; a table of fewer than TASKS such tasks is dealt to
    more, with SHARE queries at least.  Every query is held against every shard, so work grows as n m where bounds don't part the documents.
    """
    candidates, queries = (f.where(F.col("vector").isNotNull() & F.col("id").isNotNull()) for f in (candidates, queries))
    n, m = candidates.count(), queries.count()
    blocks = max(1, -(-n // BLOCK))
    ranges = -(-blocks // RUN)
    sets = max(1, -(-m // QUERIES), min(-(-m // SHARE), TASKS // ranges))
    part = lambda seed, count: F.pmod(F.xxhash64(F.lit(seed), "id", "vector"), F.lit(count))
    stored = _packed(candidates.select("id", "vector", part(1, blocks).alias("part")), "part")
    asked = _packed(queries.select("id", "vector", part(2, sets).alias("part")), "part")
    stored = stored.select("part", "size", "wide", "ids", "data", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(sets - 1).cast("bigint"))).alias("set"), (F.col("part") % ranges).alias("range"))
    asked = asked.select(F.lit(-1).cast("bigint").alias("part"), "size", "wide", "ids", "data", F.col("part").alias("set"), F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(ranges - 1).cast("bigint"))).alias("range"))
    schema = pa.schema([("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.int64())])

    def search(keys: tuple[pa.Scalar, ...], groups: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = pa.Table.from_batches(list(groups)).sort_by("part").to_pylist()

        def read(row: dict) -> tuple[np.ndarray, np.ndarray]:
            data = np.frombuffer(row["data"], f"<i{row['wide']}")
            own = data.reshape(row["size"], len(data) // row["size"])
            return np.frombuffer(row["ids"], np.int64), np.pad(own, ((0, 0), (0, width - own.shape[1])))

        width = max(len(r["data"]) // r["wide"] // r["size"] for r in held)
        asked = [r for r in held if r["part"] == -1]
        if not asked:
            return
        ids, vectors = read(asked[0])
        vectors = vectors.astype(np.int64)
        best = [[np.zeros(0, np.int64), np.zeros(0, np.int64)] for _ in ids]
        for row in held:
            if row["part"] != -1:
                best = Shard(*read(row)).search_all(ids, vectors, k, best)
        found = [np.repeat(ids, [len(b[0]) for b in best]), np.concatenate([b[1] for b in best]), np.concatenate([b[0] for b in best])]
        yield pa.RecordBatch.from_arrays([pa.array(x) for x in found], schema=schema)

    lists = stored.unionByName(asked).groupBy("set", "range").applyInArrow(search, "query_id bigint, vec_id bigint, score bigint")
    rank = F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return lists.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int"), "vec_id", "score")


def op7_maxscore_top20(spark, sf_dir: str) -> DataFrame:
    """The 20 best of all vectors for each whose id is divisible by 20; cases as in :func:`top_k`."""
    from .shared import table

    rows = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), quantised(F.col("embedding")).alias("vector"))
    return top_k(rows, rows.where(F.col("id") % 20 == 0), 20)


OP7_SQL = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(64 * CAST(x AS DOUBLE)) AS BIGINT)) AS q FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.vec_id AS query_id, b.vec_id, CAST(list_sum(list_transform(list_zip(a.q, b.q), lambda z: z[1] * z[2])) AS BIGINT) AS score
  FROM v a JOIN v b ON a.vec_id % 20 = 0 AND a.vec_id <> b.vec_id),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 20
"""
