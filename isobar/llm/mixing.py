"""Mixing sources to target weights by weighted fair queueing.

Every shuffled document of a source gets a virtual finish time: the source's tokens up to
and including it, divided by the source's target.  All sources reach time 1 when they have
given their target, so the global order of finish times interleaves them by weight, and
cutting that order at the total budget leaves every source near its target.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from .shared import durable, free_name, table, word_count

#: Bins of finish time; the bin in which the budget ends is cut into as many until it has so few rows that they are sorted exactly.
BINS, SORTED = 4096, 100_000


def targets(sizes: DataFrame, weights: Sequence[int], share: float, cap: float) -> DataFrame:
    """sizes (source, source_size) with ``target``: ``share`` of all tokens by weight, none above ``cap`` times its source.

    Weights repeat over the sources in code point order, null last.  With caps taken in the
    order of cap over weight, all sources up to some place are full and the rest divide what
    is left by weight.  From the first source that isn't full on, the level of each place is lower than
    its predecessor's, so the largest level among the sources that aren't full is theirs.
    """
    order = W.orderBy(F.col("source").asc_nulls_last())
    weight = F.element_at(F.array(*[F.lit(w) for w in weights]), ((F.row_number().over(order) - 1) % len(weights) + 1).cast("int"))
    ranked = sizes.withColumn("weight", weight).withColumn("most", F.col("source_size") * F.lit(cap))
    everything = W.partitionBy(F.lit(0))
    rise = W.orderBy(F.col("most") / F.col("weight"), F.col("source").asc_nulls_last()).rowsBetween(W.unboundedPreceding, -1)
    level = (F.sum("source_size").over(everything) * F.lit(share) - F.coalesce(F.sum("most").over(rise), F.lit(0.0))) / (
        F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(rise), F.lit(0))
    )
    full = ranked.withColumn("level", level).withColumn("full", F.col("most") <= F.col("level") * F.col("weight"))
    open_level = F.max(F.when(~F.col("full"), F.col("level"))).over(everything)
    return full.select("source", "source_size", F.when(F.col("full"), F.col("most")).otherwise(open_level * F.col("weight")).cast("double").alias("target"))


def shuffle_key(doc_id: Column, text: Column, seed: str) -> Column:
    """The place of a document in its source's shuffled order, by its id; without one by its text."""
    return F.md5(F.concat(F.lit(seed), F.coalesce(doc_id.cast("string"), F.concat(F.lit("null"), F.md5(F.coalesce(text, F.lit("")))))))


def plan_mix(slim: DataFrame, weights: Sequence[int], share: float, cap: int) -> tuple[DataFrame, DataFrame]:
    """(sources, rows): per source its target and the last taken place of each round; every row with its ``taken`` tokens.

    slim: doc_id, source, size, place.  A document can be taken in ``cap`` rounds, each in the
    same shuffled order.  Rows of a source with equal place are taken together.
    """
    spark = slim.sparkSession
    sizes = slim.groupBy("source").agg(F.sum("size").alias("source_size"))
    goal = durable(targets(sizes, weights, share, float(cap)))
    # running tokens within a source, by buckets of the place, so that a large source is no single task
    cut = slim.withColumn("bucket", F.substring("place", 1, 3))
    sums = cut.groupBy("source", "bucket").agg(F.sum("size").alias("n"))
    ahead = W.partitionBy("source").orderBy("bucket").rowsBetween(W.unboundedPreceding, -1)
    sums = sums.withColumn("before", F.coalesce(F.sum("n").over(ahead), F.lit(0))).drop("n").withColumnsRenamed({"source": "s", "bucket": "b"})
    inside = W.partitionBy("source", "bucket").orderBy("place").rangeBetween(W.unboundedPreceding, 0)
    run = cut.withColumn("inside", F.sum("size").over(inside)).join(sums, F.col("source").eqNullSafe(F.col("s")) & (F.col("bucket") == F.col("b")))
    goal_of = goal.withColumnRenamed("source", "g")
    run = run.withColumn("upto", F.col("before") + F.col("inside")).drop("s", "b", "bucket", "before", "inside")
    run = run.join(goal_of, F.col("source").eqNullSafe(F.col("g"))).drop("g")
    run = durable(run.select("doc_id", "source", "size", "place", "upto", "source_size", "target"))
    rounds = run.where(F.col("target") > 0).select(
        "source", "place", "size", F.explode(F.array(*[F.struct(F.lit(r).alias("round"), ((F.col("upto") + F.col("source_size") * r) / F.col("target")).alias("finish")) for r in range(cap)])).alias("q")
    ).select("source", "place", "size", "q.round", "q.finish")
    budget = goal.agg(F.sum("target")).first()[0] or 0.0
    # scaling by powers of two is exact, so the bins of each level lie within those of the one before
    inside, before, scale = F.lit(True), 0, 1
    for _ in range(3):
        scale *= BINS
        place_in = F.floor(F.least(F.col("finish"), F.lit(2.0)) * scale)
        ahead = W.orderBy("bin").rowsBetween(W.unboundedPreceding, -1)
        filled = rounds.where(inside).groupBy(place_in.alias("bin")).agg(F.sum("size").alias("n"), F.count(F.lit(1)).alias("rows"))
        filled = filled.withColumn("before", F.coalesce(F.sum("n").over(ahead), F.lit(0)) + F.lit(before))
        # one row: the bin where the budget ends
        last = filled.where(F.col("before") + F.col("n") > budget).orderBy("bin").limit(1).collect()
        if not last:
            break
        inside, before = place_in == last[0]["bin"], last[0]["before"]
        if last[0]["rows"] <= SORTED:
            break
    if last:
        line = F.sum("size").over(W.orderBy("finish", "round", "place", F.col("source").asc_nulls_last()))
        within = rounds.where(inside).withColumn("upto", line + F.lit(before))
        key = F.struct("finish", "round", "place", F.coalesce(F.col("source"), F.lit("\U0010ffff")).alias("source"))
        first_out = within.where(F.col("upto") > budget).agg(F.min(key).alias("x")).first()["x"]
        out = F.struct(F.lit(first_out["finish"]).alias("finish"), F.lit(first_out["round"]).alias("round"), F.lit(first_out["place"]).alias("place"), F.lit(first_out["source"]).alias("source"))
        taken = rounds.where(key < out)
    else:
        taken = rounds
    ends = taken.groupBy("source").agg(*[F.max(F.when(F.col("round") == r, F.col("place"))).alias(f"end{r}") for r in range(cap)])
    ends = ends.withColumnRenamed("source", "e")
    sources = durable(goal.join(ends, F.col("source").eqNullSafe(F.col("e")), "left").drop("e"))
    return sources, run.select("doc_id", "source", "size", "place")


def times_taken(place: Column, cap: int) -> Column:
    """In how many rounds a document is taken, given its source's ``end`` columns."""
    total = F.lit(0)
    for r in range(cap):
        total = total + F.coalesce((place <= F.col(f"end{r}")).cast("int"), F.lit(0))
    return total


def slim_rows(docs: DataFrame, seed: str) -> DataFrame:
    return durable(docs.select("doc_id", "source", word_count(F.col("text")).alias("size"), shuffle_key(F.col("doc_id"), F.col("text"), seed).alias("place")))


def mix_sources(docs: DataFrame, weights: Sequence[int] = (5, 2, 1), share: float = 1.5, cap: int = 2, seed: str = "mix") -> DataFrame:
    """The mixed corpus: ``docs`` with each row as many times as it is taken (0 to ``cap``), all columns kept.

    Texts are never shuffled: which rows a source gives is decided by the last place taken in
    each round, one small row per source.  A null or empty text has size 0 and is kept once
    in each round its place is reached; a source with no tokens gives nothing.  A null doc_id is
    placed by its text; rows equal in doc_id (or, without one, in text) have one place and are
    taken together; ties of finish go by round, place and source.  An empty table stays empty.
    Columns beyond doc_id, source and text pass through, whatever their names.
    """
    sources, _ = plan_mix(slim_rows(docs, seed), weights, share, cap)
    names = docs.columns
    taken = {c.lower() for c in names}
    mixed, copy = free_name("__mix", taken), free_name("__copies", taken)
    ends = sources.select(F.struct("source", *[f"end{r}" for r in range(cap)]).alias(mixed))
    joined = docs.join(ends, docs["source"].eqNullSafe(F.col(f"{mixed}.source")))
    times = F.lit(0)
    place = shuffle_key(docs["doc_id"], docs["text"], seed)
    for r in range(cap):
        times = times + F.coalesce((place <= F.col(f"{mixed}.end{r}")).cast("int"), F.lit(0))
    copies = joined.withColumn(copy, F.explode(F.array_repeat(F.lit(1), times)))
    return copies.select(*[docs[c] for c in names])


def op1_weighted_fair_mix(spark, sf_dir: str) -> DataFrame:
    """Every document with the words that the mix takes of it; null and empty texts have size 0, cases as in :func:`mix_sources`."""
    cap = 2
    sources, rows = plan_mix(slim_rows(table(spark, sf_dir, "documents"), "mix"), (5, 2, 1), 1.5, cap)
    sources = sources.withColumnRenamed("source", "g")
    joined = rows.join(sources, F.col("source").eqNullSafe(F.col("g")))
    return joined.select("doc_id", "size", "source_size", "target", (F.col("size") * times_taken(F.col("place"), cap)).cast("long").alias("taken"))


OP1_SQL = r"""
WITH slim AS (
  SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size,
         md5('mix' || coalesce(CAST(doc_id AS VARCHAR), 'null' || md5(coalesce(text, '')))) AS place FROM documents),
sizes AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM slim GROUP BY source),
ranked AS (SELECT *, ([5, 2, 1])[CAST((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1 AS INT)] AS weight, source_size * 2e0 AS most FROM sizes),
leveled AS (SELECT *, ((sum(source_size) OVER ()) * 1.5e0 - coalesce(sum(most) OVER rise, 0e0)) / ((sum(weight) OVER ()) - coalesce(sum(weight) OVER rise, 0)) AS level
  FROM ranked WINDOW rise AS (ORDER BY most / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
goal AS (SELECT source, source_size, CAST(CASE WHEN most <= level * weight THEN most ELSE weight * max(level) FILTER (most > level * weight) OVER () END AS DOUBLE) AS target FROM leveled),
run AS (SELECT s.*, sum(size) OVER (PARTITION BY s.source ORDER BY place) AS upto, source_size, target FROM slim s JOIN goal g ON s.source IS NOT DISTINCT FROM g.source),
rounds AS (SELECT doc_id, source, place, size, r, (upto + source_size * r) / target AS finish FROM run, (VALUES (0), (1)) v(r) WHERE target > 0),
line AS (SELECT *, sum(size) OVER (ORDER BY finish, r, place, source NULLS LAST) AS total FROM rounds),
outside AS (SELECT DISTINCT finish, r, place, source, total FROM line WHERE total > (SELECT sum(target) FROM goal) ORDER BY total LIMIT 1),
hit AS (SELECT doc_id, source, place, r FROM line WHERE total < coalesce((SELECT min(total) FROM outside), 9e18))
SELECT doc_id, size, source_size, target, CAST(size * (SELECT count(DISTINCT r) FROM hit h WHERE h.place = run.place AND h.source IS NOT DISTINCT FROM run.source) AS BIGINT) AS taken FROM run
"""
