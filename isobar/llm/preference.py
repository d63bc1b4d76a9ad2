"""Chat formatting for preference training: one prompt, two completions.

The longest common turn prefix of a chosen and a rejected conversation is rendered once, as
the prompt; what follows in each is its completion, with the spans of assistant text that
count for the loss.  Everything else (prompt, other roles, markers) is masked.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

#: Conversations of one first turn that a single task numbers, on average.
GROUP_ROWS = 50_000


def _rendered(turns: Column) -> Column:
    return F.concat_ws("", F.transform(turns, lambda t: F.concat(F.lit("<|"), t["role"], F.lit("|>\n"), t["text"], F.lit("<|end|>\n"))))


def _spans(turns: Column) -> Column:
    """"start:end" of each assistant text in the rendered turns, in code points, the end marker included."""
    head = lambda t: F.length(t["role"]) + 5
    size = lambda t: head(t) + F.length(t["text"]) + 8

    def step(s: Column, t: Column) -> Column:
        start = s["at"] + head(t)
        span = F.concat_ws(":", start.cast("string"), (start + F.length(t["text"]) + 7).cast("string"))
        return F.struct((s["at"] + size(t)).alias("at"), F.when(t["role"] == "assistant", F.concat(s["out"], F.array(span))).otherwise(s["out"]).alias("out"))

    return F.aggregate(turns, F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("out")), step, lambda s: F.concat_ws(",", s["out"]))


def gathered(turns: DataFrame) -> DataFrame:
    """conv_id, turns (array of turn, role, text in turn order): one row for each conversation.

    Null roles become "unknown", null texts empty; repeated turns stay, in the order of role and text.
    """
    cells = F.struct("turn", F.coalesce("role", F.lit("unknown")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    return turns.where(F.col("conv_id").isNotNull()).groupBy("conv_id").agg(F.sort_array(F.collect_list(cells)).alias("turns"))


def format_pairs(pairs: DataFrame) -> DataFrame:
    """Rendered pairs from columns chosen_id, rejected_id, chosen, rejected (turn arrays; rejected may be null).

    The prefix stops short of either conversation's last turn, so that no completion is empty.
    Without a rejected conversation the prompt is all but the last turn.  Empty texts are rendered
    empty; repeated rows give equal pairs, an empty table none; only the four columns are read.
    """
    equal = lambda i: (F.col("chosen")[i]["role"] == F.col("rejected")[i]["role"]) & (F.col("chosen")[i]["text"] == F.col("rejected")[i]["text"])
    most = F.least(F.size("chosen"), F.when(F.col("rejected").isNotNull(), F.size("rejected"))) - 1
    common = F.aggregate(F.when(most > 0, F.sequence(F.lit(0), most - 1)).otherwise(F.array().cast("array<int>")), F.lit(0), lambda n, i: F.when((n == i) & equal(i), i + 1).otherwise(n))
    common = F.when(F.col("rejected").isNull(), F.size("chosen") - 1).otherwise(common)
    cut = pairs.withColumn("n_prompt_turns", common.cast("int"))
    rest = lambda c: F.slice(c, F.col("n_prompt_turns") + 1, F.size(c))
    return cut.select(
        "chosen_id", "rejected_id", "n_prompt_turns",
        _rendered(F.slice("chosen", 1, F.col("n_prompt_turns"))).alias("prompt"),
        _rendered(rest(F.col("chosen"))).alias("chosen"), _spans(rest(F.col("chosen"))).alias("chosen_loss"),
        F.when(F.col("rejected").isNotNull(), _rendered(rest(F.col("rejected")))).alias("rejected"),
        F.when(F.col("rejected").isNotNull(), _spans(rest(F.col("rejected")))).alias("rejected_loss"),
    )


def paired(turns: DataFrame) -> DataFrame:
    """Pairs of conversations with an equal first turn, for :func:`format_pairs`.

    In each group they are paired first with second, third with fourth, in the order of conv_id;
    the one of more turns is chosen, a tie goes to the smaller id, and the last of an odd group
    has no partner.  A group of more than GROUP_ROWS is numbered in parts, by hash of conv_id.
    Rows without a conv_id are left out, repeated turns stay (:func:`gathered`), turns of any length
    are compared whole, an empty table gives an empty one, and other columns play no part.
    """
    whole = gathered(turns)
    # the first turn itself, as a digest that tells different turns apart
    begun = whole.withColumn("first", F.sha2(F.concat(F.octet_length(F.col("turns")[0]["role"]).cast("string"), F.lit(":"), F.col("turns")[0]["role"], F.col("turns")[0]["text"]), 256))
    ids = begun.select("conv_id", "first")
    groups = ids.groupBy("first").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    cut = ids.join(groups, "first").withColumn("part", F.pmod(F.xxhash64("conv_id"), F.ceil(F.col("n") / GROUP_ROWS)))
    sizes = cut.groupBy("first", "part").agg(F.count(F.lit(1)).alias("m"))
    before = sizes.select("first", "part", F.coalesce(F.sum("m").over(W.partitionBy("first").orderBy("part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    slot = F.row_number().over(W.partitionBy("first", "part").orderBy("conv_id")) - 1 + F.col("before")
    slots = cut.join(before, ["first", "part"]).select("conv_id", "first", slot.alias("slot"))
    mates = slots.groupBy("first", F.floor(F.col("slot") / 2).alias("pair")).agg(F.min("conv_id").alias("a"), F.max("conv_id").alias("b")).where("a <> b")
    # each paired conversation with its partner; the others are alone
    sides = mates.select(F.col("a").alias("conv_id"), F.col("b").alias("mate")).unionByName(mates.select(F.col("b").alias("conv_id"), F.col("a").alias("mate")))
    keyed = whole.join(sides, "conv_id", "left").withColumn("pair", F.least("conv_id", "mate"))  # alone: its own id
    both = keyed.groupBy("pair").agg(F.min(F.struct((-F.size("turns")).alias("k"), "conv_id", "turns")).alias("c"), F.max(F.struct((-F.size("turns")).alias("k"), "conv_id", "turns")).alias("r"), F.count(F.lit(1)).alias("n"))
    two = F.col("n") > 1
    return both.select(F.col("c.conv_id").alias("chosen_id"), F.when(two, F.col("r.conv_id")).alias("rejected_id"), F.col("c.turns").alias("chosen"), F.when(two, F.col("r.turns")).alias("rejected"))


def op8_preference_pairs(spark, sf_dir: str) -> DataFrame:
    """Every conversation in one pair or alone; cases as in :func:`paired` and :func:`format_pairs`."""
    from .shared import table

    return format_pairs(paired(table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")))


OP8_SQL = r"""
WITH t AS (SELECT conv_id, coalesce(role, 'unknown') AS role, coalesce(text, '') AS text,
  row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, 'unknown'), coalesce(text, '')) - 1 AS k, count(*) OVER (PARTITION BY conv_id) AS n
  FROM conversations WHERE conv_id IS NOT NULL),
f AS (SELECT conv_id, n, row_number() OVER (PARTITION BY role, text ORDER BY conv_id) - 1 AS slot, count(*) OVER (PARTITION BY role, text) AS m, role, text FROM t WHERE k = 0),
p AS (SELECT role, text, slot // 2 AS pair, min(conv_id) AS a, max(conv_id) AS b FROM f GROUP BY ALL),
q AS (SELECT CASE WHEN y.n > x.n THEN p.b ELSE p.a END AS chosen_id, CASE WHEN p.a = p.b THEN NULL WHEN y.n > x.n THEN p.a ELSE p.b END AS rejected_id, greatest(x.n, y.n) AS nc, least(x.n, y.n) AS nr
  FROM p JOIN f x ON x.conv_id = p.a JOIN f y ON y.conv_id = p.b),
l AS (SELECT q.chosen_id, CASE WHEN q.rejected_id IS NULL THEN q.nc - 1 ELSE coalesce(least(min(c.k) FILTER (c.role <> r.role OR c.text <> r.text), nr - 1), nr - 1) END AS cut
  FROM q LEFT JOIN t c ON c.conv_id = q.chosen_id LEFT JOIN t r ON r.conv_id = q.rejected_id AND r.k = c.k GROUP BY q.chosen_id, q.rejected_id, q.nc, q.nr),
s AS (SELECT q.chosen_id AS id, side, t.k, t.k >= l.cut AS late, t.role, t.text, '<|' || t.role || '|>' || chr(10) || t.text || '<|end|>' || chr(10) AS piece
  FROM q JOIN l ON l.chosen_id = q.chosen_id CROSS JOIN (VALUES ('c'), ('r')) v(side) JOIN t ON t.conv_id = CASE WHEN side = 'c' THEN q.chosen_id ELSE q.rejected_id END),
o AS (SELECT *, coalesce(sum(length(piece)) OVER (PARTITION BY id, side, late ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + length(role) + 5 AS start FROM s),
g AS (SELECT id, side, coalesce(string_agg(piece, '' ORDER BY k) FILTER (NOT late), '') AS prompt, coalesce(string_agg(piece, '' ORDER BY k) FILTER (late), '') AS done,
  coalesce(string_agg(CAST(start AS BIGINT) || ':' || CAST(start + length(text) + 7 AS BIGINT), ',' ORDER BY k) FILTER (late AND role = 'assistant'), '') AS loss FROM o GROUP BY id, side)
SELECT q.chosen_id, q.rejected_id, CAST(l.cut AS INTEGER) AS n_prompt_turns, c.prompt, c.done AS chosen, c.loss AS chosen_loss, r.done AS rejected, r.loss AS rejected_loss
FROM q JOIN l ON l.chosen_id = q.chosen_id JOIN g c ON c.id = q.chosen_id AND c.side = 'c' LEFT JOIN g r ON r.id = q.chosen_id AND r.side = 'r'
"""
