"""A training corpus from raw documents: STAGES in order, each over all that the one before kept.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the
columns of ``documents``.  SQL can't express a trained scorer or the encoder, so ORACLE_SQL is
None and tests hold the stages against brute force.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from isobar.llm.bpe import encode, tokenizer_path
from isobar.llm.jaccard import BROADCAST_ROWS, linked
from isobar.llm.mixing import mix_sources
from isobar.llm.pii import configured_key, pseudonymise
from isobar.llm.shared import WORD_PATTERN, durable, stored, table
from isobar.llm.toxicity import toxicity_scores

#: Documents scoring this much or more are rejected.
TOXIC = 0.3


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents scored below TOXIC; empty and null texts score low and stay.

    Repeated rows share their fate, texts of any length are read whole, other columns pass through whatever
    their names, and an empty table stays empty.
    """
    name = "toxicity_score"
    while name in docs.columns:
        name += "_"
    scored = toxicity_scores(docs, table(spark, sf_dir, "labels"), name=name)
    return scored.where(F.col(name) < TOXIC).select(*docs.columns)


def _without(docs: DataFrame, mark: Column, gone: DataFrame) -> DataFrame:
    """``docs`` without the rows whose ``mark`` is in ``gone``, a durable column of that name."""
    side = F.broadcast(gone) if gone.count() <= BROADCAST_ROWS else gone
    return docs.join(side, mark == F.col("gone"), "left_anti")


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near duplicates: the one of smallest doc_id, a null one last.  Texts without words stay.

    The decision is by row, whatever its doc_id: rows are told apart by a 64-bit hash of all
    their columns, and of rows equal in all columns one stays.  Other columns pass through whatever their
    names, texts of any length are read whole, and an empty table stays empty.
    """
    row = F.xxhash64(*[F.struct(F.col(c).isNull(), c) for c in docs.columns])
    worded = docs.where(F.col("text").rlike(WORD_PATTERN))
    twice = durable(worded.groupBy(row.alias("gone")).count().where("count > 1").select("gone"))
    if not twice.isEmpty():
        few = F.broadcast(twice) if twice.count() <= BROADCAST_ROWS else twice
        docs = stored(_without(docs, row, twice).unionByName(docs.join(few, row == F.col("gone"), "left_semi").dropDuplicates()))
    groups = durable(linked(docs.select(row.alias("doc_id"), "text")).where("component_id <> doc_id").select(F.col("doc_id").alias("row"), F.col("component_id").alias("component")))
    members = groups.unionByName(groups.select(F.col("component").alias("row"), "component").distinct())
    side = F.broadcast(members) if groups.count() <= BROADCAST_ROWS // 2 else members
    places = docs.select(row.alias("at"), F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", row.alias("at")).alias("place"))
    placed = durable(places.join(side, F.col("at") == F.col("row")).select("row", "component", "place"))
    stay = placed.groupBy("component").agg(F.min("place")["at"].alias("stays"))
    gone = durable(placed.join(stay, placed["row"] == stay["stays"], "left_anti").select(F.col("row").alias("gone")))
    return _without(docs, row, gone)


def replace_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts with pseudonyms for personal data, null and empty ones as they are; ``n_chars`` follows the text.

    Repeated rows get equal results, texts of any length are read whole, and an empty table stays empty.
    """
    names = docs.columns
    out = pseudonymise(docs, configured_key(spark))
    if "n_chars" in names:
        out = out.withColumn("n_chars", F.when(F.col("text").isNull(), F.col("n_chars")).otherwise(F.length("text").cast(docs.schema["n_chars"].dataType)))
    return out.select(*names)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources mixed to weights 5, 2, 1 and 150 % of all words; a row appears as often as it is taken.

    Null and empty texts have no words and cost nothing; an empty table stays empty.
    """
    return mix_sources(docs)


def tokenise(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every row and the text they decode to: doc_id, source, n_tokens, ids (little-endian unsigned 32-bit) and decoded.

    Null and empty texts have no ids and decode to an empty text.  Repeated rows come out as often as they go
    in, texts of any length are encoded whole, and an empty table stays empty.
    """
    coded = encode(docs.select("doc_id", "source", "text"), tokenizer_path(), decoded=True)
    return coded.select("doc_id", "source", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), "ids", "decoded")


STAGES = [
    ("toxicity", drop_toxic),
    ("n-gram Jaccard join", drop_near_duplicates),
    ("PII", replace_personal_data),
    ("mixing sources to target weights", mix),
    ("BPE encoding and decoding", tokenise),
]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of ``sf_dir``; each result but the last is written as Parquet and read again."""
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
