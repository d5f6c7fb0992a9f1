"""From raw documents to token ids, stage by stage.

Each stage takes the documents that its predecessor kept, as a table, and returns
the documents that go on, with the columns of ``documents``; the last one returns
token ids.  Rows are judged each by itself, whatever their ``doc_id``: nulls and
repeated ids are allowed, and an empty table stays empty.  ``n_chars`` follows the text.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.minhash import near_duplicates
from tidemark.llm.mixing import mix
from tidemark.llm.quality import judge
from tidemark.llm.repeats import repeated_spans
from tidemark.llm.tables import small_batches, stored, table
from tidemark.llm.tokens import encode_decode
from tidemark.sizes import fits_broadcast

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def _row() -> list:
    """What names a row: its id, language and source, and a hash of its text."""
    return [F.struct("doc_id", "lang", "source").alias("_id"), F.xxhash64("text").alias("_hash")]


def _without(docs: DataFrame, dropped: DataFrame) -> DataFrame:
    """``docs`` without the rows named in ``dropped``; the texts only move if the names are too many to send."""
    dropped = stored(dropped.select("_id", "_hash").distinct(), "dropped")
    named = docs.select("*", *_row())
    small = F.broadcast(dropped) if fits_broadcast(dropped) else dropped
    return named.join(small, ["_id", "_hash"], "left_anti").drop("_id", "_hash")


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that fail the fixed limits, or stand out from their language and source, go."""
    small_batches(spark)
    docs = docs.select(*COLUMNS)
    named = docs.select("text", "lang", "source", *_row())
    return _without(docs, judge(named, keep=("_id", "_hash")).where(~F.col("kept")))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates stays: the one of the least id.  Documents without words stay."""
    small_batches(spark)
    docs = docs.select(*COLUMNS)
    named = docs.select("doc_id", "text", *_row())
    found = stored(near_duplicates(named, keep=("_id", "_hash")).where(F.col("group").isNotNull()), "groups")
    names = F.struct(F.col("doc_id").isNull(), F.col("doc_id"), F.col("_hash"), F.col("_id"))
    chosen = stored(found.groupBy("group").agg(F.min(names).alias("_chosen")), "chosen")
    marked = found.join(chosen, "group").withColumn("_stays", names.eqNullSafe(F.col("_chosen")))
    left = _without(docs, marked.where(~F.col("_stays")))
    # Rows equal in everything that names a row: all but one of them go.
    twice = marked.where("_stays").groupBy("_id", "_hash").count().where("count > 1").select("_id", "_hash")
    twice = stored(twice, "twice")
    if twice.isEmpty():
        return left
    named = left.select("*", *_row())
    equal = named.join(twice, ["_id", "_hash"], "left_semi").dropDuplicates(["_id", "_hash"])
    return _without(left, twice).unionByName(equal.drop("_id", "_hash"))


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Whole characters of repeated passages are cut out; every document stays, be it empty."""
    small_batches(spark)
    keep = tuple(c for c in COLUMNS if c != "text")
    cut = repeated_spans(docs.select(*COLUMNS), keep=keep, whole_characters=True)
    text = F.col("kept").cast("string")
    return cut.select("doc_id", text.alias("text"), "lang", "source", F.length(text).cast("long").alias("n_chars"))


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it: not at all, once or twice."""
    mixed = mix(docs.select(*COLUMNS)).where("copies > 0")
    return mixed.select(*COLUMNS, F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))).alias("_copy")).drop("_copy")


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each document, checked to decode to its text."""
    small_batches(spark)
    coded = encode_decode(docs.select(*COLUMNS), public_tokenizers.path("byte_bpe_50k.json"), keep=("doc_id", "text", "lang", "source"))
    exact = F.col("decoded") == F.coalesce("text", F.lit(""))
    return coded.select(
        "doc_id", "lang", "source", F.size("ids").cast("long").alias("n_tokens"), "ids", exact.alias("round_trip")
    )


STAGES = [
    ("quality_rules", quality_rules),
    ("near_dedup", near_dedup),
    ("repeated_passages", repeated_passages),
    ("mixing", mixing),
    ("bpe_tokens", tokens),
]

#: SQL cannot express the estimates, the groups and the encoder.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), name)
    return docs
