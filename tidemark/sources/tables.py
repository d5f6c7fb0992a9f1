"""Headerless CSV files and stored intermediate tables."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable, Sequence

from pyspark.errors import AnalysisException
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.sources.splits import quoted_records, scanned_lines

DATED_SCHEMA = "number string, date string, uid string, link string, text string"


def read_dated_posts(spark: SparkSession, path: str, multi_line: bool = False, folder: str | None = None) -> DataFrame:
    """A headerless CSV of ``number, date, uid, link, text`` with the date parsed.

    ``multi_line`` allows line breaks inside quoted fields.  Spark then reads a file in one
    task; with a ``folder`` that all executors share it is read in splits instead
    (:func:`read_quoted_csv`).
    """
    if multi_line and folder is not None:
        rows = read_quoted_csv(spark, [path], DATED_SCHEMA, folder)
    else:
        reader = spark.read.schema(DATED_SCHEMA).option("header", False).option("multiLine", multi_line)
        rows = reader.option("escape", '"').csv(path)
    return rows.withColumn("date", F.to_timestamp("date"))


def read_quoted_csv(spark: SparkSession, paths: Sequence[str], schema: str, folder: str) -> DataFrame:
    """A headerless CSV whose quoted fields may hold line breaks, read in splits.

    Rows are those of Spark's reader with ``multiLine``; quotes inside of a field are doubled.
    """
    lines = scanned_lines(spark, paths, folder, separator="\n")
    records = quoted_records(lines, folder).select(F.regexp_replace("value", "\r$", "").alias("value")).where("value <> ''")
    fields = F.from_csv("value", schema, {"escape": '"', "header": "false"})
    return records.select(fields.alias("_fields")).select("_fields.*")


def read_token_lines(spark: SparkSession, path: str) -> DataFrame:
    """A headerless one-column CSV of token strings; posts without tokens are dropped."""
    return spark.read.schema("token string").option("header", False).csv(path).where(F.col("token").isNotNull())


def is_complete(spark: SparkSession, path: str) -> bool:
    """Whether a write to ``path`` ran to its end, which leaves the success marker."""
    try:
        spark.read.text(f"{path}/_SUCCESS")
        return True
    except AnalysisException as missing:
        if missing.getCondition() != "PATH_NOT_FOUND":
            raise
        return False


def input_tag(spark: SparkSession, paths: Sequence[str], pattern: str | None = None) -> str:
    """A fingerprint of all files below ``paths``: path, length and time of each.

    Only the files' listing is read, by the executors; a table made from the files
    takes it as part of its name (see :func:`materialize`) and is built anew when a
    file is added, taken away or changed.
    """
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", True)
    if pattern:
        reader = reader.option("pathGlobFilter", pattern)
    files = reader.load(list(paths)).select("path", "length", "modificationTime")
    hashes = [F.bit_xor(F.xxhash64(F.lit(salt), *files.columns)).alias(f"h{salt}") for salt in (1, 2)]
    found = files.agg(F.count("*").alias("files"), F.coalesce(F.sum("length"), F.lit(0)).alias("bytes"), *hashes).first()
    return "-".join(str(value) for value in found)


def materialize(spark: SparkSession, path: str, build: Callable[[], DataFrame], *made_from: object) -> DataFrame:
    """The Parquet table at ``path``, built and written first if it is not there.

    ``made_from`` names what the table depends on: parameters, and a tag of the
    input (:func:`input_tag` makes one from the files).  It is part of the stored name, so other values are another table and
    what an earlier run left for its own values is not taken for this one's.

    Put ``path`` in storage all executors share: readers of the result survive
    the loss of the executors that built it.  What a broken-off write left is
    replaced.
    """
    if made_from:
        named = json.dumps(made_from, default=str)
        path = f"{path}-{hashlib.md5(named.encode()).hexdigest()[:16]}"
    if not is_complete(spark, path):
        build().write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def read_embedding_dataset(spark: SparkSession, path: str, embedding: str = "embedding") -> DataFrame:
    """A stored embedding dataset with an ML vector column ``features``."""
    stored = spark.read.parquet(path)
    return stored.withColumn("features", array_to_vector(F.col(embedding).cast("array<double>")))
