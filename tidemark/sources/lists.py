"""Name lists and ordered community lists."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions.text import strip_space


def read_names(spark: SparkSession, path: str, separator: str = "\n", name: str = "author") -> DataFrame:
    """Distinct trimmed names of a newline or comma list.

    The separator ends a record for the reader, so a list that is one huge line
    is still read in splits.
    """
    records = spark.read.option("lineSep", separator).text(path)
    names = records.select(F.explode(F.split("value", "[,\n]")).alias(name)).select(strip_space(F.col(name)).alias(name))
    return names.where(F.col(name) != "").distinct()


def read_priorities(spark: SparkSession, path: str) -> DataFrame:
    """``(community, priority)`` from a newline list; the first line is priority 1.

    The file is read whole, since line numbers exist only within one file; it is
    a hand-written list.
    """
    whole = spark.read.text(path, wholetext=True)
    lines = whole.select(F.posexplode(F.split("value", "\r?\n")).alias("_at", "community"))
    listed = lines.where(F.col("community") != "")
    return listed.groupBy("community").agg((F.min("_at") + 1).alias("priority"))
