"""What is known only from a file's start, for files read in many splits.

A line's number, or whether it lies inside of a quoted field, depends on everything
before it.  Each split is counted by itself; a prefix sum over the splits of a file,
one narrow row for each, puts the counts in line.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.sizes import lookup_join, write_once

SPLIT = ["file", "block"]


def scanned_lines(
    spark: SparkSession, paths: Sequence[str], folder: str, pattern: str | None = None, separator: str | None = None
) -> DataFrame:
    """All lines with ``file``, ``block`` (where the split starts) and ``row`` (ascending within a split).

    They are stored in ``folder``, which all executors share: what comes after reads
    them several times, and a second scan could be cut into other splits.
    """
    reader = spark.read.option("recursiveFileLookup", True)
    if pattern:
        reader = reader.option("pathGlobFilter", pattern)
    if separator:
        reader = reader.option("lineSep", separator)
    lines = reader.text(list(paths)).select(
        "value",
        F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("row"),
    )
    return write_once(lines, folder, "lines")


def before_split(splits: DataFrame, amount: Column) -> Column:
    """The sum of ``amount`` over the splits before a split of the same file; one row per split."""
    earlier = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    return F.coalesce(F.sum(amount).over(earlier), F.lit(0))


def with_line_numbers(lines: DataFrame, folder: str, name: str = "line_number") -> DataFrame:
    """Add the number of each line in its file, from 1, to what :func:`scanned_lines` gives.

    A split's rows are consecutive, since one task reads it from start to end.
    """
    splits = lines.groupBy(*SPLIT).agg(F.min("row").alias("_first"), F.count("*").alias("_lines"))
    offsets = splits.select(*SPLIT, "_first", before_split(splits, F.col("_lines")).alias("_before"))
    placed = lookup_join(lines, offsets, SPLIT, "inner", salt_by=["row"], folder=folder)
    return placed.withColumn(name, F.col("row") - F.col("_first") + F.col("_before") + 1).drop("_first", "_before")


def quoted_records(lines: DataFrame, folder: str, quote: str = '"') -> DataFrame:
    """Records ``file``, ``value`` of text whose quoted fields may hold line breaks.

    A line break ends a record if the number of quotes before it in its file is even;
    doubled quotes inside of a field do not matter to that.  Lines that are a record
    by themselves stay where they are, the others are put together by record.
    """
    order = Window.partitionBy(*SPLIT).orderBy("row")
    earlier = order.rowsBetween(Window.unboundedPreceding, -1)
    quotes = F.length("value") - F.length(F.replace("value", F.lit(quote), F.lit("")))
    counted = lines.withColumn("_quotes", quotes).withColumn("_inside", F.coalesce(F.sum("_quotes").over(earlier), F.lit(0)) % 2)
    counted = write_once(counted, folder, "counted")
    splits = counted.groupBy(*SPLIT).agg(
        F.sum("_quotes").alias("_all"),
        F.count_if(F.col("_inside") == 0).alias("_even"),
        F.count_if(F.col("_inside") == 1).alias("_odd"),
    )
    splits = splits.withColumn("_parity", before_split(splits, F.col("_all")) % 2)
    starts = F.when(F.col("_parity") == 0, F.col("_even")).otherwise(F.col("_odd"))
    offsets = splits.select(*SPLIT, "_parity", before_split(splits, starts).alias("_before"))
    placed = lookup_join(counted, offsets, SPLIT, "inner", salt_by=["row"], folder=folder)
    opens = (F.col("_inside") + F.col("_parity")) % 2 == 0
    closes = (F.col("_inside") + F.col("_parity") + F.col("_quotes")) % 2 == 0
    whole = placed.where(opens & closes).select("file", "value")
    torn = placed.select(*SPLIT, "row", "value", opens.alias("_opens"), closes.alias("_closes"), "_before")
    record = F.col("_before") + F.count_if("_opens").over(Window.partitionBy(*SPLIT).orderBy("row"))
    torn = torn.withColumn("_record", record).where(~(F.col("_opens") & F.col("_closes")))
    parts = F.array_sort(F.collect_list(F.struct("block", "row", "value")))
    joined = torn.groupBy("file", "_record").agg(F.array_join(F.transform(parts, lambda part: part["value"]), "\n").alias("value"))
    return whole.unionByName(joined.select("file", "value"))
