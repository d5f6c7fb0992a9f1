"""Post dumps: JSON lines, plain or compressed, in any number of folders."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.sources.splits import scanned_lines, with_line_numbers

FIELDS = ["id", "author", "subreddit", "created_utc", "body", "selftext", "title"]
# Every field is read as text: a number or a nested value keeps its JSON text,
# so a field of an unexpected type does not make the line a bad one.
LINE_SCHEMA = ", ".join(f"{name} string" for name in FIELDS) + ", _bad string"


def parse_lines(lines: DataFrame, mode: str = "tolerant", keep_raw: bool = False) -> DataFrame:
    """Posts from a column ``value`` of JSON lines; other columns are kept.

    ``tolerant`` drops lines that are not JSON, ``strict`` fails on the first.
    Fields absent from a line are NULL.  ``keep_raw`` adds the untouched line.
    """
    if mode not in ("tolerant", "strict"):
        raise ValueError(f"unknown mode {mode!r}")
    others = [c for c in lines.columns if c != "value"]
    if mode == "strict":
        parsed = F.from_json("value", LINE_SCHEMA.removesuffix(", _bad string"), {"mode": "FAILFAST"})
        posts = lines.withColumn("_post", parsed)
    else:
        options = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"}
        posts = lines.withColumn("_post", F.from_json("value", LINE_SCHEMA, options))
        posts = posts.where(F.col("_post").isNotNull() & F.col("_post._bad").isNull() & (F.trim("value") != ""))
    fields = [F.col(f"_post.{name}").alias(name) for name in FIELDS if name != "created_utc"]
    at = F.expr("try_cast(_post.created_utc as double)").cast("long").alias("created_utc")
    raw = [F.col("value").alias("raw")] if keep_raw else []
    return posts.select(*fields, at, *raw, *others)


def data_type(file_name: Column) -> Column:
    """Submissions if the base name holds ``RS``, else comments."""
    return F.when(file_name.contains("RS"), "submissions").otherwise("comments")


def author_of_file(file_name: Column) -> Column:
    """Author from ``<author>_<kind>.json``; the author may hold underscores."""
    return F.regexp_extract(file_name, r"^(.*)_(?:comments|submissions)\.json", 1)


def folder_of_file(file_path: Column) -> Column:
    """Name of the folder a file lies in, which is its community or cohort."""
    return F.element_at(F.split(file_path, "/"), -2)


def _file_columns(lines: DataFrame, places: list[Column]) -> DataFrame:
    name = F.element_at(F.split("file", "/"), -1)
    return lines.select("value", "file", data_type(name).alias("data_type"), *places)


def read_posts(
    spark: SparkSession,
    paths: Sequence[str],
    mode: str = "tolerant",
    pattern: str | None = None,
    keep_raw: bool = False,
    partitions: int | None = None,
    positions: bool = False,
    line_numbers: str | None = None,
) -> DataFrame:
    """Posts of all files below ``paths`` with ``file`` and ``data_type``.

    Compressed files cannot be split: one task decodes each.  ``partitions``
    deals the raw lines out right after, so that parsing and all later work run
    at full width whatever the file sizes are.

    ``positions`` adds ``pos``, which orders the lines of all files: by the file's
    path, and within it by the start of the split and a count, so a file may be
    read in many splits.  It is an order, not a line number; store the posts before use.

    ``line_numbers`` is a folder all executors share: the lines are stored there and
    numbered from 1 in each file, bad lines included, as ``line_number``.
    """
    place = F.struct("file", "block", "row").alias("pos")
    if line_numbers is not None:
        lines = with_line_numbers(scanned_lines(spark, paths, line_numbers, pattern), line_numbers)
        scanned = _file_columns(lines, [F.col("line_number"), *([place] if positions else [])])
    else:
        reader = spark.read.option("recursiveFileLookup", True)
        if pattern:
            reader = reader.option("pathGlobFilter", pattern)
        path, block = F.col("_metadata.file_path"), F.col("_metadata.file_block_start")
        lines = reader.text(list(paths)).select(
            "value", path.alias("file"), block.alias("block"), F.monotonically_increasing_id().alias("row")
        )
        scanned = _file_columns(lines, [place] if positions else [])
    if partitions:
        scanned = scanned.repartition(partitions)
    return parse_lines(scanned, mode, keep_raw)


def with_post_id(posts: DataFrame, name: str = "post_id") -> DataFrame:
    """Add a key per post: its ``id``, or a digest if it has none.

    The digest is that of its fields, and of its file and position where the table
    has them; with positions, equal posts have different keys.
    """
    place = [F.to_json(F.struct(c)) for c in ("file", "pos") if c in posts.columns]
    fields = [F.coalesce(F.col(c).cast("string"), F.lit("")) for c in FIELDS[1:]]
    digest = F.md5(F.concat_ws("\x1f", *fields, *place))
    return posts.withColumn(name, F.coalesce("id", digest))


def with_time(posts: DataFrame, at: str = "created_utc") -> DataFrame:
    """Turn epoch seconds into a timestamp."""
    return posts.withColumn(at, F.timestamp_seconds(at))


def with_all_fields(posts: DataFrame) -> DataFrame:
    """Add the text fields a table lacks, as NULL."""
    missing = {name: F.lit(None).cast("string") for name in ("body", "selftext", "title") if name not in posts.columns}
    return posts.withColumns(missing) if missing else posts
