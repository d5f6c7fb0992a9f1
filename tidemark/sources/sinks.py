"""Writers."""

from __future__ import annotations

import hashlib
import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tidemark.sizes import inline_table, write_once
from tidemark.sources.tables import is_complete

AUTHOR_BUCKETS = 64
MANIFEST = "manifest"


def author_bucket(author: str = "author", buckets: int = AUTHOR_BUCKETS) -> Column:
    return F.pmod(F.xxhash64(author), F.lit(buckets)).cast("int")


def write_author_json(
    posts: DataFrame, path: str, buckets: int = AUTHOR_BUCKETS, raw: str | None = None, batch: str | None = None
) -> None:
    """Append posts as JSON lines below ``data_type=…/author_bucket=…``.

    Authors are grouped into buckets instead of one file each.  Rebalancing
    gathers small buckets into few files and splits a bucket that one author
    fills.  With ``raw`` that column's text is written as it is.

    A ``batch`` names the append, so that it may be repeated: its rows are written
    to a folder of their own, and only then listed in a manifest.  A batch that is listed
    is not written again; what a broken-off attempt left is in no list.  Read such
    a folder with :func:`author_json_paths`.
    """
    spark = posts.sparkSession
    if batch is not None:
        listed = f"{path}/{MANIFEST}/{_name_of(batch)}"
        if is_complete(spark, listed):
            return
        attempt = f"{_name_of(batch)}-{uuid.uuid4().hex}"
        path = f"{path}/data/{attempt}"
    placed = posts.withColumn("author_bucket", author_bucket(buckets=buckets))
    placed = placed.hint("rebalance", "data_type", "author_bucket")
    if raw:
        lines = placed.select(F.col(raw).alias("value"), "data_type", "author_bucket")
        lines.write.mode("append").partitionBy("data_type", "author_bucket").text(path)
    else:
        placed.write.mode("append").partitionBy("data_type", "author_bucket").json(path)
    if batch is not None:
        entry = inline_table(spark, ["batch", "attempt"], [(batch, attempt)])
        # Of two writers of the same batch the first to finish is listed.
        entry.coalesce(1).write.mode("ignore").json(listed)


def _name_of(batch: str) -> str:
    """A folder name for a batch of any name."""
    return hashlib.md5(batch.encode()).hexdigest()


def author_json_paths(spark: SparkSession, path: str) -> list[str]:
    """The folders of all batches appended to ``path`` that were written to their end, one for each."""
    manifest = spark.read.schema("batch string, attempt string").option("recursiveFileLookup", True)
    try:
        listed = manifest.json(f"{path}/{MANIFEST}").collect()
    except AnalysisException as missing:
        if missing.getCondition() != "PATH_NOT_FOUND":
            raise
        listed = []
    return sorted(f"{path}/data/{row.attempt}" for row in listed)


def write_names(names: DataFrame, path: str, separator: str = "\n", name: str = "author") -> None:
    """Write a one-column list, one name per record, in as many files as there are partitions."""
    names.select(name).write.mode("overwrite").option("lineSep", separator).text(path)


def write_csv(df: DataFrame, path: str, header: bool = True) -> None:
    """Write CSV; arrays, maps and structs become JSON text, which CSV can hold."""
    nested = [c for c, kind in df.dtypes if kind.startswith(("array", "map", "struct"))]
    flat = df.withColumns({c: F.to_json(c) for c in nested}) if nested else df
    flat.write.mode("overwrite").option("header", header).option("escape", '"').csv(path)


def write_dataset(dataset: DataFrame, path: str, embedding: str = "embedding") -> DataFrame:
    """Write a labelled embedding dataset, read it back and check it.

    Fails if the stored vectors differ in length or the counts do not match.
    """
    stats = [F.count("*").alias("n"), F.min(F.size(embedding)).alias("low"), F.max(F.size(embedding)).alias("high")]
    dataset.write.mode("overwrite").parquet(path)
    stored = dataset.sparkSession.read.schema(dataset.schema).parquet(path)
    found = stored.agg(*stats).first()
    if found.n and found.low != found.high:
        raise ValueError(f"vectors of {found.low} to {found.high} numbers in {path}")
    return stored


def write_cohort(posts: DataFrame, path: str) -> None:
    """Write the selected cohort rows in place of an earlier selection; sources stay untouched."""
    posts.write.mode("overwrite").parquet(path)


def _stored_cohort(spark: SparkSession, path: str, schema: StructType) -> DataFrame | None:
    """What is at ``path``, if anything; dynamic overwriting leaves no success marker to look for."""
    try:
        return spark.read.schema(schema).parquet(path)
    except AnalysisException as missing:
        if missing.getCondition() != "PATH_NOT_FOUND":
            raise
        return None


def replace_authors(posts: DataFrame, path: str, folder: str, buckets: int = AUTHOR_BUCKETS, author: str = "author") -> None:
    """Put the authors of ``posts`` in place of their earlier rows in the cohort at ``path``; all others stay.

    The cohort lies in buckets of authors.  Only buckets that a new author falls into are
    rewritten, their other authors' rows included; the files of the rest are not
    touched.  The merged buckets are first stored in ``folder``, which all executors
    share, so that a run that is broken off has changed nothing, and can be repeated.
    """
    spark = posts.sparkSession
    new = write_once(posts.withColumn("author_bucket", author_bucket(author, buckets)), folder, "new")
    stored = _stored_cohort(spark, path, new.schema)
    if stored is not None:
        # One row for each bucket at most.
        touched = [row[0] for row in new.select("author_bucket").distinct().collect()]
        others = stored.where(F.col("author_bucket").isin(touched)).join(new.select(author).distinct(), author, "left_anti")
        new = write_once(new.unionByName(others.select(*new.columns)), folder, "merged")
    placed = new.hint("rebalance", "author_bucket")
    placed.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("author_bucket").parquet(path)


def write_report(report: DataFrame, path: str) -> None:
    """Write the one-row result report as JSON."""
    report.coalesce(1).write.mode("overwrite").json(path)
