"""Joins whose plan depends on how big a side really is."""

from __future__ import annotations

import uuid
from collections.abc import Sequence

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

BROADCAST_ROWS = 1_000_000
BROADCAST_BYTES = 256 << 20
SALTS = 8


def inline_table(spark: SparkSession, names: Sequence[str], rows: Sequence[tuple]) -> DataFrame:
    """A small table from Python rows; Spark sees its exact size."""
    columns = list(zip(*rows, strict=True)) or [[] for _ in names]
    return spark.createDataFrame(pa.table(dict(zip(names, map(list, columns), strict=True))))


def broadcast_share(df: DataFrame) -> float:
    """The part of a table, by a count of rows and text bytes, that the broadcast limits allow; 1 or more if it fits."""
    texts = [F.coalesce(F.octet_length(c), F.lit(0)) for c, kind in df.dtypes if kind in ("string", "binary")]
    # What is nested has strings of any length inside: as JSON it is not shorter.
    nested = [c for c, kind in df.dtypes if kind.startswith(("array", "map", "struct"))]
    texts += [F.coalesce(F.octet_length(F.to_json(F.struct(c))), F.lit(0)) for c in nested]
    width = sum(texts, F.lit(16 * len(df.columns)).cast("long"))
    found = df.agg(F.count("*").alias("rows"), F.sum(width).alias("bytes")).first()
    return min(BROADCAST_ROWS / found.rows, BROADCAST_BYTES / found.bytes) if found.rows else float("inf")


def fits_broadcast(df: DataFrame) -> bool:
    """Whether a count of rows and text bytes stays within the broadcast limits."""
    return broadcast_share(df) >= 1


def checked_broadcast(df: DataFrame) -> DataFrame:
    """Broadcast a stored table if it fits; a larger one is returned as it is.

    This counts the table at once, so it belongs into explicit steps of a job,
    not into operators that only compose a plan.
    """
    return F.broadcast(df) if fits_broadcast(df) else df


def write_once(df: DataFrame, folder: str, what: str) -> DataFrame:
    """``df`` stored under a new name in ``folder``, which is the caller's to remove, and read back."""
    path = f"{folder}/{what}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def lookup_join(
    left: DataFrame,
    right: DataFrame,
    on: Sequence[str],
    how: str = "left",
    salt_by: Sequence[str] | None = None,
    salts: int = SALTS,
    folder: str | None = None,
    often: str | None = None,
) -> DataFrame:
    """Join ``left`` to ``right``, which is derived and holds one row per key.

    Without ``folder`` nothing runs: it is a plain join that adaptive execution
    turns into a broadcast, or splits where a key is hot.

    ``left`` carries the texts, so not having to shuffle it matters most.  With a
    ``folder`` that all executors share, the right side is stored there first, as
    a step of its own, and measured: if it fits it is broadcast.  If not, one key
    may still hold a large part of ``left``.  Its rows are dealt over ``salts``
    sub-keys (a power of two), and the narrow right rows are copied to each.  The
    salt depends on the row alone (on ``salt_by``, or all of it), so a retried
    task deals the same rows to the same sub-keys.  The folder is the caller's, who
    removes it when the result is stored.

    ``often`` names a column of ``right`` that grows with how often its key stands in
    ``left``.  Of a right side that does not fit, the most frequent keys that do are then
    broadcast, and only rows with none of these are shuffled, without copies.
    """
    on = list(on)
    if folder is None:
        return left.join(right, on, how)
    right = write_once(right, folder, "lookup")
    share = broadcast_share(right)
    if share >= 1:
        return left.join(F.broadcast(right), on, how)
    kept = left.columns + [c for c in right.columns if c not in on]
    if often is not None:
        # A little less than fits, as the percentile is not exact; keys at the edge itself are shuffled.
        edge = right.agg(F.percentile_approx(often, 1 - 0.95 * share)).first()[0]
        head, tail = right.where(F.col(often) > edge), right.where(F.col(often) <= edge)
        rest = left.join(F.broadcast(head.select(*on)), on, "left_anti").join(tail, on, how)
        return left.join(F.broadcast(head), on).select(*kept).unionByName(rest.select(*kept))
    row = salt_by or [c for c, kind in left.dtypes if "map<" not in kind]
    salted = left.withColumn("_salt", F.xxhash64(*row).bitwiseAND(F.lit(salts - 1)))
    copies = right.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1)).cast("array<bigint>")))
    return salted.join(copies, [*on, "_salt"], how).select(*kept)
