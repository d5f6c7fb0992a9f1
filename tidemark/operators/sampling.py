"""Exact samples and splits that do not depend on how rows are laid out.

A draw is the md5 of seed and key.  Sorting a large table by it to take its head
would send every partition's head to one task, so the position of the last
wanted row is first narrowed down with a histogram of draw prefixes.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.draws import cell, draw
from tidemark.functions.fixed_values import SPLIT_SEED, TEST_SIZE
from tidemark.sizes import lookup_join, write_once

GLOBAL_DIGITS = 4
GROUP_DIGITS = 3


def _head_edge(drawn: DataFrame, groups: list[str], wanted: Column) -> DataFrame:
    """Per group, the draw and key of the ``wanted``-th row in draw order.

    ``drawn`` holds the groups, ``_key`` and ``_draw``; ``wanted`` may use
    ``_total``, the group's row count.  Groups that want no row are absent, and
    a group smaller than wanted gets its last row.
    """
    digits = GROUP_DIGITS if groups else GLOBAL_DIGITS
    celled = drawn.withColumn("_cell", cell(F.col("_draw"), digits))
    # At most 16 ** digits rows per group go through this window.
    order = Window.partitionBy(*groups).orderBy("_cell")
    sizes = (
        celled.groupBy(*groups, "_cell")
        .agg(F.count("*").alias("_rows"))
        .withColumn("_upto", F.sum("_rows").over(order))
        .withColumn("_total", F.sum("_rows").over(Window.partitionBy(*groups)))
        .withColumn("_wanted", F.least(wanted, F.col("_total")))
    )
    rim = sizes.where((F.col("_upto") >= F.col("_wanted")) & (F.col("_upto") - F.col("_rows") < F.col("_wanted")))
    rim = rim.select(*groups, "_cell", (F.col("_wanted") - F.col("_upto") + F.col("_rows")).alias("_room"))
    place = Window.partitionBy(*groups, "_cell").orderBy("_draw", "_key")
    return (
        celled.join(rim, [*groups, "_cell"])
        .withColumn("_place", F.row_number().over(place))
        .where(F.col("_place") == F.col("_room"))
        .select(*groups, F.struct("_draw", "_key").alias("_edge"))
    )


def sample_n(df: DataFrame, key: str, n: int, seed: int = SPLIT_SEED, folder: str | None = None) -> DataFrame:
    """Exactly ``n`` of the distinct keys; fails if there are fewer.

    The keys are read three times: for the histogram, the edge and the sample.  With a
    ``folder`` that all executors share, the distinct keys are stored there first, so
    that ``df`` itself is read once.
    """
    drawn = df.select(F.col(key).alias("_key")).distinct().withColumn("_draw", draw(F.col("_key"), seed))
    if folder is not None:
        drawn = write_once(drawn, folder, "keys")
    too_few = F.raise_error(F.lit(f"cannot draw {n} distinct keys: there are fewer")).cast("long")
    wanted = F.when(F.col("_total") < n, too_few).otherwise(F.lit(n))
    edge = _head_edge(drawn, [], wanted).select("_edge").scalar()
    return drawn.where(F.struct("_draw", "_key") <= edge).select(F.col("_key").alias(key))


def sample_fraction(
    df: DataFrame, group: str, key: str, fraction: float = 0.1, seed: int = SPLIT_SEED, folder: str | None = None
) -> DataFrame:
    """Exactly ``fraction`` of each group's rows, rounded half to even; ``key`` must be unique.

    Only group and key are read to find the edge of the sample, so the rows with
    their texts are scanned once and not shuffled unless the edges are many.
    """
    keyed = df.withColumn("_key", F.col(key)).withColumn("_draw", draw(F.col(key), seed))
    wanted = F.rint(F.col("_total") * fraction).cast("long")
    edges = _head_edge(keyed.select(group, "_key", "_draw"), [group], wanted)
    return (
        lookup_join(keyed, edges, [group], "inner", salt_by=["_draw"], folder=folder)
        .where(F.struct("_draw", "_key") <= F.col("_edge"))
        .select(*df.columns)
    )


def sample_fraction_fast(df: DataFrame, fraction: float = 0.1, seed: int = SPLIT_SEED) -> DataFrame:
    """A Bernoulli sample on the scan: near ``fraction``, no shuffle at all."""
    return df.sample(fraction, seed)


def hash_split(df: DataFrame, key: str, below: str = "33", name: str = "split") -> DataFrame:
    """Mark rows ``test`` where the key's md5 starts below ``below`` (``33``: 51 of 256), else ``train``."""
    start = F.substring(F.md5(F.col(key).cast("string")), 1, len(below))
    return df.withColumn(name, F.when(start < below, "test").otherwise("train"))


def exact_split(
    df: DataFrame, key: str, test_size: float = TEST_SIZE, seed: int = SPLIT_SEED, name: str = "split"
) -> DataFrame:
    """Mark exactly ``ceil(test_size * rows)`` rows ``test``; ``key`` must be unique."""
    drawn = df.select(F.col(key).alias("_key")).withColumn("_draw", draw(F.col("_key"), seed))
    wanted = F.ceil(F.col("_total") * F.lit(test_size)).cast("long")
    edge = _head_edge(drawn, [], wanted).select("_edge").scalar()
    here = F.struct(draw(F.col(key), seed).alias("_draw"), F.col(key).alias("_key"))
    return df.withColumn(name, F.when(here <= edge, "test").otherwise("train"))


def draw_position(df: DataFrame, key: str, seed: int = SPLIT_SEED, name: str = "position") -> DataFrame:
    """Number all rows 1, 2, 3, … in draw order; ``key`` must be unique.

    Each of the ``16 ** GLOBAL_DIGITS`` cells is numbered by itself; the cell
    offsets are a table of that many rows at most, so they are broadcast.
    """
    celled = df.withColumn("_draw", draw(F.col(key), seed)).withColumn("_cell", cell(F.col("_draw"), GLOBAL_DIGITS))
    offsets = (
        df.select(cell(draw(F.col(key), seed), GLOBAL_DIGITS).alias("_cell"))
        .groupBy("_cell")
        .agg(F.count("*").alias("_rows"))
        .withColumn("_before", F.sum("_rows").over(Window.orderBy("_cell")) - F.col("_rows"))
        .drop("_rows")
    )
    place = F.row_number().over(Window.partitionBy("_cell").orderBy("_draw", key))
    return (
        celled.withColumn("_place", place)
        .join(F.broadcast(offsets), "_cell")
        .withColumn(name, F.col("_before") + F.col("_place"))
        .select(*df.columns, name)
    )


def first_n_users(df: DataFrame, user: str, n: int = 5) -> DataFrame:
    """All rows of the first ``n`` users by name."""
    chosen = df.select(user).distinct().orderBy(user).limit(n)
    return df.join(chosen, user, "left_semi")


def min_posts_users(df: DataFrame, user: str, at_least: int = 2) -> DataFrame:
    """Users with at least ``at_least`` posts, and their post counts."""
    return df.groupBy(user).agg(F.count("*").alias("n")).where(F.col("n") >= at_least)


def capped_active_users(df: DataFrame, user: str, n: int = 30_000, at_least: int = 2) -> DataFrame:
    """All rows of the first ``n`` users by name among those with ``at_least`` posts."""
    chosen = min_posts_users(df, user, at_least).select(user).orderBy(user).limit(n)
    return df.join(chosen, user, "left_semi")
