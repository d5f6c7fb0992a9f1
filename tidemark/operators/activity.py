"""Who posts, and since when."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.fixed_values import PLACEHOLDER_AUTHOR


def distinct_authors(
    posts: DataFrame, author: str = "author", exclude=PLACEHOLDER_AUTHOR, distinct: bool = True
) -> DataFrame:
    """Author names with a value, without the placeholder unless ``exclude`` is None."""
    named = posts.select(author).where(F.col(author).isNotNull())
    if exclude is not None:
        named = named.where(F.col(author) != F.lit(exclude))
    return named.distinct() if distinct else named


def author_summary(posts: DataFrame, author: str = "author", file: str = "file") -> DataFrame:
    """Number of posts, of files and of different authors."""
    return posts.agg(
        F.count("*").alias("n_posts"),
        F.countDistinct(file).alias("n_files"),
        F.countDistinct(author).alias("n_authors"),
    )


def author_summary_fast(posts: DataFrame, author: str = "author", file: str = "file") -> DataFrame:
    """:func:`author_summary` with sketched author and file counts (one small shuffle)."""
    return posts.agg(
        F.count("*").alias("n_posts"),
        F.approx_count_distinct(file).alias("n_files"),
        F.approx_count_distinct(author).alias("n_authors"),
    )


def first_seen(posts: DataFrame, user: str = "uid", at: str = "date", name: str = "first") -> DataFrame:
    """Time of each user's first post."""
    return posts.where(F.col(user).isNotNull()).groupBy(user).agg(F.min(at).alias(name))


def new_users(posts: DataFrame, user: str = "uid", at: str = "date", grain: str | None = "day") -> DataFrame:
    """Users per first-post time, in time order; ``grain=None`` keeps the exact time."""
    firsts = first_seen(posts, user, at)
    if grain is not None:
        kind = firsts.schema["first"].dataType
        firsts = firsts.withColumn("first", F.date_trunc(grain, "first").cast(kind))
    return firsts.where(F.col("first").isNotNull()).groupBy("first").agg(F.count("*").alias("n")).orderBy("first")


def event_window(posts: DataFrame, event: Column, days: int = 60, at: str = "date") -> DataFrame:
    """Posts at most ``days`` days before or after an event."""
    reach = F.make_dt_interval(F.lit(days))
    return posts.where(F.col(at).between(event - reach, event + reach))
