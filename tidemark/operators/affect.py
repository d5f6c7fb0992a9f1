"""Affects of posts from a word lexicon, and their shares per class."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.fixed_values import AFFECTS, EMOTIONS, MISSING_WHEN_ABSENT, POLARITIES


def affect_wide(posts: DataFrame, lexicon: DataFrame, keys: Sequence[str], words: str = "words") -> DataFrame:
    """One column per affect: its part of all affect hits of the post.

    ``posts`` holds the array ``words``; ``keys`` identify a post (further
    columns that are constant per post may be among them).  ``lexicon`` has the
    columns ``(word, affect)``; a word may carry several affects.  A post
    without any hit has all zeros, and a missing ``anticipation`` is NULL.

    The lexicon is first one row per word, so a word is matched once.  Posts equal in
    all keys and words are counted together and written out again as often.
    """
    keys = list(keys)
    table = lexicon.groupBy("word").agg(*(F.count_if(F.col("affect") == name).alias(name) for name in AFFECTS))
    # Made before the explode: after it, the whole array would be hashed once per word.
    named = posts.select(*keys, F.xxhash64(words).alias("_words"), F.col(words).alias("_list"))
    spelt = named.select(*keys, "_words", F.posexplode_outer("_list").alias("_at", "word"))
    hits = spelt.join(table, "word", "left")
    sums = [F.coalesce(F.sum(name), F.lit(0)).alias(name) for name in AFFECTS]
    copies = F.count_if(F.coalesce("_at", F.lit(0)) == 0).cast("int")
    counts = hits.groupBy(*keys, "_words").agg(*sums, copies.alias("_copies"))
    each = counts.withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("_copies"))))
    total = sum((F.col(name) for name in AFFECTS[1:]), F.col(AFFECTS[0]))
    return each.select(*keys, *(_part(name, total).alias(name) for name in AFFECTS))


def _part(name: str, total: Column) -> Column:
    absent = F.lit(None).cast("double") if name == MISSING_WHEN_ABSENT else F.lit(0.0)
    return F.when(F.col(name) == 0, absent).otherwise(F.try_divide(F.col(name), total))


def affect_per_post(wide: DataFrame, keys: Sequence[str]) -> DataFrame:
    """One row per post and affect."""
    return wide.unpivot(list(keys), AFFECTS, "affect", "freq")


def affect_scores(wide: DataFrame, affects: Sequence[str], label: str = "class") -> DataFrame:
    """Each affect's part of the sum over ``affects``, per class; missing values are skipped."""
    sums = wide.groupBy(label).agg(*(F.sum(name).alias(name) for name in affects))
    long = sums.unpivot([label], list(affects), "emotion", "_sum")
    # As many rows per class as there are affects.
    whole = F.sum("_sum").over(Window.partitionBy(label))
    return long.select("emotion", F.try_divide(F.col("_sum"), whole).alias("percentage"), label)


def emotion_scores(wide: DataFrame, label: str = "class") -> DataFrame:
    """Shares of the eight emotions per class."""
    return affect_scores(wide, EMOTIONS, label)


def polarity_scores(wide: DataFrame, label: str = "class") -> DataFrame:
    """Shares of positive and negative per class."""
    return affect_scores(wide, POLARITIES, label)
