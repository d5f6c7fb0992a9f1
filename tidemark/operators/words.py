"""Word shares of two classes and the words that set them apart.

Input is one row per word occurrence with a class column, or the word table that
:func:`word_shares` makes of it.  Equal values are always ordered by word.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.fixed_values import (
    ABSOLUTE_PICKS,
    BAND_PICKS,
    EXTENT_HIGH,
    EXTENT_LOW,
    HISTOGRAM_BINS,
    METRIC_PICKS,
    OTHER_SHARE_FLOOR,
    SHARE_BANDS,
    TOP_WORDS_PER_CLASS,
)


def word_counts(words: DataFrame, label: str = "class") -> DataFrame:
    """Occurrences of each word per class."""
    return words.groupBy(label, "word").agg(F.count("*").alias("n"))


def word_shares(words: DataFrame, classes: Sequence[str] = ("a", "b"), label: str = "class") -> DataFrame:
    """The word table: counts, shares, total and share ratio.

    Both classes are counted in one aggregate, which does the work of two counts
    and a full outer join.  The totals come from the same shuffled counts.
    """
    first, second = classes
    counts = (
        words.where(F.col(label).isin(list(classes)))
        .groupBy("word")
        .agg(
            F.count_if(F.col(label) == first).alias("count_a"),
            F.count_if(F.col(label) == second).alias("count_b"),
        )
    )
    totals = counts.agg(F.struct(F.sum("count_a").alias("a"), F.sum("count_b").alias("b")).alias("t")).scalar()
    shared = counts.withColumn("_t", totals).select(
        "word",
        "count_a",
        _over(F.col("count_a"), F.col("_t.a")).alias("share_a"),
        "count_b",
        _over(F.col("count_b"), F.col("_t.b")).alias("share_b"),
        (F.col("count_a") + F.col("count_b")).alias("count_total"),
    )
    ratio = F.when(F.col("count_b") == 0, F.lit(float("inf"))).otherwise(F.col("share_a") / F.col("share_b"))
    return shared.withColumn("ratio", ratio)


def counts_of(table: DataFrame, classes: Sequence[str] = ("a", "b"), label: str = "class") -> DataFrame:
    """The counts per class again, from the word table instead of the words."""
    rows = [F.struct(F.lit(name).alias(label), F.col(f"count_{c}").alias("n")) for name, c in zip(classes, "ab", strict=True)]
    return table.select("word", F.inline(F.array(*rows))).where(F.col("n") > 0).select(label, "word", "n")


def _over(count: Column, total: Column) -> Column:
    return F.coalesce(F.try_divide(count, total), F.lit(0.0))


def word_metric(table: DataFrame) -> DataFrame:
    """Add ``metric``: cubed log ratio times both shares; NULL for one-sided words."""
    both = (F.col("count_a") > 0) & (F.col("count_b") > 0)
    value = F.pow(F.abs(F.log2("ratio")), F.lit(3)) * F.col("share_a") * F.col("share_b")
    return table.withColumn("metric", F.when(both, value))


def share_extents(table: DataFrame) -> DataFrame:
    """Largest and smallest positive share of each class, and the scaled common axis."""
    found = table.agg(
        F.max("share_a").alias("max_a"),
        F.min(F.when(F.col("share_a") > 0, F.col("share_a"))).alias("min_a"),
        F.max("share_b").alias("max_b"),
        F.min(F.when(F.col("share_b") > 0, F.col("share_b"))).alias("min_b"),
    )
    return found.select(
        "*",
        (F.greatest("max_a", "max_b") * EXTENT_HIGH).alias("scale_max"),
        (F.least("min_a", "min_b") * EXTENT_LOW).alias("scale_min"),
    )


def share_histogram(table: DataFrame, bins: int = HISTOGRAM_BINS) -> DataFrame:
    """Words and occurrences per cell of a grid over (share_b, share_a)."""
    spans = table.agg(
        F.struct(
            F.min("share_a").alias("low_a"),
            F.max("share_a").alias("high_a"),
            F.min("share_b").alias("low_b"),
            F.max("share_b").alias("high_b"),
        ).alias("s")
    ).scalar()

    def place(share: str, low: str, high: str) -> Column:
        step = F.try_divide(F.col(share) - F.col(f"_s.{low}"), F.col(f"_s.{high}") - F.col(f"_s.{low}"))
        return F.least(F.floor(F.coalesce(step, F.lit(0.0)) * bins), F.lit(bins - 1)).cast("int")

    return (
        table.withColumn("_s", spans)
        .groupBy(place("share_b", "low_b", "high_b").alias("bx"), place("share_a", "low_a", "high_a").alias("by"))
        .agg(F.count("*").alias("n_words"), F.sum("count_total").alias("n_total"))
    )


def top_words(counts: DataFrame, k: int = TOP_WORDS_PER_CLASS, label: str = "class") -> DataFrame:
    """The ``k`` most frequent words of each class."""
    order = Window.partitionBy(label).orderBy(F.col("n").desc(), "word")
    return counts.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def _choice(rule: str, place: Column, band: Column, k: Column, score: Column) -> Column:
    return F.struct(
        place.alias("place"),
        F.lit(rule).alias("rule"),
        band.alias("band"),
        k.alias("k"),
        score.cast("double").alias("score"),
    )


def _plain(rule: str, place: int, k: int, score: Column) -> Column:
    return _choice(rule, F.lit(place), F.lit(0), F.lit(k), score)


def _absolute_choices() -> list[Column]:
    by = {"share_a": F.col("share_a"), "share_b": F.col("share_b"), "total": F.col("count_total")}
    return [_plain(rule, i, ABSOLUTE_PICKS, value) for i, (rule, value) in enumerate(by.items(), start=1)]


def _by_band(value: dict[int, int], share: Column) -> Column:
    """``value`` of the band a share lies in, NULL outside all bands."""
    found = F.lit(None).cast("int")
    for band, (low, high) in SHARE_BANDS.items():
        found = F.when((share > low) & (share <= high), value[band]).otherwise(found)
    return found


def _banded_choices() -> list[Column]:
    choices = []
    for at, (rule, picks) in enumerate(BAND_PICKS.items()):
        own, other = ("share_a", "share_b") if rule.startswith("a") else ("share_b", "share_a")
        score = F.col("ratio") if rule.endswith("top") else -F.col("ratio")
        band = _by_band({b: b for b in SHARE_BANDS}, F.col(own))
        k = _by_band(picks, F.col(own))
        # First pass before second; within a pass band by band, top before bottom.
        place = 2 * band + F.lit(100 * (1 + at // 2) + at % 2)
        if any(picks.values()):
            choices.append(F.when((k > 0) & (F.col(other) > OTHER_SHARE_FLOOR), _choice(rule, place, band, k, score)))
    return choices


def _metric_choices() -> list[Column]:
    metric = F.col("metric")
    return [F.when(metric.isNotNull(), _plain("metric", 900, METRIC_PICKS, metric))]


def _pick(table: DataFrame, choices: list[Column]) -> DataFrame:
    """Rank each word in every list it qualifies for and keep the list heads.

    One pass over the table serves all lists: the fixed rank limit drops all but
    the head of each list on the map side, before anything is shuffled.
    """
    most = max(ABSOLUTE_PICKS, METRIC_PICKS, *(k for picks in BAND_PICKS.values() for k in picks.values()))
    listed = table.select("word", F.explode(F.array(*choices)).alias("_c")).where(F.col("_c").isNotNull())
    listed = listed.select("word", "_c.*")
    order = Window.partitionBy("place").orderBy(F.col("score").desc(), "word")
    ranked = listed.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= most)
    return ranked.where(F.col("rank") <= F.col("k")).drop("k")


def top_words_absolute(table: DataFrame) -> DataFrame:
    """The top words by share in a, by share in b and by total count."""
    return _pick(table, _absolute_choices())


def top_words_banded(table: DataFrame) -> DataFrame:
    """Most and least one-sided words per band of share."""
    return _pick(table, _banded_choices())


def top_words_metric(table: DataFrame) -> DataFrame:
    """The top words by :func:`word_metric`."""
    return _pick(table, _metric_choices())


def top_words_all(table: DataFrame) -> DataFrame:
    """All the above lists in one, each word where it came first."""
    picked = _pick(table, _absolute_choices() + _banded_choices() + _metric_choices())
    return first_listed(picked)


def first_listed(picked: DataFrame) -> DataFrame:
    """One row per word: its first list and its rank there."""
    first = F.min(F.struct("place", "rank", "rule", "band", "score")).alias("_f")
    return picked.groupBy("word").agg(first).select("word", "_f.*")
