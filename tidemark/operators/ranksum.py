"""Rank sums over any number of rows: Mann-Whitney U and ROC AUC.

Average ranks need a running count over the sorted values.  Values are first
collapsed to counts, then cut into ranges of about equal size; each range is
ranked by itself and only one row per range is needed to put them in line.
"""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BIG = "decimal(38,0)"

#: Without ties, and with a smaller group of at most so many values, p is exact.
EXACT_GROUP = 8
#: Longest list of rank sums that is counted for an exact p; beyond it, the normal approximation is used.
EXACT_SUMS = 5_000


def rank_sums(df: DataFrame, value: str, first: Column, feature: str | None = None) -> DataFrame:
    """Per feature: group sizes, doubled rank sum of the first group, tie term.

    Rows with a NULL value are left out.  ``first`` tells the first group from
    the second.  Ranks are doubled so that average ranks stay whole numbers.
    """
    rows = df.select(
        (F.col(feature) if feature else F.lit("all")).alias("feature"),
        F.col(value).alias("value"),
        first.alias("_first"),
    ).where(F.col("value").isNotNull())
    counts = rows.groupBy("feature", "value").agg(
        F.count_if("_first").alias("c1"), F.count_if(~F.col("_first")).alias("c2")
    )
    # Equal parts of all counts in order of feature and value, so each feature has
    # ranges on its own scale, and there are as many as shuffle partitions.  Any
    # borders give the right result.
    ordered = counts.repartitionByRange("feature", "value")
    ranged = ordered.select(
        "feature", "value", "c1", (F.col("c1") + F.col("c2")).alias("c"), F.spark_partition_id().alias("_range")
    )
    inside = Window.partitionBy("feature", "_range").orderBy("value").rowsBetween(Window.unboundedPreceding, -1)
    c, c1 = F.col("c").cast(BIG), F.col("c1").cast(BIG)
    in_range = (
        ranged.withColumn("_before", F.coalesce(F.sum("c").over(inside), F.lit(0)))
        .groupBy("feature", "_range")
        .agg(
            F.sum("c1").alias("n1"),
            F.sum("c").alias("n"),
            F.sum((c1 * (2 * F.col("_before") + F.col("c") + 1)).cast(BIG)).cast(BIG).alias("r1"),
            F.sum((c * c * c - c).cast(BIG)).cast(BIG).alias("ties"),
        )
    )
    # At most one row per feature and shuffle partition from here on.
    across = Window.partitionBy("feature").orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    offset = F.coalesce(F.sum("n").over(across), F.lit(0))
    return (
        in_range.withColumn("_offset", offset)
        .groupBy("feature")
        .agg(
            F.sum("n1").alias("n1"),
            (F.sum("n") - F.sum("n1")).alias("n2"),
            F.sum((F.col("r1") + 2 * F.col("_offset") * F.col("n1").cast(BIG)).cast(BIG)).alias("twice_r1"),
            F.sum("ties").alias("ties"),
        )
    )


def _statistic() -> Column:
    n1 = F.col("n1").cast(BIG)
    return (F.col("twice_r1") - n1 * (F.col("n1") + 1)).cast("double") / 2


def mann_whitney(df: DataFrame, feature: str, value: str, first: Column) -> DataFrame:
    """U of the first group, the tie- and continuity-corrected z, and whether values are ``tied``, per feature."""
    n1, n2 = F.col("n1").cast("double"), F.col("n2").cast("double")
    n = n1 + n2
    tied = F.try_divide(F.col("ties").cast("double"), n * (n - 1))
    spread = F.sqrt(n1 * n2 / 12 * ((n + 1) - tied))
    u = F.col("u")
    z = F.try_divide(F.greatest(u, n1 * n2 - u) - n1 * n2 / 2 - 0.5, spread)
    return (
        rank_sums(df, value, first, feature)
        .withColumn("u", _statistic())
        .select("feature", "n1", "n2", "u", z.alias("z"), (F.col("ties") > 0).alias("tied"))
    )


def _counts_by_sum(small: Column, large: Column, longest: Column) -> Column:
    """How many ways there are to place the smaller group for each U from 0 to ``longest``.

    The numbers are the coefficients of the product over i of
    (1 - q^(large + i)) / (1 - q^i): for each value of the smaller group the array
    is multiplied once and divided once, from the left to the right.
    """
    none = F.array().cast(f"array<{BIG}>")
    start = F.transform(F.sequence(F.lit(0), longest), lambda k: F.when(k == 0, 1).otherwise(0).cast(BIG))

    def one_more(counts: Column, i: Column) -> Column:
        step = large + i
        multiplied = F.transform(
            counts, lambda c, k: (c - F.when(k >= step, F.get(counts, (k - step).cast("int"))).otherwise(F.lit(0))).cast(BIG)
        )
        return F.aggregate(
            multiplied,
            none,
            lambda done, c: F.concat(
                done, F.array((c + F.coalesce(F.get(done, (F.size(done) - i).cast("int")), F.lit(0))).cast(BIG))
            ),
        )

    return F.aggregate(F.sequence(F.lit(1), small), start.cast(f"array<{BIG}>"), one_more)


def exact_p(n1: Column, n2: Column, u: Column) -> Column:
    """Two-sided p of U without ties: the share of all placements that are as far out.

    The distribution is symmetric, so only the sums up to the shorter tail are
    counted, in whole numbers; they are exact up to 38 digits.
    """
    small, large = F.least(n1, n2).cast("int"), F.greatest(n1, n2).cast("int")
    far = F.least(u, n1.cast("double") * n2 - u).cast("int")
    tail = F.aggregate(_counts_by_sum(small, large, far), F.lit(0).cast("double"), lambda total, c: total + c.cast("double"))
    ways = F.aggregate(F.sequence(F.lit(1), small), F.lit(1.0), lambda total, i: total * (large + i) / i)
    return F.least(2 * tail / ways, F.lit(1.0))


def with_p_value(tested: DataFrame, exact_group: int = EXACT_GROUP, exact_sums: int = EXACT_SUMS) -> DataFrame:
    """Add the two-sided ``p``, and whether it is ``exact``.

    It is where no values are tied, the smaller group has at most ``exact_group`` values
    and the tail at most ``exact_sums`` rank sums.  Otherwise p is that of ``z``; one
    row per feature, hence the Python function.
    """

    @F.pandas_udf("double")
    def two_sided(z: pd.Series) -> pd.Series:
        return z.map(lambda at: min(1.0, math.erfc(at / math.sqrt(2))), na_action="ignore")

    n1, n2, u = F.col("n1"), F.col("n2"), F.col("u")
    shorter = F.least(u, n1.cast("double") * n2 - u)
    exact = ~F.col("tied") & (F.least(n1, n2) >= 1) & (F.least(n1, n2) <= exact_group) & (shorter < exact_sums)
    # The other arm of a condition that calls Python would be computed for all rows.
    marked = tested.withColumn("exact", F.coalesce(exact, F.lit(False))).withColumn("_normal", two_sided("z"))
    return marked.withColumn("p", F.when(F.col("exact"), exact_p(n1, n2, u)).otherwise(F.col("_normal"))).drop("_normal")


def roc_auc(df: DataFrame, label: str, score: str) -> DataFrame:
    """Area under the ROC curve of ``score`` for label 1, with tied scores averaged."""
    sums = rank_sums(df.where(F.col(label).isNotNull()), score, F.col(label) == 1)
    pairs = F.col("n1").cast("double") * F.col("n2").cast("double")
    return sums.select("n1", "n2", F.try_divide(_statistic(), pairs).alias("roc_auc"))
