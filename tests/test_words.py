import math
from collections import Counter

import pytest
from pyspark.sql import functions as F

from tidemark.operators import words as wd


def occurrences(spark, a, b):
    rows = [("a", w) for w in a] + [("b", w) for w in b]
    return spark.createDataFrame(rows, "class string, word string").repartition(4)


def test_shares_and_one_sided_words(spark):
    table = wd.word_metric(wd.word_shares(occurrences(spark, ["x", "x", "y", "z"], ["x", "y", "q", "q"])))
    got = {r.word: r for r in table.collect()}
    assert (got["x"].count_a, got["x"].share_a, got["x"].count_b, got["x"].share_b) == (2, 0.5, 1, 0.25)
    assert got["x"].ratio == 2.0 and got["x"].metric == pytest.approx(1 * 0.5 * 0.25)
    assert got["z"].ratio == math.inf and got["z"].metric is None
    assert got["q"].ratio == 0.0 and got["q"].metric is None
    assert got["q"].count_total == 2
    assert sum(r.share_a for r in got.values()) == sum(r.share_b for r in got.values()) == 1.0
    assert not any(math.isnan(v) for r in got.values() for v in r if isinstance(v, float))


def test_counts_from_the_table(spark):
    words = occurrences(spark, ["x", "x", "z"], ["x", "q"])
    direct = wd.word_counts(words)
    assert sorted(direct.collect()) == sorted(wd.counts_of(wd.word_shares(words)).collect())


def test_empty_class(spark):
    table = wd.word_shares(occurrences(spark, ["x"], [])).collect()
    assert [(r.share_a, r.share_b, r.ratio) for r in table] == [(1.0, 0.0, math.inf)]


def test_other_classes_do_not_count(spark):
    rows = [("a", "x"), ("b", "x"), ("c", "y")]
    assert [r.word for r in wd.word_shares(spark.createDataFrame(rows, "class string, word string")).collect()] == ["x"]


def shares_table(spark, rows):
    """Rows of (word, share_a, share_b)."""
    df = spark.createDataFrame(rows, "word string, share_a double, share_b double")
    ratio = F.when(F.col("share_b") == 0, float("inf")).otherwise(F.col("share_a") / F.col("share_b"))
    counts = [F.ceil(F.col(c) * 1e9).alias(f"count_{c[-1]}") for c in ("share_a", "share_b")]
    return df.select("*", *counts, ratio.alias("ratio")).withColumn("count_total", F.col("count_a") + F.col("count_b"))


def test_band_edges(spark):
    table = shares_table(spark, [("tenth", 0.1, 0.5), ("cent", 0.01, 0.5), ("floor", 1e-6, 0.5), ("rare", 0.2, 1e-6)])
    picked = wd.top_words_banded(table).where("rule = 'a_top'").collect()
    assert {r.word: r.band for r in picked} == {"tenth": 2, "cent": 3}


def test_band_four_has_no_top_in_the_first_pass(spark):
    table = shares_table(spark, [(f"w{i}", 5e-4, 1e-3 + i * 1e-5) for i in range(9)])
    rules = Counter((r.rule, r.band) for r in wd.top_words_banded(table).collect())
    assert rules == {("a_bottom", 4): 4, ("b_top", 4): 1, ("b_top", 3): 4}


def test_ties_go_by_word(spark):
    counts = wd.word_counts(occurrences(spark, list("dcba") * 2 + ["zz"], ["q"]))
    got = [(r.rank, r.word) for r in wd.top_words(counts, 3).where("class = 'a'").orderBy("rank").collect()]
    assert got == [(1, "a"), (2, "b"), (3, "c")]


def test_lists_are_merged_first_come(spark):
    table = wd.word_metric(wd.word_shares(occurrences(spark, ["x"] * 5 + ["y"] * 3 + ["z"], ["x", "y", "y", "z", "z"])))
    merged = {r.word: (r.rule, r.rank) for r in wd.top_words_all(table).collect()}
    assert merged == {"x": ("share_a", 1), "y": ("share_a", 2), "z": ("share_a", 3)}
    assert wd.top_words_absolute(table).count() == 9


def test_extents_and_histogram(spark):
    table = wd.word_shares(occurrences(spark, ["x"] * 6 + ["y"] * 4, ["x"] * 2 + ["z"] * 8))
    extents = wd.share_extents(table).first()
    assert (extents.max_a, extents.min_a, extents.max_b, extents.min_b) == (0.6, 0.4, 0.8, 0.2)
    assert extents.scale_max == pytest.approx(0.88) and extents.scale_min == pytest.approx(3.0)
    cells = {(r.bx, r.by): (r.n_words, r.n_total) for r in wd.share_histogram(table, 10).collect()}
    assert cells == {(2, 9): (1, 8), (0, 6): (1, 4), (9, 0): (1, 8)}


def test_result_does_not_depend_on_partitions(spark):
    words = occurrences(spark, [f"w{i % 37}" for i in range(900)] + ["hot"] * 900, [f"w{i % 23}" for i in range(900)])
    one, many = (wd.word_shares(words.repartition(n)).orderBy("word").collect() for n in (1, 17))
    assert one == many
