import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from tidemark import sizes
from tidemark.operators import cohort
from tidemark.sizes import inline_table, lookup_join

POSTS = "author string, subreddit string, created_utc long, pos long"


def ids(df, *columns):
    return sorted(tuple(r) for r in df.select(*columns).collect())


def test_cut_by_time(spark):
    posts = spark.createDataFrame([("u", "x", t, t) for t in (1, 2)] + [("u", "L", 3, 3), ("u", "x", 4, 4), ("v", "x", 9, 9)], POSTS)
    assert ids(cohort.cut_by_time(posts, ["L"]), "author", "created_utc") == [("u", 1), ("u", 2), ("v", 9)]


def test_author_whose_first_post_is_listed_vanishes(spark):
    posts = spark.createDataFrame([("u", "L", 1, 0), ("u", "x", 2, 1)], POSTS)
    assert cohort.cut_by_time(posts, ["L"]).count() == 0


def test_modes_differ(spark):
    # X comes first in the file, Y is first in the list.
    posts = spark.createDataFrame([("u", "x", 9, 0), ("u", "X", 2, 1), ("u", "x", 3, 2), ("u", "Y", 4, 3)], POSTS)
    by_position = cohort.cut_by_position(posts, ["Y", "X"], "author")
    assert ids(by_position, "pos") == [(0,)]
    assert ids(cohort.cut_by_priority(posts, ["Y", "X"]), "pos") == [(0,), (1,), (2,)]
    assert ids(cohort.cut_by_time(posts, ["Y", "X"]), "pos") == []


def test_communities_as_table(spark):
    posts = spark.createDataFrame([("u", "x", 9, 0), ("u", "X", 2, 1), ("u", "x", 3, 2), ("u", "Y", 4, 3)], POSTS)
    table = inline_table(spark, ["community", "priority"], [("Y", 1), ("X", 2)])
    for cut in (cohort.cut_by_priority, cohort.cut_by_time):
        assert ids(cut(posts, table), "pos") == ids(cut(posts, ["Y", "X"]), "pos")


def random_posts(n=600, seed=1):
    rng = random.Random(seed)
    # One author holds a third of all posts.
    authors = ["hot"] * n + [f"u{i}" for i in range(60)] * (2 * n // 60)
    rng.shuffle(authors)
    times = rng.sample(range(10**7), len(authors))
    return [(a, rng.choice("abcdefgh"), t, i) for i, (a, t) in enumerate(zip(authors, times, strict=True))]


def test_cut_against_python(spark):
    rows = random_posts()
    first = defaultdict(lambda: float("inf"))
    for author, community, at, _ in rows:
        if community in "gh":
            first[author] = min(first[author], at)
    want = sorted((pos,) for author, _, at, pos in rows if at < first[author])
    posts = spark.createDataFrame(rows, POSTS).repartition(7)
    assert ids(cohort.cut_by_time(posts, ["g", "h"]), "pos") == want


@pytest.mark.parametrize("threshold", ["10485760", "-1"])
@pytest.mark.parametrize("rows", [0, 10**6])
def test_lookup_join_keeps_every_row_once(spark, monkeypatch, tmp_path, threshold, rows):
    monkeypatch.setattr(sizes, "BROADCAST_ROWS", rows)
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
    try:
        posts = spark.createDataFrame(random_posts(), POSTS)
        right = posts.where("author <> 'u1'").groupBy("author").agg(F.count("*").alias("n"))
        for folder in (None, str(tmp_path)):
            joined = lookup_join(posts, right, ["author"], folder=folder)
            assert joined.count() == posts.count()
            assert joined.where("n is null").select("author").distinct().collect() == [("u1",)]
            inner = lookup_join(posts, right, ["author"], "inner", folder=folder)
            assert inner.count() == posts.where("author <> 'u1'").count()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)


def test_companion(spark):
    authors = inline_table(spark, ["author"], [("u",), ("v",)])
    companions = inline_table(
        spark, ["author", "priority", "text"], [("u", 3, "c"), ("u", 2, "b"), ("u", 2, "bb"), ("w", 1, "x")]
    )
    assert ids(cohort.companion_first_match(authors, companions), "author", "priority", "text") == [("u", 2, "b"), ("u", 2, "bb")]
    posts = inline_table(spark, ["author", "text"], [("u", "p"), ("v", "q")])
    assert ids(cohort.with_companions(posts, companions), "author", "text") == [
        ("u", "b"), ("u", "bb"), ("u", "p"), ("v", "q"),
    ]


def text_rows():
    return [(a, t, f"w{p} {c}{p} ." if p % 7 else "", p) for a, c, t, p in random_posts(300, 2)] + [(None, 5, "lost", -1)]


def documents(rows):
    by_author = defaultdict(list)
    for author, at, text, pos in rows:
        if author is not None:
            by_author[author].append((at, pos, text))
    return {a: "<s> ".join(t for _, _, t in sorted(posts)) for a, posts in by_author.items()}


def test_author_text(spark):
    rows = text_rows()
    posts = spark.createDataFrame(rows, "author string, created_utc long, text string, pos long").repartition(5)
    for seconds in (1, 3_600, 10**9):
        slices = cohort.time_slice(F.col("created_utc"), seconds)
        got = dict(cohort.author_text(posts, ["created_utc", "pos"], slices).collect())
        assert got == documents(rows)


@pytest.mark.parametrize("n", [1, 5, 100, 100_000])
def test_author_tail(spark, n):
    rows = text_rows()
    posts = spark.createDataFrame(rows, "author string, created_utc long, text string, pos long").repartition(5)
    slices = cohort.time_slice(F.col("created_utc"), 50_000)
    got = dict(cohort.author_tail(posts, ["created_utc", "pos"], slices, n).collect())
    assert got == {a: " ".join(doc.split()[-n:]) for a, doc in documents(rows).items()}


def test_label_cohorts(spark):
    parts = {"a": spark.range(2), "b": spark.range(3).withColumn("x", F.lit(1))}
    both = cohort.label_cohorts(parts)
    assert ids(both.groupBy("class").count(), "class", "count") == [("a", 2), ("b", 3)]


@pytest.mark.parametrize("how", ["inner", "left"])
def test_frequent_keys_are_broadcast(spark, monkeypatch, tmp_path, how):
    """Of a right side that does not fit, the frequent keys' rows are not shuffled."""
    rows = [(f"w{k}" if k else None, copy) for k in range(40) for copy in range(100 if k < 6 else 2)]
    left = spark.createDataFrame(rows, "word string, copy int")
    right = left.where("word <> 'w7'").groupBy("word").agg(F.count("*").alias("often"))
    want = sorted(map(str, left.join(right, "word", how).select("word", "copy", "often").collect()))
    monkeypatch.setattr(sizes, "BROADCAST_ROWS", 8)
    found = lookup_join(left, right, ["word"], how, folder=str(tmp_path), often="often")
    assert sorted(map(str, found.collect())) == want
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = lookup_join(left, right, ["word"], how, folder=str(tmp_path), often="often")._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)
    # Frequent ones, what is left of them, and the others.
    assert plan.count("BroadcastHashJoin") == 2 and plan.count("SortMergeJoin") == 1 and "_salt" not in plan
