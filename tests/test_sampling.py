import hashlib
import math

import pytest
from pyspark.sql import functions as F

from tidemark.operators import sampling


def draw(key, seed=42):
    return hashlib.md5(f"{seed}:{key}".encode()).hexdigest(), key


def test_sample_n_is_the_head_of_the_draw_order(spark):
    names = [f"n{i}" for i in range(5000)]
    df = spark.createDataFrame([(n,) for n in names + names[:50]], "author string")
    want = sorted(sorted(names, key=draw)[:700])
    for layout in (df, df.repartition(13), df.coalesce(1)):
        assert sorted(r[0] for r in sampling.sample_n(layout, "author", 700).collect()) == want
    assert sampling.sample_n(df, "author", 5000).count() == 5000


def test_sample_n_fails_beyond_the_population(spark):
    df = spark.range(10).withColumnRenamed("id", "author")
    with pytest.raises(Exception, match="fewer"):
        sampling.sample_n(df, "author", 11).collect()


def test_fraction_rounds_half_to_even(spark):
    rows = [(f"f{size}", f"f{size}-{i}") for size in (5, 6, 15, 25) for i in range(size)]
    df = spark.createDataFrame(rows, "file string, id string").repartition(6)
    got = sampling.sample_fraction(df, "file", "id").groupBy("file").count().collect()
    assert dict(got) == {"f6": 1, "f15": 2, "f25": 2}


def test_fraction_with_a_hot_group(spark):
    rows = [("hot" if i % 3 else f"g{i % 40}", i) for i in range(9000)]
    df = spark.createDataFrame(rows, "file string, id long").repartition(9)
    groups = {}
    for file, i in rows:
        groups.setdefault(file, []).append(i)
    want = sorted(i for ids in groups.values() for i in sorted(ids, key=draw)[: round(0.1 * len(ids))])
    assert sorted(r.id for r in sampling.sample_fraction(df, "file", "id").collect()) == want


def test_exact_split(spark):
    for n in (1, 9, 10, 1003):
        split = sampling.exact_split(spark.range(n), "id")
        assert split.where("split = 'test'").count() == math.ceil(0.2 * n)


def test_hash_split_does_not_depend_on_layout(spark):
    df = spark.range(2000)
    one = sampling.hash_split(df.repartition(3), "id").orderBy("id").collect()
    assert one == sampling.hash_split(df.coalesce(1), "id").orderBy("id").collect()
    assert 0.15 < sum(r.split == "test" for r in one) / 2000 < 0.25


def test_draw_position(spark):
    placed = sampling.draw_position(spark.range(3000), "id").collect()
    assert {r.id: r.position for r in placed} == {k: i for i, k in enumerate(sorted(range(3000), key=draw), 1)}


def test_users(spark):
    df = spark.createDataFrame([(u, i) for u in "edcba" for i in range(ord(u) - 96)], "user string, i int")
    assert {r.user for r in sampling.first_n_users(df, "user", 2).collect()} == {"a", "b"}
    assert dict(sampling.min_posts_users(df, "user", 4).collect()) == {"d": 4, "e": 5}
    capped = sampling.capped_active_users(df, "user", 2, 2).groupBy("user").agg(F.count("*")).collect()
    assert dict(capped) == {"b": 2, "c": 3}


def test_fast_fraction(spark):
    assert 300 < sampling.sample_fraction_fast(spark.range(5000), 0.1).count() < 700
