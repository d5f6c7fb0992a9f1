import itertools
import math
import random
import time
from fractions import Fraction

import pytest
from pyspark.sql import functions as F

from tidemark import sizes
from tidemark.functions.fixed_values import AFFECTS
from tidemark.operators import affect, ranksum, tfidf
from tidemark.sizes import inline_table

LEXICON = [("good", "joy"), ("good", "positive"), ("bad", "negative"), ("soon", "anticipation")]


def wide(spark, rows):
    posts = spark.createDataFrame(rows, "id int, class string, words array<string>")
    return affect.affect_wide(posts, inline_table(spark, ["word", "affect"], LEXICON), ["id", "class"])


def test_affects_of_a_post(spark):
    rows = [(1, "a", ["good", "good", "bad", "day"]), (2, "a", ["day"]), (3, "b", []), (4, "b", ["soon", "bad"])]
    got = {r.id: r for r in wide(spark, rows).collect()}
    assert (got[1].joy, got[1].positive, got[1].negative, got[1].fear) == (0.4, 0.4, 0.2, 0.0)
    assert got[1].anticipation is None
    for k in (2, 3):
        assert got[k].anticipation is None and all(got[k][name] == 0.0 for name in AFFECTS if name != "anticipation")
    assert (got[4].anticipation, got[4].negative) == (0.5, 0.5)


def test_equal_posts_both_count(spark):
    rows = [(1, "a", ["good", "bad"])] * 2 + [(1, "a", ["good"]), (2, "a", []), (2, "a", [])]
    got = sorted((r.id, r.joy, r.negative) for r in wide(spark, rows).collect())
    assert got == [(1, pytest.approx(1 / 3), pytest.approx(1 / 3))] * 2 + [(1, 0.5, 0.0), (2, 0.0, 0.0), (2, 0.0, 0.0)]


def test_features_on_other_scales_have_even_ranges(spark):
    """Each of two features, on scales a million apart, is spread over many ranges."""
    rows = spark.range(20_000).selectExpr(
        "if(id % 2 = 0, 'small', 'large') AS feature", "id * if(id % 2 = 0, 1e-6, 1.0) AS value", "id % 3 = 0 AS first"
    )
    ordered = rows.repartitionByRange("feature", "value").withColumn("range", F.spark_partition_id())
    # Ranges as small as these would be merged.
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        sizes = [r["count"] for r in ordered.groupBy("feature", "range").count().collect()]
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    assert len(sizes) >= 8 and max(sizes) < 3 * 20_000 / 8
    got = ranksum.rank_sums(rows, "value", F.col("first"), "feature").collect()
    assert {(r.feature, r.n1 + r.n2) for r in got} == {("small", 10_000), ("large", 10_000)}


def test_scores_are_normalised_per_group(spark):
    table = wide(spark, [(1, "a", ["good", "good", "bad"]), (2, "a", ["soon"]), (3, "b", ["bad"])])
    emotions = {(r["class"], r.emotion): r.percentage for r in affect.emotion_scores(table).collect()}
    assert emotions["a", "anticipation"] == pytest.approx(1 / 1.4)
    assert sum(v for (k, _), v in emotions.items() if k == "a") == pytest.approx(1)
    assert emotions["b", "joy"] is None  # nothing to share out
    polarity = {(r["class"], r.emotion): r.percentage for r in affect.polarity_scores(table).collect()}
    assert polarity["a", "positive"] == pytest.approx(2 / 3) and polarity["b", "negative"] == 1.0


def values(spark, a, b):
    rows = [("f", float(v), True) for v in a] + [("f", float(v), False) for v in b]
    return spark.createDataFrame(rows, "feature string, value double, first boolean").repartition(5)


def u_by_pairs(a, b):
    return float(sum(Fraction(1) if x > y else Fraction(1, 2) if x == y else 0 for x in a for y in b))


def test_small_rank_sum(spark):
    got = ranksum.mann_whitney(values(spark, [1, 2, 2], [2, 3]), "feature", "value", F.col("first")).first()
    assert (got.n1, got.n2, got.u) == (3, 2, 1.0)


@pytest.mark.parametrize("ranges", [1, 2, 7, 64])
@pytest.mark.parametrize("seed", range(2))
def test_u_against_all_pairs(spark, ranges, seed):
    old = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", str(ranges))
    rng = random.Random(seed)
    a = [rng.choice([0, 0, 0, rng.randint(-9, 9), rng.random()]) for _ in range(130)]
    b = [rng.choice([0, rng.randint(-9, 9), rng.gauss(0, 3)]) for _ in range(170)]
    sums = ranksum.rank_sums(values(spark, a, b), "value", F.col("first"), "feature").first()
    spark.conf.set("spark.sql.shuffle.partitions", old)
    u = (int(sums.twice_r1) - sums.n1 * (sums.n1 + 1)) / 2
    assert u == u_by_pairs(a, b)
    counts = [(a + b).count(v) for v in set(a + b)]
    assert int(sums.ties) == sum(c**3 - c for c in counts)


def test_z_and_p(spark):
    rng = random.Random(3)
    a, b = [rng.randint(0, 5) for _ in range(60)], [rng.randint(1, 6) for _ in range(50)]
    df = values(spark, a, b)
    got = ranksum.with_p_value(ranksum.mann_whitney(df, "feature", "value", F.col("first"))).first()
    other = ranksum.mann_whitney(df, "feature", "value", ~F.col("first")).first()
    assert got.u + other.u == 60 * 50 and got.z == pytest.approx(other.z)
    n = 110
    ties = sum((a + b).count(v) ** 3 - (a + b).count(v) for v in range(7))
    sigma = math.sqrt(60 * 50 / 12 * (n + 1 - ties / (n * (n - 1))))
    u = u_by_pairs(a, b)
    z = (max(u, 3000 - u) - 1500 - 0.5) / sigma
    assert got.z == pytest.approx(z) and got.p == pytest.approx(math.erfc(z / math.sqrt(2)))


def exact_by_choices(a, b):
    """Two-sided p from all ways to choose the first group's ranks."""
    n1, n2 = len(a), len(b)
    u = u_by_pairs(a, b)
    far = min(u, n1 * n2 - u)
    sums = [sum(chosen) - n1 * (n1 - 1) / 2 for chosen in itertools.combinations(range(n1 + n2), n1)]
    return min(1.0, 2 * sum(s <= far for s in sums) / len(sums))


@pytest.mark.parametrize("sizes", [(1, 1), (1, 9), (3, 4), (8, 2), (7, 8), (4, 16)])
def test_exact_p_against_all_choices(spark, sizes):
    rng = random.Random(sum(sizes))
    drawn = rng.sample(range(1000), sum(sizes))
    a, b = drawn[: sizes[0]], drawn[sizes[0] :]
    got = ranksum.with_p_value(ranksum.mann_whitney(values(spark, a, b), "feature", "value", F.col("first"))).first()
    assert got.exact and got.p == pytest.approx(exact_by_choices(a, b), rel=1e-12)


def test_when_p_is_exact(spark):
    """Ties, large groups and long tails take the normal approximation; many values do not."""
    tied = ranksum.mann_whitney(values(spark, [1, 2], [2, 3]), "feature", "value", F.col("first"))
    assert not ranksum.with_p_value(tied).first().exact
    large = ranksum.mann_whitney(values(spark, range(9), range(9, 40)), "feature", "value", F.col("first"))
    assert not ranksum.with_p_value(large).first().exact
    assert ranksum.with_p_value(large, exact_group=9).first().p == pytest.approx(2 / math.comb(40, 9))
    a, b = range(0, 1600, 200), [k for k in range(2000) if k % 200]
    middle = ranksum.mann_whitney(values(spark, a, b), "feature", "value", F.col("first"))
    assert not ranksum.with_p_value(middle, exact_sums=100).first().exact
    got = ranksum.with_p_value(middle, exact_sums=10_000).first()
    assert got.exact and got.p == pytest.approx(math.erfc(got.z / math.sqrt(2)), rel=0.05)
    none = ranksum.mann_whitney(values(spark, [1.0], []), "feature", "value", F.col("first"))
    assert ranksum.with_p_value(none).first().p is None


def test_a_post_of_many_words(spark):
    """The row is hashed once, not once per word: ten times the words take about ten times as long."""
    words = "array_repeat('good', {0}) || array_repeat('bad', {0}) || array_repeat('day', {0})"
    seconds = []
    for count in (10_000, 100_000):
        posts = spark.range(1).selectExpr("cast(id as int) id", "'a' class", f"{words.format(count)} as words")
        table = affect.affect_wide(posts, inline_table(spark, ["word", "affect"], LEXICON), ["id", "class"])
        start = time.perf_counter()
        got = table.first()
        seconds.append(time.perf_counter() - start)
        assert got.negative == pytest.approx(1 / 3)
    assert seconds[1] < 10 * seconds[0] + 5


def test_missing_values_and_empty_groups(spark):
    rows = [("f", 1.0, True), ("f", None, False), ("g", 2.0, False), ("g", 2.0, True)]
    df = spark.createDataFrame(rows, "feature string, value double, first boolean")
    got = {r.feature: (r.n1, r.n2, r.u, r.z) for r in ranksum.mann_whitney(df, "feature", "value", F.col("first")).collect()}
    assert got == {"f": (1, 0, 0.0, None), "g": (1, 1, 0.5, None)}


def test_auc(spark):
    rng = random.Random(5)
    rows = [(int(rng.random() < 0.4), round(rng.random(), 1)) for _ in range(300)]
    df = spark.createDataFrame(rows, "label int, score double")
    got = ranksum.roc_auc(df, "label", "score").first()
    ones, zeros = [s for k, s in rows if k], [s for k, s in rows if not k]
    assert got.roc_auc == pytest.approx(u_by_pairs(ones, zeros) / (len(ones) * len(zeros)))
    turned = ranksum.roc_auc(df.withColumn("score", -F.col("score")), "label", "score").first()
    assert got.roc_auc + turned.roc_auc == pytest.approx(1)


def test_tfidf(spark):
    docs = {("a", 1): ["x", "x", "y"], ("a", 2): ["y"], ("a", 3): [], ("b", 4): ["x"]}
    df = spark.createDataFrame([(c, i, w) for (c, i), w in docs.items()], "class string, id int, words array<string>")
    weights = tfidf.tfidf_weights(tfidf.word_tallies(df, "id"), "id")
    norms = weights.groupBy("class", "id").agg(F.sum(F.col("weight") ** 2).alias("n")).collect()
    assert [r.n for r in norms] == pytest.approx([1.0] * 3)
    x, y = math.log(3 / 2) + 1, math.log(3 / 3) + 1
    length = math.hypot(2 * x, y)
    got = {(r["class"], r.word): r.tfidf for r in tfidf.tfidf_average(weights).collect()}
    assert got == pytest.approx({("a", "x"): 2 * x / length / 2, ("a", "y"): (y / length + 1) / 2, ("b", "x"): 1.0})


def test_tfidf_top_terms(spark):
    rows = [("a", f"w{i}", i / 10) for i in range(5)] + [("b", f"w{i}", (5 - i) / 10) for i in range(5)]
    top = tfidf.tfidf_top_terms(spark.createDataFrame(rows, "class string, word string, tfidf double"), 1)
    assert sorted((r["class"], r.word) for r in top.collect()) == [("a", "w0"), ("a", "w4"), ("b", "w0"), ("b", "w4")]


@pytest.mark.parametrize("rows", [0, 4, 10**6])
def test_tfidf_of_many_words(spark, monkeypatch, tmp_path, rows):
    """More words than can be broadcast: tallies of frequent ones stay, the others are shuffled once, without copies."""
    docs = [("ab"[k % 2], k, [f"w{j}" for j in range(1, 30) if k % j == 0]) for k in range(1, 40)]
    tallies = tfidf.word_tallies(spark.createDataFrame(docs, "class string, id int, words array<string>"), "id")
    want = {(r["class"], r.word): r.tfidf for r in tfidf.tfidf_average(tfidf.tfidf_weights(tallies, "id")).collect()}
    monkeypatch.setattr(sizes, "BROADCAST_ROWS", rows)
    weights = tfidf.tfidf_weights(tallies, "id", folder=str(tmp_path))
    assert {(r["class"], r.word): r.tfidf for r in tfidf.tfidf_average(weights).collect()} == pytest.approx(want)
    monkeypatch.setattr(tfidf, "lookup_join", lambda *a, **k: seen.append(k.get("often")) or sizes.lookup_join(*a, **k))
    seen = []
    tfidf.tfidf_weights(tallies, "id", folder=str(tmp_path))
    assert seen == ["df", None]
