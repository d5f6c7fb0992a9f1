import random

import pytest
from pyspark.sql import functions as F

from tidemark import session
from tidemark.functions.text import lemmas_by_rules
from tidemark.operators import cohort
from tidemark.operators.network import Plan
from tidemark.plans import jobs
from tidemark.sizes import inline_table

POST = "id long, author string, subreddit string, created_utc long, body string, selftext string, title string"


def make(spark, prefix, words, n=240):
    rng = random.Random(prefix)
    rows = []
    for i in range(n):
        text = " ".join(rng.choices(words, k=12))
        community = "Bad" if rng.random() < 0.03 else "fine"
        comment = i % 3
        author = f"{prefix}{0 if i % 3 == 0 else i % 17}"
        rows.append((i, author, community, 1000 + i * 50, text if comment else None, None if comment else text, None if comment else "t"))
    return spark.createDataFrame(rows, POST)


@pytest.fixture(scope="module")
def cohorts(spark):
    common = [f"word{i}" for i in range(30)]
    return make(spark, "a", common + ["angry"] * 9), make(spark, "b", common + ["happy"] * 9)


def test_acquire(spark, cohorts, tmp_path):
    chosen, posts = jobs.acquire_authors(cohorts[1], str(tmp_path), 5)
    assert chosen.count() == 5
    assert {r.author for r in posts.select("author").collect()} == {r.author for r in chosen.collect()}


def test_two_runs_in_one_folder(spark, cohorts, tmp_path):
    for n in (3, 5, 3):
        assert jobs.acquire_authors(cohorts[1], str(tmp_path), n)[0].count() == n
    other = cohorts[1].where("author <> 'b0'")
    found = jobs.acquire_authors(other, str(tmp_path), other.select("author").distinct().count(), tag="other")[0]
    assert "b0" not in {r.author for r in found.collect()}


def test_acquire_cohort(spark, tmp_path):
    comments = spark.createDataFrame(
        [(f"u{i % 20}", f"c{i % 2}", f"c{i % 2}/u{i % 20}", f"comment {i}") for i in range(200)],
        "author string, community string, file string, body string",
    )
    submissions = spark.createDataFrame(
        [("u1", "c1", "late"), ("u1", "c0", "early"), ("u2", "c1", "only"), ("zz", "c0", "no")],
        "author string, community string, selftext string",
    )
    order = inline_table(spark, ["community", "priority"], [("c0", 1), ("c1", 2)])
    got = jobs.acquire_cohort(comments, submissions, order, str(tmp_path), 20)
    assert sorted(r.selftext for r in got.where("selftext is not null").collect()) == ["early", "only"]
    assert got.where("body is not null").count() == 200
    few = jobs.acquire_cohort(comments, submissions, order, str(tmp_path / "few"), 7)
    assert few.where("body is not null").select("file").distinct().count() == 7


def test_new_user_curve(spark):
    rows = [("u", "2017-08-11 01:00:00"), ("u", "2017-06-01 00:00:00"), ("v", "2017-08-11 23:00:00"), ("w", "2017-08-13 00:00:00")]
    posts = spark.createDataFrame(rows, "uid string, date string").withColumn("date", F.to_timestamp("date"))
    curve = jobs.new_user_curve(posts, F.to_timestamp(F.lit("2017-08-12")), 60).collect()
    assert [(str(r.first)[:10], r.n) for r in curve] == [("2017-08-11", 2), ("2017-08-13", 1)]


def test_sampled_tokens(spark, cohorts):
    filed = [df.withColumn("file", F.col("author")) for df in cohorts]
    got = jobs.tokenised_posts(*filed, ["Bad"], "id", [], cohort.cut_by_time, 0.1)
    sizes = [round(0.1 * r["count"]) for df in filed for r in df.groupBy("file").count().collect()]
    assert 0 < got.count() <= sum(sizes)
    assert got.where("class = 'b'").count() == sum(
        round(0.1 * r["count"]) for r in filed[1].groupBy("file").count().collect()
    )


def test_compare(spark, cohorts, tmp_path):
    lexicon = inline_table(spark, ["word", "affect"], [("angry", "anger"), ("happy", "joy"), ("word1", "anticipation")])
    tokens = jobs.tokenised_posts(*cohorts, ["Bad"], "id", ["word0"])
    made = jobs.compare_cohorts(tokens, lexicon, str(tmp_path), "id")
    table = {r.word: r for r in made["word_table"].collect()}
    assert "word0" not in table and table["happy"].count_a == 0 and table["angry"].count_b == 0
    assert made["top_words"].where("rank = 1").orderBy("class").select("word").collect() == [("angry",), ("happy",)]
    assert {r.word for r in made["selected_words"].collect()} >= {"angry", "happy"}
    assert made["emotions"].count() == 16 and made["polarities"].count() == 4
    tests = {r.feature: r for r in made["rank_tests"].collect()}
    assert tests["joy"].p < 1e-6 and tests["joy"].u == 0.0 or tests["joy"].u < tests["joy"].n1 * tests["joy"].n2 / 2
    assert made["tfidf_terms"].count() > 0 and made["extents"].count() == 1 and made["histogram"].count() > 0


def test_lemmas_in_the_comparison(spark, cohorts, tmp_path):
    lemmas = inline_table(spark, ["surface", "lemma"], [("angry", "anger"), ("happy", "joyful"), ("word0", "word1")])
    tokens = jobs.tokenised_posts(*cohorts, ["Bad"], "id", ["word5"], lemmas=lemmas, folder=str(tmp_path))
    plain = jobs.tokenised_posts(*cohorts, ["Bad"], "id", ["word5"])
    names = {"angry": "anger", "happy": "joyful", "word0": "word1"}
    want = {(r.id, r["class"]): [names.get(w, w) for w in r.words] for r in plain.collect()}
    assert {(r.id, r["class"]): r.words for r in tokens.collect()} == want
    made = jobs.compare_cohorts(tokens, inline_table(spark, ["word", "affect"], [("anger", "anger")]), str(tmp_path), "id")
    words = {r.word for r in made["word_table"].collect()}
    assert {"anger", "joyful"} <= words and not words & {"angry", "happy", "word0", "word5"}


def test_placeholder_author_and_user_cap(spark, cohorts):
    hot = cohorts[1].withColumn("author", F.when(F.col("id") % 3 == 0, "[deleted]").otherwise(F.col("author")))
    named = {r.author for r in jobs.author_documents(hot, None, "id").collect()}
    assert named and "[deleted]" not in named
    few = jobs.embed_cohorts(cohorts[0], hot, ["Bad"], "id", users=4, at_least=2)
    found = [(r.author, r.label) for r in few.select("author", "label").collect()]
    assert sum(label == 0 for _, label in found) == 4 and all(author != "[deleted]" for author, _ in found)


def test_documents_embed_classify(spark, cohorts, tmp_path):
    whole = {r.author: r.text for r in jobs.author_documents(cohorts[0], ["Bad"], "id", None).collect()}
    tail = {r.author: r.text for r in jobs.author_documents(cohorts[0], ["Bad"], "id", 30).collect()}
    assert tail == {a: " ".join(t.split()[-30:]) for a, t in whole.items()}
    dataset = jobs.embed_cohorts(*cohorts, ["Bad"], "id").cache()
    assert dataset.columns == ["author", "embedding", "label"]
    assert {r.label for r in dataset.collect()} == {0, 1}
    scored, report = jobs.classify(spark, dataset, str(tmp_path), 768, hidden=[8], epochs=20)
    total = dataset.count()
    assert scored.count() == -(-total // 5)
    assert report.columns == ["accuracy", "f1", "roc_auc"] and report.count() == 1


def test_network_in_place_of_the_classifier(spark, cohorts, tmp_path):
    dataset = jobs.embed_cohorts(*cohorts, ["Bad"], "id").cache()
    plan = Plan(768, (16, 8), dropout=0.1, rate=0.02, batch=32)
    scored, report, history = jobs.classify_with_network(spark, dataset, str(tmp_path), plan, 3)
    assert scored.count() == -(-dataset.count() // 5) and report.count() == 1
    rows = history.orderBy("epoch").collect()
    assert [row.epoch for row in rows] == [1, 2, 3] and {row.n_valid for row in rows} == {scored.count()}
    hits = scored.where(F.col("label") == F.col("prediction")).count()
    assert rows[-1].accuracy == pytest.approx(hits / scored.count())


def test_rule_lemmas_in_a_comparison(spark, cohorts):
    words = spark.createDataFrame([("angrys",), ("happys",)], "word string")
    known = spark.createDataFrame([("angry",)], "word string")
    plural = [df.withColumn("body", F.regexp_replace("body", "angry|happy", "$0s")) for df in cohorts]
    tokens = jobs.tokenised_posts(*plural, ["Bad"], "id", [], lemmas=lemmas_by_rules(words, known))
    found = {row.word for row in tokens.select(F.explode("words").alias("word")).distinct().collect()}
    assert {"angry", "happys"} <= found and "angrys" not in found


def test_shuffle_partitions():
    assert session.shuffle_partitions_for(10) == 200
    assert session.shuffle_partitions_for(2**40) == 4096
    assert session.shuffle_partitions_for(100 * 2**40) == 409_600


def test_shared_folder(spark):
    own = session.shared_folder(spark)
    assert own and session.shared_folder(spark) == own


def test_shared_folder_is_the_clusters():
    class Context:
        master, folder = "yarn", None

        def getCheckpointDir(self):
            return self.folder

        def setCheckpointDir(self, folder):
            self.folder = folder

    class Session:
        def __init__(self, conf):
            self.conf, self.sparkContext = conf, Context()

    named = Session({"spark.checkpoint.dir": "/shared"})
    assert session.shared_folder(named) == named.sparkContext.folder == "/shared"
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        session.shared_folder(Session({}))
