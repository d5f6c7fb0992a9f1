import random

import numpy as np
import pytest
from pyspark.ml.feature import HashingTF
from pyspark.ml.linalg import Vectors
from pyspark.sql import functions as F

from catalog.queries import QUERIES
from tidemark.operators import classifier, embedding, evaluate


def scored(spark, rows):
    return spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "id long, label int, prediction int").repartition(3)


def test_class_without_positive_calls(spark):
    got = {r["class"]: r for r in evaluate.class_metrics(scored(spark, [(1, 0), (0, 0), (0, 0)])).collect()}
    assert (got[1].precision, got[1].recall, got[1].f1) == (0.0, 0.0, 0.0)
    assert got[0].precision == pytest.approx(2 / 3) and got[0].recall == 1.0
    assert got[0].accuracy == got[1].accuracy == pytest.approx(2 / 3)


def test_batch_mean_is_not_the_pooled_value(spark):
    rng = random.Random(1)
    df = scored(spark, [(rng.randint(0, 1), rng.randint(0, 1)) for _ in range(10)])
    pooled = {r["class"]: r.precision for r in evaluate.class_metrics(df).collect()}
    assert evaluate.batch_metrics(df, "id", 10).where("class = 1").first().precision == pytest.approx(pooled[1])
    assert evaluate.batch_metrics(df, "id", 4).where("class = 1").first().precision != pytest.approx(pooled[1])


def test_accuracy_is_cut(spark):
    got = evaluate.accuracy_pct(scored(spark, [(1, 1), (1, 1), (1, 0)])).first()
    assert got.accuracy == pytest.approx(200 / 3) and got.accuracy_whole == 66


def test_argmax_tie_is_class_0(spark):
    df = spark.createDataFrame([([0.5, 0.5],), ([0.4, 0.6],), ([0.6, 0.4],)], "p array<double>")
    assert [r[0] for r in df.select(classifier.argmax_class(F.col("p"))).collect()] == [0, 1, 0]


def test_one_hot(spark):
    rows = spark.createDataFrame([(0,), (1,)], "label int")
    assert [r.target for r in embedding.one_hot(rows).collect()] == [[1.0, 0.0], [0.0, 1.0]]


def test_hashed_embedding(spark):
    docs = spark.createDataFrame([("u", "A b  b"), ("v", "b b a"), ("w", "")], "author string, text string")
    got = {r.author: r.embedding for r in embedding.embed_hashed(docs, size=32).collect()}
    assert got["u"] == got["v"] and len(got["u"]) == 32
    assert sum(x * x for x in got["u"]) == pytest.approx(1)
    assert set(got["w"]) == {0.0}


def test_hashed_embedding_by_hand(spark):
    hashing = HashingTF(numFeatures=64)
    texts = ["a b a", "é ü 7 a", "x " * 50 + "y"]
    docs = spark.createDataFrame(list(enumerate(texts)), "id int, text string")
    for row in embedding.embed_hashed(docs, size=64).collect():
        counts = np.zeros(64)
        for piece in texts[row.id].split():
            counts[hashing.indexOf(piece)] += 1
        assert row.embedding == pytest.approx(list(counts / np.linalg.norm(counts)), abs=1e-6)


def test_own_encoder(spark):
    def load():
        def encode(texts):
            return np.array([[len(t), t.count("a")] for t in texts], dtype=np.float32)

        return encode

    docs = spark.createDataFrame([(i, "a" * i) for i in range(50)], "id int, text string")
    got = embedding.embed_with(docs, load, batch_size=7, partitions=4).collect()
    assert {r.id: r.embedding for r in got} == {i: [float(i), float(i)] for i in range(50)}


def test_labelled_dataset(spark):
    part = spark.createDataFrame([("u", "t", [1.0])], "author string, text string, embedding array<float>")
    both = embedding.labelled_dataset({1: part, 0: part})
    assert both.columns == ["author", "embedding", "label"] and sorted(r.label for r in both.collect()) == [0, 1]


@pytest.fixture(scope="module")
def points(spark):
    rng = random.Random(0)
    rows = [(i, [rng.gauss(2 * (i % 2) - 1, 0.3), rng.random()], i % 2) for i in range(300)]
    return spark.createDataFrame(rows, "id int, embedding array<float>, label int")


def test_train_and_predict(spark, points):
    model = classifier.train(points, 2, [4], 40)
    got = classifier.predict(model, points)
    assert got.columns == ["id", "embedding", "label", "probability", "prediction"]
    rows = got.collect()
    assert all(sum(r.probability) == pytest.approx(1) for r in rows)
    assert all(r.prediction == int(r.probability[1] > r.probability[0]) for r in rows)
    assert evaluate.accuracy_pct(got).first().accuracy > 95
    report = evaluate.report(got.withColumn("score", F.col("probability")[1])).first()
    assert report.accuracy > 95 and report.roc_auc > 0.99
    losses = [r.loss for r in classifier.history(model, points).orderBy("epoch").collect()]
    assert losses[-1] < losses[0]


def test_trained_vectors(spark):
    """Words of one topic lie closer to one another than to the other topic's; texts do too."""
    pick = random.Random(1)
    topics = [["cat", "dog", "cow", "pig"], ["red", "blue", "green", "pink"]]
    rows = [(k, " ".join(pick.choices(topics[k % 2], k=30) + ["the"] * 5)) for k in range(400)] + [(900, "unheard"), (901, None), (902, "")]
    docs = spark.createDataFrame(rows, "id int, text string")
    vectors = embedding.train_word_vectors(docs, size=8, partitions=1).cache()
    by_word = {row.word: (row.vector.toArray(), row.weight) for row in vectors.collect()}
    assert set(by_word) == {*topics[0], *topics[1], "the"}
    share = 400 * 5 / (400 * 35 + 1)
    assert by_word["the"][1] == pytest.approx(1e-3 / (1e-3 + share))
    near = lambda a, b: float(a @ b / np.linalg.norm(a) / np.linalg.norm(b))
    assert near(by_word["cat"][0], by_word["dog"][0]) > near(by_word["cat"][0], by_word["red"][0])
    found = {row.id: np.array(row.embedding) for row in embedding.embed_averaged(docs, vectors, "id", 8).collect()}
    assert len(found) == 403 and all(not found[k].any() for k in (900, 901, 902))
    words = rows[0][1].split()
    plain = sum(by_word[w][0] * by_word[w][1] for w in words)
    np.testing.assert_allclose(found[0], plain / np.linalg.norm(plain), atol=1e-5)
    assert near(found[0], found[2]) > near(found[0], found[1])


def test_texts_are_averaged_before_the_shuffle(spark, monkeypatch, tmp_path):
    """Sums have a fixed size and words are looked up by a measured table: no sort of rows with vectors, no shuffle by word."""
    rows = [(k, " ".join(["a"] * (k % 3) + ["b"] * (k % 2) + ["rare"])) for k in range(30)] + [(5, "a"), (None, "b"), (31, None)]
    spark.createDataFrame(rows, "doc_id bigint, text string").write.parquet(f"{tmp_path}/documents.parquet")
    learnt = [("a", Vectors.dense([3.0] + [0.0] * 15), 0.5), ("b", Vectors.dense([0.0, 4.0] + [0.0] * 14), 0.25)]
    vectors = spark.createDataFrame(learnt, ["word", "vector", "weight"])
    monkeypatch.setattr(embedding, "train_word_vectors", lambda *a, **k: vectors)
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        found = QUERIES["trained_texts"](spark, str(tmp_path))
        plan = found._jdf.queryExecution().executedPlan().toString()
        got = sorted((row.doc_id or -1, row.known, row.dim, row.is_unit) for row in found.collect())
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)
    assert "ObjectHashAggregate" not in plan and "SortAggregate" not in plan and "hashpartitioning(word" not in plan
    known = {k: k % 3 + k % 2 + (k == 5) for k in range(30)}
    want = [(k or -1, n, 16, True) for k, n in known.items()] + [(5, known[5], 16, True), (-1, 0, 16, True), (31, 0, 16, True)]
    assert got == sorted(want)
    docs = spark.createDataFrame([(1, "a b a"), (2, "c")], "id int, text string")
    both = {row.id: row.embedding for row in embedding.embed_averaged(docs, vectors, "id", 16).collect()}
    assert both[1][:2] == pytest.approx([3 / 10**0.5, 1 / 10**0.5]) and not any(both[2]) and len(both[2]) == 16
