import random

from pyspark.sql import functions as F

from tidemark.llm import language


def test_held_out_accuracy_and_calibration(small):
    docs = small("documents").withColumn("held_out", F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(4)) == 2)
    model = language.train(docs.where("NOT held_out"))
    assert (model.weights == 0).mean() > 0.5 and model.temperature > 0
    got = language.predict_languages(docs.where("held_out"), model, keep=("doc_id", "lang")).collect()
    assert sum(row.lang == row.lang_pred for row in got) >= 0.97 * len(got)
    assert all(0 <= row.score <= 1 for row in got)


def test_texts_without_letters(texts_frame):
    texts = ["the cat and the dog", None, "", "123 !?", "le chat et le chien", "the bird", "le chien", "the cat and the dog"]
    langs = ["en", "en", None, "fr", "fr", "en", "fr", "en"]
    docs = texts_frame(texts, lang=langs)
    got = language.predict_languages(docs, language.train(docs)).orderBy("doc_id").collect()
    assert [row.lang_pred for row in got] == ["en", "und", "und", "und", "fr", "en", "fr", "en"]
    assert [row.score for row in got][1:4] == [0.0] * 3


def test_nothing_to_learn(texts_frame):
    docs = texts_frame(["some words", "1"], lang=[None, "en"])
    assert {row.lang_pred for row in language.predict_languages(docs, language.train(docs)).collect()} == {"und"}
    assert language.predict_languages(docs.limit(0), language.train(docs.limit(0))).count() == 0


def test_one_language(texts_frame):
    docs = texts_frame(["some words", "more words"])
    assert {row.lang_pred for row in language.predict_languages(docs, language.train(docs)).collect()} == {"en"}


def test_many_rows_without_or_with_one_id(spark):
    """What is learnt does not hang on the ids: all null, all equal, or a third of them equal."""
    pick = random.Random(4)
    words = {"en": "the cat and a dog of house that was here", "fr": "le chat et un chien de la maison qui est ici"}
    rows = [(lang, " ".join(pick.choices(words[lang].split(), k=12)) + f" {k}") for lang in words for k in range(3000)]
    for key in (lambda k: None, lambda k: 0, lambda k: k if k % 3 else 7):
        docs = spark.createDataFrame([(key(k), *row) for k, row in enumerate(rows)], "doc_id long, lang string, text string")
        model = language.train(docs)
        assert sorted(model.languages) == ["en", "fr"]
        asked = docs.where("text like '%99'")
        assert all(row.lang == row.lang_pred for row in language.predict_languages(asked, model, keep=("lang",)).collect())
