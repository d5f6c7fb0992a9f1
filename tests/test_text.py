import re
import unicodedata

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from catalog.queries import QUERIES
from tidemark import sizes
from tidemark.functions import text as tx
from tidemark.functions.fixed_values import CUSTOM_STOPWORDS
from tidemark.sizes import inline_table


def value(spark, column, text):
    return spark.createDataFrame([(text,)], "t string").select(column(F.col("t"))).first()[0]


def test_clean_regex(spark):
    assert value(spark, tx.clean_text, "a &amp; b &lt;c&gt; hi!there") == "a and b < c > hi ! there"
    assert value(spark, tx.clean_text, "\t x \n") == "x"
    assert value(spark, tx.clean_text, None) == ""


def test_long_runs_do_not_stall(spark):
    run = " \n" * 150_000
    assert value(spark, tx.clean_text, f"{run}a{run}b{run}") == f"a{run} b"  # a line break counts as punctuation
    assert value(spark, tx.clean_text, "x" * 300_000) == "x" * 300_000
    assert value(spark, lambda c: tx.last_tokens(c, 3), "!" * 300_000 + run) == "!" * 300_000


def test_clean_regex_as_written_out(spark):
    """The one-character borders give what the run-by-run patterns give."""
    for text in ["ab!!cd", "a!b!c", "!a", "a!", "x_1-2 y", "é!ü", "a\nb", "<<a>>", "a  b", "--", ""]:
        word, other = r"[^\W]+", r"[^\w ]+"
        want = re.sub(f"({word})({other})", r"\1 \2", text)
        want = re.sub(f"({other})({word})", r"\1 \2", want).strip()
        assert value(spark, tx.clean_text, text) == want


def test_clean_literal(spark):
    clean = lambda c: tx.clean_text(c, "literal")
    assert value(spark, clean, "a &amp; b &lt;c&gt; hi!there") == "a &amp; b <c> hi!there"
    assert value(spark, clean, "a &amp;? b") == "a and b"
    null_as_nan = lambda c: tx.clean_text(c, "literal", "nan")
    assert value(spark, null_as_nan, None) == "nan"


def test_join_fields(spark):
    row = spark.range(1).select(
        tx.join_fields(F.lit("b"), F.lit(None).cast("string"), F.lit(None).cast("string")),
        tx.join_fields(F.lit(None).cast("string"), F.lit("s"), F.lit("t")),
    )
    assert tuple(row.first()) == ("b </s>  </s> ", " </s> s </s> t")


def test_token_source(spark):
    rows = spark.createDataFrame(
        [("b", None, None), (None, "s", "t"), ("b", "s", None), (None, None, None)],
        "body string, selftext string, title string",
    )
    columns = [F.col(c) for c in ("body", "selftext", "title")]
    assert [r[0] for r in rows.select(tx.token_source(*columns)).collect()] == ["b", "s t", "s ", ""]
    assert [r[0] for r in rows.select(tx.token_source(*columns, "nan")).collect()] == ["b", "s t", "s nan", ""]


def test_tokens(spark):
    words = lambda c: tx.word_array(c, ["dont", "ok"])
    assert value(spark, words, "Don't stop—OK? café x") == ["stopok", "café"]
    assert value(spark, words, " ?! … ") == []
    assert value(spark, words, "a bb cc\x1cdd") == ["bb", "cc", "dd"]


def test_stopword_list(spark):
    stop = tx.default_stopwords()
    assert len(CUSTOM_STOPWORDS) == 101 and len(set(CUSTOM_STOPWORDS)) == 98
    assert {"nan", "ok", "the", "we", "yourselves"} <= set(stop)
    words = inline_table(spark, ["word"], [("ok",), ("yes",), ("nan",)])
    table = inline_table(spark, ["word"], [(w,) for w in stop])
    assert [r.word for r in tx.drop_stopwords(words, table).collect()] == ["yes"]


def test_both_stop_tests_agree(spark):
    stop = ["it's", "back\\slash", "dont", 'say"so"', "n", "\\n"]
    texts = ["dont it's n say", "back slash backslash saysoitdont"]
    df = spark.createDataFrame([(t,) for t in texts], "text string")
    exploded = sorted(r.word for r in tx.explode_words(df, "text", [], stop).collect())
    arrays = sorted(w for r in df.select(tx.word_array(F.col("text"), stop).alias("w")).collect() for w in r.w)
    assert exploded == arrays == sorted(w for t in texts for w in python_words(t, stop))


def test_lemma_comes_after_the_stop_test(spark):
    posts = inline_table(spark, ["text"], [("cats was ran",)])
    words = tx.explode_words(posts, "text", [], ["was", "wa"])
    lemmas = inline_table(spark, ["surface", "lemma"], [("cats", "cat"), ("ran", "was")])
    assert sorted(r.word for r in tx.lemmatise(words, lemmas).collect()) == ["cat", "was"]


def test_last_tokens(spark):
    last = lambda c: tx.last_tokens(c, 5)
    assert value(spark, last, "a b c") == "a b c"
    assert value(spark, last, "a b c d e f g") == "c d e f g"
    assert value(spark, last, "  ") == ""


def test_tally(spark):
    docs = spark.createDataFrame([(1, ["b", "a", "b"]), (2, []), (3, ["x"]), (4, None)], "id int, words array<string>")
    got = sorted(tuple(r) for r in tx.tally_words(docs, ["id"]).collect())
    assert got == [(1, "a", 1), (1, "b", 2), (3, "x", 1)]


def python_words(text, stop=()):
    stripped = (re.sub(r"[^\w\s]", "", piece) for piece in text.lower().split())
    return [w for w in stripped if w not in stop and len(w) > 1]


# Scripts whose categories have been stable for long, and every kind of space.
LETTERS = st.characters(min_codepoint=1, max_codepoint=0x24F) | st.sampled_from("абвßĳ—’… 　  中文٣")


@settings(max_examples=40, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.text(LETTERS, max_size=30), min_size=1, max_size=30))
def test_tokens_match_python(spark, texts):
    """White space and word characters are Python's."""
    plain = [t for t in texts if all(unicodedata.category(c) != "Cs" for c in t)]
    if not plain:
        return
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(plain)], "id int, t string")
    got = dict(rows.select("id", tx.word_array(F.col("t"))).collect())
    assert got == {i: python_words(t) for i, t in enumerate(plain)}


def test_written_out_stop_words_are_those_of_spark_ml(spark):
    from pyspark.ml.feature import StopWordsRemover

    from tidemark.functions.fixed_values import ENGLISH_STOPWORDS

    assert ENGLISH_STOPWORDS == StopWordsRemover.loadDefaultStopWords("english")


def test_oracle_sql_reads_no_files(monkeypatch):
    import pyspark

    from catalog import oracle

    monkeypatch.setattr(pyspark, "__path__", [])
    assert len(oracle.oracle_sql()) >= 67


def brute_lemma(word, dictionary, exceptions, rules, rounds):
    """First the exceptions, then the earliest round with a known form: the shortest, then the earliest rule."""
    if exceptions.get(word) in dictionary:
        return exceptions[word]
    forms = [(-1, word)]
    for _ in range(rounds + 1):
        known = sorted((len(form), rule, form) for rule, form in forms if form in dictionary)
        if known:
            return known[0][2]
        forms = [
            (rule, form[: len(form) - len(suffix)] + ending)
            for _, form in forms
            for rule, (suffix, ending) in enumerate(rules)
            if form.endswith(suffix) and len(form) > len(suffix)
        ]
    return word


def test_lemmas_by_rules(spark):
    dictionary = ["dog", "glass", "wolf", "box", "quiz", "church", "wish", "woman", "city", "bus", "mouse", "ox", "s", "as", "a"]
    exceptions = {"mice": "mouse", "oxen": "ox", "geese": "goose", "dogs": "wolf"}
    words = ["dogs", "glasses", "wolves", "boxes", "churches", "wishes", "women", "cities", "bus", "buses", "mice", "oxen", "geese"]
    words += ["s", "as", "ass", "quizzes", "unknowns", "dogss", "", None, "dogs"]
    frame = lambda rows, kind: spark.createDataFrame(rows, kind)
    table = tx.lemmas_by_rules(
        frame([(w,) for w in words], "word string"),
        frame([(w,) for w in dictionary] * 2, "word string"),
        frame(list(exceptions.items()), "surface string, lemma string"),
    )
    got = {row.surface: row.lemma for row in table.collect()}
    want = {w: brute_lemma(w, dictionary, exceptions, tx.NOUN_RULES, 2) for w in words if w is not None}
    assert got == {w: lemma for w, lemma in want.items() if lemma != w}
    assert got["dogs"] == "wolf" and got["dogss"] == "dog" and "geese" not in got and got["women"] == "woman"
    assert table.count() == len(got)
    nothing = tx.lemmas_by_rules(frame([], "word string"), frame([], "word string"))
    assert nothing.columns == ["surface", "lemma"] and nothing.count() == 0


def test_rule_lemmas_in_arrays(spark):
    """Rows that agree in all keys stay rows, equal or not."""
    rows = [(1, ["dogs", "run"]), (1, ["dogs", "run"]), (1, ["cats"]), (1, []), (2, None), (1, ["cats", "cats"])]
    docs = spark.createDataFrame(rows, "id int, words array<string>")
    known = spark.createDataFrame([("dog",), ("cat",)], "word string")
    lemmas = tx.lemmas_by_rules(docs.select(F.explode("words").alias("word")), known)
    got = sorted((row.id, row.words) for row in tx.lemmatise_arrays(docs, lemmas, ["id"]).collect())
    assert got == [(1, []), (1, ["cat"]), (1, ["cat", "cat"]), (1, ["dog", "run"]), (1, ["dog", "run"]), (2, [])]


@pytest.mark.parametrize("rows", [0, 10**6])
def test_lemmas_in_arrays_with_a_folder(spark, monkeypatch, tmp_path, rows):
    """A table that fits replaces words in place, without a shuffle; a larger one is joined; both as without a folder."""
    monkeypatch.setattr(sizes, "BROADCAST_ROWS", rows)
    texts = [["dogs", "run", "dogs"], ["dogs", "run", "dogs"], [], None, ["cats", None], ["x"] * 3]
    docs = spark.createDataFrame([(k % 5 or None, words) for k, words in enumerate(texts * 3)], "id int, words array<string>").repartition(4)
    lemmas = spark.createDataFrame([("dogs", "hound"), ("dogs", "dog"), ("cats", None), (None, "x"), ("x", "")], "surface string, lemma string")
    want = sorted(map(str, tx.lemmatise_arrays(docs, lemmas, ["id"]).collect()))
    found = tx.lemmatise_arrays(docs, lemmas, ["id"], folder=str(tmp_path))
    assert sorted(map(str, found.collect())) == want
    assert "['dog', 'run', 'dog']" in str(want) and len(want) == 18
    if rows:
        plain = tx.lemmatise_arrays(docs.sparkSession.createDataFrame(docs.collect(), docs.schema), lemmas, ["id"], folder=str(tmp_path))
        assert "Exchange" not in plain._jdf.queryExecution().executedPlan().toString()


def test_rule_lemmas_of_documents_are_not_shuffled(spark, tmp_path):
    """The lemma queries shuffle no row per word of a text."""
    rows = [(1, "cats dogs thing thed"), (2, None), (2, ""), (3, "thing thing")]
    spark.createDataFrame(rows, "doc_id bigint, text string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, "cat dog")], "item_id bigint, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    want = {"lemma_tokens": ["", "", "cats dogs th th", "th th"], "lemma_rules_tokens": ["", "", "cat dog thing thed", "thing thing"]}
    for name, joined in want.items():
        found = QUERIES[name](spark, str(tmp_path))
        assert "Exchange" not in found._jdf.queryExecution().executedPlan().toString()
        assert sorted(row.joined for row in found.collect()) == sorted(joined)
