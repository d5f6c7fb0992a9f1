"""One query per operator, over the test tables."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from catalog.side_tables import COMMUNITIES, IRREGULAR, LEMMAS, LEXICON, SOURCES, STOP_TABLE
from tidemark.functions import text as tx
from tidemark.functions.fixed_values import EMOTIONS, POLARITIES
from tidemark.operators import activity, affect, classifier, cohort, embedding, evaluate, network, ranksum, sampling, tfidf
from tidemark.operators import words as wd
from tidemark.plans import jobs
from tidemark.session import shared_folder
from tidemark.sizes import inline_table, lookup_join, write_once
from tidemark.sources import lists, sinks, tables
from tidemark.sources import posts as ps

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def query(build: Query) -> Query:
    QUERIES[build.__name__] = build
    return build


# Given, so that reading a table starts no job to look at its files.
SCHEMAS = {
    "documents": "doc_id bigint, text string, lang string, source string, n_chars bigint",
    "labels": "doc_id bigint, quality int, toxic int",
    "events": "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string",
    "conversations": "conv_id bigint, turn bigint, role string, text string",
    "embeddings": "vec_id bigint, embedding array<float>, label int",
    "orders": "o_custkey bigint, o_orderstatus string, o_totalprice double",
    "pages": "page_id bigint, url string, html string",
}


#: Tables of long texts, and the setting that says over how many tasks their rows are dealt right after the scan.
#: Unset, they are read as they lie; it is for files that cannot be split, as ``partitions`` of ``read_posts``.
LONG_TEXTS = ("documents", "pages")
TEXT_PARTITIONS = "spark.tidemark.textPartitions"


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.schema(SCHEMAS[name]).parquet(f"{folder}/{name}.parquet")


def dealt(rows: DataFrame, name: str) -> DataFrame:
    partitions = rows.sparkSession.conf.get(TEXT_PARTITIONS, None)
    return rows.repartition(int(partitions)) if partitions and name in LONG_TEXTS else rows


def texts(spark: SparkSession, folder: str, name: str, *columns: str) -> DataFrame:
    return dealt(table(spark, folder, name).select(*columns), name)


def rounded(name: str, digits: int = 9) -> Column:
    return F.round(name, digits).alias(name)


# --- shared inputs ---------------------------------------------------------


def labelled_documents(spark: SparkSession, folder: str) -> DataFrame:
    labels = table(spark, folder, "labels").select("doc_id", F.when(F.col("toxic") == 1, "a").otherwise("b").alias("class"))
    return texts(spark, folder, "documents", "doc_id", "text").join(labels, "doc_id")


def class_words(spark: SparkSession, folder: str) -> DataFrame:
    return tx.explode_words(labelled_documents(spark, folder), "text", ["class"], tx.default_stopwords())


def class_documents(spark: SparkSession, folder: str) -> DataFrame:
    words = tx.word_array(F.col("text"), tx.default_stopwords()).alias("words")
    return labelled_documents(spark, folder).select("doc_id", "class", words)


def materialized_words(spark: SparkSession, folder: str) -> DataFrame:
    """Kept words of all documents with their counts, stored: lemmas and counts both read them."""
    words = tx.explode_words(texts(spark, folder, "documents", "text"), "text", [], tx.default_stopwords())
    return write_once(words.groupBy("word").agg(F.count("*").alias("n")), shared_folder(spark), "words")


def word_table(spark: SparkSession, folder: str) -> DataFrame:
    return wd.word_metric(wd.word_shares(class_words(spark, folder)))


def affects(spark: SparkSession, folder: str) -> DataFrame:
    lexicon = inline_table(spark, ["word", "affect"], LEXICON)
    return affect.affect_wide(class_documents(spark, folder), lexicon, ["doc_id", "class"])


def timeline(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "events").select("event_id", "user_id", "event_type", "ts")


def scored(spark: SparkSession, folder: str) -> DataFrame:
    p = 1 / (1 + F.exp(-F.col("embedding")[0].cast("double")))
    rows = table(spark, folder, "embeddings").select(
        "vec_id", (F.col("label") < 4).cast("int").alias("label"), F.array(1 - p, p).alias("probability")
    )
    return rows.withColumn("prediction", classifier.argmax_class(F.col("probability"))).withColumn(
        "score", F.col("probability")[1]
    )


# --- text ------------------------------------------------------------------


@query
def post_text(spark, folder):
    docs = table(spark, folder, "documents").select("doc_id", F.col("text").alias("body"), F.col("source").alias("title"))
    full = ps.with_all_fields(docs)
    return full.select("doc_id", tx.join_fields(F.col("body"), F.col("selftext"), F.col("title")).alias("text"))


@query
def token_source(spark, folder):
    docs = table(spark, folder, "documents").join(table(spark, folder, "labels").select("doc_id", "quality"), "doc_id", "left")
    known = F.col("quality").isNotNull()
    source = tx.token_source(F.col("text"), F.when(known, F.col("text")), F.when(known, F.col("source")))
    return docs.select("doc_id", source.alias("token"))


@query
def clean_text_regex(spark, folder):
    return texts(spark, folder, "pages", "page_id", "html").select("page_id", tx.clean_text(F.col("html")).alias("text"))


@query
def clean_text_literal(spark, folder):
    return texts(spark, folder, "pages", "page_id", "html").select("page_id", tx.clean_text(F.col("html"), "literal").alias("text"))


@query
def tokens(spark, folder):
    words = tx.word_array(F.col("text"), tx.default_stopwords())
    docs = texts(spark, folder, "documents", "doc_id", "text").select("doc_id", words.alias("words"))
    return docs.select("doc_id", F.size("words").alias("n_tokens"), F.array_join("words", " ").alias("joined"))


@query
def stopword_filter(spark, folder):
    words = tx.explode_words(texts(spark, folder, "documents", "text"), "text", [])
    kept = tx.drop_stopwords(words, inline_table(spark, ["word"], [(w,) for w in STOP_TABLE]))
    return kept.groupBy("word").agg(F.count("*").alias("n"))


@query
def lemma_join(spark, folder):
    words = tx.explode_words(texts(spark, folder, "documents", "text"), "text", [], tx.default_stopwords())
    lemmas = tx.lemmatise(words, inline_table(spark, ["surface", "lemma"], LEMMAS))
    return lemmas.groupBy("word").agg(F.count("*").alias("n"))


@query
def lemma_tokens(spark, folder):
    """Each document's kept words as lemmas, in order."""
    docs = texts(spark, folder, "documents", "doc_id", "text").select(
        "doc_id", tx.word_array(F.col("text"), tx.default_stopwords()).alias("words")
    )
    lemmas = inline_table(spark, ["surface", "lemma"], LEMMAS)
    found = tx.lemmatise_arrays(docs, lemmas, ["doc_id"], folder=shared_folder(spark))
    return found.select("doc_id", F.size("words").alias("n_tokens"), F.array_join("words", " ").alias("joined"))


@query
def lemma_rules(spark, folder):
    """Counts of the kept words as lemmas that rules find; the dictionary is what the benchmark's texts hold."""
    stop = tx.default_stopwords()
    words = materialized_words(spark, folder)
    dictionary = tx.explode_words(spark.read.parquet(f"{folder}/benchmark.parquet").select("text"), "text", [], stop)
    irregular = inline_table(spark, ["surface", "lemma"], IRREGULAR)
    lemmas = tx.lemmas_by_rules(words, dictionary, irregular)
    return tx.lemmatise(words, lemmas).groupBy("word").agg(F.sum("n").alias("n"))


@query
def lemma_rules_tokens(spark, folder):
    """Each document's kept words, in order, with the lemmas that rules find for them."""
    words = tx.word_array(F.col("text"), tx.default_stopwords()).alias("words")
    docs = texts(spark, folder, "documents", "doc_id", "text").select("doc_id", words)
    stored = write_once(docs, shared_folder(spark), "words")
    dictionary = spark.read.parquet(f"{folder}/benchmark.parquet").select("text")
    dictionary = tx.explode_words(dictionary, "text", [], tx.default_stopwords())
    lemmas = tx.lemmas_by_rules(
        stored.select(F.explode("words").alias("word")), dictionary, inline_table(spark, ["surface", "lemma"], IRREGULAR)
    )
    found = tx.lemmatise_arrays(stored, lemmas, ["doc_id"], folder=shared_folder(spark))
    return found.select("doc_id", F.size("words").alias("n_tokens"), F.array_join("words", " ").alias("joined"))


@query
def last_n_tokens(spark, folder):
    return texts(spark, folder, "documents", "doc_id", "text").select("doc_id", tx.last_tokens(F.col("text"), 50).alias("text"))


@query
def parse_tolerant(spark, folder):
    """JSON lines made of the documents, one in ten of them broken."""
    line = F.to_json(F.struct(F.col("source").alias("author"), F.col("text").alias("body"), F.col("doc_id").alias("created_utc")))
    broken = F.when(F.col("doc_id") % 10 != 7, line).otherwise(F.concat(F.lit("{"), line))
    lines = table(spark, folder, "documents").select(broken.alias("value"))
    return ps.parse_lines(lines).select("author", "body", "created_utc")


@query
def parse_strict(spark, folder):
    line = F.to_json(F.struct(F.col("source").alias("author"), F.col("text").alias("selftext"), F.col("lang").alias("title")))
    lines = table(spark, folder, "documents").select("doc_id", line.alias("value"))
    return ps.parse_lines(lines, "strict").select("doc_id", "author", "selftext", "title", "body")


@query
def file_columns(spark, folder):
    kind = F.when(F.col("lang") == "en", "comments").otherwise("submissions")
    dump = F.when(F.col("lang") == "en", "RC_").otherwise("RS_")
    docs = table(spark, folder, "documents")
    named = docs.select(
        "doc_id",
        F.concat("source", F.lit("_x_"), kind, F.lit(".json")).alias("file"),
        F.concat(F.lit("/dumps/"), "source", F.lit("/"), dump, "doc_id", F.lit(".zst")).alias("path"),
    )
    return named.select(
        "doc_id",
        ps.author_of_file(F.col("file")).alias("author"),
        ps.folder_of_file(F.col("path")).alias("folder"),
        ps.data_type(F.element_at(F.split("path", "/"), -1)).alias("data_type"),
    )


# --- written and read back ---------------------------------------------------


def _scratch(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


@query
def author_json_roundtrip(spark, folder):
    path = _scratch(spark, "author_json")
    docs = texts(spark, folder, "documents", "doc_id", "source", "lang", "text").select(
        F.col("source").alias("author"),
        F.col("text").alias("body"),
        F.col("doc_id").alias("created_utc"),
        F.when(F.col("lang") == "en", "comments").otherwise("submissions").alias("data_type"),
    )
    sinks.write_author_json(docs, path)
    back = ps.read_posts(spark, [path], pattern="*.json")
    kind = F.regexp_extract("file", "data_type=([^/]*)/", 1).alias("kind")
    return back.select("author", "body", "created_utc", kind)


@query
def author_json_batches(spark, folder):
    """Appends by language, each of them made twice and one of them torn, read back."""
    path = _scratch(spark, "author_json")
    docs = texts(spark, folder, "documents", "doc_id", "source", "lang", "text").select(
        F.col("source").alias("author"),
        F.col("text").alias("body"),
        F.col("doc_id").alias("created_utc"),
        F.lit("comments").alias("data_type"),
        F.coalesce("lang", F.lit("none")).alias("lang"),
    )
    for lang in ["en", "de", "en", "rest", "rest"]:
        chosen = ~F.col("lang").isin("en", "de") if lang == "rest" else F.col("lang") == lang
        sinks.write_author_json(docs.where(chosen).drop("lang"), path, batch=lang)
    # What a run leaves that ends before its batch is listed.
    docs.drop("lang").write.json(f"{path}/data/torn")
    back = ps.read_posts(spark, sinks.author_json_paths(spark, path), pattern="*.json")
    return back.select("author", "body", "created_utc")


@query
def cohort_by_author(spark, folder):
    """A cohort of all events of which some users get new rows: these in place of theirs, the rest as it was."""
    path, work = _scratch(spark, "cohort"), shared_folder(spark)
    rows = timeline(spark, folder).select("user_id", "event_id", F.col("event_type").alias("kind"))
    sinks.replace_authors(rows, path, work, 16, "user_id")
    replacing = rows.where("kind = 'error' AND user_id % 7 = 0").withColumn("kind", F.lit("new"))
    sinks.replace_authors(replacing, path, work, 16, "user_id")
    return spark.read.parquet(path).select("user_id", "event_id", "kind")


@query
def line_numbers(spark, folder):
    """Documents as JSON lines, a file for each source with one line in seven broken, and each good line's number in its file."""
    path = _scratch(spark, "lines")
    docs = table(spark, folder, "documents")
    line = F.to_json(F.struct(F.col("source").alias("author"), F.col("doc_id").alias("created_utc"), F.col("text").alias("body")))
    lines = docs.select("source", "doc_id", F.when(F.col("doc_id") % 7 == 3, F.lit("broken")).otherwise(line).alias("value"))
    ordered = lines.repartition("source").sortWithinPartitions("source", "doc_id")
    ordered.select("source", "value").write.partitionBy("source").text(path)
    posts = ps.read_posts(spark, [path], line_numbers=shared_folder(spark))
    return posts.select("author", F.col("created_utc").alias("doc_id"), "line_number")


@query
def cut_by_line(spark, folder):
    """Each user's events before the line of the first listed one, in files whose lines run backwards in time."""
    path = _scratch(spark, "lines")
    rows = timeline(spark, folder).select((F.col("user_id") % 8).alias("part"), "user_id", "event_id", "event_type", "ts")
    line = F.to_json(F.struct(F.col("user_id").alias("author"), F.col("event_type").alias("subreddit"), F.col("event_id").alias("created_utc")))
    ordered = rows.repartition("part").sortWithinPartitions("part", F.desc("ts"), F.desc("event_id"))
    ordered.select("part", line.alias("value")).write.partitionBy("part").text(path)
    posts = ps.read_posts(spark, [path], line_numbers=shared_folder(spark))
    kept = cohort.cut_by_position(posts, COMMUNITIES, "author", "subreddit", "line_number")
    return kept.select(F.col("created_utc").alias("event_id"), F.col("author").cast("long").alias("user_id"))


@query
def csv_quoted_lines(spark, folder):
    """Documents as CSV with line breaks and quotes inside of fields, read back in splits."""
    path, work = _scratch(spark, "quoted"), shared_folder(spark)
    docs = texts(spark, folder, "documents", "doc_id", "text", "source")
    quoted = F.concat(F.lit('say "'), F.col("source"), F.lit('",\n'), F.col("text"))
    sinks.write_csv(docs.select("doc_id", F.lit("2024-01-01 00:00:00"), "source", F.lit("x"), quoted.alias("text")), path, header=False)
    rows = tables.read_dated_posts(spark, path, multi_line=True, folder=work)
    return rows.select(F.col("number").cast("long").alias("doc_id"), F.col("uid").alias("source"), "text")


@query
def name_list_roundtrip(spark, folder):
    path = _scratch(spark, "names")
    names = activity.distinct_authors(timeline(spark, folder), "user_id", None)
    sinks.write_names(names.select(F.col("user_id").cast("string").alias("author")), path, ",")
    return lists.read_names(spark, path, ",")


@query
def csv_new_users(spark, folder):
    """Dated posts written as headerless CSV, read back, first post per user, new users per day."""
    path = _scratch(spark, "dated")
    dated = table(spark, folder, "events").select("event_id", F.col("ts").cast("string"), "user_id", "event_type", "props")
    sinks.write_csv(dated, path, header=False)
    curve = activity.new_users(tables.read_dated_posts(spark, path))
    return curve.select(F.date_format("first", "yyyy-MM-dd").alias("day"), "n")


@query
def stored_word_counts(spark, folder):
    """Counts built once and then read from the stored table."""
    path = _scratch(spark, "word_counts")
    for _ in range(2):
        stored = tables.materialize(spark, path, lambda: wd.word_counts(class_words(spark, folder)))
    return stored


@query
def dataset_roundtrip(spark, folder):
    path = _scratch(spark, "dataset")
    vectors = table(spark, folder, "embeddings").select("vec_id", "embedding", (F.col("label") < 4).cast("int").alias("label"))
    sinks.write_dataset(vectors, path)
    stored = tables.read_embedding_dataset(spark, path)
    first = vector_to_array("features")[0]
    return stored.select("vec_id", "label", first.alias("first"))


# --- authors and activity --------------------------------------------------


@query
def distinct_authors(spark, folder):
    return activity.distinct_authors(timeline(spark, folder), "user_id", exclude=7)


@query
def author_summary(spark, folder):
    found = activity.author_summary(timeline(spark, folder), "user_id", "event_type")
    return found.toDF("n_events", "n_types", "n_users")


@query
def first_seen(spark, folder):
    return activity.first_seen(timeline(spark, folder), "user_id", "ts", "first_ts")


@query
def new_users_per_day(spark, folder):
    return activity.new_users(timeline(spark, folder), "user_id", "ts")


@query
def new_users_per_hour(spark, folder):
    return activity.new_users(timeline(spark, folder), "user_id", "ts", "hour")


@query
def new_users_exact(spark, folder):
    return activity.new_users(timeline(spark, folder), "user_id", "ts", None)


@query
def event_window(spark, folder):
    event = F.lit("2024-01-15 00:00:00").cast("timestamp_ntz")
    return activity.event_window(timeline(spark, folder), event, 3, "ts").select("event_id")


# --- samples and splits ----------------------------------------------------


@query
def sample_n(spark, folder):
    return sampling.sample_n(timeline(spark, folder), "user_id", 10, folder=shared_folder(spark))


@query
def sample_frac_per_group(spark, folder):
    docs = table(spark, folder, "documents").select("doc_id", "source")
    return sampling.sample_fraction(docs, "source", "doc_id")


@query
def first_n_users(spark, folder):
    rows = sampling.first_n_users(timeline(spark, folder), "user_id", 5)
    return rows.groupBy("user_id").agg(F.count("*").alias("n"))


@query
def min_posts_users(spark, folder):
    return sampling.min_posts_users(table(spark, folder, "conversations"), "conv_id", 2)


@query
def capped_active_users(spark, folder):
    turns = table(spark, folder, "conversations").select("conv_id", "turn")
    return sampling.capped_active_users(turns, "conv_id", 30, 5)


@query
def train_test_split(spark, folder):
    return sampling.hash_split(table(spark, folder, "embeddings").select("vec_id"), "vec_id")


@query
def train_test_split_exact(spark, folder):
    return sampling.exact_split(table(spark, folder, "embeddings").select("vec_id"), "vec_id")


# --- cohorts ---------------------------------------------------------------


@query
def posts_of_authors(spark, folder):
    posts = timeline(spark, folder)
    chosen = sampling.sample_n(posts, "user_id", 10, folder=shared_folder(spark))
    return cohort.posts_of_authors(posts, chosen, "user_id").select("event_id", "user_id")


@query
def companion_first_match(spark, folder):
    posts = timeline(spark, folder)
    authors = posts.where(F.col("event_type") == "click").select("user_id")
    rank = F.array_position(F.array(*map(F.lit, SOURCES)), F.col("event_type"))
    others = posts.where(F.col("event_type").isin(SOURCES)).withColumn("priority", rank)
    matched = cohort.companion_first_match(authors, others, "user_id")
    return matched.groupBy("user_id", F.col("event_type").alias("source")).agg(F.count("*").alias("n"))


@query
def cohort_with_companions(spark, folder):
    """Purchases with each user's other events of one hour of the day: the first hour that has any."""
    posts = timeline(spark, folder)
    others = posts.where(F.col("event_type") != "purchase").withColumn("priority", F.hour("ts"))
    both = cohort.with_companions(posts.where(F.col("event_type") == "purchase"), others, "user_id")
    return both.groupBy("user_id", "event_type", "priority").agg(F.count("*").alias("n"))


@query
def cut_by_time(spark, folder):
    return cohort.cut_by_time(timeline(spark, folder), COMMUNITIES, "user_id", "event_type", "ts").select("event_id", "user_id")


@query
def cut_by_position(spark, folder):
    kept = cohort.cut_by_position(timeline(spark, folder), COMMUNITIES, "user_id", "event_type", "event_id")
    return kept.select("event_id", "user_id")


@query
def cut_by_priority(spark, folder):
    kept = cohort.cut_by_priority(timeline(spark, folder), COMMUNITIES, "user_id", "event_type", "event_id")
    return kept.select("event_id", "user_id")


@query
def cohort_label(spark, folder):
    labels = table(spark, folder, "labels")
    parts = {"a": labels.where(F.col("toxic") == 1), "b": labels.where(F.col("toxic") == 0)}
    return cohort.label_cohorts(parts).groupBy("class").agg(F.count("*").alias("n"))


def _turn_slice() -> Column:
    return F.floor(F.col("turn") / 4)


@query
def author_text(spark, folder):
    turns = table(spark, folder, "conversations")
    return cohort.author_text(turns, ["turn"], _turn_slice(), "conv_id")


@query
def author_slices(spark, folder):
    turns = table(spark, folder, "conversations")
    return cohort.author_slices(turns, ["turn"], _turn_slice(), "conv_id")


@query
def author_last_tokens(spark, folder):
    turns = table(spark, folder, "conversations")
    return cohort.author_tail(turns, ["turn"], _turn_slice(), 40, "conv_id")


@query
def cut_author_text(spark, folder):
    """Cut, concat and label in one: event types as texts."""
    kept = cohort.cut_by_time(timeline(spark, folder), ["signup"], "user_id", "event_type", "ts")
    return cohort.author_text(kept, ["ts", "event_id"], cohort.time_slice(F.col("ts")), "user_id", "event_type")


# --- words -----------------------------------------------------------------


@query
def word_count(spark, folder):
    return wd.word_counts(class_words(spark, folder))


@query
def word_shares(spark, folder):
    shares = wd.word_shares(class_words(spark, folder))
    one_sided = (F.col("count_a") == 0) | (F.col("count_b") == 0)
    return shares.withColumn("ratio", F.when(F.col("count_b") > 0, F.col("ratio"))).withColumn(
        "one_sided", one_sided.cast("int")
    )


@query
def word_metric(spark, folder):
    return word_table(spark, folder).select("word", F.round(F.col("metric") * 1e9, 4).alias("metric"))


@query
def share_extents(spark, folder):
    extents = wd.share_extents(wd.word_shares(class_words(spark, folder)))
    return extents.select(*(rounded(c, 12) for c in extents.columns))


@query
def share_hist2d(spark, folder):
    return wd.share_histogram(wd.word_shares(class_words(spark, folder)))


@query
def top_words(spark, folder):
    return wd.top_words(wd.word_counts(class_words(spark, folder)))


@query
def top_words_absolute(spark, folder):
    picked = wd.top_words_absolute(word_table(spark, folder))
    return picked.select("rule", "rank", "word", rounded("score"))


@query
def top_words_banded(spark, folder):
    picked = wd.top_words_banded(word_table(spark, folder))
    return picked.select("rule", "band", "rank", "word", rounded("score"))


@query
def top_words_metric(spark, folder):
    picked = wd.top_words_metric(word_table(spark, folder))
    return picked.select("rank", "word", F.round(F.col("score") * 1e9, 4).alias("metric"))


@query
def top_words_all(spark, folder):
    return wd.top_words_all(word_table(spark, folder)).select("word", "rule", "band", "rank")


# --- affects and tests -----------------------------------------------------


@query
def affect_wide(spark, folder):
    wide = affects(spark, folder)
    return wide.select("doc_id", *(rounded(name) for name in EMOTIONS + POLARITIES))


@query
def affect_per_post(spark, folder):
    return affect.affect_per_post(affects(spark, folder), ["doc_id"]).select("doc_id", "affect", rounded("freq"))


@query
def emotion_scores(spark, folder):
    return affect.emotion_scores(affects(spark, folder)).select("emotion", rounded("percentage"), "class")


@query
def polarity_scores(spark, folder):
    return affect.polarity_scores(affects(spark, folder)).select("emotion", rounded("percentage"), "class")


def _tested(spark, folder):
    long = affect.affect_per_post(affects(spark, folder), ["doc_id", "class"])
    return ranksum.mann_whitney(long, "affect", "freq", F.col("class") == "a")


@query
def mann_whitney(spark, folder):
    return _tested(spark, folder).select("feature", "n1", "n2", "u", rounded("z"))


@query
def mann_whitney_p(spark, folder):
    return ranksum.with_p_value(_tested(spark, folder)).select("feature", rounded("z"), rounded("p", 7))


@query
def mann_whitney_exact(spark, folder):
    """Each customer's prices of finished orders against those of the others: small groups, so p is exact."""
    orders = table(spark, folder, "orders").where(F.col("o_custkey").isNotNull())
    tested = ranksum.mann_whitney(orders, "o_custkey", "o_totalprice", F.col("o_orderstatus") == "F")
    small = tested.where(~F.col("tied") & F.least("n1", "n2").between(1, 8))
    return ranksum.with_p_value(small).where("exact").select("feature", "n1", "n2", "u", rounded("p"))


def _tfidf(spark: SparkSession, folder: str) -> DataFrame:
    """Averages from stored tallies, so that the texts are tokenised once."""
    path = _scratch(spark, "tallies")
    tallies = tables.materialize(spark, path, lambda: tfidf.word_tallies(class_documents(spark, folder), "doc_id"))
    return tfidf.tfidf_average(tfidf.tfidf_weights(tallies, "doc_id", folder=shared_folder(spark)))


@query
def tfidf_avg(spark, folder):
    averages = _tfidf(spark, folder)
    return averages.select("class", "word", rounded("tfidf"))


@query
def tfidf_top_terms(spark, folder):
    averages = _tfidf(spark, folder)
    return tfidf.tfidf_top_terms(averages).select("class", "word", rounded("tfidf"))


# --- embeddings, classifier, scores ----------------------------------------


@query
def embedding_dataset(spark, folder):
    vectors = table(spark, folder, "embeddings").withColumnRenamed("label", "kind")
    parts = {1: vectors.where(F.col("kind") < 4), 0: vectors.where(F.col("kind") >= 4)}
    stored = embedding.labelled_dataset(parts, text="kind")
    return stored.select("vec_id", F.size("embedding").alias("dim"), "label")


@query
def one_hot(spark, folder):
    rows = table(spark, folder, "embeddings").select("vec_id", (F.col("label") < 4).cast("int").alias("label"))
    hot = embedding.one_hot(rows)
    return hot.select("vec_id", F.col("target")[0].alias("target_0"), F.col("target")[1].alias("target_1"))


@query
def embed_texts(spark, folder):
    docs = cohort.author_text(table(spark, folder, "conversations"), ["turn"], _turn_slice(), "conv_id")
    return embedding.embed_hashed(docs).select("conv_id", "embedding")


@query
def trained_texts(spark, folder):
    """Documents as means of word vectors learnt from them: how many of their words are known, and that the means are unit vectors."""
    docs, work = texts(spark, folder, "documents", "doc_id", "text"), shared_folder(spark)
    vectors = write_once(embedding.train_word_vectors(docs, size=16, min_count=40), work, "vectors")
    found = embedding.embed_averaged(docs, vectors, "doc_id", 16, folder=work)
    words = tx.pieces_by_word(docs, "doc_id")
    vocabulary = embedding.with_share(vectors).select("word", "share")
    known = lookup_join(words, vocabulary, ["word"], "inner", salt_by=["doc_id"], folder=work, often="share")
    known = known.select(F.inline(F.arrays_zip("doc_id", "tf"))).groupBy("doc_id").agg(F.sum("tf").alias("known"))
    norm = F.aggregate("embedding", F.lit(0.0), lambda total, x: total + x * x)
    rows = found.join(known, "doc_id", "left").withColumn("known", F.coalesce("known", F.lit(0)))
    return rows.select(
        "doc_id", "known", F.size("embedding").alias("dim"),
        F.when(F.col("known") == 0, norm == 0).otherwise(F.abs(norm - 1) < 1e-5).alias("is_unit"),
    )


@query
def encoded_texts(spark, folder):
    """An encoder that can be checked: a text's length and its number of blanks."""

    def make_predict():
        import numpy as np

        def predict(texts):
            return np.array([[len(text), text.count(" ")] for text in texts], "float32").reshape(len(texts), 2)

        return predict

    vectors = embedding.embed_with(texts(spark, folder, "documents", "doc_id", "text"), make_predict)
    return vectors.select(
        "doc_id", F.col("embedding")[0].cast("long").alias("chars"), F.col("embedding")[1].cast("long").alias("blanks")
    )


@query
def mlp_checks(spark, folder):
    """What must hold for the classifier's answers on the test part, whatever it learnt."""
    p = F.col("probability")
    return mlp_predict(spark, folder).select(
        "vec_id", "label", (F.abs(p[0] + p[1] - 1) < 1e-9).alias("adds_up"),
        (F.col("prediction") == F.when(p[1] > p[0], 1).otherwise(0)).alias("is_argmax"),
    )


@query
def mlp_predict(spark, folder):
    rows = table(spark, folder, "embeddings").withColumn("label", (F.col("label") < 4).cast("int"))
    split = sampling.hash_split(rows, "vec_id")
    model = classifier.train(split.where("split = 'train'"), 64)
    return classifier.predict(model, split.where("split = 'test'")).select("vec_id", "label", "probability", "prediction")


def _network(spark, folder):
    """Two epochs over the embeddings."""
    rows = table(spark, folder, "embeddings").withColumn("label", (F.col("label") < 4).cast("int"))
    plan = network.Plan(64, (32, 16, 8), batch=128)
    return jobs.classify_with_network(spark, rows, _scratch(spark, "network"), plan, 2, "vec_id")


@query
def network_history(spark, folder):
    return _network(spark, folder)[2]


@query
def network_checks(spark, folder):
    """What must hold for a network's answers on the test part, whatever it learnt."""
    p = F.col("probability")
    return _network(spark, folder)[0].select(
        "vec_id", "label", (F.abs(p[0] + p[1] - 1) < 1e-9).alias("adds_up"),
        (F.col("prediction") == F.when(p[1] > p[0], 1).otherwise(0)).alias("is_argmax"),
    )


@query
def argmax_class(spark, folder):
    return scored(spark, folder).select("vec_id", "prediction")


@query
def class_metrics(spark, folder):
    found = evaluate.class_metrics(scored(spark, folder))
    return found.select("class", *(rounded(name) for name in evaluate.MEASURES))


@query
def batch_metrics(spark, folder):
    found = evaluate.batch_metrics(scored(spark, folder), "vec_id", 64)
    return found.select("class", *(rounded(name) for name in evaluate.MEASURES))


@query
def roc_auc(spark, folder):
    return evaluate.roc_auc(scored(spark, folder), "label", "score").select("n1", "n2", rounded("roc_auc"))


@query
def accuracy_pct(spark, folder):
    return evaluate.accuracy_pct(scored(spark, folder)).select("total", "correct", rounded("accuracy"), "accuracy_whole")


@query
def result_report(spark, folder):
    return evaluate.report(scored(spark, folder)).select("accuracy", rounded("f1"), rounded("roc_auc"))
