"""Whole jobs: acquire authors, count new users, compare cohorts, embed, classify.

Each step that several later steps read is stored below ``folder``, which must be
storage all executors share (see :func:`tidemark.session.shared_folder`).  ``tag``
names the input: with another tag, or other parameters, the steps are built anew in
the same folder instead of being taken from the earlier run.
:func:`tidemark.sources.tables.input_tag` makes one from the input's files.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions.fixed_values import ENCODER_TOKENS, EPOCHS, PLACEHOLDER_AUTHOR
from tidemark.functions.text import (
    clean_text,
    default_stopwords,
    join_fields,
    lemmatise_arrays,
    token_source,
    word_array,
)
from tidemark.operators import affect, classifier, cohort, embedding, evaluate, network, ranksum, sampling, tfidf, words
from tidemark.operators.activity import distinct_authors, event_window, new_users
from tidemark.sources.tables import materialize

Cut = Callable[..., DataFrame]


def acquire_authors(
    posts: DataFrame, folder: str, n: int, author: str = "author", tag: str = ""
) -> tuple[DataFrame, DataFrame]:
    """Sample ``n`` authors and select all their posts."""
    spark = posts.sparkSession
    everyone = materialize(spark, f"{folder}/authors", lambda: distinct_authors(posts, author), author, tag)
    chosen = materialize(spark, f"{folder}/sampled", lambda: sampling.sample_n(everyone, author, n), author, n, tag)
    return chosen, cohort.posts_of_authors(posts, chosen, author)


def acquire_cohort(
    comments: DataFrame,
    submissions: DataFrame,
    communities: DataFrame,
    folder: str,
    n: int,
    file: str = "file",
    tag: str = "",
) -> DataFrame:
    """Comments of ``n`` sampled author files, with their authors' submissions.

    An author's submissions come from the first community, in the order of
    ``communities`` ``(community, priority)``, that has any; both inputs carry
    the community whose folder they lie in.
    """
    sample = f"{folder}/files"
    files = materialize(comments.sparkSession, sample, lambda: sampling.sample_n(comments, file, n), file, n, tag)
    picked = cohort.posts_of_authors(comments, files, file)
    ranked = submissions.join(communities, "community")
    return cohort.with_companions(picked, ranked, folder=folder)


def new_user_curve(posts: DataFrame, event: Column, days: int = 60, grain: str | None = "day") -> DataFrame:
    """New users per day around an event, from dated posts ``(uid, date)``."""
    return new_users(event_window(posts, event, days), grain=grain)


def tokenised_posts(
    cohort_a: DataFrame,
    cohort_b: DataFrame,
    communities: Sequence[str] | DataFrame,
    key: str,
    stopwords: Sequence[str] | None = None,
    cut: Cut = cohort.cut_by_time,
    fraction: float | None = None,
    file: str = "file",
    lemmas: DataFrame | None = None,
    folder: str | None = None,
) -> DataFrame:
    """``(key, class, words)`` of both cohorts; the first is cut at first membership.

    ``fraction`` first samples that part of each file's posts.  With ``lemmas``
    ``(surface, lemma)`` the kept words are then replaced by their lemmas; ``key`` must
    be unique for that (see :func:`tidemark.sources.posts.with_post_id`).
    """
    stop = default_stopwords() if stopwords is None else stopwords
    if fraction is not None:
        cohort_a, cohort_b = (sampling.sample_fraction(df, file, key, fraction, folder=folder) for df in (cohort_a, cohort_b))
    both = cohort.label_cohorts({"a": cut(cohort_a, communities, folder=folder), "b": cohort_b})
    source = token_source(F.col("body"), F.col("selftext"), F.col("title"))
    found = both.select(key, "class", word_array(source, stop).alias("words"))
    return found if lemmas is None else lemmatise_arrays(found, lemmas, [key, "class"], folder=folder)


def compare_cohorts(
    tokens: DataFrame, lexicon: DataFrame, folder: str, key: str, tag: str = ""
) -> dict[str, DataFrame]:
    """All comparison tables of two tokenised cohorts."""
    spark = tokens.sparkSession
    # Posts without words are dropped after the tokens are stored: before, the
    # filter would be pushed down and every text tokenised twice.
    stored = materialize(spark, f"{folder}/tokens", lambda: tokens, key, tag).where(F.size("words") > 0)
    single = stored.select("class", F.explode("words").alias("word"))
    table = materialize(spark, f"{folder}/word_table", lambda: words.word_metric(words.word_shares(single)), tag)
    wide = materialize(spark, f"{folder}/affects", lambda: affect.affect_wide(stored, lexicon, [key, "class"]), key, tag)
    tallies = materialize(spark, f"{folder}/tallies", lambda: tfidf.word_tallies(stored, key), key, tag)
    averages = materialize(
        spark, f"{folder}/tfidf", lambda: tfidf.tfidf_average(tfidf.tfidf_weights(tallies, key, folder=folder)), key, tag
    )
    by_affect = affect.affect_per_post(wide, [key, "class"])
    tested = ranksum.mann_whitney(by_affect, "affect", "freq", F.col("class") == "a")
    return {
        "top_words": words.top_words(words.counts_of(table)),
        "word_table": table,
        "selected_words": words.top_words_all(table),
        "extents": words.share_extents(table),
        "histogram": words.share_histogram(table),
        "emotions": affect.emotion_scores(wide),
        "polarities": affect.polarity_scores(wide),
        "rank_tests": ranksum.with_p_value(tested),
        "tfidf_terms": tfidf.tfidf_top_terms(averages),
    }


def author_documents(
    posts: DataFrame,
    communities: Sequence[str] | DataFrame | None,
    post_id: str,
    n_tokens: int | None = ENCODER_TOKENS,
    cut: Cut = cohort.cut_by_time,
    exclude: str | None = PLACEHOLDER_AUTHOR,
    folder: str | None = None,
) -> DataFrame:
    """One cleaned document per author, cut at first membership if communities are given.

    ``n_tokens`` keeps what an encoder of that input length can use; None keeps
    the whole document, which must then fit one row.  Posts of the placeholder
    author ``exclude`` belong to nobody and are left out.
    """
    named = posts if exclude is None else posts.where(F.col("author") != exclude)
    kept = cut(named, communities, folder=folder) if communities is not None else named
    cleaned = [clean_text(F.col(c)) for c in ("body", "selftext", "title")]
    texts = kept.select("author", "created_utc", post_id, join_fields(*cleaned).alias("text"))
    slices = cohort.time_slice(F.col("created_utc"))
    order = ["created_utc", post_id]
    if n_tokens is None:
        return cohort.author_text(texts, order, slices)
    return cohort.author_tail(texts, order, slices, n_tokens, folder=folder)


def embed_cohorts(
    cohort_a: DataFrame,
    cohort_b: DataFrame,
    communities: Sequence[str] | DataFrame,
    post_id: str,
    encode: Callable[[DataFrame], DataFrame] = embedding.embed_hashed,
    users: int | None = None,
    at_least: int = 1,
    folder: str | None = None,
) -> DataFrame:
    """``(author, embedding, label)``: the cut cohort is label 1, the control 0.

    ``users`` takes that many authors of each cohort, the first by name among those
    with ``at_least`` posts.
    """
    if users is not None:
        named = (df.where(F.col("author") != PLACEHOLDER_AUTHOR) for df in (cohort_a, cohort_b))
        cohort_a, cohort_b = (sampling.capped_active_users(df, "author", users, at_least) for df in named)
    documents = {
        1: author_documents(cohort_a, communities, post_id, folder=folder),
        0: author_documents(cohort_b, None, post_id, folder=folder),
    }
    return embedding.labelled_dataset({label: encode(docs) for label, docs in documents.items()})


def classify(
    spark: SparkSession, dataset: DataFrame, folder: str, size: int, key: str = "author", tag: str = "", **training
) -> tuple[DataFrame, DataFrame]:
    """Train on 80 %, predict the rest; returns predictions and the report."""
    split = materialize(spark, f"{folder}/split", lambda: sampling.exact_split(dataset, key), key, tag)
    model = classifier.train(split.where("split = 'train'"), size, **training)
    test = split.where("split = 'test'").drop("split")
    scored = materialize(
        spark,
        f"{folder}/predictions",
        lambda: classifier.predict(model, test).withColumn("score", F.col("probability")[1]),
        size, training, key, tag,
    )
    return scored, evaluate.report(scored)


def classify_with_network(
    spark: SparkSession,
    dataset: DataFrame,
    folder: str,
    plan: network.Plan,
    epochs: int = EPOCHS,
    key: str = "author",
    tag: str = "",
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """As :func:`classify` with the network of mini-batches; returns predictions, the report and a history per epoch."""
    split = materialize(spark, f"{folder}/split", lambda: sampling.exact_split(dataset, key), key, tag)
    train, test = (split.where(F.col("split") == part).drop("split") for part in ("train", "test"))
    state, history = network.train_network(train, test, folder, plan, epochs, key, tag=tag)
    answer = classifier.argmax_class(F.col("probability"))
    scored = materialize(
        spark,
        f"{folder}/network-predictions",
        lambda: network.predict_network(plan, state, test).withColumn("prediction", answer).withColumn("score", F.col("probability")[1]),
        plan, epochs, key, tag,
    )
    return scored, evaluate.report(scored), history
