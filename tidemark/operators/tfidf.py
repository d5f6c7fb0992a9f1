"""Average TF-IDF of a class's words.

Weights follow the usual smoothed form: ``ln((1 + n) / (1 + df)) + 1`` times the
raw count, scaled to length 1 per document, averaged over all documents of the
class.  ``n`` and ``df`` are those of the class.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.fixed_values import TFIDF_PICKS
from tidemark.functions.text import tally_words
from tidemark.sizes import lookup_join


def word_tallies(docs: DataFrame, doc: str, words: str = "words", label: str = "class") -> DataFrame:
    """One row per class, document and different word, with its count ``tf``.

    ``docs`` holds one row per document with its word array; documents without
    words do not count.  ``lead`` marks one word of each document.  The weights read
    this table three times, so store it: the texts are then tokenised once.
    """
    return tally_words(docs, [label, doc], words, lead="lead")


def tfidf_weights(tallies: DataFrame, doc: str, label: str = "class", folder: str | None = None) -> DataFrame:
    """One normalised weight per class, document and word, from :func:`word_tallies`.

    Two narrow tables are joined to the tallies: a weight for each word, and a length for each
    document, which its words add up to within their partition.  With a ``folder`` that
    all executors share both are stored there and measured; what fits is broadcast,
    so that the tallies themselves are not shuffled at all.  Of more words than fit the
    most frequent are broadcast and the tallies of the others shuffled by the word; of more
    documents than fit the tallies are shuffled by the document.
    """
    frequency = tallies.groupBy(label, "word").agg(F.count("*").alias("df"))
    # One row per class.
    sizes = tallies.groupBy(label).agg(F.count_if("lead").alias("n"))
    idf = frequency.join(F.broadcast(sizes), label).select(
        label, "word", "n", "df", (F.log((1 + F.col("n")) / (1 + F.col("df"))) + 1).alias("idf")
    )
    weighted = lookup_join(tallies, idf, ["word", label], "inner", salt_by=[doc], folder=folder, often="df")
    weighted = weighted.select(label, doc, "word", "n", (F.col("tf") * F.col("idf")).alias("w"))
    lengths = weighted.groupBy(doc, label).agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("_length"))
    scaled = lookup_join(weighted, lengths, [doc, label], "inner", salt_by=["word"], folder=folder)
    return scaled.select(label, doc, "word", "n", (F.col("w") / F.col("_length")).alias("weight"))


def tfidf_average(weights: DataFrame, label: str = "class") -> DataFrame:
    """Mean weight of each word over all documents of its class."""
    return weights.groupBy(label, "word", "n").agg(F.sum("weight").alias("_sum")).select(
        label, "word", (F.col("_sum") / F.col("n")).alias("tfidf")
    )


def tfidf_top_terms(averages: DataFrame, k: int = TFIDF_PICKS, label: str = "class") -> DataFrame:
    """Rows of every word that is among the top ``k`` of any class."""
    # Sums of doubles vary in the last digit with the order of rows; ranks must not.
    order = Window.partitionBy(label).orderBy(F.round("tfidf", 12).desc(), "word")
    heads = averages.withColumn("_rank", F.row_number().over(order)).where(F.col("_rank") <= k)
    # At most k words per class.
    chosen = heads.select("word").distinct()
    return averages.join(F.broadcast(chosen), "word", "left_semi").select(*averages.columns)
