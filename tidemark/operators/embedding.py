"""From author documents to labelled vectors."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.ml.feature import HashingTF, Normalizer
from pyspark.ml.functions import array_to_vector, predict_batch_udf, vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, FloatType, StructField, StructType

from tidemark import sizes
from tidemark.functions.fixed_values import EMBEDDING_SIZE, SPLIT_SEED
from tidemark.functions.text import pieces, tally_pieces
from tidemark.operators.skipgram import SkipGram, counted_pieces, labelled_pieces, ordered_tree, packed_sentences, run_starts, text_rows
from tidemark.sizes import lookup_join, write_once

#: Share of a word from which its weight is less than a half.
SMOOTH = 1e-3
#: Bytes of a row of word vectors on their way from the parts to their mean.
ROW_BYTES = 1 << 20
#: Words whose vectors are added up at once.
ADDED_WORDS = 1 << 15


def embed_with(
    docs: DataFrame,
    make_predict: Callable[[], Callable],
    text: str = "text",
    batch_size: int = 32,
    name: str = "embedding",
    partitions: int | None = None,
) -> DataFrame:
    """Add the vector that an encoder gives each text.

    ``make_predict`` is called once per Python worker; it loads the encoder and
    returns a function from a numpy array of texts to a 2-D float array.  With
    ``partitions`` the documents are spread evenly first, since one encoder call
    costs far more than moving a text.
    """
    encode = predict_batch_udf(make_predict, return_type=ArrayType(FloatType()), batch_size=batch_size)
    spread = docs.repartition(partitions) if partitions else docs
    return spread.withColumn(name, encode(F.col(text)))


def embed_hashed(docs: DataFrame, text: str = "text", size: int = EMBEDDING_SIZE, name: str = "embedding") -> DataFrame:
    """The encoder that needs no model: hashed word counts scaled to length 1."""
    counted = HashingTF(inputCol="_pieces", outputCol="_counts", numFeatures=size).transform(
        docs.withColumn("_pieces", pieces(F.lower(text)))
    )
    scaled = Normalizer(inputCol="_counts", outputCol="_unit").transform(counted)
    return scaled.withColumn(name, vector_to_array("_unit", "float32")).drop("_pieces", "_counts", "_unit")


def train_word_vectors(
    docs: DataFrame, text: str = "text", size: int = 100, min_count: int = 5, partitions: int = 8, seed: int = SPLIT_SEED
) -> DataFrame:
    """Word vectors learnt from the texts: ``word``, ``vector`` and ``weight``.

    The words are those that stand at least ``min_count`` times; the driver holds them and their
    counts, each task their vectors, so ``min_count`` bounds the model: raise it with the corpus.
    Each of the ``partitions`` trains a :class:`~tidemark.operators.skipgram.SkipGram` on its part of
    the texts, and a word's vector is the mean over those that changed it, as in Spark ML's Word2Vec.
    ``weight`` is the smooth inverse frequency ``1e-3 / (1e-3 + share of the word)``.
    Words are counted at once, training runs when the result is used.  Store the result: it is read
    more than once, and training is not repeated then.
    """
    spark, split = docs.sparkSession, docs.select(F.lower(F.coalesce(text, F.lit(""))).alias("_text"))
    counts = split.mapInArrow(counted_pieces, "word string, _n bigint").groupBy("word").agg(F.sum("_n").alias("_n"))
    # The rare ones become one row without a word, so that all words are counted once.
    often = F.when(F.col("_n") >= min_count, F.col("word")).alias("word")
    found = counts.groupBy(often).agg(F.sum("_n").alias("_n")).toArrow()
    kept = found.filter(pc.is_valid(found["word"])).sort_by("word")
    if not len(kept):
        raise ValueError(f"no word stands at least {min_count} times")
    numbers = kept["_n"].to_numpy()
    order, parent, side = ordered_tree(numbers)
    weights = SMOOTH / (SMOOTH + numbers[order] / pc.sum(found["_n"]).as_py())
    shared = spark.sparkContext.broadcast((kept["word"].combine_chunks().take(pa.array(order)), weights, parent, side))
    per_part, rows = float(numbers.sum()) / partitions, max(1, ROW_BYTES // (4 * size))

    def label(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = shared.value[0]
        for batch in text_rows(batches):
            packed = list(packed_sentences(*labelled_pieces(batch.column(0), words)))
            columns = [pa.array([part.tobytes() for part in parts], pa.binary()) for parts in zip(*packed, strict=True)]
            if columns:
                yield pa.RecordBatch.from_arrays(columns, ["_labels", "_lengths"])

    def train(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _, _, parent, side = shared.value
        model = SkipGram(parent, side, size, seed, TaskContext.get().partitionId())
        read = (tuple(np.frombuffer(raw.as_buffer(), np.int32) for raw in row) for b in batches for row in zip(*b.columns, strict=True))
        model.train(read, per_part)
        for at in range(0, model.words, rows):
            part = slice(at, min(at + rows, model.words))
            columns = [[at], [model.context[part].tobytes()], [model.changed[part].tobytes()]]
            yield pa.RecordBatch.from_pydict(dict(zip(("_at", "_vectors", "_changed"), columns, strict=True)))

    def average(parts: pa.Table) -> pa.Table:
        words, weights, _, _ = shared.value
        at = parts["_at"][0].as_py()
        some, total, changes = slice(at, at + rows), 0.0, 0
        for raw, flags in zip(parts["_vectors"], parts["_changed"], strict=True):
            vectors = np.frombuffer(raw.as_buffer(), np.float32).reshape(-1, size).astype(np.float64)
            changed = np.frombuffer(flags.as_buffer(), bool)
            total, changes = total + vectors * changed[:, None], changes + changed
        # A word without a neighbour keeps the vector that all parts began with.
        mean = np.where(changes[:, None] > 0, total / np.maximum(changes, 1)[:, None], vectors)
        ends = pa.array(np.arange(len(mean) + 1) * size, pa.int32())
        lists = pa.ListArray.from_arrays(ends, pa.array(mean.ravel()))
        return pa.table({"word": words[some], "_mean": lists, "weight": weights[some]})

    texts = split.mapInArrow(label, "_labels binary, _lengths binary").repartition(partitions)
    trained = texts.mapInArrow(train, "_at bigint, _vectors binary, _changed binary")
    means = trained.groupBy("_at").applyInArrow(average, "word string, _mean array<double>, weight double")
    return means.select("word", array_to_vector("_mean").alias("vector"), "weight")


def with_share(vectors: DataFrame) -> DataFrame:
    """Word vectors with ``share``, the word's share of all words, that the weight came from."""
    return vectors.withColumn("share", F.lit(SMOOTH) / F.col("weight") - F.lit(SMOOTH))


def embed_averaged(
    docs: DataFrame,
    vectors: DataFrame,
    key: str,
    size: int,
    text: str = "text",
    name: str = "embedding",
    folder: str | None = None,
) -> DataFrame:
    """Add the weighted mean of the vectors of a text's words, scaled to length 1; zeros without a known word.

    ``vectors`` comes from :func:`train_word_vectors`, ``key`` must be unique.  A text's
    words are counted within its row.  With a ``folder`` that all executors share, the
    vectors are measured; if they fit every task gets them and adds up whole texts.  Otherwise
    those of the most frequent words are broadcast, and the other words meet their vectors by word.
    A sum per place of the vector has a fixed size, so a text's words are added up before anything is shuffled.
    """
    shares = with_share(vectors)
    if folder is not None:
        shares = write_once(shares, folder, "shares")
    if folder is not None and _fits_tasks(shares, size):
        parts = _added(docs, shares, key, size, text)
    else:
        tallies = tally_pieces(docs, [key], text)
        found = lookup_join(tallies, shares, ["word"], "inner", salt_by=[key], folder=folder, often="share")
        parts = found.select(key, (F.col("tf") * F.col("weight")).alias("_w"), vector_to_array("vector").alias("_v"))
    sums = parts.groupBy(key).agg(*(F.sum(F.col("_w") * F.get("_v", F.lit(k))).alias(f"_{k}") for k in range(size)))
    # The mean has the direction of the sum.
    sums = sums.select(key, F.array(*(F.col(f"_{k}") for k in range(size))).alias("_sums"))
    sums = sums.withColumn("_norm", F.sqrt(F.aggregate("_sums", F.lit(0.0), lambda total, x: total + x * x)))
    unit = F.transform("_sums", lambda x: F.when(F.col("_norm") > 0, x / F.col("_norm")).otherwise(0.0).cast("float"))
    zeros = F.array_repeat(F.lit(0.0).cast("float"), size)
    both = docs.join(sums.select(key, unit.alias("_found")), key, "left")
    return both.withColumn(name, F.coalesce("_found", zeros)).select(*docs.columns, name)


def _fits_tasks(vectors: DataFrame, size: int) -> bool:
    """Whether words and vectors, packed, stay within the bytes of a broadcast."""
    found = vectors.agg(F.count("*").alias("rows"), F.sum(F.octet_length("word")).alias("bytes")).first()
    return found.rows * (4 * size + 4) + (found.bytes or 0) <= sizes.BROADCAST_BYTES


def _added(docs: DataFrame, vectors: DataFrame, key: str, size: int, text: str) -> DataFrame:
    """The sums of the weighted vectors of each text's words, as ``_v`` with a weight ``_w`` of 1; all tasks get the vectors."""
    table = vectors.select("word", "weight", vector_to_array("vector", "float32").alias("_v")).toArrow()
    weighted = table["_v"].combine_chunks().flatten().to_numpy().reshape(-1, size) * table["weight"].to_numpy()[:, None].astype(np.float32)
    shared = docs.sparkSession.sparkContext.broadcast((table["word"].combine_chunks(), weighted))

    def add(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, weighted = shared.value
        for batch in text_rows(batches):
            labels, lengths = labelled_pieces(batch.column("_text"), words)
            rows, sums = np.repeat(np.arange(len(lengths)), lengths), np.zeros((len(lengths), size))
            for at in range(0, len(labels), ADDED_WORDS):
                some = rows[at : at + ADDED_WORDS]
                starts = run_starts(some)
                found = weighted.take(labels[at : at + ADDED_WORDS], 0)
                sums[some[starts]] += np.add.reduceat(found, starts, axis=0, dtype=np.float64)
            ends = pa.array(np.arange(len(sums) + 1) * size, pa.int32())
            lists = pa.ListArray.from_arrays(ends, pa.array(sums.ravel()))
            yield pa.RecordBatch.from_arrays([batch.column(key), lists], [key, "_v"])

    ready = docs.select(key, F.lower(text).alias("_text"))
    made = ready.mapInArrow(add, StructType([ready.schema[key], StructField("_v", ArrayType(DoubleType()))]))
    return made.withColumn("_w", F.lit(1.0))


def labelled_dataset(cohorts: dict[int, DataFrame], text: str = "text", label: str = "label") -> DataFrame:
    """Union of embedded cohorts with integer labels, without the texts."""
    parts = [df.withColumn(label, F.lit(value).cast("int")).drop(text) for value, df in cohorts.items()]
    together = parts[0]
    for part in parts[1:]:
        together = together.unionByName(part)
    return together


def one_hot(df: DataFrame, label: str = "label", name: str = "target") -> DataFrame:
    """Two-class label as ``[is 0, is 1]``."""
    return df.withColumn(name, F.array(*((F.col(label) == k).cast("float") for k in (0, 1))))
