import heapq
import unicodedata

import numpy as np
import pytest
from pyspark.sql import functions as F

from catalog.queries import QUERIES
from tidemark import sizes
from tidemark.functions import text as tx
from tidemark.operators import embedding, skipgram


def model(counts, size=4, seed=1):
    order, parent, side = skipgram.ordered_tree(np.array(counts))
    made = skipgram.SkipGram(parent, side, size, seed)
    made.path, made.sign = skipgram.tree_paths(parent, side, np.arange(len(counts)), made.depth)
    return made, np.argsort(order)


def test_tree_is_huffmans():
    counts = [int(n) for n in np.random.default_rng(3).zipf(1.4, 200)]
    made, label = model(counts)
    heap, least = counts.copy(), 0
    heapq.heapify(heap)
    while len(heap) > 1:
        pair = heapq.heappop(heap) + heapq.heappop(heap)
        least += pair
        heapq.heappush(heap, pair)
    assert sum(counts[word] * made.depth[label[word]] for word in range(200)) == least
    codes = [tuple(zip(nodes[: int(n)].tolist(), signs[: int(n)].tolist())) for nodes, signs, n in zip(made.path, made.sign, made.depth)]
    assert len(set(codes)) == 200 and all(len(code) == len({node for node, _ in code}) for code in codes)
    # In the order of the leaves the words below a node lie side by side.
    for node in range(199):
        below = [word for word, code in enumerate(codes) if node in dict(code)]
        assert below == list(range(below[0], below[-1] + 1))


def by_hand(made, sentences, reaches, rate):
    """All pairs of a block one by one, from the values before it."""
    context, node = made.context.astype(float), made.node.astype(float)
    move_c, move_n, curve_c, curve_n = np.zeros_like(context), np.zeros_like(node), np.zeros(len(context)), np.zeros(len(node))
    for sentence in sentences:
        for at, centre in enumerate(sentence):
            for other in range(max(0, at - reaches), min(len(sentence), at + reaches + 1)):
                if other == at:
                    continue
                c = sentence[other]
                for n, sign in zip(made.path[centre][: made.depth[centre]], made.sign[centre]):
                    g = (sign > 0) - 1 / (1 + np.exp(-context[c] @ node[n]))
                    move_c[c] += rate * g * node[n]
                    move_n[n] += rate * g * context[c]
                    curve_c[c] += rate * skipgram.CONTEXT_CURVATURE * node[n] @ node[n]
                    curve_n[n] += rate * skipgram.NODE_CURVATURE * context[c] @ context[c]
    return (
        context + move_c * skipgram.shortened(curve_c)[:, None],
        node + move_n * skipgram.shortened(curve_n)[:, None],
    )


@pytest.mark.parametrize("reach", [1, 3, 5])
def test_block_trains_every_pair(reach):
    pick = np.random.default_rng(reach)
    counts = [900, 400, 50, 30, 20, 9, 5, 2]
    made, _ = model(counts)
    made.node[:-1] = pick.normal(0, 0.5, made.node[:-1].shape)

    class Fixed:
        def integers(self, low, high, size):
            return np.full(size, reach)

    made.reaches = Fixed()
    sentences = [pick.choice(8, n, p=np.array(counts) / sum(counts)).astype(np.int32) for n in (90, 1, 2, 7, 40)]
    context, node = by_hand(made, sentences, reach, 0.02)
    flat = skipgram.with_gaps(np.concatenate(sentences), np.array([len(s) for s in sentences]), made.words)
    made.train_block(flat, 0.02)
    np.testing.assert_allclose(made.context, context, atol=2e-5)
    np.testing.assert_allclose(made.node, node, atol=2e-5)
    assert set(np.flatnonzero(made.changed)) == set(np.concatenate([s for s in sentences if len(s) > 1]))


@pytest.mark.parametrize("text", [[0, 1], [0] * 99 + [1], [0, 1, 2], list(range(50))])
def test_large_blocks_of_few_words_stay_bounded(text):
    """Thousands of pairs of a block move the same values, which must not run away."""
    words = np.tile(np.array(text, np.int32), 300_000 // len(text))
    made, label = model(np.bincount(words).tolist(), 16)
    lengths = np.full(len(words) // 1000, 1000)
    made.train([(label[words[: lengths.sum()]].astype(np.int32), lengths)], len(words))
    assert np.isfinite(made.context).all() and np.abs(made.context).max() < 10 > np.abs(made.node).max()


def test_blocks_hold_all_sentences():
    pick = np.random.default_rng(0)
    lengths = pick.integers(0, 2500, 300)
    labels = np.arange(lengths.sum())
    packs = list(skipgram.packed_sentences(labels, lengths))
    assert (np.concatenate([part for part, _ in packs]) == labels).all()
    cut = np.concatenate([part for _, part in packs])
    assert cut.max() == skipgram.SENTENCE and set(np.cumsum(lengths)) <= {0, *np.cumsum(cut)}
    assert all(len(part) == counts.sum() <= skipgram.PACK + skipgram.SENTENCE for part, counts in packs)
    blocks = list(skipgram.blocks(packs, 20_000))
    assert (np.concatenate([part for part, _ in blocks]) == labels).all()
    assert (np.concatenate([part for _, part in blocks]) == cut).all()
    assert all(len(part) == counts.sum() for part, counts in blocks)
    assert len(blocks[0][0]) <= 1000 < 10_000 < max(len(part) for part, _ in blocks) <= 20_000
    assert list(skipgram.packed_sentences(np.array([], int), np.array([0, 0]))) == [] == list(skipgram.blocks([], 10))


def test_pieces_are_counted_as_by_spark(spark):
    """Arrow's white space and Spark's are the same, also the rare ones; rows keep to themselves."""
    blanks = [chr(c) for c in range(0x110000) if unicodedata.category(chr(c)).startswith("Z") or c in (*range(9, 14), *range(28, 32), 0x85)]
    near = ["​", "᠎", "﻿", "\x00", "\x1b", "⁠"]
    rows = [(k, f"{c}A{c}{c}b x{c}a") for k, c in enumerate(blanks + near)] + [(7, "İ ß É b"), (7, ""), (None, " b B "), (9000, None)]
    docs = spark.createDataFrame(rows, "id int, text string").repartition(3)
    want = tx.tally_words(docs.select("id", tx.pieces(F.lower("text")).alias("words")), ["id"])
    got = tx.tally_pieces(docs, ["id"])
    assert got.schema.simpleString() == want.schema.simpleString()
    assert sorted(map(str, got.collect())) == sorted(map(str, want.collect()))
    grouped = tx.pieces_by_word(docs, "id")
    apart = grouped.select("word", F.inline(F.arrays_zip("id", "tf"))).select("id", "word", "tf")
    assert sorted(map(str, apart.collect())) == sorted(map(str, want.collect()))
    assert grouped.count() < apart.count()


def test_texts_add_up_alike_whatever_fits(spark, monkeypatch, tmp_path):
    pick = np.random.default_rng(2)
    rows = [(int(k) if k else None, " ".join(pick.choice(["a", "b", "c", "Dd", "e"], n))) for k, n in zip(pick.integers(0, 20, 40), pick.integers(0, 30, 40))]
    docs = spark.createDataFrame([*rows, (50, None), (51, "zz")], "id int, text string")
    vectors = embedding.train_word_vectors(docs, size=3, min_count=1, partitions=2).cache()
    monkeypatch.setattr(embedding, "ADDED_WORDS", 16)
    found = []
    for folder, most in ((None, 10**6), (str(tmp_path), 10**6), (str(tmp_path), 0.2)):
        monkeypatch.setattr(sizes, "BROADCAST_ROWS", most)
        monkeypatch.setattr(sizes, "BROADCAST_BYTES", 100 * most)
        rows = embedding.embed_averaged(docs, vectors, "id", 3, folder=folder).collect()
        found.append(sorted((row.id or 0, row.text or "", row.embedding) for row in rows))
    for other in found[1:]:
        assert [row[:2] for row in found[0]] == [row[:2] for row in other]
        np.testing.assert_allclose([row[2] for row in found[0]], [row[2] for row in other], atol=1e-6)


def test_words_without_neighbours_and_without_words(spark):
    docs = spark.createDataFrame([("one",), ("one",), ("",), (None,)], "text string")
    rows = embedding.train_word_vectors(docs, size=4, min_count=2, partitions=3).collect()
    assert [row.word for row in rows] == ["one"] and len(rows[0].vector) == 4 and rows[0].vector.norm(2) > 0
    assert rows[0].weight == pytest.approx(1e-3 / 1.001)
    with pytest.raises(ValueError):
        embedding.train_word_vectors(docs, min_count=3)


def test_trained_texts_send_no_single_words_to_rows(spark, tmp_path, monkeypatch):
    """Words are counted and trained in Arrow batches: no row for each word, and no training by Spark ML in the driver's JVM."""
    texts = [(k, " ".join(["the"] * 50 + [f"w{k % 3}"] * 30 + ["rare"] * (k % 2))) for k in range(30)]
    spark.createDataFrame(texts, "doc_id bigint, text string").write.parquet(f"{tmp_path}/documents.parquet")
    ran = []
    monkeypatch.setattr("pyspark.ml.feature.Word2Vec.fit", lambda *a: ran.append(a))
    found = QUERIES["trained_texts"](spark, str(tmp_path))
    assert not ran and "explode(" not in found._jdf.queryExecution().executedPlan().toString()
    assert sorted(tuple(row) for row in found.collect()) == [(k, 80, 16, True) for k in range(30)]
