import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pytest
from brute import NGrams
from pyspark.sql import functions as F

from tidemark.llm import chunks, ngrams, queries


@pytest.mark.parametrize(("order", "chunk"), [(1, 4 << 20), (2, 20_000), (3, 50_000)])
def test_scores_against_brute_force(small, monkeypatch, order, chunk):
    monkeypatch.setattr(chunks, "CHUNK_BYTES", chunk)
    docs = small("documents").withColumn("learn", F.col("doc_id") % 7 != 2)
    texts = {row.doc_id: row.text for row in docs.collect()}
    model = NGrams([text for key, text in texts.items() if key % 7 != 2], order)
    rows = ngrams.score_texts(docs, "learn", order=order).collect()
    assert len(rows) == len(texts)
    for row in rows:
        tokens = model.tokens(texts[row.doc_id])[1:]
        assert (row.n_tokens, row.train_tokens) == (len(tokens), model.total)
        assert row.n_known == sum(model.count[1][(token,)] > 0 for token in tokens)
        assert row.base_score == pytest.approx(model.score(texts[row.doc_id], 1))
        assert row.score == pytest.approx(model.score(texts[row.doc_id]))


def test_query_uses_two_words_of_context(spark, small):
    texts = {row.doc_id: row.text for row in small("documents").collect()}
    rows = queries.QUERIES["op2_lm_score"](spark, "/root/testdata/sf0.001").collect()
    model = NGrams([texts[row.doc_id] for row in rows if not row.held_out], 3)
    assert [row.score for row in rows] == pytest.approx([model.score(texts[row.doc_id]) for row in rows])


def test_odd_rows(texts_frame):
    texts = [None, "", " ", "a a a", "A a", "b"]
    docs = texts_frame(texts).withColumn("learn", F.col("doc_id") < 5)
    model = NGrams(texts[:5], 2)
    rows = ngrams.score_texts(docs, "learn").orderBy("doc_id").collect()
    assert [row.n_tokens for row in rows] == [1, 1, 1, 4, 3, 2]
    assert [row.score for row in rows] == pytest.approx([model.score(text) for text in texts])
    assert ngrams.score_texts(docs.limit(0), "learn").count() == 0
    nothing = ngrams.score_texts(docs.withColumn("learn", F.lit(False)), "learn").collect()
    assert {row.score for row in nothing} == {0.0} and {row.train_tokens for row in nothing} == {0}


def test_totals_above_four_bytes(spark):
    """Sums of counts are whole numbers of 64 bits, wherever they go."""
    keys = np.array([5, 9, 1 << 63], np.uint64)
    rows = [row for chunk in range(3) for row in chunks.ask(chunk, 1, keys, np.array([1, 1 << 31, 3_000_000_000]), 1)]
    asked = spark.createDataFrame([tuple(bytes(v) if isinstance(v, bytes) else v for v in row) for row in rows], chunks.ASKED)
    table = chunks.totals(asked, 1).where("_chunk = 2").toArrow()
    answers = chunks.Answers(table)
    assert answers.totals(1).tolist() == [3, 3 << 31, 9_000_000_000]
    assert answers.corpus(1) == (3, 3 + (3 << 31) + 9_000_000_000) and answers.first(1).tolist() == [False] * 3


def test_numbered_equals_unique():
    keys = np.random.default_rng(5).integers(0, 1 << 63, 1000).astype(np.uint64)
    alike = np.concatenate([keys, keys[:300], keys[0] ^ np.arange(50, dtype=np.uint64)[::-1]])
    for found in (alike, keys[:1], keys[:0]):
        for got, expected in zip(ngrams.numbered(found), np.unique(found, return_inverse=True), strict=True):
            assert got.tolist() == expected.tolist()


def test_long_ngrams_told_by_shorter_ones_are_not_asked_about(spark):
    """Of three chunks' triples those with a pair of one chunk, or one never learnt, are known, and all totals are right."""
    texts = [["a b c d", "x y z x y z"], ["a b c e", "p q r"], ["a b c d", "held x y out out out"]]
    learnt = [[True, True], [True, True], [True, False]]
    made = [ngrams.Chunk(pa.table({"_text": pa.array(part)}), 3) for part in texts]
    learnt = [np.array(part) for part in learnt]

    def rows(sizes, what, again=False):
        found = []
        for number, chunk in enumerate(made):
            for size in sizes:
                mask, counts = what(number, size)
                found += chunks.ask(number, size, chunk.keys[size - 1][mask], counts[mask], 1, press=True, again=again)
        return spark.createDataFrame(chunks.asked_table(found))

    def answers(*tables):
        table = pa.concat_tables(one.toArrow() for one in tables)
        return [chunks.Answers(table.filter(pc.equal(table["_chunk"], number))) for number in range(len(made))]

    counted = [[chunk.counted(size, part) for size in (1, 2, 3)] for chunk, part in zip(made, learnt, strict=True)]
    short = rows((1, 2), lambda n, size: (np.ones(len(made[n].keys[size - 1]), bool), counted[n][size - 1]))
    pairs = chunks.totals(short, 1, press=True)
    known = [ngrams.Known(made[n], learnt[n], found, 2) for n, found in enumerate(answers(pairs))]
    asked = [part.to_ask(3) for part in known]
    # "<s> a b" and "a b c" of all three, "b c d" and "c d </s>" of the first and third; the third has learnt no "held x".
    assert [int(part.sum()) for part in asked] == [4, 2, 4]
    triples = chunks.totals(rows((3,), lambda n, size: (asked[n], counted[n][2])), 1, press=True)
    whole = [ngrams.Known(made[n], learnt[n], found, 3) for n, found in enumerate(answers(pairs, triples))]
    model = NGrams([text for part, use in zip(texts, learnt, strict=True) for text, used in zip(part, use, strict=True) if used], 3)

    def expected(number, size, value):
        """By n-gram of a chunk: what the plain model has for it."""
        flat = [token for text in texts[number] for token in model.tokens(text)]
        at = made[number].at[size - 1]
        return {int(at[k]): value(tuple(flat[k - size + 1 : k + 1])) for k in np.flatnonzero(at >= 0)}

    for number, part in enumerate(whole):
        for size in (1, 2, 3):
            assert dict(enumerate(part.total[size - 1].tolist())) == expected(number, size, lambda gram: model.count[len(gram)][gram])
    sent = rows((1, 2), lambda n, size: (whole[n].asked[size - 1], whole[n].own_followers(size) * whole[n].spread(size)), again=True)
    assert sent.where("length(_keys) > 0").count() == 0
    more = chunks.totals_again(short, sent, ngrams.FOLLOWERS)
    for number, found in enumerate(answers(pairs, triples, more)):
        for size in (1, 2):
            followers = whole[number].followers(size, found)
            grams = expected(number, size, lambda gram: gram)
            contexts = [k for k, gram in grams.items() if gram[-1] != "</s>"]
            assert [followers[k] for k in contexts] == [model.followers[grams[k]] for k in contexts]
