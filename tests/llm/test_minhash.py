import random

import numpy as np
import pytest
from brute import groups
from pyspark.sql import functions as F

from tidemark.llm import minhash


def odd_texts():
    pick = random.Random(5)
    words = [f"w{k}" for k in range(500)]
    texts = [None, "", " ", "one", "one", "One two", "a b c", "A B C"]
    for _ in range(8):
        base = pick.choices(words, k=pick.randint(5, 150))
        for _ in range(20):
            copy = list(base)
            for _ in range(pick.randint(0, max(1, len(base) // 25))):
                copy[pick.randrange(len(copy))] = pick.choice(words)
            texts.append(" ".join(copy))
    return texts


@pytest.mark.parametrize("size", [4, 5])
def test_groups_against_brute_force(texts_frame, size):
    texts = odd_texts()
    rows = minhash.near_duplicates(texts_frame(texts), size).collect()
    want = groups(enumerate(texts), size)
    assert {row.doc_id: (row.n_shingles, row.component_id) for row in rows} == want
    assert all(row.kept == (row.doc_id == row.component_id) for row in rows)


def test_documents_against_brute_force(small):
    docs = small("documents")
    want = groups([(row.doc_id, row.text) for row in docs.collect()], 4)
    rows = minhash.near_duplicates(docs, 4).collect()
    assert {row.doc_id: (row.n_shingles, row.component_id) for row in rows} == want


@pytest.mark.parametrize("size", [1, 2, 7, 100, 5000])
def test_every_coordinate_is_filled(size):
    pick = np.random.default_rng(size)
    found = minhash.sketch(pick.integers(0, 1 << 63, size, dtype=np.uint64))
    assert (found != np.uint64(0xFFFFFFFFFFFFFFFF)).all()


def test_equal_coordinates_follow_the_similarity():
    pick = np.random.default_rng(1)
    errors = []
    for _ in range(60):
        both = pick.integers(0, 1 << 63, 300, dtype=np.uint64)
        a, b = both[:240], both[60:]
        errors.append((minhash.sketch(a) == minhash.sketch(b)).mean() - 180 / 300)
    assert abs(np.mean(errors)) < 0.03 and np.std(errors) < 0.08


def test_cells_bound_what_is_shared(spark):
    """The bound is never under the intersection, and close to it for sets of everyday size."""
    pick = np.random.default_rng(3)
    rows, shared = [], []
    for k, (size, both) in enumerate([(300, 200), (300, 0), (40, 40), (2000, 900), (5, 1), (60_000, 10)]):
        base = pick.integers(0, 1 << 63, 2 * size - both, dtype=np.uint64)
        rows += [(2 * k, np.sort(base[:size]).tobytes()), (2 * k + 1, np.sort(base[size - both :]).tobytes())]
        shared.append((size, both))
    cells = minhash.cells_of(spark.createDataFrame(rows, "node long, shingles binary"))
    other = cells.selectExpr("node - 1 node", "cells _cells", "beyond _beyond")
    pairs = cells.where("node % 2 = 0").join(other, "node").orderBy("node")
    got = [row[0] for row in pairs.select(minhash._by_cells(F.col, lambda name: F.col(f"_{name}"))).collect()]
    for (size, both), bound in zip(shared, got, strict=True):
        assert both <= bound <= size
    assert got[0] < 240 and got[1] < 70 and got[3] < 1780


def test_a_hot_bucket_of_unlike_texts_stays_linear(spark, monkeypatch):
    """Texts that share a long passage but are no near copies: few pairs are compared in full."""
    pick, compared = random.Random(9), []
    words = [f"w{k}" for k in range(3000)]
    passage = pick.choices(words, k=60)
    texts = [" ".join(passage + pick.choices(words, k=pick.randint(18, 24))) for _ in range(500)]
    real = minhash.compared

    def counted(pairs, sets):
        compared.append(pairs.count())
        return real(pairs, sets)

    monkeypatch.setattr(minhash, "compared", counted)
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    rows = minhash.near_duplicates(frame, 4).collect()
    want = groups(enumerate(texts), 4)
    assert {row.doc_id: (row.n_shingles, row.component_id) for row in rows} == want
    assert sum(compared) < 32 * 500


def test_null_and_repeated_ids(spark):
    text = "a b c d e f g h"
    rows = [(None, text), (3, text), (3, text), (1, "other words stand here instead of them"), (None, None), (2, "")]
    got = minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), 4).collect()
    assert sorted((r.doc_id or 0, r.n_shingles, r.component_id or 0, r.kept) for r in got) == [
        (0, 0, 0, False), (0, 5, 3, False), (1, 4, 1, True), (2, 0, 2, True), (3, 5, 3, True), (3, 5, 3, True),
    ]
    assert minhash.near_duplicates(spark.createDataFrame([], "doc_id long, text string")).count() == 0
