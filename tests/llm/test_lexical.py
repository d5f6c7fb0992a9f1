import math
import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from compare import differences, duck
from pyspark.sql import functions as F

from tidemark.llm import lexical
from tidemark.llm.queries import ORACLE_SQL, op13_lexical_search

TERM = re.compile(rb"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def terms(text):
    lower = bytes(byte + 32 if 65 <= byte <= 90 else byte for byte in (text or "").encode())
    return TERM.findall(lower)


def brute(docs, items, k=10):
    """Rows of (item, rank, doc, score) by scoring every pair."""
    counted = [(doc, Counter(terms(text))) for doc, text in docs]
    counted = [(doc, found) for doc, found in counted if found]
    size, total = len(counted), sum(sum(found.values()) for _, found in counted)
    holding = Counter(term for _, found in counted for term in found)
    rows = []
    for item, text in items:
        scored = []
        for doc, found in counted:
            norm = 100 - 90 + (90 * sum(found.values()) * size) // total
            score = 0
            for term in set(terms(text)) & set(found):
                weight = math.floor(1000 * math.log((2 * size + 2) / (2 * holding[term] + 1)))
                score += weight * ((1000000000 * found[term]) // (1000 * found[term] + 8 * norm))
            if score > 0:
                scored.append((-score, doc is None, doc or 0, doc))
        rows += [(item, rank + 1, row[3], -row[0]) for rank, row in enumerate(sorted(scored, key=lambda row: row[:3])[:k])]
    return sorted(rows, key=str)


def invented(seed, count):
    pick = random.Random(seed)
    words = [f"w{k}" for k in range(60)] + ["Été", "ÉTÉ", "x9"]
    weights = [1 / (k + 1) for k in range(len(words))]
    texts = [" ".join(pick.choices(words, weights, k=pick.randint(0, 40))) for _ in range(count)]
    texts[5:25] = [texts[4]] * 20
    return texts + [None, "", " .,- ", "W1 w1-w2_w3", "w1 " * 5000, "w40 w41 " * 300]


@pytest.mark.parametrize("bucket,cells", [(lexical.BUCKET, lexical.CELLS), (1, 600), (3, 5000)])
def test_ranks_equal_brute_force(spark, texts_frame, monkeypatch, bucket, cells):
    monkeypatch.setattr(lexical, "BUCKET", bucket)
    monkeypatch.setattr(lexical, "CELLS", cells)
    texts = invented(1, 400)
    wanted = invented(2, 12)
    items = list(enumerate(wanted)) + [(0, wanted[0]), (None, "w1 w2")]
    frame = spark.createDataFrame(items, "item_id long, text string").withColumn("score", F.lit("clash"))
    rows = lexical.ranked_search(texts_frame(texts).repartition(3), frame).collect()
    assert sorted(map(tuple, rows), key=str) == brute(list(enumerate(texts)), items)


def test_equal_null_and_repeated_ids(spark):
    docs = [(None, "a b"), (3, "a b"), (3, "a b"), (2, "a c"), (1, None), (7, "a b")] + [(None, "a b")] * 5
    items = [(1, "A b!")]
    frames = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    rows = lexical.ranked_search(*frames, k=4).collect()
    assert sorted(map(tuple, rows), key=str) == brute(docs, items, 4)


def test_blocks_of_items(spark, texts_frame, monkeypatch):
    monkeypatch.setattr(lexical, "ITEM_BYTES", 300)
    texts, wanted = invented(3, 80), invented(4, 20)
    frame = spark.createDataFrame(list(enumerate(wanted)), "item_id long, text string")
    rows = lexical.ranked_search(texts_frame(texts), frame).collect()
    assert sorted(map(tuple, rows), key=str) == brute(list(enumerate(texts)), list(enumerate(wanted)))


def test_nothing_to_find(spark, texts_frame):
    items = spark.createDataFrame([(1, "nowhere"), (2, None)], "item_id long, text string")
    none = spark.createDataFrame([], "item_id long, text string")
    for docs in (texts_frame([]), texts_frame([None, "", "other words"])):
        for frame in (items, none):
            found = lexical.ranked_search(docs, frame)
            assert found.columns == ["item_id", "rank", "doc_id", "score"] and found.collect() == []


def test_other_ids(spark):
    docs = spark.createDataFrame([("b", "x y"), ("a", "x y"), ("c", "z")], "name string, body string")
    items = spark.createDataFrame([("q", "y")], "name string, body string")
    found = lexical.ranked_search(docs, items.withColumnRenamed("name", "item"), doc_id="name", item_id="item", text="body")
    assert [(row["item"], row["rank"], row["name"]) for row in found.orderBy("rank").collect()] == [("q", 1, "a"), ("q", 2, "b")]


def test_bounds_leave_branches_out(monkeypatch):
    """A search looks at few documents when one branch is much better than the rest."""
    monkeypatch.setattr(lexical, "BUCKET", 4)
    numbers = [np.array([0, 1])] * 10 + [np.array([2 + k % 50]) for k in range(2000)]
    tree = lexical.Tree(numbers, [np.ones(len(own), np.int64) for own in numbers], np.full(2010, 50), np.arange(52), 52)
    best = lexical.Best(10)
    best.ids = pa.array(range(2010))
    looked = []
    real = best.offer
    monkeypatch.setattr(best, "offer", lambda found, documents: looked.append(len(found)) or real(found, documents))
    tree.search(np.array([0, 1, 2]), np.array([500, 500, 10]), best)
    assert [row[2] for row in best.rows] == list(range(10)) and sum(looked) <= 64


def test_query_equals_sql(spark):
    folder = "/root/testdata/sf0.001"
    assert differences(op13_lexical_search(spark, folder), duck(folder), ORACLE_SQL["op13_lexical_search"]) == ""
