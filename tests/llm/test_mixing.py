import pytest
from pyspark.sql import functions as F
from compare import differences, duck

from tidemark.llm import mixing
from tidemark.llm.queries import QUERIES

FOLDER = "/root/testdata/sf0.01"


def test_mix_equals_sql(spark):
    assert differences(QUERIES["op6_mixing"](spark, FOLDER), duck(FOLDER), mixing.MIX_SQL) == ""


def test_targets_and_bounds(texts_frame):
    texts = ["w " * (k % 40 + 1) for k in range(2000)] + [None, "", " "]
    sources = [("a", "b", "c", "d", None)[k % 5 if k % 3 else 0] for k in range(len(texts))]
    docs = texts_frame(texts, source=sources)
    rows = mixing.mix(docs).collect()
    assert {c for c in docs.columns if c not in ("size", "target")} <= set(rows[0].asDict())
    by_source = {}
    for row in rows:
        assert row.taken == row["size"] * row.copies and 0 <= row.copies <= 2
        by_source.setdefault(row.source, []).append(row)
    total = sum(row["size"] for row in rows)
    assert sum(own[0].target for own in by_source.values()) == pytest.approx(1.5 * total)
    for own in by_source.values():
        assert own[0].source_size == sum(row["size"] for row in own)
        assert abs(sum(row.taken for row in own) - own[0].target) <= 20
    again = mixing.mix(docs.repartition(7)).collect()
    assert {r.doc_id: r.taken for r in rows} == {r.doc_id: r.taken for r in again}


def test_weights_within_a_source(texts_frame):
    docs = texts_frame(["w " * 10] * 600, source=["a"] * 300 + ["b"] * 300, lang=["1", "3"] * 300)
    rows = mixing.mix(docs.withColumn("w", docs.lang.cast("double")), weight="w").collect()
    for source in "ab":
        own = [row for row in rows if row.source == source]
        assert abs(sum(row.taken for row in own) - own[0].target) <= 10
    light, heavy = (sum(r.taken for r in rows if r.lang == lang and r.source == "b") for lang in ("1", "3"))
    assert heavy > 1.5 * light


def test_odd_tables(texts_frame):
    docs = texts_frame(["a b c"])
    assert mixing.mix(docs.limit(0)).count() == 0
    assert mixing.mix(texts_frame([None, ""])).agg({"taken": "sum"}).first()[0] == 0
    both = mixing.mix(docs.union(docs)).collect()
    assert len({row.taken for row in both}) == 1


def test_rows_without_an_id(texts_frame):
    """Rows with a null id are drawn by their texts, so their source meets its target."""
    docs = texts_frame([f"w{k} " * 10 for k in range(400)], source=["a"] * 200 + ["b"] * 100 + ["c"] * 100)
    rows = mixing.mix(docs.withColumn("doc_id", F.lit(None).cast("long"))).collect()
    for source in "abc":
        own = [row for row in rows if row.source == source]
        assert abs(sum(row.taken for row in own) - own[0].target) <= 10
        assert source == "a" or len({row.taken for row in own}) == 2
