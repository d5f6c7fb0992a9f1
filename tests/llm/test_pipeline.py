import random

from brute import groups, quality_counts, repeated_spans

import corpus_pipeline
from tidemark.llm.tables import stored

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def prose(pick, words):
    return " ".join("".join(pick.choices("abcdefghij", k=pick.randint(2, 9))) for _ in range(words))


def documents(texts_frame):
    pick = random.Random(11)
    texts = [prose(pick, pick.randint(60, 200)) for _ in range(60)]
    passage = prose(pick, 60)
    texts += [f"{prose(pick, 80)} {passage} {prose(pick, 80)}" for _ in range(5)]
    texts += [texts[0], texts[0], texts[1] + " tail"] + [f"{texts[2]} {word}" for word in "abc"]
    texts += [None, "", "too short", "*** ".join(prose(pick, 90).split())]
    return texts_frame(texts, source=[("a", "b", None)[k % 3] for k in range(len(texts))])


def test_stages_against_plain_python(spark, texts_frame):
    docs = documents(texts_frame)
    first = {row.doc_id: row.text for row in docs.collect()}

    judged = stored(corpus_pipeline.quality_rules(spark, docs, ""), "test")
    assert judged.columns == COLUMNS
    kept = {row.doc_id: row.text for row in judged.collect()}
    failed = {k for k, text in first.items() if quality_counts(text)[0] < 50}
    assert set(first) - set(kept) == failed | {max(first)}  # the last one is full of symbols

    single = stored(corpus_pipeline.near_dedup(spark, judged, ""), "test")
    want = {key for key, (_, least) in groups(kept.items(), 5).items() if key == least}
    left = {row.doc_id: row.text for row in single.collect()}
    assert set(left) == want and single.columns == COLUMNS

    cut = stored(corpus_pipeline.repeated_passages(spark, single, ""), "test")
    raw, spans = repeated_spans([left[key] for key in sorted(left)])
    assert any(spans)
    for row, data, own in zip(cut.orderBy("doc_id").collect(), raw, spans, strict=True):
        for start, end in reversed(own):
            data = data[:start] + data[end:]
        assert row.text == data.decode() and row.n_chars == len(row.text)

    mixed = stored(corpus_pipeline.mixing(spark, cut, ""), "test")
    words = {row.doc_id: len(row.text.split()) for row in cut.collect()}
    taken = [row.doc_id for row in mixed.collect()]
    assert all(taken.count(key) <= 2 for key in words) and mixed.columns == COLUMNS
    assert abs(sum(words[key] for key in taken) - 1.5 * sum(words.values())) < 3 * max(words.values())

    last = corpus_pipeline.tokens(spark, mixed, "").collect()
    assert len(last) == len(taken) and all(row.round_trip for row in last)


def test_rows_equal_in_everything_leave_one(spark, texts_frame):
    docs = texts_frame(["one two three four five six", "alone here", None])
    twice = docs.union(docs).union(docs.withColumn("doc_id", docs.doc_id.cast("string").cast("long") * 0))
    nulls = twice.union(docs.withColumn("doc_id", docs.doc_id * None))
    got = corpus_pipeline.near_dedup(spark, nulls, "").collect()
    texts = [row.text for row in got]
    assert texts.count("one two three four five six") == 1 and texts.count("alone here") == 1
    assert texts.count(None) == 4  # without words nothing is a copy


def test_empty_table(spark, texts_frame):
    docs = texts_frame(["x"]).limit(0)
    for name, stage in corpus_pipeline.STAGES:
        docs = stored(stage(spark, docs, ""), f"test-{name}")
    assert docs.count() == 0


def test_registered(spark):
    import __spark_entry__ as contract

    assert contract.queries()["pipeline"] is corpus_pipeline.run
    assert len([name for name in contract.queries() if name.startswith("op")]) == 13
