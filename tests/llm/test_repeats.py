import random

import pytest
from brute import repeated_spans

from tidemark.llm import chunks, repeats


def odd_texts():
    pick = random.Random(3)
    base = ["".join(pick.choices("ab cdé\n", k=pick.randint(0, 900))) for _ in range(15)]
    texts = [None, "", "x" * 3000, "ab" * 300, "é" * 300, "short", base[0], base[0], base[1][:150] + base[2] + "zz" + base[3][20:600]]
    cut = [text[: pick.randint(0, len(text))] + "Q" + text[pick.randint(0, len(text)) :] for text in base * 2]
    return texts + base + cut


@pytest.mark.parametrize("hot", [repeats.HOT, 3])
@pytest.mark.parametrize("symbol", [repeats.SYMBOL, 20])
def test_spans_against_brute_force(texts_frame, monkeypatch, hot, symbol):
    monkeypatch.setattr(repeats, "HOT", hot)
    monkeypatch.setattr(repeats, "SYMBOL", symbol)
    monkeypatch.setattr(chunks, "CHUNK_BYTES", 8000)
    texts = odd_texts()
    rows = repeats.repeated_spans(texts_frame(texts)).orderBy("doc_id").collect()
    for row, raw, spans in zip(rows, *repeated_spans(texts), strict=True):
        assert [(span.start, span.end) for span in row.spans] == spans
        left = bytearray(raw)
        for start, end in reversed(spans):
            del left[start:end]
        assert bytes(row.kept) == bytes(left) and row.n_bytes == len(raw)


def test_documents_against_brute_force(small, monkeypatch):
    monkeypatch.setattr(chunks, "CHUNK_BYTES", 60_000)
    docs = small("documents").orderBy("doc_id")
    texts = [row.text for row in docs.collect()]
    rows = repeats.repeated_spans(docs).orderBy("doc_id").collect()
    assert [[(s.start, s.end) for s in row.spans] for row in rows] == repeated_spans(texts)[1]


def test_whole_characters(texts_frame):
    passage = "é" * 150
    texts = [f"{passage}a", f"bb{passage}", "é" * 100]
    for row in repeats.repeated_spans(texts_frame(texts), whole_characters=True).collect():
        bytes(row.kept).decode()
    assert repeats.repeated_spans(texts_frame(texts).limit(0)).count() == 0


def test_merged_transforms_give_the_order_of_all_suffixes():
    """Shards merged by refinement agree with sorting the suffixes of all of them."""
    import numpy as np

    pick = random.Random(5)
    words = [[pick.randint(1, 3) for _ in range(pick.randint(1, 12))] for _ in range(12)]
    symbol, successor, shard, suffix = [], [], [], []
    for k, word in enumerate(words):
        for at in range(len(word) + 1):
            place = len(symbol)
            symbol.append(word[at] if at < len(word) else 0)
            successor.append(place + 1 if at < len(word) else place)
            shard.append(k % 3)
            suffix.append(tuple(word[at:]))
    merged, block = repeats.merge_transforms(
        np.array(symbol, np.uint64), np.array(successor), np.array(shard), 13, depth=4
    )
    ordered = [suffix[k] for k in merged]
    assert [s[:4] for s in ordered] == sorted(s[:4] for s in suffix)
    for a, b, x, y in zip(ordered, ordered[1:], block, block[1:], strict=False):
        assert (x == y) == (len(a) >= 4 and a[:4] == b[:4])


def test_anchors_spread_over_buckets():
    import numpy as np
    import pyarrow as pa

    pick = random.Random(7)
    text = "".join(pick.choices("abcdefghij ", k=200_000))
    anchors = np.unique(repeats.Runs.of(pa.array([text])).anchor)
    shares = np.bincount((anchors >> np.uint64(61)).astype(int), minlength=8) / len(anchors)
    assert len(anchors) > 1000 and shares.min() > 0.08 and shares.max() < 0.18


def test_runs_against_each_window():
    """Runs found by edges and sliding extremes are those of a plain walk over all strings."""
    import numpy as np
    import pyarrow as pa

    pick = random.Random(11)
    texts = odd_texts() + ["x" * 199, "x" * 200, "x" * 199 + "é", "".join(pick.choices("ab", k=2000))]
    found = repeats.Runs.of(pa.array(texts))
    block = repeats.Bytes(pa.array(texts))
    grams, width = block.hashes.windows(repeats.GRAM).tolist(), repeats.LENGTH - repeats.GRAM + 1
    plain = []
    for low, high in zip(block.offsets[:-1].tolist(), block.offsets[1:].tolist(), strict=True):
        for start in range(low, high - repeats.LENGTH):
            least = min(grams[start : start + width])
            if start > low and plain[-1][0] == least and plain[-1][2] < repeats.LONGEST_RUN:
                plain[-1][2] += 1
            else:
                plain.append([least, start, 1])
    weights = [min(2, grams[start : start + size + width - 1].count(least)) for least, start, size in plain]
    assert found.start.tolist() == [start for _, start, _ in plain]
    assert found.size.tolist() == [size for _, _, size in plain]
    assert found.weight.tolist() == weights
    assert found.anchor.tolist() == repeats.mix(np.array([least for least, _, _ in plain], np.uint64)).tolist()
