import random

import pyarrow as pa
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from tidemark.llm import tokens
from tidemark.llm.arrays import flat_bytes

PATH = public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


@pytest.mark.parametrize("mean", [tokens.MEAN_CHUNK, 64, 12])
def test_ids_equal_the_library_whatever_the_chunks(monkeypatch, library, mean):
    monkeypatch.setattr(tokens, "MEAN_CHUNK", mean)
    pick = random.Random(mean)
    parts = ["a", "b", " ", "  ", "\n", "\t", "<|endoftext|>", "é", "☃", "x1", "'s", "'LL", ".", "　", "zz ", "the cat "]
    texts = ["".join(pick.choices(parts, k=pick.randint(0, 900))) for _ in range(120)]
    texts += [None, "", " ", " " * 3000, "a" * 3000, "ab " * 2000, "no break" + "x" * 500 + " y " * 300]
    encoder = tokens.Encoder(tokens.Vocabulary.read(PATH))
    got = encoder.block(*flat_bytes(pa.array(texts, pa.string())))
    want = [found.ids for found in library.encode_batch([text or "" for text in texts], add_special_tokens=False)]
    assert [ids.tolist() for ids in got] == want


def test_shared_chunks_are_encoded_once(monkeypatch):
    encoder, seen = tokens.Encoder(tokens.Vocabulary.read(PATH)), []
    pick = random.Random(2)
    passage = " ".join(str(pick.random()) for _ in range(2000))
    real = encoder.ids
    monkeypatch.setattr(encoder, "ids", lambda raw: seen.append(len(raw)) or real(raw))
    encoder.block(*flat_bytes(pa.array([passage])))
    once = sum(seen)
    seen.clear()
    encoder.block(*flat_bytes(pa.array([f"{k} {passage}" for k in range(20)])))
    assert sum(seen) < 4 * once


def test_round_trip(texts_frame, library):
    texts = [None, "", "Hello <|endoftext|> world", "é" * 100, "same", "same"]
    rows = tokens.encode_decode(texts_frame(texts), PATH).orderBy("doc_id").collect()
    assert [row.decoded for row in rows] == [text or "" for text in texts]
    assert [row.ids for row in rows] == [library.encode(text or "", add_special_tokens=False).ids for text in texts]
