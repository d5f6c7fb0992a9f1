import hashlib
import random
import struct

import numpy as np
import pyarrow as pa
import public_tokenizers
import pytest
import sentencepiece

from tidemark.llm import pieces
from tidemark.llm.arrays import flat_bytes
from tidemark.llm.queries import op12_piece_round_trip

PATH = public_tokenizers.path("piece_bpe_32k.model")
PARTS = ["a", "b", " ", "  ", "\n", "\t", "<s>", "</s>", "<0x0A>", "é", "☃", "x1", "▁", ".", "　", "the cat ", "\x00", "字", "Á"]


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=PATH)


def odd_texts(seed, count=150):
    pick = random.Random(seed)
    texts = ["".join(pick.choices(PARTS, k=pick.randint(0, 300))) for _ in range(count)]
    return texts + [None, "", " ", "▁", " " * 3000, "a" * 3000, "ab " * 2000, "x" * 500 + " y " * 300, "字" * 700]


def spans(library, text):
    """Byte spans of each piece as the library gives them."""
    return [(piece.id, piece.begin, piece.end) for piece in library.encode(text, return_type="proto").pieces]


@pytest.mark.parametrize("seed", [1, 2])
def test_ids_and_text_equal_the_library(library, seed):
    texts, encoder = odd_texts(seed), pieces.Encoder(pieces.Model.read(PATH))
    ids, begins, ends, bounds = encoder.block(*flat_bytes(pa.array(texts, pa.string())))
    for text, a, b in zip(texts, bounds[:-1], bounds[1:], strict=True):
        want = library.encode(text or "")
        assert ids[a:b].tolist() == want
        assert encoder.decode(want) == library.decode(want)


def test_spans_equal_the_library(library):
    texts, encoder = [text or "" for text in odd_texts(3, 60)], pieces.Encoder(pieces.Model.read(PATH))
    ids, begins, ends, bounds = encoder.block(*flat_bytes(pa.array(texts, pa.string())))
    for text, a, b in zip(texts, bounds[:-1], bounds[1:], strict=True):
        got = list(zip(ids[a:b].tolist(), begins[a:b].tolist(), ends[a:b].tolist(), strict=True))
        assert got == spans(library, text)
        covered = "".join(text.encode()[low:high].decode() for _, low, high in got)
        assert covered == text


@pytest.mark.parametrize("rule", ["nmt_nfkc", "nfkc_cf"])
@pytest.mark.parametrize("trim", [True, False])
def test_longest_prefixes_of_a_compiled_map(rule, trim):
    """The map of a library's rule, with what each byte of the result comes from."""
    library = sentencepiece.SentencePieceNormalizer(
        rule_name=rule, add_dummy_prefix=True, escape_whitespaces=True, remove_extra_whitespaces=trim
    )
    model = pieces.Model.parse(library.serialized_model_proto())
    assert model.character_map and model.trim_spaces == trim
    pick = random.Random(5)
    parts = ["ＡＢ", "ｶﾞ", "①", "é", "Ǻ", " ", "  ", "　", "\t", "ﬁ", "x", "​", "ß", "한", "한", "▁"]
    texts = ["".join(pick.choices(parts, k=pick.randint(0, 60))) for _ in range(200)] + ["", " ", "a  ", "　　"]
    data, offsets = flat_bytes(pa.array(texts))
    out, source, places = pieces.Normaliser(model).block(data, offsets)
    for k, text in enumerate(texts):
        got = out[places[k] : places[k + 1]].tobytes().decode()
        want, starts = library.normalize(text, with_offsets=True)
        assert got == want, text
        # The library counts characters of the source for each character of the result.
        first = np.flatnonzero((out[places[k] : places[k + 1]] & 0xC0) != 0x80)
        chars = np.concatenate([[0], np.cumsum([len(c.encode()) for c in text])])
        mine = source[places[k] : places[k + 1]][first] - offsets[k]
        assert mine.tolist() == [int(chars[at]) for at in starts[: len(first)]], text


def test_long_words_merge_as_short_ones():
    encoder, pick = pieces.Encoder(pieces.Model.read(PATH)), random.Random(7)
    words = ["".join(pick.choices("abcdetinhos▁é字☃", k=pick.randint(1, 60))) for _ in range(300)]
    points = np.concatenate([[ord(c) for c in word] for word in words])
    symbols, counts = encoder._short(encoder.single[points], np.array([len(word) for word in words]))
    got = [own.tolist() for own in np.split(symbols, np.cumsum(counts)[:-1])]
    assert got == [encoder._long(word) for word in words]


def test_forgetting_words_changes_nothing(monkeypatch, library):
    monkeypatch.setattr(pieces, "REMEMBERED", 10)
    encoder = pieces.Encoder(pieces.Model.read(PATH))
    text = "some words and more words " * 20
    ids, *_ = encoder.block(*flat_bytes(pa.array([text, text])))
    assert ids.tolist() == library.encode(text) * 2


def test_frame(texts_frame, library):
    texts = [None, "", "Hello <s> world", "é☃" * 100, "same", "same", "long " * 30_000]
    rows = pieces.encode_pieces(texts_frame(texts), PATH).orderBy("doc_id").collect()
    assert [row.ids for row in rows] == [library.encode(text or "") for text in texts]
    assert [row.decoded for row in rows] == [text or "" for text in texts]
    assert all((row.begins[0], row.ends[-1]) == (0, len(text.encode())) for row, text in zip(rows, texts) if text)
    empty = pieces.encode_pieces(texts_frame([]), PATH)
    assert empty.collect() == [] and empty.columns == ["doc_id", "ids", "begins", "ends", "decoded"]


def test_other_models_are_refused(tmp_path):
    def field(number, raw):
        return bytes([number << 3 | 2, len(raw)]) + raw

    piece = field(1, b"a") + b"\x15" + struct.pack("<f", -1.0)
    path = tmp_path / "own.model"
    path.write_bytes(field(1, piece) + field(2, b"\x18\x01"))
    with pytest.raises(ValueError, match="does not merge pairs"):
        pieces.Model.read(str(path))


def test_query_equals_the_library(spark, small, library):
    sha = lambda text: hashlib.sha256(text.encode()).hexdigest()
    want = {}
    for row in small("documents").collect():
        ids = library.encode(row.text or "")
        want[row.doc_id] = (len(ids), sha(",".join(map(str, ids))), sha(library.decode(ids)), True)
    got = op12_piece_round_trip(spark, "/root/testdata/sf0.001").collect()
    assert {row.doc_id: tuple(row)[1:] for row in got} == want
