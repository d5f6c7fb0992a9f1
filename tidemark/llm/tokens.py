"""Byte-level BPE encoding and decoding with content-defined chunk reuse.

A rolling hash over the text's bytes sets the borders of chunks, so that equal
passages of different documents fall into equal chunks wherever they stand.  In
a block of documents each distinct chunk is encoded once.  A border may cut a
word, so every join is repaired: the stretch from the last safe place of the left
chunk to the first safe place of the right one is encoded again, and it grows by
further safe places until its ends agree with token ends of both chunks.

A safe place is a blank between two visible ASCII characters.  The splitting
pattern always starts a new piece there and looks neither back nor across it,
and no special token holds a blank, so what stands before and after encodes
independently.  That makes the result exact, not only likely.

Null texts are empty and give no tokens.  Rows are independent: repeated rows
give repeated results, an empty table an empty one.  A text may be of any
length; a block holds whole documents.
"""

from __future__ import annotations

import json
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from tidemark.llm.arrays import PrefixHash, U, flat_bytes, give_back, text_blocks

#: Fixed value: the pattern that splits text before the merges.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""

WINDOW = 24
#: One border in so many bytes.
MEAN_CHUNK = 2048


def _byte_letters() -> dict[str, int]:
    """The letter that vocabulary files write for each byte: itself if visible, else the next free one from 256."""
    visible = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [byte for byte in range(256) if byte not in visible]
    return {chr(byte): byte for byte in visible} | {chr(256 + k): byte for k, byte in enumerate(hidden)}


@dataclass
class Vocabulary:
    """Ranks and special tokens of a byte-level BPE file of the tokenizers library."""

    ranks: dict[bytes, int]
    special: dict[str, int]

    @staticmethod
    def read(path: str) -> Vocabulary:
        with open(path, encoding="utf-8") as file:
            model = json.load(file)
        letters = _byte_letters()
        special = {token["content"]: token["id"] for token in model["added_tokens"]}
        words = model["model"]["vocab"].items()
        return Vocabulary({bytes(letters[c] for c in word): k for word, k in words if word not in special}, special)

    def encoding(self):
        import tiktoken

        return tiktoken.Encoding("bpe", pat_str=PATTERN, mergeable_ranks=self.ranks, special_tokens=self.special)

    def bytes_of(self) -> list[bytes]:
        table = [b""] * (1 + max([*self.ranks.values(), *self.special.values()]))
        for token, number in self.ranks.items():
            table[number] = token
        for token, number in self.special.items():
            table[number] = token.encode()
        return table


def borders(data: np.ndarray) -> np.ndarray:
    """Places where a rolling hash of the bytes before them says cut, at the start of a character."""
    hashes = PrefixHash(data).windows(WINDOW)
    places = np.flatnonzero(hashes % U(MEAN_CHUNK) == 0) + WINDOW
    places = places[places < len(data)]
    return places[(data[places] & 0xC0) != 0x80]


def safe_places(data: np.ndarray) -> np.ndarray:
    """Blanks between two visible ASCII characters."""
    visible = (data > 32) & (data < 127)
    return np.flatnonzero(visible[:-2] & (data[1:-1] == 32) & visible[2:]) + 1


class Encoder:
    """Encodes texts of one task, each distinct chunk of a block once."""

    def __init__(self, vocabulary: Vocabulary):
        self.encoding = vocabulary.encoding()
        table = vocabulary.bytes_of()
        self.widths = np.array([len(token) for token in table], np.int64)

    def ids(self, raw: bytes) -> np.ndarray:
        return self.encoding.encode_to_numpy(raw.decode(), allowed_special="all").view(np.int32)

    def block(self, data: np.ndarray, offsets: np.ndarray) -> list[np.ndarray]:
        """The ids of each text; ``data`` has one more byte after every text."""
        raw, seen = data.tobytes(), {}
        cuts, safe = borders(data), safe_places(data)
        return [self._text(raw, int(a), int(b) - 1, cuts, safe, seen) for a, b in zip(offsets[:-1], offsets[1:], strict=True)]

    def _chunk(self, raw: bytes, seen: dict) -> tuple[np.ndarray, np.ndarray]:
        """Ids of a chunk and the place after each of them."""
        found = seen.get(raw)
        if found is None:
            ids = self.ids(raw)
            found = seen[raw] = (ids, np.cumsum(self.widths[ids]))
        return found

    def _text(self, raw: bytes, start: int, end: int, cuts: np.ndarray, safe: np.ndarray, seen: dict) -> np.ndarray:
        inner = cuts[cuts.searchsorted(start + 1) : cuts.searchsorted(end)]
        if len(inner) == 0:
            return self._chunk(raw[start:end], seen)[0]
        edges = [start, *inner.tolist(), end]
        parts: list[np.ndarray] = []
        done = start  # everything before it is in parts, and it is the text's start or a safe place
        for left, right in zip(edges[:-1], edges[1:], strict=True):
            if right <= done:
                continue
            ids, ends = self._chunk(raw[left:right], seen)
            # Where the chunk's own tokens may be taken over: from `first` to `last`.
            first = done if done >= left else self._agree(safe, left, right, left, ends, 1)
            last = end if right == end else self._agree(safe, max(left, done), right, left, ends, -1)
            if first is None or last is None or first >= last:
                continue  # no agreement inside: the next chunk's join reaches back to `done`
            if done >= left and done > left and not self._on_end(ends, done - left):
                continue
            if first > done:
                parts.append(self.ids(raw[done:first]))
            low = ends.searchsorted(first - left, "right") if first > left else 0
            high = ends.searchsorted(last - left, "right")
            parts.append(ids[low:high])
            done = last
        if done < end:
            parts.append(self.ids(raw[done:end]))
        return np.concatenate(parts)

    @staticmethod
    def _on_end(ends: np.ndarray, place: int) -> bool:
        at = ends.searchsorted(place)
        return at < len(ends) and ends[at] == place

    def _agree(self, safe: np.ndarray, low: int, high: int, left: int, ends: np.ndarray, step: int) -> int | None:
        """The first (or last) safe place strictly inside that is also the end of a token of the chunk."""
        at, stop = (safe.searchsorted(low, "right"), len(safe)) if step > 0 else (safe.searchsorted(high) - 1, -1)
        while at != stop and low < safe[at] < high:
            if self._on_end(ends, safe[at] - left):
                return int(safe[at])
            at += step
        return None


def encode_decode(docs: DataFrame, vocabulary: str, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Columns ``keep``, ``ids`` (array of int) and ``decoded`` (the text decoded from them).

    ``vocabulary`` is the path of a byte-level BPE file, read on the driver; its
    size is that of the vocabulary, whatever the data.
    """
    spark = docs.sparkSession
    read = Vocabulary.read(vocabulary)
    # Broadcasts are pickled by reference, so only plain values go in.
    shared = spark.sparkContext.broadcast((read.ranks, read.special))
    rows = docs.select(*keep, docs[text].alias("_text"))

    def encode(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        give_back()
        own = Vocabulary(*shared.value)
        encoder, table = Encoder(own), own.bytes_of()
        for block in text_blocks(batches, "_text"):
            found = encoder.block(*flat_bytes(block.column("_text")))
            places = np.concatenate([[0], np.cumsum([len(ids) for ids in found])])
            values = np.concatenate(found) if found else np.zeros(0, np.int32)
            ids = pa.ListArray.from_arrays(pa.array(places, pa.int32()), pa.array(values, pa.int32()))
            texts = [b"".join(map(table.__getitem__, ids.tolist())).decode(errors="replace") for ids in found]
            kept = [block.column(name) for name in keep]
            yield pa.RecordBatch.from_arrays([*kept, ids, pa.array(texts, pa.string())], [*keep, "ids", "decoded"])

    kept = ", ".join(f"`{name}` {rows.schema[name].dataType.simpleString()}" for name in keep)
    return rows.mapInArrow(encode, f"{kept}, ids array<int>, decoded string")
