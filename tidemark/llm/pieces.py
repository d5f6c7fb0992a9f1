"""SentencePiece encoding that keeps the place of every piece in the original bytes.

A block of texts goes through three steps, each over all its bytes at once:

1. **Normalise.**  From every character the compiled character map (a double-array
   trie) is walked for its longest prefix; matches are consumed from left to right,
   everything else is copied.  White space is escaped as the model asks.  For each
   byte that comes out, ``align`` has the byte of the source it came from.
2. **Cut and merge.**  Where no piece of the vocabulary can reach across, the text is
   cut into words; each distinct word is merged once, best pair first, leftmost
   among equals.  Characters outside of the vocabulary become byte pieces.
3. **Project.**  The pieces' ends in the normalised bytes are looked up in ``align``.
   Spans of a text touch one another and cover it, apart from what the map drops.
   The bytes of a character outside of the vocabulary are empty spans at its start
   but for the last one, which has it whole.

Null texts are empty and give no pieces.  Rows are independent: repeated rows give
repeated results, an empty table an empty one, and other columns of any name are
left alone.  A text may be of any length: a block holds whole texts, words of any
length are merged (long ones with a heap).
"""

from __future__ import annotations

import heapq
import struct
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from tidemark.llm.arrays import flat_bytes, text_blocks

SPACE = "▁"
_SPACE = np.frombuffer(SPACE.encode(), np.uint8)

#: Kinds of pieces in a model file.
NORMAL, UNKNOWN, CONTROL, BYTE = 1, 2, 3, 6
#: The model type that merges pairs.
BPE = 2

#: Words of at most so many characters are merged many at a time, longer ones with a heap.
SHORT = 48
#: Bytes of distinct words whose pieces a task remembers.
REMEMBERED = 8 << 20


def _fields(raw: bytes) -> Iterator[tuple[int, int | bytes]]:
    """Number and value of each field of a protobuf message."""

    def number(at: int) -> tuple[int, int]:
        value = shift = 0
        while True:
            value |= (raw[at] & 127) << shift
            at, shift = at + 1, shift + 7
            if raw[at - 1] < 128:
                return value, at

    at = 0
    while at < len(raw):
        key, at = number(at)
        if key & 7 == 0:
            value, at = number(at)
        else:
            if key & 7 == 2:
                size, at = number(at)
            else:
                size = 8 if key & 7 == 1 else 4
            value, at = raw[at : at + size], at + size
        yield key >> 3, value


@dataclass
class Model:
    """What encoding needs of a SentencePiece model file."""

    pieces: list[tuple[str, float, int]]
    character_map: bytes = b""
    dummy_prefix: bool = True
    trim_spaces: bool = True
    escape_spaces: bool = True
    byte_fallback: bool = False
    unknown_text: str = " ⁇ "
    kind: int = 1
    refused: list[str] = field(default_factory=list)

    @staticmethod
    def parse(raw: bytes) -> Model:
        model = Model([])
        for number, value in _fields(raw):
            if number == 1:
                piece = dict(_fields(value))
                score = struct.unpack("<f", piece.get(2, bytes(4)))[0]
                model.pieces.append((piece[1].decode(), score, piece.get(3, NORMAL)))
            elif number == 2:
                trained = dict(_fields(value))
                model.kind = trained.get(3, 1)
                model.byte_fallback = bool(trained.get(35, 0))
                model.unknown_text = trained.get(44, model.unknown_text.encode()).decode()
                if trained.get(24):
                    model.refused.append("white space as a suffix")
            elif number == 3:
                spec = dict(_fields(value))
                model.character_map = spec.get(2, b"")
                model.dummy_prefix, model.trim_spaces, model.escape_spaces = (bool(spec.get(k, 1)) for k in (3, 4, 5))
        return model

    @staticmethod
    def read(path: str) -> Model:
        with open(path, "rb") as file:
            model = Model.parse(file.read())
        if model.kind != BPE:
            model.refused.append("a model that does not merge pairs")
        if any(kind not in (NORMAL, UNKNOWN, CONTROL, BYTE) for _, _, kind in model.pieces):
            model.refused.append("user-defined or unused pieces")
        if model.refused:
            raise ValueError(f"{path}: cannot encode with {', '.join(model.refused)}")
        return model

    def surfaces(self) -> list[bytes]:
        """What each id decodes to."""
        texts = {UNKNOWN: lambda piece: self.unknown_text.encode(), CONTROL: lambda piece: b"", BYTE: _byte}
        return [texts.get(kind, lambda p: p.replace(SPACE, " ").encode())(piece) for piece, _, kind in self.pieces]


def _byte(piece: str) -> bytes:
    return bytes([int(piece[1:-1], 16)])


class Normaliser:
    """Text to normalised bytes, each with its place in the source."""

    def __init__(self, model: Model):
        self.model = model
        raw = model.character_map
        size = struct.unpack("<I", raw[:4])[0] if raw else 0
        self.units = np.frombuffer(raw, np.uint32, size // 4, 4) if raw else np.zeros(0, np.uint32)
        self.texts = np.frombuffer(raw, np.uint8, offset=4 + size) if raw else np.zeros(0, np.uint8)
        self.text_ends = np.flatnonzero(self.texts == 0)

    @staticmethod
    def _step(unit: np.ndarray) -> np.ndarray:
        """How far a trie unit's children are away from it."""
        return (unit >> np.uint32(10)) << ((unit & np.uint32(1 << 9)) >> np.uint32(6))

    def longest(self, data: np.ndarray, starts: np.ndarray, limits: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Length of the longest prefix in the map from each start, 0 for none, and where its replacement begins."""
        length, text = np.zeros(len(starts), np.int64), np.zeros(len(starts), np.int64)
        if not len(self.units):
            return length, text
        alive = np.arange(len(starts))
        node = np.full(len(starts), self._step(self.units[:1])[0], np.uint32)
        depth = 0
        while True:
            more = starts[alive] + depth < limits[alive]
            alive, node = alive[more], node[more]
            if not len(alive):
                return length, text
            byte = data[starts[alive] + depth].astype(np.uint32)
            node = node ^ byte
            unit = self.units[np.minimum(node, len(self.units) - 1)]
            # A label has 8 bits and the mark of a leaf, which no byte carries.
            same = (unit & np.uint32(0x800000FF)) == byte
            alive, unit = alive[same], unit[same]
            node = node[same] ^ self._step(unit)
            depth += 1
            ends = (unit >> np.uint32(8)) & np.uint32(1) == 1
            length[alive[ends]] = depth
            text[alive[ends]] = self.units[node[ends]] & np.uint32(0x7FFFFFFF)

    def _consumed(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, ...]:
        """Start, source length, and the pooled range of what it becomes, of each unit consumed from left to right."""
        inside = np.ones(len(data), bool)
        inside[offsets[1:] - 1] = False  # the byte after each text
        if not len(self.units):
            # Without a map every byte is copied.
            starts = np.flatnonzero(inside)
            return starts, starts, np.ones(len(starts), np.int64)
        starts = np.flatnonzero(inside & ((data & 0xC0) != 0x80))
        next_start = np.append(starts[1:], len(data))
        limits = offsets[1:][owners(starts, offsets)] - 1
        plain = np.minimum(next_start, limits) - starts
        length, text = self.longest(data, starts, limits)
        # A match of several characters swallows the starts inside of it.
        keep, done = np.ones(len(starts), bool), 0
        for at in np.flatnonzero(length > plain).tolist():
            if starts[at] >= done:
                done = starts[at] + length[at]
                keep[at + 1 : np.searchsorted(starts, done)] = False
        starts, plain, length, text = starts[keep], plain[keep], length[keep], text[keep]
        mapped = length > 0
        low = np.where(mapped, len(data) + text, starts)
        size = plain.copy()
        size[mapped] = self.text_ends[np.searchsorted(self.text_ends, text[mapped])] - text[mapped]
        return starts, low, size

    def block(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Normalised bytes of all texts, the source byte of each, and the offsets of the texts in them.

        ``data`` has one more byte after every text.
        """
        starts, low, size = self._consumed(data, offsets)
        pool = np.concatenate([data, self.texts])
        first = np.cumsum(size) - size
        out = pool[spread(low, first, size)]
        source = np.repeat(starts, size)
        text = owners(starts, offsets)
        owner = np.repeat(text, size)
        # Texts that get a mark in front, and what it comes from: the first unit that is not a trimmed blank.
        solid = ~((size == 1) & (pool[low] == 32)) if self.model.trim_spaces else np.ones(len(starts), bool)
        led = text[solid]
        at = np.flatnonzero(np.diff(led, prepend=-1))
        if self.model.trim_spaces:
            keep = self._untrimmed(out, owner, first, size, offsets)
            out, source, owner = out[keep], source[keep], owner[keep]
        return self._escaped(out, source, owner, len(offsets) - 1, led[at], starts[solid][at])

    def _untrimmed(self, out, owner, first, size, offsets) -> np.ndarray:
        """Bytes that stay when blanks at the start, at the end and after blanks go."""
        blank = out == 32
        solid = np.concatenate([[0], np.cumsum(~blank)])
        full = size > 0
        first, size = first[full], size[full]
        if not len(first):
            return blank
        last_blank = blank[first + size - 1]
        begins = np.ones(len(first), bool)
        begins[1:] = owner[first[1:]] != owner[first[:-1]]
        after = np.where(begins, True, np.append(True, last_blank[:-1]))
        leading = solid[:-1] == np.repeat(solid[first], size)
        keep = ~(blank & leading & np.repeat(after, size))
        # Blanks at the end: nothing solid follows in the text.
        ends = np.searchsorted(owner, np.arange(len(offsets) - 1), "right")
        return keep & ~(blank & (solid[1:] == solid[ends][owner]))

    def _escaped(self, out, source, owner, texts, led, heads) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """With a mark in front of the texts ``led`` and marks for blanks."""
        model = self.model
        mark = _SPACE if model.escape_spaces else np.array([32], np.uint8)
        fresh = np.zeros(len(out), bool)
        if model.dummy_prefix:
            head = np.searchsorted(owner, led)
            out, source, owner = np.insert(out, head, 32), np.insert(source, head, heads), np.insert(owner, head, led)
            fresh = np.zeros(len(out), bool)
            fresh[head + np.arange(len(head))] = True
        blank = (out == 32) if model.escape_spaces else fresh
        width = np.where(blank, len(mark), 1)
        place = np.cumsum(width) - width
        grown = np.repeat(out, width)
        for k, byte in enumerate(mark.tolist()):
            grown[place[blank] + k] = byte
        ends = np.concatenate([[0], np.cumsum(np.bincount(owner, width, texts).astype(np.int64))])
        source = np.repeat(source, width)
        if model.trim_spaces and model.escape_spaces:
            grown, source, ends = self._trimmed_marks(grown, source, ends)
        return grown, source, ends

    @staticmethod
    def _trimmed_marks(grown, source, ends) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Without marks at the end of a text, which come from the source as they are."""
        keep = np.ones(len(grown), bool)
        closing = np.flatnonzero((np.diff(ends) > 3) & (grown[ends[1:] - 1] == _SPACE[2])) if len(grown) else []
        for text in closing:
            low, high = int(ends[text]), int(ends[text + 1])
            raw = grown[low:high].tobytes()
            rest = raw
            while rest.endswith(_SPACE.tobytes()):
                rest = rest[:-3]
            keep[low + len(rest) : high] = False
        sizes = np.add.reduceat(np.append(keep, False), ends[:-1])
        sizes[np.diff(ends) == 0] = 0
        return grown[keep], source[keep], np.concatenate([[0], np.cumsum(sizes)])


def spread(low: np.ndarray, first: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The places ``low … low + size`` of all ranges, one after the other; ``first`` is where each range begins in the result."""
    return np.repeat(low - first, size) + np.arange(int(size.sum()))


def owners(places: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """The text that each of the ascending places is in."""
    return np.repeat(np.arange(len(offsets) - 1), np.diff(np.searchsorted(places, offsets)))


class Encoder:
    """Pieces of words, each distinct word merged once as long as it is remembered.

    A symbol is the number of a piece, or :attr:`size` plus the code point of a
    character that is no piece.
    """

    def __init__(self, model: Model):
        self.model = model
        self.normaliser = Normaliser(model)
        self.size = len(model.pieces)
        scores = sorted({-score for _, score, kind in model.pieces if kind == NORMAL})
        place = {score: k for k, score in enumerate(scores)}
        self.rank = {piece: place[-score] for piece, score, kind in model.pieces if kind == NORMAL}
        self.ids = {piece: k for k, (piece, _, kind) in enumerate(model.pieces) if kind == NORMAL}
        self.unknown = next((k for k, (_, _, kind) in enumerate(model.pieces) if kind == UNKNOWN), 0)
        self.bytes = np.full(256, self.unknown, np.int32)
        for k, (piece, _, kind) in enumerate(model.pieces):
            if kind == BYTE:
                self.bytes[_byte(piece)[0]] = k
        self.surface = model.surfaces()
        self.widths = np.array([len(piece.encode()) for piece, _, _ in model.pieces], np.int64)
        self.single = np.arange(self.size, self.size + 0x110000, dtype=np.int32)
        for piece, k in self.ids.items():
            if len(piece) == 1:
                self.single[ord(piece)] = k
        self._tabulate()
        # ASCII characters that no longer piece holds; and whether a mark only ever leads a piece.
        inner = {c for piece in self.rank if len(piece) > 1 for c in piece}
        self.alone = np.zeros(256, bool)
        self.alone[[k for k in range(128) if chr(k) not in inner]] = True
        self.mark_leads = not any(SPACE in piece.lstrip(SPACE) for piece in self.rank)
        self._forget()

    def _symbol(self, part: str) -> int:
        return self.ids[part] if part in self.ids else self.size + ord(part)

    def _tabulate(self) -> None:
        """All pairs of symbols that merge, by key, with rank and result."""
        rows = [
            (self._symbol(piece[:cut]), self._symbol(piece[cut:]), self.rank[piece], number)
            for piece, number in self.ids.items()
            for cut in range(1, len(piece))
            if (cut == 1 or piece[:cut] in self.ids) and (cut == len(piece) - 1 or piece[cut:] in self.ids)
        ]
        table = np.array(sorted(rows) or [(0, 0, 0, 0)], np.int64)
        self.span = self.size + 0x110000
        # The last entry is no pair: its rank says never.
        self.pair_keys = np.append(table[:, 0] * self.span + table[:, 1], np.iinfo(np.int64).max)
        self.never = len(self.rank) + 1
        self.pair_ranks = np.append(table[:, 2], self.never).astype(np.int32)
        self.pair_results = np.append(table[:, 3], 0).astype(np.int32)
        if not rows:
            self.pair_ranks[0] = self.never

    def _pairs(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rank and result of merging each left symbol with its right one."""
        keys = left.astype(np.int64) * self.span + right
        at = np.searchsorted(self.pair_keys, keys)
        at[self.pair_keys[at] != keys] = len(self.pair_keys) - 1
        return self.pair_ranks[at], self.pair_results[at]

    def _long(self, word: str) -> list[int]:
        """The symbols of one word of any length, by a heap and linked neighbours."""
        parts: list[str | None] = list(word)
        after, before = list(range(1, len(parts) + 1)), list(range(-1, len(parts) - 1))
        heap: list[tuple[int, int, int, int]] = []

        def propose(left: int, right: int) -> None:
            if left >= 0 and right < len(parts):
                rank = self.rank.get(parts[left] + parts[right])
                if rank is not None:
                    heapq.heappush(heap, (rank, left, right, len(parts[left]) + len(parts[right])))

        for left in range(len(parts) - 1):
            propose(left, left + 1)
        while heap:
            _, left, right, size = heapq.heappop(heap)
            if parts[left] is None or parts[right] is None or len(parts[left]) + len(parts[right]) != size:
                continue
            parts[left], parts[right] = parts[left] + parts[right], None
            after[left] = after[right]
            if after[left] < len(parts):
                before[after[left]] = left
            propose(before[left], left)
            propose(left, after[left])
        return [self._symbol(part) for part in parts if part is not None]

    def _short(self, symbols: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Symbols of many words at once, one merge a word and round; also how many symbols each word is left with.

        ``size`` has the characters of each word, one at least.
        """
        number = np.arange(len(size))
        start = np.cumsum(size) - size
        rank, result = self._pairs(symbols, np.append(symbols[1:], 0))
        rank[start + size - 1] = self.never
        done: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        while len(size):
            best = np.minimum.reduceat(rank, start)
            over = best == self.never
            if over.any():
                gone = np.repeat(over, size)
                done.append((number[over], size[over], symbols[gone]))
                symbols, rank, result = symbols[~gone], rank[~gone], result[~gone]
                number, size, best = number[~over], size[~over], best[~over]
                start = np.cumsum(size) - size
                if not len(size):
                    break
            equal = np.flatnonzero(rank == np.repeat(best, size))
            at = equal[np.searchsorted(equal, start)]  # the leftmost of each word
            symbols[at] = result[at]
            keep = np.ones(len(symbols), bool)
            keep[at + 1] = False
            symbols, rank, result = symbols[keep], rank[keep], result[keep]
            at = at - np.arange(len(at))
            size = size - 1
            start = np.cumsum(size) - size
            rank[at] = self.never
            right = at[at + 1 < start + size]
            rank[right], result[right] = self._pairs(symbols[right], symbols[right + 1])
            left = at[at > start] - 1
            rank[left], result[left] = self._pairs(symbols[left], symbols[left + 1])
        numbers = np.concatenate([row[0] for row in done] or [number])
        sizes = np.concatenate([row[1] for row in done] or [size])
        flat = np.concatenate([row[2] for row in done] or [symbols])
        order = np.argsort(numbers, kind="stable")
        firsts = np.cumsum(sizes) - sizes
        sizes, firsts = sizes[order], firsts[order]
        return flat[spread(firsts, np.cumsum(sizes) - sizes, sizes)], sizes

    def words(self, raw: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids of the pieces of all words, the end of each in its word's bytes, and how many each word has."""
        text = b"".join(raw).decode()
        points = np.frombuffer(text.encode("utf-32-le"), np.uint32)
        bytes_each = np.array([len(word) for word in raw], np.int64)
        lengths = (points >= 0x80).astype(np.int64) + (points >= 0x800) + (points >= 0x10000) + 1
        bounds = np.searchsorted(np.cumsum(lengths), np.cumsum(bytes_each), "left") + 1
        size = np.diff(bounds, prepend=0)
        short = size <= SHORT
        symbols, counts = self._short(self.single[points[np.repeat(short, size)]], size[short])
        if not short.all():
            # Long words go between the others.
            others = iter(np.split(symbols, np.cumsum(counts)[:-1]))
            pieces = [
                next(others) if quick else np.array(self._long(word.decode()), np.int32)
                for word, quick in zip(raw, short.tolist(), strict=True)
            ]
            symbols, counts = np.concatenate(pieces), np.array([len(own) for own in pieces], np.int64)
        return self._coded(symbols, counts)

    def _coded(self, symbols: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Symbols as ids: characters outside of the vocabulary as byte pieces."""
        owner = np.repeat(np.arange(len(counts)), counts)
        foreign = symbols >= self.size
        points = np.where(foreign, symbols - self.size, 0)
        lengths = 1 + (points >= 0x80).astype(np.int64) + (points >= 0x800) + (points >= 0x10000)
        widths = np.where(foreign, lengths, self.widths[np.where(foreign, 0, symbols)])
        ends = np.cumsum(widths)
        before = np.concatenate([[0], ends])[np.cumsum(counts) - counts]
        ends = ends - before[owner]
        if not foreign.any():
            return symbols, ends, counts
        if not self.model.byte_fallback:
            return np.where(foreign, self.unknown, symbols).astype(np.int32), ends, counts
        tokens = np.where(foreign, lengths, 1)
        ids = np.repeat(symbols, tokens)
        places = np.repeat(ends - np.where(foreign, widths, 0), tokens)  # byte pieces stand at the character's start
        last = np.cumsum(tokens) - 1
        places[last] = ends
        raw = "".join(map(chr, points[foreign].tolist())).encode()
        ids[np.repeat(foreign, tokens)] = self.bytes[np.frombuffer(raw, np.uint8)]
        return ids, places, np.bincount(owner, tokens, len(counts)).astype(np.int64)

    def _forget(self) -> None:
        self.known: dict[bytes, int] = {}
        self.held = 0
        self.flat_ids, self.flat_ends = np.zeros(0, np.int32), np.zeros(0, np.int32)
        self.first, self.count = np.zeros(0, np.int64), np.zeros(0, np.int64)

    def _remembered(self, words: list[bytes]) -> np.ndarray:
        """The place of each word in what is remembered; new words are merged together."""
        if self.held > REMEMBERED:
            self._forget()
        known = self.known
        fresh = [word for word in words if word not in known]
        if fresh:
            ids, ends, counts = self.words(fresh)
            self.first = np.append(self.first, len(self.flat_ids) + np.cumsum(counts) - counts)
            self.count = np.append(self.count, counts)
            self.flat_ids = np.append(self.flat_ids, ids.astype(np.int32))
            self.flat_ends = np.append(self.flat_ends, ends.astype(np.int32))
            self.held += sum(map(len, fresh))
            known.update(zip(fresh, range(len(known), len(known) + len(fresh)), strict=True))
        return np.fromiter(map(known.__getitem__, words), np.int64, len(words))

    def _words(self, norm: np.ndarray, places: np.ndarray) -> np.ndarray:
        """Where words start: texts, marks after other characters, and around characters that stand alone."""
        starts = np.zeros(len(norm) + 1, bool)
        starts[places] = True
        if self.mark_leads:
            mark = np.zeros(len(norm), bool)
            mark[:-2] = (norm[:-2] == _SPACE[0]) & (norm[1:-1] == _SPACE[1]) & (norm[2:] == _SPACE[2])
            run = np.zeros(len(norm), bool)
            run[3:] = mark[:-3]
            starts[:-1] |= mark & ~run
        lone = self.alone[norm]
        starts[:-1] |= lone
        starts[1:] |= lone
        return np.flatnonzero(starts[:-1])

    def block(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, ...]:
        """Ids of all texts, begins and ends of their spans in the source text, and the texts' offsets in them."""
        norm, source, places = self.normaliser.block(data, offsets)
        if not len(norm):
            empty = np.zeros(0, np.int64)
            return empty, empty, empty, np.zeros(len(offsets), np.int64)
        words = self._words(norm, places)
        edges = np.append(words, len(norm)).astype(np.int64)
        buffers = [None, pa.py_buffer(edges.tobytes()), pa.py_buffer(norm.tobytes())]
        coded = pa.Array.from_buffers(pa.large_binary(), len(words), buffers).dictionary_encode()
        which = self._remembered(coded.dictionary.to_pylist())[coded.indices.to_numpy()]
        count = self.count[which]
        first = np.cumsum(count) - count
        take = spread(self.first[which], first, count)
        ids = self.flat_ids[take]
        ends = self.flat_ends[take] + np.repeat(words, count)
        # Ends in the source; an end that closes a text closes its source too.
        owner = np.repeat(owners(words, places), count)
        closes = ends == places[owner + 1]
        ends = np.where(closes, offsets[owner + 1] - 1, source[np.minimum(ends, len(source) - 1)]) - offsets[owner]
        tokens = np.bincount(owner, minlength=len(offsets) - 1)
        bounds = np.concatenate([[0], np.cumsum(tokens)])
        begins = np.append(0, ends[:-1])
        begins[bounds[:-1][tokens > 0]] = source[places[:-1][tokens > 0]] - offsets[:-1][tokens > 0]
        return ids, begins, ends, bounds

    def decode(self, ids: list[int]) -> str:
        text = b"".join(map(self.surface.__getitem__, ids)).decode(errors="replace")
        leads = self.model.dummy_prefix or self.model.trim_spaces
        return text[1:] if leads and text.startswith(" ") and ids and self.model.pieces[ids[0]][2] == NORMAL else text


def encode_pieces(docs: DataFrame, model: str, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Columns ``keep``, ``ids``, ``begins`` and ``ends`` (arrays of int) and ``decoded``.

    Piece ``k`` comes from the bytes ``begins[k] … ends[k]`` of the UTF-8 text.
    ``model`` is the path of a SentencePiece file of the kind that merges pairs, read
    on the driver; what is broadcast has the size of that file, whatever the data.
    """
    spark = docs.sparkSession
    Model.read(model)
    with open(model, "rb") as file:
        shared = spark.sparkContext.broadcast(file.read())
    rows = docs.select(*keep, docs[text].alias("_text"))

    def encode(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(Model.parse(shared.value))
        for block in text_blocks(batches, "_text"):
            ids, begins, ends, bounds = encoder.block(*flat_bytes(block.column("_text")))
            places = pa.array(bounds, pa.int32())
            lists = [pa.ListArray.from_arrays(places, pa.array(values, pa.int32())) for values in (ids, begins, ends)]
            plain = ids.tolist()
            texts = [encoder.decode(plain[a:b]) for a, b in zip(bounds[:-1], bounds[1:], strict=True)]
            kept = [block.column(name) for name in keep]
            names = [*keep, "ids", "begins", "ends", "decoded"]
            yield pa.RecordBatch.from_arrays([*kept, *lists, pa.array(texts, pa.string())], names)

    kept = ", ".join(f"`{name}` {rows.schema[name].dataType.simpleString()}" for name in keep)
    kept = kept and f"{kept}, "
    return rows.mapInArrow(encode, f"{kept}ids array<int>, begins array<int>, ends array<int>, decoded string")
