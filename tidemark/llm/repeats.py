"""Repeated passages: shard Burrows-Wheeler transforms merged by interleave refinement.

Every byte that lies in a string of :data:`LENGTH` bytes which also starts anywhere
else in the corpus is a repeated byte.  Three steps find them exactly:

1. *Pruning.*  Each string of that length has an anchor: the least hash of the
   :data:`GRAM`-byte strings in it.  Equal strings have equal anchors, so strings whose
   anchor occurs once in the corpus are unique.  Anchors are counted chunk by chunk.
2. *Merging.*  Runs of strings with the same repeated anchor are dealt by anchor, so
   that equal strings meet.  Where they meet, equal runs are counted once, and the
   rest is indexed: runs are texts over the alphabet of :data:`SYMBOL`-byte blocks, each
   shard has its suffix order and its Burrows-Wheeler transform, and the transforms of
   all shards are merged by refining an interleave.  One refinement stably sorts the
   interleave by the preceding symbols and makes the known common prefix one symbol
   longer; after ``LENGTH / SYMBOL`` of them the interleave's blocks are the intervals of
   equal strings.  No suffixes of different shards are ever compared.
3. *Covering.*  Each chunk marks the bytes of its repeated strings.

An anchor that occurs :data:`HOT` times or more (a notice in a third of all documents)
would bring an unbounded number of runs together, so its strings are counted by hash
like the anchors; equal strings of one chunk are one row there.

Null texts are empty.  Repeated rows are repeated text: of two equal rows of at least
``LENGTH`` bytes all bytes are repeated.  Strings never cross documents.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from tidemark.llm.arrays import PrefixHash, U, flat_bytes, mix, text_blocks
from tidemark.llm.chunks import ASKED, Answers, Layout, ask, asked_table, in_chunks, opened, packed, totals, unpacked, with_answers

# Fixed value: the length of a repeated string.
LENGTH = 200
GRAM = 32
SYMBOL = 50
HOT = 1000
LONGEST_RUN = 256
#: Bytes of runs in one index, or one anchor's runs.
INDEX_BYTES = 1 << 18
SHARDS = 8
ANCHORS, STRINGS, RUNS = 1, 2, 3
#: Bytes of text whose hashes are at hand at once: their arrays then stay in memory that the worker already has.
BLOCK = 1 << 17


def ranges(first: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The numbers ``first, first + 1, …`` of each range, one range after the other."""
    ends = np.cumsum(size)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(first - (ends - size), size)


def sliding(of: np.ufunc, values: np.ndarray, width: int) -> np.ndarray:
    """The minimum (or maximum) of each window of ``width`` values, by its start."""
    count = len(values) - width + 1
    rows = np.concatenate([values, np.repeat(values[-1:], -len(values) % width)]).reshape(-1, width)
    front = of.accumulate(rows, axis=1).ravel()
    back = of.accumulate(rows[:, ::-1], axis=1)[:, ::-1].ravel()
    return of(back[:count], front[width - 1 : width - 1 + count])


class Bytes:
    """The bytes of one block of documents, hashed once they are asked for."""

    def __init__(self, texts: pa.Array):
        self.data, self.offsets = flat_bytes(texts)

    @cached_property
    def hashes(self) -> PrefixHash:
        return PrefixHash(self.data)


@dataclass
class Runs:
    """Runs of consecutive string starts with one anchor, over one block of documents."""

    anchor: np.ndarray
    start: np.ndarray
    size: np.ndarray
    weight: np.ndarray

    @staticmethod
    def of(texts: pa.Array) -> Runs:
        block = Bytes(texts)
        offsets = block.offsets
        grams, width = block.hashes.windows(GRAM), LENGTH - GRAM + 1
        count = len(grams) - width + 1
        none = np.zeros(0, np.int64)
        if count <= 0:
            return Runs(np.zeros(0, np.uint64), none, none, none)
        least = sliding(np.minimum, grams, width)
        # Starts reach from a document's first byte to its last whole string; a new least hash begins a new run.
        begin, after = offsets[:-1], np.maximum(offsets[1:] - LENGTH, offsets[:-1])
        edges = np.unique(np.concatenate([np.flatnonzero(least[1:] != least[:-1]) + 1, begin, after]))
        inside = edges < after[np.minimum(np.searchsorted(begin, edges, "right") - 1, len(after) - 1)]
        start, size = edges[inside], (np.append(edges[1:], 0) - edges)[inside]
        if not len(start):
            return Runs(np.zeros(0, np.uint64), none, none, none)
        # Long runs, as in texts of one letter, are cut; their parts keep the anchor.
        parts = -(-size // LONGEST_RUN)
        part = ranges(np.zeros(len(size), np.int64), parts)
        anchor = np.repeat(least[start], parts)
        first = np.repeat(start, parts) + part * LONGEST_RUN
        size = np.minimum(np.repeat(size, parts) - part * LONGEST_RUN, LONGEST_RUN)
        # A run that holds its anchor more than once may repeat itself.  Only places that are
        # the least of a window can be an anchor: those where the greatest least is the place's own.
        edge = np.zeros(width - 1, np.uint64)
        places = np.flatnonzero(sliding(np.maximum, np.concatenate([edge, least, edge]), width) == grams)
        low = np.searchsorted(places, first)
        held = np.searchsorted(places, first + size + width - 1) - low
        same = grams[places[ranges(low, held)]] == np.repeat(anchor, held)
        weight = np.minimum(np.add.reduceat(same, np.cumsum(held) - held, dtype=np.int64), 2)
        # Least hashes are all small; mixed again they spread over the buckets.
        return Runs(mix(anchor), first, size, weight)

    def content(self, block: Bytes, chosen: np.ndarray) -> np.ndarray:
        """A hash of the bytes that the strings of each chosen run cover."""
        start = self.start[chosen]
        return block.hashes.ranges(start, start + self.size[chosen] + LENGTH - 1)


class Chunk:
    """All runs of a chunk's documents, block by block.

    The runs are found once and held; the bytes of a block and their hashes, which are
    many times larger, are made again where a later step needs them.
    """

    def __init__(self, docs: pa.Table):
        self.blocks = [b for batch in docs.combine_chunks().to_batches() for b in text_blocks([batch], "_text", BLOCK)]
        self.runs = [Runs.of(block.column("_text")) for block in self.blocks]
        found = np.concatenate([*(runs.anchor for runs in self.runs), np.zeros(0, np.uint64)])
        self.anchors, self.number = np.unique(found, return_inverse=True)

    def counts(self) -> np.ndarray:
        weights = np.concatenate([*(runs.weight for runs in self.runs), np.zeros(0, np.int64)])
        return np.bincount(self.number, weights, minlength=len(self.anchors)).astype(np.int64)

    def suspects(self, total: np.ndarray) -> Iterator[tuple[pa.RecordBatch, Bytes, Runs, np.ndarray, np.ndarray]]:
        """Each block with its runs, those to be merged and those to be counted by string."""
        at = 0
        for block, runs in zip(self.blocks, self.runs, strict=True):
            own = total[self.number[at : at + len(runs.anchor)]]
            at += len(runs.anchor)
            yield block, Bytes(block.column("_text")), runs, np.flatnonzero((own >= 2) & (own < HOT)), np.flatnonzero(own >= HOT)


def string_hashes(block: Bytes, runs: Runs, chosen: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start and hash of each string of the chosen runs."""
    starts = ranges(runs.start[chosen], runs.size[chosen])
    return starts, block.hashes.ranges(starts, starts + LENGTH) if len(starts) else np.zeros(0, np.uint64)


def distinct_runs(anchor: np.ndarray, content: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The first of each distinct run in the order of anchor and content, and each run's place in it."""
    order = np.lexsort((content, anchor))
    new = np.ones(len(order), bool)
    new[1:] = (anchor[order[1:]] != anchor[order[:-1]]) | (content[order[1:]] != content[order[:-1]])
    place = np.empty(len(order), np.int64)
    place[order] = np.cumsum(new) - 1
    return order[new], place


def stable_order(key: np.ndarray, bits: int) -> np.ndarray:
    """The places of ``key`` in stable order; keys are below ``2 ** bits``.

    Key and place sorted as one number are quicker than a stable sort.
    """
    own = len(key).bit_length()
    if bits + own > 64:
        return np.argsort(key, kind="stable")
    numbered = (key.astype(np.uint64) << U(own)) | np.arange(len(key), dtype=np.uint64)
    return (np.sort(numbered) & U((1 << own) - 1)).astype(np.int64)


def suffix_order(symbol: np.ndarray, successor: np.ndarray, shard: np.ndarray, longest: int) -> np.ndarray:
    """The suffixes of each shard in order, shard after shard.

    ``symbol`` is 0 for the empty suffix at a text's end, which is its own successor;
    others are numbers up to the count of suffixes.
    """
    rank, step, reach = symbol, successor, 1
    bits = len(symbol).bit_length()
    first = shard.astype(np.uint64) << U(2 * bits)
    while True:
        pair = first | (rank.astype(np.uint64) << U(bits)) | rank[step].astype(np.uint64)
        order = stable_order(pair, 2 * bits + int(shard.max(initial=0)).bit_length())
        if 2 * reach >= longest:
            return order
        ordered = pair[order]
        dense = np.empty(len(order), np.int64)
        dense[order] = np.concatenate([[0], np.cumsum(ordered[1:] != ordered[:-1])])
        rank, step, reach = dense, step[step], 2 * reach


def merge_transforms(
    symbol: np.ndarray, successor: np.ndarray, shard: np.ndarray, longest: int, depth: int
) -> tuple[np.ndarray, np.ndarray]:
    """Suffixes of all shards in merged order, and the block of ``depth`` equal symbols each is in.

    Only the shards' transforms (the symbol before each suffix, 0 at a text's start) and
    the interleave take part in the refinement.
    """
    size = len(symbol)
    symbol = np.unique(symbol, return_inverse=True)[1]
    bits = size.bit_length()
    previous = np.full(size, -1, np.int64)
    inner = np.flatnonzero(symbol != 0)
    previous[successor[inner]] = inner
    order = suffix_order(symbol, successor, shard, longest)
    before = previous[order]
    transform = np.where(before >= 0, symbol[before], 0)
    interleave = shard[order].astype(np.uint8)  # at the start: shard after shard
    block = np.zeros(size, np.int64)
    ends = np.sort(shard[symbol == 0]).astype(np.uint8)
    for _ in range(depth):
        # Read each shard's transform in its own order along the interleave.
        turn = np.argsort(interleave, kind="stable")
        read = np.empty(size, np.int64)
        read[turn] = transform
        moved = np.flatnonzero(read)
        moved = moved[stable_order(read[moved], bits)]
        new = np.ones(len(moved), bool)
        new[1:] = (read[moved[1:]] != read[moved[:-1]]) | (block[moved[1:]] != block[moved[:-1]])
        # Empty suffixes come first and stand alone.
        interleave = np.concatenate([ends, interleave[moved]])
        block = np.concatenate([np.arange(len(ends)), len(ends) + np.cumsum(new) - 1])
    merged = np.empty(size, np.int64)
    merged[np.argsort(interleave, kind="stable")] = order
    return merged, block


def repeated_starts(raw: list[bytes], weight: np.ndarray, shard: np.ndarray) -> list[np.ndarray]:
    """For each run's bytes, which of its strings start anywhere else too."""
    data = np.frombuffer(b"".join(raw), np.uint8)
    sizes = np.array([len(text) for text in raw], np.int64)
    # A run of n bytes is SYMBOL texts of blocks; places n - SYMBOL + 1 … n are their empty suffixes.
    held = sizes + 1
    firsts = np.cumsum(held) - held
    inside = ranges(np.zeros(len(sizes), np.int64), held)
    run = np.repeat(np.arange(len(sizes)), held)
    whole = inside <= sizes[run] - SYMBOL
    hashes = PrefixHash(data)
    starts = np.repeat(np.cumsum(sizes) - sizes, held) + inside
    symbol = np.zeros(len(inside), np.uint64)
    symbol[whole] = hashes.ranges(starts[whole], starts[whole] + SYMBOL) | U(1)
    entry = np.arange(len(inside))
    successor = np.where(whole, entry + SYMBOL, entry)
    longest = int(sizes.max() // SYMBOL) + 1
    merged, block = merge_transforms(symbol, successor, shard[run], longest, LENGTH // SYMBOL)
    # Strings only: a suffix with fewer symbols stands alone by its empty end.
    string = inside <= sizes[run] - LENGTH
    seen = np.bincount(block, np.where(string[merged], weight[run[merged]], 0))
    twice = np.zeros(len(inside), bool)
    twice[merged] = seen[block] >= 2
    twice &= string
    return [twice[first : first + size - LENGTH + 1] for first, size in zip(firsts, sizes, strict=True)]


def merge_runs(table: pa.Table) -> pa.Table:
    """Answer one bucket's questions about runs: a bit for each string of each run."""
    anchor, content, size, weight, raw, shard, held = [], [], [], [], [], [], []
    for row in table.to_pylist():
        n = row["_size"]
        keys = unpacked(row["_keys"], np.uint64)
        anchor.append(keys[:n])
        content.append(keys[n:])
        own = unpacked(row["_counts"][: 8 * n], np.uint32)
        size.append(own[:n].astype(np.int64))
        weight.append(own[n:].astype(np.int64))
        raw.append(row["_counts"][8 * n :])
        shard.append(np.full(n, row["_chunk"] % SHARDS))
        held.append(n)
    anchor, content, size, weight, shard = map(np.concatenate, (anchor, content, size, weight, shard))
    starts = np.cumsum(size) - size
    text = b"".join(raw)
    first, place = distinct_runs(anchor, content)
    total = np.bincount(place, weight, minlength=len(first)).astype(np.int64)
    # A group of runs with one anchor in which each run occurs twice needs no index.
    group = np.concatenate([[0], np.cumsum(anchor[first[1:]] != anchor[first[:-1]])]).astype(np.int64)
    indexed = np.flatnonzero((np.bincount(group, total == 1) > 0)[group])
    marks = [np.ones(size[run] - LENGTH + 1, bool) for run in first]
    # Groups do not depend on each other, so an index is made of a few at a time.
    volume = np.cumsum(size[first[indexed]])
    while len(indexed):
        stop = int(np.searchsorted(volume, INDEX_BYTES, "right"))
        last = group[indexed[max(stop, 1) - 1]]
        stop = int(np.searchsorted(group[indexed], last, "right" if stop == 0 or stop == len(indexed) else "left"))
        stop = stop or int(np.searchsorted(group[indexed], last, "right"))
        part, runs = indexed[:stop], first[indexed[:stop]]
        found = repeated_starts([text[starts[r] : starts[r] + size[r]] for r in runs], total[part], shard[runs])
        for where, mark in zip(part, found, strict=True):
            marks[where] = mark
        indexed, volume = indexed[stop:], volume[stop:] - volume[stop - 1]
    bits, at = [], 0
    for n in held:
        own = [marks[place[run]] for run in range(at, at + n)]
        bits.append(np.packbits(np.concatenate(own)).tobytes())
        at += n
    rows = table.num_rows
    return pa.table({
        "_chunk": table.column("_chunk"), "_kind": table.column("_kind"), "_bucket": table.column("_bucket"),
        "_totals": pa.array(bits, pa.binary()), "_first": pa.array([b""] * rows, pa.binary()),
        "_distinct": pa.array([0] * rows, pa.int64()), "_sum": pa.array([0] * rows, pa.int64()),
    })


def _whole_characters(data: np.ndarray, first: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Spans shrunk to whole UTF-8 characters."""
    first, end = first.copy(), end.copy()
    for _ in range(3):
        first += (first < end) & ((data[first] & 0xC0) == 0x80)
        end -= (first < end) & ((data[end] & 0xC0) == 0x80)
    return first, np.maximum(first, end)


def repeated_spans(
    docs: DataFrame, text: str = "text", keep: tuple[str, ...] = ("doc_id",), whole_characters: bool = False
) -> DataFrame:
    """Columns ``keep``, ``n_bytes``, ``spans`` (maximal repeated byte ranges) and ``kept`` (the other bytes), for every row.

    With ``whole_characters`` spans shrink to whole characters, so that ``kept`` stays UTF-8.
    """
    layout = Layout(docs, text)
    bits = layout.bits
    named = docs.select(*keep, docs[text].alias("_text"))
    chunks = in_chunks(named, "_text", keep, layout)

    def ask_anchors(blobs: pa.Table) -> pa.Table:
        chunk = Chunk(opened(blobs))
        return asked_table(ask(blobs.column("_chunk")[0].as_py(), ANCHORS, chunk.anchors, chunk.counts(), bits))

    def ask_strings(blobs: pa.Table, answered: pa.Table) -> pa.Table:
        number = blobs.column("_chunk")[0].as_py()
        chunk = Chunk(opened(blobs))
        strings, anchor, content, raw = [], [], [], []
        for _, block, runs, merged, counted in chunk.suspects(Answers(answered).totals(ANCHORS)):
            strings.append(string_hashes(block, runs, counted)[1])
            anchor.append(runs.anchor[merged])
            content.append(runs.content(block, merged))
            ends = runs.start[merged] + runs.size[merged] + LENGTH - 1
            raw += [block.data[a:b].tobytes() for a, b in zip(runs.start[merged].tolist(), ends.tolist(), strict=True)]
        rows = []
        keys, counts = np.unique(np.concatenate([*strings, np.zeros(0, np.uint64)]), return_counts=True)
        if len(keys):
            rows += ask(number, STRINGS, keys, counts, bits)
        anchors = np.concatenate([*anchor, np.zeros(0, np.uint64)])
        contents = np.concatenate([*content, np.zeros(0, np.uint64)])
        first, place = distinct_runs(anchors, contents)
        weight = np.bincount(place, minlength=len(first)).astype(np.uint32)
        buckets = anchors[first] >> U(64 - bits)
        for bucket in np.unique(buckets).tolist():
            low, high = np.searchsorted(buckets, [bucket, bucket + 1])
            own = first[low:high]
            texts = [raw[run] for run in own]
            numbers = np.concatenate([np.array([len(t) for t in texts], np.uint32), weight[low:high]])
            keys = np.concatenate([anchors[own], contents[own]])
            rows.append((bucket, number, RUNS, int(high - low), packed(keys), packed(numbers) + b"".join(texts)))
        return asked_table(rows)

    def cover(blobs: pa.Table, answered: pa.Table) -> pa.Table:
        chunk, answers = Chunk(opened(blobs)), Answers(answered)
        parts, anchor, content, size, hot = [], [], [], [], []
        for rows, block, runs, merged, counted in chunk.suspects(answers.totals(ANCHORS)):
            anchor.append(runs.anchor[merged])
            content.append(runs.content(block, merged))
            size.append(runs.size[merged])
            hot.append(string_hashes(block, runs, counted))
            parts.append((rows, block.data, block.offsets, runs.start[merged], runs.size[merged]))
        anchors = np.concatenate([*anchor, np.zeros(0, np.uint64)])
        contents = np.concatenate([*content, np.zeros(0, np.uint64)])
        sizes = np.concatenate([*size, np.zeros(0, np.int64)]).astype(np.int64)
        first, place = distinct_runs(anchors, contents)
        buckets = anchors[first] >> U(64 - bits)
        marks = []
        for bucket, raw in answers.rows(RUNS):
            low, high = np.searchsorted(buckets, [bucket, bucket + 1])
            marks.append(np.unpackbits(np.frombuffer(raw, np.uint8), count=int(sizes[first[low:high]].sum())))
        marks = np.concatenate([*marks, np.zeros(0, np.uint8)]).astype(bool)
        mark_at = np.cumsum(sizes[first]) - sizes[first]
        keys = np.unique(np.concatenate([*(hashes for _, hashes in hot), np.zeros(0, np.uint64)]))
        twice = answers.totals(STRINGS) >= 2
        tables, at = [], 0
        for (block, data, offsets, start, size), (starts, hashes) in zip(parts, hot, strict=True):
            own = place[at : at + len(start)]
            at += len(start)
            found = ranges(start, size)[marks[ranges(mark_at[own], size)]]
            if len(keys):
                found = np.concatenate([found, starts[twice[np.searchsorted(keys, hashes)]]])
            tables.append(_covered(block, data, offsets, found, keep, whole_characters))
        return pa.concat_tables(tables)

    counted = totals(chunks.groupBy("_chunk").applyInArrow(ask_anchors, ASKED), bits)
    asked = with_answers(chunks, counted, ask_strings, ASKED)
    answers = counted.unionByName(totals(asked, bits, {RUNS: merge_runs}))
    kept = ", ".join(f"`{name}` {named.schema[name].dataType.simpleString()}" for name in keep)
    result = "n_bytes long, spans array<struct<start:long,end:long>>, kept binary"
    return with_answers(chunks, answers, cover, f"{kept}, {result}")


def _covered(
    block: pa.RecordBatch, data: np.ndarray, offsets: np.ndarray, starts: np.ndarray, keep, whole_characters: bool
) -> pa.Table:
    """One block's rows of :func:`repeated_spans` from the starts of its repeated strings."""
    change = np.zeros(len(data) + 1, np.int8)
    change[starts] += 1
    change[starts + LENGTH] -= 1
    removed = np.zeros(len(data) + 2, np.int8)
    removed[1:-1] = np.cumsum(change, dtype=np.int32)[:-1] > 0
    edges = np.flatnonzero(np.diff(removed))
    first, end = edges[::2], edges[1::2]
    if whole_characters and len(first):
        first, end = _whole_characters(data, first, end)
        first, end = first[first < end], end[first < end]
    left = np.ones(len(data), bool)
    left[ranges(first, end - first)] = False
    left[offsets[1:] - 1] = False  # the added line feeds
    kept = np.concatenate([[0], np.cumsum(left)])[offsets]
    span = np.searchsorted(first, offsets)
    document = np.searchsorted(offsets, first, "right") - 1
    bounds = [pa.array(edge - offsets[document], pa.int64()) for edge in (first, end)]
    spans = pa.ListArray.from_arrays(pa.array(span, pa.int32()), pa.StructArray.from_arrays(bounds, ["start", "end"]))
    raw = pa.LargeBinaryArray.from_buffers(
        pa.large_binary(), len(offsets) - 1, [None, pa.py_buffer(kept.astype(np.int64)), pa.py_buffer(data[left].tobytes())]
    )
    columns = {"n_bytes": pa.array(np.diff(offsets) - 1, pa.int64()), "spans": spans, "kept": raw.cast(pa.binary())}
    return pa.table({name: block.column(name) for name in keep} | columns)
