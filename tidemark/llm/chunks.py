"""Counting keys of whole texts across a corpus, chunk by chunk.

Texts are dealt by a hash of the row into chunks of about :data:`CHUNK_BYTES`.
A chunk asks for the totals of its distinct 64-bit keys: it sends them, sorted and
counted, in one packed row for each bucket of the key space; a bucket adds up the
counts of all chunks and answers each of them with totals in the order of its keys.
Sums over keys that a chunk has asked about before are sent without them, by place.

A key that makes up a third of the corpus is one key per chunk, chunks and
buckets are even by hashing, and no task holds more than one of either.  Both sizes
follow from the bytes of text, whatever they are.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.arrays import U, give_back, text_blocks

CHUNK_BYTES = 4 << 20

ASKED = "_bucket int, _chunk int, _kind int, _size int, _keys binary, _counts binary"
ANSWERED = "_chunk int, _kind int, _bucket int, _totals binary, _first binary, _distinct long, _sum long"


class Layout:
    """How many chunks, of ``times`` the usual size, and buckets a corpus of so many bytes of text gets."""

    def __init__(self, docs: DataFrame, text: str, times: int = 1):
        found = docs.agg(F.sum(F.octet_length(docs[text]).cast("long")).alias("bytes")).first()
        self.chunks = max(1, -(-(found.bytes or 0) // (times * CHUNK_BYTES)))
        self.bits = max(1, (self.chunks - 1).bit_length() + 1)


def packed(values: np.ndarray) -> bytes:
    """Numbers as planes of equal bytes, so that high zero bytes compress to nothing."""
    return np.ascontiguousarray(values.view(np.uint8).reshape(len(values), values.itemsize).T).tobytes()


def unpacked(raw: bytes, kind: type) -> np.ndarray:
    planes = np.frombuffer(raw, np.uint8).reshape(np.dtype(kind).itemsize, -1)
    return np.ascontiguousarray(planes.T).view(kind).ravel()


#: Added to the first byte of totals whose planes are compressed further, to less than a byte for each small total.
PRESSED = 64


def packed_totals(values: np.ndarray, press: bool = False) -> bytes:
    """Totals in four bytes each, in eight where one of them needs more; the first byte says which."""
    kind = np.uint64 if len(values) and values.max() >= 1 << 32 else np.uint32
    size, planes = np.dtype(kind).itemsize, packed(values.astype(kind))
    return bytes([size + PRESSED]) + zlib.compress(planes, 1) if press else bytes([size]) + planes


def unpacked_totals(raw: bytes) -> np.ndarray:
    planes = zlib.decompress(raw[1:]) if raw[0] > PRESSED else raw[1:]
    return unpacked(planes, np.uint64 if raw[0] % PRESSED == 8 else np.uint32).astype(np.int64)


def in_chunks(docs: DataFrame, text: str, keep: Sequence[str], layout: Layout) -> DataFrame:
    """Rows ``_chunk`` and ``_blob``: documents (``keep`` and ``_text``) as compressed Arrow, dealt by chunk."""
    from_row = F.pmod(F.xxhash64(docs[text], *(docs[c] for c in keep)), F.lit(layout.chunks)).cast("int")
    rows = docs.select(*keep, docs[text].alias("_text"), from_row.alias("_chunk"))

    def deal(batches):
        for block in text_blocks(batches, "_text", 8 << 20):
            chunk = block.column("_chunk").to_numpy()
            order = np.argsort(chunk, kind="stable")
            ids, starts = np.unique(chunk[order], return_index=True)
            sorted_rows = block.drop_columns(["_chunk"]).take(pa.array(order))
            blobs = []
            for start, stop in zip(starts, [*starts[1:], len(order)], strict=True):
                sink = pa.BufferOutputStream()
                piece = sorted_rows.slice(start, stop - start)
                with pa.ipc.new_stream(sink, piece.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
                    out.write_batch(pa.RecordBatch.from_struct_array(pa.concat_arrays([piece.to_struct_array()])))
                blobs.append(sink.getvalue().to_pybytes())
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int32()), pa.array(blobs, pa.binary())], ["_chunk", "_blob"])

    return rows.mapInArrow(deal, "_chunk int, _blob binary")


def opened(blobs: pa.Table) -> pa.Table:
    """The documents of a chunk's blobs."""
    give_back()  # what the chunk before has left
    return pa.concat_tables(pa.ipc.open_stream(blob.as_py()).read_all() for blob in blobs.column("_blob"))


def ask(
    chunk: int, kind: int, keys: np.ndarray, counts: np.ndarray, bits: int, press: bool = False, again: bool = False
) -> list[tuple]:
    """Rows of :data:`ASKED` for a chunk's sorted distinct keys and their counts, one for every bucket.

    ``press`` compresses the counts further; ``again`` leaves the keys out, for :func:`totals_again`.
    """
    edges = np.searchsorted(keys >> U(64 - bits), np.arange((1 << bits) + 1, dtype=np.uint64))
    counts = counts.astype(np.uint32)
    rows = []
    for bucket, (low, high) in enumerate(zip(edges[:-1], edges[1:], strict=True)):
        steps = b"" if again else packed(np.diff(keys[low:high], prepend=U(bucket) << U(64 - bits)))
        own = packed_totals(counts[low:high], True) if press else packed(counts[low:high])
        rows.append((bucket, chunk, kind, int(high - low), steps, own))
    return rows


def asked_table(rows: list[tuple]) -> pa.Table:
    kinds = [pa.int32()] * 4 + [pa.binary()] * 2
    columns = list(zip(*rows, strict=True)) or [[]] * len(kinds)
    names = [part.split()[0] for part in ASKED.split(", ")]
    return pa.table({name: pa.array(column, kind) for name, column, kind in zip(names, columns, kinds, strict=True)})


class Bucket:
    """The keys of one kind and bucket, of all chunks."""

    def __init__(self, table: pa.Table):
        self.sizes = np.array(table.column("_size").to_pylist(), np.int64)
        steps = [unpacked(raw.as_py(), np.uint64) for raw in table.column("_keys")]
        keys = np.concatenate([np.cumsum(s, dtype=np.uint64) for s in steps])
        self.order = np.argsort(keys, kind="stable")
        self.new = np.ones(len(keys), bool)
        self.new[1:] = keys[self.order[1:]] != keys[self.order[:-1]]
        self.group = np.cumsum(self.new) - 1

    def sums(self, counts: np.ndarray) -> np.ndarray:
        """For each distinct key, the sum of all chunks' counts."""
        return np.add.reduceat(counts[self.order], np.flatnonzero(self.new)) if len(counts) else np.zeros(0, np.int64)

    def spread(self, values: np.ndarray) -> np.ndarray:
        """Values of the distinct keys, in the order in which chunks have sent them."""
        found = np.empty(len(self.order), values.dtype)
        found[self.order] = values[self.group]
        return found

    def slices(self) -> list[slice]:
        ends = np.cumsum(self.sizes)
        return [slice(a, b) for a, b in zip(ends - self.sizes, ends, strict=True)]


def totals(
    asked: DataFrame, bits: int, others: dict[int, Callable[[pa.Table], pa.Table]] | None = None, press: bool = False
) -> DataFrame:
    """Answers of :data:`ANSWERED` to all questions; ``others`` answers kinds that are not about totals.

    ``_first`` marks the keys that no chunk of a lower number has counted, so each
    counted key is marked once in the corpus.  ``_distinct`` and ``_sum`` are the
    bucket's number of counted keys and the sum of their counts.  With ``press``, counts
    and totals are compressed further, and the marks of keys that no other chunk has
    asked about follow those of ``_first``.
    """

    def add(table: pa.Table) -> pa.Table:
        table = table.sort_by("_chunk")
        other = (others or {}).get(table.column("_kind")[0].as_py())
        if other:
            return other(table)
        bucket = table.column("_bucket")[0].as_py()
        keys = Bucket(table)
        raws = [raw.as_py() for raw in table.column("_counts")]
        counts = np.concatenate([unpacked_totals(raw) if press else unpacked(raw, np.uint32) for raw in raws]).astype(np.int64)
        sums = keys.sums(counts)
        answer = keys.spread(sums)
        # The first counting chunk of each key: rows are in chunk order and the sort is stable.
        counted = np.flatnonzero(counts[keys.order] > 0)
        first = np.zeros(len(counts), np.uint8)
        if len(counted):
            lead = np.ones(len(counted), bool)
            lead[1:] = keys.group[counted[1:]] != keys.group[counted[:-1]]
            first[keys.order[counted[lead]]] = 1
        slices = keys.slices()
        marks = [np.packbits(first[s]).tobytes() for s in slices]
        if press:
            alone = keys.spread(np.bincount(keys.group, minlength=len(sums)) == 1)
            marks = [mark + np.packbits(alone[s]).tobytes() for mark, s in zip(marks, slices, strict=True)]
        rows = len(slices)
        return pa.table({
            "_chunk": table.column("_chunk"),
            "_kind": table.column("_kind"),
            "_bucket": pa.array([bucket] * rows, pa.int32()),
            "_totals": pa.array([packed_totals(answer[s], press) for s in slices], pa.binary()),
            "_first": pa.array(marks, pa.binary()),
            "_distinct": pa.array([int((sums > 0).sum())] * rows, pa.int64()),
            "_sum": pa.array([int(sums.sum())] * rows, pa.int64()),
        })

    return asked.groupBy("_kind", "_bucket").applyInArrow(add, ANSWERED)


def totals_again(asked: DataFrame, sent: DataFrame, kind: int) -> DataFrame:
    """Totals of the counts in ``sent``, pressed and without keys: they belong to those ``asked`` about, of the same kind and chunk.

    Answers are of the kind asked about plus ``kind``, and have no marks.
    """

    def add(key: tuple[pa.Scalar, ...], left: pa.Table, right: pa.Table) -> pa.Table:
        left, right = left.sort_by("_chunk"), right.sort_by("_chunk")
        rows = right.num_rows
        found = []
        if rows:
            keys = Bucket(left)
            counts = np.concatenate([unpacked_totals(raw.as_py()) for raw in right.column("_counts")])
            answer = keys.spread(keys.sums(counts))
            found = [packed_totals(answer[s], True) for s in keys.slices()]
        return pa.table({
            "_chunk": right.column("_chunk"),
            "_kind": pa.array([number + kind for number in right.column("_kind").to_pylist()], pa.int32()),
            "_bucket": right.column("_bucket"),
            "_totals": pa.array(found, pa.binary()),
            "_first": pa.array([b""] * rows, pa.binary()),
            "_distinct": pa.array([0] * rows, pa.int64()),
            "_sum": pa.array([0] * rows, pa.int64()),
        })

    return asked.groupBy("_kind", "_bucket").cogroup(sent.groupBy("_kind", "_bucket")).applyInArrow(add, ANSWERED)


class Answers:
    """A chunk's answers, in the order of its keys."""

    def __init__(self, table: pa.Table):
        self.table = table.sort_by("_bucket") if table.num_rows else table
        self.kinds = np.array(self.table.column("_kind").to_pylist(), np.int64)
        self.sizes: dict[int, list[int]] = {}

    def _rows(self, kind: int) -> pa.Table:
        return self.table.filter(pa.array(self.kinds == kind))

    def totals(self, kind: int) -> np.ndarray:
        found = [unpacked_totals(raw.as_py()) for raw in self._rows(kind).column("_totals")]
        self.sizes[kind] = [len(part) for part in found]
        return np.concatenate(found) if found else np.zeros(0, np.int64)

    def first(self, kind: int) -> np.ndarray:
        return self._marks(kind, 0)

    def alone(self, kind: int) -> np.ndarray:
        """The keys that no other chunk has asked about, counted or not; only pressed answers say it."""
        return self._marks(kind, 1)

    def _marks(self, kind: int, which: int) -> np.ndarray:
        if kind not in self.sizes:
            self.totals(kind)
        parts = []
        for marks, size in zip(self._rows(kind).column("_first"), self.sizes[kind], strict=True):
            each = -(-size // 8)
            bits = np.frombuffer(marks.as_py(), np.uint8)[which * each : (which + 1) * each]
            parts.append(np.unpackbits(bits, count=size).astype(bool))
        return np.concatenate(parts) if parts else np.zeros(0, bool)

    def rows(self, kind: int) -> list[tuple[int, bytes]]:
        """Bucket and answer of each row of a kind that is not about totals."""
        found = self._rows(kind)
        return list(zip(found.column("_bucket").to_pylist(), found.column("_totals").to_pylist(), strict=True))

    def corpus(self, kind: int) -> tuple[int, int]:
        """Distinct counted keys and the sum of all counts, over the whole corpus."""
        rows = self._rows(kind)
        return sum(rows.column("_distinct").to_pylist()), sum(rows.column("_sum").to_pylist())


def with_answers(chunks: DataFrame, answers: DataFrame, work: Callable[[pa.Table, pa.Table], pa.Table], schema: str):
    """Apply ``work`` to each chunk's blobs and answers."""

    def both(key: tuple[pa.Scalar, ...], left: pa.Table, right: pa.Table) -> pa.Table:
        return work(left, right)

    return chunks.groupBy("_chunk").cogroup(answers.groupBy("_chunk")).applyInArrow(both, schema)
