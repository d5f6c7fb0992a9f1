"""Ranked lexical search: the best documents of each item, found in FP-trees of documents.

1. The items' terms are the vocabulary.  One pass over the whole texts counts the
   terms of each document and keeps its *restricted vector*: the vocabulary terms it
   holds, and how often.  Corpus counts (documents, terms, documents by term) come
   from those stored vectors.
2. A task orders every vector by falling document frequency and enters it into an
   FP-tree (:class:`Tree`): vectors with equal beginnings share a path.  Each node has
   the largest count of every term below it and the smallest length norm ``m``.
3. For every item the tree is searched depth first.  Score grows with a term's count
   and falls with ``m``, so a node's maxima and minimum bound every document below
   it; a branch whose bound is under the item's k-th score so far is left out.
4. The best ``k`` of each task are ranked once more over all tasks.

Items are taken in blocks of :data:`ITEM_BYTES`, whatever their number, so what is
sent to the tasks is bounded; each block searches all documents.  A task holds the
trees of at most :data:`CELLS` counts at a time.  No document is left out: a bound is
never under a score.  Equal documents end at the same node, in any number.

Null and empty texts, and those without a term, have no score and no place in the
corpus counts.  Items without terms get no rows; an item of the table is a row, so
repeated items are answered each by itself, and repeated documents are ranked each
by itself.  Equal scores go by ascending id, null last.  Other columns are left alone.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.arrays import flat_bytes, text_blocks
from tidemark.llm.tables import stored

#: Bytes of item text that are searched for at a time.
ITEM_BYTES = 4 << 20
#: Counts of a tree: documents times terms of the vocabulary.
CELLS = 24 << 20
#: Nodes of at most so many documents are not divided any further.
BUCKET = 64

#: Letters, digits and everything outside of ASCII.
IS_TERM = np.zeros(256, bool)
IS_TERM[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def terms_of(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """All terms of all texts, A-Z lower-cased, and each text's place in the list."""
    data, offsets = flat_bytes(texts)
    inside = np.zeros(len(data) + 2, np.int8)
    inside[1:-1] = IS_TERM[data]
    edges = np.flatnonzero(np.diff(inside))
    start, end = edges[::2], edges[1::2]
    bounds = np.concatenate([[0], np.cumsum(end - start)]).astype(np.int64)
    held = LOWER[data[inside[1:-1].view(bool)]]
    terms = pa.Array.from_buffers(pa.large_binary(), len(start), [None, pa.py_buffer(bounds.tobytes()), pa.py_buffer(held.tobytes())])
    return terms, np.searchsorted(start, offsets)


def counted(texts: pa.Array, vocabulary: pa.Array) -> tuple[np.ndarray, pa.ListArray, pa.ListArray]:
    """Each text's number of terms, its vocabulary terms in ascending order, and their counts."""
    terms, places = terms_of(texts)
    found = pc.fill_null(pc.index_in(terms, value_set=vocabulary), -1).to_numpy().astype(np.int64)
    owner = np.repeat(np.arange(len(places) - 1), np.diff(places))
    known = found >= 0
    keys, counts = np.unique(owner[known] * len(vocabulary) + found[known], return_counts=True)
    bounds = pa.array(np.searchsorted(keys, np.arange(len(places)) * len(vocabulary)), pa.int32())
    numbers = pa.array(keys % max(1, len(vocabulary)), pa.int32())
    return np.diff(places), pa.ListArray.from_arrays(bounds, numbers), pa.ListArray.from_arrays(bounds, pa.array(counts, pa.int32()))


def restricted(docs: DataFrame, vocabulary: list[bytes], doc_id: str, text: str) -> DataFrame:
    """Rows ``_id``, ``_n`` (terms of the document), ``_terms`` and ``_counts`` of documents with a term."""
    rows = docs.select(docs[doc_id].alias("_id"), docs[text].alias("_text"))
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary)

    def count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        terms = pa.array(shared.value, pa.large_binary())
        for block in text_blocks(batches, "_text"):
            sizes, numbers, counts = counted(block.column("_text"), terms)
            whole = pa.RecordBatch.from_arrays(
                [block.column("_id"), pa.array(sizes, pa.int64()), numbers, counts], ["_id", "_n", "_terms", "_counts"]
            )
            yield whole.filter(pa.array(sizes > 0))

    kind = rows.schema["_id"].dataType.simpleString()
    return rows.mapInArrow(count, f"_id {kind}, _n long, _terms array<int>, _counts array<int>")


@dataclass
class Corpus:
    """Counts over all documents: how many have terms, how many terms, and how many documents hold each term."""

    documents: int
    terms: int
    holding: np.ndarray

    @staticmethod
    def of(vectors: DataFrame, size: int) -> Corpus:
        total = vectors.agg(F.count("*").alias("documents"), F.sum("_n").alias("terms")).first()
        holding = np.zeros(size, np.int64)
        # One row for each term of the vocabulary at most.
        for row in vectors.select(F.explode("_terms").alias("term")).groupBy("term").count().toLocalIterator():
            holding[row["term"]] = row["count"]
        return Corpus(total.documents, total.terms or 0, holding)

    def weights(self) -> np.ndarray:
        top = 2 * self.documents + 2
        return np.array([math.floor(1000 * math.log(top / (2 * int(df) + 1))) for df in self.holding], np.int64)

    def norms(self, sizes: np.ndarray) -> np.ndarray:
        if len(sizes) and 90 * int(sizes.max()) * self.documents >= 1 << 63:
            return np.array([10 + 90 * int(n) * self.documents // self.terms for n in sizes], np.int64)
        return 10 + (90 * sizes * self.documents) // self.terms


def scores(counts: np.ndarray, norms: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """Score of each row of counts; as bounds if the counts are maxima and the norms minima."""
    counts = counts.astype(np.int64)
    return ((1_000_000_000 * counts) // (1000 * counts + 8 * norms[:, None])) @ weights


class Tree:
    """An FP-tree over restricted vectors.

    Documents lie in the order of their paths, so a node is a range of them; ``low``
    and ``high`` bound it, ``children`` has the numbers of the nodes below (none:
    its documents are scored one by one).
    """

    def __init__(self, numbers: list[np.ndarray], counts: list[np.ndarray], norms: np.ndarray, place: np.ndarray, width: int):
        # A term's place in the order of falling document frequency is its step of the path.
        paths = [np.sort(place[terms]) for terms in numbers]
        keys = [path.astype(">u4").tobytes() for path in paths]
        self.order = np.array(sorted(range(len(keys)), key=keys.__getitem__), np.int64)
        paths = [paths[at] for at in self.order]
        self.shared = np.array([0, *(self._common(a, b) for a, b in zip(paths, paths[1:], strict=False))], np.int64)
        self.norms = norms[self.order]
        rows = np.repeat(np.arange(len(paths)), [len(path) for path in paths])
        values = np.concatenate([counts[at] for at in self.order])
        kind = np.uint16 if len(values) == 0 or values.max() < 1 << 16 else np.int64
        self.counts = np.zeros((len(paths), width), kind)
        self.counts[rows, np.concatenate([numbers[at] for at in self.order])] = values
        self.low, self.high, self.children = [0], [len(paths)], [[]]
        self._grow()
        self._bound()

    @staticmethod
    def _common(a: np.ndarray, b: np.ndarray) -> int:
        size = min(len(a), len(b))
        other = a[:size] != b[:size]
        return int(other.argmax()) if other.any() else size

    def _grow(self) -> None:
        todo = [0]
        while todo:
            node = todo.pop()
            low, high = self.low[node], self.high[node]
            if high - low <= BUCKET:
                continue
            # Where the path common to the whole range ends, it branches.
            inner = self.shared[low + 1 : high]
            cuts = (np.flatnonzero(inner == inner.min()) + low + 1).tolist()
            for a, b in self._gathered([low, *cuts, high]):
                self.children[node].append(len(self.low))
                todo.append(len(self.low))
                self.low.append(a)
                self.high.append(b)
                self.children.append([])

    @staticmethod
    def _gathered(edges: list[int]) -> Iterator[tuple[int, int]]:
        """Ranges of branches; small neighbours share a node."""
        start = edges[0]
        for before, edge in zip(edges, edges[1:], strict=False):
            if edge - start > BUCKET and start < before:
                yield start, before
                start = before
        yield start, edges[-1]

    def _bound(self) -> None:
        """Largest counts and smallest norm below each node; children have higher numbers than their parents."""
        self.most = np.zeros((len(self.low), self.counts.shape[1]), self.counts.dtype)
        self.least = np.zeros(len(self.low), np.int64)
        for node in range(len(self.low) - 1, -1, -1):
            below = self.children[node]
            if below:
                self.most[node], self.least[node] = self.most[below].max(axis=0), self.least[below].min()
            else:
                own = slice(self.low[node], self.high[node])
                self.most[node], self.least[node] = self.counts[own].max(axis=0), self.norms[own].min()

    def search(self, terms: np.ndarray, weights: np.ndarray, best: Best) -> None:
        """Offer every document that may be among the best of the item with ``terms``."""
        most, counts = self.most[:, terms], self.counts
        stack = [(int(scores(most[:1], self.least[:1], weights)[0]), 0)]
        while stack:
            bound, node = stack.pop()
            if bound < best.least or bound <= 0:
                continue
            below = self.children[node]
            if not below:
                own = slice(self.low[node], self.high[node])
                best.offer(scores(counts[own][:, terms], self.norms[own], weights), self.order[own])
                continue
            bounds = scores(most[below], self.least[below], weights)
            # The most promising branch comes first.
            stack.extend((int(bounds[at]), below[at]) for at in np.argsort(bounds, kind="stable") if bounds[at] >= best.least)


class Best:
    """The best ``k`` documents of an item so far; ``least`` is what a score must reach to matter."""

    def __init__(self, k: int):
        self.k, self.rows, self.least = k, [], 1
        self.ids: pa.Array | None = None

    def offer(self, found: np.ndarray, documents: np.ndarray) -> None:
        good = np.flatnonzero(found >= self.least)
        if not len(good):
            return
        if len(good) > self.k:
            # Of many at once only those from the k-th score on can stay.
            edge = np.partition(found[good], len(good) - self.k)[len(good) - self.k]
            good = good[found[good] >= edge]
        ids = self.ids.take(pa.array(documents[good])).to_pylist()
        rows = [(-int(score), name is None, name) for score, name in zip(found[good], ids, strict=True)]
        self.rows = sorted(self.rows + rows, key=lambda row: row[:2] if row[1] else row)[: self.k]
        if len(self.rows) == self.k:
            self.least = -self.rows[-1][0]


@dataclass
class Items:
    """A block of items: their number, id and distinct terms as numbers of a common vocabulary."""

    numbers: list[int]
    ids: list
    terms: list[np.ndarray]
    vocabulary: list[bytes]

    @staticmethod
    def of(rows: list) -> Items:
        terms, places = terms_of(pa.array([row["_text"] for row in rows], pa.string()))
        coded = terms.dictionary_encode()
        held = coded.indices.to_numpy()
        own = [np.unique(held[a:b]).astype(np.int64) for a, b in zip(places[:-1], places[1:], strict=True)]
        return Items([row["_item"] for row in rows], [row["_item_id"] for row in rows], own, coded.dictionary.to_pylist())


def _searched(vectors: DataFrame, items: Items, corpus: Corpus, k: int, schema: str) -> DataFrame:
    """The best ``k`` documents of each item within each task."""
    weights, width = corpus.weights(), len(items.vocabulary)
    place = np.empty(width, np.int64)
    place[np.argsort(-corpus.holding, kind="stable")] = np.arange(width)
    shared = vectors.sparkSession.sparkContext.broadcast(
        (items.numbers, items.ids, items.terms, weights, place, (corpus.documents, corpus.terms))
    )
    limit = max(BUCKET, CELLS // max(1, width))

    def search(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        numbers, ids, terms, weights, place, (documents, total) = shared.value
        corpus = Corpus(documents, total, np.zeros(0, np.int64))
        best = [Best(k) for _ in ids]
        id_kind = None
        for table in _pieces(batches, limit):
            id_kind = table.column("_id").type
            own, counts = _split(table.column("_terms")), _split(table.column("_counts"))
            tree = Tree(own, counts, corpus.norms(table.column("_n").to_numpy()), place, len(place))
            for item, wanted in zip(best, terms, strict=True):
                item.ids = table.column("_id").combine_chunks()
                if len(wanted):
                    tree.search(wanted, weights[wanted], item)
        found = [(number, name, -row[0], row[2]) for number, name, item in zip(numbers, ids, best, strict=True) for row in item.rows]
        if found:
            columns = [pa.array(column) for column in zip(*found, strict=True)]
            columns[-1] = columns[-1].cast(id_kind)
            yield pa.RecordBatch.from_arrays(columns, ["_item", "_item_id", "score", "_id"])

    return vectors.mapInArrow(search, schema)


def _split(lists: pa.ChunkedArray) -> list[np.ndarray]:
    whole = lists.combine_chunks()
    ends = np.cumsum(pc.list_value_length(whole).to_numpy(zero_copy_only=False))
    return np.split(whole.flatten().to_numpy().astype(np.int64), ends[:-1])


def _pieces(batches: Iterable[pa.RecordBatch], limit: int) -> Iterator[pa.Table]:
    """Tables of at most ``limit`` rows."""
    held, size = [], 0
    for batch in batches:
        while batch.num_rows:
            part = batch.slice(0, limit - size)
            held.append(part)
            size += part.num_rows
            batch = batch.slice(part.num_rows)
            if size == limit:
                yield pa.Table.from_batches(held)
                held, size = [], 0
    if held:
        yield pa.Table.from_batches(held)


def _blocks(items: DataFrame) -> Iterator[Items]:
    """The items in blocks of :data:`ITEM_BYTES` of text, one block at a time on the driver."""
    rows, size = [], 0
    for row in items.toLocalIterator():
        rows.append(row)
        size += len(row["_text"] or "") + 64
        if size >= ITEM_BYTES:
            yield Items.of(rows)
            rows, size = [], 0
    if rows:
        yield Items.of(rows)


def ranked_search(
    docs: DataFrame, items: DataFrame, k: int = 10, doc_id: str = "doc_id", item_id: str = "item_id", text: str = "text"
) -> DataFrame:
    """Columns ``item_id``, ``rank`` (from 1), ``doc_id`` and ``score`` of the ``k`` best documents of every item."""
    listed = items.select(items[item_id].alias("_item_id"), items[text].alias("_text"))
    listed = stored(listed.withColumn("_item", F.monotonically_increasing_id()), "items")
    kinds = (listed.schema["_item_id"].dataType.simpleString(), docs.schema[doc_id].dataType.simpleString())
    schema = f"_item long, _item_id {kinds[0]}, score long, _id {kinds[1]}"
    found = [docs.sparkSession.createDataFrame([], schema)]
    for block in _blocks(listed):
        vectors = stored(restricted(docs, block.vocabulary, doc_id, text), "vectors")
        corpus = Corpus.of(vectors, len(block.vocabulary))
        found.append(_searched(vectors, block, corpus, k, schema))
    order = Window.partitionBy("_item").orderBy(F.desc("score"), F.asc_nulls_last("_id"))
    ranked = reduce(DataFrame.unionAll, found).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked.select(F.col("_item_id").alias(item_id), "rank", F.col("_id").alias(doc_id), "score")


#: The same ranking over the tables ``documents`` and ``benchmark``.
SEARCH_SQL = """
with texts as (
  select row_number() over () as row, doc_id, translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as text
  from documents
), words as (
  select row, doc_id, unnest(regexp_extract_all(text, '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) as term from texts
), held as (
  select row, doc_id, term, count(*) as tf from words group by all
), sizes as (
  select row, sum(tf)::bigint as n from held group by row
), corpus as (
  select count(*) as docs, sum(n)::bigint as total from sizes
), terms as (
  select term, floor(1000 * ln((2 * docs + 2) / (2 * count(*) + 1)))::bigint as w from held, corpus group by term, docs
), items as (
  select row_number() over () as item, item_id, translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as text
  from benchmark
), asked as (
  select distinct item, item_id, term from (
    select item, item_id, unnest(regexp_extract_all(text, '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) as term from items)
), scored as (
  select item, item_id, row, doc_id, sum(w * ((1000000000 * tf) // (1000 * tf + 8 * (10 + (90 * n * docs) // total))))::bigint as score
  from asked join held using (term) join terms using (term) join sizes using (row), corpus group by all
), ranked as (
  select item_id, doc_id, score, row_number() over (partition by item order by score desc, doc_id)::int as rank from scored where score > 0
)
select item_id, rank, doc_id, score from ranked where rank <= 10
"""
