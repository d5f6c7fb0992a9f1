"""Skip-gram training against a Huffman tree, by matrix products over blocks of positions.

The rule is that of Spark ML's Word2Vec: every word is a centre with a reach drawn evenly from 1 to
:data:`WINDOW`, every word in reach is a context whose vector is trained against all nodes on the centre's
path, and the rate falls linearly with the words seen.  What differs: the pairs of a block are all trained
from the values before it, and a value moved by many of them takes the sum of their steps, shortened by
what its curvature allows (:func:`shortened`); up to 32 places of a word in a block share a reach; pairs that
are far on the right or wrong side are trained too.  Blocks start small and grow with the words seen.

What is here runs inside tasks, so it is pickled by value: executors need no copy of it.
"""

from __future__ import annotations

import sys
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from numpy.lib.stride_tricks import sliding_window_view
from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])

#: Words to each side that a context may be away, words a sentence is cut at, first rate and least part of it.
WINDOW, SENTENCE, RATE, LEAST_RATE = 5, 1000, 0.025, 1e-4
#: Words of a row of sentences on their way to the part that trains on them.
PACK = 1 << 14
#: Words and gaps of the first blocks, of a block as a part of the words seen before, and of the largest, whose steps take so many bytes.
FIRST_BLOCK, GROWTH, BLOCK, STEP_BYTES = 64, 0.05, 1 << 16, 48 << 20
#: So many positions of a word share a reach and are multiplied at once; what is left of a word goes to the next size.
TILES = (32, 8, 4, 2, 1)
#: Curvature that is counted for the loss along a product, for nodes and for contexts: a half and a quarter of the most it
#: has.  The sums over pairs overstate it, most for contexts, whose nodes point in many ways and are decided mostly.
NODE_CURVATURE, CONTEXT_CURVATURE = 0.125, 0.0625
#: Paths are filled up to a multiple of so many nodes.
LEVELS = 4


def counted_pieces(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The different pieces of each batch of texts with their counts."""
    for batch in batches:
        pa.default_memory_pool().release_unused()
        found = pc.utf8_split_whitespace(batch.column(0)).flatten().dictionary_encode()
        times = np.bincount(found.indices.to_numpy(), minlength=len(found.dictionary))
        made = pa.RecordBatch.from_arrays([found.dictionary, pa.array(times, pa.int64())], ["word", "_n"])
        yield made.filter(pc.not_equal(made["word"], ""))


def text_rows(batches: Iterable[pa.RecordBatch], rows: int = 4096) -> Iterator[pa.RecordBatch]:
    """The same rows, not too many at once."""
    for batch in batches:
        yield from (batch.slice(at, rows) for at in range(0, batch.num_rows, rows))
    pa.default_memory_pool().release_unused()


def labelled_pieces(texts: pa.Array, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Places in ``words`` of the pieces of all texts that are among them, and how many each text has."""
    split = pc.utf8_split_whitespace(texts)
    labels = pc.fill_null(pc.index_in(split.values, value_set=words), -1).to_numpy()
    known = labels >= 0
    sums = np.concatenate([[0], np.cumsum(known)])
    return labels[known], np.diff(sums[split.offsets.to_numpy()])


def huffman_tree(counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Parent (-1 at the root) and side (0 or 1) of every node: first the words, then the inner nodes."""
    words = len(counts)
    leaves = np.argsort(counts, kind="stable").tolist()
    weight = counts.tolist() + [0] * (words - 1)
    parent, side = np.full(2 * words - 1, -1, np.int32), np.zeros(2 * words - 1, np.int8)
    leaf, inner = 0, words
    for node in range(words, 2 * words - 1):
        for turn in (0, 1):
            # Inner nodes are made in order of their weights.
            if leaf < words and (inner >= node or weight[leaves[leaf]] <= weight[inner]):
                least, leaf = leaves[leaf], leaf + 1
            else:
                least, inner = inner, inner + 1
            parent[least], side[least] = node, turn
            weight[node] += weight[least]
    return parent, side


def tree_depths(parent: np.ndarray) -> np.ndarray:
    """How many nodes are above each word."""
    words = (len(parent) + 1) // 2
    depth, at = np.zeros(words, np.int32), parent[:words]
    while (live := at >= 0).any():
        depth, at = depth + live, np.where(live, parent[at], -1)
    return depth


def tree_paths(parent: np.ndarray, side: np.ndarray, some: np.ndarray, depth: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Inner nodes from the root to some words of given depths, and 1 or -1 for the side taken; past the word an unused node and 0."""
    words = (len(parent) + 1) // 2
    shape = (len(some), max(1, int(depth.max())))
    nodes, signs = np.full(shape, words - 1, np.int32), np.zeros(shape, np.int8)
    rows, below = np.arange(len(some)), some
    for up in range(1, shape[1] + 1):
        live = depth[rows] >= up
        rows, below = rows[live], below[live]
        signs[rows, depth[rows] - up] = 1 - 2 * side[below]
        below = parent[below]
        nodes[rows, depth[rows] - up] = below - words
    return nodes, signs


def ordered_tree(counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The words in the order of the tree's leaves, and parent and side of words and nodes numbered in that order.

    The words below a node, and the nodes of a path, then lie side by side.
    """
    parent, side = huffman_tree(counts)
    words = len(counts)
    nodes, signs = tree_paths(parent, side, np.arange(words), tree_depths(parent))
    order = np.lexsort(-signs.T[::-1])
    visited, first = nodes[order].ravel(), np.empty(words, np.int64)
    first[visited[::-1]] = np.arange(len(visited))[::-1]
    inner = np.argsort(first[: words - 1], kind="stable")
    old = np.concatenate([order, words + inner])
    new = np.empty(len(old) + 1, np.int32)
    new[old], new[-1] = np.arange(len(old)), -1
    return order, new[parent[old]], side[old]


def shortened(curvature: np.ndarray) -> np.ndarray:
    """The part of a sum of steps to take: near 1 for few of them, and not beyond the minimum of a parabola so curved."""
    x = np.maximum(curvature, 1e-6)
    return (-np.expm1(-x) / x).astype(np.float32)


def run_starts(values: np.ndarray) -> np.ndarray:
    """Where a new value starts."""
    return np.flatnonzero(np.concatenate([[True], values[1:] != values[:-1]]))


class SkipGram:
    """A model of the words of a tree; ``seed`` makes the first vectors, which are the same everywhere, ``draw`` the reaches."""

    def __init__(self, parent: np.ndarray, side: np.ndarray, size: int, seed: int, draw: int = 0):
        self.words, self.size = (len(parent) + 1) // 2, size
        self.parent, self.side, self.depth = parent, side, tree_depths(parent)
        # The last row of both stays zero: a gap between sentences, and the node past a word.
        self.context = np.zeros((self.words + 1, size), np.float32)
        self.context[:-1] = (np.random.default_rng(seed).random((self.words, size), dtype=np.float32) - 0.5) / size
        self.node = np.zeros((self.words, size), np.float32)
        self.changed = np.zeros(self.words, bool)
        self.reaches = np.random.default_rng([seed, draw])
        self._steps = np.zeros((0, 2 * WINDOW + 1, size), np.float32)

    def train(self, sentences: Iterable[tuple[np.ndarray, np.ndarray]], total: float) -> None:
        """Train on labels and lengths of sentences; ``total`` is the number of words after which the rate is least."""
        largest = max(FIRST_BLOCK, min(BLOCK, STEP_BYTES // (4 * (2 * WINDOW + 1) * self.size)))
        seen = 0
        for labels, lengths in blocks(sentences, largest):
            self.train_block(with_gaps(labels, lengths, self.words), RATE * max(1 - seen / (total + 1), LEAST_RATE))
            seen += len(labels)

    def train_block(self, labels: np.ndarray, rate: float) -> None:
        """Train all pairs of a block, with :data:`WINDOW` gaps before, between and behind its sentences."""
        at = np.flatnonzero(labels < self.words)
        at = np.sort(labels[at].astype(np.int64) << 32 | at) & 0xFFFFFFFF
        found = labels[at]
        starts = run_starts(found)
        words = found[starts]
        depth = self.depth[words]
        paths = tree_paths(self.parent, self.side, words, depth)
        # Halves, as the logistic function of x is (1 + tanh(x / 2)) / 2.
        half = self.context.take(labels, 0)
        half *= 0.5
        if len(self._steps) < len(labels):
            self._steps = np.zeros((len(labels), *self._steps.shape[1:]), np.float32)
        steps = self._steps[: len(labels)]
        steps.fill(0)
        moves = np.zeros((*paths[0].shape, self.size), np.float32)
        reach, pull = np.zeros(len(labels), np.int64), np.zeros(len(labels))
        rest, first = np.diff(np.append(starts, len(at))), starts.copy()
        for count in TILES:
            tiles = rest // count
            of = np.repeat(np.arange(len(words)), tiles)
            place = np.arange(len(of)) - np.repeat(np.cumsum(tiles) - tiles, tiles)
            begin = first[of] + count * place
            far = self.reaches.integers(1, WINDOW + 1, len(of))
            deep = np.minimum(-(-depth[of] // LEVELS) * LEVELS, moves.shape[1])
            kind = deep * (WINDOW + 1) + far
            by = np.argsort(kind, kind="stable")
            edges = run_starts(kind[by]) if len(by) else by
            for some in np.split(by, edges[1:]) if len(by) else ():
                places = at[(begin[some][:, None] + np.arange(count)).ravel()]
                r = far[some[0]]
                reach[places] = r
                pull[places] = np.repeat(self._tiles(half, places, paths, of[some], r, deep[some[0]], steps, moves), count)
            first, rest = first + count * tiles, rest - count * tiles
        self._move_nodes(paths[0], starts, at, half, reach, moves, rate)
        self._move_contexts(words, starts, at, reach, pull, steps, rate)
        near = (labels[at - 1] < self.words) | (labels[at + 1] < self.words)
        self.changed[found[near]] = True

    def _tiles(self, half, places, paths, of, reach, deep, steps, moves) -> np.ndarray:
        """Steps of contexts, by place and distance, and of nodes, by word and level; returns the squares of the paths' nodes."""
        tiles, span = len(of), 2 * reach + 1
        near = sliding_window_view(half.ravel(), span * self.size)[:: self.size][places - reach].reshape(-1, span, self.size)
        near[:, reach] = 0  # The centre is no context of itself.
        near = near.reshape(tiles, -1, self.size)
        path, sign = (part[of, :deep] for part in paths)
        nodes = self.node.take(path, 0)
        wrong = np.matmul(near, nodes.transpose(0, 2, 1))
        np.tanh(wrong, out=wrong)
        np.subtract(sign[:, None].astype(np.float32), wrong, out=wrong)
        found = np.matmul(wrong, nodes).reshape(len(places), span, self.size)
        found[:, reach] = 0
        steps[places, WINDOW - reach : WINDOW + reach + 1] = found
        moved = np.matmul(wrong.transpose(0, 2, 1), near)
        edges = run_starts(of)
        moves[of[edges], :deep] += moved if len(edges) == tiles else np.add.reduceat(moved, edges, axis=0)
        return np.einsum("nlk,nlk->n", nodes, nodes)

    def _move_nodes(self, path, starts, at, half, reach, moves, rate) -> None:
        """Each node takes the moves of the words below it, which lie side by side."""
        squares = np.einsum("ij,ij->i", half, half)
        sums = np.concatenate([[0.0], np.cumsum(squares, dtype=np.float64)])
        far = reach[at]
        around = np.add.reduceat(sums[at + far + 1] - sums[at - far] - squares[at], starts)
        for level, nodes in enumerate(np.ascontiguousarray(path.T)):
            runs = run_starts(nodes)
            part = rate * shortened(4 * rate * NODE_CURVATURE * np.add.reduceat(around, runs))
            moved = np.add.reduceat(moves[:, level], runs, axis=0)
            moved *= part[:, None].astype(np.float32)
            moved += self.node.take(nodes[runs], 0)
            self.node[nodes[runs]] = moved
        self.node[-1] = 0

    def _move_contexts(self, words, starts, at, reach, pull, steps, rate) -> None:
        """Each word takes the steps of all places where it is a context."""
        size, far = len(reach), reach[at]
        # The steps of a place go to the places around it, which lie in a row; those of every eleventh place do not overlap.
        span = 2 * WINDOW + 1
        taken, steps = np.zeros((size + 2 * span) * self.size, np.float32), steps.reshape(size, -1)
        for first in range(min(span, size)):
            rows = steps[first::span]
            taken[first * self.size :][: rows.size].reshape(rows.shape)[:] += rows
        taken = np.add.reduceat(taken.reshape(-1, self.size).take(at + WINDOW, 0), starts, axis=0)
        edges = np.bincount(at - far, pull[at], size + 1) - np.bincount(at + far + 1, pull[at], size + 1)
        curvature = np.add.reduceat(np.maximum(np.cumsum(edges)[at] - pull[at], 0), starts)
        part = rate / 2 * shortened(rate * CONTEXT_CURVATURE * curvature)
        self.context[words] += taken * part[:, None].astype(np.float32)


def packed_sentences(labels: np.ndarray, lengths: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Texts cut into sentences of at most :data:`SENTENCE` words, in packs of about :data:`PACK` words."""
    parts = -(-lengths // SENTENCE)
    cut = np.full(int(parts.sum()), SENTENCE, np.int32)
    last = np.cumsum(parts)[parts > 0] - 1
    cut[last] = (lengths - (parts - 1) * SENTENCE)[parts > 0]
    ends = np.cumsum(cut)
    edges = run_starts((ends - 1) // PACK) if len(ends) else ends
    for some, counts in zip(np.split(labels, ends[edges[1:] - 1]), np.split(cut, edges[1:]), strict=True):
        if len(some):
            yield some.astype(np.int32), counts


def with_gaps(labels: np.ndarray, lengths: np.ndarray, gap: int) -> np.ndarray:
    """Sentences with :data:`WINDOW` gaps before, between and behind them."""
    spread = np.full(len(labels) + WINDOW * (len(lengths) + 1), gap, np.int32)
    spread[np.arange(len(labels)) + WINDOW * (1 + np.repeat(np.arange(len(lengths)), lengths))] = labels
    return spread


def blocks(sentences: Iterable[tuple[np.ndarray, np.ndarray]], largest: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """The same sentences, whole, in blocks that grow with the words before them up to about ``largest`` words and gaps."""
    seen, kept, room = 0, [], 0

    def most() -> int:
        return int(min(max(FIRST_BLOCK, seen * GROWTH), largest))

    for labels, lengths in sentences:
        kept.append((labels, lengths))
        room += len(labels) + WINDOW * len(lengths)
        if room < most():
            continue
        labels, lengths = (np.concatenate(parts) for parts in zip(*kept, strict=True))
        ends, with_gap = (np.concatenate([[0], np.cumsum(of)]) for of in (lengths, lengths + WINDOW))
        place = 0
        while with_gap[-1] - with_gap[place] >= most():
            to = max(place + 1, int(np.searchsorted(with_gap, with_gap[place] + most(), "right")) - 1)
            yield labels[ends[place] : ends[to]], lengths[place:to]
            seen, place = seen + int(ends[to] - ends[place]), to
        kept, room = [(labels[ends[place] :], lengths[place:])], int(with_gap[-1] - with_gap[place])
    if room:
        labels, lengths = (np.concatenate(parts) for parts in zip(*kept, strict=True))
        yield labels, lengths
