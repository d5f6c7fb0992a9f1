"""Scoring texts with a smoothed n-gram model as a weighted backoff automaton.

Learning documents are counted to n-grams of order 1 to ``order``; a text is its
lower-cased words and one end token, after a start mark that is only context.  With
absolute discounting ``D`` the model is

    p(w | h) = max(c(hw) - D, 0) / c(h) + D * T(h) / c(h) * p(w | h without its first word)

with ``T(h)`` the number of different tokens seen after ``h``; the unigram is
``(c + 1) / (N + V + 1)``, so every token has a chance.  As an automaton, a state is
a counted context, an arc carries the log-probability of a counted n-gram, and a
failure arc leads to the shorter context and carries the log of the factor.

The model grows with the corpus, so no task holds all of it.  Each chunk of
documents gets the part of the automaton that its own texts can reach: the counts
of its own n-grams over the corpus, and ``T`` of its own contexts.  It asks about
words and pairs of words, and then about longer n-grams, order by order, unless the
answers on shorter ones tell: an n-gram that holds one never learnt is not learnt
either, and one that holds an n-gram of no other chunk is in no other chunk.  ``T`` is
summed at the keys of the first questions, which are not sent twice.

A chunk then traverses its automaton.  The state after a token is the longest counted
context that ends there, whatever came before it, so all tokens take their arcs side
by side.

Null and empty texts are the end token alone.  Rows are independent: repeated rows
get repeated scores.  Without learning documents every token has the unknown's chance.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from tidemark.llm.arrays import U, mix, text_blocks, word_hashes
from tidemark.llm.chunks import ASKED, Answers, Layout, ask, asked_table, in_chunks, opened, totals, totals_again, with_answers

ORDER = 2
DISCOUNT = 0.75
START, END = (mix(np.array([seed], np.uint64))[0] for seed in (1, 2))
#: Kinds of questions: n-grams by order, and what follows contexts by order plus this.
FOLLOWERS = 100
#: N-grams up to this order are asked about at once.
AT_ONCE = 2
#: Chunks are so many times the usual size: the larger, the fewer n-grams are in several of them.
CHUNK_TIMES = 2
#: Bytes of text that are split into words together: few enough to stay in the processor's memory.
BLOCK = 256 << 10
#: Chunks and buckets are dealt to two partitions for each chunk, but to no more than this.
PARTITIONS = 1000

SCORES = "n_tokens long, n_known long, train_tokens long, base_score double, score double"


def numbered(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The sorted distinct keys, and the number of each key among them."""
    # Sorting values is several times faster than sorting places: high bits carry the place below them.
    low = U((1 << len(keys).bit_length()) - 1)
    places = np.arange(len(keys), dtype=np.uint64)
    order = (np.sort((keys & ~low) | places) & low).astype(np.int64)
    ordered = keys[order]
    if (ordered[1:] < ordered[:-1]).any():  # keys that differ in the low bits only
        order = np.argsort(keys)
        ordered = keys[order]
    new = np.ones(len(keys), bool)
    np.not_equal(ordered[1:], ordered[:-1], out=new[1:])
    number = np.empty(len(keys), np.int64)
    number[order] = np.cumsum(new) - 1
    return ordered[new], number


class Chunk:
    """The token sequences of a chunk's documents, and their n-grams."""

    def __init__(self, docs: pa.Table, order: int):
        words, ends = [], []
        shift = 0
        for batch in docs.select(["_text"]).combine_chunks().to_batches():
            for block in text_blocks([batch], "_text", BLOCK):
                found, places = word_hashes(block.column("_text"))
                words.append(found)
                ends.append(places[1:] + shift)
                shift += len(found)
        flat = np.concatenate([*words, np.zeros(0, np.uint64)])
        stops = np.concatenate([*ends, np.zeros(0, np.int64)]).astype(np.int64)
        rows = len(stops)
        # Each text becomes: start, its words, end.
        starts = np.concatenate([[0], stops])[:rows]
        self.lengths = stops - starts + 2
        self.offsets = np.concatenate([[0], np.cumsum(self.lengths)])
        tokens = np.empty(int(self.offsets[-1]), np.uint64)
        inner = np.ones(len(tokens), bool)
        inner[self.offsets[:-1]] = inner[self.offsets[1:] - 1] = False
        tokens[inner] = flat
        tokens[self.offsets[:-1]], tokens[self.offsets[1:] - 1] = START, END
        place = np.arange(len(tokens)) - np.repeat(self.offsets[:-1], self.lengths)
        #: By order: the sorted keys, and for each token the number of the n-gram that ends there, or -1.
        self.keys: list[np.ndarray] = []
        self.at: list[np.ndarray] = []
        last = mix(tokens)
        for size in range(1, order + 1):
            if size > 1:
                last = np.concatenate([np.zeros(1, np.uint64), mix(last[:-1] * U(3) + tokens[1:])])
            whole = place >= size - 1
            keys, number = numbered(last[whole])
            at = np.full(len(tokens), -1, np.int64)
            at[whole] = number
            self.keys.append(keys)
            self.at.append(at)

    def counted(self, size: int, learning: np.ndarray) -> np.ndarray:
        """How often the learning documents hold each n-gram of an order."""
        at = self.at[size - 1]
        used = at[np.repeat(learning, self.lengths) & (at >= 0)]
        return np.bincount(used, minlength=len(self.keys[size - 1]))


    def parts(self, size: int) -> tuple[np.ndarray, np.ndarray]:
        """For each n-gram of an order, the numbers of its context and of its shorter n-gram, those without its last or first token."""
        at, below = self.at[size - 1], self.at[size - 2]
        # One token each n-gram ends at.
        where = np.zeros(len(self.keys[size - 1]), np.int64)
        ends = np.flatnonzero(at >= 0)
        where[at[ends]] = ends
        return below[where - 1], below[where]


class Known:
    """What is known of a chunk's n-grams up to an order, by order, from the answers to what the chunk had to ask."""

    def __init__(self, chunk: Chunk, learning: np.ndarray, answers: Answers, order: int):
        self.chunk = chunk
        #: How often the corpus holds an n-gram, whether this is the first chunk that does, and whether it is the only one with it.
        self.total: list[np.ndarray] = []
        self.first: list[np.ndarray] = []
        self.alone: list[np.ndarray] = []
        self.asked: list[np.ndarray] = []
        for size in range(1, order + 1):
            asked = self.to_ask(size)
            total = chunk.counted(size, learning)
            first, alone = total > 0, np.ones(len(total), bool)
            total[asked], first[asked], alone[asked] = answers.totals(size), answers.first(size), answers.alone(size)
            self.total.append(total)
            self.first.append(first)
            self.alone.append(alone)
            self.asked.append(asked)

    def to_ask(self, size: int) -> np.ndarray:
        """The n-grams of an order that are not told by those one shorter: both of these are learnt, and in other chunks too."""
        if size <= AT_ONCE:
            return np.ones(len(self.chunk.keys[size - 1]), bool)
        context, shorter = self.chunk.parts(size)
        shared = (self.total[size - 2] > 0) & ~self.alone[size - 2]
        return shared[context] & shared[shorter]

    def own_followers(self, size: int) -> np.ndarray:
        """How many n-grams this chunk is the first to hold begin with each context of an order."""
        context, _ = self.chunk.parts(size + 1)
        return np.bincount(context[self.first[size]], minlength=len(self.chunk.keys[size - 1]))

    def spread(self, size: int) -> np.ndarray:
        """The contexts whose followers other chunks may hold as well; what was counted once has one."""
        return (self.total[size - 1] > 1) & ~self.alone[size - 1]

    def followers(self, size: int, answers: Answers) -> np.ndarray:
        """How many different tokens follow each context of an order in the corpus."""
        found = np.minimum(self.total[size - 1], 1)
        twice = self.total[size - 1] > 1
        found[twice] = self.own_followers(size)[twice]
        spread = self.spread(size)
        found[spread] = answers.totals(FOLLOWERS + size)[spread[self.asked[size - 1]]]
        return found


class Automaton:
    """The part of the model that a chunk's texts can reach."""

    def __init__(self, chunk: Chunk, learning: np.ndarray, answers: Answers):
        order = len(chunk.keys)
        known = Known(chunk, learning, answers, order)
        self.count = known.total
        # The start mark is counted as a context, but is no token.
        start = int(np.searchsorted(chunk.keys[0], mix(np.array([START]))[0]))
        starts = int(self.count[0][start]) if len(chunk.lengths) else 0
        distinct, total = answers.corpus(1)
        self.tokens = total - starts
        self.unigram = np.log10((self.count[0] + 1) / (self.tokens + distinct - (starts > 0) + 1))
        chances = [10.0**self.unigram]
        self.failure: list[np.ndarray] = [np.zeros(0)]
        for size in range(2, order + 1):
            context, shorter = chunk.parts(size)
            seen = self.count[size - 2]
            followers = known.followers(size - 1, answers)
            with np.errstate(divide="ignore", invalid="ignore"):
                factor = np.where(seen > 0, DISCOUNT * followers / seen, 1.0)
                own = np.maximum(self.count[size - 1] - DISCOUNT, 0) / seen[context]
            lower = chances[-1][shorter]
            chances.append(np.where(seen[context] > 0, own + factor[context] * lower, lower))
            self.failure.append(np.log10(np.where(factor > 0, factor, 1.0)))
        self.arc = [self.unigram, *(np.log10(chance) for chance in chances[1:])]

    def traverse(self, chunk: Chunk) -> np.ndarray:
        """The log-probability of each text: the weights of its arcs, added from left to right."""
        order = len(self.arc)
        # A state is a context's length and the token it ends at; the start mark is the first.
        after = np.zeros(len(chunk.at[0]), np.int64)
        for size in range(1, order):
            ends = np.flatnonzero(chunk.at[size - 1] >= 0)
            after[ends[self.count[size - 1][chunk.at[size - 1][ends]] > 0]] = size
        place = np.ones(len(after), bool)
        place[chunk.offsets[:-1]] = False
        place = np.flatnonzero(place)
        state = after[place - 1]
        added = np.zeros(len(place))
        for size in range(order, 0, -1):
            trying = np.flatnonzero(state == size - 1)
            arc = chunk.at[size - 1][place[trying]]
            found = (self.count[size - 1][arc] > 0) | (size == 1)
            taken, failed = trying[found], trying[~found]
            added[taken] += self.arc[size - 1][arc[found]]
            state[taken] = -1  # there is no more to try
            if len(failed):
                added[failed] += self.failure[size - 1][chunk.at[size - 2][place[failed] - 1]]
                state[failed] = size - 2
        texts = np.repeat(np.arange(len(chunk.lengths)), chunk.lengths - 1)
        return np.bincount(texts, weights=added, minlength=len(chunk.lengths))


def score_texts(
    docs: DataFrame, learning: str, text: str = "text", keep: tuple[str, ...] = ("doc_id",), order: int = ORDER
) -> DataFrame:
    """Columns ``keep`` and those of :data:`SCORES`, for every row.

    ``learning`` names a boolean column: the documents that the model learns from.
    """
    layout = Layout(docs, text, CHUNK_TIMES)
    named = docs.select(*keep, docs[text].alias("_text"), docs[learning].alias("_learning"))
    bits = layout.bits

    parts = min(2 * layout.chunks, PARTITIONS)

    def dealt(rows: DataFrame, *by: str) -> DataFrame:
        """Dealt by these columns and by no others later, so that what several rounds read is shuffled once."""
        return rows.repartition(parts, *by)

    chunks = dealt(in_chunks(named, "_text", (*keep, "_learning"), layout), "_chunk")

    def opened_chunk(blobs: pa.Table, longest: int = order) -> tuple[pa.Table, Chunk, np.ndarray]:
        table = opened(blobs)
        learning = np.array([bool(value) for value in table.column("_learning").to_pylist()], bool)
        return table, Chunk(table, longest), learning

    def ask_first(blobs: pa.Table) -> pa.Table:
        number = blobs.column("_chunk")[0].as_py()
        longest = min(order, AT_ONCE)
        _, chunk, learning = opened_chunk(blobs, longest)
        rows = []
        for size in range(1, longest + 1):
            rows += ask(number, size, chunk.keys[size - 1], chunk.counted(size, learning), bits, press=True)
        return asked_table(rows)

    def ask_order(size: int):
        def ask_longer(blobs: pa.Table, answered: pa.Table) -> pa.Table:
            number = blobs.column("_chunk")[0].as_py()
            _, chunk, learning = opened_chunk(blobs, size)
            asked = Known(chunk, learning, Answers(answered), size - 1).to_ask(size)
            counts = chunk.counted(size, learning)
            return asked_table(ask(number, size, chunk.keys[size - 1][asked], counts[asked], bits, press=True))

        return ask_longer

    def ask_followers(blobs: pa.Table, answered: pa.Table) -> pa.Table:
        number = blobs.column("_chunk")[0].as_py()
        _, chunk, learning = opened_chunk(blobs)
        known, rows = Known(chunk, learning, Answers(answered), order), []
        for size in range(1, order):
            asked = known.asked[size - 1]
            own = np.where(known.spread(size), known.own_followers(size), 0)
            rows += ask(number, size, chunk.keys[size - 1][asked], own[asked], bits, press=True, again=True)
        return asked_table(rows)

    def score(blobs: pa.Table, answered: pa.Table) -> pa.Table:
        table, chunk, learning = opened_chunk(blobs)
        automaton = Automaton(chunk, learning, Answers(answered))
        own = chunk.at[0]
        token = np.ones(len(own), bool)
        token[chunk.offsets[:-1]] = False
        base = np.where(token, automaton.unigram[own], 0.0)
        known = (token & (automaton.count[0][own] > 0)).astype(np.int64)
        firsts = chunk.offsets[:-1]
        columns = {
            "n_tokens": pa.array(chunk.lengths - 1, pa.int64()),
            "n_known": pa.array(np.add.reduceat(known, firsts), pa.int64()),
            "train_tokens": pa.array([automaton.tokens] * len(firsts), pa.int64()),
            "base_score": pa.array(np.add.reduceat(base, firsts), pa.float64()),
            "score": pa.array(automaton.traverse(chunk), pa.float64()),
        }
        return pa.table({name: table.column(name) for name in keep} | columns)

    asked = dealt(chunks.groupBy("_chunk").applyInArrow(ask_first, ASKED), "_kind", "_bucket")
    answers = dealt(totals(asked, bits, press=True), "_chunk")
    for size in range(AT_ONCE + 1, order + 1):
        longer = dealt(with_answers(chunks, answers, ask_order(size), ASKED), "_kind", "_bucket")
        answers = answers.unionByName(dealt(totals(longer, bits, press=True), "_chunk"))
        asked = asked.unionByName(longer) if size < order else asked
    if order > 1:
        sent = dealt(with_answers(chunks, answers, ask_followers, ASKED), "_kind", "_bucket")
        answers = answers.unionByName(dealt(totals_again(asked, sent, FOLLOWERS), "_chunk"))
    kept = ", ".join(f"`{name}` {named.schema[name].dataType.simpleString()}" for name in keep)
    return with_answers(chunks, answers, score, f"{kept}, {SCORES}")
