"""Near-duplicate groups by fast similarity sketching, banding and exact verification.

A document's set is that of its distinct word shingles.  Its sketch has
:data:`COORDINATES` coordinates: in each of the first rounds every shingle is thrown
into one hashed bin, and a bin keeps its least value; a bin still empty goes on to the
next round.  Should bins be left after as many rounds as coordinates, further rounds
throw all shingles into one bin each, so every coordinate is filled for any set.
Long sets fill all bins in a round or two, so a sketch costs about one hash for each
shingle, and the share of equal coordinates keeps close to the similarity.

Documents with equal sets are one node.  Nodes that agree in one of :data:`BANDS`
bands meet in a bucket.  Links are verified on full sets, in rounds that never write
out all pairs of a bucket:

1. the first node of a bucket is the one that meets most others; each node is compared
   with one of its buckets' first nodes, again the one that meets most;
2. in buckets that hold several components after that, each node is compared with
   the bucket's first node;
3. the same among the nodes outside of the bucket's largest component so far;
4. what is still apart: the nodes outside of a bucket's largest component are
   compared with the nodes of the other components, but for those pairs whose
   similarity is bounded below the threshold by what is known of each node alone:
   the shingles it shares with any other, those with the bucket's first node, and which
   of :data:`CELLS` hashed cells its shingles fall into.

Only links between different components can change the result, so the components
are those of all links that any bucket holds.  At the threshold of 0.8 a pair
misses all buckets with a chance of 5 in 10**8.

Null and empty texts have an empty set and are linked with nothing.  Rows equal in
text are always in one group, also if they are equal in id.  A null id has no part
in the choice of a group's first id.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.arrays import U, as_long, give_back, mix, shingle_sets, text_blocks, word_hashes
from tidemark.llm.components import components
from tidemark.llm.tables import stored
from tidemark.sizes import fits_broadcast

COORDINATES = 128
BANDS = 32
#: Links have 100 * intersection >= THRESHOLD * union.
THRESHOLD = 80
#: Two sets share at most as many members as they share cells, and the lesser number of members beyond one a cell.
CELLS = 2048
ROUND_SEEDS = mix(np.arange(1, 2 * COORDINATES + 1, dtype=np.uint64) * U(0xC2B2AE3D27D4EB4F))


def sketch(shingles: np.ndarray) -> np.ndarray:
    """The fast similarity sketch of a set that is not empty."""
    most = U(0xFFFFFFFFFFFFFFFF)
    bins = np.full(COORDINATES, most)
    for turn in range(2 * COORDINATES):
        thrown = mix(shingles + ROUND_SEEDS[turn])
        # The round comes first in a value, so an earlier round always wins.
        value = (U(turn) << U(48)) | (thrown >> U(16))
        if turn < COORDINATES:
            np.minimum.at(bins, (thrown & U(0xFFFF)) % U(COORDINATES), value)
        else:
            bins[turn - COORDINATES] = min(bins[turn - COORDINATES], value.min())
        if (bins != most).all():
            break
    return bins


def bands(coordinates: np.ndarray) -> np.ndarray:
    """One hash for each band of coordinates."""
    rows = coordinates.reshape(BANDS, -1)
    found = mix(np.arange(1, BANDS + 1, dtype=np.uint64))
    for column in range(rows.shape[1]):
        found = mix(found * U(3) + rows[:, column])
    return found


def digest(shingles: np.ndarray) -> bytes:
    """128 bits that name a set."""
    low = np.bitwise_xor.reduce(mix(shingles + U(1)))
    high = np.add.reduce(mix(shingles ^ U(0x5851F42D4C957F2D)))
    return np.array([low, high, len(shingles)], np.uint64).tobytes()[:20]


def _sets(block: pa.RecordBatch, size: int) -> list[np.ndarray]:
    return shingle_sets(*word_hashes(block.column("_text")), size)


def sketched(rows: DataFrame, keep: list[str], size: int) -> DataFrame:
    """Columns ``keep``, ``n_shingles``, ``node`` (null for an empty set) and ``bands``, from ``_text``."""

    def work(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        give_back()
        for block in text_blocks(batches, "_text"):
            sets = _sets(block, size)
            columns = [
                pa.array([len(own) for own in sets], pa.int64()),
                pa.array([digest(own) if len(own) else None for own in sets], pa.binary()),
                pa.array([as_long(bands(sketch(own))) if len(own) else None for own in sets], pa.list_(pa.int64())),
            ]
            kept = [block.column(name) for name in keep]
            yield pa.RecordBatch.from_arrays([*kept, *columns], [*keep, "n_shingles", "node", "bands"])

    kept = ", ".join(f"`{name}` {rows.schema[name].dataType.simpleString()}" for name in keep)
    return rows.mapInArrow(work, f"{kept}, n_shingles long, node binary, bands array<long>")


def full_sets(rows: DataFrame, size: int) -> DataFrame:
    """Columns ``_set`` (its name) and ``shingles`` (sorted 64-bit hashes), from ``_text``."""

    def work(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        give_back()
        for block in text_blocks(batches, "_text"):
            sets = [own for own in _sets(block, size) if len(own)]
            columns = [pa.array([digest(own) for own in sets], pa.binary()), pa.array([own.tobytes() for own in sets], pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, ["_set", "shingles"])

    return rows.mapInArrow(work, "_set binary, shingles binary")


def compared(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """Columns ``a``, ``b``, ``common`` (the size of the intersection) and ``linked``, from full sets."""
    first = sets.select(F.col("node").alias("a"), F.col("shingles").alias("_a"))
    second = sets.select(F.col("node").alias("b"), F.col("shingles").alias("_b"))
    both = pairs.join(second, "b").join(first, "a")

    def compare(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            shared, linked = [], []
            for a, b in zip(batch.column("_a"), batch.column("_b"), strict=True):
                a, b = np.frombuffer(a.as_buffer(), np.uint64), np.frombuffer(b.as_buffer(), np.uint64)
                place = np.minimum(np.searchsorted(a, b), len(a) - 1)
                common = int((a[place] == b).sum())
                shared.append(common)
                linked.append(100 * common >= THRESHOLD * (len(a) + len(b) - common))
            columns = [batch.column("a"), batch.column("b"), pa.array(shared, pa.int64()), pa.array(linked, pa.bool_())]
            yield pa.RecordBatch.from_arrays(columns, ["a", "b", "common", "linked"])

    return both.select("a", "b", "_a", "_b").mapInArrow(compare, "a long, b long, common long, linked boolean")


def unshared(sets: DataFrame) -> DataFrame:
    """Columns ``node`` and ``_alone``: how many shingles of a node no other of these nodes has."""

    def spell(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = [np.frombuffer(raw.as_buffer(), np.int64) for raw in batch.column("shingles")]
            node = np.repeat(batch.column("node").to_numpy(), [len(one) for one in own])
            flat = np.concatenate([*own, np.zeros(0, np.int64)])
            yield pa.RecordBatch.from_arrays([pa.array(node, pa.int64()), pa.array(flat, pa.int64())], ["node", "shingle"])

    spelt = sets.select("node", "shingles").mapInArrow(spell, "node long, shingle long")
    held = spelt.groupBy("shingle").agg(F.count("*").alias("_n"), F.min("node").alias("node")).where("_n = 1")
    return held.groupBy("node").agg(F.count("*").alias("_alone"))


def cells_of(sets: DataFrame) -> DataFrame:
    """Columns ``node``, ``cells`` (a set's cells as bits of longs) and ``beyond`` (members beyond one a cell)."""

    def count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found, beyond = [], []
            for raw in batch.column("shingles"):
                own = np.frombuffer(raw.as_buffer(), np.uint64)
                taken = np.zeros(CELLS, np.uint8)
                taken[(own >> U(40)) % U(CELLS)] = 1
                found.append(np.packbits(taken).view(np.int64))
                beyond.append(len(own) - int(taken.sum()))
            columns = [batch.column("node"), pa.array(found, pa.list_(pa.int64())), pa.array(beyond, pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, ["node", "cells", "beyond"])

    return sets.select("node", "shingles").mapInArrow(count, "node long, cells array<long>, beyond long")


def _by_cells(one: Callable[[str], Column], other: Callable[[str], Column]) -> Column:
    """The most that two sets can share by their cells."""
    both = (F.bit_count(one("cells")[k].bitwiseAND(other("cells")[k])) for k in range(CELLS // 64))
    return sum(both, F.least(one("beyond"), other("beyond")))


def _close(common: Column, a: Column, b: Column) -> Column:
    """Whether sets of sizes ``a`` and ``b`` with at most ``common`` shared members may be similar enough."""
    return 100 * common >= THRESHOLD * (a + b - common)


def _bound(one: Callable[[str], Column], other: Callable[[str], Column]) -> Column:
    """The most that two nodes of a bucket can share, from what is known of each alone.

    ``shared`` counts a node's shingles that any other node has too, ``with_first`` those
    that it shares with the bucket's first node (null if they were not compared).
    """
    shared = F.least(one("shared"), other("shared"))
    rest = F.least(one("shared") - one("with_first"), other("shared") - other("with_first"))
    by_first = F.least(one("with_first"), other("with_first")) + F.greatest(rest, F.lit(0))
    both = one("with_first").isNotNull() & other("with_first").isNotNull()
    return F.least(shared, F.when(both, by_first).otherwise(shared))


def _with_first(members: DataFrame, bounded: bool) -> DataFrame:
    """Pairs of each node with the most central node of its bucket: columns ``bucket``, ``a`` and ``b``."""
    known = ["shared", "with_first", "cells", "beyond"] if bounded else []
    first = members.groupBy("bucket").agg(F.max(F.struct("score", "node", "n", *known)).alias("_first"))
    first = stored(first, "first")  # a plain table, so that a hot bucket can be split in the join
    pairs = members.join(first, "bucket").where(F.col("node") != F.col("_first.node"))
    if bounded:
        most = _bound(F.col, lambda name: F.col(f"_first.{name}"))
        by_cells = _by_cells(F.col, lambda name: F.col(f"_first.{name}"))
        pairs = pairs.where(_close(most, F.col("n"), F.col("_first.n")) & _close(by_cells, F.col("n"), F.col("_first.n")))
    return pairs.select("bucket", F.col("_first.node").alias("a"), F.col("node").alias("b"))


def _nearest_first(members: DataFrame) -> DataFrame:
    """Pairs of each node with the most central of the first nodes of its buckets: columns ``a`` and ``b``."""
    first = stored(members.groupBy("bucket").agg(F.max(F.struct("score", "node")).alias("_first")), "first")
    met = members.select("bucket", "node").join(first, "bucket").where(F.col("node") != F.col("_first.node"))
    return met.groupBy(F.col("node").alias("b")).agg(F.max("_first").alias("_first")).select(F.col("_first.node").alias("a"), "b")


def _outside(members: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Members with their bucket's largest component as ``_largest``, and those outside of it."""
    parts = members.groupBy("bucket", "component").agg(F.count("*").alias("_size"))
    largest = parts.groupBy("bucket").agg(F.max(F.struct("_size", "component")).getField("component").alias("_largest"))
    marked = stored(members.join(stored(largest, "largest"), "bucket"), "marked")
    return marked, marked.where(F.col("component") != F.col("_largest"))


def _known(members: DataFrame, sets: DataFrame, firsts: DataFrame) -> DataFrame:
    """Members with ``shared``, ``with_first``, and ``cells`` and ``beyond`` of their node."""
    own = sets.join(members.select("node").distinct(), "node", "left_semi")
    met = firsts.select("bucket", F.col("b").alias("node"), F.col("common").alias("with_first"))
    full = members.join(unshared(own), "node", "left").withColumn("shared", F.col("n") - F.coalesce("_alone", F.lit(0)))
    return stored(full.drop("_alone").join(met, ["bucket", "node"], "left").join(cells_of(own), "node"), "known")


def _still_apart(members: DataFrame) -> DataFrame:
    """Pairs of nodes outside of their bucket's largest component with the nodes of its other components.

    Pairs that are bounded below the threshold are left out.
    """
    marked, outside = _outside(members)
    names = ["node", "n", "component", "shared", "with_first", "cells", "beyond"]
    outside = outside.select("bucket", *(F.col(name).alias(f"_{name}") for name in names))
    # Of two nodes outside, only one order.
    once = (F.col("component") == F.col("_largest")) | (F.col("_node") < F.col("node"))
    most = _bound(F.col, lambda name: F.col(f"_{name}"))
    by_cells = _by_cells(F.col, lambda name: F.col(f"_{name}"))
    pairs = marked.join(outside, "bucket").where(
        (F.col("component") != F.col("_component"))
        & once
        & _close(most, F.col("n"), F.col("_n"))
        & _close(by_cells, F.col("n"), F.col("_n"))
    )
    return pairs.select(F.col("_node").alias("a"), F.col("node").alias("b")).distinct()


def _mixed(members: DataFrame, groups: DataFrame) -> DataFrame:
    """Members with their components, of the buckets that hold more than one."""
    own = members.drop("component").join(groups, "node", "left").withColumn("component", F.coalesce("component", "node"))
    own = stored(own, "members")
    spread = own.groupBy("bucket").agg(F.min("component").alias("_low"), F.max("component").alias("_high"))
    mixed = stored(spread.where("_low != _high").select("bucket"), "buckets")
    return stored(own.join(mixed, "bucket", "left_semi"), "members")


def near_duplicates(
    docs: DataFrame, size: int = 5, text: str = "text", key: str = "doc_id", keep: tuple[str, ...] = ()
) -> DataFrame:
    """Columns ``key``, ``keep``, ``n_shingles``, ``component_id``, ``kept`` and ``group`` for every row.

    ``component_id`` is the least key of the row's group; ``kept`` marks the rows of that
    key.  ``group`` is the same for all rows of a group, and null for an empty set.
    """
    rows = docs.select(docs[key].alias("_key"), *keep, docs[text].alias("_text"), F.xxhash64(docs[text]).alias("_row"))
    found = stored(sketched(rows, ["_key", *keep, "_row"], size), "sketches")
    nodes = found.where(F.col("node").isNotNull()).groupBy(F.col("node").alias("_set")).agg(
        F.min("_key").alias("_least"), F.min(F.struct("_row", "_key")).alias("_one"), F.first("n_shingles").alias("n"),
        F.first("bands").alias("bands"),
    )
    # Numbers instead of 128-bit names from here on; they are fixed by being stored.
    nodes = stored(nodes.withColumn("node", F.monotonically_increasing_id()), "nodes")
    placed = nodes.select("node", "n", F.posexplode("bands").alias("band", "bucket"))
    full = placed.groupBy("bucket").agg(F.count("*").alias("_size")).where("_size > 1")
    members = stored(placed.join(stored(full, "buckets"), "bucket"), "members")
    # A node is the more central, the more others it meets.
    score = members.groupBy("node").agg(F.sum("_size").alias("score"))
    members = members.drop("_size").join(score, "node").withColumn("component", F.col("node"))
    members = stored(members, "members")

    # The texts behind the nodes that meet another one: one row for each.
    meeting = members.select("node").distinct()
    wanted = nodes.join(meeting, "node", "left_semi").select(F.col("_one._row").alias("_row"), F.col("_one._key").alias("_key"))
    wanted = stored(wanted, "meeting")
    if fits_broadcast(wanted):
        wanted = F.broadcast(wanted)
    same = (rows["_row"] == wanted["_row"]) & rows["_key"].eqNullSafe(wanted["_key"])
    sets = full_sets(rows.join(wanted, same, "left_semi").select("_text"), size).dropDuplicates(["_set"])
    sets = stored(sets.join(nodes.select("_set", "node"), "_set").select("node", "shingles"), "sets")

    met = stored(compared(_nearest_first(members), sets), "compared")
    links = met.where("linked").select("a", "b")
    groups = components(links)
    members = _mixed(members, groups)
    if not members.isEmpty():
        with_first = stored(_with_first(members, False), "firsts")
        pairs = with_first.select("a", "b").distinct().join(met, ["a", "b"], "left_anti")
        met = met.union(stored(compared(pairs, sets), "compared"))
        links = met.where("linked").select("a", "b")
        groups = components(links)
        members = _mixed(members, groups)
    if not members.isEmpty():
        members = _known(members, sets, with_first.join(met, ["a", "b"]))
        # Clusters beside a bucket's largest one find each other through their own first node.
        second = _with_first(_outside(members)[1], True).select("a", "b").distinct()
        links = links.union(stored(compared(second, sets).where("linked").select("a", "b"), "compared"))
        members = _mixed(members, components(links))
        if not members.isEmpty():
            last = stored(compared(_still_apart(members), sets), "compared")
            links = links.union(last.where("linked").select("a", "b"))
        groups = components(links)
    labelled = nodes.select("_set", "node", "_least").join(groups, "node", "left")
    labelled = stored(labelled.withColumn("group", F.coalesce("component", "node")), "groups")
    least = labelled.groupBy("group").agg(F.min("_least").alias("component_id"))
    named = stored(labelled.join(least, "group").select(F.col("_set").alias("node"), "group", "component_id"), "groups")
    component = F.coalesce("component_id", "_key")
    return found.join(named, "node", "left").select(
        F.col("_key").alias(key), *keep, "n_shingles", component.alias("component_id"),
        F.coalesce(F.col("_key") == component, F.lit(False)).alias("kept"), "group",
    )
