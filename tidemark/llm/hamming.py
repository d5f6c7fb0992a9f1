"""Exact top-k search over binary codes by incremental multi-index hashing.

A code of 64 bits is cut into segments so long that a segment value is held by about
:data:`PER_KEY` codes, at any size.  Each code is indexed by each of its ``m``
segments.  A query probes every segment value within a radius that grows from 0.
When the segments up to number ``j`` have been searched to radius ``s`` and the
others to ``s - 1``, every code within distance ``m * s + j`` has been seen: one that
was not differs by ``s + 1`` in the first ``j + 1`` segments and by ``s`` in the others
at least.  So with its k-th verified distance a query knows which segments it still
has to search at the next radius, and is done when there are none.  From then on
only codes within that distance leave the join.

Equal codes are one entry with the first ``k`` of their ids, and equal queries one
query, so copies cost nothing.  A probe of radius ``s + 1`` flips one more bit after the
last flipped one, so no probe is made twice; a code that is found through several
segments counts where it is found first.

A bit is set where the component is above zero (NaN is); missing components are
not.  Rows without a vector are neither found nor answered.  A row is its own
nearest.  Ties go to the smaller id, null ids first.  Rows equal in id and vector
are one row.  With fewer than ``k`` rows all of them are returned.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.tables import stored

BITS = 64
K = 10
PER_KEY = 8


def sign_code(vector: Column) -> Column:
    """The signs of the first 64 components as a long."""
    code = F.lit(0).cast("long")
    for bit in range(BITS):
        place = (1 << bit) if bit < BITS - 1 else -(1 << bit)
        code = code + F.when(F.get(vector, F.lit(bit)) > 0, F.lit(place)).otherwise(F.lit(0)).cast("long")
    return F.when(vector.isNotNull(), code)


def segments(codes: int) -> list[tuple[int, int]]:
    """First bit and length of each segment for so many codes."""
    count = min(16, max(2, round(BITS / math.log2(max(codes / PER_KEY, 16)))))
    edges = [BITS * part // count for part in range(count + 1)]
    return [(low, high - low) for low, high in zip(edges[:-1], edges[1:], strict=True)]


def _segment(code: Column, low: int, length: int) -> Column:
    return F.shiftrightunsigned(code, low).bitwiseAND(F.lit((1 << length) - 1))


def _keys(parts: list[tuple[int, int]], code: Column) -> Column:
    """The code's segments as an array of structs ``segment``, ``length``, ``key``."""
    return F.array(*(
        F.struct(F.lit(k).alias("segment"), F.lit(length).alias("length"), _segment(code, low, length).alias("key"))
        for k, (low, length) in enumerate(parts)
    ))


def _first_found(parts: list[tuple[int, int]], difference: Column) -> Column:
    """Radius and segment at which two codes of this difference meet first, as one number."""
    return F.least(*(
        F.bit_count(_segment(difference, low, length)) * len(parts) + k for k, (low, length) in enumerate(parts)
    ))


def top_k(rows: DataFrame, queries: DataFrame, k: int = K, id_column: str = "vec_id", code: str = "code") -> DataFrame:
    """Columns ``query_id``, ``rank`` (from 1), ``vec_id`` and ``distance``: the ``k`` rows nearest to each query.

    ``rows`` and ``queries`` hold ids and codes.
    """
    by_code = Window.partitionBy("code").orderBy("id")
    held = rows.where(rows[code].isNotNull()).select(rows[id_column].alias("id"), rows[code].alias("code")).distinct()
    held = held.withColumn("_n", F.row_number().over(by_code)).where(F.col("_n") <= k)
    held = stored(held, "codes")
    sizes = held.agg(F.count("*").alias("ids"), F.count(F.when(F.col("_n") == 1, 1)).alias("codes")).first()
    wanted = min(k, sizes.ids)
    parts = segments(sizes.codes)
    count = len(parts)
    index = held.where(F.col("_n") == 1).select("code", F.inline(_keys(parts, F.col("code"))))
    index = stored(index.select("code", "segment", "key"), "index")

    asked = queries.where(queries[code].isNotNull()).select(queries[id_column].alias("query_id"), queries[code].alias("_query"))
    asked = stored(asked.distinct(), "queries")
    probes = asked.select("_query").distinct().select("_query", F.inline(_keys(parts, F.col("_query"))))
    probes = stored(probes.select("*", F.lit(-1).alias("last"), F.lit(BITS).alias("bound")), "probes")
    ranked = Window.partitionBy("_query").orderBy("distance", "id")
    best, radius = None, 0
    while True:
        difference = F.col("code").bitwiseXOR(F.col("_query"))
        met = probes.join(index, ["segment", "key"]).where(
            (_first_found(parts, difference) == F.lit(radius * count) + F.col("segment"))
            & (F.bit_count(difference) <= F.col("bound"))
        )
        met = met.select("_query", "code", F.bit_count(difference).alias("distance"))
        found = met.join(held.select("code", "id"), "code").select("_query", "id", "distance")
        found = found if best is None else best.unionByName(found)
        best = found.withColumn("rank", F.row_number().over(ranked)).where(F.col("rank") <= k)
        best = stored(best.select("_query", "id", "distance"), "best")
        bounds = best.groupBy("_query").agg(F.count("*").alias("_n"), F.max("distance").alias("_far"))
        bounds = bounds.select("_query", F.when(F.col("_n") >= wanted, F.col("_far")).alias("_bound"))
        radius += 1
        going = probes.join(bounds, "_query", "left").withColumn("bound", F.coalesce("_bound", F.lit(BITS)))
        going = going.where((F.col("segment") <= F.col("bound") - radius * count) & (F.col("last") + 1 < F.col("length")))
        flips = F.explode(F.sequence(F.col("last") + 1, F.col("length") - 1))
        probes = going.drop("_bound").withColumn("last", flips)
        probes = probes.withColumn("key", F.col("key").bitwiseXOR(F.expr("shiftleft(1L, last)")))
        probes = stored(probes, "probes")
        if probes.isEmpty():
            break
    answers = best.withColumn("rank", F.row_number().over(ranked))
    return asked.join(answers, "_query").select("query_id", "rank", F.col("id").alias("vec_id"), "distance")


def _half(column: str, first: int) -> str:
    bits = (f"CASE WHEN {column}[{bit + 1}] > 0 THEN {1 << (bit - first)} ELSE 0 END" for bit in range(first, first + 32))
    return f"({' + '.join(bits)})::BIGINT"


TOP_K_SQL = f"""
    WITH codes AS (
        SELECT DISTINCT vec_id, {_half('embedding', 0)} AS low, {_half('embedding', 32)} AS high
        FROM embeddings WHERE embedding IS NOT NULL),
    distances AS (
        SELECT q.vec_id AS query_id, c.vec_id,
               (bit_count(xor(q.low, c.low)) + bit_count(xor(q.high, c.high)))::INT AS distance
        FROM codes q, codes c WHERE q.vec_id % 100 = 0),
    ranked AS (
        SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY distance, vec_id NULLS FIRST)::INT AS rank FROM distances)
    SELECT query_id, rank, vec_id, distance FROM ranked WHERE rank <= {K}
"""
