"""Mix sources to target weights by Pareto order sampling, in DataFrame functions only.

Sources in code-point order, null last, weigh :data:`WEIGHTS` in turn and share
:data:`SHARE` times all words.  A target stops at :data:`MOST` times its source's
words; the excess is shared by weight among the others until none is above, which
is one water level: ``target = min(MOST * size, weight * level)``.

A document is wanted ``target / source size`` times.  Where documents have weights of
their own it is wanted by weight, up to :data:`MOST` times, so that the source's words
still add up to the target.  The whole part is certain: so many copies are allocated at
once.  For the rest each document has an inclusion probability, and documents are
ranked by random odds over inclusion odds; the sample is the front of that order,
as long as the middle of the next document is still inside the target.  Only the
edge of the order is looked at row by row: :data:`LEVELS` histograms of 1,024 cells,
each within one cell of the last, find the few rows around it, so that no source is
ever sorted or gathered.

The draw is the md5 of seed and document id (of the text's md5 where the id is null),
so reruns agree.  Null texts have size 0.  Documents of size 0 take no words.  Rows equal in id and text share a draw
and are taken together.  A source without words has target 0.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.tables import stored
from tidemark.sizes import checked_broadcast

# Weights in turn, share of all sizes, most copies of a source.
WEIGHTS = (5, 2, 1)
SHARE = 1.5
MOST = 2
SEED = "mix"
CELLS = 1024
LEVELS = 3
_BITS = 52


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def draw(key: Column, seed: str = SEED) -> Column:
    """A number strictly between 0 and 1 from the md5 of seed and key."""
    digest = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(key.cast("string"), F.lit(""))))
    return (F.conv(F.substring(digest, 1, _BITS // 4), 16, 10).cast("long") + F.lit(0.5)) / F.lit(float(1 << _BITS))


def numbered(sources: DataFrame) -> DataFrame:
    """Adds ``_number``, the place of ``_source`` in code-point order, null last.

    Range partitions are sorted each by itself; a partition's rows follow those of
    all partitions before it, whose counts are one row per partition.
    """
    order = [F.col("_source").isNull(), F.col("_source")]
    placed = stored(
        sources.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_at", F.monotonically_increasing_id()),
        "mix-sources",
    )
    part = F.shiftright("_at", 33)
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    counts = placed.groupBy(part.alias("_part")).count().select(
        "_part", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("_before")
    )
    rows = placed.withColumn("_part", part).join(F.broadcast(counts), "_part")
    return rows.withColumn("_number", F.col("_before") + F.col("_at").bitwiseAND(F.lit((1 << 33) - 1))).drop(
        "_part", "_before", "_at"
    )


def targets(sources: DataFrame) -> DataFrame:
    """Columns ``_source``, ``source_size``, ``target`` from ``_source`` and ``source_size``."""
    weights = F.array(*map(F.lit, WEIGHTS))
    weighted = stored(
        numbered(sources).withColumn("_weight", F.element_at(weights, (F.col("_number") % len(WEIGHTS) + 1).cast("int"))),
        "mix-weights",
    )
    cap = F.col("source_size") * MOST
    level = None
    while True:
        full = F.lit(False) if level is None else F.col("_weight") * F.lit(level) >= cap
        found = weighted.agg(
            F.sum("source_size").alias("all"),
            F.coalesce(F.sum(F.when(full, cap)), F.lit(0)).alias("full"),
            F.sum(F.when(~full, F.col("_weight"))).alias("weight"),
        ).first()
        if not found.weight:
            break  # all are full, or there are none
        risen = (SHARE * found.all - found.full) / found.weight
        if risen == level:
            break
        level = risen
    target = F.least(F.col("_weight") * F.lit(level or 0.0), cap.cast("double"))
    return weighted.select("_source", "source_size", target.alias("target"))


def _edge_rows(rows: DataFrame) -> DataFrame:
    """The rows of the cell in which a source's running total reaches its ``_need``.

    ``_place`` is a row's place in the order, from 0 to 1; it becomes the place within
    the cell, and ``_need`` what is still needed there.
    """
    celled = rows.withColumn("_cell", F.floor(F.col("_place") * CELLS))
    running = Window.partitionBy("_source_key").orderBy("_cell")
    cells = celled.groupBy("_source_key", "_cell").agg(F.sum("_size").alias("_total"), F.first("_need").alias("_need"))
    edges = (
        cells.withColumn("_reached", F.sum("_total").over(running))
        .where((F.col("_reached") >= F.col("_need")) & (F.col("_reached") - F.col("_total") < F.col("_need")))
        .select("_source_key", "_cell", (F.col("_need") - F.col("_reached") + F.col("_total")).alias("_left"))
    )
    inside = celled.join(checked_broadcast(stored(edges, "mix-edges")), ["_source_key", "_cell"])
    return inside.select(
        "_source_key", "_size", "_rank", "_tie", F.col("_left").alias("_need"),
        (F.col("_place") * CELLS - F.col("_cell")).alias("_place"),
    )


def _weighted_levels(rows: DataFrame, wanted: DataFrame) -> DataFrame:
    """``_level`` of each source for documents with weights: ``least(MOST, _own * _level)`` copies make the target.

    Each round counts the documents that are full at the last level and shares the rest of
    the target among the others, so the level only rises, until no more are full.
    """
    while True:
        full = F.col("_own") * F.col("_level") >= MOST
        parts = rows.join(checked_broadcast(wanted), "_source_key").groupBy("_source_key").agg(
            F.first("target").alias("target"), F.first("source_size").alias("source_size"),
            F.first("_level").alias("_last"), F.sum(F.when(full, F.col("_size") * MOST).otherwise(0)).alias("_full"),
            F.sum(F.when(full, 0.0).otherwise(F.col("_size") * F.col("_own"))).alias("_rest"),
        )
        risen = F.coalesce(F.try_divide(F.col("target") - F.col("_full"), F.col("_rest")), F.col("_last"))
        risen = F.greatest(risen, F.when(F.col("_full") > 0, F.col("_last")).otherwise(F.lit(0.0)))
        parts = stored(parts.withColumn("_level", risen), "mix-levels")
        wanted = parts.select("_source_key", "source_size", "target", "_level")
        if parts.where(F.abs(F.col("_level") - F.col("_last")) > 1e-9 * F.col("_last")).isEmpty():
            return wanted


def mix(
    docs: DataFrame, text: str = "text", source: str = "source", key: str = "doc_id", weight: str | None = None
) -> DataFrame:
    """All columns of ``docs`` and ``size``, ``source_size``, ``target``, ``copies``, ``taken``.

    Columns of these names in ``docs`` are replaced.  ``weight`` names a column of
    positive relative weights within a source; without it all documents of a
    source have the same.
    """
    own = F.lit(1.0) if weight is None else F.coalesce(docs[weight].cast("double"), F.lit(1.0))
    source_key = F.coalesce(F.concat(F.lit("="), docs[source]), F.lit("null"))
    added = ["size", "source_size", "target", "copies", "taken"]
    own_columns = [c for c in docs.columns if c.lower() not in added]
    # The row's own columns travel in one struct, so that their names clash with nothing here.
    rows = docs.select(
        F.struct(*(docs[c] for c in own_columns)).alias("_doc"),
        docs[source].alias("_source"), source_key.alias("_source_key"), word_count(docs[text]).alias("_size"),
        own.alias("_own"), draw(F.coalesce(docs[key].cast("string"), F.md5(docs[text]))).alias("_draw"),
        F.struct(docs[key].alias("key"), F.md5(docs[text]).alias("text")).alias("_tie"),
    )
    narrow = stored(rows.select("_source", "_source_key", "_size", "_own", "_draw", "_tie"), "mix-rows")
    totals = stored(
        narrow.groupBy("_source_key").agg(
            F.first("_source", ignorenulls=True).alias("_source"),
            F.sum("_size").alias("source_size"),
        ),
        "mix-totals",
    )
    wanted = targets(totals.select("_source", "source_size"))
    wanted = wanted.withColumn("_source_key", F.coalesce(F.concat(F.lit("="), F.col("_source")), F.lit("null")))
    wanted = wanted.drop("_source").withColumn("_level", F.try_divide(F.col("target"), F.col("source_size").cast("double")))
    wanted = stored(wanted.withColumn("_level", F.coalesce("_level", F.lit(0.0))), "mix-targets")
    if weight is not None:
        wanted = _weighted_levels(narrow, wanted.withColumn("_level", F.lit(0.0)))
    wanted = checked_broadcast(wanted)

    def ranked(table: DataFrame) -> DataFrame:
        """Adds whole copies and the rank key to rows with their source's target."""
        times = F.least(F.lit(float(MOST)), F.col("_level") * F.col("_own"))
        joined = table.join(wanted, "_source_key").withColumn("_times", times)
        joined = joined.withColumn("_whole", F.floor("_times")).withColumn("_chance", F.col("_times") - F.col("_whole"))
        odds = (F.col("_draw") / (1 - F.col("_draw"))) / (F.col("_chance") / (1 - F.col("_chance")))
        return joined.withColumn("_rank", F.when(F.col("_chance") > 0, odds))

    drawn = ranked(narrow)
    needs = drawn.groupBy("_source_key").agg(
        (F.first("target") - F.sum(F.col("_size") * F.col("_whole"))).alias("_need")
    )
    order = drawn.where(F.col("_rank").isNotNull()).select("_source_key", "_size", "_rank", "_tie")
    order = order.join(checked_broadcast(stored(needs, "mix-needs")), "_source_key")
    edge = order.withColumn("_place", F.col("_rank") / (1 + F.col("_rank")))
    for _ in range(LEVELS):
        edge = _edge_rows(edge)
    before = Window.partitionBy("_source_key").orderBy("_rank", "_tie").rowsBetween(Window.unboundedPreceding, -1)
    inside = edge.withColumn("_reached", F.coalesce(F.sum("_size").over(before), F.lit(0)))
    inside = inside.withColumn("_in", F.col("_reached") + F.col("_size") / 2 < F.col("_need"))
    # The border of each source: the last row inside it, or where none is, the first row outside.
    borders = inside.groupBy("_source_key").agg(
        F.max(F.when(F.col("_in"), F.struct("_rank", "_tie"))).alias("_last"),
        F.min(F.struct("_rank", "_tie")).alias("_first"),
    )
    found = ranked(rows).join(checked_broadcast(stored(borders, "mix-borders")), "_source_key", "left")
    own_place = F.struct("_rank", "_tie")
    front = F.when(F.col("_last").isNotNull(), own_place <= F.col("_last")).otherwise(own_place < F.col("_first"))
    # Without a border a source needs nothing more, or its whole order is short of the target.
    short = found.join(checked_broadcast(stored(needs.where(F.col("_need") > 0), "mix-short")), "_source_key", "left")
    chosen = F.when(F.col("_rank").isNull(), F.lit(False)).otherwise(F.coalesce(front, F.col("_need").isNotNull()))
    copies = F.col("_whole") + chosen.cast("long")
    return short.select(
        *(F.col("_doc").getField(c).alias(c) for c in own_columns),
        F.col("_size").alias("size"), "source_size", "target", copies.alias("copies"),
        (F.col("_size") * copies).alias("taken"),
    )


MIX_SQL = f"""
    WITH sized AS (
        SELECT doc_id, source,
               coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0)::BIGINT AS size,
               (('0x' || substr(md5('{SEED}:' || coalesce(doc_id::VARCHAR, md5(text), '')), 1, {_BITS // 4}))::BIGINT + 0.5)
                   / {float(1 << _BITS)!r}::DOUBLE AS u
        FROM documents),
    sources AS (
        SELECT source, sum(size)::BIGINT AS source_size,
               [{', '.join(map(str, WEIGHTS))}][((row_number() OVER (ORDER BY source NULLS LAST) - 1) % {len(WEIGHTS)} + 1)::INT] AS weight
        FROM sized GROUP BY source),
    levels AS (
        SELECT {MOST} * source_size / weight AS ratio,
               ({SHARE}::DOUBLE * (SELECT sum(source_size) FROM sources)
                - coalesce(sum({MOST} * source_size) OVER (ORDER BY {MOST} * source_size / weight, source NULLS LAST
                           ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
               / sum(weight) OVER (ORDER BY {MOST} * source_size / weight, source NULLS LAST
                           ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level
        FROM sources),
    targets AS (
        SELECT source, source_size,
               least(weight * (SELECT max(level) FROM levels WHERE level <= ratio), {MOST} * source_size)::DOUBLE AS target
        FROM sources),
    wanted AS (
        SELECT s.doc_id, s.size, s.u, t.source_size, t.target, s.source,
               CASE WHEN t.source_size > 0 THEN least({MOST}.0::DOUBLE, t.target / t.source_size::DOUBLE) ELSE 0 END AS times
        FROM sized s JOIN targets t ON s.source IS NOT DISTINCT FROM t.source),
    ranked AS (
        SELECT *, floor(times) AS whole, times - floor(times) AS chance FROM wanted),
    keyed AS (
        SELECT *, CASE WHEN chance > 0 THEN (u / (1 - u)) / (chance / (1 - chance)) END AS pareto,
               target - sum(size * whole) OVER (PARTITION BY source) AS need
        FROM ranked),
    walked AS (
        SELECT *, coalesce(sum(size) OVER (PARTITION BY source ORDER BY pareto NULLS LAST, doc_id
                           ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS reached
        FROM keyed)
    SELECT doc_id, size, source_size, target,
           (size * (whole + CASE WHEN pareto IS NOT NULL AND reached + size / 2.0::DOUBLE < need THEN 1 ELSE 0 END))::BIGINT AS taken
    FROM walked
"""
