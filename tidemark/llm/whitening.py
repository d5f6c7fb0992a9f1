"""Whitening of embeddings with MLlib's BlockMatrix.

1. Every usable vector becomes whole numbers ``x = floor(64 * c) + 1000000`` and gets
   a consecutive index (offsets from one count per task).
2. The *fit list* has each distinct ``x`` once: the row of the least index.  Copies
   are put together before they are shuffled.  It gives ``n`` and the sums ``S``.
3. Rows are centred and gathered, ``height`` consecutive ones at a time, into the blocks of a
   BlockMatrix; rows outside of the fit list are zero in a second one, which is
   multiplied with its own transpose.  Each task multiplies a few blocks of rows, and
   only the products, of one vector's length squared, are added up.
4. The driver takes the eigenvectors of that one small matrix.
5. A second multiplication projects all rows.  The blocks are laid out on a square
   grid for it, the whitening matrix repeats along the diagonal of the other side: a
   product with one column of blocks would get few tasks.
6. The whitened rows of the fit list are centred and multiplied in the same way;
   what differs from the identity is ``identity_error``.

Rows whose vector is null, empty, or holds null or non-finite entries are left out, and
so are vectors of another length than the most frequent one (of several: the longest).
``64 * c`` is held within ±2**46, where doubles are still exact.  A component without
variance (eigenvalue zero up to rounding) has null ``whitened``; without any variance
``explained`` and ``identity_error`` are null too.  ``deviation`` is exact, null where
it does not fit a long.  Ids may be null or repeat: every row is answered by itself.
Other columns are left alone; without usable rows the result is empty.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from py4j.java_gateway import JavaObject
from pyspark.mllib.common import callMLlibFunc
from pyspark.mllib.linalg import MatrixUDT
from pyspark.mllib.linalg.distributed import BlockMatrix
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, LongType, StructField, StructType

from tidemark.llm.tables import stored
from tidemark.sizes import inline_table

SCALE, SHIFT, LARGEST = 64.0, 1_000_000, float(1 << 46)
#: Bytes of a block of centred rows.
BLOCK_BYTES = 2 << 20
#: Blocks of rows that one task of the scatter multiplies.
BLOCKS_PER_TASK = 8

_PLACE = StructType([StructField("_1", LongType()), StructField("_2", LongType())])
#: What MLlib takes as blocks: place in the grid, and matrix.
BLOCKS = StructType([StructField("_1", _PLACE), StructField("_2", MatrixUDT())])
_ARROW_PLACE = pa.struct([("_1", pa.int64()), ("_2", pa.int64())])
_NUMBERS = pa.list_(pa.field("element", pa.int32(), False))
_DOUBLES = pa.list_(pa.field("element", pa.float64(), False))
_ARROW_MATRIX = pa.struct([
    pa.field(name, kind, name in ("colPtrs", "rowIndices", "values"))
    for name, kind in [
        ("type", pa.int8()), ("numRows", pa.int32()), ("numCols", pa.int32()), ("colPtrs", _NUMBERS),
        ("rowIndices", _NUMBERS), ("values", _DOUBLES), ("isTransposed", pa.bool_()),
    ]
])


def whole_numbers(vector: Column) -> Column:
    """The long of each entry."""
    held = lambda c: F.greatest(F.least(F.lit(SCALE) * c.cast("double"), F.lit(LARGEST)), F.lit(-LARGEST))
    return F.transform(vector, lambda c: F.floor(held(c)) + F.lit(SHIFT).cast("long"))


def usable(rows: DataFrame, row_id: str, vector: str) -> DataFrame:
    """Columns ``_id`` and ``x`` of the rows that take part."""
    found = rows.select(rows[row_id].alias("_id"), rows[vector].alias("_vector"))
    finite = F.forall("_vector", lambda c: c.isNotNull() & ~F.isnan(c.cast("double")) & (F.abs(c.cast("double")) < float("inf")))
    return found.where((F.size("_vector") > 0) & finite).select("_id", whole_numbers(F.col("_vector")).alias("x"))


def indexed(rows: DataFrame, what: str) -> tuple[DataFrame, int]:
    """``rows`` stored with a consecutive ``_index``, and their number."""
    kept = stored(rows.withColumn("_at", F.monotonically_increasing_id()), what)
    task, place = F.shiftright("_at", 33), F.col("_at").bitwiseAND(F.lit((1 << 33) - 1))
    # One row for each task that wrote.
    sizes = kept.groupBy(task.alias("_task")).count().orderBy("_task").collect()
    before, offsets = 0, []
    for row in sizes:
        offsets.append((row["_task"], before))
        before += row["count"]
    table = inline_table(rows.sparkSession, ["_task", "_before"], offsets or [(0, 0)])
    numbered = kept.withColumn("_task", task).join(F.broadcast(table), "_task")
    return numbered.select(*rows.columns, (F.col("_before") + place).alias("_index")), before


def _matrices(places: np.ndarray, blocks: list[np.ndarray]) -> pa.RecordBatch:
    """Blocks by place (rows of two numbers) as MLlib's rows."""
    spots = [{"_1": int(a), "_2": int(b)} for a, b in places]
    empty = pa.nulls(len(blocks), _NUMBERS)
    ends = np.concatenate([[0], np.cumsum([block.size for block in blocks])])
    values = np.concatenate([block.ravel() for block in blocks]) if blocks else np.zeros(0)
    columns = [
        pa.array([1] * len(blocks), pa.int8()),
        pa.array([block.shape[0] for block in blocks], pa.int32()),
        pa.array([block.shape[1] for block in blocks], pa.int32()),
        empty,
        empty,
        pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(values, pa.float64()), type=_DOUBLES),
        pa.array([True] * len(blocks), pa.bool_()),  # row by row
    ]
    matrices = pa.StructArray.from_arrays(columns, fields=list(_ARROW_MATRIX))
    return pa.RecordBatch.from_arrays([pa.array(spots, _ARROW_PLACE), matrices], ["_1", "_2"])


def _grid(frame: DataFrame, height: int, width: int, rows: int, columns: int) -> JavaObject:
    return callMLlibFunc("createBlockMatrix", frame, height, width, rows, columns)


def _scatter(frame: DataFrame, blocks: int, height: int, width: int) -> np.ndarray:
    """Transpose times matrix, for a matrix of one column of blocks."""
    tall = BlockMatrix(_grid(frame, height, width, blocks * height, width), height, width)
    splits = max(1, -(-blocks // BLOCKS_PER_TASK))
    # The multiplication of the Python class has no splits: the rows would meet in one task.
    product = tall.transpose()._java_matrix_wrapper._java_model.multiply(tall._java_matrix_wrapper._java_model, splits)
    return BlockMatrix(product, width, width).toLocalMatrix().toArray()


def _projected(frame: DataFrame, blocks: int, height: int, matrix: np.ndarray) -> DataFrame:
    """Each block of rows times ``matrix``: columns ``_block`` and ``_matrix``."""
    spark, (width, parts) = frame.sparkSession, matrix.shape
    across = max(1, int(np.ceil(np.sqrt(blocks))))
    down = -(-blocks // across)

    def on_grid(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            block = batch.column("_1").field("_1").to_numpy()
            place = pa.StructArray.from_arrays(
                [pa.array(block // across, pa.int64()), pa.array(block % across, pa.int64())], fields=list(_ARROW_PLACE)
            )
            yield pa.RecordBatch.from_arrays([place, batch.column("_2")], ["_1", "_2"])

    def diagonal(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column("id").to_numpy()
            yield _matrices(np.stack([ids, ids], axis=1), [matrix] * len(ids))

    left = _grid(frame.mapInArrow(on_grid, BLOCKS), height, width, down * height, across * width)
    right = _grid(spark.range(across).mapInArrow(diagonal, BLOCKS), width, parts, across * width, across * parts)
    found = callMLlibFunc("getMatrixBlocks", left.multiply(right, 1))
    number = F.col("_1._1").cast("long") * across + F.col("_1._2").cast("long")
    return found.select(number.alias("_block"), F.col("_2").alias("_matrix"))


def _rows_of(matrix: dict) -> np.ndarray:
    """A dense MLlib matrix as rows."""
    shape, values = (matrix["numRows"], matrix["numCols"]), np.asarray(matrix["values"], np.float64)
    return values.reshape(shape) if matrix["isTransposed"] else values.reshape(shape[::-1]).T


def _matrix_at(column: pa.StructArray, at: int) -> np.ndarray:
    own = {name: column.field(name)[at] for name in ("numRows", "numCols", "isTransposed", "values")}
    plain = {name: value.as_py() for name, value in own.items() if name != "values"}
    return _rows_of(plain | {"values": own["values"].values.to_numpy()})


def deviations(centred: np.ndarray, n: int, rest: np.ndarray) -> list[int | None]:
    """Sum of squares of ``n * centred - rest`` by row: whole numbers, so the sums are exact."""
    largest = int(np.abs(centred).max(initial=0)) * n + int(np.abs(rest).max(initial=0))
    if largest * largest * centred.shape[1] < 1 << 63:
        return ((centred * n - rest) ** 2).sum(axis=1).tolist()
    exact = [sum((int(c) * n - int(r)) ** 2 for c, r in zip(row, rest, strict=True)) for row in centred]
    return [value if value < 1 << 63 else None for value in exact]


def whiten(rows: DataFrame, row_id: str = "vec_id", vector: str = "embedding", components: int = 16) -> DataFrame:
    """Columns ``row_id``, ``component`` (from 1), ``n``, ``deviation``, ``whitened``, ``explained`` and ``identity_error``."""
    spark = rows.sparkSession
    kind = rows.schema[row_id].dataType.simpleString()
    result = f"`{row_id}` {kind}, component int, n long, deviation long, whitened double, explained double, identity_error double"
    every = usable(rows, row_id, vector)
    lengths = every.groupBy(F.size("x").alias("length")).count().orderBy(F.desc("count"), F.desc("length")).first()
    if lengths is None:
        return spark.createDataFrame([], result)
    width = lengths["length"]
    numbered, total = indexed(every.where(F.size("x") == width), "vectors")
    height = max(1, BLOCK_BYTES // (8 * width))
    blocks = -(-total // height)

    fit = stored(numbered.groupBy("x").agg(F.min("_index").alias("_index")), "fit")
    n = fit.count()
    sums = fit.select(F.posexplode("x").alias("at", "value")).groupBy("at").agg(F.sum(F.col("value").cast("decimal(20,0)")).alias("sum"))
    totals = [int(row["sum"]) for row in sums.orderBy("at").collect()]
    # x - S/n = (x - whole) - rest/n: the first part is exact.
    whole = np.array([s // n for s in totals], np.int64)
    rest = np.array([s % n for s in totals], np.int64)

    def gather(key: tuple[pa.Scalar, ...], own: pa.Table, fitted: pa.Table) -> pa.Table:
        own = own.sort_by("_index")
        index = own.column("_index").to_numpy()
        x = own.column("x").combine_chunks().flatten().to_numpy().reshape(-1, width)
        centred = x - whole
        marks = np.isin(index, fitted.column("_index").to_numpy())
        block = int(key[0].as_py())
        matrix = _matrices(np.array([[block, 0]]), [centred - rest / n])
        ids = pa.ListArray.from_arrays(pa.array([0, len(index)], pa.int32()), own.column("_id").combine_chunks())
        far = pa.array([deviations(centred, n, rest)], pa.list_(pa.int64()))
        names = ["_1", "_2", "_ids", "_far", "_fit"]
        return pa.table([matrix.column("_1"), matrix.column("_2"), ids, far, pa.array([marks.tolist()], pa.list_(pa.bool_()))], names)

    block_of = F.floor(F.col("_index") / F.lit(height)).cast("long").alias("_block")
    extra = StructType.fromDDL(f"_ids array<{kind}>, _far array<bigint>, _fit array<boolean>").fields
    gathered = (
        numbered.select("_id", "x", "_index", block_of).groupBy("_block")
        .cogroup(fit.select("_index", block_of).groupBy("_block"))
        .applyInArrow(gather, StructType([*BLOCKS.fields, *extra]))
    )
    gathered = stored(gathered, "blocks")
    matrices = gathered.select("_1", "_2")

    def fitted_rows(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            places = [tuple(place.values()) for place in batch.column("_1").to_pylist()]
            marks = batch.column("_fit").to_pylist()
            kept = [_matrix_at(batch.column("_2"), at) * np.array(own)[:, None] for at, own in enumerate(marks)]
            yield _matrices(np.array(places), kept)

    listed = matrices if n == total else stored(gathered.select("_1", "_2", "_fit").mapInArrow(fitted_rows, BLOCKS), "fitted")
    covariance = _scatter(listed, blocks, height, width) / n
    values, vectors = np.linalg.eigh((covariance + covariance.T) / 2)
    order = np.argsort(-values, kind="stable")[:components]
    values, vectors = values[order], vectors[:, order]
    trace = float(np.trace(covariance))
    firm = values > max(0.0, float(values.max())) * width * np.finfo(float).eps
    scaled = np.zeros_like(vectors)
    scaled[:, firm] = vectors[:, firm] / np.sqrt(values[firm])

    numbers = gathered.select(F.col("_1._1").alias("_block"), "_ids", "_far", "_fit")
    projected = stored(_projected(matrices, blocks, height, scaled).join(numbers, "_block"), "projected")
    error = _identity_error(projected, blocks, height, n, firm)
    explained = [float(value) / trace if trace > 0 else None for value in values]
    parts = len(values)

    def answer(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(batch.num_rows):
                found = _matrix_at(batch.column("_matrix"), at)
                size = len(found)
                row = pa.array(np.repeat(np.arange(size), parts))
                white = pa.array(found.ravel(), mask=np.tile(~firm, size))
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("_ids")[at].values.take(row),
                        pa.array(np.tile(np.arange(1, parts + 1), size), pa.int32()),
                        pa.array(np.full(size * parts, n), pa.int64()),
                        batch.column("_far")[at].values.take(row),
                        white,
                        pa.array(explained * size, pa.float64()),
                        pa.array([error] * (size * parts), pa.float64()),
                    ],
                    [row_id, "component", "n", "deviation", "whitened", "explained", "identity_error"],
                )

    return projected.mapInArrow(answer, result)


def _identity_error(projected: DataFrame, blocks: int, height: int, n: int, firm: np.ndarray) -> float | None:
    """How far the covariance of the fit list's whitened rows is from the identity."""
    if not firm.any():
        return None
    width = int(firm.sum())

    def kept(batch: pa.RecordBatch, at: int) -> tuple[np.ndarray, np.ndarray]:
        marks = np.array(batch.column("_fit")[at].as_py(), bool)
        return _matrix_at(batch.column("_matrix"), at)[:, firm], marks

    def sums(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(batch.num_rows):
                found, marks = kept(batch, at)
                yield pa.RecordBatch.from_arrays([pa.array(range(width), pa.int32()), pa.array(found[marks].sum(axis=0))], ["part", "sum"])

    columns = projected.select("_block", "_matrix", "_fit")
    added = columns.mapInArrow(sums, "part int, sum double").groupBy("part").agg(F.sum("sum").alias("sum"))
    mean = np.array([row["sum"] for row in added.orderBy("part").collect()]) / n

    def centred(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            whole = []
            for at in range(batch.num_rows):
                found, marks = kept(batch, at)
                whole.append((found - mean) * marks[:, None])
            places = [(block, 0) for block in batch.column("_block").to_pylist()]
            yield _matrices(np.array(places, np.int64).reshape(-1, 2), whole)

    covariance = _scatter(columns.mapInArrow(centred, BLOCKS), blocks, height, width) / n
    return float(np.abs(covariance - np.eye(width)).max())
