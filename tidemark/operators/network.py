"""Mini-batch training of the classifier, its gradients added up over partitions.

The network is the original's: a linear layer, then layers of ``tanh`` with dropout, a
linear layer of two outputs and a softmax.  The loss is the cross entropy of the softmax of
*those probabilities* (as the original has it), the optimiser AdamW.

* An epoch deals all rows into batches by a seeded draw of their keys and stores them.
* Where batches are large or few, a step is one job over one batch: each partition of it
  sends its gradient in pieces, an aggregate adds the pieces up, and the driver, which holds
  nothing but the parameters, makes the step.  What is sent and collected has the size of the model.
* Steps follow one another, and a job for each of many small batches would cost far more than
  the step.  There a job makes the steps of a chunk of batches, a bounded number of rows, in one
  task, and the next job goes on from its state.
* Which units drop out for a row follows from the row's key, the epoch and the unit, so a
  repeated task and a repeated run give the same.
* After each epoch the parameters and moments are a stored table.  A new run over the
  same folder goes on after the last complete epoch.

Rows are float64 throughout.  Keys must be unique; rows with a null key, label or
vector are left out.  A dataset without rows cannot be trained on.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterable, Iterator, Sequence
from dataclasses import asdict, dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions.fixed_values import ADAMW, BATCH_SIZE, DROPOUT, EPOCHS, HIDDEN_LAYERS, LEARNING_RATE, SPLIT_SEED
from tidemark.operators.evaluate import class_metrics
from tidemark.operators.sampling import draw_position
from tidemark.sources.tables import is_complete, materialize

#: Numbers in one piece of a gradient or of the stored state.
PIECE = 1 << 15
#: Rows times parameters of a batch up to which one task makes a step by itself, in well under a second.
SMALL_STEP = 1 << 29
#: Steps of an epoch up to which each is a job, however small.
FEW_STEPS = 32
#: Bytes of the vectors in a chunk of small batches.
CHUNK_BYTES = 32 << 20


@dataclass(frozen=True)
class Plan:
    """Shape and training constants."""

    size: int
    hidden: tuple[int, ...] = tuple(HIDDEN_LAYERS)
    dropout: float = DROPOUT
    rate: float = LEARNING_RATE
    batch: int = BATCH_SIZE
    seed: int = SPLIT_SEED

    def shapes(self) -> list[tuple[int, int]]:
        """Inputs and outputs of each linear layer."""
        sizes = [self.size, *self.hidden, 2]
        return list(zip(sizes[:-1], sizes[1:], strict=True))

    def parameters(self) -> int:
        return sum((inputs + 1) * outputs for inputs, outputs in self.shapes())


def layers_of(plan: Plan, flat: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """Weights and biases as views of one array."""
    found, at = [], 0
    for inputs, outputs in plan.shapes():
        middle, end = at + inputs * outputs, at + (inputs + 1) * outputs
        found.append((flat[at:middle].reshape(inputs, outputs), flat[middle:end]))
        at = end
    return found


def first_parameters(plan: Plan) -> np.ndarray:
    """Uniform within one over the root of each layer's inputs."""
    pick = np.random.default_rng(plan.seed)
    limits = [np.full((inputs + 1) * outputs, inputs**-0.5) for inputs, outputs in plan.shapes()]
    limit = np.concatenate(limits)
    return pick.uniform(-limit, limit)


def kept_units(rows: np.ndarray, layer: int, units: int, dropout: float) -> np.ndarray:
    """Which units stay for each row, scaled so that the mean stays; ``rows`` are 64-bit hashes of key and epoch."""
    with np.errstate(over="ignore"):
        x = rows[:, None] + np.uint64(0x9E3779B97F4A7C15) * np.arange(1 + layer * (1 << 20), 1 + layer * (1 << 20) + units, dtype=np.uint64)
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    drawn = ((x ^ (x >> np.uint64(31))) >> np.uint64(11)) / float(1 << 53)
    return (drawn >= dropout) / (1 - dropout)


def softmax(x: np.ndarray) -> np.ndarray:
    raised = np.exp(x - x.max(axis=1, keepdims=True))
    return raised / raised.sum(axis=1, keepdims=True)


def forward(plan: Plan, flat: np.ndarray, x: np.ndarray, rows: np.ndarray | None = None) -> tuple[np.ndarray, list[tuple]]:
    """Probabilities, and what the way back needs: each layer's input, activation and kept units."""
    layers, trace = layers_of(plan, flat), []
    for k, (weights, bias) in enumerate(layers):
        out = x @ weights + bias
        # The first and the last layer are linear.
        inner = 0 < k < len(layers) - 1
        active = np.tanh(out) if inner else out
        mask = kept_units(rows, k, active.shape[1], plan.dropout) if inner and rows is not None else None
        trace.append((x, active if inner else None, mask))
        x = active if mask is None else active * mask
    return softmax(x), trace


def losses(p: np.ndarray, label: np.ndarray) -> np.ndarray:
    """Cross entropy of the softmax of the probabilities, by row."""
    return np.log(np.exp(p).sum(axis=1)) - p[np.arange(len(p)), label]


def gradient(plan: Plan, flat: np.ndarray, x: np.ndarray, label: np.ndarray, rows: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
    """Sum of the rows' gradients as one array, and the probabilities."""
    p, trace = forward(plan, flat, x, rows)
    upper = softmax(p)
    upper[np.arange(len(p)), label] -= 1
    back = p * (upper - (upper * p).sum(axis=1, keepdims=True))
    parts = []
    for (weights, _), (inputs, active, mask) in zip(reversed(layers_of(plan, flat)), reversed(trace), strict=True):
        if mask is not None:
            back = back * mask
        if active is not None:
            back = back * (1 - active**2)
        parts += [back.sum(axis=0), (inputs.T @ back).ravel()]
        back = back @ weights.T
    return np.concatenate(parts[::-1]), p


@dataclass
class State:
    """Parameters and the optimiser's moments after so many steps."""

    flat: np.ndarray
    first: np.ndarray
    second: np.ndarray
    steps: int = 0

    @staticmethod
    def new(plan: Plan) -> State:
        flat = first_parameters(plan)
        return State(flat, np.zeros_like(flat), np.zeros_like(flat))

    def step(self, mean: np.ndarray, rate: float) -> State:
        """One step of AdamW along the mean gradient."""
        beta1, beta2, eps, decay = ADAMW
        steps = self.steps + 1
        first = beta1 * self.first + (1 - beta1) * mean
        second = beta2 * self.second + (1 - beta2) * mean**2
        move = first / (1 - beta1**steps) / (np.sqrt(second / (1 - beta2**steps)) + eps)
        return State(self.flat * (1 - rate * decay) - rate * move, first, second, steps)

    def table(self, spark: SparkSession, losses: Sequence[float]) -> DataFrame:
        """Rows of pieces; the training losses of the epoch's batches go with the first."""
        pieces = range(-(-len(self.flat) // PIECE))
        cut = lambda values: [values[k * PIECE : (k + 1) * PIECE].tolist() for k in pieces]
        columns = {"piece": list(pieces), "flat": cut(self.flat), "first": cut(self.first), "second": cut(self.second)}
        columns["steps"] = [self.steps] * len(pieces)
        columns["losses"] = [list(map(float, losses)) if k == 0 else [] for k in pieces]
        return spark.createDataFrame(pa.table(columns))

    @staticmethod
    def read(stored: DataFrame) -> State:
        # As many rows as the parameters have pieces.
        rows = stored.orderBy("piece").collect()
        whole = [np.concatenate([np.array(row[name]) for row in rows]) for name in ("flat", "first", "second")]
        return State(*whole, rows[0]["steps"])


def _arrays(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    x = batch.column("x").flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)
    return x, batch.column("label").to_numpy(), batch.column("row").to_numpy().astype(np.int64).view(np.uint64)


def batch_gradient(rows: DataFrame, plan: Plan, flat: np.ndarray) -> tuple[np.ndarray, float]:
    """Mean gradient and mean loss over all ``rows`` (``x``, ``label``, ``row``)."""
    shared = rows.sparkSession.sparkContext.broadcast(flat)

    def own(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, loss, count = np.zeros(plan.parameters()), 0.0, 0
        for batch in batches:
            if batch.num_rows:
                x, label, hashes = _arrays(batch)
                found, p = gradient(plan, shared.value, x, label, hashes)
                total += found
                loss += float(losses(p, label).sum())
                count += len(label)
        if count:
            packed = np.append(total, [loss, count])
            pieces = range(-(-len(packed) // PIECE))
            values = [packed[k * PIECE : (k + 1) * PIECE].tobytes() for k in pieces]
            yield pa.RecordBatch.from_arrays([pa.array(pieces, pa.int32()), pa.array(values, pa.binary())], ["piece", "sums"])

    def add(table: pa.Table) -> pa.Table:
        # Floating sums in one order, whatever order the partitions arrive in.
        parts = sorted(value.as_py() for value in table.column("sums"))
        total = np.sum([np.frombuffer(part) for part in parts], axis=0)
        return pa.table({"piece": table.column("piece")[:1], "sums": pa.array([total.tobytes()], pa.binary())})

    schema = "piece int, sums binary"
    added = rows.mapInArrow(own, schema).groupBy("piece").applyInArrow(add, schema).orderBy("piece").collect()
    packed = np.concatenate([np.frombuffer(row["sums"]) for row in added])
    return packed[:-2] / packed[-1], packed[-2] / packed[-1]


def chunk_steps(rows: DataFrame, plan: Plan, state: State) -> tuple[State, list[float]]:
    """The steps of one chunk's batches, one after the other in one task, and the loss of each.

    ``rows`` (``position``, ``x``, ``label``, ``row``) start with a batch; only the last batch may be short.
    """
    shared = rows.sparkSession.sparkContext.broadcast((state.flat, state.first, state.second, state.steps))

    def walk(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, found, waiting = State(*shared.value), [], None

        def stepped(x: np.ndarray, label: np.ndarray, hashes: np.ndarray) -> State:
            total, p = gradient(plan, at.flat, x, label, hashes)
            found.append(float(losses(p, label).sum()) / len(label))
            return at.step(total / len(label), plan.rate)

        for batch in batches:
            if batch.num_rows:
                arrays = _arrays(batch)
                waiting = arrays if waiting is None else tuple(np.concatenate(both) for both in zip(waiting, arrays, strict=True))
                whole = len(waiting[1]) // plan.batch * plan.batch
                for start in range(0, whole, plan.batch):
                    at = stepped(*(values[start : start + plan.batch] for values in waiting))
                waiting = tuple(values[whole:] for values in waiting)
        if waiting is not None and len(waiting[1]):
            at = stepped(*waiting)
        for name, values in (("flat", at.flat), ("first", at.first), ("second", at.second), ("losses", np.array(found))):
            for piece in range(-(-len(values) // PIECE)):
                part = values[piece * PIECE : (piece + 1) * PIECE].tobytes()
                yield pa.RecordBatch.from_pydict({"name": [name], "piece": pa.array([piece], pa.int32()), "part": pa.array([part], pa.binary())})

    ordered = rows.repartition(1).sortWithinPartitions("position").select("x", "label", "row")
    # What is collected has the size of the state and a number for each step.
    parts = sorted(ordered.mapInArrow(walk, "name string, piece int, part binary").collect(), key=lambda row: row["piece"])
    whole = {name: np.concatenate([np.frombuffer(row["part"]) for row in parts if row["name"] == name]) for name in {row["name"] for row in parts}}
    made = whole["losses"].tolist()
    return State(whole["flat"], whole["first"], whole["second"], state.steps + len(made)), made


def _rows(dataset: DataFrame, key: str, embedding: str, label: str) -> DataFrame:
    rows = dataset.select(F.col(key).alias("key"), F.col(embedding).cast("array<double>").alias("x"), F.col(label).cast("int").alias("label"))
    return rows.dropna()


def predict_network(plan: Plan, state: State, dataset: DataFrame, embedding: str = "embedding") -> DataFrame:
    """Add ``probability`` (two numbers)."""
    shared = dataset.sparkSession.sparkContext.broadcast(state.flat)

    @F.pandas_udf("array<double>")
    def probability(vectors):
        p, _ = forward(plan, shared.value, np.stack(vectors.to_numpy()))
        return vectors.__class__(list(p))

    return dataset.withColumn("probability", probability(F.col(embedding).cast("array<double>")))


def history_row(predictions: DataFrame, epoch: int, train_losses: Sequence[float]) -> DataFrame:
    """One row of an epoch: mean training loss of its batches, and scores over all of ``predictions``."""
    p = F.col("probability")
    softened = F.log(F.exp(p[0]) + F.exp(p[1])) - F.when(F.col("label") == 1, p[1]).otherwise(p[0])
    loss = predictions.agg(F.avg(softened).alias("loss"), F.count("*").alias("n"))
    ones = class_metrics(predictions).where(F.col("class") == 1)
    return ones.select(
        F.lit(epoch).alias("epoch"),
        F.lit(float(np.mean(train_losses))).alias("train_loss"),
        loss.select("loss").scalar().alias("valid_loss"),
        loss.select("n").scalar().alias("n_valid"),
        "accuracy", "precision", "recall", "f1",
    )


def train_network(
    train: DataFrame,
    valid: DataFrame,
    folder: str,
    plan: Plan,
    epochs: int = EPOCHS,
    key: str = "author",
    embedding: str = "embedding",
    label: str = "label",
    tag: str = "",
) -> tuple[State, DataFrame]:
    """Train, and check on ``valid`` after each epoch; returns the last state and the history.

    The history has one row per epoch: ``epoch``, ``train_loss``, ``valid_loss``, ``n_valid``,
    ``accuracy``, ``precision``, ``recall`` and ``f1`` of class 1.  Below ``folder``, which all
    executors share, everything is stored under a name made of the plan and ``tag``, which
    names the input (see :func:`tidemark.sources.tables.input_tag`).
    """
    spark = train.sparkSession
    named = hashlib.md5(json.dumps([asdict(plan), tag], sort_keys=True).encode()).hexdigest()[:16]
    home = f"{folder}/network-{named}"
    state = State.new(plan)
    rows = materialize(spark, f"{home}/rows", lambda: _rows(train, key, embedding, label))
    count = rows.count()
    if not count:
        raise ValueError("no rows to train on")
    for epoch in range(1, epochs + 1):
        after = f"{home}/state/epoch-{epoch}"
        if not is_complete(spark, after):
            state, found = _epoch(rows, count, plan, state, f"{home}/batches/epoch-{epoch}", epoch)
            state.table(spark, found).write.mode("overwrite").parquet(after)
        stored = spark.read.parquet(after)
        state = State.read(stored)
        losses_of = stored.where(F.size("losses") > 0).select("losses").first()[0]
        scored = materialize(spark, f"{home}/valid/epoch-{epoch}", lambda at=state: _scored(valid, plan, at, key, embedding, label))
        materialize(spark, f"{home}/history/epoch-{epoch}", lambda e=epoch, s=scored, f=losses_of: history_row(s, e, f))
    return state, spark.read.parquet(*(f"{home}/history/epoch-{epoch}" for epoch in range(1, epochs + 1)))


def _scored(valid: DataFrame, plan: Plan, state: State, key: str, embedding: str, label: str) -> DataFrame:
    rows = predict_network(plan, state, _rows(valid, key, embedding, label), "x")
    return rows.select("key", "label", "probability", (F.col("probability")[1] > F.col("probability")[0]).cast("int").alias("prediction"))


def _epoch(rows: DataFrame, count: int, plan: Plan, state: State, path: str, epoch: int) -> tuple[State, list[float]]:
    """All steps of an epoch, and the loss of each batch."""
    drawn = draw_position(rows, "key", plan.seed * 1_000_003 + epoch)
    hashed = F.xxhash64(F.col("key"), F.lit(plan.seed), F.lit(epoch)).alias("row")
    steps = -(-count // plan.batch)
    chained = steps > FEW_STEPS and plan.batch * plan.parameters() <= SMALL_STEP
    together = max(1, CHUNK_BYTES // (8 * plan.size * plan.batch)) if chained else 1
    batch = F.floor((F.col("position") - 1) / (plan.batch * together)).cast("int")
    dealt = drawn.select(batch.alias("batch"), "position", "x", "label", hashed)
    dealt.repartition("batch").write.mode("overwrite").partitionBy("batch").parquet(path)
    stored = rows.sparkSession.read.schema(dealt.schema).parquet(path)
    found = []
    for number in range(-(-steps // together)):
        part = stored.where(F.col("batch") == number).select("position", "x", "label", "row")
        if chained:
            state, made = chunk_steps(part, plan, state)
            found += made
        else:
            mean, loss = batch_gradient(part.drop("position"), plan, state.flat)
            state = state.step(mean, plan.rate)
            found.append(loss)
    return state, found
