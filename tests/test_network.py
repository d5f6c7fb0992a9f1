import hashlib
import math

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.operators import network
from tidemark.operators.network import Plan

PLAN = Plan(3, (4, 3), dropout=0.5, rate=0.05, batch=16, seed=5)


def invented(spark, count, seed, partitions=3):
    pick = np.random.default_rng(seed)
    x = pick.normal(size=(count, 3)).round(3)
    rows = [(f"u{k}", v.tolist(), int(v[0] + 0.3 * v[1] > 0)) for k, v in enumerate(x)]
    return rows, spark.createDataFrame(rows, "author string, embedding array<float>, label int").repartition(partitions)


def plain_loss(flat, x, label, masks):
    """The network written out once more, for one row after the other."""
    w1, b1 = flat[:12].reshape(3, 4), flat[12:16]
    w2, b2 = flat[16:28].reshape(4, 3), flat[28:31]
    w3, b3 = flat[31:37].reshape(3, 2), flat[37:39]
    total = 0.0
    for row, want, mask in zip(x, label, masks, strict=True):
        z = np.tanh((row @ w1 + b1) @ w2 + b2) * mask @ w3 + b3
        p = np.exp(z) / np.exp(z).sum()
        total += math.log(np.exp(p).sum()) - p[want]
    return total / len(x)


def slope(flat, *batch):
    found = np.zeros_like(flat)
    for k in range(len(flat)):
        step = np.zeros_like(flat)
        step[k] = 1e-5
        found[k] = (plain_loss(flat + step, *batch) - plain_loss(flat - step, *batch)) / 2e-5
    return found


def test_training_equals_a_plain_run(spark, tmp_path):
    rows, train = invented(spark, 40, 1)
    _, valid = invented(spark, 30, 2)
    state, history = network.train_network(train, valid, str(tmp_path), PLAN, epochs=2)
    flat = network.first_parameters(PLAN)
    assert len(flat) == PLAN.parameters() == 39
    first, second, steps, losses = np.zeros(39), np.zeros(39), 0, []
    keys = spark.createDataFrame([(name,) for name, _, _ in rows], "key string")
    for epoch in (1, 2):
        hashes = dict(keys.select("key", F.xxhash64("key", F.lit(5), F.lit(epoch))).collect())
        seed = 5 * 1_000_003 + epoch
        dealt = sorted(rows, key=lambda row, s=seed: hashlib.md5(f"{s}:{row[0]}".encode()).hexdigest())
        found = []
        for at in range(0, len(dealt), 16):
            part = dealt[at : at + 16]
            own = np.array([hashes[name] for name, _, _ in part]).astype(np.int64).view(np.uint64)
            masks = network.kept_units(own, 1, 3, 0.5)
            x = np.array([v for _, v, _ in part], np.float32).astype(float)
            batch = x, [label for _, _, label in part], masks
            found.append(plain_loss(flat, *batch))
            mean, steps = slope(flat, *batch), steps + 1
            first, second = 0.9 * first + 0.1 * mean, 0.999 * second + 0.001 * mean**2
            flat = flat - 0.05 * 0.01 * flat
            flat = flat - 0.05 * (first / (1 - 0.9**steps)) / (np.sqrt(second / (1 - 0.999**steps)) + 1e-8)
        losses.append(np.mean(found))
    got = {row.epoch: row for row in history.collect()}
    assert [got[k].train_loss for k in (1, 2)] == pytest.approx(losses, abs=1e-5)
    np.testing.assert_allclose(state.flat, flat, atol=2e-4)
    assert state.steps == 6


def test_history_equals_sql_on_stored_probabilities(spark, tmp_path):
    _, train = invented(spark, 120, 3)
    _, valid = invented(spark, 80, 4)
    _, history = network.train_network(train, valid, str(tmp_path), Plan(3, (8, 6), 0.1, 0.02, 32, 7), epochs=4)
    rows = {row.epoch: row for row in history.collect()}
    assert sorted(rows) == [1, 2, 3, 4] and rows[4].train_loss < rows[1].train_loss
    for epoch, row in rows.items():
        path = f"{next(tmp_path.glob('network-*'))}/valid/epoch-{epoch}/*.parquet"
        sql = f"""SELECT count(*), avg(ln(exp(probability[1]) + exp(probability[2])) - probability[label + 1]),
            avg((label = (probability[2] > probability[1])::int)::int),
            2e0 * count(*) FILTER (label = 1 AND prediction = 1) / (count(*) FILTER (label = 1) + count(*) FILTER (prediction = 1))
            FROM '{path}'"""
        n, loss, accuracy, f1 = duckdb.connect().execute(sql).fetchone()
        assert (row.n_valid, row.valid_loss, row.accuracy, row.f1) == (n, *(pytest.approx(v) for v in (loss, accuracy, f1)))


def test_a_lost_driver_goes_on(spark, tmp_path, monkeypatch):
    """A second run takes what is stored, and both runs agree with one that was not broken off."""
    _, train = invented(spark, 50, 5)
    _, valid = invented(spark, 20, 6)
    steps = []
    real = network.batch_gradient
    monkeypatch.setattr(network, "batch_gradient", lambda *a: steps.append(1) or real(*a))
    network.train_network(train, valid, str(tmp_path / "a"), PLAN, epochs=1)
    assert len(steps) == 4
    state, history = network.train_network(train, valid, str(tmp_path / "a"), PLAN, epochs=2)
    assert len(steps) == 8 and history.count() == 2
    other = train.repartition(1).orderBy(F.desc("author"))
    whole, _ = network.train_network(other, valid, str(tmp_path / "b"), PLAN, epochs=2)
    np.testing.assert_allclose(state.flat, whole.flat, rtol=1e-9)
    network.train_network(train, valid, str(tmp_path / "a"), PLAN, epochs=2, tag="other input")
    assert len(steps) == 24


def test_gradients_of_partitions_add_up(spark):
    rows, _ = invented(spark, 60, 7)
    flat = network.first_parameters(PLAN)
    frame = spark.createDataFrame([(v, label, k) for k, (_, v, label) in enumerate(rows)], "x array<double>, label int, row long")
    one = network.batch_gradient(frame.coalesce(1), PLAN, flat)
    many = network.batch_gradient(frame.repartition(7), PLAN, flat)
    np.testing.assert_allclose(one[0], many[0], rtol=1e-9, atol=1e-12)
    assert one[1] == pytest.approx(many[1])


def test_odd_rows(spark, tmp_path):
    rows = [("a", [1.0, 2.0, 3.0], 1), (None, [1.0, 2.0, 3.0], 1), ("b", None, 0), ("c", [0.0, 0.0, 0.0], None), ("d", [0.0, 1.0, 0.0], 0)]
    frame = spark.createDataFrame(rows, "author string, embedding array<double>, label int")
    _, history = network.train_network(frame, frame, str(tmp_path), PLAN, epochs=1)
    assert history.first().n_valid == 2
    with pytest.raises(ValueError, match="no rows"):
        network.train_network(frame.limit(0), frame, str(tmp_path / "none"), PLAN, epochs=1)


def test_dropout_keeps_its_share():
    rows = np.arange(4000, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    kept = network.kept_units(rows, 2, 50, 0.5)
    assert set(np.unique(kept)) == {0.0, 2.0} and abs(kept.mean() - 1) < 0.02
    assert abs(np.corrcoef(kept[:, 0], kept[:, 1])[0, 1]) < 0.06


def test_many_small_steps_share_jobs(spark, tmp_path, monkeypatch):
    """Chunks of small batches end where a job for each batch ends, and need no such job."""
    _, train = invented(spark, 700, 8)
    _, valid = invented(spark, 20, 9)
    jobs, chunks = [], []
    real, chunk = network.batch_gradient, network.chunk_steps
    monkeypatch.setattr(network, "batch_gradient", lambda *a: jobs.append(1) or real(*a))
    monkeypatch.setattr(network, "chunk_steps", lambda *a: chunks.append(1) or chunk(*a))
    # 40 batches in a chunk, so that the second chunk ends with a short batch.
    monkeypatch.setattr(network, "CHUNK_BYTES", 40 * 16 * 3 * 8)
    state, history = network.train_network(train, valid, str(tmp_path / "a"), PLAN, epochs=2)
    assert (len(jobs), len(chunks), state.steps) == (0, 4, 88)
    monkeypatch.setattr(network, "FEW_STEPS", 1000)
    other, single = network.train_network(train, valid, str(tmp_path / "b"), PLAN, epochs=2)
    assert (len(jobs), len(chunks)) == (88, 4)
    np.testing.assert_allclose(state.flat, other.flat, rtol=1e-7, atol=1e-12)
    both = zip(history.orderBy("epoch").collect(), single.orderBy("epoch").collect(), strict=True)
    assert all(list(a) == pytest.approx(list(b)) for a, b in both)
    monkeypatch.setattr(network, "FEW_STEPS", 4)
    monkeypatch.setattr(network, "SMALL_STEP", 100)
    network.train_network(train.limit(100), valid, str(tmp_path / "c"), PLAN, epochs=1)
    assert (len(jobs), len(chunks)) == (95, 4)
