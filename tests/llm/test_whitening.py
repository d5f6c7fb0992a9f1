import math

import numpy as np
import pytest

from tidemark.llm import whitening
from tidemark.llm.queries import op11_whitening

NAN, INF = float("nan"), float("inf")


def frame(spark, rows):
    clash = [(*row, "a", 1, "b", 2.0) for row in rows]
    return spark.createDataFrame(clash, "vec_id long, embedding array<float>, x string, n int, _id string, whitened double")


def brute(rows, components=16):
    """Rows by id of component, deviation, whitened and explained, in plain numpy."""
    rows = [(name, v) for name, v in rows if v and all(c is not None and math.isfinite(c) for c in v)]
    x = [[math.floor(64 * float(np.float32(c))) + 1_000_000 for c in v] for _, v in rows]
    fit = sorted(set(map(tuple, x)))
    n, sums = len(fit), [sum(column) for column in zip(*fit, strict=True)]
    mean = np.array([s / n for s in sums])
    centred = np.array(fit) - mean
    values, vectors = np.linalg.eigh(centred.T @ centred / n)
    order = np.argsort(-values)[:components]
    found = []
    for (name, _), own in zip(rows, x, strict=True):
        far = sum((n * c - s) ** 2 for c, s in zip(own, sums, strict=True))
        with np.errstate(all="ignore"):
            white = (np.array(own) - mean) @ vectors[:, order] / np.sqrt(values[order])
        found.append((name, n, far, white, values[order] / values.sum()))
    return found


def invented(seed, count, width):
    pick = np.random.default_rng(seed)
    rows = pick.normal(size=(count, width)) * np.linspace(3, 1, width) + pick.normal(size=(count, 1))
    return [(k, [float(np.float32(c)) for c in row]) for k, row in enumerate(rows)]


@pytest.mark.parametrize("size", [whitening.BLOCK_BYTES, 8 * 20 * 7])
def test_equals_numpy(spark, monkeypatch, size):
    """Also with blocks of seven rows; a third of the rows are copies."""
    monkeypatch.setattr(whitening, "BLOCK_BYTES", size)
    rows = invented(1, 300, 20)
    rows += [(1000 + k, rows[5][1]) for k in range(150)] + [(None, rows[6][1]), (7, rows[8][1])]
    odd = [(2000, None), (2001, [None] * 20), (2002, [NAN] * 20), (2003, [INF] + [0.0] * 19), (2004, [])]
    got = whitening.whiten(frame(spark, rows + odd).repartition(5)).collect()
    want = brute(rows)
    assert len(got) == 16 * len(want)
    by_id = {}
    for row in got:
        by_id.setdefault((row.vec_id, row.deviation), {})[row.component] = row
    signs = None
    for name, n, far, white, explained in want:
        own = by_id[name, far]
        assert sorted(own) == list(range(1, 17)) and {row.n for row in own.values()} == {n}
        mine = np.array([own[k].whitened for k in range(1, 17)])
        if signs is None:
            signs = np.sign(mine * white)
        np.testing.assert_allclose(mine * signs, white, atol=1e-7)
        np.testing.assert_allclose([own[k].explained for k in range(1, 17)], explained, rtol=1e-9)
    errors = {row.identity_error for row in got}
    assert len(errors) == 1 and 0 <= errors.pop() < 1e-9


def test_no_variance(spark):
    rows = whitening.whiten(frame(spark, [(1, [0.5, 2.0]), (2, [0.5, 2.0])])).collect()
    assert sorted((r.vec_id, r.component) for r in rows) == [(1, 1), (1, 2), (2, 1), (2, 2)]
    assert {(r.n, r.deviation, r.whitened, r.explained, r.identity_error) for r in rows} == {(1, 0, None, None, None)}


def test_a_direction_without_variance(spark):
    rows = whitening.whiten(frame(spark, [(k, [float(k), 2.0 * k, 1.0]) for k in range(9)])).collect()
    assert all((row.whitened is None) == (row.component > 1) for row in rows)
    assert {row.identity_error < 1e-9 for row in rows} == {True}


def test_empty_and_unequal_lengths(spark):
    empty = whitening.whiten(frame(spark, []))
    assert empty.collect() == [] and empty.columns[:3] == ["vec_id", "component", "n"]
    assert whitening.whiten(frame(spark, [(1, None), (2, [])])).collect() == []
    rows = invented(3, 30, 4)
    mixed = whitening.whiten(frame(spark, rows + [(100, [1.0, 2.0])])).collect()
    assert {row.vec_id for row in mixed} == set(range(30))


def test_large_entries(spark):
    rows = [(1, [3e38, 1.0]), (2, [-3e38, 1.0]), (3, [0.0, 5.0])]
    found = whitening.whiten(frame(spark, rows)).collect()
    assert len(found) == 6 and all(row.deviation is None for row in found if row.vec_id != 3)


def test_exact_deviations():
    big = np.array([[1 << 20, -5]])
    n, rest = 1 << 12, np.array([3, 2])
    assert whitening.deviations(big, n, rest) == [((n << 20) - 3) ** 2 + (5 * n + 2) ** 2 if ((n << 20) - 3) ** 2 < 1 << 63 else None]
    small = np.array([[2, -1], [0, 0]])
    assert whitening.deviations(small, 10, np.array([1, 9])) == [19**2 + 19**2, 1 + 81]


def test_rows_are_dealt_over_tasks(spark, monkeypatch):
    """No product meets in a single task: the scatter has splits, the projection a square grid."""
    monkeypatch.setattr(whitening, "BLOCK_BYTES", 8 * 4 * 10)
    rows = invented(4, 400, 4)
    _, total = whitening.indexed(whitening.usable(frame(spark, rows), "vec_id", "embedding"), "vectors")
    assert total == 400
    index = whitening.indexed(whitening.usable(frame(spark, rows), "vec_id", "embedding"), "vectors")[0].select("_index").collect()
    assert sorted(row[0] for row in index) == list(range(400))


def test_query_equals_numpy(spark, small):
    rows = [(row.vec_id, row.embedding) for row in small("embeddings").collect()]
    want = {name: (n, far, white, share) for name, n, far, white, share in brute(rows)}
    got = op11_whitening(spark, "/root/testdata/sf0.001").collect()
    assert len(got) == 16 * len(want)
    for row in got:
        n, far, white, share = want[row.vec_id]
        assert (row.n, row.deviation) == (n, far) and row.identity_error < 1e-4
        assert abs(abs(row.whitened) - abs(white[row.component - 1])) < 1e-6
        assert abs(row.explained / share[row.component - 1] - 1) < 1e-9
