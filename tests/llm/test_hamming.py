import numpy as np
import pytest
from compare import differences, duck
from pyspark.sql import functions as F

from tidemark.llm import hamming
from tidemark.llm.queries import QUERIES

FOLDER = "/root/testdata/sf0.01"


def test_search_equals_sql(spark):
    assert differences(QUERIES["op5_hamming_top_k"](spark, FOLDER), duck(FOLDER), hamming.TOP_K_SQL) == ""


def brute(rows, queries, k):
    found = []
    for query, code in queries:
        order = sorted(((c ^ code) % (1 << 64)).bit_count() * 10**9 + key for key, c in rows)[:k]
        found += [(query, n + 1, value % 10**9, value // 10**9) for n, value in enumerate(order)]
    return sorted(found)


@pytest.mark.parametrize(("size", "spread"), [(5, 64), (300, 64), (3000, 12)])
def test_search_against_brute_force(spark, size, spread):
    pick = np.random.default_rng(size)
    codes = [int(c) for c in pick.integers(-(1 << (spread - 1)), (1 << (spread - 1)) - 1, size, dtype=np.int64)]
    codes[: size // 3] = [codes[0]] * (size // 3)  # a third are copies
    rows = list(enumerate(codes))
    table = spark.createDataFrame(rows, "vec_id long, code long")
    got = hamming.top_k(table, table.where("vec_id % 50 = 0"), 7).collect()
    assert sorted(map(tuple, got)) == brute(rows, rows[::50], 7)


def test_odd_rows(spark):
    rows = [(1, [1.0] * 64), (2, None), (3, [-1.0, float("nan"), None]), (3, [-1.0, float("nan"), None]), (4, []), (None, [1.0])]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    codes = table.select("vec_id", hamming.sign_code(F.col("embedding")).alias("code"), F.lit(1).alias("distance"))
    got = hamming.top_k(codes, codes.where("vec_id = 3"), 3).orderBy("rank").collect()
    assert [(r.vec_id, r.distance) for r in got] == [(3, 0), (4, 1), (None, 2)]
    assert hamming.top_k(codes.limit(0), codes.limit(0)).count() == 0
    assert hamming.top_k(codes, codes.where("vec_id = 2")).count() == 0


def test_segments_cover_all_bits():
    for codes in (0, 1, 500, 10**6, 10**12):
        parts = hamming.segments(codes)
        assert sum(length for _, length in parts) == 64 and all(length <= 32 for _, length in parts)
