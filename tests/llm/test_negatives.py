import numpy as np
import pytest
from hypothesis import given
from hypothesis import strategies as st
from pyspark.sql import types as T

import oracle_check
from fleetlark.llm import negatives as ng

SCHEMA = T.StructType([T.StructField("vec_id", T.LongType()), T.StructField("embedding", T.ArrayType(T.FloatType())), T.StructField("label", T.IntegerType()),
                       T.StructField("tile", T.StringType()), T.StructField("score", T.StringType()), T.StructField("anchor", T.StringType())])


def brute(rows, every=100, low=80):
    """Every anchor against every row, with Python's integers."""
    good = {}
    for i, v, label in rows:
        if i is not None and label is not None and v is not None and None not in v and np.isfinite(v).all() and all(abs(x) < 2 ** 20 for x in v):
            code = [int(np.floor(256 * float(np.float32(x)))) for x in v]
            good[i, len(v)] = min(good.get((i, len(v)), (label, code)), (label, code))
    out = []
    for (a, dim), (label, code) in good.items():
        if a % every:
            continue
        scored = sorted((-sum(x * y for x, y in zip(code, c, strict=True)), b, m == label) for (b, d), (m, c) in good.items() if d == dim and b != a)
        for s, p, _ in [x for x in scored if x[2]][:5]:
            fitting = [(t, n) for t, n, same in scored if not same and low * -s <= 100 * -t <= 100 * -s]
            out += [(a, p, k + 1, n, -s, -t) for k, (t, n) in enumerate(fitting[:5])]
    return sorted(out)


def run(spark, rows, **options):
    df = spark.createDataFrame([(i, v, label, "x", "y", "z") for i, v, label in rows], SCHEMA)
    return sorted(map(tuple, ng.mine_hard_negatives(df, **options).collect()))


def test_the_table_against_sql(spark):
    sf = "/root/testdata/sf0.01"
    assert oracle_check.differences(ng.op12_negatives(spark, sf), oracle_check.connect(sf), ng.OP12_SQL) is None


@pytest.mark.parametrize("spread", [0.02, 1.0, 0.0])
def test_small_tiles_against_brute_force(spark, monkeypatch, spread):
    """One label holds most rows; with spread 0 nearly all scores are equal."""
    monkeypatch.setattr(ng, "ROW_TILE", 40)
    monkeypatch.setattr(ng, "ANCHOR_TILE", 7)
    rng = np.random.default_rng(int(spread * 100))
    centre = rng.normal(size=6)
    rows = [(i - 60, (centre + spread * rng.normal(size=6)).astype(np.float32).tolist(), int(rng.integers(0, 3)) if i % 3 else 7) for i in range(240)]
    wanted = brute(rows, every=10)
    assert run(spark, rows, every=10) == wanted and len(wanted) > 100


def test_odd_rows(spark):
    v, w = [1.0, 2.0], [1.0, 1.9]
    rows = [(0, v, 1), (1, v, 1), (1, v, 1), (2, w, 2), (2, w, 2), (2, v, 3), (100, None, 1), (200, [None, 1.0], 1), (300, [float("nan"), 1.0], 1), (400, v, None),
            (None, v, 2), (3, [float("inf"), 0.0], 2), (500, [], 1), (501, [], 1), (502, [], 2), (0, [1.0, 2.0, 3.0], 1), (5, [1.0, 2.0, 3.0], 1), (6, [1.0, 2.0, 2.9], 2),
            (600, [-1.0, -2.0], 1), (700, [0.0, 0.0], 1), (7, [5e8, 1.0], 2), (8, [1e5, 2e5], 2), (800, [1.0, 2.0, 3.0], 9), (-100, v, 2)]
    wanted = brute(rows)
    assert run(spark, rows) == wanted and (0, 5, 2, 6) in [r[:4] for r in wanted] and (500, 501, 1, 502, 0, 0) in wanted
    assert run(spark, []) == [] and run(spark, rows[:1]) == [] and run(spark, [(7, v, 1), (8, v, 2)]) == []


def test_large_components_stay_exact(spark):
    rng = np.random.default_rng(5)
    rows = [(i * 50, (rng.integers(-2 ** 19, 2 ** 19, 4) + 0.5).tolist(), i % 2) for i in range(30)]
    assert run(spark, rows) == brute(rows)


LONG = st.integers(-2 ** 63, 2 ** 63 - 1)


@given(st.lists(st.tuples(st.integers(0, 9), LONG, LONG, LONG), max_size=8))
def test_keys_sort_as_the_numbers(rows):
    keys = [ng.packed_key(*r) for r in rows]
    assert [ng.unpacked_key(k) for k in sorted(keys)] == sorted(rows, key=lambda r: (r[0], r[1], -r[2], r[3]))


def test_the_iterator_holds_little():
    """A million negatives of one score before and after a positive: the windows close after five."""
    def pairs():
        for n in range(1_000_000):
            yield ng.packed_key(4, 1, 100, n), n == 500_000
    read = 0

    def counted():
        nonlocal read
        for pair in pairs():
            read += 1
            yield pair
    found = list(ng.windows(counted(), 5, 80, 100))
    assert found == [(1, 500_000, k + 1, k, 100, 100) for k in range(5)] and read == 1_000_000
