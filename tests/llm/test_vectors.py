import numpy as np
import pytest
from pyspark.sql import types as T

from fleetlark.llm import vectors as nv

SCHEMA = T.StructType([T.StructField("vec_id", T.LongType()), T.StructField("embedding", T.ArrayType(T.FloatType())),
                       T.StructField("label", T.IntegerType()), T.StructField("rep", T.StringType()), T.StructField("tile", T.StringType())])


def brute(rows, threshold=0.98):
    def good(v):
        return v is not None and len(v) and None not in v and np.isfinite(v).all() and np.any(v)
    units = [np.asarray(v, np.float32).astype(float) / np.linalg.norm(np.asarray(v, np.float32).astype(float)) if good(v) else None for _, v, _ in rows]
    n, low = len(rows), list(range(len(rows)))
    links = [[j for j in range(n) if j != i and units[i] is not None and units[j] is not None and rows[i][2] is not None and rows[i][2] == rows[j][2]
              and len(units[i]) == len(units[j]) and units[i] @ units[j] >= threshold] for i in range(n)]
    changed = True
    while changed:
        changed = False
        for i in range(n):
            for j in links[i]:
                if low[j] < low[i]:
                    low[i], changed = low[j], True
    groups = {}
    for i in range(n):
        groups.setdefault(low[i], []).append(rows[i][0])
    smallest = {g: min((x for x in ids if x is not None), default=None) for g, ids in groups.items()}
    return sorted(((rows[i][0], len(links[i]), None if rows[i][0] is None else smallest[low[i]]) for i in range(n)), key=str)


def run(spark, rows, threshold=0.98):
    df = spark.createDataFrame([(i, v, label, "x", "y") for i, v, label in rows], SCHEMA)
    return sorted(map(tuple, nv.near_duplicate_vectors(df, threshold).collect()), key=str)


def clouds(rng, sizes, dim, spread):
    for label, size in enumerate(sizes):
        centre = rng.normal(size=dim)
        for _ in range(size):
            yield label % 2, (centre + rng.normal(size=dim) * spread).astype(np.float32).tolist()


@pytest.mark.parametrize("tile", [2048, 16])
def test_clouds(spark, monkeypatch, tile):
    monkeypatch.setattr(nv, "TILE", tile)
    rng = np.random.default_rng(tile)
    data = list(clouds(rng, (40, 40, 25, 10), 24, 0.14))
    data += data[:7] * 3
    ids = rng.permutation(len(data))
    rows = [(int(i), v, label) for i, (label, v) in zip(ids, data, strict=True)]
    assert run(spark, rows) == brute(rows)


def test_odd_rows(spark):
    v, w = [1.0, 2.0, 3.0], [1.0, 2.0, 3.01]
    rows = [(1, None, 1), (2, [], 1), (3, [0.0, 0.0, 0.0], 1), (4, [1.0, None, 2.0], 1), (5, [float("nan"), 1.0, 1.0], 1), (6, [float("inf"), 1.0, 1.0], 1),
            (7, v, None), (8, v, None), (9, v, 1), (9, v, 1), (10, w, 1), (9, [-1.0, 0.0, 0.0], 1), (12, [-1.0, 0.0, 0.01], 1), (None, v, 1), (None, [5.0, 5.0], 1),
            (13, [1e38, 2e38, 3e38], 1), (14, [1e-40, 2e-40, 3e-40], 1), (15, v, 2)]
    assert run(spark, rows) == brute(rows)
    assert run(spark, []) == []


def test_the_table(spark, sf):
    rows = [(r["vec_id"], list(r["embedding"]), r["label"]) for r in spark.read.parquet(f"{sf}/embeddings.parquet").collect()]
    for threshold in (0.98, 0.3):
        assert run(spark, rows, threshold) == brute(rows, threshold)


def test_the_bound_holds():
    rng = np.random.default_rng(3)
    for dim in (2, 64, 1500):
        u = nv.unit(rng.normal(size=(60, dim)) ** 3)
        codes, scale, err = nv.quantise(u)
        near = (codes.astype(float) * scale[:, None]) @ (codes.astype(float) * scale[:, None]).T
        assert (np.abs(near - u @ u.T) <= err + err[:, None] * (1 + err) + 1e-12).all()
