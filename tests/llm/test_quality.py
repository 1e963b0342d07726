import numpy as np

from fleetlark.llm import quality

SF = "/root/testdata/sf0.01"


def test_held_out_accuracy(spark):
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    rows = quality.op6_quality(spark, SF).join(labels, "doc_id").where("held_out").collect()
    assert sum(r["predicted"] == r["quality"] for r in rows) >= 0.95 * len(rows) > 50


def test_odd_rows(make_docs, spark):
    docs = make_docs([(1, None), (2, ""), (3, "good words here"), (3, "good words here"), (None, "x")], extra=("quality", "score"))
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert quality.fit(docs, none) == 0.5
    assert quality.fit(docs, spark.createDataFrame([(3, 1, 0), (2, None, 0), (None, 0, 0)], none.schema)) == 1.0
    assert [r["score"] for r in quality.score(docs, 0.5).collect()] == [0.5] * 5
    assert quality.score(docs.limit(0), 0.5).count() == 0


def test_coordinate_descent_reaches_the_optimum():
    rng = np.random.default_rng(1)
    rows = [np.unique(rng.integers(0, 20, 5)) for _ in range(60)]
    signs = np.where(rng.random(60) < 0.5, 1.0, -1.0)
    ratio = rng.normal(size=20)
    x = np.array([[ratio[k] if k in r else 0.0 for k in range(20)] for r in rows])
    x = np.hstack((x / np.linalg.norm(x, axis=1, keepdims=True), np.ones((60, 1))))

    def primal(w):
        return 0.5 * w @ w + np.maximum(0, 1 - signs * (x @ w)).sum()
    weight, bias = quality.dual_coordinate_descent(rows, signs, ratio, epochs=400)
    best = np.append(weight, bias)
    assert all(primal(best) <= primal(best + rng.normal(size=21) * s) + 1e-3 for s in (0.01, 0.1) for _ in range(200))
