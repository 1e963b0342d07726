"""Operator 6: quality by naive Bayes support vectors (after Wang and Manning, 2012).

Features are indicators of n-grams: of one and two words or runs of other characters, and of one
to three shapes (upper case, title case, lower case, digits, other characters as they are, or
"as the one before"). They are hashed to ``FEATURES`` places. Each is scaled by the log ratio of
its share among documents of the two classes; texts are scaled to unit length; a linear hinge-loss
model is fitted by dual coordinate descent (Hsieh et al., 2008), and its margin turned into a probability
by a logistic curve fitted to a quarter of the sample that the model did not see.

The model is fitted on a bounded sample: about ``sample`` labelled rows of each class, chosen by a hash of the id.

Defined cases: null and empty texts have no feature and get the score of the bias alone. Where labels have one class only,
the score is that class, and 0.5 without labels. A row without doc_id is held out. Labels of null
quality are not used; of repeated labels each counts. Other columns are not looked at.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fleetlark.llm.common import may_match, mix, table, text_or_empty
from fleetlark.llm.language import held_out

FEATURES = 1 << 18
SAMPLE = 5_000
_TOKEN = re.compile(r"\w+|[^\w\s]+")
_KEPT_TOKENS = 300_000
_AGAIN = 99


class Features:
    """Indicators of texts. Keeps hashes and shapes of tokens it has met."""

    def __init__(self):
        self.known: dict[str, int] = {}
        self.hashes: list[int] = []
        self.shapes: list[int] = []

    def _number(self, token: str) -> int:
        k = self.known[token] = len(self.known)
        h = xxhash.xxh3_64_intdigest(token.lower())
        self.hashes.append(h)
        if not (token[0].isalnum() or token[0] == "_"):
            self.shapes.append(xxhash.xxh3_64_intdigest(token[:4]) | 128)
        else:
            self.shapes.append(1 if token.isdigit() else 2 if token.isupper() and len(token) > 1 else 3 if token[0].isupper() else 4)
        return k

    def of(self, texts: list[str]) -> list[np.ndarray]:
        if len(self.known) > _KEPT_TOKENS:
            self.__init__()
        known = self.known
        numbers = [np.array([known[t] if t in known else self._number(t) for t in _TOKEN.findall(text)], np.int64) for text in texts]
        hashes, shapes = np.array(self.hashes, np.uint64), np.array(self.shapes, np.uint64)
        return [indicators(hashes[n], shapes[n]) if len(n) else n for n in numbers]


def indicators(words: np.ndarray, shapes: np.ndarray) -> np.ndarray:
    shapes = shapes.copy()
    shapes[1:][(words[1:] == words[:-1]) & (shapes[1:] < 128)] = _AGAIN
    a, b, c = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0x165667B19E3779F9)
    grams = [mix(words), mix(words[:-1] * a + words[1:] + b), mix(shapes + c), mix(shapes[:-1] * a + shapes[1:] + c),
             mix(shapes[:-2] * a + shapes[1:-1] * b + shapes[2:] + c)]
    return np.unique(np.concatenate(grams) & np.uint64(FEATURES - 1)).astype(np.int64)


@dataclass(frozen=True)
class Model:
    ratio: np.ndarray  # log-count ratio of each feature
    weight: np.ndarray
    bias: float
    slope: float
    offset: float

    def margin(self, found: np.ndarray) -> float:
        if not len(found):
            return self.bias
        r = self.ratio[found]
        length = float(np.sqrt(r @ r))
        return self.bias + (float(self.weight[found] @ r) / length if length else 0.0)

    def score(self, found: np.ndarray) -> float:
        return float(1 / (1 + np.exp(-np.clip(self.slope * self.margin(found) + self.offset, -60, 60))))


def log_count_ratios(rows: list[np.ndarray], labels: np.ndarray) -> np.ndarray:
    p, q = (1.0 + np.bincount(np.concatenate([np.zeros(0, np.int64), *[r for r, y in zip(rows, labels, strict=True) if y == side]]), minlength=FEATURES)
            for side in (1, 0))
    return np.log(p / p.sum()) - np.log(q / q.sum())


def dual_coordinate_descent(rows: list[np.ndarray], signs: np.ndarray, ratio: np.ndarray, cost: float = 1.0, epochs: int = 12, seed: int = 0) -> tuple[np.ndarray, float]:
    """Weights and bias that minimise half their squared length plus cost times the hinge losses."""
    weight, bias = np.zeros(len(ratio)), 0.0
    values = [ratio[r] / max(float(np.sqrt(ratio[r] @ ratio[r])), 1e-12) for r in rows]
    alpha, rng = np.zeros(len(rows)), np.random.default_rng(seed)
    for _ in range(epochs):
        for i in rng.permutation(len(rows)):
            gradient = signs[i] * (float(weight[rows[i]] @ values[i]) + bias) - 1
            step = min(max(alpha[i] - gradient / 2, 0.0), cost) - alpha[i]  # the squared length with bias is 2
            if step:
                alpha[i] += step
                weight[rows[i]] += step * signs[i] * values[i]
                bias += step * signs[i]
    return weight, bias


def logistic(margins: np.ndarray, labels: np.ndarray, weights: np.ndarray) -> tuple[float, float]:
    """Slope and offset of the curve that turns margins into probabilities (Newton, slightly damped)."""
    at = np.zeros(2)
    x = np.stack((margins, np.ones(len(margins))), axis=1)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ at, -60, 60)))
        gradient = x.T @ (weights * (p - labels)) + 1e-3 * at
        hessian = (x * (weights * p * (1 - p))[:, None]).T @ x + 1e-3 * np.eye(2)
        step = np.linalg.solve(hessian, gradient)
        at -= np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-8:
            break
    return float(at[0]), float(at[1])


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Model | float:
    """The model, or the constant score where there are not two classes to tell apart."""
    labels = labels.where("quality IN (0, 1) AND doc_id IS NOT NULL").select("doc_id", F.col("quality").cast("int").alias("quality"))
    sizes = {r["quality"]: r["count"] for r in labels.groupBy("quality").count().collect()}
    if len(sizes) < 2:
        return float(next(iter(sizes), 0.5))
    share = F.when(F.col("quality") == 1, F.lit(sample / sizes[1])).otherwise(F.lit(sample / sizes[0]))
    chosen = labels.where(F.pmod(F.xxhash64("doc_id"), F.lit(1_000_000)) < share * 1_000_000)
    texts = may_match(docs.select("doc_id", text_or_empty().alias("text")), "doc_id", chosen, "doc_id").join(chosen, "doc_id")

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        extract = Features()
        for batch in batches:
            found = extract.of(batch.column(1).to_pylist())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array([f.astype(np.int32) for f in found], pa.list_(pa.int32()))],
                                             ["doc_id", "quality", "found"])

    got = (texts.select("doc_id", "text", "quality").mapInArrow(features, "doc_id long, quality int, found array<int>")
           .orderBy(F.xxhash64("doc_id", F.lit(1)), "quality", F.hash("found")).toArrow())
    y = got["quality"].to_numpy()
    rows = [np.asarray(x.values, np.int64) for x in got["found"]]
    seen = np.arange(len(y)) % 4 != 3
    if len(set(y[seen])) < 2:
        return sizes[1] / (sizes[0] + sizes[1])
    train = [r for r, s in zip(rows, seen, strict=True) if s]
    ratio = log_count_ratios(train, y[seen])
    weight, bias = dual_coordinate_descent(train, np.where(y[seen] == 1, 1.0, -1.0), ratio)
    plain = Model(ratio, weight, bias, 1.0, 0.0)
    rest = ~seen if (~seen).any() else seen
    margins = np.array([plain.margin(r) for r, s in zip(rows, rest, strict=True) if s])
    # each class counts as often as among all labels
    frequency = np.array([sizes[0] / max(1, (y[rest] == 0).sum()), sizes[1] / max(1, (y[rest] == 1).sum())])[y[rest]]
    slope, offset = logistic(margins, y[rest].astype(float), frequency * len(margins) / frequency.sum())
    return Model(ratio, weight, bias, slope, offset)


def score(docs: DataFrame, model: Model | float) -> DataFrame:
    """Rows ``(doc_id, score)``: the probability that a document is of quality 1."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        extract = Features()
        for batch in batches:
            out: list[float] = []
            for a in range(0, len(batch), 500):
                texts = batch["text"].iloc[a:a + 500].tolist()
                out += [model] * len(texts) if isinstance(model, float) else [model.score(f) for f in extract.of(texts)]
            yield pd.DataFrame({"doc_id": batch["doc_id"], "score": out})

    return docs.select("doc_id", text_or_empty().alias("text")).mapInPandas(
        run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, score double")


def op6_quality(spark, sf_dir) -> DataFrame:
    docs, labels, out = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), held_out(parts=4, part=2)
    model = fit(docs, labels.where(~out))
    return score(docs, model).select("doc_id", out.alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))
