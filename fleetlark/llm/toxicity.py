"""Operator 13: toxicity by a subsequence string kernel with Nyström landmarks.

The kernel of two words counts the subsequences of ``LENGTH`` letters they share, each weighed down by ``DECAY`` for every
place it spans in either (Lodhi et al., 2002): an insult stays similar to itself with letters inserted, dropped out or set apart. It is
scaled to one for equal words and taken to a power; the kernel of two sentences is the sum over their pairs of words. A
sentence is mapped to its kernels with ``LANDMARKS`` words of the training data, whitened by the inverse square root of the kernels
among those (Nyström; Williams and Seeger, 2001), and a linear support vector machine is fitted there by dual coordinate
descent. Since the map is a sum over words, so is a sentence's margin: each distinct word's share is worked out once.

Labels belong to documents: all sentences of a clean one are clean, and of a toxic one at least one is toxic. The machine is fitted
in rounds, each taking the sentence of highest margin of every toxic document, and any others of positive margin, as the
toxic ones (multiple-instance learning; Andrews et al., 2002). Each is taken a second time with a character inserted into its most
toxic word, so that altered insults lie on the same side. A logistic curve, fitted to a quarter of the sample that the
machine did not see, turns a document's highest margin, as far as negative, and the sum of its positive ones into a probability.

Words are what white space sets apart, in lower case, without punctuation at their ends; three and more single characters in a row, set apart
by spaces or signs, are joined to one word. Words of over ``_LONG`` characters count as overlapping stretches of it. Sentences end at a full stop, question or
exclamation mark before white space, at a newline, and after ``SENTENCE_WORDS`` words.

The model is fitted on a bounded sample: about ``sample`` labelled documents of each class, chosen by a hash of the id, of each at
most ``SAMPLE_SENTENCES`` sentences, chosen by a hash. Scoring takes whole texts.

Defined cases: null and empty texts, and those without a word, get the score of a sentence without words. With one
class only, the score is that class, and 0 without labels. A row without doc_id is held out. Labels of null
toxic are not used; of repeated labels each counts. Repeated rows get equal scores. Other columns are not looked at.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import chain, groupby, islice

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fleetlark.llm.common import may_match, slices, table, text_or_empty, utf8
from fleetlark.llm.language import held_out

LENGTH, DECAY, POWER = 3, 0.85, 4
LANDMARKS = 64
SAMPLE, SAMPLE_SENTENCES, SENTENCE_WORDS = 1_500, 64, 48
_LONG = 32
_LANDMARK_LETTERS = 12
# Toxic landmarks are less alike than this.
_DISTINCT = 0.7
_KEPT_WORDS = 400_000
_CHUNK = 512
# Marks before and after a word, so that its ends count as letters do.
_BEGIN, _END = "\x02", "\x03"
_EDGE = "".join(map(chr, [*range(33, 48), *range(58, 65), *range(91, 97), *range(123, 127)]))
_STOPS = ".!?…。"
_SPELT = re.compile(r"\w(?:[\W_]\w){2,}")
_INSERTED = ".-*_'xe"


def sentences(text: str) -> list[list[str]]:
    """Words of each sentence, as they stand, in lower case."""
    found = []
    for line in text.lower().split("\n"):
        words = joined(line.split())
        start = 0
        for stop in [k + 1 for k, w in enumerate(words) if w[-1] in _STOPS] + [len(words)]:
            found += [words[a:min(a + SENTENCE_WORDS, stop)] for a in range(start, stop, SENTENCE_WORDS)]
            start = stop
    return found


def joined(words: list[str]) -> list[str]:
    """Three and more single characters in a row as one word."""
    lengths = list(map(len, words))
    if lengths.count(1) < 3:
        return words
    single = [k for k, n in enumerate(lengths) if n == 1]
    if not any(b - a == 2 for a, b in zip(single, single[2:])):
        return words
    out: list[str] = []
    for alone, run in groupby(words, key=lambda w: len(w) == 1):
        run = list(run)
        out += ["".join(run)] if alone and len(run) > 2 else run
    return out


def units(word: str) -> list[str]:
    """The word between its marks, or overlapping stretches of a long one; nothing for mere punctuation."""
    word = word.strip(_EDGE)
    if not word:
        return []
    if not word.isalpha() and _SPELT.fullmatch(word):
        word = word[::2]
    word = _BEGIN + word + _END
    return [word] if len(word) <= _LONG else [word[a:a + _LONG] for a in range(0, len(word) - _LONG // 2, _LONG // 2)]


def _codes(words: list[str]) -> np.ndarray:
    """Code points in rows, filled up with zeros."""
    size = max(map(len, words))
    return np.frombuffer("".join([w.ljust(size, "\0") for w in words]).encode("utf-32-le"), np.uint32).reshape(len(words), size)


def subsequence_kernel(words: list[str], others: list[str]) -> np.ndarray:
    """The kernel of each word with each other one, not scaled. Dynamic programming over the letters of the words, for
    many others of like length and all their letters at once: ``state[q]`` holds, up to a letter of the other, the weight of
    common subsequences of q + 1 letters."""
    out = np.zeros((len(words), len(others)), np.float32)
    order = sorted(range(len(words)), key=lambda k: len(words[k]))
    by_length = sorted(range(len(others)), key=lambda k: len(others[k]))
    for part in np.array_split(np.array(by_length, np.int64), min(3, len(others))):
        target = _codes([others[k] for k in part])
        alphabet = np.unique(target[target > 0])
        equal = (target == alphabet[:, None, None]).astype(np.float32)  # letter, other, place
        equal = np.concatenate((equal, np.zeros((1, *target.shape), np.float32)))
        onward = _onward(target.shape[1])
        for a in range(0, len(order), _CHUNK):
            rows = order[a:a + _CHUNK]
            codes = _codes([words[k] for k in rows])
            at = np.minimum(np.searchsorted(alphabet, codes), max(0, len(alphabet) - 1))
            letters = np.where(alphabet[at] == codes, at, len(alphabet)) if len(alphabet) else np.zeros(codes.shape, np.int64)
            out[np.ix_(rows, part)] = _chunk(letters, equal, onward)
    return out


def _onward(size: int) -> np.ndarray:
    """Weight with which a subsequence that ends at one place counts at each later one."""
    gap = np.arange(size)[None, :] - np.arange(size)[:, None]
    return np.where(gap > 0, DECAY ** (gap + 1.0), 0).astype(np.float32)


def _chunk(letters: np.ndarray, equal: np.ndarray, onward: np.ndarray) -> np.ndarray:
    first = equal @ onward  # what one letter adds to the subsequences of one letter
    shape = (len(letters), *equal.shape[1:])
    state = [np.zeros(shape, np.float32) for _ in range(LENGTH - 1)]
    total, same, part, sent = (np.zeros(shape, np.float32) for _ in range(4))
    flat, last = (-1, shape[2]), letters.shape[1] - 1
    for place, column in enumerate(letters.T):
        if place:
            np.take(equal, column, axis=0, out=same, mode="clip")
        if place >= LENGTH - 1:  # states before are still zero
            total += np.multiply(same, state[-1], out=part)
        if place == last:
            break
        for q in range(min(LENGTH - 2, place), 0, -1):
            np.multiply(same, state[q - 1], out=part)
            np.matmul(part.reshape(flat), onward, out=sent.reshape(flat))
            state[q] *= DECAY
            state[q] += sent
        state[0] *= DECAY
        state[0] += np.take(first, column, axis=0, out=part, mode="clip")
    return total.sum(axis=2) * np.float32(DECAY ** 2)


def self_kernel(words: list[str]) -> np.ndarray:
    """The kernel of each word with itself."""
    out = np.zeros(len(words), np.float32)
    order = sorted(range(len(words)), key=lambda k: len(words[k]))
    for a in range(0, len(order), 8 * _CHUNK):
        rows = order[a:a + 8 * _CHUNK]
        codes = _codes([words[k] for k in rows])
        onward = _onward(codes.shape[1])
        state = [np.zeros(codes.shape, np.float32) for _ in range(LENGTH - 1)]
        total = np.zeros(codes.shape, np.float32)
        for i in range(codes.shape[1]):
            same = ((codes == codes[:, i, None]) & (codes > 0)).astype(np.float32)
            total += same * state[-1]
            for q in range(LENGTH - 2, 0, -1):
                state[q] = state[q] * DECAY + (same * state[q - 1]) @ onward
            state[0] = state[0] * DECAY + same @ onward
        out[rows] = total.sum(axis=1) * DECAY ** 2
    return out


def similarities(words: list[str], landmarks: list[str], own: np.ndarray) -> np.ndarray:
    """The scaled kernel to the power, with landmarks whose own kernels are given. Words too short to have a
    subsequence are similar to nothing."""
    if not words:
        return np.zeros((0, len(landmarks)), np.float32)
    mine = self_kernel(words)
    scaled = subsequence_kernel(words, landmarks) / (np.sqrt(np.maximum(mine, 1e-30))[:, None] * np.sqrt(np.maximum(own, 1e-30)))
    return np.where(mine[:, None] > 0, scaled, 0) ** POWER


class _Numbers(dict):
    """Numbers words as they are met."""

    def __missing__(self, word: str) -> int:
        self[word] = number = len(self)
        return number


class Shares:
    """What each word adds to the margin of its sentence. Keeps words it has met."""

    def __init__(self, landmarks: list[str], beta: np.ndarray):
        self.landmarks, self.beta, self.own = landmarks, beta.astype(np.float32), self_kernel(landmarks)
        self.number = _Numbers()
        self.values = np.zeros(0)

    def of(self, words: list[str]) -> np.ndarray:
        if len(self.number) > _KEPT_WORDS:
            self.number, self.values = _Numbers(), np.zeros(0)
        number, known = self.number, len(self.number)
        at = np.fromiter(map(number.__getitem__, words), np.int64, len(words))
        if len(number) > known:
            fresh = [units(w) for w in islice(number, known, None)]
            distinct = dict.fromkeys(chain.from_iterable(fresh))
            share = dict(zip(distinct, (similarities(list(distinct), self.landmarks, self.own) @ self.beta).tolist(), strict=True))
            self.values = np.concatenate((self.values, [share[found[0]] if len(found) == 1 else sum([share[u] for u in found]) for found in fresh]))
        return self.values[at]


@dataclass(frozen=True)
class Model:
    landmarks: list[str]
    beta: np.ndarray  # a word's share of the margin is beta times its similarities
    bias: float
    curve: np.ndarray  # of the summary of a document's margins

    def summaries(self, texts: list[list[list[str]]], shares: Shares) -> np.ndarray:
        flat = list(chain.from_iterable(texts))
        sizes = np.array([len(s) for s in flat], np.int64)
        total = np.concatenate(([0], np.cumsum(shares.of(list(chain.from_iterable(flat))))))
        ends = np.concatenate(([0], np.cumsum(sizes)))
        margins = total[ends[1:]] - total[ends[:-1]] + self.bias
        bounds = np.concatenate(([0], np.cumsum([len(t) for t in texts], dtype=np.int64)))
        return np.array([summary(margins[a:b] if b > a else np.array([self.bias])) for a, b in zip(bounds[:-1], bounds[1:], strict=True)]).reshape(-1, 3)

    def scores(self, texts: list[list[list[str]]], shares: Shares) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.summaries(texts, shares) @ self.curve, -60, 60)))


def summary(margins: np.ndarray) -> np.ndarray:
    """Highest margin if negative (within bounds), size of the positive ones, and one."""
    return np.array([min(max(margins.max(initial=-1.5), -1.5), 0.0), np.log1p(np.maximum(margins, 0).sum()), 1.0])


def chosen_landmarks(docs: list[list[list[str]]], labels: np.ndarray, count: int) -> list[str]:
    """Two thirds words that toxic documents have most in excess, one third the words of clean documents most like those."""
    seen = [Counter(), Counter()]
    for doc, label in zip(docs, labels, strict=True):
        seen[label].update({u for sentence in doc for w in sentence for u in units(w)})
    n = np.maximum(np.bincount(labels, minlength=2), 1)

    def excess(word: str) -> float:
        p, q = (seen[1][word] + 0.1) / n[1], (seen[0][word] + 0.1) / n[0]
        return (p - q) / np.sqrt(p / n[1] + q / n[0])

    short = lambda words: [w for w in words if LENGTH < len(w) <= _LANDMARK_LETTERS]
    toxic: list[str] = []
    for w in sorted(short(seen[1]), key=lambda w: (-excess(w), w))[:8 * count]:
        if len(toxic) < count * 2 // 3 and (not toxic or similarities([w], toxic, self_kernel(toxic)).max() < _DISTINCT):
            toxic.append(w)
    rest = sorted(set(short(seen[0])) - set(toxic))
    if not (toxic and rest):
        return toxic + rest[:count - len(toxic)]
    near = similarities(rest, toxic, self_kernel(toxic)).max(axis=1)
    return toxic + [rest[k] for k in np.lexsort((np.arange(len(rest)), -near))[:count - len(toxic)]]


def support_vector_machine(x: np.ndarray, signs: np.ndarray, costs: np.ndarray, epochs: int = 15, seed: int = 0) -> tuple[np.ndarray, float]:
    """Weights and bias that minimise half their squared length plus the hinge losses at their costs, by dual coordinate descent."""
    x = np.hstack((x, np.ones((len(x), 1))))
    square, weight, alpha, rng = (x * x).sum(axis=1), np.zeros(x.shape[1]), np.zeros(len(x)), np.random.default_rng(seed)
    for _ in range(epochs):
        for i in rng.permutation(len(x)):
            step = min(max(alpha[i] - (signs[i] * (x[i] @ weight) - 1) / square[i], 0.0), costs[i]) - alpha[i]
            if step:
                alpha[i] += step
                weight += step * signs[i] * x[i]
    return weight[:-1], float(weight[-1])


def logistic(x: np.ndarray, labels: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """Coefficients of the probability (Newton's steps, cut to two; lightly damped)."""
    at = np.zeros(x.shape[1])
    for _ in range(60):
        p = 1 / (1 + np.exp(-np.clip(x @ at, -60, 60)))
        hessian = (x * (weights * p * (1 - p))[:, None]).T @ x + 1e-2 * np.eye(len(at))
        step = np.linalg.solve(hessian, x.T @ (weights * (p - labels)) + 1e-2 * at)
        at -= np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-8:
            break
    return at


def train(docs: list[list[list[str]]], labels: np.ndarray, frequency: np.ndarray, count: int = LANDMARKS, rounds: int = 3, cost: float = 1.0) -> Model:
    """The model of documents in an order that is random to their content; ``frequency`` says how often each label occurs among all."""
    seen = np.arange(len(docs)) % 4 != 3
    if len(set(labels[seen].tolist())) < 2:
        seen[:] = True
    fitted = [(d, y) for d, y, s in zip(docs, labels.tolist(), seen, strict=True) if s and d]
    landmarks = chosen_landmarks([d for d, _ in fitted], np.array([y for _, y in fitted], np.int64), count)
    if not landmarks:
        return Model(["\x02\x02\x02\x02"], np.zeros(1), 0.0, logistic(np.array([summary(np.zeros(1))] * len(docs)), labels, frequency[labels]))
    own = self_kernel(landmarks)
    values, vectors = np.linalg.eigh(similarities(landmarks, landmarks, own).astype(np.float64) + 1e-3 * np.eye(len(landmarks)))
    whiten = vectors @ np.diag(np.maximum(values, 1e-3) ** -0.5) @ vectors.T
    # a sentence's features: the sum of its words' similarities, whitened
    number: dict[str, int] = {}
    flat = [[number.setdefault(u, len(number)) for w in s for u in units(w)] for d, _ in fitted for s in d]
    near = similarities(list(number), landmarks, own).astype(np.float64)
    features = lambda found: np.array([near[s].sum(axis=0) if s else np.zeros(len(landmarks)) for s in found]) @ whiten
    x, names, rng = features(flat), list(number), np.random.default_rng(0)
    owner = np.repeat(np.arange(len(fitted)), [len(d) for d, _ in fitted])
    toxic = np.array([y for _, y in fitted])[owner] == 1
    shares = near[:, :count * 2 // 3].max(axis=1, initial=0)  # at first: the likeness to a landmark in excess
    margin = np.array([shares[s].max(initial=0) for s in flat]) - 0.5
    for k in range(rounds):
        top = np.full(len(fitted), -np.inf)
        np.maximum.at(top, owner, margin)
        told = np.flatnonzero(toxic & ((margin == top[owner]) | (margin > 0)))
        clean = np.flatnonzero(~toxic)
        worst = [max(flat[i], key=lambda u: shares[u], default=None) for i in told]
        altered = similarities([names[u][:(c := int(rng.integers(2, max(3, len(names[u]) - 1))))] + _INSERTED[int(rng.integers(len(_INSERTED)))] + names[u][c:]
                                for u in worst if u is not None], landmarks, own)
        again = x[[i for i, u in zip(told, worst, strict=True) if u is not None]] + (altered - near[[u for u in worst if u is not None]]) @ whiten
        used = np.concatenate((x[told], again, x[clean]))
        n_toxic = len(told) + len(again)
        costs = np.where(np.arange(len(used)) < n_toxic, cost, cost * max(n_toxic / max(1, len(clean)), 0.1))
        weight, bias = support_vector_machine(used, np.where(np.arange(len(used)) < n_toxic, 1.0, -1.0), costs, seed=k)
        margin, shares = x @ weight + bias, near @ (whiten @ weight)
    plain = Model(landmarks, whiten @ weight, bias, np.zeros(3))
    rest = np.flatnonzero(~seen) if (~seen).any() else np.arange(len(docs))
    found = plain.summaries([docs[k] for k in rest], Shares(landmarks, plain.beta))
    each = np.bincount(labels[rest], minlength=2)
    weights = (frequency / frequency.sum() / np.maximum(each, 1))[labels[rest]] * len(rest)
    curve = logistic(found, labels[rest].astype(float), weights)
    if (curve[:2] < 0).any():  # more toxic sentences never make a document less so
        curve = logistic(found * np.append(curve[:2] >= 0, True), labels[rest].astype(float), weights)
    return Model(landmarks, plain.beta, bias, curve)


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Model | float:
    """The model, or the constant score where there are not two classes to tell apart."""
    labels = labels.where("toxic IN (0, 1) AND doc_id IS NOT NULL").select("doc_id", F.col("toxic").cast("int").alias("toxic"))
    sizes = {r["toxic"]: r["count"] for r in labels.groupBy("toxic").count().collect()}
    if len(sizes) < 2:
        return float(next(iter(sizes), 0))
    share = F.when(F.col("toxic") == 1, F.lit(sample / sizes[1])).otherwise(F.lit(sample / sizes[0]))
    # a doc_id that repeats comes once with each label, so that the sample stays bounded
    picked = labels.where(F.pmod(F.xxhash64("doc_id"), F.lit(1_000_000)) < share * 1_000_000).distinct()
    texts = (may_match(docs.select("doc_id", text_or_empty().alias("text")), "doc_id", picked, "doc_id").join(picked, "doc_id")
             .groupBy("doc_id", "toxic").agg(F.min("text").alias("text")))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for text in batch.column(0).to_pylist():
                found = [" ".join(w[:4 * _LONG] for w in s) for s in sentences(text)]
                keep = sorted(sorted(range(len(found)), key=lambda k: (xxhash.xxh3_64_intdigest(found[k].encode("utf-8", "surrogatepass")), k))[:SAMPLE_SENTENCES])
                out.append([found[k] for k in keep])
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.list_(pa.string())), batch.column(1)], ["found", "toxic"])

    got = (texts.select("text", "toxic", "doc_id").orderBy(F.xxhash64("doc_id", F.lit(1)), "doc_id", "toxic").select("text", "toxic")
           .mapInArrow(cut, "found array<string>, toxic int").toArrow())
    y = got["toxic"].to_numpy().astype(np.int64)
    if len(set(y.tolist())) < 2:
        return sizes[1] / (sizes[0] + sizes[1])
    docs_found = [[joined(s.split()) for s in found] for found in got["found"].to_pylist()]
    return train(docs_found, y, np.array([sizes[0], sizes[1]], float))


def score(docs: DataFrame, model: Model | float) -> DataFrame:
    """Rows ``(doc_id, score)``: the probability that a document is toxic."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shares = None if isinstance(model, float) else Shares(model.landmarks, model.beta)
        for batch in batches:
            for a, b in slices(utf8(batch.column(1))[1]):
                texts = batch.column(1).slice(a, b - a).to_pylist()
                found = np.full(len(texts), model) if shares is None else model.scores([sentences(t) for t in texts], shares)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), pa.array(found, pa.float64())], ["doc_id", "score"])

    return docs.select(F.col("doc_id").cast("long"), text_or_empty().alias("text")).mapInArrow(run, "doc_id long, score double")


def op13_toxicity(spark, sf_dir) -> DataFrame:
    docs, labels, out = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), held_out()
    model = fit(docs, labels.where(~out))
    return score(docs, model).select("doc_id", out.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
