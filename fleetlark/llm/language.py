"""Operator 8: language identification by segmentation-marginalised unigrams.

Every language has a probability for each piece of a fixed public vocabulary. A text is scored by the sum over all
its segmentations of the product of piece probabilities, by the forward algorithm over the lattice (lattice.py), and
given to the language of the highest posterior (all languages equally likely before).

The probabilities are expected piece counts (forward-backward) over a bounded sample of training
texts: about ``sample`` distinct texts of each language, chosen by a hash of the text, each counted once
however many rows repeat it.

Defined cases: a text that is null or has no letter is ``und`` with score 0, as is every text if
there is nothing to learn from. Ties go to the language that sorts first. A row without doc_id is held out.
Repeated rows get equal predictions. Other columns are not looked at.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import islice

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fleetlark.llm.common import table
from fleetlark.llm.lattice import MODEL, Lattice, Numbers, Vocabulary, read_model

UNDETERMINED = "und"
SAMPLE = 10_000
_SLICE_CHARS = 1 << 20
_KEPT_UNITS = 200_000
_SMOOTHING = 0.5


def held_out(doc_id: str = "doc_id", parts: int = 5, part: int = 0) -> Column:
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % parts == part, F.lit(True))


def fit(train: DataFrame, sample: int = SAMPLE, model: str = MODEL) -> tuple[list[str], np.ndarray]:
    """Languages and log-probabilities (pieces by languages) from rows ``(text, lang)``."""
    data = read_model(model)
    train = train.where("text IS NOT NULL AND lang IS NOT NULL").select("text", "lang")
    key = F.xxhash64("text")
    sizes = {r["lang"]: r["n"] for r in train.groupBy("lang").agg(F.count_distinct(key).alias("n")).collect()}
    langs = sorted(sizes)
    share = F.create_map(*[x for lang in langs for x in (F.lit(lang), F.lit(min(1.0, sample / sizes[lang])))]) if langs else F.lit(None)
    if not langs:
        return [], np.zeros((0, 0))
    chosen = train.where(F.pmod(key, F.lit(1_000_000)) < share[F.col("lang")] * 1_000_000).dropDuplicates(["text", "lang"])
    number = {lang: k for k, lang in enumerate(langs)}

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        vocabulary = Vocabulary(data)
        sums = np.zeros((vocabulary.size, len(langs)))
        for batch in batches:
            index = Numbers()
            found = [index.of(text) for text in batch["text"]]
            lang = np.repeat([number[x] for x in batch["lang"]], [len(f) for f in found])
            times = np.bincount(np.concatenate([np.zeros(0, np.int64), *found]) * len(langs) + lang.astype(np.int64), minlength=len(index) * len(langs)).reshape(-1, len(langs))
            words = list(index)
            for a in range(0, len(words), 50_000):
                lattice = Lattice.of(words[a:a + 50_000], vocabulary)
                weights = lattice.weights(vocabulary.prior, vocabulary)
                ways = lattice.forward(weights)
                chance = np.exp(ways[lattice.source] + weights + lattice.backward(weights)[lattice.target] - lattice.totals(ways)[lattice.owner])
                known = lattice.piece >= 0
                np.add.at(sums, lattice.piece[known], chance[known, None] * times[a:a + 50_000][lattice.owner[known]])
        piece, lang = np.nonzero(sums)
        yield pd.DataFrame({"piece": piece, "lang": lang, "n": sums[piece, lang]})

    rows = chosen.mapInPandas(count, "piece long, lang long, n double").groupBy("piece", "lang").agg(F.sum("n").alias("n")).toPandas()
    counts = np.full((Vocabulary(data).size, len(langs)), _SMOOTHING)
    counts[rows["piece"], rows["lang"]] += rows["n"]
    return langs, np.log(counts / counts.sum(axis=0))


def predict(docs: DataFrame, langs: list[str], logp: np.ndarray, model: str = MODEL) -> DataFrame:
    """Rows ``(doc_id, lang_pred, score)``; the score is the posterior of the prediction."""
    return classified(docs.select("doc_id", "text"), langs, logp, model).drop("text")


def classified(docs: DataFrame, langs: list[str], logp: np.ndarray, model: str = MODEL,
               into: tuple[str, str] = ("lang_pred", "score")) -> DataFrame:
    """Adds predicted language and score to the documents, in columns of the names ``into`` (which are replaced)."""
    data = read_model(model)
    docs = docs.drop(*into)
    names, place = docs.columns, docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = Vocabulary(data)
        known = Numbers()
        values = np.zeros((0, len(langs)))

        def scored(words: list[str]) -> np.ndarray:
            lattice = Lattice.of(words, vocabulary)
            return lattice.totals(lattice.forward(lattice.weights(logp, vocabulary)))

        for batch in batches:
            texts, out, a = [t or "" for t in batch.column(place).to_pylist()], [], 0
            while a < len(texts):
                b, size = a, 0
                while b < len(texts) and (b == a or size + len(texts[b]) <= _SLICE_CHARS):
                    size += len(texts[b])
                    b += 1
                if len(known) > _KEPT_UNITS:
                    known.clear()
                    values = values[:0]
                before = len(known)
                found = [known.of(t) if langs and any(map(str.isalpha, t)) else None for t in texts[a:b]]
                if len(known) > before:
                    values = np.concatenate((values, scored(list(islice(known, before, None)))))
                for f in found:
                    if f is None:
                        out.append((UNDETERMINED, 0.0))
                        continue
                    total = values[f].sum(axis=0)
                    best = int(total.argmax())
                    out.append((langs[best], float(1 / np.exp(total - total[best]).sum())))
                a = b
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array([x[0] for x in out], pa.string()), pa.array([x[1] for x in out], pa.float64())], [*names, *into])

    return docs.mapInArrow(run, T.StructType([*docs.schema.fields, T.StructField(into[0], T.StringType()), T.StructField(into[1], T.DoubleType())]))


def identify(docs: DataFrame, sample: int = SAMPLE, model: str = MODEL) -> DataFrame:
    """Predictions for all documents, learnt from those that are not held out."""
    langs, logp = fit(docs.where(~held_out()), sample, model)
    return predict(docs, langs, logp, model)


def op8_language(spark, sf_dir) -> DataFrame:
    found = identify(table(spark, sf_dir, "documents"))
    return found.select("doc_id", held_out().alias("held_out"), "lang_pred", "score")
