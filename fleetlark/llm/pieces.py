"""Operator 2: sampled SentencePiece encoding, and decoding.

A segmentation is drawn from all that the vocabulary allows, each with probability in proportion to the product of
its pieces' prior probabilities (see lattice.Vocabulary): sums run forward over the lattice, and pieces are drawn
backward from the end of each unit. The draws are hashes of seed, row key, place of the unit
in the text and step, so a row gets the same segmentation wherever and with whatever other rows
it is processed. Decoding returns every text exactly.

Defined cases: null and empty texts have no tokens, and decode to the empty text. Rows with equal key and text get equal
tokens; a null key is a key of its own. Other columns are left as they are.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import islice

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fleetlark.llm.common import mix, table, text_or_empty
from fleetlark.llm.lattice import MODEL, Lattice, Numbers, Vocabulary, piece_bytes, read_model, spell, spelt, units

# Texts are worked on in runs of about so many code points; a run may end within a text.
_SLICE_CHARS = 1 << 17
# Lattices are kept up to this size, units' names included.
_KEPT_BYTES = 64 << 20
_UNIT_BYTES = 200
_ONE = 1 << 36


class Grown:
    """An array that grows by doubling."""

    def __init__(self, kind: type):
        self.room, self.size = np.zeros(1024, kind), 0

    def add(self, more: np.ndarray) -> None:
        end = self.size + len(more)
        if end > len(self.room):
            room = np.zeros(max(end, 2 * len(self.room)), self.room.dtype)
            room[:self.size] = self.room[:self.size]
            self.room = room
        self.room[self.size:end] = more
        self.size = end

    @property
    def values(self) -> np.ndarray:
        return self.room[:self.size]


class Sampler:
    """Draws segmentations. Keeps the lattices of units it has met, as edges sorted by the state they end in,
    up to ``_KEPT_BYTES``.

    Shares of edges are whole numbers of 1 / ``_ONE``, so that their running sums are exact and
    a unit's draws do not depend on what was met before it."""

    def __init__(self, vocabulary: Vocabulary, alpha: float = 1.0):
        self.vocabulary, self.alpha = vocabulary, alpha
        self._forget()

    def _forget(self) -> None:
        self.known = Numbers()
        self.upto = Grown(np.int64)
        self.upto.add(np.zeros(1, np.int64))
        self.source, self.piece, self.low, self.high, self.base, self.length = (Grown(np.int32) for _ in range(6))

    @property
    def nbytes(self) -> int:
        arrays = (self.upto, self.source, self.piece, self.low, self.high, self.base, self.length)
        return sum(x.room.nbytes for x in arrays) + _UNIT_BYTES * len(self.known)

    def _learn(self, words: list[str]) -> None:
        lattice = Lattice.of(words, self.vocabulary)
        weights = lattice.weights(self.vocabulary.prior * self.alpha, self.vocabulary)
        sums = lattice.forward(weights)
        share = np.rint(np.exp(sums[lattice.source] + weights - sums[lattice.target]) * _ONE).astype(np.int64)
        # edges into a state lie together: where they start and end
        low, high = np.zeros(len(sums), np.int64), np.zeros(len(sums), np.int64)
        first = np.flatnonzero(np.concatenate(([True], lattice.target[1:] != lattice.target[:-1])))
        low[lattice.target[first]] = first
        high[lattice.target[first]] = np.concatenate((first[1:], [len(share)]))
        states, edges = self.low.size, self.source.size
        self.upto.add(self.upto.values[-1] + np.cumsum(share))
        self.source.add(lattice.source + states)
        self.piece.add(lattice.piece)
        self.low.add(low + edges)
        self.high.add(high + edges)
        self.base.add(lattice.base + states)
        self.length.add(lattice.lengths)

    def sample(self, texts: list[str], keys: np.ndarray) -> list[np.ndarray]:
        """Token ids of every text; keys are 64-bit hashes of the rows' keys."""
        words, counts = [], []
        for text in texts:
            found = units(text)
            counts.append(len(found))
            words += found
        counts = np.array(counts, np.int64)
        place = np.arange(len(words)) - np.repeat(np.cumsum(counts) - counts, counts)
        seed = mix(np.repeat(keys, counts) ^ mix(place.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)))
        row = np.repeat(np.arange(len(texts)), counts)
        size = np.cumsum(np.fromiter(map(len, words), np.int64, len(words))) // _SLICE_CHARS
        cuts = [0, *(np.flatnonzero(size[1:] != size[:-1]) + 1).tolist(), len(words)]
        ids, rows = [np.zeros(0, np.int32)], [np.zeros(0, np.int32)]
        for a, b in zip(cuts, cuts[1:], strict=False):
            drawn, owner = self._draw(words[a:b], seed[a:b], row[a:b])
            ids.append(drawn.astype(np.int32))
            rows.append(owner.astype(np.int32))
        return np.split(np.concatenate(ids), np.searchsorted(np.concatenate(rows), np.arange(1, len(texts))))

    def _draw(self, words: list[str], seed: np.ndarray, row: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Token ids of some units in order, and the row of each."""
        if self.nbytes > _KEPT_BYTES:
            self._forget()
        before = len(self.known)
        unit = np.fromiter(map(self.known.__getitem__, words), np.int64, len(words))
        if len(self.known) > before:
            self._learn(list(islice(self.known, before, None)))
        upto, low, high, base = self.upto.values, self.low.values, self.high.values, self.base.values
        state, active, steps = base[unit] + self.length.values[unit], np.arange(len(unit)), []
        while len(active):
            draw = (mix(seed[active] + np.uint64(len(steps))) >> np.uint64(11)).astype(np.float64) * 2.0 ** -53
            edge = low[state]
            target = upto[edge] + (draw * (upto[high[state]] - upto[edge])).astype(np.int64)
            further = np.flatnonzero(upto[edge + 1] <= target)  # few edges end in a state
            while len(further):
                edge[further] += 1
                further = further[upto[edge[further] + 1] <= target[further]]
            steps.append((active, self.piece.values[edge]))
            state = self.source.values[edge]
            going = state != base[unit[active]]
            active, state = active[going], state[going]
        tokens = np.zeros(len(unit), np.int64)
        for at, _ in steps:
            tokens[at] += 1
        ends = np.cumsum(tokens)
        ids = np.zeros(int(tokens.sum()), np.int64)
        for k, (at, piece) in enumerate(steps):
            ids[ends[at] - 1 - k] = piece
        row = np.repeat(row, tokens)
        return self._spell(ids, row) if (ids < 0).any() else (ids, row)

    def _spell(self, ids: np.ndarray, row: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        rare = np.flatnonzero(ids < 0)
        values, which = np.unique(ids[rare], return_inverse=True)
        spellings = [spelt(self.vocabulary, -1 - value) for value in values.tolist()]
        width = np.ones(len(ids), np.int64)
        width[rare] = np.array([len(x) for x in spellings])[which]
        first = np.array([len(x) for x in spellings]).cumsum() - [len(x) for x in spellings]
        at = np.cumsum(width) - width
        out = np.repeat(ids, width)
        byte = np.arange(int(width[rare].sum())) - np.repeat(np.cumsum(width[rare]) - width[rare], width[rare])
        out[np.repeat(at[rare], width[rare]) + byte] = np.concatenate(spellings)[np.repeat(first[which], width[rare]) + byte]
        return out, np.repeat(row, width)


def free_name(columns: list[str], wish: str) -> str:
    while wish in columns:
        wish = "_" + wish
    return wish


def encode(docs: DataFrame, key: str = "doc_id", seed: int = 0, alpha: float = 1.0, model: str = MODEL,
           decoded: str | None = None) -> DataFrame:
    """Adds ``tokens`` (an array of ids) to the documents, and with ``decoded`` a column of that name with the text that
    they spell; columns of these names are replaced."""
    data = read_model(model)
    added = ["tokens", *([decoded] if decoded else [])]
    rest = [c for c in docs.columns if c not in added]
    sources = docs.select(*rest).withColumns({(hashed := free_name(rest, "_key")): F.xxhash64(F.lit(seed), F.col(key).cast("string"), F.col(key).isNull())})
    at = rest.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = Vocabulary(data)
        sampler = Sampler(vocabulary, alpha)
        for whole in batches:
            size = np.cumsum(pc.fill_null(pc.utf8_length(whole.column(at)), 0).to_numpy(zero_copy_only=False), dtype=np.int64) // _SLICE_CHARS
            cuts = [0, *(np.flatnonzero(size[1:] != size[:-1]) + 1).tolist(), len(size)]
            for a, b in zip(cuts, cuts[1:], strict=False):
                batch = whole.slice(a, b - a)
                texts = [t or "" for t in batch.column(at).to_pylist()]
                out = sampler.sample(texts, batch.column(len(rest)).to_numpy(zero_copy_only=False).view(np.uint64)) if texts else []
                ends = np.cumsum([0, *map(len, out)], dtype=np.int32)
                more = [pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate([np.zeros(0, np.int32), *out])))]
                if decoded:
                    more.append(pa.array([spell(vocabulary.bytes, x.tolist()) for x in out], pa.string()))
                yield pa.RecordBatch.from_arrays([*batch.columns[:len(rest)], *more], [*rest, *added])

    schema = docs.select(*rest).schema.add("tokens", T.ArrayType(T.IntegerType()))
    return sources.select(*rest, hashed).mapInArrow(run, schema.add(decoded, T.StringType()) if decoded else schema)


def decode(rows: DataFrame, tokens: str = "tokens", into: str = "decoded", model: str = MODEL) -> DataFrame:
    """Adds the text that the tokens spell."""
    data = read_model(model)

    @F.pandas_udf("string")
    def spelt_out(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        table = piece_bytes(data)
        for arrays in batches:
            yield arrays.map(lambda ids: "" if ids is None else spell(table, ids.tolist()))

    return rows.withColumn(into, spelt_out(tokens))


def op2_pieces(spark, sf_dir) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", text_or_empty().alias("text"))
    return encode(docs, decoded="decoded").select("doc_id", F.size("tokens").cast("long").alias("n_tokens"), F.xxhash64("tokens").alias("tokens_hash"),
                                       (F.col("decoded") == F.col("text")).alias("lossless"))
