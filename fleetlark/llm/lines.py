"""Operator 4: fuzzy line deduplication by MinHash.

Lines are compared by their sets of ``SHINGLE`` code points (a shorter line is one shingle), after
stripping white space at both ends. Each distinct line gets a signature of ``BANDS * ROWS``
minima in one pass (one-permutation hashing, empty bins filled from others of the line); lines
that agree in a whole band are candidates. With the values below a pair at the threshold is
found with probability 0.99, one at 0.9 with 0.9999. Candidates are verified by exact Jaccard similarity,
in blocks of bounded size, connected components are found by distributed union-find, and of every component
the first line stays (least doc_id, then least line number).

Defined cases: null and empty texts have no lines; blank lines are never compared and always
stay. Rows that repeat doc_id and text are one document and keep the same lines. A null doc_id sorts first.
Other columns are left as they are.
"""

from __future__ import annotations

from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fleetlark.llm.common import checkpoint, components, match_flag, may_match, mix, slices, table, text_or_empty
from fleetlark.llm.ngram_join import BLOCK_SHINGLES, block_links

SHINGLE = 8
BANDS, ROWS = 12, 5
_BINS = BANDS * ROWS
_SLICE_CHARS = 1 << 19
SMALL_BLOCK = 6
_P = 0x9E3779B97F4A7C15


def line_shingles(lines: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all shingles of some lines, and the line of each."""
    lengths = np.array([len(x) for x in lines], np.int64)
    codes = np.frombuffer("".join(lines).encode("utf-32-le"), np.uint32).astype(np.uint64) + np.uint64(1)
    starts = np.concatenate(([0], np.cumsum(lengths)[:-1])) if len(lines) else np.zeros(0, np.int64)
    owner = np.repeat(np.arange(len(lines)), lengths)
    hashes, width = codes, 1
    while width < SHINGLE:  # windows of twice the width from two neighbours
        hashes = hashes[:-width] * np.uint64(pow(_P, width, 1 << 64)) + hashes[width:] if len(hashes) > width else hashes[:0]
        width *= 2
    within = np.flatnonzero(owner[:len(hashes)] == owner[SHINGLE - 1:SHINGLE - 1 + len(hashes)]) if len(hashes) else np.zeros(0, np.int64)
    values, rows = mix(hashes[within]), owner[within]
    short = np.flatnonzero(lengths < SHINGLE)
    if len(short):
        whole = np.array([xxhash.xxh3_64_intdigest(lines[k].encode()) for k in short], np.uint64)
        values, rows = np.concatenate((values, whole)), np.concatenate((rows, short))
    return values, rows


def band_keys(lines: list[str]) -> np.ndarray:
    """One key for each line and band."""
    values, rows = line_shingles(lines)
    empty = np.uint64(0xFFFFFFFFFFFFFFFF)
    bins = ((values >> np.uint64(32)) * np.uint64(_BINS) >> np.uint64(32)).astype(np.int64)
    minima = np.full(len(lines) * _BINS, empty)
    np.minimum.at(minima, rows * _BINS + bins, mix(values + np.uint64(1)))
    minima = minima.reshape(len(lines), _BINS)
    filled = minima.copy()
    todo, step = np.nonzero(minima == empty), 0
    while len(todo[0]):  # an empty bin takes the value of the first full one on a path of its own
        step += 1
        source = (mix(todo[1].astype(np.uint64) * np.uint64(1 << 20) + np.uint64(step)) % np.uint64(_BINS)).astype(np.int64)
        found = minima[todo[0], source]
        filled[todo] = np.where(found == empty, empty, found + np.uint64(step))
        left = found == empty
        todo = todo[0][left], todo[1][left]
    keys = np.full((len(lines), BANDS), np.uint64(0))
    for r in range(ROWS):
        keys = mix(keys * np.uint64(_P) + filled[:, r::ROWS])
    return mix(keys + np.arange(BANDS, dtype=np.uint64)).view(np.int64)


def _whole_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Rows sorted by block, regrouped so that no block is cut: a task holds one block and one batch."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not len(batch):
            continue
        block = batch["block"].to_numpy()
        if held and block[0] != held[-1]["block"][-1].as_py():
            yield pa.Table.from_batches(held)
            held = []
        last = int(np.searchsorted(block, block[-1]))
        if last:
            yield pa.Table.from_batches([*held, batch.slice(0, last)])
            held = []
        held.append(batch.slice(last))
    if held:
        yield pa.Table.from_batches(held)


def links_of_blocks(ids: np.ndarray, lines: list[str], starts: np.ndarray, t: Fraction) -> tuple[np.ndarray, np.ndarray]:
    """Links among the lines of each of some blocks, which begin and end at ``starts``. Most blocks have a few lines: the pairs of
    those of up to ``SMALL_BLOCK`` lines are compared all at once, and only larger ones are searched one by one."""
    ids, first, at = np.unique(ids, return_index=True, return_inverse=True)
    values, owner = line_shingles([lines[k] for k in first])
    order = np.lexsort((values, owner))
    values, owner = values[order], owner[order]
    fresh = np.concatenate(([True], (values[1:] != values[:-1]) | (owner[1:] != owner[:-1])))
    values, owner = values[fresh], owner[fresh]
    begin = np.searchsorted(owner, np.arange(len(ids) + 1))
    counts, links = np.diff(starts), []
    for k in np.flatnonzero(counts > SMALL_BLOCK):
        who = at[starts[k]:starts[k + 1]]
        links += block_links(ids[who].tolist(), [values[begin[i]:begin[i + 1]] for i in who], t)
    pairs = [np.zeros((2, 0), np.int64)]
    for m in range(2, SMALL_BLOCK + 1):
        who = at[starts[:-1][counts == m][:, None] + np.arange(m)]
        pairs.append(np.stack([who[:, side].ravel() for side in np.triu_indices(m, 1)]))
    pairs = np.unique(np.sort(np.concatenate(pairs, axis=1), axis=0), axis=1)
    sizes = np.diff(begin)
    small, large = np.take_along_axis(pairs, np.argsort(sizes[pairs], axis=0, kind="stable"), axis=0)
    near = (small != large) & (sizes[small] * t.denominator >= sizes[large] * t.numerator)
    small, large = small[near], large[near]
    # Shingles of the smaller line are looked up among those of the larger one, all pairs together.
    distinct, token = np.unique(values, return_inverse=True)
    places = owner * len(distinct) + token
    n = sizes[small]
    asked = np.repeat(begin[small] - np.cumsum(n) + n, n) + np.arange(n.sum())
    wanted = np.repeat(large, n) * len(distinct) + token[asked]
    hits = places[np.minimum(np.searchsorted(places, wanted), len(places) - 1)] == wanted
    common = np.bincount(np.repeat(np.arange(len(n)), n)[hits], minlength=len(n))
    linked = common * t.denominator >= (n + sizes[large] - common) * t.numerator
    a, b = np.array(links, np.int64).reshape(-1, 2).T
    return np.concatenate((a, ids[small[linked]])), np.concatenate((b, ids[large[linked]]))


def line_hash(line: str) -> int:
    return xxhash.xxh3_64_intdigest(line.encode()) - (1 << 63)


def _hashed(docs: DataFrame) -> DataFrame:
    """Per document its lines' hashes and lengths (null and 0 for blank lines), in order."""
    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for text in batch.column(2).to_pylist():
                lines = [x.strip() for x in text.split("\n")] if text else []
                rows.append(([line_hash(x) if x else None for x in lines], [len(x) for x in lines]))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array([r[0] for r in rows], pa.list_(pa.int64())), pa.array([r[1] for r in rows], pa.list_(pa.int32()))],
                ["doc_id", "text_hash", "lines", "chars"])

    return docs.mapInArrow(hashed, "doc_id long, text_hash long, lines array<long>, chars array<int>")


def _banded(docs: DataFrame) -> DataFrame:
    """Rows ``(key, line)``: lines that occur again in a task's batch of texts come once."""
    def banded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            distinct = {line: None for text in batch.column(0).to_pylist() for part in text.split("\n") if (line := part.strip())}
            lines, size = [], 0
            for line in [*distinct, None]:
                if line is None or size + len(line) > _SLICE_CHARS:
                    if lines:
                        ids = np.array([line_hash(x) for x in lines], np.int64)
                        yield pa.RecordBatch.from_arrays([pa.array(band_keys(lines).ravel()), pa.array(np.repeat(ids, BANDS))], ["key", "line"])
                    lines, size = [], 0
                if line is not None:
                    lines.append(line)
                    size += len(line)

    return docs.select("text").mapInArrow(banded, "key long, line long")


def _keyed(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long"), F.xxhash64(text_or_empty()).alias("text_hash"), text_or_empty().alias("text"))


def similar_lines(docs: DataFrame, threshold: float | str = "0.8") -> tuple[DataFrame, DataFrame]:
    """Lines by document (see _hashed, checkpointed), and components of their hashes."""
    t, docs = Fraction(str(threshold)), _keyed(docs)
    hashed = checkpoint(_hashed(docs))
    whole = Window.partitionBy("key")
    # Rows of two numbers, of a hot key too: the window reads them sorted and spills.
    # A line that many batches have comes once with each of them, until the keys of one line are gone.
    shared = (_banded(docs).withColumns({"low": F.min("line").over(whole), "high": F.max("line").over(whole)})
              .where("low < high").select("key", "line").distinct())
    shared = checkpoint(shared)
    who = F.xxhash64("line")
    groups = (shared.groupBy("key").agg(F.count("*").alias("size"), F.bit_xor(who).alias("x"), F.sum(F.shiftright(who, 24)).alias("y"))
              .groupBy("size", "x", "y").agg(F.min("key").alias("key")).select("key"))
    members = shared.join(groups, "key")
    wanted = members.select("line").distinct()
    places = (hashed.select("doc_id", "text_hash", F.posexplode(F.arrays_zip("lines", "chars")).alias("no", "at"))
              .select("doc_id", "text_hash", "no", F.col("at.lines").alias("line"), F.col("at.chars").alias("chars")))
    firsts = (may_match(places, "line", wanted, "line").join(wanted, "line")
              .groupBy("line").agg(F.min(F.struct("text_hash", "no", "doc_id", "chars")).alias("at")).select("line", "at.*"))
    firsts = checkpoint(firsts)
    sizes = (members.join(firsts, "line").groupBy("key").agg(F.sum("chars").alias("total"))
             .select("key", F.ceil(F.col("total") / BLOCK_SHINGLES).cast("int").alias("parts")))
    part = F.pmod(who, F.col("parts")).cast("int")
    blocks = (members.join(sizes, "key").select("key", "line", part.alias("part"), F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("other"))
              .select("line", F.xxhash64("key", F.least("part", "other"), F.greatest("part", "other")).alias("block")))
    # texts come once for each document, and leave it as the lines asked for
    asked = firsts.groupBy("text_hash").agg(F.collect_list("no").alias("nos"), F.collect_list("line").alias("names"))

    @F.pandas_udf("array<string>")
    def picked(texts: pd.Series, nos: pd.Series) -> pd.Series:
        def pick(text: str, wanted: np.ndarray) -> list[str]:
            lines = text.split("\n")
            return [lines[k] for k in wanted]
        return pd.Series([pick(t, w) for t, w in zip(texts, nos, strict=True)])

    texts = (may_match(docs.select("text_hash", "text"), "text_hash", firsts, "text_hash").dropDuplicates(["text_hash"]).join(asked, "text_hash")
             .select(F.explode(F.arrays_zip(F.col("names"), picked("text", "nos").alias("content"))).alias("one"))
             .select(F.col("one.names").alias("line"), F.col("one.content").alias("content")))

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in _whole_blocks(batches):
            block, lines = rows["block"].to_numpy(), [x.strip() for x in rows["content"].to_pylist()]
            starts = np.concatenate(([0], np.flatnonzero(block[1:] != block[:-1]) + 1, [len(block)]))
            chars = np.concatenate(([0], np.cumsum([len(x) for x in lines])))
            for a, b in slices(chars[starts], _SLICE_CHARS):
                low, high = starts[a], starts[b]
                found = links_of_blocks(rows["line"].to_numpy()[low:high], lines[low:high], starts[a:b + 1] - low, t)
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in found], ["a", "b"])

    links = blocks.join(texts, "line").repartition("block").sortWithinPartitions("block").mapInArrow(search, "a long, b long")
    return hashed, components(links)


def line_decisions(docs: DataFrame, threshold: float | str = "0.8") -> DataFrame:
    """Per document ``(doc_id, text_hash, n_lines, dropped)``: how many lines that are not blank
    it has, and the numbers (from 0, blank lines counted) of those that go."""
    hashed, found = similar_lines(docs, threshold)
    lines = (hashed.dropDuplicates(["doc_id", "text_hash"]).select("doc_id", "text_hash", F.posexplode("lines").alias("no", "line")).where("line IS NOT NULL")
             .join(found.withColumnRenamed("id", "line"), "line", "left").select("doc_id", "text_hash", "no", F.coalesce("component", "line").alias("line")))
    at = F.struct("doc_id", "no", "text_hash")
    firsts = lines.groupBy("line").agg(F.min(at).alias("first"), F.count("*").alias("times")).where("times > 1")
    dropped = (lines.join(firsts, "line").where(at != F.col("first"))
               .groupBy("doc_id", "text_hash").agg(F.sort_array(F.collect_list("no")).alias("dropped")))
    return (hashed.select("doc_id", "text_hash", F.size(F.array_compact("lines")).cast("long").alias("n_lines")).alias("h")
            .join(dropped.alias("d"), F.col("h.doc_id").eqNullSafe(F.col("d.doc_id")) & (F.col("h.text_hash") == F.col("d.text_hash")), "left")
            .select("h.doc_id", "h.text_hash", "n_lines", F.coalesce("dropped", F.array().cast("array<int>")).alias("dropped")))


def dedup_lines(docs: DataFrame, threshold: float | str = "0.8", drop_emptied: bool = True) -> DataFrame:
    """The documents with the lines that go taken out of ``text`` and ``n_chars`` set anew, where there is
    such a column. ``drop_emptied`` leaves out documents of which no line with content stays; those
    without content from the start stay."""
    decided = checkpoint(line_decisions(docs, threshold).where("size(dropped) > 0").dropDuplicates(["doc_id", "text_hash"]))

    @F.pandas_udf("string")
    def without(texts: pd.Series, dropped: pd.Series) -> pd.Series:
        out = []
        for text, gone in zip(texts, dropped, strict=True):
            gone = set(gone.tolist())
            out.append("\n".join(x for k, x in enumerate(text.split("\n")) if k not in gone))
        return pd.Series(out)

    # A row travels as one struct, so that its columns may have any names.
    hashed = F.xxhash64(text_or_empty())
    flagged = docs.select(F.struct(*docs.columns).alias("row"), hashed.alias("text_hash"), match_flag(hashed, decided, "text_hash").alias("touched"))
    moved = (flagged.where("touched").alias("f")
             .join(decided.alias("d"), F.col("f.row.doc_id").cast("long").eqNullSafe(F.col("d.doc_id")) & (F.col("f.text_hash") == F.col("d.text_hash")), "left"))
    if drop_emptied:
        moved = moved.where("d.dropped IS NULL OR size(d.dropped) < d.n_lines")
    changed = F.col("d.dropped").isNotNull()
    content = F.when(changed, without("f.row.text", F.coalesce("d.dropped", F.array().cast("array<int>")))).otherwise(F.col("f.row.text"))
    moved = moved.select("f.row", content.alias("content"), changed.alias("changed"))
    cleaned = {"text": F.col("content")}
    if "n_chars" in docs.columns:
        kind = docs.schema["n_chars"].dataType
        cleaned["n_chars"] = F.when(F.col("changed"), F.length("content").cast(kind)).otherwise(F.col("row.n_chars"))
    moved = moved.select(*[cleaned.get(c, F.col("row")[c]).alias(c) for c in docs.columns])
    return flagged.where("NOT touched").select("row.*").unionByName(moved)


def op4_line_dedup(spark, sf_dir) -> DataFrame:
    return line_decisions(table(spark, sf_dir, "documents")).select(
        "doc_id", "n_lines", F.size("dropped").cast("long").alias("n_dropped"), F.array_join("dropped", ",").alias("dropped"))
