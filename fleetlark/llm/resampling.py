"""Operator 11: importance resampling towards a target distribution, with segment deduplication.

Features of a text are its runs of 1 to ``width`` consecutive words, hashed to buckets. A bucket's gain is the log ratio
of its smoothed share in the target to that in the corpus; a document's weight is the floored mean of its
features' gains. Documents are drawn without replacement by the Gumbel-top-k rule (Xie et al., 2023, for the weights).

1. A newline ends every word, so texts are cut into lines there. Equal lines meet in one aggregation, which combines
   before its shuffle; the features of each distinct line are counted once and multiplied by its occurrences. Runs that cross
   a newline belong to no line and are counted apart, each at the line that holds its last word.
2. Sums by bucket, a list of fixed length, give the gains.
3. A second pass adds up the gains of every document from those of its lines; the distinct lines of a batch are computed once.
4. Ranks come from counts by score: a score is an integer of a bounded range, so no task sorts all rows. Counts
   before a score are added up over bins of scores, and only rows of one and the same score are sorted.

Defined cases: null and empty texts have no features, weight 0, and are too short to be drawn. A row without
doc_id counts for the corpus but has no score and is never drawn. Rows that repeat a doc_id are rows of
their own; where score and doc_id are equal, the one with fewer features comes first. An empty target or corpus
has zero counts. Other columns are not looked at.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fleetlark.llm.common import checkpoint, slices, table, text_or_empty, utf8

BUCKETS = 10_000
# Each byte of a word to itself, A-Z to a-z, every other to a space.
_LETTERS = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))
# Scores added up in one window task.
_BIN = 512


def words_of(line: bytes) -> list[bytes]:
    """Words of UTF-8 bytes, A-Z lower-cased."""
    return line.translate(_LETTERS).split()


def runs(words: list[bytes], width: int) -> list[bytes]:
    """All runs of 1 to ``width`` words, joined by one space."""
    return words + [b" ".join(words[i:i + k]) for k in range(2, width + 1) for i in range(len(words) - k + 1)]


def seams(lines: list[list[bytes]], width: int) -> list[bytes]:
    """The runs that begin in one of the lines and end in a later one."""
    found, tail = [], []
    for words in lines:
        both = tail + words[:width - 1]
        found += [b" ".join(both[i:i + k]) for k in range(2, width + 1) for i in range(max(0, len(tail) - k + 1), len(tail)) if i + k <= len(both)]
        tail = (tail + words)[1 - width:] if width > 1 else []
    return found


def bucketed(groups: list[list[bytes]], buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of all features of some groups of them, and where each group ends."""
    sizes = [len(g) for g in groups]
    hashes = np.fromiter((h for g in groups for h in map(zlib.crc32, g)), np.int64, sum(sizes))
    return hashes % buckets, np.cumsum(sizes, dtype=np.int64)


def _encoded(column: pa.Array) -> list[bytes]:
    return column.cast(pa.large_binary()).to_pylist()


def _pieces(batches: Iterator[pa.RecordBatch], text: int) -> Iterator[pa.RecordBatch]:
    """The batches in pieces of bounded bytes of a text column (or of one row)."""
    for batch in batches:
        for start, stop in slices(utf8(batch.column(text))[1]):
            yield batch.slice(start, stop - start)


def bucket_counts(texts: DataFrame, width: int = 1, buckets: int = BUCKETS) -> np.ndarray:
    """How many features of the texts (column ``text``) fall into each bucket."""
    def of_lines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros(buckets, np.int64)
        for batch in _pieces(batches, 0):
            found, ends = bucketed([runs(words_of(line), width) for line in _encoded(batch.column(0))], buckets)
            np.add.at(sums, found, np.repeat(batch.column(1).to_numpy(), np.diff(ends, prepend=0)))
        yield _nonzero(sums)

    def of_seams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros(buckets, np.int64)
        for batch in _pieces(batches, 0):
            found, _ = bucketed([seams([words_of(line) for line in text.split(b"\n")], width) for text in _encoded(batch.column(0))], buckets)
            np.add.at(sums, found, 1)
        yield _nonzero(sums)

    def _nonzero(sums: np.ndarray) -> pa.RecordBatch:
        some = np.flatnonzero(sums)
        return pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array(sums[some])], ["bucket", "n"])

    texts = texts.where("text IS NOT NULL").select("text")
    lines = texts.select(F.explode(F.split("text", "\n")).alias("line")).where("line != ''").groupBy("line").agg(F.count("*").alias("times"))
    parts = lines.mapInArrow(of_lines, "bucket int, n long")
    if width > 1:
        parts = parts.unionByName(texts.mapInArrow(of_seams, "bucket int, n long"))
    counts = np.zeros(buckets, np.int64)
    for row in parts.groupBy("bucket").agg(F.sum("n").alias("n")).toLocalIterator():
        counts[row["bucket"]] = row["n"]
    return counts


def bucket_gains(corpus: np.ndarray, target: np.ndarray, scale: int = 1000) -> np.ndarray:
    """Floored, scaled log ratio of each bucket's share in the target to that in the corpus."""
    size = len(corpus)
    both, aim = float(corpus.sum() + size), float(target.sum() + size)
    return np.array([math.floor(scale * math.log((t + 1.0) * both / ((s + 1.0) * aim))) for s, t in zip(corpus.tolist(), target.tolist(), strict=True)], np.int64)


def weigh(docs: DataFrame, gains: np.ndarray, width: int = 1) -> DataFrame:
    """Rows ``(doc_id, n_words, n_features, weight)``, one for each row of ``docs``."""
    def added(groups: list[list[bytes]]) -> tuple[np.ndarray, np.ndarray]:
        found, ends = bucketed(groups, len(gains))
        sums = np.concatenate(([0], np.cumsum(gains[found])))[np.concatenate(([0], ends))]
        return np.diff(ends, prepend=0), np.diff(sums)

    def weighed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _pieces(batches, 1):
            texts = [text.split(b"\n") for text in _encoded(batch.column(1))]
            places: dict[bytes, int] = {}
            at = [[places.setdefault(line, len(places)) for line in lines] for lines in texts]
            words = [words_of(line) for line in places]
            sizes = np.array([len(w) for w in words], np.int64)
            features, sums = added([runs(w, width) for w in words])
            total = np.array([[x[k].sum() for x in (sizes, features, sums)] for k in at], np.int64).reshape(-1, 3)
            if width > 1:
                total[:, 1:] += np.stack(added([seams([words[k] for k in lines], width) for lines in at]), axis=1)
            weight = np.where(total[:, 1] > 0, total[:, 2] // np.maximum(total[:, 1], 1), 0)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(total[:, 0]), pa.array(total[:, 1]), pa.array(weight)],
                                             ["doc_id", "n_words", "n_features", "weight"])

    return docs.select(F.col("doc_id").cast("long"), text_or_empty().alias("text")).mapInArrow(
        weighed, "doc_id long, n_words long, n_features long, weight long")


def gumbel(seed: int, scale: int = 1000):
    """Floored, scaled Gumbel noise from a hash of the seed and doc_id."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("doc_id").cast("string")), 256)
    uniform = (F.conv(F.substring(digest, 1, 8), 16, 10).cast("long") + F.lit(0.5)) / F.lit(4294967296.0)
    return F.floor(F.lit(-float(scale)) * F.ln(-F.ln(uniform))).cast("long")


def ranked(rows: DataFrame, draw: int) -> DataFrame:
    """Adds ``rank`` to the ``draw`` rows of highest ``score`` (ties: smaller doc_id) among those with ``may``."""
    scores = rows.where("may").groupBy("score").agg(F.count("*").alias("n")).withColumn("bin", F.floor(F.col("score") / _BIN))
    # bins are few: scores lie in a range of some ten thousands
    bins = scores.groupBy("bin").agg(F.sum("n").alias("n"))
    earlier = lambda window: F.coalesce(F.sum("n").over(window.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    bins = bins.select("bin", earlier(Window.partitionBy(F.lit(0)).orderBy(F.desc("bin"))).alias("ahead"))
    before = (scores.join(bins, "bin").select("score", (F.col("ahead") + earlier(Window.partitionBy("bin").orderBy(F.desc("score")))).alias("before"))
              .where(F.col("before") < draw).withColumnRenamed("score", "at"))
    placed = rows.join(before, F.col("may") & (F.col("score") == F.col("at")), "left").drop("at")
    place = F.col("before") + F.row_number().over(Window.partitionBy("score").orderBy("doc_id", "n_features"))
    return (placed.where("before IS NOT NULL").withColumn("rank", F.when(place <= draw, place))
            .unionByName(placed.where("before IS NULL").withColumn("rank", F.lit(None).cast("long"))).drop("before"))


def importance_resample(docs: DataFrame, target: DataFrame, percent: int = 10, least_words: int = 20, width: int = 1,
                        buckets: int = BUCKETS, seed: int = 2024) -> DataFrame:
    """Rows ``(doc_id, n_features, weight, score, rank)``: of the documents with ``least_words`` the ``percent`` with the highest scores have a rank."""
    gains = bucket_gains(bucket_counts(docs, width, buckets), bucket_counts(target, width, buckets))
    rows = (checkpoint(weigh(docs, gains, width)).withColumn("score", F.col("weight") + gumbel(seed))
            .withColumn("may", (F.col("n_words") >= least_words) & F.col("doc_id").isNotNull()))
    draw = percent * rows.where("may").count() // 100
    return ranked(rows, draw).select("doc_id", "n_features", "weight", "score", "rank")


def op11_resampling(spark, sf_dir) -> DataFrame:
    return importance_resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


# The CRC is taken byte by byte over the distinct words, from a table of its 256 steps.
OP11_SQL = r"""WITH steps AS (SELECT list(list_reduce(list_prepend(i, range(8)), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)
      ORDER BY i) AS step FROM range(256) r(i)),
  texts AS (SELECT 'd' AS side, doc_id, text FROM documents UNION ALL SELECT 'b', NULL, text FROM benchmark),
  words AS (SELECT side, doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
      '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) AS word FROM texts),
  spelt AS (SELECT word, list_transform(range(1, length(hex(encode(word))) // 2 + 1), lambda k: 16 * (instr('0123456789ABCDEF', substr(hex(encode(word)), 2 * k - 1, 1)) - 1)
      + instr('0123456789ABCDEF', substr(hex(encode(word)), 2 * k, 1)) - 1) AS bytes FROM (SELECT DISTINCT word FROM words)),
  hashed AS (SELECT word, xor(list_reduce(list_prepend(4294967295::BIGINT, bytes), lambda c, b: xor(c >> 8, step[(xor(c, b) & 255) + 1])), 4294967295) % 10000 AS bucket
      FROM spelt, steps),
  placed AS (SELECT side, doc_id, bucket FROM words JOIN hashed USING (word)),
  counts AS (SELECT r.bucket, count(*) FILTER (side = 'd') AS s, count(*) FILTER (side = 'b') AS t
      FROM range(10000) r(bucket) LEFT JOIN placed p ON p.bucket = r.bucket GROUP BY 1),
  gains AS (SELECT bucket, floor(1000 * ln((t + 1)::DOUBLE * (sum(s) OVER () + 10000)::DOUBLE / ((s + 1)::DOUBLE * (sum(t) OVER () + 10000)::DOUBLE)))::BIGINT AS gain FROM counts),
  weights AS (SELECT d.doc_id, count(bucket) AS n_features, coalesce(floor(sum(gain)::DOUBLE / count(bucket)), 0)::BIGINT AS weight
      FROM documents d LEFT JOIN (SELECT doc_id, bucket, gain FROM placed JOIN gains USING (bucket) WHERE side = 'd') p ON p.doc_id = d.doc_id GROUP BY d.doc_id),
  draws AS (SELECT doc_id, list_reduce(list_transform(range(1, 9), lambda k: instr('0123456789abcdef', substr(sha256('2024:' || doc_id), k, 1)) - 1),
      lambda a, b: a * 16 + b) AS h FROM documents),
  scores AS (SELECT *, weight + floor(-1000 * ln(-ln((h + 0.5::DOUBLE) / 4294967296::DOUBLE)))::BIGINT AS score FROM weights JOIN draws USING (doc_id)),
  drawn AS (SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS place, count(*) OVER () AS n FROM scores WHERE n_features >= 20)
SELECT s.doc_id, n_features, weight, score, CASE WHEN place <= 10 * n // 100 THEN place END AS rank FROM scores s LEFT JOIN drawn USING (doc_id)"""
