"""Operator 7: n-gram Jaccard join by T-occurrence search (DivideSkip).

Documents link when the Jaccard similarity of their sets of distinct word shingles reaches a
threshold; the join returns every document's set size and the smallest id reachable by links.

1. Documents of equal sets form a class; its smallest id stands for it from here on.
2. A set of ``n`` hashes has its ``L(n)`` smallest as keys, a fixed share of ``n``, and keeps the ``R(n) = floor(n / t) - n + 1``
   of them that fewest documents have, counted exactly. Linked sets share a kept key: let the larger one, by ``d``, lack
   ``a`` hashes in the other, which lacks ``a - d``; ``a`` is below both R. The i-th common hash has at most ranks ``i + a`` and
   ``i + a - d``, and L grows by no more than n does, so at most ``a`` keys of either are not keys of both, and the
   rarest common key is among the ``a + 1`` rarest of each. Documents that merely have passages in common share frequent keys only.
   This is done twice, with few keys for all documents and with more for those that then share one.
3. Documents that share a key form a block; blocks of over ``BLOCK_SHINGLES`` shingles are cut
   into parts, and each pair of parts is a block of its own, so no task takes a large group.
   In a block a document searches an inverted index by DivideSkip: the short lists are
   merged, the long ones probed by bisection, and those that reach the required overlap are kept. Searches end
   as soon as all documents not yet searched hang together. A block returns a spanning forest, never all pairs.
4. Documents that hang together through kept keys are searched together, unless so many that the pairs of parts would hold more
   copies of them than their keys do. Such clusters are searched by key: first each
   document under the most frequent key it keeps, then under every key whose documents still lie in
   different components, so that no link between components is missed.

Defined cases: null and empty texts, and texts without words, have an empty set and are linked
with nothing; rows of equal text, and rows that repeat a doc_id, share one class; a null doc_id
is linked with nothing and is its own (null) component. Other columns are not looked at.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fleetlark.llm.common import checkpoint, components, may_match, mix, table, text_or_empty, utf8
from fleetlark.llm.shingles import shingle_sets

BLOCK_SHINGLES = 600_000
# Weight of a probe against a merge step in DivideSkip's choice of long lists.
_MU = 5.0
# Keys of a set as a share of its hashes: so many times 1/t - 1 at first, then at least MORE_KEYS (and 2 times 1/t - 1).
FIRST_KEYS, MORE_KEYS = Fraction(3, 2), Fraction(2, 5)


def _signatures(docs: DataFrame, width: int, share: Fraction) -> DataFrame:
    """Per document: set size, a 128-bit digest of the set, and this share of its hashes, the smallest."""
    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, first, second, keys_of = [], [], [], [np.zeros(0, np.int64)]
            for keys in shingle_sets(*utf8(batch.column(1)), width):
                n = len(keys)
                sizes.append(n)
                first.append(int(keys.sum(dtype=np.uint64).astype(np.int64)))
                second.append(int(mix(keys + np.uint64(n)).sum(dtype=np.uint64).astype(np.int64)))
                keys_of.append(keys[:_ceil(min(Fraction(1), share) * n)].view(np.int64))
            ends = np.cumsum([len(x) for x in keys_of], dtype=np.int32)
            lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(keys_of)))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(sizes, pa.int64()), pa.array(first, pa.int64()), pa.array(second, pa.int64()), lists],
                ["doc_id", "n_shingles", "set_a", "set_b", "keys"])

    return docs.select(F.col("doc_id").cast("long"), text_or_empty().alias("text")).mapInArrow(
        sign, "doc_id long, n_shingles long, set_a long, set_b long, keys array<long>")


def _ceil(x: Fraction) -> int:
    return -(-x.numerator // x.denominator)


def t_occurrence(lists: list, least: int) -> list[tuple[int, int]]:
    """Numbers (not negative) that occur in at least ``least`` of the sorted lists, with how often they do."""
    sizes = np.array([len(x) for x in lists], np.int64)
    ends = np.cumsum(sizes)
    found, counts = occurring(np.concatenate([np.asarray(x, np.int64) for x in lists]), ends - sizes, sizes, least)
    return list(zip(found.tolist(), counts.tolist(), strict=True))


def occurring(flat: np.ndarray, starts: np.ndarray, sizes: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
    """The same of lists that lie in one array.

    The longest lists are set aside; what occurs often enough in the others, merged, is looked up in each long one by
    bisection, and dropped once the lists left cannot make up what it lacks. (The merge adds up occurrences of all short lists at
    once. A heap over them gives the same counts one element at a time.)"""
    none = np.zeros(0, np.int64)
    if len(sizes) < least or not len(sizes):
        return none, none
    n_long = max(0, min(least - 1, int(least / (_MU * math.log2(max(2, sizes.max())) + 1))))
    order = np.argsort(sizes, kind="stable")
    short, long = order[:len(order) - n_long], order[len(order) - n_long:][::-1]
    lengths = sizes[short]
    before = np.cumsum(lengths) - lengths
    merged = flat[np.repeat(starts[short] - before, lengths) + np.arange(lengths.sum())]
    counts = np.bincount(merged)
    found = np.flatnonzero(counts >= least - n_long)
    counts = counts[found]
    for left, k in zip(range(n_long, 0, -1), long.tolist(), strict=True):
        may = counts + left >= least
        found, counts = found[may], counts[may]
        if not len(found):
            return none, none
        x = flat[starts[k]:starts[k] + sizes[k]]
        at = np.searchsorted(x, found)
        counts = counts + (x[np.minimum(at, len(x) - 1)] == found)
    enough = counts >= least
    return found[enough], counts[enough]


def block_links(ids: list[int], sets: list[np.ndarray], t: Fraction) -> list[tuple[int, int]]:
    """A spanning forest of the links among some documents.

    A search finds all links of one document. Two documents of different components need no search if one of them has
    been searched, so searches go on only until all documents not yet searched hang together: a dense group is settled by a
    few of its members. Those whose shingles most others share go first, as they link most; members of
    the component with the most documents left wait.
    """
    order = sorted(range(len(ids)), key=lambda i: (len(sets[i]), ids[i]))
    ids, sets = [ids[i] for i in order], [sets[i] for i in order]
    n, sizes = len(ids), np.array([len(x) for x in sets], np.int64)
    if n < 2:
        return []
    owner = np.repeat(np.arange(n), sizes)
    _, token, df = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    index, begin = owner[np.argsort(token, kind="stable")], np.cumsum(df) - df  # documents of each shingle, ascending
    at = np.concatenate(([0], np.cumsum(sizes)))
    shared = np.bincount(owner, weights=df[token], minlength=n) / np.maximum(sizes, 1)
    root, links = np.arange(n), []

    def search(q: int) -> None:
        size = int(sizes[q])
        low, high = np.searchsorted(sizes, [_ceil(t * size), size * t.denominator // t.numerator + 1])
        least = max(1, _ceil(t * (size + _ceil(t * size)) / (1 + t)))
        lists = token[at[q]:at[q + 1]]
        lists = lists[df[lists] > 1]
        for x, common in zip(*(v.tolist() for v in occurring(index, begin[lists], df[lists], least)), strict=True):
            if low <= x < high and root[x] != root[q] and common * t.denominator >= t.numerator * (size + int(sizes[x]) - common):
                links.append((ids[q], ids[x]))
                root[root == root[x]] = root[q]

    waiting = np.lexsort((np.arange(n), -shared))
    while len(waiting) > 1 and (root[waiting] != root[waiting[0]]).any():
        later = []
        for place, q in enumerate(waiting.tolist()):
            left = np.concatenate((np.array(later, np.int64), waiting[place:]))
            groups = np.bincount(root[left], minlength=n)
            if groups[root[q]] == len(left):
                return links
            if groups[root[q]] > 1 and root[q] == groups.argmax():  # one group only, so that every pass searches
                later.append(q)
            else:
                search(q)
        waiting = np.array(later, np.int64)
    return links


def _search(docs: DataFrame, postings: DataFrame, width: int, t: Fraction) -> DataFrame:
    """Links found among the documents of each key. postings: ``(key, doc_id, n)``. Of keys that
    the same documents have (known by count and two hashes) one is searched."""
    who = F.xxhash64("doc_id")
    lists = postings.groupBy("key").agg(F.sum("n").alias("total"), F.count("*").alias("size"), F.bit_xor(who).alias("x"),
                                        F.sum(F.shiftright(who, 24)).alias("y"))
    sizes = (lists.groupBy("size", "total", "x", "y").agg(F.min("key").alias("key"))
             .select("key", F.ceil(F.col("total") / BLOCK_SHINGLES).cast("int").alias("parts")))
    part = F.pmod(F.xxhash64("doc_id"), F.col("parts")).cast("int")
    others = F.explode(F.sequence(F.lit(0), F.col("parts") - 1))
    blocks = (postings.join(sizes, "key").select("key", "doc_id", part.alias("part"), others.alias("other"))
              .select("doc_id", F.xxhash64("key", F.least("part", "other"), F.greatest("part", "other")).alias("block")))
    texts = may_match(docs.select("doc_id", text_or_empty().alias("text")), "doc_id", postings, "doc_id")

    def search(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.drop_duplicates(["doc_id", "text"])
        sets = list(shingle_sets(*utf8(pa.array(rows["text"], pa.large_string())), width))
        return pd.DataFrame(block_links(rows["doc_id"].tolist(), sets, t), columns=["a", "b"])

    return blocks.join(texts, "doc_id").groupBy("block").applyInPandas(search, "a long, b long")


def _shared_keys(signed: DataFrame, t: Fraction) -> DataFrame:
    """Rows ``(key, df, doc_id, n)`` of the keys that a document keeps and shares with another.
    A doc_id of several texts takes part with each of them."""
    keys = (signed.dropDuplicates(["doc_id", "set_a", "set_b"])
            .select("doc_id", F.col("n_shingles").alias("n"), "set_a", F.size("keys").alias("n_keys"), F.explode("keys").alias("key")))
    # Counted where the rows of a key lie, so that keys are moved once. The sort of the window spills.
    shared = keys.withColumn("df", F.count("*").over(Window.partitionBy("key"))).where("df > 1")
    # Keys that no other document has are the rarest; they take the first ranks without being moved.
    of_one = Window.partitionBy("doc_id", "n", "set_a")
    rank = F.col("n_keys") - F.count("*").over(of_one) + F.row_number().over(of_one.orderBy("df", "key"))
    most = F.expr(f"n * {t.denominator} DIV {t.numerator} - n + 1")
    return shared.withColumn("rank", rank).where(F.col("rank") <= most).select("key", "df", "doc_id", "n")


def _by_cluster(postings: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Postings under one key for all that hang together through keys, where cutting that into blocks copies documents
    less often than searching under each key does, and the postings of other clusters as they are."""
    first = postings.groupBy("key").agg(F.min("doc_id").alias("b"))
    clusters = components(postings.join(first, "key").select(F.col("doc_id").alias("a"), "b"))
    placed = postings.join(clusters.withColumnRenamed("id", "doc_id"), "doc_id")
    whole = placed.groupBy("component", "doc_id", "n").agg(F.count("*").alias("n_keys"))
    copies = F.ceil(F.sum("n") / BLOCK_SHINGLES) * F.count("*")
    fits = checkpoint(whole.groupBy("component").agg((copies <= F.sum("n_keys")).alias("fits")))
    small = whole.join(fits.where("fits"), "component").select(F.xxhash64(F.lit("cluster"), "component").alias("key"), "doc_id", "n")
    return small, placed.join(fits.where("NOT fits"), "component").select("key", "df", "doc_id", "n")


def ngram_jaccard_join(docs: DataFrame, threshold: float | str = "0.9", width: int = 3) -> DataFrame:
    """Rows ``(doc_id, n_shingles, component_id)``, one for each row of ``docs``."""
    t = Fraction(str(threshold))
    if not 0 < t <= 1:
        raise ValueError("the threshold must lie above 0 and not above 1")
    docs = docs.select(F.col("doc_id").cast("long"), "text")
    fewest = 1 / t - 1
    signed = checkpoint(_signatures(docs, width, FIRST_KEYS * fewest))
    filled = signed.where("n_shingles > 0 AND doc_id IS NOT NULL")
    classes = filled.groupBy("n_shingles", "set_a", "set_b").agg(F.min("doc_id").alias("rep"))
    near = checkpoint(_shared_keys(filled.join(classes.select(F.col("rep").alias("doc_id")), "doc_id", "leftsemi"), t).select("doc_id").distinct())
    again = _signatures(may_match(docs, "doc_id", near, "doc_id").join(near, "doc_id"), width, max(MORE_KEYS, 2 * fewest))
    postings = checkpoint(_shared_keys(checkpoint(again.where("n_shingles > 0")), t))
    small, large = _by_cluster(postings)
    large = checkpoint(large)
    first = large.groupBy("doc_id", "n").agg(F.max(F.struct("df", "key")).getField("key").alias("key"))
    links = checkpoint(_search(docs, checkpoint(small.unionByName(first)), width, t))
    found = components(links.join(large.select(F.col("doc_id").alias("a")).distinct(), "a", "leftsemi"))
    placed = large.join(found.withColumnRenamed("id", "doc_id"), "doc_id", "left").withColumn("component", F.coalesce("component", "doc_id"))
    apart = placed.groupBy("key").agg(F.min("component").alias("low"), F.max("component").alias("high")).where("low < high").select("key")
    rest = checkpoint(large.join(apart, "key").select("key", "doc_id", "n"))
    copies = filled.join(classes, ["n_shingles", "set_a", "set_b"]).select(F.col("doc_id").alias("a"), F.col("rep").alias("b"))
    found = components(links.unionByName(_search(docs, rest, width, t)).unionByName(copies))
    return (signed.select("doc_id", "n_shingles").join(found.withColumnRenamed("id", "doc_id"), "doc_id", "left")
            .select("doc_id", "n_shingles", F.coalesce("component", "doc_id").alias("component_id")))


def keep_one_of_each(docs: DataFrame, threshold: float | str = "0.9", width: int = 3) -> DataFrame:
    """The documents that are the smallest id of their component, with all their columns; of
    rows that repeat a kept doc_id all stay, as do rows without doc_id."""
    joined = ngram_jaccard_join(docs, threshold, width)
    dropped = joined.where("component_id < doc_id").select("doc_id").distinct()
    return docs.join(dropped, "doc_id", "leftanti")


def op7_ngram_join(spark, sf_dir) -> DataFrame:
    return ngram_jaccard_join(table(spark, sf_dir, "documents"))
