"""Operator 3: Lempel-Ziv phrase fingerprints.

A text is parsed as Lempel and Ziv did in 1978, over its words (runs of other than white space,
cut after ``WORD_CHARS`` code points): each phrase is the longest phrase already in the
dictionary and one word more. The set of phrases, each known by a 64-bit rolling hash, is
summed up by its ``SIGNATURE`` smallest scrambled hashes (32 bits each, as hexadecimal text).
The likeness of two fingerprints estimates the Jaccard similarity of the phrase sets from the
smallest hashes of their union, and is exact for texts of few phrases.

Defined cases: null counts as empty; an empty text, or one of white space, has the empty
fingerprint, which is like another empty one (1.0) and unlike all others (0.0). Equal texts have
equal fingerprints. Documents of equal doc_id follow each other by text, so repeated rows are
each other's neighbours; null doc_ids come after all others. In a table of one row the
next document is the row itself. Other columns are not looked at.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fleetlark.llm.common import mix, table, text_or_empty

WORD_CHARS = 16
SIGNATURE = 64
# Characters of text that one range of neighbouring documents should hold.
RANGE_CHARS = 8_000_000
MOST_RANGES = 20_000
_WORD = re.compile(r"\S{1,%d}" % WORD_CHARS)
_STEP, _MASK = 0x9E3779B97F4A7C15, (1 << 64) - 1


class Parser:
    """Parses words to sets of phrase hashes. Keeps the hashes of words it has met."""

    def __init__(self, keep: int = 200_000):
        self.known: dict[str, int] = {}
        self.keep = keep

    def word(self, word: str) -> int:
        if (value := self.known.get(word)) is None:
            if len(self.known) >= self.keep:
                self.known.clear()
            value = self.known[word] = int.from_bytes(hashlib.blake2b(word.encode(), digest_size=8).digest(), "little")
        return value

    def parse(self, words: list[str], phrases: set[int], phrase: int = 0) -> int:
        """Adds the phrases of words to a dictionary; returns the phrase left open."""
        known = self.known
        for word in words:
            value = known.get(word)
            if value is None:
                value = self.word(word)
            phrase = (phrase * _STEP + value) & _MASK
            if phrase not in phrases:
                phrases.add(phrase)
                phrase = 0
        return phrase


def signature(phrases: set[int]) -> np.ndarray:
    values = np.unique((mix(np.fromiter(phrases, np.uint64, len(phrases))) >> np.uint64(32)).astype(np.uint32))
    return values[:SIGNATURE]


def to_text(values: np.ndarray) -> str:
    return values.astype(">u4").tobytes().hex()


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """Share of the union's smallest hashes that both have."""
    union = np.union1d(a, b)[:SIGNATURE]
    return float(np.isin(np.intersect1d(a, b, True), union, True).sum() / len(union)) if len(union) else 1.0


def fingerprint(text: str, parser: Parser) -> np.ndarray:
    phrases: set[int] = set()
    parser.parse(_WORD.findall(text), phrases)
    return signature(phrases)


def edited(text: str, following: str) -> str:
    """The text with its last third replaced by as much of the following text."""
    n = len(text) // 3
    return text[:len(text) - n] + following[:n]


class Parsed:
    """A document's fingerprint, and where its parse stood before the part that an edit
    replaces (at a white space, so that no word is cut): what precedes is parsed once."""

    def __init__(self, text: str, parser: Parser):
        self.text, self.parser = text, parser
        kept = len(text) - len(text) // 3
        while kept and not text[kept - 1].isspace():
            kept -= 1
        self.kept, phrases = kept, set()
        self.open = parser.parse(_WORD.findall(text, 0, kept), phrases)
        self.before = set(phrases)
        parser.parse(_WORD.findall(text, kept), phrases, self.open)
        self.values = signature(phrases)

    def edited(self, following: str) -> tuple[str, np.ndarray]:
        """The edited text and its fingerprint; for one call."""
        changed = edited(self.text, following)
        self.parser.parse(_WORD.findall(changed, self.kept), self.before, self.open)
        return changed, signature(self.before)


def with_next(docs: DataFrame) -> DataFrame:
    """Documents in ranges of neighbouring ids, as rows ``(range, tail, doc_id, text)``: sorted
    within each range by descending doc_id, and after them (``tail``) the first document of the
    next range, or of all after the last. Texts move once; only the bounds of ranges, whose
    number is at most MOST_RANGES, pass through the driver."""
    docs = docs.select(F.col("doc_id").cast("long"), text_or_empty().alias("text"))
    chars, low = docs.agg(F.sum(F.length("text")), F.min("doc_id")).first()
    ranges = min(MOST_RANGES, int((chars or 0) // RANGE_CHARS) + 1)
    cuts: set[int] = set()
    if ranges > 1 and low is not None:
        cuts = {int(x) for x in docs.approxQuantile("doc_id", [k / ranges for k in range(1, ranges)], 0.1 / ranges)}
    bounds = np.asarray(sorted(cuts), np.int64)

    def own_range(ids: pd.Series) -> np.ndarray:
        # ranges count from the largest ids; a null id comes after all others
        at = len(bounds) - np.searchsorted(bounds, ids.fillna(0).astype("int64").to_numpy(), "right")
        return np.where(ids.isna(), len(bounds), at)

    @F.pandas_udf("int")
    def range_of(ids: pd.Series) -> pd.Series:
        return pd.Series(own_range(ids)).astype("int32")

    firsts = docs.select(range_of("doc_id").alias("range"), "doc_id").groupBy("range").agg(F.max("doc_id").alias("first")).collect()
    order = sorted((row["range"], row["first"]) for row in firsts)
    before = {first: a for (a, _), (_, first) in zip(order, order[1:] + order[:1], strict=True)}

    @F.pandas_udf("array<int>")
    def places(ids: pd.Series) -> pd.Series:
        """Its own range, and for the first document of a range that before it, as -1 - range."""
        keys = [None if pd.isna(x) else int(x) for x in ids]
        return pd.Series([[own, -1 - before[key]] if key in before else [own] for own, key in zip(own_range(ids).tolist(), keys, strict=True)])

    spread = docs.select(F.explode(places("doc_id")).alias("place"), "doc_id", "text").select(
        F.when(F.col("place") < 0, -1 - F.col("place")).otherwise(F.col("place")).alias("range"),
        (F.col("place") < 0).alias("tail"), "doc_id", "text")
    return spread.repartitionById(len(bounds) + 1, F.col("range")).sortWithinPartitions(
        "range", "tail", F.col("doc_id").desc_nulls_last(), "text")


RESULT = ("doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string,"
          " near_edited double, near_next double")


def fingerprint_documents(docs: DataFrame) -> DataFrame:
    """Every document's fingerprint, that of its edited text, and how like they are to each
    other and to the next document's."""
    names = [field.split()[0] for field in RESULT.split(", ")]

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        parser, held = Parser(), None  # held: the document that waits for the next one
        for batch in batches:
            out = []
            for where, tail, doc_id, text in zip(batch["range"], batch["tail"], batch["doc_id"], batch["text"], strict=True):
                parsed = Parsed(text, parser)
                if held is not None and held[0] == where:
                    _, before, document = held
                    changed, other = document.edited(text)
                    out.append((None if pd.isna(before) else int(before), len(document.text), hashlib.sha256(changed.encode()).hexdigest(),
                                to_text(document.values), to_text(other),
                                likeness(document.values, other), likeness(document.values, parsed.values)))
                held = None if tail else (where, doc_id, parsed)
            frame = pd.DataFrame(out, columns=names)
            yield frame.astype({"doc_id": "Int64"})

    return with_next(docs).mapInPandas(scan, RESULT)


def op3_fingerprint(spark, sf_dir) -> DataFrame:
    return fingerprint_documents(table(spark, sf_dir, "documents"))
