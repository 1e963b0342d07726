"""What the operators share: reading, checkpoints, hashing in numpy, connected components."""

from __future__ import annotations

import sys
import tempfile

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

import fleetlark.llm

# Python functions travel with the job, so executors need no copy of this package.
cloudpickle.register_pickle_by_value(sys.modules["fleetlark.llm"])

DOC_COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
# Bits of the filter of may_match; a fixed size, so what is broadcast does not grow.
FILTER_BITS = 1 << 23
# UTF-8 bytes taken through numpy at once (a single longer text is taken whole).
SLICE_BYTES = 1 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The checkpoint folder, shared by all executors, as ``spark.checkpoint.dir`` names it. Only
    a local session without that setting gets a folder of its own."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        if not sc.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="run-", dir="/tmp"))
    return sc.getCheckpointDir()


def checkpoint(df: DataFrame) -> DataFrame:
    """Cuts the lineage in the shared folder."""
    shared_folder(df.sparkSession)
    return df.checkpoint()


def text_or_empty(name: str = "text") -> Column:
    return F.coalesce(F.col(name), F.lit(""))


# --- numpy -----------------------------------------------------------------------------

_A, _B = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def mix(x: np.ndarray) -> np.ndarray:
    """Scrambles 64-bit values (the finaliser of SplitMix64), one to one."""
    x = np.asarray(x, np.uint64)
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * _A
        x = (x ^ (x >> np.uint64(27))) * _B
        return x ^ (x >> np.uint64(31))


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a string column; null counts as empty."""
    array = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    array = array.cast(pa.large_string())
    if array.null_count:
        array = array.fill_null("")
    _, offsets, data = array.buffers()
    offsets = np.frombuffer(offsets, np.int64)[array.offset:array.offset + len(array) + 1] if len(array) else np.zeros(1, np.int64)
    return np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8), offsets


def slices(offsets: np.ndarray, most: int = SLICE_BYTES):
    """Ranges of rows of at most so many bytes, or of one row."""
    start, n = 0, len(offsets) - 1
    while start < n:
        stop = max(start + 1, int(np.searchsorted(offsets, offsets[start] + most, "right")) - 1)
        yield start, min(stop, n)
        start = stop


# --- graphs ----------------------------------------------------------------------------


def components(edges: DataFrame) -> DataFrame:
    """Connected components of edges ``(a, b)``: rows ``(id, component)`` for every id that has
    an edge to another, ``component`` being the smallest id reachable.

    Alternates the large-star and small-star steps of Kiveris et al. (2014) until the edges no
    longer change: each node then points at its minimum. Every step is a minimum that combines
    before the shuffle and a join that adaptive execution may split; each round is
    checkpointed. Null ends and loops are left out.
    """
    edges = checkpoint(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u > v").distinct())
    state = _fingerprint(edges)
    while state[0]:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        moved = large.join(low, "u").where("v > m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        edges = checkpoint(moved.unionByName(low.select("u", F.col("m").alias("v"))).distinct())
        before, state = state, _fingerprint(edges)
        if state == before:
            break
    ends = edges.select("v").distinct()
    return (edges.select(F.col("u").alias("id"), F.col("v").alias("component"))
            .unionByName(ends.select(F.col("v").alias("id"), F.col("v").alias("component"))))


def _fingerprint(edges: DataFrame) -> tuple:
    row = edges.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)")).alias("h")).first()
    return row["n"], row["h"]


def match_flag(key: Column, wanted: DataFrame, wanted_key: str) -> Column:
    """Whether a key may be among the wanted ones: a one-hash filter of fixed size. It calls no
    wanted key absent at any size; with very many wanted keys it calls nearly all present."""
    bucket = F.pmod(F.xxhash64(F.col(wanted_key)), F.lit(FILTER_BITS)).cast("int")
    rows = (wanted.where(F.col(wanted_key).isNotNull()).select(bucket.alias("bit")).distinct()
            .groupBy((F.col("bit") / 4096).cast("int").alias("block"))
            .agg(F.collect_list((F.col("bit") % 4096).cast("short")).alias("bits")).toArrow())
    flags = np.zeros(FILTER_BITS, bool)
    for block, bits in zip(rows["block"].to_pylist(), rows["bits"], strict=True):
        flags[block * 4096 + np.asarray(bits.values, np.int64)] = True
    packed = np.packbits(flags)

    @F.pandas_udf("boolean")
    def present(bits: pd.Series) -> pd.Series:
        at = bits.to_numpy()
        return pd.Series((packed[at >> 3] >> (7 - (at & 7)).astype(np.uint8)) & 1 == 1)

    return key.isNotNull() & present(F.pmod(F.xxhash64(key), F.lit(FILTER_BITS)).cast("int"))


def may_match(rows: DataFrame, key: str, wanted: DataFrame, wanted_key: str) -> DataFrame:
    """Rows whose key is among the wanted ones, and perhaps some others: taken before the
    shuffle of a join so that it moves fewer rows."""
    return rows.where(match_flag(F.col(key), wanted, wanted_key))
