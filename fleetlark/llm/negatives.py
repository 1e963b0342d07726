"""Operator 12: hard negatives by a secondary-sort shuffle.

Vectors are scored against anchors by the integer inner product of their floored, scaled components. Of an anchor, the best
rows of its own label are its positives; for each positive the best rows of other labels that score neither above it
nor far below it are its hard negatives.

1. Rows are packed into tiles of integer codes by a hash of vec_id, anchors into tiles of their own; every pair of an
   anchor tile and a row tile is one unit of work, so a label of any size spreads over many tasks.
2. A first pass over the units keeps, of each anchor and tile, the best rows of its own label; the best of these are
   its positives.
3. A second pass keeps, of each anchor and tile, the best ``negatives`` rows in the window of each of its positives. What
   others would be returned for an anchor must be among these, so the shuffle moves a fixed number of pairs for an
   anchor and tile instead of one for each row, and loses none.
4. Pairs are packed into keys (anchor, descending score, id) of 28 bytes, with the number of components first, that sort as the numbers do, dealt by anchor and
   sorted within partitions. An iterator runs over them: a positive opens a window, later negatives (and
   those of the same score) go to the open windows, which close when full or out of reach. It holds the windows of one
   anchor and a few negatives of one score, never an anchor's rows.

Defined cases: rows with a null vec_id, label or vector, a null or non-finite component, or a scaled component of 2**28 or more (whose
products need not fit a long) take no part; an empty vector scores 0. Vectors are compared with those of as many
components. Of rows that repeat a vec_id (and number of components) the one of smallest label, then vector, takes part. Other
columns are not looked at.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fleetlark.llm.common import checkpoint, table

ROW_TILE, ANCHOR_TILE = 8192, 2048
# Anchors scored at once.
_STRIP = 64
# Components, anchor, score and id, in the order that bytes have.
_KEY = ">IQQQ"
_SIGN = 1 << 63
_PACKED = "dim int, tile int, ids binary, labels binary, codes binary"


def products(anchors: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Exact inner products: in doubles where all partial sums are integers that doubles hold."""
    if not (anchors.size and rows.size):
        return np.zeros((len(anchors), len(rows)), np.int64)
    bound = float(np.abs(anchors).max()) * float(np.abs(rows).max()) * anchors.shape[1]
    if bound < 2 ** 53:
        return (anchors.astype(np.float64) @ rows.astype(np.float64).T).astype(np.int64)
    return anchors @ rows.T


def best(scores: np.ndarray, among: np.ndarray, count: int) -> np.ndarray:
    """Of the places ``among`` (ascending) the ``count`` of highest score, the first where scores are equal."""
    if len(among) > count:
        found = scores[among]
        last = np.partition(found, len(found) - count)[len(found) - count]
        above = among[found > last]
        among = np.concatenate((above, among[found == last][:count - len(above)]))
    return among[np.lexsort((among, -scores[among]))]


def _packed(rows: DataFrame, tiles: int) -> DataFrame:
    """Tiles of rows ``(vec_id, label, vector, dim)``: ids ascending, labels, codes."""
    def pack(group: pd.DataFrame) -> pd.DataFrame:
        group = group.assign(vector=[tuple(v) for v in group["vector"]]).sort_values(["vec_id", "label", "vector"]).drop_duplicates("vec_id")
        codes = np.array(group["vector"].tolist(), np.int64).reshape(len(group), int(group["dim"].iloc[0]))
        return pd.DataFrame([{"dim": group["dim"].iloc[0], "tile": group["tile"].iloc[0], "ids": group["vec_id"].to_numpy(np.int64).tobytes(),
                              "labels": group["label"].to_numpy(np.int64).tobytes(), "codes": codes.astype(np.int32).tobytes()}])

    return (rows.withColumn("tile", F.pmod(F.xxhash64("vec_id"), F.lit(tiles)).cast("int"))
            .select("dim", "tile", "vec_id", "label", "vector").groupBy("dim", "tile").applyInPandas(pack, _PACKED))


def _opened(tile: pd.Series) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    ids, labels = (np.frombuffer(tile[c], np.int64) for c in ("ids", "labels"))
    return ids, labels, np.frombuffer(tile["codes"], np.int32).reshape(len(ids), int(tile["dim"])).astype(np.int64)


def mine_hard_negatives(vectors: DataFrame, every: int = 100, positives: int = 5, negatives: int = 5, low: int = 80, high: int = 100,
                        scale: int = 256) -> DataFrame:
    """Rows ``(anchor_id, positive_id, rank, negative_id, positive_score, negative_score)``. Anchors are the rows whose vec_id is
    divisible by ``every``. Labels are integers. A negative fits a positive if
    ``low * positive_score <= 100 * negative_score <= high * positive_score``; with ``high`` at most 100 none scores above it."""
    if not 0 < high <= 100:
        raise ValueError("a negative may not score above its positive")
    rows = vectors.select(F.col("vec_id").cast("long"), F.col("label").cast("long").alias("label"), F.col("embedding").cast("array<double>").alias("vector"))
    limit = 2.0 ** 28 / scale
    fits = f"vec_id IS NOT NULL AND label IS NOT NULL AND vector IS NOT NULL AND forall(vector, x -> x IS NOT NULL AND NOT isnan(x) AND abs(x) < {limit}D)"
    rows = (rows.where(F.coalesce(F.expr(fits), F.lit(False)))
            .select("vec_id", "label", F.expr(f"transform(vector, x -> CAST(floor({scale}D * x) AS int))").alias("vector"), F.expr("size(vector)").alias("dim")))
    is_anchor = F.col("vec_id") % every == 0
    n_rows, n_anchors = rows.agg(F.count("*"), F.count_if(is_anchor)).first()
    n_row_tiles, n_anchor_tiles = -(-n_rows // ROW_TILE) or 1, -(-n_anchors // ANCHOR_TILE) or 1
    row_tiles = checkpoint(_packed(rows, n_row_tiles))
    anchor_tiles = checkpoint(_packed(rows.where(is_anchor), n_anchor_tiles))

    meeting = ["dim", "anchor_tile", "row_tile"]

    def units(anchors: DataFrame):
        """Every pair of tiles once: each side is sent to the tile numbers of the other, and both meet by equal keys."""
        numbers = lambda tiles: F.explode(F.sequence(F.lit(0), F.lit(tiles - 1)))
        across = anchors.withColumnRenamed("tile", "anchor_tile").withColumn("row_tile", numbers(n_row_tiles))
        down = row_tiles.withColumnRenamed("tile", "row_tile").withColumn("anchor_tile", numbers(n_anchor_tiles))
        return across.groupBy(*meeting).cogroup(down.groupBy(*meeting))

    def scored(anchors: pd.DataFrame, tile: pd.DataFrame) -> Iterator[tuple]:
        """Per anchor its id, which rows of the tile have its label, its scores with them, and their ids."""
        if len(anchors) and len(tile):
            a_ids, a_labels, a_codes = _opened(anchors.iloc[0])
            ids, labels, codes = _opened(tile.iloc[0])
            for at in range(0, len(a_ids), _STRIP):
                for k, scores in enumerate(products(a_codes[at:at + _STRIP], codes)):
                    yield a_ids[at + k], labels == a_labels[at + k], scores, ids

    def rows_of(anchors: pd.DataFrame, out: list[tuple]) -> pd.DataFrame:
        unit = anchors.iloc[0] if len(anchors) else {"dim": 0, "anchor_tile": 0}
        return pd.DataFrame(out, columns=["anchor", "id", "score"]).astype("int64").assign(dim=unit["dim"], anchor_tile=unit["anchor_tile"])

    def own(anchors: pd.DataFrame, tile: pd.DataFrame) -> pd.DataFrame:
        return rows_of(anchors, [(anchor, ids[k], scores[k]) for anchor, same, scores, ids in scored(anchors, tile)
                                 for k in best(scores, np.flatnonzero(same & (ids != anchor)), positives)])

    schema = "anchor long, id long, score long, dim int, anchor_tile int"
    order = Window.partitionBy("dim", "anchor").orderBy(F.desc("score"), "id")
    found = (units(anchor_tiles).applyInPandas(own, schema)
             .withColumn("place", F.row_number().over(order)).where(F.col("place") <= positives))
    found = checkpoint(found.drop("place"))
    # each anchor tile carries the positive scores of its anchors
    floors = found.groupBy("dim", F.col("anchor_tile").alias("tile")).agg(F.collect_list(F.struct("anchor", "score")).alias("wanted"))

    def others(anchors: pd.DataFrame, tile: pd.DataFrame) -> pd.DataFrame:
        wanted: dict[int, set[int]] = {}
        for w in anchors["wanted"].iloc[0] if len(anchors) else []:
            wanted.setdefault(w["anchor"], set()).add(w["score"])
        out = []
        for anchor, same, scores, ids in scored(anchors, tile):
            tops = wanted.get(anchor, ())
            for k in {k for top in tops for k in best(scores, np.flatnonzero(~same & (100 * scores <= high * top) & (100 * scores >= low * top)), negatives).tolist()}:
                out.append((anchor, ids[k], scores[k]))
        return rows_of(anchors, out)

    against = units(anchor_tiles.join(floors, ["dim", "tile"])).applyInPandas(others, schema)
    pairs = found.select("dim", "anchor", "score", "id", F.lit(True).alias("positive")).unionByName(
        against.select("dim", "anchor", "score", "id", F.lit(False).alias("positive")))
    return secondary_sorted(pairs, negatives, low, high)


def packed_key(dim: int, anchor: int, score: int, number: int) -> bytes:
    """Sorts by number of components, anchor, descending score, then id."""
    return struct.pack(_KEY, dim, anchor + _SIGN, _SIGN - 1 - score, number + _SIGN)


def unpacked_key(key: bytes) -> tuple[int, int, int, int]:
    dim, anchor, score, number = struct.unpack(_KEY, key)
    return dim, anchor - _SIGN, _SIGN - 1 - score, number - _SIGN


def windows(pairs: Iterator[tuple[bytes, bool]], negatives: int, low: int, high: int) -> Iterator[tuple]:
    """Rows from sorted pairs ``(key, positive)``, as they come."""
    current, level, held, opened = None, None, [], []
    for key, positive in pairs:
        dim, anchor, score, number = unpacked_key(key)
        if (dim, anchor) != current:
            current, level, opened = (dim, anchor), None, []
        if score != level:
            level, held = score, []
        if positive:
            window = [number, score, 0]
            opened.append(window)
            offered = [(n, window) for n in held]
        else:
            if len(held) < negatives:
                held.append(number)
            offered = [(number, window) for window in opened]
        for n, window in offered:
            if low * window[1] <= 100 * score <= high * window[1] and window[2] < negatives:
                window[2] += 1
                yield anchor, window[0], window[2], n, window[1], score
        opened = [w for w in opened if w[2] < negatives and low * w[1] <= 100 * score]


def secondary_sorted(pairs: DataFrame, negatives: int, low: int, high: int) -> DataFrame:
    """The secondary sort over pairs ``(dim, anchor, score, id, positive)``, and the windows over it."""
    spark = pairs.sparkSession
    keyed = pairs.rdd.map(lambda r: (packed_key(r["dim"], r["anchor"], r["score"], r["id"]), r["positive"]))
    by_anchor = keyed.repartitionAndSortWithinPartitions(int(spark.conf.get("spark.sql.shuffle.partitions")), lambda key: zlib.crc32(key[:12]))
    return spark.createDataFrame(by_anchor.mapPartitions(lambda sorted_pairs: windows(sorted_pairs, negatives, low, high)),
                                 "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long")


def op12_negatives(spark, sf_dir) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return mine_hard_negatives(vectors.withColumn("label", moved))


OP12_SQL = """WITH codes AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
      list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS code FROM embeddings
      WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
  pairs AS (SELECT a.vec_id AS anchor_id, b.vec_id AS id, a.label = b.label AS same, list_inner_product(a.code, b.code)::BIGINT AS score
      FROM codes a JOIN codes b ON a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id),
  positives AS (SELECT * FROM pairs WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, id) <= 5),
  fitting AS (SELECT p.anchor_id, p.id AS positive_id, n.id AS negative_id, p.score AS positive_score, n.score AS negative_score,
      row_number() OVER (PARTITION BY p.anchor_id, p.id ORDER BY n.score DESC, n.id) AS place
      FROM positives p JOIN pairs n ON n.anchor_id = p.anchor_id AND NOT n.same AND 80 * p.score <= 100 * n.score AND 100 * n.score <= 100 * p.score)
SELECT anchor_id, positive_id, place::INTEGER AS rank, negative_id, positive_score, negative_score FROM fitting WHERE place <= 5"""
