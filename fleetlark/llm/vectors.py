"""Operator 10: near-duplicate embeddings by int8 tile products with error bounds.

Vectors are compared within one label (and one dimension). Equal vectors form a class and are
compared once. Classes are dealt evenly to tiles of about ``TILE`` vectors; every pair of tiles
of a label is one unit of work, so a label of any size spreads over many tasks.

A unit vector ``u`` is kept as ``s q + e``: int8 codes ``q``, a scale ``s``, and the exact length
``|e|`` of what quantising lost. For two of them

    |u.v - s_u s_v (q_u.q_v)|  <=  |e_v| + |e_u| (1 + |e_v|)

so a tile product of the codes settles every pair whose bound lies below the threshold; only the
others are computed again in double precision. (Products of codes are integers that float32
holds exactly up to 1,040 dimensions; beyond that they are taken in float64.)

A unit of work returns counts of links and a spanning forest of them, never all pairs.

Defined cases: a vector that is null, empty, zero, or holds null or non-finite components, and one whose
label is null, links with nothing and is its own component. Every row counts as a vector, also where vec_id
repeats; rows without vec_id count for others, but get no component themselves. Other columns are not looked at.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fleetlark.llm.common import checkpoint, components, table

TILE = 2048
_STRIP = 256
# Rounding in the bound itself and in products of doubles.
_SLACK = 1e-9


def unit(vectors: np.ndarray) -> np.ndarray:
    """Rows scaled to length one (by their largest component first, so that nothing overflows)."""
    x = vectors / np.abs(vectors).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def quantise(units: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """int8 codes, scales and lengths of the errors."""
    scale = np.abs(units).max(axis=1) / 127
    codes = np.rint(units / scale[:, None]).astype(np.int8)
    error = units - codes * scale[:, None]
    return codes, scale, np.sqrt((error * error).sum(axis=1)) + 1e-15


def tile_hits(a: tuple, b: tuple, threshold: float):
    """Per strip of rows of tile a: its place, and which vectors of tile b link with each."""
    (units_a, codes_a, scale_a, err_a), (units_b, codes_b, scale_b, err_b) = a, b
    kind = np.float32 if codes_a.shape[1] <= 1040 else np.float64
    right = codes_b.astype(kind).T
    for at in range(0, len(codes_a), _STRIP):
        rows = slice(at, at + _STRIP)
        near = (codes_a[rows].astype(kind) @ right).astype(np.float64) * scale_a[rows, None] * scale_b
        hits = near >= threshold - _SLACK - err_b - err_a[rows, None] * (1 + err_b)
        i, j = np.flatnonzero(hits.any(axis=1)), np.flatnonzero(hits.any(axis=0))
        if len(i):
            hits[np.ix_(i, j)] &= units_a[rows][i] @ units_b[j].T >= threshold
        yield at, hits


def forest(groups: np.ndarray, row: int, linked: np.ndarray, edges: list) -> None:
    """Joins the groups of linked vectors to that of a row, noting one edge for each."""
    mine = groups[row]
    others, first = np.unique(groups[linked], return_index=True)
    for group, k in zip(others.tolist(), first.tolist(), strict=True):
        if group != mine:
            edges.append((row, int(linked[k])))
            groups[groups == group] = mine


def tile_links(left: pd.Series, right: pd.Series | None, threshold: float) -> pd.DataFrame:
    """Links between two tiles, or within one: counts ``(id, n)`` and edges ``(id, other)``."""
    def opened(tile: pd.Series) -> tuple:
        units = unit(np.frombuffer(tile["vectors"], np.float64).reshape(len(tile["ids"]), -1))
        codes = np.frombuffer(tile["codes"], np.int8).reshape(units.shape)
        return units, codes, np.frombuffer(tile["scales"], np.float64), np.frombuffer(tile["errors"], np.float64)

    within = right is None
    tiles = [left] if within else [left, right]
    ids = np.concatenate([np.asarray(t["ids"], np.int64) for t in tiles])
    weights = np.concatenate([np.asarray(t["weights"], np.int64) for t in tiles])
    a = opened(left)
    b = a if within else opened(right)
    skip = 0 if within else len(left["ids"])
    counts, groups, edges = np.zeros(len(ids), np.int64), np.arange(len(ids)), []
    for at, hits in tile_hits(a, b, threshold):
        if within:
            hits[np.arange(len(hits)), at + np.arange(len(hits))] = False
        counts[at:at + len(hits)] += hits @ weights[skip:]
        if not within:
            counts[skip:] += weights[at:at + len(hits)] @ hits
        for i in np.flatnonzero(hits.any(axis=1)):
            forest(groups, at + int(i), skip + np.flatnonzero(hits[i]), edges)
    some = np.flatnonzero(counts)
    a_side, b_side = (ids[np.array(x, np.int64)] for x in (zip(*edges, strict=True) if edges else ([], [])))
    return pd.DataFrame({"id": np.concatenate((ids[some], a_side)), "n": np.concatenate((counts[some], np.zeros(len(edges), np.int64))),
                         "other": pd.array(np.concatenate((np.zeros(len(some), np.int64), b_side)), "Int64")}).assign(
        other=lambda f: f["other"].mask(f["n"] > 0))


def near_duplicate_vectors(vectors: DataFrame, threshold: float = 0.98) -> DataFrame:
    """Rows ``(vec_id, n_links, component_id)``, one for each row of ``vectors``."""
    if not -1 <= threshold <= 1:
        raise ValueError("a cosine lies between -1 and 1")
    rows = vectors.select(F.col("vec_id").cast("long"), F.col("label").cast("string").alias("label"),
                          F.col("embedding").cast("array<double>").alias("vector"))
    good = F.expr("label IS NOT NULL AND vector IS NOT NULL AND forall(vector, x -> x IS NOT NULL AND NOT isnan(x) AND abs(x) < double('infinity'))"
                  " AND exists(vector, x -> x != 0)")
    rows = rows.withColumn("good", F.coalesce(good, F.lit(False)))
    classes = rows.where("good").groupBy("label", "vector").agg(F.min("vec_id").alias("low"), F.count("*").alias("weight"))
    # a class is named by its smallest vec_id; by a negative hash if it has none, or where another class has that name
    name = F.shiftrightunsigned(F.xxhash64("label", "vector"), 1) + F.lit(-2**63)
    same = Window.partitionBy("low", F.when(F.col("low").isNull(), name)).orderBy("label", "vector")
    classes = (classes.withColumn("rep", F.when(F.col("low").isNotNull() & (F.row_number().over(same) == 1), F.col("low")).otherwise(name))
               .withColumn("dim", F.size("vector")))
    sizes = classes.groupBy("label", "dim").agg(F.ceil(F.count("*") / TILE).cast("int").alias("tiles"))
    placed = classes.join(sizes, ["label", "dim"]).withColumn("tile", F.pmod(F.xxhash64("rep", "vector"), F.col("tiles")).cast("int"))

    def pack(group: pd.DataFrame) -> pd.DataFrame:
        values = np.stack(group["vector"].to_numpy()).astype(np.float64)
        codes, scales, errors = quantise(unit(values))
        first = group.iloc[0]
        return pd.DataFrame([{"label": first["label"], "dim": first["dim"], "tiles": first["tiles"], "tile": first["tile"],
                              "ids": group["rep"].tolist(), "weights": group["weight"].tolist(), "vectors": values.tobytes(),
                              "codes": codes.tobytes(), "scales": scales.tobytes(), "errors": errors.tobytes()}])

    packed = placed.select("label", "dim", "tiles", "tile", "rep", "weight", "vector").groupBy("label", "dim", "tile").applyInPandas(
        pack, "label string, dim int, tiles int, tile int, ids array<long>, weights array<long>,"
              " vectors binary, codes binary, scales binary, errors binary")
    units = (packed.select("*", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)).alias("with"))
             .withColumns({"low": F.least("tile", "with"), "high": F.greatest("tile", "with")}).drop("with", "tiles"))

    def compare(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("tile")
        if len(group) == 1:  # either one tile with itself, or the other tile is empty
            only = group.iloc[0]
            return tile_links(only, None, threshold) if only["low"] == only["high"] else pd.DataFrame({"id": [], "n": [], "other": []}).astype(
                {"id": "int64", "n": "int64", "other": "Int64"})
        return tile_links(group.iloc[0], group.iloc[1], threshold)

    found = checkpoint(units.groupBy("label", "dim", "low", "high").applyInPandas(compare, "id long, n long, other long"))
    linked = components(found.where("other IS NOT NULL").select(F.col("id").alias("a"), F.col("other").alias("b")))
    counts = found.groupBy("id").agg(F.sum("n").alias("outer"))
    by_class = (classes.select("label", "vector", "weight", "rep", "low")
                .join(counts.withColumnRenamed("id", "rep"), "rep", "left").join(linked.withColumnRenamed("id", "rep"), "rep", "left")
                .withColumn("component", F.coalesce("component", "rep")))
    lowest = by_class.groupBy("component").agg(F.min("low").alias("component_id"))
    by_class = by_class.join(lowest, "component").select(
        "label", "vector", (F.coalesce("outer", F.lit(0)) + F.col("weight") - 1).alias("n_links"), "component_id")
    return (rows.where("good").join(by_class, ["label", "vector"]).select("vec_id", "n_links", "component_id")
            .unionByName(rows.where("NOT good").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id")))
            .select("vec_id", "n_links", F.when(F.col("vec_id").isNotNull(), F.col("component_id")).alias("component_id")))


def op10_near_vectors(spark, sf_dir) -> DataFrame:
    return near_duplicate_vectors(table(spark, sf_dir, "embeddings")).withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))
