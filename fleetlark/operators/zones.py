"""Which geofences lie at a point: a grid index over the fences and lookups in it.

Fences are cut into grid cells whose side fits their size, so that each takes a bounded
number of cells. A cell that no edge comes near is either wholly inside its fence, and then
needs no test, or left out; the others keep just the edges that matter to points in them.
Points find their candidates by equality of cells, never by comparing all points with all
fences.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fleetlark.functions import geo

# Cell sides in degrees, finest first. A fence takes the first level on which it spans at
# most so many cells each way; whatever is larger takes the last.
CELL_SIDES = tuple(0.0025 * 4 ** n for n in range(7))
_SPAN_CELLS = 24
# Where the fences of the first level have more than so many others in their cells, they get a
# level of smaller cells, halved until the mean fence spans so many of them.
CROWDED_FENCES = 16
_SMALL_SPAN, _MOST_HALVINGS = 4, 6
# Cells of a level are numbered by row and column; a row has fewer cells than this.
_ROW_CELLS = 100_000_000
# Cells are taken this much larger, in degrees, so that rounding puts no point outside.
_CELL_SLACK = "1e-9D"
# An index is broadcast up to this size, and its candidates travel as one array per cell
# up to this many fences in a cell. Beyond either, joins shuffle and pairs are regrouped.
BROADCAST_BYTES = 64 * 1024 * 1024
ARRAY_FENCES = 64
_EDGE_BYTES, _FENCE_BYTES = 32, 200
# Points without a position spread over this many keys instead of one.
_NULL_KEYS = 1024


def _cell(x: str, y: str, side: float) -> str:
    return f"(floor(({x} + 180) / {side}D) * {_ROW_CELLS} + floor(({y} + 90) / {side}D))"


@dataclass(frozen=True)
class FenceIndex:
    """Fences by (level, cell), and what was measured about them."""
    cells: DataFrame
    levels: tuple[int, ...]
    nbytes: int
    densest: int
    sides: tuple[float, ...] = CELL_SIDES

    @property
    def small(self) -> bool:
        return self.nbytes <= BROADCAST_BYTES

    @property
    def joins_without_shuffle(self) -> bool:
        return self.small and self.densest <= ARRAY_FENCES

    def release(self) -> None:
        self.cells.unpersist()

    def hinted(self, df: DataFrame) -> DataFrame:
        return F.broadcast(df) if self.small else df


def fence_index(fences: DataFrame, margin_m: float = 0.0) -> FenceIndex:
    """Index of the fences, each box grown by a margin; fences without a ring are left out. A fence is
    where one of its ``polygons`` is, or without such a column the inside of its ``ring``.
    Measures the (small) fence table first, to choose how it will be joined; what was read
    for that stays cached for the join, until ``release``. Fences are dealt to all cores and kept once
    read, as otherwise filters on what is worked out from them would read their texts again."""
    pad_x, pad_y = geo.grown_box(margin_m)
    polygons = "polygons" if "polygons" in fences.columns else "array(array(ring))"
    whole_rings = "transform(filter(polygons, p -> size(get(p, 0)) >= 4), p -> filter(p, r -> size(r) >= 4))"
    known = fences.selectExpr("id", "name", f"{polygons} AS polygons").repartition(fences.sparkSession.sparkContext.defaultParallelism).persist()
    usable = known.selectExpr("id", "name", f"{whole_rings} AS polygons").where("size(polygons) > 0")
    edged = usable.selectExpr(
        "id", "name", f"transform(polygons, polygon -> {geo.polygon_edges('polygon')}) AS parts",
        f"{geo.polygons_area('polygons')} AS area",
        *[f"{pick}(flatten(transform(polygons, polygon -> transform(polygon[0], p -> p.{axis})))) AS {name}" for name, pick, axis in (
            ("west", "array_min", "lng"), ("east", "array_max", "lng"),
            ("south", "array_min", "lat"), ("north", "array_max", "lat"))])
    padded = edged.selectExpr("*", f"{pad_x} AS pad_x", f"{pad_y} AS pad_y")
    grown = padded.selectExpr("id", "name", "parts", "area", "pad_x", "pad_y", "west - pad_x AS west",
                              "east + pad_x AS east", "south - pad_y AS south", "north + pad_y AS north")
    sides = _sides(grown)
    fits = " ".join(f"WHEN {_SPAN} <= {_SPAN_CELLS * side!r}D THEN {n}" for n, side in enumerate(sides[:-1]))
    cut = (
        grown.selectExpr("*", f"CASE {fits} ELSE {len(sides) - 1} END AS level")
        .selectExpr("*", f"array({', '.join(f'{side!r}D' for side in sides)})[level] AS side")
        .selectExpr("*", f"explode_outer({_BOX_CELLS}) AS c")
        .selectExpr("*", f"c.cx * side - 180 - pad_x - {_CELL_SLACK} AS cell_west",
                    f"(c.cx + 1) * side - 180 + pad_x + {_CELL_SLACK} AS cell_east",
                    f"c.cy * side - 90 - pad_y - {_CELL_SLACK} AS cell_south",
                    f"(c.cy + 1) * side - 90 + pad_y + {_CELL_SLACK} AS cell_north"))
    # Edges west of a cell, above or below it are never crossed by a ray from it to the east. Those east of
    # it that pass its whole height always are, so that only their being odd in number matters.
    passed = "least(e.x1, e.x2) > cell_east AND least(e.y1, e.y2) < cell_south AND greatest(e.y1, e.y2) > cell_north"
    near = ("filter(edges, e -> greatest(e.y1, e.y2) >= cell_south AND least(e.y1, e.y2) <= cell_north"
            f" AND greatest(e.x1, e.x2) >= cell_west AND NOT ({passed}))")
    odd = f"transform(array(filter(edges, e -> {passed})), far -> slice(far, 1, size(far) % 2))[0]"
    kept = f"filter(transform(parts, edges -> concat({near}, {odd})), edges -> size(edges) > 0)"
    middle = ("(cell_west + cell_east) / 2", "(cell_south + cell_north) / 2")
    touched = "exists(parts, edges -> exists(edges, e -> least(e.x1, e.x2) <= cell_east))"
    holds_middle = f"exists(parts, edges -> {geo.inside_edges('edges', *middle)})"
    # A generator works the edges out once; a filter on them would do so again for each use.
    pieces = cut.selectExpr(
        "id", "name", "area", "west", "east", "south", "north", "level", "c",
        f"inline_outer(transform(array({kept}), parts -> struct(parts AS kept, {touched} AS touched, {holds_middle} AS holds_middle)))")
    exploded = (
        pieces.where("touched OR holds_middle")
        .selectExpr("level", f"c.cx * {_ROW_CELLS} + c.cy AS cell", "struct(id, name, area, west, east, south, north, "
                    "NOT touched AS whole, IF(touched, kept, slice(kept, 1, 0)) AS parts) AS fence")
    ).persist()
    per_cell = exploded.groupBy("level", "cell").agg(
        F.expr("count(*) AS fences"),
        F.expr(f"sum(size(flatten(fence.parts)) * {_EDGE_BYTES} + {_FENCE_BYTES}) AS nbytes"))
    measured = per_cell.selectExpr("collect_set(level) AS levels", "max(fences) AS densest", "sum(nbytes) AS nbytes").first()
    known.unpersist()
    return FenceIndex(exploded, tuple(sorted(measured["levels"])), measured["nbytes"] or 0, measured["densest"] or 0, sides)


_SPAN = "greatest(east - west, north - south)"
_STEPS = "sequence(floor(({0} + {2}) / side), floor(({1} + {2}) / side))"
_BOX_CELLS = (f"flatten(transform({_STEPS.format('west', 'east', 180)}, cx -> "
              f"transform({_STEPS.format('south', 'north', 90)}, cy -> struct(cx, cy))))")


def _sides(boxes: DataFrame) -> tuple[float, ...]:
    """Sides of the levels. A point meets all fences of its cell, so where many fences are smaller than the first level's
    cells and crowd in them, a level that fits them goes before it."""
    first = CELL_SIDES[0]
    cells = (boxes.where(f"{_SPAN} <= {_SPAN_CELLS * first!r}D").selectExpr(f"{_SPAN} AS span", f"{first!r}D AS side", "west", "east", "south", "north")
             .selectExpr("span", f"explode_outer({_BOX_CELLS}) AS c"))
    found = (cells.groupBy("c").agg(F.expr("count(*) AS fences"), F.expr("sum(span) AS spans"))
             .selectExpr("sum(fences * fences) / sum(fences) AS crowd", "sum(spans) / sum(fences) AS span").first())
    if (found["crowd"] or 0) <= CROWDED_FENCES:
        return CELL_SIDES
    halvings = 0
    while halvings < _MOST_HALVINGS and found["span"] * 2 ** halvings < _SMALL_SPAN * first:
        halvings += 1
    return (first / 2 ** halvings, *CELL_SIDES) if halvings else CELL_SIDES


def _in_box(fence: str, x: str, y: str) -> str:
    return f"({x} BETWEEN {fence}.west AND {fence}.east AND {y} BETWEEN {fence}.south AND {fence}.north)"


def covering(fence: str, x: str, y: str) -> str:
    """A candidate fence covers the point."""
    return f"({fence}.whole OR ({_in_box(fence, x, y)} AND exists({fence}.parts, edges -> {geo.covers('edges', x, y)})))"


def strictly_covering(fence: str, x: str, y: str) -> str:
    """A candidate fence has the point in its interior."""
    return f"({fence}.whole OR ({_in_box(fence, x, y)} AND exists({fence}.parts, edges -> {geo.strictly_within('edges', x, y)})))"


def distance_m(fence: str, x: str, y: str) -> str:
    """Metres to a candidate fence, right up to the margin of its index and null or greater
    beyond."""
    return f"CASE WHEN {covering(fence, x, y)} THEN 0D ELSE {geo.edge_distance_m(f'flatten({fence}.parts)', x, y)} END"


def candidate_pairs(points: DataFrame, index: FenceIndex, lng: str = "lng", lat: str = "lat") -> DataFrame:
    """Points with each fence that may cover them or be within the margin, as column ``fence``."""
    keys = ", ".join(f"struct({n} AS level, {_cell(lng, lat, index.sides[n])} AS cell)" for n in index.levels)
    looked = points.where(f"{lng} IS NOT NULL AND {lat} IS NOT NULL").selectExpr(
        "*", f"inline({f'array({keys})' if keys else 'CAST(array() AS array<struct<level:int,cell:bigint>>)'})")
    return (looked.join(index.hinted(index.cells), ["level", "cell"])
            .where(f"fence.whole OR {_in_box('fence', lng, lat)}").drop("level", "cell"))


def _zones(candidates: str, x: str, y: str) -> str:
    hit = f"filter({candidates}, f -> {covering('f', x, y)})"
    return f"coalesce(transform({hit}, f -> struct(f.area, f.id, f.name)), {_NO_ZONES})"


def _near(candidates: str, x: str, y: str, metres: float) -> str:
    close = f"filter({candidates}, f -> NOT f.whole AND {_in_box('f', x, y)} AND {geo.boundary_near('flatten(f.parts)', x, y, metres)})"
    return f"coalesce(transform({close}, f -> f.name), {_NO_NAMES})"


_NO_ZONES = "CAST(array() AS array<struct<area:double,id:bigint,name:string>>)"
_NO_NAMES = "CAST(array() AS array<string>)"


def with_zones(points: DataFrame, fences: DataFrame, buffer_m: float | None = None, *,
               lng: str = "lng", lat: str = "lat", row_key: str = "id",
               index: FenceIndex | None = None) -> DataFrame:
    """Adds ``zones``, the fences covering the point as array<struct<area,id,name>> sorted
    by (area, id), and with a buffer also ``near``: the names of the fences whose boundary
    is at most that many metres away, asked only where no fence covers the point."""
    index = index or fence_index(fences, buffer_m or 0.0)
    if index.densest > ARRAY_FENCES and not points.isStreaming:
        return _with_zones_regrouped(points, index, buffer_m, lng, lat, row_key)
    found = points
    names = []
    for n in index.levels:
        cells = (index.cells.where(f"level = {n}").groupBy(F.col("cell").alias(f"_cell{n}"))
                 .agg(F.collect_list("fence").alias(f"_fences{n}")))
        spread = f"-1 - CAST(pmod(hash({row_key}), {_NULL_KEYS}) AS bigint)"
        found = (found.selectExpr("*", f"coalesce({_cell(lng, lat, index.sides[n])}, {spread}) AS _cell{n}")
                 .join(index.hinted(cells), f"_cell{n}", "left"))
        names.append(f"_fences{n}")
    joined = lambda parts, none: f"concat({', '.join(parts)})" if parts else none
    zones = joined([_zones(name, lng, lat) for name in names], _NO_ZONES)
    out = found.selectExpr(*points.columns, f"array_sort({zones}) AS zones", *names)
    if buffer_m is None:
        return out.drop(*names)
    near = joined([_near(name, lng, lat, buffer_m) for name in names], _NO_NAMES)
    return out.selectExpr(*points.columns, "zones",
                          f"CASE WHEN size(zones) = 0 THEN {near} ELSE {_NO_NAMES} END AS near")


def _with_zones_regrouped(points: DataFrame, index: FenceIndex, buffer_m: float | None,
                          lng: str, lat: str, row_key: str) -> DataFrame:
    """The same through (position, fence) pairs, for fences that crowd into few cells. Zones
    depend on the position alone, so each distinct one is looked up once and rows find it by
    position; ids need not be unique. Points without position spread over many keys."""
    known = f"{lng} IS NOT NULL AND {lat} IS NOT NULL"
    spots = points.where(known).selectExpr(f"{lng} AS _x", f"{lat} AS _y").distinct()
    near = "false" if buffer_m is None else geo.boundary_near("flatten(fence.parts)", "_x", "_y", buffer_m)
    found = (candidate_pairs(spots, index, "_x", "_y").selectExpr(
        "_x", "_y", f"CASE WHEN {covering('fence', '_x', '_y')} THEN struct(fence.area, fence.id, fence.name) END AS _zone",
        f"CASE WHEN {near} THEN fence.name END AS _near")
        .where("_zone IS NOT NULL OR _near IS NOT NULL").groupBy("_x", "_y")
        .agg(F.collect_list("_zone").alias("_zones"), F.collect_list("_near").alias("_nears"))
        .withColumn("_spread", F.lit(0)))
    spread = f"CASE WHEN {known} THEN 0 ELSE 1 + pmod(hash({row_key}), {_NULL_KEYS}) END"
    out = (points.selectExpr("*", f"{lng} AS _x", f"{lat} AS _y", f"{spread} AS _spread")
           .join(found, ["_x", "_y", "_spread"], "left").selectExpr(
               *points.columns, f"array_sort(coalesce(_zones, {_NO_ZONES})) AS zones", "_nears"))
    if buffer_m is None:
        return out.drop("_nears")
    return out.selectExpr(*points.columns, "zones",
                          f"CASE WHEN size(zones) = 0 THEN coalesce(_nears, {_NO_NAMES}) ELSE {_NO_NAMES} END AS near")


def chosen_zone(priority: str = "area", zones: str = "zones") -> Column:
    """Name of the zone that counts: the smallest area, or the lowest id; null for none."""
    if priority == "area":
        return F.expr(f"get({zones}, 0).name")
    if priority == "id":
        return F.expr(f"array_min(transform({zones}, z -> struct(z.id, z.name))).name")
    raise ValueError(f"unknown zone priority: {priority!r}")
