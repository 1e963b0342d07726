"""Geofences from GeoJSON text."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fleetlark.functions.geo import closed

_SHAPE = "type string, coordinates string"
_GEOMETRY = f"{_SHAPE}, geometries array<struct<{_SHAPE}>>"
_GEOJSON = (f"{_GEOMETRY}, geometry struct<{_GEOMETRY}>, features array<struct<geometry: struct<{_GEOMETRY}>>>, "
            "_corrupt_record string")
_POSITIONS = "array<array<array<double>>>"
NOT_JSON, NO_POLYGON, UNREADABLE = "not a JSON object", "no polygon", "coordinates that are not nested lists of numbers"
NO_POSITION, FEW_CORNERS = "a position without two numbers", "a ring of fewer than three corners"


def _shapes() -> str:
    """All geometries of a document ``d`` with coordinates, of the document itself, its geometry, its
    features, and collections of geometries in each, as array<struct<type,coordinates>>."""
    own = lambda at: f"concat(array(struct({at}.type AS type, {at}.coordinates AS coordinates)), coalesce({at}.geometries, array()))"
    features = f"coalesce(flatten(transform(d.features, f -> {own('f.geometry')})), array())"
    return f"filter(concat({own('d')}, {own('d.geometry')}, {features}), g -> g.coordinates IS NOT NULL)"


def _read_polygons(texts: DataFrame) -> DataFrame:
    """Adds ``polygons`` (array of arrays of closed rings) or, where a text is refused, ``reason``."""
    many = f"from_json(g.coordinates, 'array<{_POSITIONS}>')"
    one = f"from_json(g.coordinates, '{_POSITIONS}')"
    raw = f"CASE WHEN g.type = 'MultiPolygon' THEN {many} WHEN coalesce(g.type, 'Polygon') = 'Polygon' THEN array({one}) ELSE array() END"
    corner = "struct(get(p, 0) AS lng, get(p, 1) AS lat)"
    # Positions are looked at by a lambda of their own: closing a ring of unknown positions would hide them.
    ring = f"transform(array(transform(r, p -> {corner})), ring -> CASE WHEN size(ring) > 0 THEN {closed('ring')} ELSE ring END)[0]"
    broken = "exists(polygons, poly -> poly IS NULL OR size(poly) = 0 OR exists(poly, r -> r IS NULL))"
    unplaced = ("exists(polygons, poly -> exists(poly, r -> exists(r, p -> p.lng IS NULL OR p.lat IS NULL"
                " OR isnan(p.lng) OR isnan(p.lat) OR abs(p.lng) = double('infinity') OR abs(p.lat) = double('infinity'))))")
    reason = (f"CASE WHEN polygon_geojson IS NULL OR _document._corrupt_record IS NOT NULL OR _document IS NULL THEN '{NOT_JSON}'"
              f" WHEN polygons IS NULL OR {broken} THEN '{UNREADABLE}' WHEN size(polygons) = 0 THEN '{NO_POLYGON}'"
              f" WHEN {unplaced} THEN '{NO_POSITION}' WHEN exists(polygons, poly -> exists(poly, r -> size(r) < 4)) THEN '{FEW_CORNERS}' END")
    return (texts.withColumn("_document", F.expr(f"from_json(polygon_geojson, '{_GEOJSON}')"))
            .withColumn("polygons", F.expr(f"flatten(transform(array(_document), d -> flatten(transform({_shapes()}, g -> {raw}))))"))
            .withColumn("polygons", F.expr(f"transform(polygons, poly -> transform(poly, r -> {ring}))"))
            .withColumn("reason", F.expr(reason)).drop("_document"))


def load_geofences(texts: DataFrame) -> DataFrame:
    """Geofences with their polygons and the closed outer ring of the first one.

    ``texts`` has ``id``, ``name`` and ``polygon_geojson``: a Polygon or MultiPolygon, bare, as a Feature, in a
    FeatureCollection or in a GeometryCollection. ``polygons`` holds all of them, each the outer ring and then its
    holes; a fence is where at least one of its polygons is. Other geometries are passed over. A text of which
    anything cannot be used is refused as a whole: ``ring`` and ``polygons`` are null (see ``refused_geofences``).
    """
    valid = F.col("reason").isNull()
    return (_read_polygons(texts).withColumn("polygons", F.when(valid, F.col("polygons")))
            .withColumn("ring", F.expr("get(get(polygons, 0), 0)")).drop("reason")
            .select(*[c for c in texts.columns if c not in ("ring", "polygons")], "ring", "polygons"))


def refused_geofences(texts: DataFrame) -> DataFrame:
    """Rows ``(id, name, reason)`` of the texts that ``load_geofences`` refuses."""
    return _read_polygons(texts).where("reason IS NOT NULL").select("id", "name", "reason")


def require_unique_names(fences: DataFrame) -> DataFrame:
    """Fails the job when two geofences share a name: zone state is kept by name. Geofences without a name stay."""
    clash = F.raise_error(F.concat(F.lit("geofence name is not unique: "), F.col("name")))
    names = fences.where("name IS NOT NULL").groupBy("name").agg(F.count(F.lit(1)).alias("uses")).select(
        "name", F.when(F.col("uses") > 1, clash).otherwise(F.lit(True)).alias("unique"))
    return fences.join(names, "name", "left").where("unique OR name IS NULL").select(*fences.columns)


def geofence_rings(fences: DataFrame) -> DataFrame:
    """Geofences as nested coordinate lists for maps: [[[lng, lat], ...]]."""
    return fences.selectExpr("id", "name", "array(transform(ring, p -> array(p.lng, p.lat))) AS coordinates")
