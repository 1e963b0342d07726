"""Spatial questions about points, alerts and geofences."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fleetlark import schemas as S
from fleetlark.functions import geo
from fleetlark.functions.values import moment
from fleetlark.operators import ordered, zones
from fleetlark.operators.zones import candidate_pairs, chosen_zone, fence_index, with_zones


def covers_join(points: DataFrame, fences: DataFrame) -> DataFrame:
    """Each point with each geofence covering it, boundary included."""
    pairs = candidate_pairs(points, fence_index(fences))
    return (pairs.where(zones.covering("fence", "lng", "lat"))
            .select(*points.columns, F.col("fence.id").alias("fence_id"), F.col("fence.name").alias("fence_name")))


def within_distance_join(points: DataFrame, fences: DataFrame, metres: float) -> DataFrame:
    """Each point with each geofence at most so many metres away; zero inside."""
    pairs = candidate_pairs(points, fence_index(fences, metres))
    distance = zones.distance_m("fence", "lng", "lat")
    return (pairs.withColumn("distance_m", F.expr(distance)).where(F.col("distance_m") <= metres)
            .select(*points.columns, F.col("fence.id").alias("fence_id"), F.col("fence.name").alias("fence_name"),
                    "distance_m"))


def first_zone(points: DataFrame, fences: DataFrame) -> DataFrame:
    """Adds ``zone``: the covering geofence with the lowest id, or null."""
    return assign_zone(points, fences, priority="id")


def assign_zone(points: DataFrame, fences: DataFrame, priority: str = "area") -> DataFrame:
    """Adds ``zone``: one covering geofence per point, or null."""
    return with_zones(points, fences).withColumn("zone", chosen_zone(priority)).drop("zones")


def overlapping_zones(points: DataFrame, fences: DataFrame) -> DataFrame:
    """Points covered by more than one geofence, with all the names."""
    names = F.expr("sort_array(transform(zones, z -> z.name))")
    return (with_zones(points, fences).withColumns({"overlapping_zones": names, "zone_count": F.size("zones")})
            .where("zone_count > 1").drop("zones"))


def alerts_within_radius(alerts: DataFrame, lat: float, lng: float, metres: float,
                         since: str | datetime | Column) -> DataFrame:
    """Alerts at most so many metres from a position, newest first."""
    recent = alerts.where(F.col("detected_at") >= moment(since))
    box = geo.radius_box(lat, lng, metres)
    if box:
        south, north, west, east = box
        recent = recent.where(F.col("lat").between(south, north) & F.col("lng").between(west, east))
    distance = F.expr(geo.haversine_km(f"{float(lat)!r}D", f"{float(lng)!r}D", "lat", "lng")) * 1000
    return (recent.withColumn("distance_m", distance).where(F.col("distance_m") <= metres)
            .orderBy(F.desc("detected_at"), F.desc("id")))


def alerts_within_geofence(alerts: DataFrame, fences: DataFrame, name: str,
                           since: str | datetime | Column) -> DataFrame:
    """Alerts strictly inside the named geofence (or one of that name), newest first; each alert comes once."""
    recent = alerts.where(F.col("detected_at") >= moment(since))
    spots = recent.select("lng", "lat").distinct()
    pairs = candidate_pairs(spots, fence_index(fences.where(F.col("name") == name)))
    inside = pairs.where(zones.strictly_covering("fence", "lng", "lat")).select("lng", "lat")
    return (recent.join(inside, ["lng", "lat"], "leftsemi")
            .select(*alerts.columns).orderBy(F.desc("detected_at"), F.desc("id")))


def leg_distance(readings: DataFrame, large_rows: int | None = None) -> DataFrame:
    """Adds ``leg_km``: the distance from the vehicle's previous point, null at its first."""
    slices = ordered.find_slices(readings, ordered.by_vehicle(large_rows))
    placed = readings.where("lat IS NOT NULL AND lng IS NOT NULL")
    rows = ordered.history(placed, slices).with_previous("_prev", F.struct("lat", "lng")).rows()
    leg = geo.haversine_km("_prev.lat", "_prev.lng", "lat", "lng")
    return rows.withColumn("leg_km", F.expr(leg)).drop("_prev")


def with_region(df: DataFrame, fences: DataFrame, priority: str = "area") -> DataFrame:
    """Adds ``region``: the zone of the point, or Unknown."""
    return (assign_zone(df, fences, priority)
            .withColumn("region", F.coalesce("zone", F.lit(S.UNKNOWN_REGION))).drop("zone"))


def regions(df: DataFrame) -> DataFrame:
    """The regions in use, sorted."""
    return df.select("region").where("region <> ''").distinct().orderBy("region")


def fleet_center(points: DataFrame, lat: str = "lat", lng: str = "lng") -> DataFrame:
    """Mean position."""
    return points.agg(F.avg(lat).alias("center_lat"), F.avg(lng).alias("center_lng"))
