"""Explicit schemas and fixed values of the fleet data model."""

from __future__ import annotations

from pyspark.sql import types as T

_S, _D, _L, _TS = T.StringType(), T.DoubleType(), T.LongType(), T.TimestampType()


def _struct(**fields: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(name, dtype) for name, dtype in fields.items()])


POINT = _struct(lng=_D, lat=_D)
RING = T.ArrayType(POINT)

# One GPS message as it travels on the stream (JSON field names).
GPS_EVENT = _struct(vehicleId=_S, lat=_D, lng=_D, speedKph=_D, heading=_D, timestamp=_TS,
                    status=_S, statusColor=_S, message=_S, region=_S)

# One alert message. ``details`` stays JSON text.
ALERT_EVENT = _struct(id=_L, vehicleId=_S, alertType=_S, details=_S, timestamp=_TS, lat=_D, lng=_D)

READING = _struct(id=_L, vehicle_id=_S, lat=_D, lng=_D, location=POINT, speed_kph=_D,
                  heading=_D, event_timestamp=_TS, created_at=_TS)

ALERT = _struct(id=_L, vehicle_id=_S, alert_type=_S, details=_S, detected_at=_TS, lat=_D, lng=_D)

GEOFENCE = _struct(id=_L, name=_S, polygon_geojson=_S, ring=RING, created_at=_TS)

STATUS = _struct(vehicle_id=_S, last_lat=_D, last_lng=_D, last_speed=_D, last_seen=_TS,
                 status=_S, status_updated_at=_TS)

VEHICLE_STATS = _struct(vehicleId=_S, avgSpeed=_D, maxSpeed=_D, totalDistance=_D,
                        readingCount=T.IntegerType(), windowStart=_TS, windowEnd=_TS)

# Everything an alert's JSON details may carry, over all alert types.
ALERT_DETAILS = _struct(speedKph=_D, threshold=_D, excess=_D, geofence=_S, zone=_S, action=_S,
                        overlapping_zones=T.ArrayType(_S), zone_count=T.IntegerType(),
                        idleMinutes=_L, durationMinutes=_L, firstIdleTime=_S, currentSpeed=_D,
                        location=_S, reason=_S)

# Alert types, statuses, thresholds and limits of the fleet domain.
SPEEDING, GEOFENCE_ENTER, GEOFENCE_EXIT, IDLE = "SPEEDING", "GEOFENCE_ENTER", "GEOFENCE_EXIT", "IDLE"
ALERT_TYPES = (SPEEDING, GEOFENCE_ENTER, GEOFENCE_EXIT, IDLE)
STATUS_COLORS = {"ONLINE": "green", "IDLE": "orange", "OFFLINE": "red"}
STATUS_LABELS = {"ONLINE": "Online", "IDLE": "Idle", "OFFLINE": "Offline"}
SPEED_LIMIT_KPH = 80.0
IDLE_SPEED_KPH = 1.0
IDLE_THRESHOLD = "2 minutes"
ZONE_BUFFER_M = 10.0
EARTH_RADIUS_KM = 6371.0
METRES_PER_DEGREE_LNG = 111319.49
METRES_PER_DEGREE_LAT = 110574.0
VEHICLE_ID_LENGTH = 50
UNKNOWN_REGION = "Unknown"
