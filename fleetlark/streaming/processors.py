"""Stateful detection per vehicle for streams.

Readings of a vehicle are taken in event-time order: sorted within a micro-batch, and a
reading older than one already taken comes out as a LATE row instead of changing state. One marked
``early``, being dated in the future, comes out as an EARLY row and changes nothing either, so that it makes no later one late.
The memory a vehicle needs is bounded by the micro-batch, so sources must limit it
(``maxBytesPerTrigger``, ``maxOffsetsPerTrigger``; the readers in ``jobs`` do). Instants travel as microseconds.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Row
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from fleetlark import schemas as S

LATE, EARLY = "LATE", "EARLY"

FOUND = ("id long, vehicle_id string, alert_type string, at long, lat double, lng double, speed_kph double, "
         "zone string, action string, overlapping_zones array<string>, first_idle_us long, idle_minutes long")
_FOUND_NAMES = [part.split()[0] for part in FOUND.split(", ")]


def _found(row: Row, alert_type: str, **values) -> Row:
    known = {"id": row.id, "vehicle_id": row.vehicle_id, "alert_type": alert_type, "at": row.at, "lat": row.lat,
             "lng": row.lng, "speed_kph": row.speed_kph, **values}
    return Row(**{name: known.get(name) for name in _FOUND_NAMES})


class OrderedProcessor(StatefulProcessor):
    """Feeds a vehicle's rows (with ``at``, ``id`` and ``early``) in order to ``take``."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self._seen = handle.getValueState("seen", "at long, id long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        seen = tuple(self._seen.get()) if self._seen.exists() else None
        self.load()
        for row in sorted(rows, key=lambda r: (r.at, r.id)):
            place = (row.at, row.id)
            if row.early:
                yield from self.early(row)
            elif seen is not None and place <= seen:
                yield from self.late(row)
            else:
                seen = place
                yield from self.take(row)
        if seen is not None:
            self._seen.update(seen)
        self.save()

    def load(self) -> None: ...

    def save(self) -> None: ...

    def take(self, row: Row) -> Iterator[Row]: ...

    def late(self, row: Row) -> Iterator[Row]: ...

    def early(self, row: Row) -> Iterator[Row]: ...

    def close(self) -> None: ...


class AlertProcessor(OrderedProcessor):
    """Idle and geofence alerts, and with a speed limit speeding alerts, in one pass over a vehicle's readings.

    Rows also carry ``raw_zone`` (the zone covering the point, or null), ``near`` (names of
    zones within the buffer) and ``overlapping_zones``.
    """

    def __init__(self, idle_us: int, idle_speed: float, speed_limit: float | None = None) -> None:
        self._idle_us, self._idle_speed, self._speed_limit = idle_us, idle_speed, speed_limit

    def init(self, handle: StatefulProcessorHandle) -> None:
        super().init(handle)
        self._zone_state = handle.getValueState("zone", "name string")
        self._idle_state = handle.getValueState("idle", "start long, told boolean")

    def load(self) -> None:
        self._zone = self._zone_state.get()[0] if self._zone_state.exists() else None
        self._start, self._told = self._idle_state.get() if self._idle_state.exists() else (None, False)

    def save(self) -> None:
        for state, value in ((self._zone_state, (self._zone,)), (self._idle_state, (self._start, self._told))):
            if value[0] is None:
                state.clear()
            else:
                state.update(value)

    def late(self, row: Row) -> Iterator[Row]:
        yield _found(row, LATE)
        yield from self._speeding(row)

    def early(self, row: Row) -> Iterator[Row]:
        yield _found(row, EARLY)

    def _speeding(self, row: Row) -> Iterator[Row]:
        if self._speed_limit is not None and row.speed_kph is not None and row.speed_kph > self._speed_limit:
            yield _found(row, S.SPEEDING)

    def take(self, row: Row) -> Iterator[Row]:
        yield from self._speeding(row)
        yield from self._take_speed(row)
        yield from self._take_position(row)

    def _take_speed(self, row: Row) -> Iterator[Row]:
        if row.speed_kph is None:
            return
        if row.speed_kph > self._idle_speed:
            self._start, self._told = None, False
            return
        if self._start is None:
            self._start = row.at
        if not self._told and row.at - self._start >= self._idle_us:
            self._told = True
            yield _found(row, S.IDLE, first_idle_us=self._start, idle_minutes=self._idle_us // 60_000_000)

    def _take_position(self, row: Row) -> Iterator[Row]:
        if row.lat is None or row.lng is None:
            return
        before = self._zone
        self._zone = row.raw_zone or (before if before in (row.near or ()) else None)
        if self._zone == before:
            return
        entered = self._zone is not None
        yield _found(row, S.GEOFENCE_ENTER if entered else S.GEOFENCE_EXIT, zone=self._zone if entered else before,
                     action="entered" if entered else "exited", overlapping_zones=row.overlapping_zones)


LEGS = "vehicle_id string, event_timestamp timestamp, speed double, lat0 double, lng0 double, lat double, lng double, late boolean"


class LegProcessor(OrderedProcessor):
    """Each reading with the vehicle's previous position, where that lies in the same window."""

    def __init__(self, window_us: int) -> None:
        self._window_us = window_us

    def init(self, handle: StatefulProcessorHandle) -> None:
        super().init(handle)
        self._last_state = handle.getValueState("last", "slot long, lat double, lng double")

    def load(self) -> None:
        self._last = tuple(self._last_state.get()) if self._last_state.exists() else None

    def save(self) -> None:
        if self._last is not None:
            self._last_state.update(self._last)

    def take(self, row: Row) -> Iterator[Row]:
        slot = row.at // self._window_us
        same = self._last is not None and self._last[0] == slot
        lat0, lng0 = self._last[1:] if same else (None, None)
        self._last = (slot, row.lat, row.lng)
        yield self._leg(row, lat0, lng0, False)

    def late(self, row: Row) -> Iterator[Row]:
        # Counted in its window, but without a leg: its neighbours have already been taken.
        yield self._leg(row, None, None, True)

    @staticmethod
    def _leg(row: Row, lat0: float | None, lng0: float | None, late: bool) -> Row:
        return Row(vehicle_id=row.vehicle_id, event_timestamp=row.event_timestamp, speed=row.speed_kph or 0.0,
                   lat0=lat0, lng0=lng0, lat=row.lat, lng=row.lng, late=late)
