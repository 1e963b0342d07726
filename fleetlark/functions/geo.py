"""Plane and sphere geometry as native expressions.

Expressions over polygons are SQL text: they nest lambdas, and a text reaches the JVM in
one call where a Column tree takes hundreds. Arguments named ``ring``, ``edges``, ``x`` and
``y`` are SQL expressions. A ring is array<struct<lng,lat>>, edges are
array<struct<x1,y1,x2,y2>>. A polygon is an array of rings, the outer one first; the edges of
all its rings together are one edge set, in which holes are outside by the even-odd test.
"""

from __future__ import annotations

import math

from fleetlark.schemas import EARTH_RADIUS_KM, METRES_PER_DEGREE_LAT, METRES_PER_DEGREE_LNG

# Areas are compared to this many decimals of a square degree.
AREA_DECIMALS = 12
# Boxes grow by this much more than a margin asks for, so that rounding loses nothing.
_SLACK = 1.001


def haversine_km(lat1: str, lng1: str, lat2: str, lng2: str) -> str:
    """Great-circle distance in kilometres, as SQL text."""
    half = lambda a, b: f"pow(sin(radians({b} - {a}) / 2), 2)"
    a = f"({half(lat1, lat2)} + cos(radians({lat1})) * cos(radians({lat2})) * {half(lng1, lng2)})"
    return f"({2 * EARTH_RADIUS_KM}D * atan2(sqrt({a}), sqrt(greatest(0D, 1 - {a}))))"


def radius_box(lat: float, lng: float, metres: float) -> tuple[float, float, float, float] | None:
    """(south, north, west, east) holding every point within the radius; None near a pole
    or the date line, where no such box of plain ranges exists."""
    angle = metres / (EARTH_RADIUS_KM * 1000) * (1 + 1e-9)
    south, north = lat - math.degrees(angle), lat + math.degrees(angle)
    if south <= -90 or north >= 90:
        return None
    reach = math.degrees(math.asin(min(1.0, math.sin(angle) / math.cos(math.radians(lat)))))
    if lng - reach < -180 or lng + reach > 180:
        return None
    return south, north, lng - reach, lng + reach


def closed(ring: str) -> str:
    """The ring with its first vertex repeated at the end, unless it already is. The lambda
    names the ring, so that its expression is not repeated."""
    return (f"transform(array({ring}), r -> CASE WHEN r[0] = element_at(r, -1) THEN r "
            "ELSE concat(r, array(r[0])) END)[0]")


def ring_edges(ring: str) -> str:
    """Edges of a closed ring."""
    return (f"zip_with(slice({ring}, 1, size({ring}) - 1), slice({ring}, 2, size({ring}) - 1), (p, q) -> "
            "struct(p.lng AS x1, p.lat AS y1, q.lng AS x2, q.lat AS y2))")


def polygon_edges(polygon: str) -> str:
    """Edges of all rings of a polygon."""
    return f"flatten(transform({polygon}, ring -> {ring_edges('ring')}))"


def polygons_area(polygons: str) -> str:
    """Area in square degrees of some polygons, holes taken off; where polygons overlap, both count."""
    ring_area = f"transform(array({ring_edges('ring')}), edges -> {edges_area('edges')})[0]"
    sizes = f"transform(polygon, ring -> {ring_area})"
    return (f"aggregate(transform({polygons}, polygon -> aggregate({sizes}, CAST(NULL AS double), "
            "(left, size) -> coalesce(left - size, size))), 0D, (total, size) -> total + size)")


def edges_area(edges: str) -> str:
    """Area in square degrees; coordinates are taken relative to the first vertex."""
    dx, dy = f"{edges}[0].x1", f"{edges}[0].y1"
    return (f"round(abs(aggregate({edges}, 0D, (acc, e) -> acc + (e.x1 - {dx}) * (e.y2 - {dy})"
            f" - (e.x2 - {dx}) * (e.y1 - {dy}))) / 2, {AREA_DECIMALS})")


def on_edges(edges: str, x: str, y: str) -> str:
    """True where the point lies on one of the edges: exactly, in double arithmetic. That
    holds for edges along the axes; on a sloped edge few doubles qualify."""
    return (f"exists({edges}, e -> {x} BETWEEN least(e.x1, e.x2) AND greatest(e.x1, e.x2)"
            f" AND {y} BETWEEN least(e.y1, e.y2) AND greatest(e.y1, e.y2)"
            f" AND (e.x2 - e.x1) * ({y} - e.y1) - (e.y2 - e.y1) * ({x} - e.x1) = 0)")


def inside_edges(edges: str, x: str, y: str) -> str:
    """Even-odd test: a ray to the east crosses an odd number of edges."""
    return (f"(size(filter({edges}, e -> (e.y1 > {y}) != (e.y2 > {y})"
            f" AND {x} < (e.x2 - e.x1) * ({y} - e.y1) / (e.y2 - e.y1) + e.x1)) % 2 = 1)")


def covers(edges: str, x: str, y: str) -> str:
    """Interior or boundary."""
    return f"({inside_edges(edges, x, y)} OR {on_edges(edges, x, y)})"


def strictly_within(edges: str, x: str, y: str) -> str:
    """Interior only."""
    return f"({inside_edges(edges, x, y)} AND NOT {on_edges(edges, x, y)})"


def edge_distance_m(edges: str, x: str, y: str) -> str:
    """Metres from the point to the nearest edge, in a plane tangent at the point; null
    without edges.

    The steps are separate transforms, each naming its values: in one expression every use
    of an intermediate value would repeat its whole tree.
    """
    scale = f"(cos(radians({y})) * {METRES_PER_DEGREE_LNG}D)"
    lat_scale = f"{METRES_PER_DEGREE_LAT}D"
    placed = (f"transform({edges}, e -> named_struct('ax', (e.x1 - {x}) * s, 'ay', (e.y1 - {y}) * {lat_scale},"
              f" 'dx', (e.x2 - e.x1) * s, 'dy', (e.y2 - e.y1) * {lat_scale}))")
    measured = (f"transform({placed}, v -> named_struct('ax', v.ax, 'ay', v.ay, 'dx', v.dx, 'dy', v.dy,"
                " 'along', -(v.ax * v.dx + v.ay * v.dy), 'length2', v.dx * v.dx + v.dy * v.dy))")
    footed = (f"transform({measured}, v -> named_struct('ax', v.ax, 'ay', v.ay, 'dx', v.dx, 'dy', v.dy,"
              " 'share', CASE WHEN v.length2 = 0 OR v.along <= 0 THEN 0D"
              " WHEN v.along >= v.length2 THEN 1D ELSE v.along / v.length2 END))")
    offset = f"transform({footed}, v -> named_struct('px', v.ax + v.share * v.dx, 'py', v.ay + v.share * v.dy))"
    nearest = f"sqrt(array_min(transform({offset}, v -> v.px * v.px + v.py * v.py)))"
    return f"transform(array({scale}), s -> {nearest})[0]"


def boundary_near(edges: str, x: str, y: str, metres: float) -> str:
    """Some edge is at most so many metres away; edges are first picked by their grown boxes."""
    pad_y = f"{metres / METRES_PER_DEGREE_LAT * _SLACK!r}D"
    pad_x = f"({metres * _SLACK!r}D / (cos(radians({y})) * {METRES_PER_DEGREE_LNG}D))"
    picked = (f"filter({edges}, e -> least(e.y1, e.y2) <= {y} + {pad_y} AND greatest(e.y1, e.y2) >= {y} - {pad_y}"
              f" AND least(e.x1, e.x2) <= {x} + pad AND greatest(e.x1, e.x2) >= {x} - pad)")
    # The lambda names the eastward pad, so that it is not worked out again for every edge.
    return f"transform(array({pad_x}), pad -> {edge_distance_m(picked, x, y)} <= {float(metres)!r}D)[0]"


def grown_box(metres: float) -> tuple[str, str]:
    """Degrees (of longitude, of latitude) by which a box with sides ``south`` and ``north``
    must grow to hold all points within the distance."""
    pad_y = metres / METRES_PER_DEGREE_LAT * _SLACK
    widest = f"least(89D, greatest(abs(south), abs(north)) + {pad_y!r}D)"
    return f"({metres * _SLACK!r}D / (cos(radians({widest})) * {METRES_PER_DEGREE_LNG}D))", f"{pad_y!r}D"
