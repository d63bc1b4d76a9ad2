"""Distances and angles on the sphere, as Column expressions (degrees in, degrees or lengths out)."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

EARTH_M = 6371000.0

#: Metres to a unit, for results in that unit.
FROM_METRES = {"m": 1.0, "km": 1e-3, "ft": 3.28084, "mi": 0.000621371}
#: A unit's length in kilometres, as a divisor.
PER_KM = {"km": 1.0, "m": 1000.0, "ft": 3280.84, "mi": 0.621371, "nm": 0.5399568}


def haversine(lat1: Column, lat2: Column, lon1: Column, lon2: Column, units: str = "m") -> Column:
    """Great-circle distance.  The order is lat, lat, lon, lon; an unknown unit means metres."""
    a, b = F.radians(lat1), F.radians(lat2)
    h = F.pow(F.sin((b - a) / 2), 2.0) + F.cos(a) * F.cos(b) * F.pow(F.sin((F.radians(lon2) - F.radians(lon1)) / 2), 2.0)
    h = F.least(h, F.lit(1.0))
    return 2 * F.atan2(F.sqrt(h), F.sqrt(1 - h)) * F.lit(EARTH_M * FROM_METRES.get(units.lower(), 1.0))


def dist2lat(d: Column, units: str = "km", radius_km: float = 6371.0) -> Column:
    """Degrees of latitude that a meridional distance spans."""
    return F.degrees(d / F.lit(PER_KM[units.lower()]) / F.lit(radius_km))


def dist2long(d: Column, lat1: Column, lat2: Column, units: str = "km", radius_km: float = 6371.0) -> Column:
    """Degrees of longitude between points of two latitudes at a distance; null where none is so near."""
    a, b = F.radians(lat1), F.radians(lat2)
    c = d / F.lit(PER_KM[units.lower()]) / F.lit(radius_km)
    x = (F.pow(F.sin(c / 2), 2.0) - F.pow(F.sin((b - a) / 2), 2.0)) / (F.cos(a) * F.cos(b))
    return F.when((x >= 0) & (x <= 1), F.degrees(2 * F.asin(F.sqrt(F.when((x >= 0) & (x <= 1), x)))))


def add_lat(lat: Column, change: Column) -> Column:
    """Latitude after a change, turned back at a pole; the longitude isn't shifted."""
    to = lat + change
    return F.when(to > 90, 180 - to).when(to < -90, -180 - to).otherwise(to)


def add_long(lon: Column, change: Column, negative: bool = True) -> Column:
    """Longitude after a change, kept to -180..180, or 0..360."""
    to = lon + change
    high, low = (180.0, -180.0) if negative else (360.0, 0.0)
    return F.when(to > high, to - 360).when(to < low, to + 360).otherwise(to)


def rotate(x: Column, y: Column, phi: Column) -> tuple[Column, Column]:
    """Coordinates turned by phi radians around the origin, clockwise."""
    return x * F.cos(phi) + y * F.sin(phi), y * F.cos(phi) - x * F.sin(phi)


def direction_from(u: Column, v: Column, degrees: bool = True) -> Column:
    """Where a motion comes from, in (0, 360] clockwise from north; 0 without motion."""
    turn = F.lit(90.0) - F.degrees(F.atan2(0.0 - v, 0.0 - u))
    turn = F.when((u == 0) & (v == 0), F.lit(0.0)).when(turn <= 0, turn + 360).otherwise(turn)
    return turn if degrees else F.radians(turn)


def in_box(lat: Column, lon: Column, south: float, north: float, west: float, east: float) -> Column:
    """Inside a latitude-longitude box; one that crosses the antimeridian has west > east."""
    across = (lon >= west) | (lon <= east) if west > east else (lon >= west) & (lon <= east)
    return (lat >= south) & (lat <= north) & across


def space_cell(lat: Column, lon: Column, km: float) -> list[Column]:
    """The cube of side ``km`` around the Earth's centre's axes that a point is in; no pole or date line is special."""
    a, b = F.radians(lat), F.radians(lon)
    return [F.floor(c * (EARTH_M / 1000 / km)).cast("int") for c in (F.cos(a) * F.cos(b), F.cos(a) * F.sin(b), F.sin(a))]


def near_cells(cell: list[Column]) -> Column:
    """The cube and its 26 neighbours, one a row, as structs (cx, cy, cz): all points within ``km`` are in these."""
    steps = [F.struct(*[(c + d).alias(n) for c, d, n in zip(cell, shift, ("cx", "cy", "cz"), strict=True)]) for shift in ((i, j, k) for i in (-1, 0, 1) for j in (-1, 0, 1) for k in (-1, 0, 1))]
    return F.explode(F.array(*steps))
