"""Distances on the globe and straight-hole geometry."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from stratalog.functions import fixed
from stratalog.functions.text import _c


def great_circle_km(lat1, lon1, lat2, lon2, radius: float = fixed.EARTH_RADIUS_KM) -> Column:
    a_lat, a_lon, b_lat, b_lon = (F.radians(_c(x)) for x in (lat1, lon1, lat2, lon2))
    h = F.pow(F.sin((b_lat - a_lat) / 2), 2) + F.cos(a_lat) * F.cos(b_lat) * F.pow(F.sin((b_lon - a_lon) / 2), 2)
    # not least(): it would skip a null and turn an unknown position into a distance
    return F.lit(2 * radius) * F.asin(F.sqrt(F.when(h > 1.0, F.lit(1.0)).otherwise(h)))


def usable_position(lat, lon) -> Column:
    """True for coordinates in range; 0 is what an empty header holds and counts as missing."""
    y, x = _c(lat).try_cast("double"), _c(lon).try_cast("double")
    return F.coalesce((y != 0) & (x != 0) & F.abs(y).between(0, 90) & F.abs(x).between(0, 180), F.lit(False))


def unit_vector(lat, lon) -> tuple[Column, Column, Column]:
    y, x = F.radians(_c(lat)), F.radians(_c(lon))
    return F.cos(y) * F.cos(x), F.cos(y) * F.sin(x), F.sin(y)


def offset_at(depth, inclination, azimuth) -> Column:
    """struct(east_m, north_m, tvd_m) at a measured depth of a straight hole."""
    d, dip = _c(depth).cast("double"), F.radians(F.abs(_c(inclination).cast("double")))
    bearing = F.radians(F.coalesce(_c(azimuth).cast("double"), F.lit(0.0)))
    flat = d * F.cos(dip)
    return F.struct(
        (flat * F.sin(bearing)).alias("east_m"), (flat * F.cos(bearing)).alias("north_m"), (d * F.sin(dip)).alias("tvd_m")
    )


def position_at(depth, lat, lon, elevation, inclination, azimuth, stretch: float = 1.0) -> Column:
    """struct(lon, lat, altitude_m) at a measured depth; signed inclination, -90 is straight down."""
    d, dip, bearing = _c(depth).cast("double"), F.radians(_c(inclination)), F.radians(_c(azimuth))
    flat = d * F.cos(dip)
    per_lon = F.lit(fixed.METRES_PER_DEGREE_LAT) * F.cos(F.radians(_c(lat)))
    return F.struct(
        (_c(lon) + flat * F.sin(bearing) / per_lon).alias("lon"),
        (_c(lat) + flat * F.cos(bearing) / fixed.METRES_PER_DEGREE_LAT).alias("lat"),
        (F.coalesce(_c(elevation).cast("double"), F.lit(0.0)) + d * F.sin(dip) * stretch).alias("altitude_m"),
    )


def trace_depths(length, step: float) -> Column:
    """array of depths 0, step, 2*step ... below the length, and always the length itself."""
    end = _c(length).cast("double")
    count = F.ceil(end / step).cast("int")
    inner = F.transform(F.sequence(F.lit(0), F.greatest(count - 1, F.lit(0))), lambda i: i * F.lit(float(step)))
    return F.when(end > 0, F.concat(inner, F.array(end)))
