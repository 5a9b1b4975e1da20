"""WGS84 positions in a local east-north-up frame, closed form."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The WGS84 ellipsoid.
A, FLAT = 6378137.0, 1 / 298.257223563
E2 = FLAT * (2 - FLAT)
B = A * (1 - FLAT)


def _ecef(lat: Column, lon: Column, alt: Column) -> tuple[Column, Column, Column]:
    s, c = F.sin(F.radians(lat)), F.cos(F.radians(lat))
    n = F.lit(A) / F.sqrt(1 - F.lit(E2) * s * s)
    return (n + alt) * c * F.cos(F.radians(lon)), (n + alt) * c * F.sin(F.radians(lon)), (n * (1 - E2) + alt) * s


def enu(lat: Column, lon: Column, alt: Column, lat0: Column, lon0: Column, alt0: Column) -> tuple[Column, Column, Column]:
    """Metres east, north and up of the origin; NULL in, NULL out."""
    x, y, z = (p - q for p, q in zip(_ecef(lat, lon, alt), _ecef(lat0, lon0, alt0)))
    sa, ca, so, co = F.sin(F.radians(lat0)), F.cos(F.radians(lat0)), F.sin(F.radians(lon0)), F.cos(F.radians(lon0))
    return co * y - so * x, ca * z - sa * (co * x + so * y), sa * z + ca * (co * x + so * y)


def with_geodetic(df: DataFrame, e: Column, n: Column, u: Column, lat0: Column, lon0: Column, alt0: Column) -> DataFrame:
    """The way back: adds lat_deg, lon_deg and height_m, by Bowring's formula; exact to micrometres near the ground.

    Steps are columns of their own, so that none is worked out twice.
    """
    sa, ca, so, co = F.sin(F.radians(lat0)), F.cos(F.radians(lat0)), F.sin(F.radians(lon0)), F.cos(F.radians(lon0))
    x0, y0, z0 = _ecef(lat0, lon0, alt0)
    d = df.withColumns({"__x": x0 - so * e - sa * co * n + ca * co * u, "__y": y0 + co * e - sa * so * n + ca * so * u, "__z": z0 + ca * n + sa * u})
    x, y, z, p, ep2 = F.col("__x"), F.col("__y"), F.col("__z"), F.col("__p"), (A * A - B * B) / (B * B)
    d = d.withColumn("__p", F.sqrt(x * x + y * y)).withColumn("__b", F.atan2(z * A, p * B))
    s, c = F.sin("__b"), F.cos("__b")
    d = d.withColumn("__lat", F.atan2(z + F.lit(ep2 * B) * s * s * s, p - F.lit(E2 * A) * c * c * c))
    sl = F.sin("__lat")
    height = p * F.cos("__lat") + z * sl - F.lit(A) * F.sqrt(1 - F.lit(E2) * sl * sl)
    return d.withColumns({"lat_deg": F.degrees("__lat"), "lon_deg": F.degrees(F.atan2(y, x)), "height_m": height}).drop("__x", "__y", "__z", "__p", "__b", "__lat")


def utm_epsg(lat: Column, lon: Column) -> Column:
    """EPSG code of the UTM zone, with the exceptions of Norway and Svalbard; NULL beyond 80 south and 84 north."""
    plain = F.least(F.floor((lon + 180) / 6) + 1, F.lit(60)).cast("int")
    zone = (
        F.when((lat >= 56) & (lat < 64) & (lon >= 3) & (lon < 12), 32)
        .when((lat >= 72) & (lon >= 0) & (lon < 9), 31).when((lat >= 72) & (lon >= 9) & (lon < 21), 33)
        .when((lat >= 72) & (lon >= 21) & (lon < 33), 35).when((lat >= 72) & (lon >= 33) & (lon < 42), 37).otherwise(plain)
    )
    return F.when((lat >= -80) & (lat <= 84) & lon.between(-180, 180), F.when(lat >= 0, 32600).otherwise(32700) + zone)


def utm_forward(lat: Column, lon: Column, zone: Column) -> tuple[Column, Column]:
    """Easting and northing in metres in a UTM zone (northings of the south from 10,000 km), by the Gauss-Krueger series to the third order: to a millimetre inside a zone."""
    n = FLAT / (2 - FLAT)
    mean = A / (1 + n) * (1 + n**2 / 4 + n**4 / 64)
    series = (n / 2 - 2 * n**2 / 3 + 5 * n**3 / 16, 13 * n**2 / 48 - 3 * n**3 / 5, 61 * n**3 / 240)
    e = math.sqrt(E2)
    s, d = F.sin(F.radians(lat)), F.radians(lon - (zone * 6 - 183))
    t = F.sinh(F.atanh(s) - e * F.atanh(e * s))
    xi, eta = F.atan2(t, F.cos(d)), F.atanh(F.sin(d) / F.sqrt(1 + t * t))
    east = sum((c * F.cos(2 * k * xi) * F.sinh(2 * k * eta) for k, c in enumerate(series, 1)), eta)
    north = sum((c * F.sin(2 * k * xi) * F.cosh(2 * k * eta) for k, c in enumerate(series, 1)), xi)
    return 500_000 + 0.9996 * mean * east, F.when(lat < 0, 10_000_000.0).otherwise(0.0) + 0.9996 * mean * north


def utm_forward_sql(lat: str, lon: str, zone: str) -> tuple[str, str]:
    """utm_forward() as SQL text over a row with lat, lon and zone; DuckDB lacks some hyperbolic functions, so they are written out."""
    n = FLAT / (2 - FLAT)
    mean = A / (1 + n) * (1 + n**2 / 4 + n**4 / 64)
    series = (n / 2 - 2 * n**2 / 3 + 5 * n**3 / 16, 13 * n**2 / 48 - 3 * n**3 / 5, 61 * n**3 / 240)
    e = math.sqrt(E2)
    atanh, sinh, cosh = (lambda x: f"(0.5 * ln((1 + {x}) / (1 - {x})))"), (lambda x: f"((exp({x}) - exp(-({x}))) / 2)"), (lambda x: f"((exp({x}) + exp(-({x}))) / 2)")
    s, d = f"sin(radians({lat}))", f"radians({lon} - ({zone} * 6 - 183))"
    t = sinh(f"({atanh(s)} - {e!r} * {atanh(f'({e!r} * {s})')})")
    xi, eta = f"atan2({t}, cos({d}))", atanh(f"(sin({d}) / sqrt(1 + {t} * {t}))")
    east = " + ".join([eta, *(f"{c!r} * cos({2 * k} * {xi}) * {sinh(f'({2 * k} * {eta})')}" for k, c in enumerate(series, 1))])
    north = " + ".join([xi, *(f"{c!r} * sin({2 * k} * {xi}) * {cosh(f'({2 * k} * {eta})')}" for k, c in enumerate(series, 1))])
    return f"(500000 + {0.9996 * mean!r} * ({east}))", f"(CASE WHEN {lat} < 0 THEN 10000000.0 ELSE 0.0 END + {0.9996 * mean!r} * ({north}))"


def wrap_degrees(a: Column) -> Column:
    """An angle in [-180, 180)."""
    return F.pmod(a + 180, F.lit(360.0)) - 180


def enu_sql(lat: str, lon: str, alt: str, lat0: str, lon0: str, alt0: str) -> tuple[str, str, str]:
    """enu() as SQL text."""

    def ecef(la: str, lo: str, al: str) -> tuple[str, str, str]:
        s, c = f"sin(radians({la}))", f"cos(radians({la}))"
        n = f"({A!r} / sqrt(1 - {E2!r} * {s} * {s}))"
        return f"(({n} + {al}) * {c} * cos(radians({lo})))", f"(({n} + {al}) * {c} * sin(radians({lo})))", f"(({n} * (1 - {E2!r}) + {al}) * {s})"

    x, y, z = (f"({p} - {q})" for p, q in zip(ecef(lat, lon, alt), ecef(lat0, lon0, alt0)))
    sa, ca, so, co = f"sin(radians({lat0}))", f"cos(radians({lat0}))", f"sin(radians({lon0}))", f"cos(radians({lon0}))"
    return f"({co} * {y} - {so} * {x})", f"({ca} * {z} - {sa} * ({co} * {x} + {so} * {y}))", f"({sa} * {z} + {ca} * ({co} * {x} + {so} * {y}))"


assert math.isclose(B, 6356752.314245179)
