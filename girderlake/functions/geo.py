"""Projected coordinates to latitude and longitude in degrees, as column arithmetic (M7, M8).

The inverse transverse Mercator is Krueger's series in the third flattening; the datum shift goes over earth-centred
coordinates and back by Bowring's closed formula.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Ellipsoids (semi-major axis in metres, flattening).
WGS84 = (6_378_137.0, 1 / 298.257223563)
BESSEL = (6_377_397.155, 1 / 299.1528128)
#: Shift from the German main network to WGS84: metres, arc seconds, scale.
SHIFT = (598.1, 73.7, 418.2)
TURN = tuple(x * math.pi / 648_000 for x in (0.202, 0.045, -2.455))
SCALE = 1 + 6.7e-6


def series(flattening: float) -> tuple[float, list[float], list[float]]:
    """Krueger's rectifying radius over the axis, and the coefficients of both sums."""
    n = flattening / (2 - flattening)
    radius = (1 + n**2 / 4 + n**4 / 64) / (1 + n)
    beta = [n / 2 - 2 * n**2 / 3 + 37 * n**3 / 96, n**2 / 48 + n**3 / 15, 17 * n**3 / 480]
    delta = [2 * n - 2 * n**2 / 3 - 2 * n**3, 7 * n**2 / 3 - 8 * n**3 / 5, 56 * n**3 / 15]
    return radius, beta, delta


def inverse_mercator(df: DataFrame, ellipsoid: tuple[float, float], scale: float) -> DataFrame:
    """Adds _phi and _lambda, radians, of a transverse Mercator point: _east, _north, _false_east in metres, _meridian in degrees.

    Every step is a projection of its own, so that no expression repeats what one before it has computed.
    """
    axis, flattening = ellipsoid
    radius, beta, delta = series(flattening)
    c = F.col
    df = df.withColumns({"_xi": c("_north") / (scale * axis * radius), "_eta": (c("_east") - c("_false_east")) / (scale * axis * radius)})
    x, y = c("_xi"), c("_eta")
    for j, b in enumerate(beta, 1):
        x = x - b * F.sin(2 * j * c("_xi")) * F.cosh(2 * j * c("_eta"))
        y = y - b * F.cos(2 * j * c("_xi")) * F.sinh(2 * j * c("_eta"))
    df = df.withColumns({"_x": x, "_y": y}).withColumn("_chi", F.asin(F.sin("_x") / F.cosh("_y")))
    latitude = c("_chi")
    for j, d in enumerate(delta, 1):
        latitude = latitude + d * F.sin(2 * j * c("_chi"))
    return df.withColumns({"_phi": latitude, "_lambda": F.radians("_meridian") + F.atan(F.sinh("_y") / F.cos("_x"))})


def _without_steps(df: DataFrame, wanted: list[str]) -> DataFrame:
    return df.select(*wanted, "latitude", "longitude")


def utm(df: DataFrame, east: Column, north: Column, zone: Column) -> DataFrame:
    """M7: ``df`` with latitude and longitude in degrees of a UTM point of the northern hemisphere."""
    made = df.withColumns({"_east": east, "_north": north, "_false_east": F.lit(500_000.0), "_meridian": (zone * 6 - 183).cast("double")})
    made = inverse_mercator(made, WGS84, 0.9996).withColumns({"latitude": F.degrees("_phi"), "longitude": F.degrees("_lambda")})
    return _without_steps(made, df.columns)


def gauss_krueger(df: DataFrame, east: Column, north: Column) -> DataFrame:
    """M8: ``df`` with latitude and longitude in degrees of a Gauss-Krueger point of zones 2 to 5, which its first digit tells."""
    c = F.col
    made = df.withColumns({"_east": east, "_north": north}).withColumn("_zone", F.floor(c("_east") / 1_000_000))
    made = made.withColumns({"_false_east": c("_zone") * 1_000_000.0 + 500_000.0, "_meridian": c("_zone") * 3.0})
    made = inverse_mercator(made, BESSEL, 1.0)
    axis, flattening = BESSEL
    e2 = flattening * (2 - flattening)
    made = made.withColumn("_normal", axis / F.sqrt(1 - e2 * F.sin("_phi") * F.sin("_phi")))
    made = made.withColumns({"_x": c("_normal") * F.cos("_phi") * F.cos("_lambda"), "_y": c("_normal") * F.cos("_phi") * F.sin("_lambda"), "_z": c("_normal") * (1 - e2) * F.sin("_phi")})
    rx, ry, rz = TURN
    x, y, z = c("_x"), c("_y"), c("_z")
    made = made.withColumns({"_x": SHIFT[0] + SCALE * (x - rz * y + ry * z), "_y": SHIFT[1] + SCALE * (rz * x + y - rx * z), "_z": SHIFT[2] + SCALE * (rx * y - ry * x + z)})
    axis, flattening = WGS84
    minor, e2 = axis * (1 - flattening), flattening * (2 - flattening)
    made = made.withColumn("_away", F.hypot("_x", "_y")).withColumn("_theta", F.atan2(c("_z") * axis, c("_away") * minor))
    up, out = c("_z") + e2 / (1 - e2) * minor * F.pow(F.sin("_theta"), 3), c("_away") - e2 * axis * F.pow(F.cos("_theta"), 3)
    made = made.withColumns({"latitude": F.degrees(F.atan2(up, out)), "longitude": F.degrees(F.atan2(c("_y"), c("_x")))})
    return _without_steps(made, df.columns)


def clamped(degrees: Column, most: float) -> Column:
    """null outside of -most to most."""
    return F.when(degrees.between(-most, most), degrees)


def country(text: Column) -> Column:
    """a code of two letters in capitals, Germany by its names, anything else null."""
    x = F.upper(F.trim(text))
    return F.when(F.length(x) == 2, x).when(x.isin("DEUTSCHLAND", "GERMANY", "D"), "DE")
