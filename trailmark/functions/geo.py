"""Projection and grid arithmetic as Column expressions."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

#: WGS 84 and the universal transverse Mercator grid.
A, FLATTENING, K0, EAST0, SOUTH0 = 6378137.0, 1 / 298.257223563, 0.9996, 500000.0, 10000000.0


def _series() -> tuple[float, float, list[float], list[float]]:
    """Rectifying radius, eccentricity, and the coefficients of the forward and inverse series in the third flattening."""
    n = FLATTENING / (2 - FLATTENING)
    radius = A / (1 + n) * (1 + n**2 / 4 + n**4 / 64)
    forward = [n / 2 - 2 * n**2 / 3 + 5 * n**3 / 16 + 41 * n**4 / 180, 13 * n**2 / 48 - 3 * n**3 / 5 + 557 * n**4 / 1440, 61 * n**3 / 240 - 103 * n**4 / 140, 49561 * n**4 / 161280]
    inverse = [n / 2 - 2 * n**2 / 3 + 37 * n**3 / 96 - n**4 / 360, n**2 / 48 + n**3 / 15 - 437 * n**4 / 1440, 17 * n**3 / 480 - 37 * n**4 / 840, 4397 * n**4 / 161280]
    return radius, math.sqrt(FLATTENING * (2 - FLATTENING)), forward, inverse


def zone_of(epsg: int) -> tuple[int, bool]:
    """Zone, and whether it's in the south, of EPSG 326zz or 327zz."""
    if not 32601 <= epsg <= 32660 and not 32701 <= epsg <= 32760:
        raise ValueError(f"EPSG {epsg} is no zone of the transverse Mercator grid")
    return epsg % 100, epsg >= 32700


def utm(lon: Column, lat: Column, epsg: int) -> tuple[Column, Column]:
    """Easting and northing."""
    zone, south = zone_of(epsg)
    radius, e, forward, _ = _series()
    phi, lam = F.radians(lat), F.radians(lon - (zone * 6 - 183))
    s = F.sin(phi)
    t = F.sinh(F.atanh(s) - e * F.atanh(e * s))
    xi, eta = F.atan2(t, F.cos(lam)), F.atanh(F.sin(lam) / F.sqrt(1 + t * t))
    north, east = xi, eta
    for j, a in enumerate(forward, 1):
        north = north + a * F.sin(2 * j * xi) * F.cosh(2 * j * eta)
        east = east + a * F.cos(2 * j * xi) * F.sinh(2 * j * eta)
    return EAST0 + K0 * radius * east, (SOUTH0 if south else 0.0) + K0 * radius * north


def lon_lat(x: Column, y: Column, epsg: int) -> tuple[Column, Column]:
    """Degrees of an easting and northing."""
    zone, south = zone_of(epsg)
    radius, e, _, inverse = _series()
    xi, eta = (y - (SOUTH0 if south else 0.0)) / (K0 * radius), (x - EAST0) / (K0 * radius)
    u, v = xi, eta
    for j, b in enumerate(inverse, 1):
        u = u - b * F.sin(2 * j * xi) * F.cosh(2 * j * eta)
        v = v - b * F.cos(2 * j * xi) * F.sinh(2 * j * eta)

    def step(tau: Column, t: Column) -> Column:  # Newton's, from the conformal to the geographic latitude
        sigma = F.sinh(e * F.atanh(e * t / F.sqrt(1 + t * t)))
        ti = t * F.sqrt(1 + sigma * sigma) - sigma * F.sqrt(1 + t * t)
        return t + (tau - ti) / F.sqrt(1 + ti * ti) * (1 + (1 - e * e) * t * t) / ((1 - e * e) * F.sqrt(1 + t * t))

    def solved(tau: Column) -> Column:
        t = tau
        for _ in range(4):
            t = _let(t, lambda own: step(tau, own))
        return t

    tau = F.sin(u) / F.sqrt(F.pow(F.sinh(v), 2) + F.pow(F.cos(u), 2))
    return F.degrees(F.atan2(F.sinh(v), F.cos(u))) + (zone * 6 - 183), F.degrees(F.atan(_let(tau, solved)))


def _let(value: Column, body) -> Column:
    """body(value) with value computed once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def cell_centre(row: Column, col: Column, west: float, north: float, size: float) -> tuple[Column, Column]:
    return west + (col + 0.5) * size, north - (row + 0.5) * size


def cell_of(x: Column, y: Column, west: float, north: float, size: float) -> tuple[Column, Column]:
    return F.floor((north - y) / size).cast("long"), F.floor((x - west) / size).cast("long")


def outward(low: Column, high: Column, step: float) -> tuple[Column, Column]:
    """An interval's ends on the grid of step, rounded outward."""
    return F.floor(low / step) * step, F.ceil(high / step) * step
