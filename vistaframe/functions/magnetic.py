"""Magnetic declination from a table of spherical-harmonic coefficients (World Magnetic Model format)."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

# fixed values: WGS 84 semi-axis and squared eccentricity, reference radius (km)
AXIS_KM, ECC2, RADIUS_KM = 6378.137, 0.00669437999014, 6371.2


def read_coefficients(text: str) -> tuple[float, np.ndarray]:
    """(epoch, rows n, m, g, h and their yearly changes) of a .COF text: a header line with the epoch first."""
    lines = text.splitlines()
    rows = [list(map(float, x.split())) for x in lines[1:] if len(x.split()) == 6]
    return float(lines[0].split()[0]), np.array(rows)


def decimal_year(ts) -> F.Column:
    year = F.year(ts)
    start, end = F.make_timestamp(year, F.lit(1), F.lit(1), F.lit(0), F.lit(0), F.lit(0)), F.make_timestamp(year + 1, F.lit(1), F.lit(1), F.lit(0), F.lit(0), F.lit(0))
    return year + (F.unix_millis(ts) - F.unix_millis(start)) / (F.unix_millis(end) - F.unix_millis(start))


def field(coefficients: tuple[float, np.ndarray], lat, lon, year, alt_km) -> np.ndarray:
    """Declination in degrees, east positive, for arrays of geodetic places."""
    epoch, table = coefficients
    phi = np.radians(lat)
    curve = AXIS_KM / np.sqrt(1 - ECC2 * np.sin(phi) ** 2)
    axial, height = (curve + alt_km) * np.cos(phi), (curve * (1 - ECC2) + alt_km) * np.sin(phi)
    r = np.hypot(axial, height)
    down = np.arcsin(height / r)  # geocentric latitude
    c, s = np.sin(down), np.maximum(1e-9, np.cos(down))  # of the colatitude
    most = int(table[:, 0].max())
    # associated Legendre functions p[n, m] and slopes q[n, m], Schmidt semi-normalised along the way
    p, q = {(0, 0): np.ones_like(c)}, {(0, 0): np.zeros_like(c)}
    for n in range(1, most + 1):
        for m in range(n + 1):
            if m == n:
                k = np.sqrt((2 * n - 1) / (2 * n)) if n > 1 else 1.0
                p[n, n] = k * s * p[n - 1, n - 1]
                q[n, n] = k * (s * q[n - 1, n - 1] + c * p[n - 1, n - 1])
            else:
                a, b = (2 * n - 1) / np.sqrt(n * n - m * m), np.sqrt(((n - 1) ** 2 - m * m) / (n * n - m * m))
                p2, q2 = (p[n - 2, m], q[n - 2, m]) if m <= n - 2 else (0.0, 0.0)
                p[n, m] = a * c * p[n - 1, m] - b * p2
                q[n, m] = a * (c * q[n - 1, m] - s * p[n - 1, m]) - b * q2
    lam, dt = np.radians(lon), year - epoch
    north, east, radial = np.zeros_like(c), np.zeros_like(c), np.zeros_like(c)
    for n, m, g, h, dg, dh in table:
        n, m = int(n), int(m)
        g, h = g + dt * dg, h + dt * dh
        scale = (RADIUS_KM / r) ** (n + 2)
        even, odd = g * np.cos(m * lam) + h * np.sin(m * lam), g * np.sin(m * lam) - h * np.cos(m * lam)
        north += scale * even * q[n, m]
        east += scale * m * odd * p[n, m] / s
        radial += scale * (n + 1) * even * p[n, m]
    tilt = down - phi
    return np.degrees(np.arctan2(east, north * np.cos(tilt) + radial * np.sin(tilt)))


def declination(df: DataFrame, coefficients: tuple[float, np.ndarray]) -> DataFrame:
    """df (lat, lon, year and, if there, alt_km) with declination."""

    @F.pandas_udf(DoubleType())
    def at(lat: pd.Series, lon: pd.Series, year: pd.Series, alt: pd.Series) -> pd.Series:
        return pd.Series(field(coefficients, *(x.to_numpy(float) for x in (lat, lon, year, alt))))

    alt = F.col("alt_km") if "alt_km" in df.columns else F.lit(0.0)
    return df.withColumn("declination", at("lat", "lon", "year", alt))
