"""Wind column functions: units, radius of maximum winds, gradient wind, surface wind; profile fits for whole tables."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

KNOT_MS = 1852 / 3600
RHO = 1.15
#: Surface factor, factor over land, share of translation, gust factor, inflow angle in degrees.
K_SURFACE, K_LAND, K_MOVE, K_GUST, INFLOW = 0.8, 0.75, 0.5, 1.4, 20.0


def wind_to_ms(value: Column, unit: Column) -> Column:
    """m/s from knots, km/h or m/s; null for a unit that is none of these (`unknown_units` finds such rows)."""
    return F.when(unit == "kt", value * KNOT_MS).when(unit == "kmph", value / 3.6).when(unit == "ms", value)


def unknown_units(df: DataFrame, unit: str = "unit") -> DataFrame:
    return df.filter(~F.coalesce(F.col(unit).isin("kt", "kmph", "ms"), F.lit(False)))


def ms_to_kt(value: Column) -> Column:
    return value / KNOT_MS


def coriolis(lat: Column) -> Column:
    return 2 * 7.2921e-5 * F.sin(F.radians(lat))


def willoughby_rmax_km(v: Column, lat: Column) -> Column:
    return 46.4 * F.exp(-0.0155 * v + 0.0169 * F.abs(lat))


def gradient_wind(r: Column, rmax: Column, b: Column, dp: Column, f: Column) -> Column:
    """Gradient wind in m/s at radius r (metres, 1 at least) of a profile with exponent b and deficit dp (pascal)."""
    r = F.greatest(r, F.lit(1.0))
    x = F.pow(rmax / r, b)
    half = r * F.abs(f) / 2
    return F.sqrt(b / RHO * dp * x * F.exp(-x) + half * half) - half


def surface_wind(gradient: Column, east: Column, north: Column, u: Column, v: Column, over_land: Column) -> tuple[Column, Column]:
    """(sustained wind, gust) in m/s at an offset from the centre that moves with (u, v)."""
    r = F.greatest(F.hypot(east, north), F.lit(1.0))
    turn = np.radians(INFLOW)
    # a wind around the centre, turned inwards
    tx, ty = -north / r, east / r
    wx, wy = tx * np.cos(turn) - ty * np.sin(turn), tx * np.sin(turn) + ty * np.cos(turn)
    base = gradient * K_SURFACE * F.when(over_land, K_LAND).otherwise(1.0)
    speed = F.hypot(base * wx + K_MOVE * u, base * wy + K_MOVE * v)
    speed = F.greatest(speed, F.lit(0.0))
    return speed, speed * K_GUST


def _peak(rmax: np.ndarray, b: np.ndarray, dp: np.ndarray, f: np.ndarray) -> np.ndarray:
    """Largest gradient wind over radii from 0.3 to 3 times that of the maximum."""
    best = np.zeros(len(rmax))
    for k in np.linspace(0.3, 3.0, 109):
        r, x = np.maximum(k * rmax, 1.0), (1 / k) ** b
        half = r * np.abs(f) / 2
        best = np.maximum(best, np.sqrt(b / RHO * dp * x * np.exp(-x) + half * half) - half)
    return best


def _fit(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for p in frames:
        v, move, rmax = p["v_sfc"].to_numpy(float), p["v_trans"].to_numpy(float), p["rmax_km"].to_numpy(float) * 1000
        f = 2 * 7.2921e-5 * np.sin(np.radians(p["lat"].to_numpy(float)))
        target = np.maximum(v - K_MOVE * move, 1.0) / K_SURFACE
        known = p["pc_hpa"].notna().to_numpy()
        dp_known = np.maximum((1010.0 - p["pc_hpa"].fillna(1000.0).to_numpy(float)) * 100, 100.0)
        low, high = np.where(known, 1.0, 100.0), np.where(known, 2.5, 20_000.0)
        for _ in range(60):  # the peak grows with either unknown
            mid = (low + high) / 2
            over = _peak(rmax, np.where(known, mid, 1.5), np.where(known, dp_known, mid), f) > target
            low, high = np.where(over, low, mid), np.where(over, mid, high)
        mid = (low + high) / 2
        yield p.assign(b=np.where(known, mid, 1.5), dp=np.where(known, dp_known, mid), b_source=np.where(known, "pressure", "default"))


def fit_holland(table: DataFrame) -> DataFrame:
    """Adds b, dp (pascal) and b_source to rows of v_sfc, v_trans (m/s), rmax_km, lat, pc_hpa (null if unknown).

    With a pressure, b is the exponent in [1, 2.5] whose peak wind meets the target; else b is 1.5 and dp is solved for.
    """
    names = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in table.schema)
    return table.mapInPandas(_fit, f"{names}, b double, dp double, b_source string")
