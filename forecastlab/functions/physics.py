"""Wind and air features as column expressions."""

from __future__ import annotations

import math

from pyspark.sql import Column, WindowSpec, functions as F

from forecastlab.functions.scalars import clip, ratio

# Physical constants and empirical coefficients.
SHEAR_EXPONENT = 0.143
GRAVITY = 9.80665
GAS_CONSTANT_DRY_AIR = 287.05
VAPOUR_RATIO = 0.622
LAPSE_RATE = 0.0065
KELVIN = 273.15
TAU = 2 * math.pi


def hub_speed(ws: str = "ws10m", hub: str = "mean_hub_height") -> Column:
    """Wind profile power law from 10 m to hub height."""
    return F.col(ws) * F.pow(F.col(hub) / 10, F.lit(SHEAR_EXPONENT))


def vapour_pressure(temperature: Column, relative_humidity: Column) -> Column:
    """Partial pressure of water vapour in Pa, from Celsius and per cent (Magnus form for the saturation, in hPa)."""
    return relative_humidity * (6.112 * F.exp(17.67 * temperature / (temperature + 243.5)))


def barometric_pressure(sea_level: Column, height: Column, temperature: Column) -> Column:
    """Pressure at a height above the sea under one (virtual) temperature in Kelvin; in the unit of ``sea_level``."""
    return sea_level * F.exp(-GRAVITY * height / (GAS_CONSTANT_DRY_AIR * temperature))


def virtual_temperature(temperature: Column, vapour: Column, pressure: Column) -> Column:
    """Temperature at which dry air would be as dense as the moist air."""
    return temperature * (1 + 0.61 * (VAPOUR_RATIO * vapour / (pressure - (1 - VAPOUR_RATIO) * vapour)))


def hub_air(
    ws: str = "ws10m", t2m: str = "t2m", rh2m: str = "rh2m", mslp: str = "mslp",
    hub: str = "mean_hub_height", elevation: str = "elevation", max_speed: float = 25.0,
) -> dict[str, Column]:
    """Speed, air density, pressure and power density at hub height."""
    sea_level = F.col(mslp) * 100.0
    at_hub = F.col(t2m) + KELVIN - LAPSE_RATE * F.col(hub)
    moist = virtual_temperature(
        at_hub, vapour_pressure(F.col(t2m), F.col(rh2m)), barometric_pressure(sea_level, F.col(elevation), at_hub)
    )
    pressure = barometric_pressure(sea_level, F.col(elevation) + F.col(hub), moist)
    density = pressure / (GAS_CONSTANT_DRY_AIR * moist)
    speed = hub_speed(ws, hub)
    return {
        "wshh": speed,
        "adhh": density,
        "phh": pressure,
        "wind_power_density": 0.5 * density * F.pow(clip(speed, 0, max_speed), F.lit(3)),
    }


def air_density(pressure: str = "mslp", temperature: str = "t2m") -> Column:
    return F.col(pressure) / (KELVIN + F.col(temperature))


def power_density(density: Column | str, speed: str, max_speed: float = 20.0) -> Column:
    density = F.col(density) if isinstance(density, str) else density
    return density * F.pow(clip(speed, 0, max_speed), F.lit(3))


def wind_x(speed: str, direction: str = "wd10m") -> Column:
    return F.col(speed) * F.cos(TAU * F.col(direction) / 360)


def wind_y(speed: str, direction: str = "wd10m") -> Column:
    return F.col(speed) * F.sin(TAU * F.col(direction) / 360)


def gust_factor(gust: str = "g10m", speed: str = "ws10m") -> Column:
    return ratio(gust, speed)


def vector_length(x: Column, y: Column) -> Column:
    return F.sqrt(x * x + y * y)


def wind_alignment(speed: str, window: WindowSpec, direction: str = "wd10m") -> Column:
    """Length of the centred three-row mean wind vector."""
    near = window.rowsBetween(-1, 1)
    return vector_length(
        F.avg(wind_x(speed, direction)).over(near), F.avg(wind_y(speed, direction)).over(near)
    )
