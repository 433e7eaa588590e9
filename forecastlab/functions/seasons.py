"""Calendar features and fixed category dummies."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, functions as F

from forecastlab.functions.physics import TAU
from forecastlab.sources.schemas import AREAS

DAYS_PER_YEAR = 365.2425


def season(time: str = "time") -> dict[str, Column]:
    """Sine and cosine of the hour of day and of the day of year."""
    hour = F.hour(time).cast("double") / 24.0
    year = (F.dayofyear(time).cast("double") - 1 + hour) / DAYS_PER_YEAR
    return {
        "sin_hod": F.sin(TAU * hour),
        "cos_hod": F.cos(TAU * hour),
        "sin_doy": F.sin(TAU * year),
        "cos_doy": F.cos(TAU * year),
    }


def area_dummies(column: str = "bidding_area", areas: Sequence[str] = AREAS) -> dict[str, Column]:
    return {area: F.col(column) == F.lit(area) for area in areas}
