"""Units of temperature and precipitation: conversion expressions and their inverse bounds."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Unit code -> (factor, offset) with common unit = value * factor + offset.
TO_DEG_C = {
    "degC": (1.0, 0.0),
    "degF": (5.0 / 9.0, -160.0 / 9.0),
    "K": (1.0, -273.15),
    "degC_tenths": (0.1, 0.0),
    "degF_tenths": (0.5 / 9.0, -160.0 / 9.0),
}
TO_MM = {"mm": (1.0, 0.0), "mm_tenths": (0.1, 0.0), "cm": (10.0, 0.0), "in": (25.4, 0.0), "in_hundredths": (0.254, 0.0)}
TO_COMMON = TO_DEG_C | TO_MM


def to_common(value: Column, unit: str) -> Column:
    """°C or mm of a value in a fixed unit."""
    factor, offset = TO_COMMON[unit]
    return value * F.lit(factor) + F.lit(offset)


def convert(value: Column, unit: Column, units: dict[str, tuple[float, float]] = TO_COMMON) -> Column:
    """°C or mm of a value whose unit code is a column; NULL where the code is none of `units`."""
    out = F.lit(None).cast("double")
    for code, (factor, offset) in units.items():
        out = F.when(unit == code, value * F.lit(factor) + F.lit(offset)).otherwise(out)
    return out
