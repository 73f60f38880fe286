"""Derived physical quantities."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def integral_flux(flux: Column, lower: Column, upper: Column, threshold: float) -> Column:
    """Integral flux above a threshold from channel arrays; partial channels count their part."""
    width = F.zip_with(lower, upper, lambda lo, hi: F.greatest(
        F.lit(0.0), hi - F.greatest(F.lit(float(threshold)), lo)))
    parts = F.zip_with(flux, width, lambda f, w: f * w)
    covered = F.exists(width, lambda w: w > 0)
    return F.when(covered, F.aggregate(parts, F.lit(0.0), lambda a, x: a + x))


def electric_field(speed: Column, bz: Column) -> Column:
    return -speed * bz * 1e-3


def dynamic_pressure(density: Column, speed: Column) -> Column:
    return density * speed * speed * 2e-6


def mach_number(speed: Column, density: Column, field: Column) -> Column:
    return F.try_divide(speed * F.sqrt(density), F.abs(field) * 20)
