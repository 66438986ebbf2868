"""Colours of nodes and edges, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: RGB ends of the scales.
GREEN, ORANGE, RED, BRIGHT_GREEN, BRIGHT_RED = (0x00, 0x64, 0x00), (0x8B, 0x45, 0x13), (0x8B, 0x00, 0x00), (0x00, 0xFF, 0x00), (0xFF, 0x00, 0x00)


def between(low: tuple, high: tuple, ratio: Column) -> Column:
    parts = [(F.lit(a) + F.lit(b - a) * ratio).cast("int") for a, b in zip(low, high, strict=True)]
    return F.format_string("#%02X%02X%02X", *parts)


def of_missing(share: Column) -> Column:
    """Node colour by share of missing values, held within [0, 1]."""
    share = F.greatest(F.lit(0.0), F.least(F.lit(1.0), share))
    return (
        F.when(share <= 0, "#006400")
        .when(share <= 0.15, between(GREEN, ORANGE, share / 0.15))
        .when(share < 0.50, between(ORANGE, RED, (share - 0.15) / 0.35))
        .otherwise("#8B0000")
    )


def of_violations(ratio: Column) -> Column:
    """Edge colour by violation ratio."""
    return F.when(ratio <= 0, "#00FF00").when(ratio >= 0.05, "#FF0000").otherwise(between(BRIGHT_GREEN, BRIGHT_RED, ratio / 0.05))
