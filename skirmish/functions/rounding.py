"""Rounding that agrees between engines at half-way cases."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def rounded(x: Column, digits: int = 6) -> Column:
    """floor(x 10^digits + 0.5) / 10^digits: the same double arithmetic everywhere, unlike ROUND at half-way cases."""
    scale = float(10**digits)
    return F.floor(x.cast("double") * scale + 0.5) / scale


def rounded_sql(x: str, digits: int = 6) -> str:
    return f"floor(CAST({x} AS DOUBLE) * 1e{digits} + 0.5) / 1e{digits}"


def whole(x: Column) -> Column:
    """x as a whole number of 1e-9: sums of these do not depend on the order of rows."""
    return F.floor(x.cast("double") * 1e9 + 0.5).cast("long")


def exact_mean(x: Column, digits: int = 6) -> Column:
    """The mean of x over a group, from whole sums, rounded."""
    return rounded(F.sum(whole(x)) / F.count(x) / 1e9, digits)


def exact_mean_sql(x: str, digits: int = 6) -> str:
    return rounded_sql(f"CAST(sum(CAST(floor(CAST({x} AS DOUBLE) * 1e9 + 0.5) AS BIGINT)) AS DOUBLE) / count({x}) / 1e9", digits)
