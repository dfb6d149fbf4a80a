"""All queries of the engine and the SQL that checks them."""

from __future__ import annotations

from . import audits, backbone, benchmark, calibrations, checks, finals, forecast, history, ladders, learning, linkage, names, refresh, reviews, roster, rosters, series_math, sources  # noqa: F401
from .base import ORACLES, QUERIES  # noqa: F401


def flagship(spark, sf_dir: str):
    """Series resolved to canonical teams, with status, flags and label."""
    return QUERIES["j03_canonical_series"](spark, sf_dir)
