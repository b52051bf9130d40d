"""All queries of the toolkit by name, and the DuckDB SQL each is checked against."""

from . import dedup, drift, features, modeling, quality, stats, streams, text, timeseries  # noqa: F401
from .base import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
