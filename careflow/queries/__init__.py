"""Registered queries: every operator over the star-schema proxy views."""

from careflow.queries import (  # noqa: F401
    allergies, conditions, encounters, geo, loading, patients, quality, reshape,
)
from careflow.queries.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
