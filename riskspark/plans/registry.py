"""All queries of the core, with their SQL."""

from __future__ import annotations

from . import q_exposure, q_relevance, q_risk, q_stages, q_text, q_time, q_vectors  # noqa: F401
from .base import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
