"""All queries over the reference's own operators, and their SQL."""

from __future__ import annotations

from . import docs, entities, geometry, imagery, inout, landcover, reports, vectors  # noqa: F401
from .base import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
