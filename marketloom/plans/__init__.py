"""Queries over the driver's tables."""

from . import checks, details, handoff, insight, market, scoring  # noqa: F401
from .registry import ORACLES, QUERIES  # noqa: F401
