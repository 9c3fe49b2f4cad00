"""Importing the plan modules fills the registry."""
from .registry import ORACLES, QUERIES  # noqa: F401
from . import projections, scans, detection, circuits, texts, learned  # noqa: F401,E402
