"""Registered queries and their SQL."""

from __future__ import annotations

from . import files, learning, relational, texts
from .registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES", "files", "learning", "relational", "texts"]
