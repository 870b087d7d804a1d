"""Every registered query and its oracle."""

from __future__ import annotations

from . import grids, pages, sequences, texts, vectors  # noqa: F401
from .registry import ORACLES, QUERIES  # noqa: F401
