"""Queries over the test tables and their SQL counterparts."""

from . import manifests, runs, sampling, scoring, sequences, signals, sources, text  # noqa: F401
from .registry import ORACLES, QUERIES

__all__ = ["QUERIES", "ORACLES"]
