"""Registered queries with their SQL."""

from . import answers, flows, graphs, stores, tables, texts  # noqa: F401
from .registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
