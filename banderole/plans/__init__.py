"""Registered queries over the driver's tables, with their SQL."""

from . import audit, books, corpus, ingest, ledger, pay, probing, publish, published, recovery, reports, restricted, sections  # noqa: F401
from .stand_in import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
