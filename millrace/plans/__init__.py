"""Queries over the driver's tables; importing this registers them all."""

from . import corpus, intake, measure, probe, reports, sequences
from .registry import ORACLES, QUERIES, query

__all__ = ["ORACLES", "QUERIES", "corpus", "intake", "measure", "probe", "query", "reports", "sequences"]
