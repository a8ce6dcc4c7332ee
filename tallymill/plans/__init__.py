"""All queries of the library but those of the text operators."""

from . import audit, datasets, evidence, ledger, ops, sources, streams
from .registry import ORACLE_SQL, QUERIES

__all__ = ["ORACLE_SQL", "QUERIES", "audit", "datasets", "evidence", "ledger", "ops", "sources", "streams"]
