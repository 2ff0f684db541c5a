"""The registered queries of the reference operators, each beside its SQL."""

from . import core, documents, jobs, recognition, records  # noqa: F401
from .base import ORACLE_SQL, QUERIES

__all__ = ["ORACLE_SQL", "QUERIES"]
