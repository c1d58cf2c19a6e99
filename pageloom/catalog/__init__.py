"""Every operator as a named query over the given tables, with its SQL oracle."""

from .book import ORACLES, QUERIES
from . import extraction, fetchlog, jobs, lake, reports, requests, streams  # noqa: F401  (they register)

__all__ = ["ORACLES", "QUERIES"]
