"""Every query of the library over the given tables, with SQL counterparts."""

from plumbline.catalog.registry import ORACLE, QUERIES
from plumbline.catalog import profiling, transforms, splits, scoring, modelling, grams, ledgers  # noqa: F401

__all__ = ["ORACLE", "QUERIES"]
