"""Profiling, quality scoring and exploration of delimited datasets on Spark."""

from tabulant.catalog import Catalog, Field

__all__ = ["Catalog", "Field"]
