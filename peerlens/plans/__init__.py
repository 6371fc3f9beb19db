"""Queries over the given tables."""

from . import catalog_feeds, catalog_grading, catalog_peers, catalog_series, catalog_sinks, catalog_streams  # noqa: F401
from .registry import PLANS, SQL  # noqa: F401
