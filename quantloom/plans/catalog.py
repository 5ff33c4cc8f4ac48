"""Every registered query of the engine, with its SQL."""

from quantloom.plans import catalog_family, catalog_market, catalog_research, catalog_stored  # noqa: F401
from quantloom.plans.registering import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
