"""All registered queries."""

from finfacts.checks import catalog_facts, catalog_flow, catalog_items  # noqa: F401  (import registers)
from finfacts.checks import catalog_tables  # noqa: F401  (after the others, whose SQL it shares)
from finfacts.checks.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
