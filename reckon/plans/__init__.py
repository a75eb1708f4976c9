"""Registered queries over the settlement relations."""

from . import catalog, desk, landing, operations  # noqa: F401  the latter three add their queries to the catalog
