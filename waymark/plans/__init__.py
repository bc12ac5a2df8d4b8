"""Derived views and the catalogue of queries."""

from . import catalog, geometry, journeys, records, routes, rules, sheets, trips  # noqa: F401
