"""Derived views and the catalogue of queries with their SQL (all of them are in ``catalog.QUERIES`` and ``catalog.ORACLE``)."""

from voxelspark.plans import catalog, extra  # noqa: F401
