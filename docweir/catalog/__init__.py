"""Registered queries with their oracle SQL."""

from importlib import import_module

MODULES = ("crawl", "sites", "text", "retrieval", "dialogue", "streams")


def load():
    """Import the catalog modules and return (queries, oracles)."""
    for m in MODULES:
        import_module(f"docweir.catalog.{m}")
    from docweir.catalog import registry

    return dict(registry.QUERIES), dict(registry.ORACLES)
