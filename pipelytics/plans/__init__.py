"""Registered queries, each next to the SQL it is checked against."""

from importlib import import_module

AREAS = ("commerce", "cost", "runs", "text", "graph", "requests", "learning", "streams")


def load_all() -> None:
    """Import every area, which registers its queries."""
    for area in AREAS:
        import_module(f"{__name__}.{area}")
