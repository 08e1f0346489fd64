"""Registered queries on the test tables and the SQL that must give the same rows."""

from importlib import import_module

MODULES = ["levels", "cleaning", "reshaping", "spatial", "statistics", "models"]


def load_all() -> None:
    """Import every query module, which registers its queries."""
    for m in MODULES:
        import_module(f"{__name__}.{m}")
