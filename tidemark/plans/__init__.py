"""Registered queries, grouped by area."""

from importlib import import_module

AREAS = ("cleaning", "joins", "series", "stats", "funds", "panel", "models", "text", "ml")


def load_all() -> None:
    for area in AREAS:
        import_module(f"tidemark.plans.q_{area}")
