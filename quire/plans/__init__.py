"""Registered queries: an operator over the given tables plus its SQL check."""

from importlib import import_module

FAMILIES = ["text", "catalogue", "jobs", "layout", "structure", "quality", "ai", "streams"]


def load() -> None:
    """Import every family so that its queries register."""
    for name in FAMILIES:
        import_module(f"quire.plans.{name}")
