"""Registered queries, one module per report area."""

from importlib import import_module

AREAS = ("catalog", "workload", "storage", "history", "packages", "maintenance", "trace", "security", "grants", "topology", "streaming")


def load_all():
    """Import every area and return the registry."""
    for area in AREAS:
        import_module(f"fleetlens.plans.{area}")
    from fleetlens.plans.registry import QUERIES

    return QUERIES
