"""Query registrations by area."""

from importlib import import_module

from plumbline.plans.registry import QUERIES, Query

AREAS = ("tables", "profiles", "cleaning", "series", "statistics", "outliers", "models", "features", "streams", "checks")


def load_all() -> dict[str, Query]:
    for area in AREAS:
        import_module(f"plumbline.plans.{area}")
    return QUERIES
