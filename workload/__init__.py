"""Registered queries over the shared tables, each beside its SQL check."""
from importlib import import_module

AREAS = ("batches", "comparisons", "checks", "lists", "authoring", "planning", "streams")


def load_all() -> None:
    for area in AREAS:
        import_module(f"workload.{area}")
