"""Registered queries: each operator over the whole sample tables, with the SQL that gives the same rows."""

from importlib import import_module

from fleetlens.plans.registry import CASES

MODULES = ["queries", "states", "scalars", "configs", "payload_cases", "streams"]


def load_cases():
    for name in MODULES:
        import_module(f"fleetlens.plans.{name}")
    return CASES
