"""All registered queries, by family."""

import importlib

FAMILIES = ("records", "exports", "opportunity", "clusters", "journeys", "insight", "demand", "classify", "season", "brand")


def all_checks() -> dict:
    from . import sqlkit

    for family in FAMILIES:
        importlib.import_module(f"checks.family_{family}")
    return sqlkit.CHECKS
