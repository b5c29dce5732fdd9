"""Named plans over the given tables."""

import importlib

from tallyframe.plans.registry import QUERIES, SQL

FAMILIES = (
    "sources", "relational", "recon", "profiling", "quality", "metrics", "privacy", "master",
    "change", "lineage", "usage", "views", "stream",
)


def load_all():
    """Import every family of plans, so that the registry is filled."""
    for name in FAMILIES:
        importlib.import_module(f"tallyframe.plans.{name}")
    return QUERIES, SQL
