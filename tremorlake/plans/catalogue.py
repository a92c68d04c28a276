"""All queries over the catalogue tables and the SQL that gives the same rows."""

from __future__ import annotations

import importlib
import importlib.util

#: Modules of this package, which register their queries.
MODULES = ("scalars", "relational", "joining", "ordered", "series", "evaluation", "storage", "travel", "signals", "fitting", "files", "archive", "inference", "surface", "proposals", "smoothing")


def _load():
    for name in MODULES:
        if importlib.util.find_spec(f"tremorlake.plans.{name}"):
            importlib.import_module(f"tremorlake.plans.{name}")
    from . import registry

    return registry


def queries() -> dict:
    return dict(_load().QUERIES)


def oracle_sql() -> dict:
    return dict(_load().ORACLE)
