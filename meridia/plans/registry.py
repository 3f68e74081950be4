"""All queries of the library but those of optional subpackages."""

from __future__ import annotations

from importlib import import_module

#: Modules of this package with a QUERIES table: name -> (function, SQL or None).
MODULES = ("catalogue", "coding", "records", "relational", "ordered", "spatial", "georeference", "sheets", "files", "readings")


def _tables() -> dict:
    out: dict = {}
    for name in MODULES:
        out |= import_module(f"meridia.plans.{name}").QUERIES
    return out


def queries() -> dict:
    return {k: f for k, (f, _) in _tables().items()}


def oracle_sql() -> dict[str, str]:
    return {k: sql for k, (_, sql) in _tables().items() if sql}
