"""Every registered query, grouped by the part of the library it exercises."""

import importlib

PARTS = ("options", "relations", "points", "population", "evaluation", "diagnostics", "fields", "quality", "streaming")


def load() -> None:
    for part in PARTS:
        importlib.import_module(f"touchline.catalog.{part}")
