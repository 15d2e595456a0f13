"""Registered queries: name -> (Spark callable, equivalent SQL or None)."""
from __future__ import annotations

import importlib

MODULES = ["text", "annotation", "listing", "landing", "storing"]


def registry() -> dict:
    out: dict = {}
    for module in MODULES:
        for name, pair in importlib.import_module(f"pressweave.queries.{module}").QUERIES.items():
            if name in out:
                raise ValueError(f"query {name} is registered twice")
            out[name] = pair
    return out
