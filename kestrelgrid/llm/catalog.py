"""All queries of this folder and their SQL."""

from __future__ import annotations

from importlib import import_module

#: Modules of this package that hold QUERIES and SQL.
MODULES = ("p2_nearest", "p6_leaks", "p7_mix", "p8_sentences")


def _merged(attribute: str) -> dict:
    out: dict = {}
    for name in MODULES:
        for key, value in getattr(import_module(f"kestrelgrid.llm.{name}"), attribute).items():
            if key in out:
                raise ValueError(f"query {key} is defined twice")
            out[key] = value
    return out


def queries() -> dict:
    return _merged("QUERIES")


def oracle_sql() -> dict[str, str]:
    return _merged("SQL")
