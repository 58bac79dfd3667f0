"""All queries of the library by name, with the SQL that gives the same rows."""

from __future__ import annotations

import importlib

FAMILIES = ("graph", "text", "triples", "vectors", "questions", "operations", "sources", "more", "orchestration", "linking", "stores", "textindex", "answers", "entities", "models", "images")


def _all() -> dict:
    out = {}
    for family in FAMILIES:
        out |= importlib.import_module(f"graphloom.plans.{family}").QUERIES
    return out


def queries():
    return {name: run for name, (run, _) in _all().items()}


def oracle_sql():
    return {name: sql for name, (_, sql) in _all().items() if sql}


def flagship(spark, sf_dir):
    """Triples to a standardised, inferred graph, in numbers by predicate."""
    return queries()["kg_pipeline"](spark, sf_dir)
