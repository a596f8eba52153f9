"""Queries over the given tables, one module per operator family."""

from __future__ import annotations

import importlib
import importlib.util

FAMILIES = ["files", "filters", "exons", "patterns", "tests", "motifs", "permutations",
            "ranking", "annotation", "exports"]


def families():
    """The registries of all families, in report order."""
    return [importlib.import_module(f"isoscope.registry.{m}").R for m in FAMILIES
            if importlib.util.find_spec(f"isoscope.registry.{m}")]
