"""Queries over the driver tables, one or more per operator, with their SQL twins."""

from __future__ import annotations

import importlib

_MODULES = ("packets", "sequences", "fitting", "matching", "scoring", "evaluation", "jobs", "streams")


def load():
    """Import every query module that exists and return the filled registry."""
    from suite import base
    for m in _MODULES:
        importlib.import_module(f"suite.{m}")
    return base
