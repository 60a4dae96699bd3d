"""Registered queries: name -> callable(spark, sf_dir) -> DataFrame."""

from __future__ import annotations

import inspect
import re

from laggard.plans import m0, m1, m2, m3, m4, m5, m6, m7, m8, pipeline


def _collect(mod) -> dict:
    """Every public query function of a plan module whose name starts with an operator ID."""
    out = {}
    for name, fn in inspect.getmembers(mod, inspect.isfunction):
        if fn.__module__ == mod.__name__ and re.match(r"^[a-z]{1,2}\d{2}_", name):
            out[name] = fn
    return out


QUERIES = {
    "m0_delayed_errors": m0.delayed_errors,
    "m0_delayed_summary": m0.delayed_summary,
    **_collect(m1),
    **_collect(m2),
    **_collect(m3),
    **_collect(m4),
    **_collect(m5),
    **_collect(m6),
    **_collect(m7),
    **_collect(m8),
    **_collect(pipeline),
}

FLAGSHIP = m0.delayed_errors
