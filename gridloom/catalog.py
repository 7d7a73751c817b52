"""The queries that the engine registers, each with the SQL that checks it."""

from __future__ import annotations

from .queries import affine_search, arrays, displacement, elementwise, extras, filters, geometry, mesh, more, morphology, pixels, resample, statistics, streams, strings

MODULES = (elementwise, filters, statistics, geometry, resample, morphology, arrays, strings, extras, more, displacement, mesh, affine_search, pixels, streams)


def queries() -> dict:
    out: dict = {}
    for m in MODULES:
        out |= m.REG.queries
    return out


def oracle_sql() -> dict:
    out: dict = {}
    for m in MODULES:
        out |= m.REG.sql
    return out
