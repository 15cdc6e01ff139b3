"""All queries of the core."""

from __future__ import annotations

from codeloom.plans import knowledge, lookups, references, scalars, streams, upkeep
from codeloom.plans.registry import Registry

MODULES = [references, scalars, lookups, knowledge, upkeep, streams]


def collect(modules=None) -> Registry:
    out = Registry()
    for m in modules or MODULES:
        for name, f in m.R.queries.items():
            out.query(name, m.R.sql.get(name))(f)
    return out
