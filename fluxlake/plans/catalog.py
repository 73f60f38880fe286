"""All registered queries: name -> (Spark query, SQL counterpart or None)."""

from __future__ import annotations

from fluxlake.plans import boards, evaluation, incremental, labelling, modelling, preparation, stored

MODULES = (preparation, evaluation, labelling, boards, modelling, incremental, stored)


def all_queries() -> dict:
    out: dict = {}
    for module in MODULES:
        repeated = out.keys() & module.QUERIES.keys()
        if repeated:
            raise ValueError(f"queries registered twice: {sorted(repeated)}")
        out.update(module.QUERIES)
    return out
