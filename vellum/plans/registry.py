"""Every query of the engine by name, and the DuckDB SQL that gives the same rows."""

from __future__ import annotations

from vellum.plans import evaluation, layout, masks
from vellum.runtime import ship


def _shipped(f):
    def query(spark, sf_dir):
        ship(spark)
        return f(spark, sf_dir)

    query.__doc__ = f.__doc__
    return query


QUERIES: dict = {k: _shipped(f) for k, f in (layout.QUERIES | evaluation.QUERIES | masks.QUERIES).items()}
ORACLES: dict = layout.ORACLES | evaluation.ORACLES | masks.ORACLES
