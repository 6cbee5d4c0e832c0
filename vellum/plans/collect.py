"""How a module of queries collects them."""

from __future__ import annotations

from vellum.runtime import table


def collector():
    """(QUERIES, ORACLES, decorator): the decorator takes the SQL twin and the tables that a query
    is given, documents if none is named."""
    queries: dict = {}
    oracles: dict = {}

    def query(oracle: str | None = None, *sources: str):
        def add(f):
            queries[f.__name__] = lambda spark, sf_dir: f(*[table(spark, sf_dir, t) for t in sources or ("documents",)])
            queries[f.__name__].__doc__ = f.__doc__
            if oracle:
                oracles[f.__name__] = oracle
            return f

        return add

    return queries, oracles, query
