"""Registered queries over the catalog, and their SQL."""

from __future__ import annotations

from tessera.plans.bindings import Inputs, duckdb

QUERIES, ORACLES = {}, {}


def query(name: str, sql: str | None = None):
    """Registers a function of Inputs as a query, with equivalent SQL over the same inputs if there is any."""

    def add(f):
        QUERIES[name] = lambda spark, sf_dir: f(Inputs(spark, sf_dir))
        if sql:
            ORACLES[name] = duckdb(sql)
        return f

    return add


from tessera.plans import catalog_decisions, catalog_filters, catalog_functions, catalog_joins, catalog_retrieval, catalog_scores, catalog_sources  # noqa: E402, F401
