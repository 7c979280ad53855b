"""Every operator as a named query over the given tables, with the SQL it must agree with."""

from workload import charts, exploration, filters, metadata, profiling, sources

MODULES = (sources, metadata, filters, profiling, exploration, charts)


def queries() -> dict:
    return {name: run for module in MODULES for name, run in module.REGISTRY.queries.items()}


def oracle_sql() -> dict:
    return {name: sql for module in MODULES for name, sql in module.REGISTRY.oracle.items()}
