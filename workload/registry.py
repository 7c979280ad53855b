"""Collects the queries of one module and the SQL each must agree with."""

from __future__ import annotations


class Registry:
    def __init__(self) -> None:
        self.queries: dict = {}
        self.oracle: dict = {}

    def add(self, name: str, run, sql: str | None = None) -> None:
        self.queries[name] = run
        if sql is not None:
            self.oracle[name] = sql

    def query(self, sql: str | None = None):
        def register(run):
            self.add(run.__name__, run, sql)
            return run

        return register
