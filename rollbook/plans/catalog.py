"""What registers queries and their SQL."""

from __future__ import annotations


class Catalog:
    def __init__(self):
        self.queries, self.oracles = {}, {}

    def query(self, sql: str | None = None):
        """Registers a function (spark, sf_dir) -> DataFrame under its name, with its SQL; a name can be taken once."""

        def add(f):
            if f.__name__ in self.queries:
                raise ValueError(f"two queries are named {f.__name__}")
            self.queries[f.__name__] = f
            if sql:
                self.oracles[f.__name__] = sql
            return f

        return add

    def add(self, other: Catalog) -> Catalog:
        if twice := self.queries.keys() & other.queries.keys():
            raise ValueError(f"queries named twice: {sorted(twice)}")
        self.queries |= other.queries
        self.oracles |= other.oracles
        return self
