"""Registration of queries with the SQL that checks them."""

from __future__ import annotations


def collection():
    """Empty tables of queries and SQL texts, and the decorator that fills them."""
    queries, oracles = {}, {}

    def query(oracle: str | None = None):
        def add(function):
            queries[function.__name__] = function
            if oracle is not None:
                oracles[function.__name__] = oracle
            return function

        return add

    return queries, oracles, query
