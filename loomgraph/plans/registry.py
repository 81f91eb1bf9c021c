"""Named queries, each beside the SQL that must give the same rows."""

from __future__ import annotations

from collections.abc import Callable


class Registry:
    def __init__(self, wrap: Callable = lambda f: f):
        self.queries: dict[str, Callable] = {}
        self.oracles: dict[str, str] = {}
        self._wrap = wrap

    def query(self, sql: str) -> Callable:
        """Register a query under its name with its SQL; `wrap` makes a query of spark and folder of it."""

        def keep(f: Callable) -> Callable:
            self.queries[f.__name__], self.oracles[f.__name__] = self._wrap(f), sql
            return f

        return keep
