"""Several tables that one job returns."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame


class Tables:
    """Named tables, each made when it is first asked for, together with what it needs."""

    def __init__(self, **make: Callable[[], DataFrame]):
        self._make, self._made = make, {}

    def __getattr__(self, name: str) -> DataFrame:
        if name.startswith("_") or name not in self._make:
            raise AttributeError(name)
        if name not in self._made:
            self._made[name] = self._make[name]()
        return self._made[name]
