"""Named jobs: a task name, its function of (spark, parameters), and the datasets they share."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession


class Jobs:
    """Registry of named jobs and named tables."""

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self._jobs: dict[str, Callable[[SparkSession, dict], DataFrame]] = {}
        self._listeners: dict[str, list[Callable[[str, DataFrame], None]]] = {}

    def register(self, name: str, job: Callable[[SparkSession, dict], DataFrame]) -> None:
        self._jobs[name] = job

    def names(self) -> list[str]:
        return sorted(self._jobs)

    def run(self, name: str, **parameters) -> DataFrame:
        if name not in self._jobs:
            raise KeyError(f"no job {name}; there are {', '.join(self.names())}")
        return self._jobs[name](self.spark, parameters)

    def table(self, name: str, rows: DataFrame) -> DataFrame:
        """Keep a table under a name, for SQL too, and tell its listeners."""
        rows.createOrReplaceTempView(name)
        for tell in self._listeners.get(name, []):
            tell(name, rows)
        return rows

    def listen(self, name: str, tell: Callable[[str, DataFrame], None]) -> None:
        self._listeners.setdefault(name, []).append(tell)
