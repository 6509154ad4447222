"""How a module of queries names them and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ..sources.tables import table

Query = Callable[[SparkSession, str], DataFrame]


class Catalog:
    def __init__(self) -> None:
        self.queries: dict[str, Query] = {}
        self.oracles: dict[str, str] = {}

    def add(self, oracle: str | None = None):
        def named(f: Query) -> Query:
            self.queries[f.__name__] = f
            if oracle:
                self.oracles[f.__name__] = oracle
            return f

        return named


def run_sql(spark: SparkSession, sf_dir: str, names: str, text: str, **frames: DataFrame) -> DataFrame:
    """Runs SQL over shared tables, named with spaces between, and over frames by name."""
    for name in names.split():
        frames[name] = table(spark, sf_dir, name)
    for name, df in frames.items():
        df.createOrReplaceTempView(name)
    return spark.sql(text)
