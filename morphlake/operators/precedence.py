"""Operators whose result depends on priority: first success, fallback, override, first of equals."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def first_success(rows: DataFrame, query: list[str], order: list[str]) -> DataFrame:
    """Of each query's rows those of the least (priority, attempt, ...) that gave any.

    The least order is an aggregate joined back, so a query with many rows needs no window over them.
    """
    least = rows.groupBy(*query).agg(F.min(F.struct(*order)).alias("__least"))
    return rows.join(least, query).where(F.struct(*order) == F.col("__least")).drop("__least")


def fallback(stages: list[DataFrame], query: list[str]) -> DataFrame:
    """Rows of a stage for the queries that no earlier stage has rows for."""

    def after(done: DataFrame, stage: DataFrame) -> DataFrame:
        late = stage.join(done.select(*query).distinct(), query, "left_anti")
        return done.unionByName(late, allowMissingColumns=True)

    return reduce(after, stages)


def override(earlier: DataFrame, later: DataFrame, query: list[str], weak: Column | None = None) -> DataFrame:
    """Later rows, and the earlier rows of queries they don't have; with `weak`, a query's earlier rows
    are replaced only if all of them are weak."""
    replaced = later.select(*query).distinct()
    if weak is not None:
        strong = earlier.where(~weak).select(*query).distinct()
        replaced = replaced.join(strong, query, "left_anti")
        later = later.join(strong, query, "left_anti")
    return earlier.join(replaced, query, "left_anti").unionByName(later, allowMissingColumns=True)


def first_of_equals(rows: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """One row of each key: the first by `order`."""
    w = Window.partitionBy(*key).orderBy(*order)
    return rows.withColumn("__n", F.row_number().over(w)).where("__n = 1").drop("__n")


def rule_groups(rules: DataFrame, key: list[str]) -> DataFrame:
    """Adds group_id: the dense rank of the key, the order in which groups are tried."""
    return rules.withColumn("group_id", F.dense_rank().over(Window.orderBy(*key)))
