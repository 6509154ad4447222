"""Votes, consensus and crosswalks over evidence."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

QUORUM = 2


def majority(votes: DataFrame, by: list[str], value: str, quorum: int = QUORUM) -> DataFrame:
    """status and winner of each key: majority if exactly one value has the quorum, agreement if there is
    one value without it, conflict if there are several, unknown if all votes are null."""
    counted = votes.groupBy(*by, value).agg(F.count(value).alias("n"))
    enough = F.sum(F.when(F.col("n") >= quorum, 1).otherwise(0))
    values = F.count(value)
    best = F.max_by(value, F.when(F.col(value).isNotNull(), F.col("n")))
    only = F.max(value)
    out = counted.groupBy(*by).agg(enough.alias("__e"), values.alias("n_values"), best.alias("__b"), only.alias("__o"))
    status = F.when(F.col("__e") == 1, "majority").when(F.col("n_values") == 1, "agreement").when(F.col("n_values") > 1, "conflict").otherwise("unknown")
    winner = F.when(F.col("__e") == 1, F.col("__b")).when(F.col("n_values") == 1, F.col("__o"))
    return out.withColumns({"status": status, "winner": winner}).drop("__e", "__b", "__o")


def family_vote(votes: DataFrame, by: list[str], family: str, value: str, quorum: int = QUORUM) -> DataFrame:
    """One vote for each family that agrees with itself; then the majority. Adds n_families."""
    single = votes.where(F.col(value).isNotNull()).groupBy(*by, family).agg(F.min(value).alias("__lo"), F.max(value).alias("__hi"))
    single = single.where("__lo = __hi").select(*by, family, F.col("__lo").alias(value))
    families = single.groupBy(*by).agg(F.count("*").alias("n_families"))
    return majority(single, by, value, quorum).join(families, by)


def promote_masks(marks: DataFrame, by: list[str], known: str, long: str) -> DataFrame:
    """The union of the marks of each key; conflict has the bits that were marked both ways."""
    return marks.groupBy(*by).agg(
        F.bit_or(known).alias("known"), F.bit_or(long).alias("long"),
        F.bit_or(F.col(long)).bitwiseAND(F.bit_or(F.col(known).bitwiseAND(F.bitwise_not(F.col(long))))).alias("conflict"),
    )


def crosswalk(pairs: DataFrame, source: str, target: str, support: int = 3) -> DataFrame:
    """Source values seen with one target only, at least `support` times."""
    return pairs.where(F.col(target).isNotNull()).groupBy(source).agg(
        F.min(target).alias(target), F.count("*").alias("support"), F.count_distinct(target).alias("__n")
    ).where((F.col("__n") == 1) & (F.col("support") >= support)).drop("__n")


def unambiguous(pairs: DataFrame, key: str, attribute: str) -> DataFrame:
    """Keys with exactly one known attribute, with it."""
    return pairs.groupBy(key).agg(F.min(attribute).alias(attribute), F.count_distinct(attribute).alias("__n")).where("__n = 1").drop("__n")
