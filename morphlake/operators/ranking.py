"""Ranks with ties, margins, mutual best pairs, spread samples."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def rank_with_margin(pairs: DataFrame, by: list[str], score: str, tie: str) -> DataFrame:
    """Adds competition_rank (1 + strictly greater) and margin.

    The first row by (score desc, tie) has its score less the second's (0 if there is none); another
    row tied with it has its whole score; any other has its score less the best.
    """
    w = Window.partitionBy(*by)
    ordered = w.orderBy(F.desc(score), F.asc(tie))
    first, rank = F.row_number().over(ordered), F.rank().over(w.orderBy(F.desc(score)))
    margin = (
        F.when(first == 1, F.col(score) - F.coalesce(F.lead(score).over(ordered), F.lit(0.0)))
        .when(rank == 1, F.col(score))
        .otherwise(F.col(score) - F.max(score).over(w))
    )
    return pairs.withColumns({"competition_rank": rank, "margin": margin})


def mutual_best(pairs: DataFrame, left: str, right: str, score: str) -> DataFrame:
    """Pairs that are each other's only best, with the margins of both sides.

    pairs has each pair in both directions.
    """
    ranked = rank_with_margin(pairs, [left], score, right).where("competition_rank = 1 and margin > 0")
    back = ranked.select(F.col(left).alias("__r"), F.col(right).alias("__l"), F.col("margin").alias("back_margin"))
    same = (F.col(left) == F.col("__l")) & (F.col(right) == F.col("__r"))
    return ranked.join(back, same).where(F.col(left) < F.col(right)).drop("__l", "__r", "competition_rank")


def top_n(rows: DataFrame, by: list[str], order: list[Column], n: int) -> DataFrame:
    return rows.withColumn("rn", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(F.col("rn") <= n)


def spread_sample(rows: DataFrame, stratum: str, order: str, size: int) -> DataFrame:
    """`size` rows of each sorted stratum at even steps: places round(i (n - 1) / (size - 1)), half up."""
    w = Window.partitionBy(stratum)
    numbered = rows.withColumns({"__k": F.row_number().over(w.orderBy(order)) - 1, "__n": F.count("*").over(w)})
    steps = rows.sparkSession.range(size).withColumnRenamed("id", "__i")
    place = F.when(F.col("__n") <= size, F.col("__i")).otherwise(F.floor(F.col("__i") * (F.col("__n") - 1) / (size - 1) + 0.5))
    picked = numbered.join(F.broadcast(steps), F.col("__k") == place)
    return picked.drop("__k", "__n", "__i")
