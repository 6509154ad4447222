"""Search over lattices: beams, exact enumeration, pruning."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def beam(cells: DataFrame, length: int, width: int, bonus: Column) -> DataFrame:
    """The `width` best paths over cells (pos, cand, score), pos from 1 to `length`.

    bonus is an expression over prev and cand. Of equal totals the path first by text is kept. A step
    compares width times candidates rows; nothing else is kept, so the result may miss the best path.
    """

    def best(rows: DataFrame) -> DataFrame:
        w = Window.orderBy(F.desc("total"), "path")
        return rows.withColumn("__n", F.row_number().over(w)).where(F.col("__n") <= width).drop("__n")

    kept = best(cells.where("pos = 1").select(F.col("cand").cast("string").alias("path"), "cand", F.col("score").alias("total")))
    for pos in range(2, length + 1):
        step = cells.where(F.col("pos") == pos).select("cand", "score")
        grown = kept.withColumnRenamed("cand", "prev").crossJoin(F.broadcast(step))  # width times a position's candidates
        kept = best(grown.select(F.concat_ws("-", "path", "cand").alias("path"), "cand", (F.col("total") + F.col("score") + bonus).alias("total")))
    return kept


def prune_to_support(domains: DataFrame, support: DataFrame, rounds: int = 100) -> DataFrame:
    """Arc consistency: takes out (node, value) of domains until each left has, for every constraint it
    is under, a partner that is left.

    support: (constraint, node, value, other, other_value) lists the allowed pairs, in both directions; a node
    is under the constraints it is listed in. Each round is one semi-join; rounds end when nothing goes.
    """
    from ..sources.shared import materialize

    left = materialize(domains.select("node", "value").distinct(), "domains")
    needs = support.select("constraint", "node").distinct()
    n = left.count()
    for _ in range(rounds):
        partner = left.select(F.col("node").alias("other"), F.col("value").alias("other_value"))
        held = support.join(partner, ["other", "other_value"], "left_semi").select("constraint", "node", "value").distinct()
        wanted = left.join(needs, "node").select("constraint", "node", "value")
        broken = wanted.join(held, ["constraint", "node", "value"], "left_anti").select("node", "value").distinct()
        left = materialize(left.join(broken, ["node", "value"], "left_anti"), "domains")
        if (now := left.count()) == n:
            return left
        n = now
    return left
