"""Selection under budgets and ordered classification of evidence."""

from __future__ import annotations

from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def classify(cases: list[tuple[str, Column]], otherwise: str) -> Column:
    """The name of the first condition that holds; null conditions do not."""
    first = lambda out, case: out.when(F.coalesce(case[1], F.lit(False)), case[0])
    return reduce(first, cases[1:], F.when(F.coalesce(cases[0][1], F.lit(False)), cases[0][0])).otherwise(otherwise)


def corpus_queue(length: Column, occurrences: Column, dotted: Column, upper: Column, initial: Column, candidates: Column, two_words: Column, stripped: Column) -> Column:
    """The queue an unknown form belongs to, by the first rule that fits."""
    abbreviation = (length <= 2) | ((length <= 4) & (dotted >= 0.25 * occurrences)) | (upper == occurrences)
    return classify(
        [("two_words", two_words), ("quantity", stripped), ("abbreviation", abbreviation), ("single_candidate", candidates == 1), ("proper_name", initial >= 0.8 * occurrences), ("candidates", candidates > 0)],
        "unresolved",
    )


def compatibility(a: Column, b: Column, unknown: str = "X") -> Column:
    """True if equal, null if one is null or unknown, else false: agreement with what is not known."""
    open_ = a.isNull() | b.isNull() | (a == unknown) | (b == unknown)
    return F.when(~open_, a == b)


def prefix_within(rows: DataFrame, by: list[str], order: list, costs: dict[str, float]) -> DataFrame:
    """Rows of each group in order as long as every running cost stays in its budget: cut at the first over."""
    w = Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    over = reduce(lambda a, b: a | b, [F.sum(c).over(w) > limit for c, limit in costs.items()])
    return rows.withColumn("__over", over).withColumn("__cut", F.max("__over").over(w)).where("not __cut").drop("__over", "__cut")


def greedy_within(rows: DataFrame, by: list[str], order: list[str], costs: dict[str, float], exclusive: list[str] = []) -> DataFrame:  # noqa: B006
    """Rows of each group in order that still fit every budget and share no value of an exclusive column
    with a row taken: those that do not fit are skipped. A group is one task: its budget bounds it."""

    def one(t: pa.Table) -> pa.Table:
        t = t.sort_by([(c, "ascending") for c in order])
        left, seen, kept = dict(costs), {c: set() for c in exclusive}, []
        cost = {c: t.column(c).to_pylist() for c in costs}
        marks = {c: t.column(c).to_pylist() for c in exclusive}
        for k in range(t.num_rows):
            if all(cost[c][k] <= left[c] for c in costs) and all(marks[c][k] is None or marks[c][k] not in seen[c] for c in exclusive):
                kept.append(k)
                for c in costs:
                    left[c] -= cost[c][k]
                for c in exclusive:
                    seen[c].add(marks[c][k])
        return t.take(kept)

    return rows.groupBy(*by).applyInArrow(one, rows.schema)


def interned(rows: DataFrame, column: str, name: str) -> tuple[DataFrame, DataFrame]:
    """(rows with an id instead of the text, dictionary): ids are dense and in the order of the texts.

    Ranks are counted in two steps, within ranges of the texts and then over them, so that no task sees
    all texts."""
    texts = rows.where(F.col(column).isNotNull()).select(column).distinct().repartitionByRange(column)
    from ..sources.shared import materialize

    placed = materialize(texts.withColumn("__p", F.spark_partition_id()), "texts")
    sizes = placed.groupBy("__p").agg(F.count("*").alias("__n"))
    before = sizes.withColumn("__b", F.sum("__n").over(Window.orderBy("__p")) - F.col("__n")).drop("__n")  # a row a range
    local = F.row_number().over(Window.partitionBy("__p").orderBy(column)) - 1
    dictionary = placed.withColumn("__r", local).join(F.broadcast(before), "__p").select((F.col("__b") + F.col("__r")).alias(name), column)
    return rows.join(dictionary, column, "left").drop(column), dictionary


def packets(entries: DataFrame, key: list[str], members: list[str], order: list[str]) -> DataFrame:
    """One document a key with its members in order and a revision that changes with them."""
    listed = F.array_sort(F.collect_list(F.struct(*order, *[m for m in members if m not in order]))).alias("members")
    from ..functions.bits import revision

    return entries.groupBy(*key).agg(listed).withColumn("revision", revision(*[F.col(k) for k in key], F.col("members")))


def relation_of_sets(a: Column, b: Column) -> Column:
    """same, subset, superset, overlap or disjoint of two arrays."""
    both, left, right = F.size(F.array_intersect(a, b)), F.size(F.array_distinct(a)), F.size(F.array_distinct(b))
    return classify([("same", (both == left) & (both == right)), ("subset", both == left), ("superset", both == right), ("overlap", both > 0)], "disjoint")


def differences(a: DataFrame, b: DataFrame, ignore: list[str] = []) -> DataFrame:  # noqa: B006
    """Rows that only one of two tables has, with repeats: side and the columns."""
    a, b = a.drop(*ignore), b.drop(*ignore)
    return a.exceptAll(b).withColumn("side", F.lit("left")).unionByName(b.exceptAll(a).withColumn("side", F.lit("right")))
