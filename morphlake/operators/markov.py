"""Sequence Markov models: contexts, counts, smoothing, back-off, leave-one-out."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

START, END = "<s>", "</s>"


def with_contexts(sequences: DataFrame, by: str, state: str, order: list[str], depth: int) -> DataFrame:
    """by, c1 to c<depth> (the states before, nearest first, START before the first), next; a row more
    ends each sequence."""
    w = Window.partitionBy(by).orderBy(*order)
    last = F.lead(state).over(w).isNull()
    lags = [F.coalesce(F.lag(state, k).over(w), F.lit(START)).alias(f"c{k}") for k in range(1, depth + 1)]
    rows = sequences.select(by, F.col(state).alias("next"), *lags, last.alias("__last"))
    shifted = [F.col("next").alias("c1"), *[F.col(f"c{k - 1}").alias(f"c{k}") for k in range(2, depth + 1)]]
    ends = rows.where("__last").select(by, F.lit(END).alias("next"), *shifted)
    return rows.drop("__last").unionByName(ends)


def smoothed(count: Column, total: Column, vocabulary: Column, alpha: float) -> Column:
    """(c + alpha) / (t + alpha V)."""
    return (count + alpha) / (total + alpha * vocabulary)


def transition_counts(rows: DataFrame, context: list[str], by: list[str] = []) -> DataFrame:  # noqa: B006
    """n of each (context, next)."""
    return rows.groupBy(*by, *context, "next").agg(F.count("*").alias("n"))


def backoff_probability(rows: DataFrame, depth: int, strength: float, alpha: float) -> DataFrame:
    """Each (c1..c<depth>, next) with its probability by hierarchical back-off: at every depth
    (c + s p_lower) / (t + s), from the smoothed unigram up."""
    one = transition_counts(rows, [])
    v = one.count()
    total = one.agg(F.sum("n")).first()[0] or 0
    probability = one.select("next", smoothed(F.col("n"), F.lit(total), F.lit(v), alpha).alias("p"))
    keys: list[str] = []
    for k in range(1, depth + 1):
        keys = [*keys, f"c{k}"]
        counts = transition_counts(rows, keys)
        totals = counts.groupBy(*keys).agg(F.sum("n").alias("t"))
        lower = probability
        joined = counts.join(totals, keys).join(lower, [*keys[:-1], "next"])
        probability = joined.select(*keys, "next", ((F.col("n") + strength * F.col("p")) / (F.col("t") + strength)).alias("p"))
    return probability


def leave_one_out(rows: DataFrame, by: str, alpha: float) -> DataFrame:
    """Log-probability of each sequence under the model of all others: total counts less its own.

    The vocabulary is that of the others too: states only this sequence has are left out of it.
    """
    own = transition_counts(rows, ["c1"], [by])
    total = own.groupBy("c1", "next").agg(F.sum("n").alias("all_n"))
    own_context = own.groupBy(by, "c1").agg(F.sum("n").alias("own_t"))
    all_context = total.groupBy("c1").agg(F.sum("all_n").alias("all_t"))
    state = rows.groupBy(by, "next").agg(F.count("*").alias("n"))
    states = state.groupBy("next").agg(F.sum("n").alias("s"))
    v = states.count()
    lost = state.join(states, "next").where("n = s").groupBy(by).agg(F.count("*").alias("lost"))
    joined = own.join(total, ["c1", "next"]).join(own_context, [by, "c1"]).join(all_context, "c1").join(lost, by, "left")
    p = smoothed(F.col("all_n") - F.col("n"), F.col("all_t") - F.col("own_t"), F.lit(v) - F.coalesce("lost", F.lit(0)), alpha)
    return joined.groupBy(by).agg(F.sum("n").alias("steps"), F.sum(F.col("n") * F.log(p)).alias("log_p"))
