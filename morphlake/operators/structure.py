"""Markov models of dependency trees: factors of root, arcs and predicates, their counts, and scores by back-off."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

ROOT = "<ROOT>"


def factors(tokens: DataFrame, by: str, predicate: Column) -> DataFrame:
    """tokens (by, token, head, label, state), a root having a null head, to (by, kind, c1, c2, event).

    The root's event is its state; an arc's is label and state, after the head's state, and after the head with its own label and head;
    a predicate's is the sorted list of its dependents' events. A self-join on the head each: nothing walks a tree.
    """
    event = F.concat_ws(":", "label", "state")
    h = tokens.select(F.col(by).alias("__by"), F.col("token").alias("__t"), F.col("head").alias("__hh"), F.col("label").alias("__hl"), F.col("state").alias("__hs"))
    g = tokens.select(F.col(by).alias("__by2"), F.col("token").alias("__g"), F.col("state").alias("__gs"))
    arcs = tokens.join(h, (F.col(by) == F.col("__by")) & (F.col("head") == F.col("__t"))).join(g, (F.col(by) == F.col("__by2")) & (F.col("__hh") == F.col("__g")), "left")
    label = F.when(F.col("__hh").isNull(), "root").otherwise(F.col("__hl"))
    arcs = arcs.select(by, F.lit("arc").alias("kind"), F.col("__hs").alias("c1"), F.concat_ws("|", F.coalesce("__gs", F.lit(ROOT)), label, "__hs").alias("c2"), event.alias("event"))
    null = F.lit(None).cast("string")
    roots = tokens.where("head is null").select(by, F.lit("root").alias("kind"), null.alias("c1"), null.alias("c2"), F.col("state").alias("event"))
    dependents = tokens.where("head is not null").groupBy(F.col(by).alias("__by"), F.col("head").alias("__h")).agg(F.array_join(F.array_sort(F.collect_list(event)), ",").alias("__e"))
    heads = tokens.where(predicate).join(dependents, (F.col(by) == F.col("__by")) & (F.col("token") == F.col("__h")), "left")
    profiles = heads.select(by, F.lit("profile").alias("kind"), F.col("state").alias("c1"), null.alias("c2"), F.coalesce("__e", F.lit("")).alias("event"))
    return roots.unionByName(arcs).unionByName(profiles)


def scores(of: DataFrame, trained: DataFrame, by: str, alpha: float = 0.1, strength: float = 1.0) -> DataFrame:
    """(by, factors, log_score) of trees under the counts of `trained` factors: (n + a) / (N + a V) without context, one event of V being
    the unknown one, then (n + s p) / (t + s) for each longer context that was seen."""
    events = trained.groupBy("kind", "event").agg(F.count("*").alias("n0"))
    whole = events.groupBy("kind").agg(F.sum("n0").alias("t0"), (F.count("*") + 1).alias("v"))
    f = of.groupBy(by, "kind", "c1", "c2", "event").agg(F.count("*").alias("__m"))
    f = f.join(events, ["kind", "event"], "left").join(F.broadcast(whole), "kind")  # a row a kind
    p = (F.coalesce("n0", F.lit(0)) + alpha) / (F.col("t0") + alpha * F.col("v"))
    for k in ("c1", "c2"):
        counts = trained.where(f"{k} is not null").groupBy("kind", k, "event").agg(F.count("*").alias(f"n_{k}"))
        totals = counts.groupBy("kind", k).agg(F.sum(f"n_{k}").alias(f"t_{k}"))
        f = f.join(counts, ["kind", k, "event"], "left").join(totals, ["kind", k], "left")
        p = F.when(F.col(f"t_{k}").isNull(), p).otherwise((F.coalesce(f"n_{k}", F.lit(0)) + strength * p) / (F.col(f"t_{k}") + strength))
    return f.groupBy(by).agg(F.sum("__m").alias("factors"), F.sum(F.col("__m") * F.log(p)).alias("log_score"))


def shuffled(tokens: DataFrame, by: str, seed: str) -> DataFrame:
    """A negative control: the states of each tree dealt anew among its tokens, alike at every run."""
    draw = F.md5(F.concat_ws(":", F.col(by).cast("string"), F.col("token").cast("string"), F.lit(seed)).cast("binary"))
    place = F.row_number().over(Window.partitionBy(by).orderBy("token"))
    drawn = tokens.select(F.col(by).alias("__by"), F.col("state").alias("__state"), F.row_number().over(Window.partitionBy(by).orderBy(draw)).alias("__p2"))
    placed = tokens.withColumn("__p", place)
    return placed.join(drawn, (F.col(by) == F.col("__by")) & (F.col("__p") == F.col("__p2"))).withColumn("state", F.col("__state")).select(*tokens.columns)
