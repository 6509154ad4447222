"""Connected components over edges in DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.shared import materialize


def _large_star(e: DataFrame) -> DataFrame:
    both = e.union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
    return both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def _small_star(e: DataFrame) -> DataFrame:
    down = e.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = down.groupBy("u").agg(F.min("v").alias("m"))
    moved = down.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.union(least.select("u", F.col("m").alias("v"))).distinct()


def components(edges: DataFrame) -> DataFrame:
    """(u, v) pairs of longs to (node, component): the smallest node reachable.

    Alternating large-star and small-star steps; each round is written to the shared folder. Only two
    numbers a round come to the driver. Nodes that are their own component's smallest, and nodes
    without edges, have no row. Hub nodes are no hazard: minima are partial aggregates and the join
    on a hub is one that adaptive execution can split.
    """
    e = materialize(edges.select(F.col("u").cast("long"), F.col("v").cast("long")).where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
    seen = None
    while True:
        state = e.agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("u", "v")).alias("x")).first()
        if state["n"] == 0 or (state["n"], state["x"]) == seen:
            return e.select(F.col("u").alias("node"), F.col("v").alias("component"))
        seen = (state["n"], state["x"])
        e = materialize(_small_star(_large_star(e)), "edges")


def closure(seeds: DataFrame, edges: DataFrame) -> DataFrame:
    """Nodes reachable from the seeds over directed edges (u, v): rounds of joins with the newest nodes
    only, each written to the shared folder, until none is new."""
    found = materialize(seeds.select("u").distinct(), "reached")
    fresh = found
    while True:
        reached = edges.join(fresh, "u", "left_semi").select(F.col("v").alias("u")).distinct()
        fresh = materialize(reached.join(found, "u", "left_anti"), "fresh")
        if not fresh.limit(1).count():
            return found
        found = materialize(found.unionByName(fresh), "reached")
