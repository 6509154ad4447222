"""Embedding near-dedup by an inverted multi-index (operator 4)."""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.graph import components
from .common import lean, materialize, small_batches, table

THRESHOLD = 0.98
#: Least and most codewords of each half, vectors a cell on average between them, and the bounded sample
#: that the codewords are fitted on.
FEWEST, CODES, CELL, FIT_ROWS, ROUNDS = 16, 2048, 500, 8192, 12
#: Share of neighbours at exactly the threshold that the traversal is to meet; nearer ones are met more often.
RECALL = 0.999
#: Vectors of a block: a task compares two blocks at a time.
BLOCK = 2048


def unit_rows(x: np.ndarray) -> np.ndarray:
    """Rows of length one; divided by their largest component first, so that no square overflows or vanishes."""
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def codebook(x: np.ndarray, codes: int = CODES, seed: int = 13) -> np.ndarray:
    """k-means centres; fewer than `codes` where there are fewer distinct vectors."""
    rng = np.random.default_rng(seed)
    distinct = np.unique(x, axis=0)
    centres = distinct[rng.permutation(len(distinct))[:codes]]
    for _ in range(ROUNDS):
        near = (np.sum(centres**2, 1) - 2 * x @ centres.T).argmin(1)
        sums = np.zeros_like(centres)
        np.add.at(sums, near, x)
        n = np.bincount(near, minlength=len(centres))
        centres = np.where(n[:, None] > 0, sums / np.maximum(n, 1)[:, None], centres)
    return centres


def half_bounds(x: np.ndarray, centres: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Nearest codeword of each half vector, and the squared distance below which no point of each
    codeword's region can be: that to the plane midway between it and the nearest one."""
    d = np.sum(x**2, 1)[:, None] + np.sum(centres**2, 1) - 2 * x @ centres.T
    own = d.argmin(1)
    gap = np.sqrt(np.maximum(np.sum(centres**2, 1)[:, None] + np.sum(centres**2, 1) - 2 * centres @ centres.T, 0))
    to_plane = np.maximum(d - d[np.arange(len(x)), own][:, None], 0) / np.maximum(2 * gap[own], 1e-12)
    to_plane[np.arange(len(x)), own] = 0
    return own, to_plane**2


def multi_sequence(first: np.ndarray, second: np.ndarray, limit: float) -> Iterator[tuple[int, int]]:
    """Cells (i, j) of the product grid by rising first[i] + second[j], up to `limit`.

    A cell enters the queue when both its predecessors in the two sorted lists were visited.
    """
    a, b = np.argsort(first, kind="stable"), np.argsort(second, kind="stable")
    queue, done = [(first[a[0]] + second[b[0]], 0, 0)], {}
    while queue and queue[0][0] <= limit:
        _, i, j = heapq.heappop(queue)
        done[i, j] = True
        yield int(a[i]), int(b[j])
        if i + 1 < len(a) and (j == 0 or (i + 1, j - 1) in done):
            heapq.heappush(queue, (first[a[i + 1]] + second[b[j]], i + 1, j))
        if j + 1 < len(b) and (i == 0 or (i - 1, j + 1) in done):
            heapq.heappush(queue, (first[a[i]] + second[b[j + 1]], i, j + 1))


def search_limit(threshold: float, recall: float, sample: np.ndarray, books: tuple[np.ndarray, np.ndarray], seed: int = 19) -> float:
    """The bound at which a traversal stops. Unit vectors with a cosine of `threshold` lie within
    sqrt(2 - 2 threshold): no cell beyond that holds a neighbour, and recall 1 stops only there. A
    lower recall stops where that share of made neighbours has been met: each of the sample is turned
    by the angle of the threshold in random directions."""
    radius = 2 - 2 * threshold + 1e-6
    if recall >= 1 or not len(sample):
        return radius
    rng, half = np.random.default_rng(seed), sample.shape[1] // 2
    x = np.tile(sample, (max(1, 2 * FIT_ROWS // len(sample)), 1))
    g = rng.normal(size=x.shape)
    g -= (g * x).sum(1, keepdims=True) * x
    y = threshold * x + (1 - threshold**2) ** 0.5 * g / np.maximum(np.linalg.norm(g, axis=1, keepdims=True), 1e-12)
    bound = np.zeros(len(x))
    for part, book in ((slice(0, half), books[0]), (slice(half, None), books[1])):
        bound += half_bounds(x[:, part], book)[1][np.arange(len(x)), half_bounds(y[:, part], book)[0]]
    return float(min(radius, np.quantile(bound, recall) + 1e-9))


def near_duplicates(vectors: DataFrame, threshold: float = THRESHOLD, recall: float = RECALL) -> DataFrame:
    """One row per input row: vec_id, n_links, component_id, kept.

    Vectors link when their labels are equal and not null and their cosine, in double precision,
    is `threshold` or more. Equal vectors of a label are one class, searched once; their links are
    counted by multiplicity. Vectors that are null, zero or not finite, or hold nulls, and vectors
    with a null label, link with nothing; nor do vectors of unequal lengths. With recall 1 every link is
    found; a lower one stops the traversal where it is met for neighbours at the very threshold. Repeated rows count as vectors of their own. A row
    with a null vec_id links and counts as others do; its component is the smallest non-null id it
    reaches. An empty table gives an empty one. Other columns are ignored.
    """
    spark = vectors.sparkSession
    small_batches(spark, 1000)
    x = F.transform("embedding", lambda v: v.cast("double"))
    largest = F.array_max(F.transform(x, F.abs))  # NaN is the largest of all; lengths are taken after a division by it
    whole = ~F.exists(x, lambda v: v.isNull()) & (largest > 0) & (largest < float("inf")) & ~F.isnan(largest)
    sound = F.col("label").isNotNull() & F.coalesce(whole, F.lit(False))
    rows = vectors.select("vec_id", "label", "embedding").withColumn("sound", sound)
    classes = rows.where("sound").groupBy("label", "embedding").agg(F.min("vec_id").alias("rep"), F.count("*").alias("times"))
    classes = materialize(classes.withColumn("id", F.monotonically_increasing_id()).withColumn("dim", F.size("embedding")), "classes")
    dims = [r["dim"] for r in classes.select("dim").distinct().collect()]  # one as a rule

    n = classes.count()
    unit = F.pmod(F.xxhash64("embedding"), F.lit(1 << 30))
    share = int(min(1.0, FIT_ROWS / max(1, n)) * (1 << 30))
    sample = classes.where(unit <= share).select("dim", "embedding").collect()
    codes = int(min(CODES, max(FEWEST, (n / CELL) ** 0.5)))
    books, limits = {}, {}
    for d in dims:
        some = np.array([r["embedding"] for r in sample if r["dim"] == d], np.float64).reshape(-1, d)
        some = unit_rows(some) if len(some) else np.zeros((1, d))
        books[d] = (codebook(some[:, : d // 2], codes) if d > 1 else np.zeros((1, 0)), codebook(some[:, d // 2 :], codes))
        limits[d] = search_limit(threshold, recall, some, books[d])
    shared = spark.sparkContext.broadcast((books, limits))

    def matrix(column, d):
        return unit_rows(np.asarray(column.flatten().to_numpy(zero_copy_only=False), np.float64).reshape(-1, d))

    def visits(batches):
        books, limits = shared.value
        for b in batches:
            by_dim = b.column("dim").to_numpy()
            for d in np.unique(by_dim).tolist():
                part = b.filter(pa.array(by_dim == d))
                x = matrix(part.column("embedding"), d)
                (own1, lb1), (own2, lb2) = half_bounds(x[:, : d // 2], books[d][0]), half_bounds(x[:, d // 2 :], books[d][1])
                who, cell, mine = [], [], []
                for k in range(len(x)):
                    home = int(own1[k]) * CODES + int(own2[k])
                    for i, j in multi_sequence(lb1[k], lb2[k], limits[d]):
                        who.append(k)
                        cell.append(i * CODES + j)
                        mine.append(cell[-1] == home)
                who = pa.array(who, pa.int64())
                cols = [part.column(c).take(who) for c in ("id", "label", "dim", "times")]
                data = pa.array([r.tobytes() for r in x], pa.binary()).take(who)
                yield pa.RecordBatch.from_arrays([*cols, pa.array(cell, pa.int32()), pa.array(mine, pa.bool_()), data], names=names)

    names = ["id", "label", "dim", "times", "cell", "mine", "x"]
    label = vectors.schema["label"].dataType.simpleString()
    seen = classes.select("id", "label", "dim", "times", "embedding").mapInArrow(lean(visits), f"id long, label {label}, dim int, times long, cell int, mine boolean, x binary")
    seen = materialize(seen, "visits")

    # members of a cell in blocks meet its visitors in blocks: a task holds two blocks, whatever the cell's size
    key = ["label", "dim", "cell"]
    sizes = seen.groupBy(*key).agg(F.ceil(F.sum(F.col("mine").cast("long")) / BLOCK).cast("int").alias("m"), F.ceil(F.count("*") / F.lit(BLOCK)).cast("int").alias("v"), F.count("*").alias("n")).where("m > 0 and n > 1").drop("n")
    dealt = seen.join(sizes, key)
    h = F.xxhash64("id")
    asks = dealt.select(*key, "id", "times", "x", F.lit(False).alias("member"), F.pmod(h, F.col("v")).cast("int").alias("bv"), F.explode(F.sequence(F.lit(0), F.col("m") - 1)).alias("bm"))
    members = dealt.where("mine").select(*key, "id", "times", "x", F.lit(True).alias("member"), F.explode(F.sequence(F.lit(0), F.col("v") - 1)).alias("bv"), F.pmod(h, F.col("m")).cast("int").alias("bm"))

    def verify(t):
        ids, times = t.column("id").to_numpy(), t.column("times").to_numpy()
        is_member = t.column("member").to_numpy(zero_copy_only=False)
        x = np.frombuffer(b"".join(t.column("x").to_pylist()), np.float64).reshape(len(ids), -1)
        m, q = np.flatnonzero(is_member), np.flatnonzero(~is_member)
        links = np.zeros(len(q), np.int64)
        group, edges = np.arange(len(m)), []
        for at in range(0, len(q), 512):
            part = q[at : at + 512]
            close = (x[part] @ x[m].T >= threshold) & (ids[part][:, None] != ids[m])
            links[at : at + 512] = close @ times[m]
            for r in np.flatnonzero(close.any(axis=1)).tolist():
                hit = np.flatnonzero(close[r])
                edges.append((ids[part[r]], ids[m[hit[0]]]))
                if len(both := np.unique(group[hit])) > 1:  # this visitor joins members that were apart
                    group[np.isin(group, both)] = both[0]
        some = np.flatnonzero(links)
        edges += [(ids[m[k]], ids[m[g]]) for k, g in enumerate(group.tolist()) if g != k]
        return pa.table({"a": pa.array(np.concatenate([ids[q[some]], [e[0] for e in edges]]).astype(np.int64)), "b": pa.array(np.concatenate([np.full(len(some), -1), [e[1] for e in edges]]).astype(np.int64)), "n": pa.array(np.concatenate([links[some], np.zeros(len(edges), np.int64)]).astype(np.int64))})

    met = materialize(asks.unionByName(members).groupBy(*key, "bv", "bm").applyInArrow(verify, "a long, b long, n long"), "links")
    counts = met.where("b < 0").groupBy("a").agg(F.sum("n").alias("links"))
    comp = components(met.where("b >= 0").select(F.col("a").alias("u"), F.col("b").alias("v")))
    rooted = classes.select("id", "rep", "times").join(comp, F.col("id") == F.col("node"), "left").join(counts, F.col("id") == F.col("a"), "left")
    rooted = materialize(rooted.select("id", "rep", F.coalesce("component", "id").alias("root"), (F.coalesce("links", F.lit(0)) + F.col("times") - 1).alias("n_links")), "rooted")
    least = rooted.groupBy("root").agg(F.min("rep").alias("component_id"))
    found = classes.select("id", "label", "embedding").join(rooted, "id").join(least, "root").select("label", "embedding", "n_links", "component_id")
    out = rows.where("sound").join(found, ["label", "embedding"]).select("vec_id", "n_links", "component_id")
    alone = rows.where("not sound").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return out.unionByName(alone).withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))


def op4_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "embeddings"))
