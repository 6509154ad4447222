"""Mixing sources to target weights by a multivariate-hypergeometric splitting tree (operator 7)."""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import WORD, lean, materialize, small_batches, table

WEIGHTS = (1.0, 2.0, 3.0)
MOST = 3
#: Words of a block, documents of a bucket of a source, output shards.
BLOCK, BUCKET, SHARDS = 1024, 2000, 16
SEED = 17


def targets(sizes: list[tuple[str | None, int]], weights: tuple[float, ...] = WEIGHTS, most: int = MOST) -> list[float]:
    """Words wanted of each source, given in code point order with null last.

    The sources share the sum of all sizes by weight; none gets more than `most` times its size, and
    what it leaves is shared among the others by weight until none is above.
    """
    w = [weights[k % len(weights)] for k in range(len(sizes))]
    out, open_ = [0.0] * len(sizes), {k for k, (_, n) in enumerate(sizes) if n > 0}
    left = float(sum(n for _, n in sizes))
    while open_:
        unit = left / sum(w[k] for k in open_)
        over = {k for k in open_ if unit * w[k] > most * sizes[k][1]}
        for k in over or open_:
            out[k] = float(most * sizes[k][1]) if over else unit * w[k]
            left -= out[k]
        open_ = open_ - over if over else set()
    return out


def draw(has: np.ndarray, n: int, rng: np.random.Generator) -> np.ndarray:
    """`n` of the blocks drawn without replacement: how many of each source. Source by source; where more blocks
    than numpy draws from (10^9) are left, by the normal law of the same mean and variance, within what is possible."""
    out, left = np.zeros_like(has), int(has.sum())
    for k, own in enumerate(has.tolist()):
        low, high = max(0, n - (left - own)), min(n, own)
        if low == high:
            out[k] = low
        elif left < 1_000_000_000:
            out[k] = rng.hypergeometric(own, left - own, n)
        else:
            share = own / left
            out[k] = min(high, max(low, round(rng.normal(n * share, math.sqrt(n * share * (1 - share) * (left - n) / (left - 1))))))
        left, n = left - own, n - int(out[k])
    return out


def split_quotas(blocks: np.ndarray, shards: int, rng: np.random.Generator) -> np.ndarray:
    """shards x sources: exact block quotas of each shard, by a tree of multivariate-hypergeometric draws.

    Each node deals its blocks between its two halves: the left one gets its share of the node's
    blocks, drawn without replacement over the sources. Row sums differ by one at most; column sums
    are the quotas given.
    """
    out = np.zeros((shards, len(blocks)), np.int64)

    def deal(low: int, high: int, has: np.ndarray) -> None:
        if high - low == 1:
            out[low] = has
            return
        mid, total = (low + high) // 2, int(has.sum())
        # the slots of shards low to mid when slots are dealt to shards one by one
        width = high - low
        mine = (total // width) * (mid - low) + min(total % width, mid - low)
        left = draw(has, mine, rng)
        deal(low, mid, left)
        deal(mid, high, has - left)

    deal(0, shards, np.asarray(blocks, np.int64))
    return out


@dataclass
class Plan:
    """What the mix takes of a source: whole passes over its blocks and part of one more."""

    blocks: int
    passes: int
    extra: int
    cut: int
    #: Multiplier and shift of each pass's permutation of the blocks.
    orders: list[tuple[int, int]]
    #: Draws of the source that fall before each shard.
    before: np.ndarray

    def draws(self, block: int, size: int) -> list[tuple[int, int, int, int]]:
        """(pass, draw, shard, words) of each time that this block of `size` words is taken."""
        out = []
        for e, (a, b) in enumerate(self.orders):
            k = (a * block + b) % self.blocks
            words = size if e < self.passes or k < self.extra else min(size, self.cut) if k == self.extra else 0
            if words:
                draw = e * self.blocks + k
                out.append((e, draw, int(np.searchsorted(self.before, draw, "right")) - 1, words))
        return out


def plan_sources(sizes: list[tuple[str | None, int]], shards: int = SHARDS, block: int = BLOCK, seed: int = SEED) -> tuple[list[float], list[Plan]]:
    rng = np.random.default_rng(seed)
    want, plans = targets(sizes), []
    for (_, size), target in zip(sizes, want, strict=True):
        blocks, words = max(1, math.ceil(size / block)), round(target)
        passes, rest = divmod(words, size) if size else (0, 0)
        orders = []
        for _ in range(passes + (rest > 0)):
            a = next(x for x in rng.integers(1, blocks + 1, 10_000).tolist() if math.gcd(x, blocks) == 1)
            orders.append((a, int(rng.integers(blocks))))
        extra = cut = 0
        if rest:  # the last block of the source may be short; where it falls in the pass decides
            a, b = orders[-1]
            short, last = (a * (blocks - 1) + b) % blocks, size - (blocks - 1) * block
            extra = rest // block
            if short < extra:  # it is among the whole ones: make up for it
                extra = (rest + block - last) // block
                cut = rest + block - last - extra * block
            else:
                cut = rest - extra * block
                if short == extra and cut > last:
                    extra, cut = extra + 1, cut - last
        plans.append(Plan(blocks, passes, extra, cut, orders, np.zeros(0)))
    quotas = split_quotas(np.array([p.blocks * p.passes + (p.extra + (p.cut > 0)) * (len(p.orders) > p.passes) for p in plans]), shards, rng)
    for k, p in enumerate(plans):
        p.before = np.concatenate([[0], np.cumsum(quotas[:, k])])[:-1]
    return want, plans


def mix(docs: DataFrame, keep: tuple[str, ...] = (), shards: int = SHARDS, block: int = BLOCK, seed: int = SEED) -> tuple[DataFrame, DataFrame]:
    """The mix of all rows: (documents, pieces).

    documents: doc_id, the columns of `keep`, row, size, source_size, target, taken. pieces: row,
    pass, block, start (words of the document before it), words, draw, shard, place (order in the shard).

    A source's documents stand in the order of the hash of their id and are cut into blocks of `block`
    words. The mix takes whole passes over the blocks and part of one more, each in an order of its
    own; the splitting tree says which draws go to which shard, and a shard's pieces are ordered by a
    hash. No word is taken more often than there are passes, so no document exceeds MOST times its size.
    Null and empty texts have size 0 and are never taken; a null source is a source of its own. Equal
    ids in a source are told apart by their text's hash, then by their place in the input. Repeated rows are documents of
    their own. A very long text is cut into blocks like any other. An empty table gives empty ones. Other columns are
    ignored, whatever their names. The plan holds a few numbers a source on the driver.
    """
    spark = docs.sparkSession
    small_batches(spark, 1000)
    size = F.coalesce(F.size(F.regexp_extract_all("text", F.lit(WORD), F.lit(0))), F.lit(0)).cast("long")
    read = docs.select("doc_id", "source", *keep, size.alias("size"), F.xxhash64(F.lit(seed), F.col("doc_id").cast("string"), "text").alias("o1"), F.xxhash64("text").alias("o2"))
    read = materialize(read.withColumn("row", F.monotonically_increasing_id()), "sizes")
    stats = read.groupBy("source").agg(F.sum("size").alias("n"), F.count("*").alias("docs")).collect()  # a row a source
    stats.sort(key=lambda r: (r["source"] is None, (r["source"] or "").encode()))
    want, plans = plan_sources([(r["source"], r["n"]) for r in stats], shards, block, seed)
    facts = [(k, r["source"], max(1, math.ceil(r["docs"] / BUCKET)), r["n"], want[k]) for k, r in enumerate(stats)]
    sources = spark.createDataFrame(facts, "src int, source string, buckets long, source_size long, target double")
    # by a range of the hash, so that the order of buckets is the order of hashes
    unit = F.shiftrightunsigned("o1", 33)
    placed = read.join(F.broadcast(sources), read["source"].eqNullSafe(sources["source"])).drop(sources["source"])
    placed = placed.withColumn("bucket", F.shiftright(unit * F.col("buckets"), 31))
    sums = placed.groupBy("src", "bucket").agg(F.sum("size").alias("n"))
    # a row a bucket: a small fixed share of the documents
    first = sums.withColumn("base", F.sum("n").over(Window.partitionBy("src").orderBy("bucket")) - F.col("n")).drop("n")
    inner = Window.partitionBy("src", "bucket").orderBy("o1", "o2", "row")
    at = placed.withColumn("at", F.sum("size").over(inner) - F.col("size")).join(first, ["src", "bucket"]).withColumn("at", F.col("at") + F.col("base"))
    at = materialize(at.drop("bucket", "base", "buckets", "o1", "o2"), "places")
    shared = spark.sparkContext.broadcast(plans)
    totals = spark.sparkContext.broadcast([r["n"] for r in stats])

    def cut(batches):
        for b in batches:
            rows = []
            for row, src, start, n in zip(*(c.to_pylist() for c in b.columns), strict=True):
                for k in range(start // block, (start + n - 1) // block + 1 if n else 0):
                    whole = min(block, totals.value[src] - k * block)
                    low, high = max(start, k * block), min(start + n, (k + 1) * block)
                    for e, draw, shard, words in shared.value[src].draws(k, whole):
                        if (top := min(high, k * block + words)) > low:
                            rows.append((row, e, k, low - start, top - low, draw, shard))
            cols = list(zip(*rows, strict=True)) if rows else [[]] * 7
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, [pa.int64(), pa.int32(), *[pa.int64()] * 4, pa.int32()], strict=True)], names=names)

    names = ["row", "pass", "block", "start", "words", "draw", "shard"]
    pieces = at.select("row", "src", "at", "size").mapInArrow(lean(cut), "row long, pass int, block long, start long, words long, draw long, shard int")
    pieces = pieces.withColumn("place", F.xxhash64(F.lit(seed), "row", "pass", "block"))
    taken = pieces.groupBy("row").agg(F.sum("words").alias("taken"))
    out = at.join(taken, "row", "left").select("doc_id", *keep, "row", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).alias("taken"))
    return out, pieces


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    out, _ = mix(table(spark, sf_dir, "documents").select("doc_id", "source", "text"))
    return out.select("doc_id", "size", "source_size", "target", "taken")
