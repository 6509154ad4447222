"""SimHash near-dedup by covering locality-sensitive hashing (operator 6)."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.graph import components
from .blocks import block_pairs
from .common import lean, materialize, small_batches, table

RADIUS = 4
#: A fingerprint that more than one in so many rows have is joined apart.
COMMON = 10_000
#: Distinct fingerprints of a task that deals them to the covering tables: so many times 31 rows it aggregates in memory.
SPREAD = 8_000
SHINGLE = 4
SEED = 42


def fingerprint(text: bytes, width: int = SHINGLE, seed: int = SEED) -> int:
    """64-bit SimHash of a text's word shingles, repeats included; 0 for a text without words.

    A-Z are lower-cased; words are runs without ASCII white space. A text of fewer words than the
    width is one shingle.
    """
    words = text.lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    if len(words) <= width:
        hashes = np.array([xxhash.xxh64_intdigest(joined, seed)], np.uint64)
    else:
        ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
        starts = np.concatenate(([0], ends[:-1] + 1))
        digest = xxhash.xxh64_intdigest
        pairs = zip(starts[: len(words) - width + 1].tolist(), ends[width - 1 :].tolist(), strict=True)
        hashes = np.fromiter((digest(joined[a:b], seed) for a, b in pairs), np.uint64, len(words) - width + 1)
    ones = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 1 << 16):  # bounds the unpacked bits of a very long text
        part = np.unpackbits(hashes[at : at + (1 << 16)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones += part.sum(axis=0, dtype=np.int64)
    bits = 2 * ones > len(hashes)
    return int(np.packbits(bits, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, the columns of `keep` and fp (the fingerprint as a signed long) of each row; a null text
    is as an empty one."""

    def run(batches):
        for b in batches:
            *rest, texts = b.columns
            fps = np.fromiter((fingerprint(t or b"") for t in texts.to_pylist()), np.uint64, b.num_rows)
            yield pa.RecordBatch.from_arrays([*rest, pa.array(fps.view(np.int64))], names=["doc_id", *keep, "fp"])

    kinds = [f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in ("doc_id", *keep)]
    return docs.select("doc_id", *keep, F.col("text").cast("binary").alias("__text")).mapInArrow(lean(run), ", ".join([*kinds, "fp long"]))


def covering_masks(radius: int = RADIUS, bits: int = 64, seed: int = 11) -> list[int]:
    """2**(radius+1)-1 masks such that any set of up to `radius` bit positions is missed by at least one.

    Each position gets a random nonzero vector over GF(2) with radius+1 components; mask v keeps the
    positions whose vector has an odd product with v. The vectors of `radius` positions span at most
    `radius` dimensions, so some v is orthogonal to all of them: its mask keeps none of these
    positions, and two fingerprints that differ only there agree under it.
    """
    size = 1 << (radius + 1)
    rng = np.random.default_rng(seed)
    # every vector about equally often, so that the masks are of about equal weight
    code = rng.permutation(np.concatenate([np.arange(1, size)] * (bits // (size - 1) + 1))[:bits])
    return [sum(1 << i for i in range(bits) if bin(int(code[i]) & v).count("1") & 1) for v in range(1, size)]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def spanning_edges(fps: np.ndarray, radius: int) -> list[tuple[int, int]]:
    """Edges of a spanning forest of the graph that links fingerprints at `radius` or fewer bits.

    A search that takes each fingerprint out once it is reached: dense groups cost little more
    than their size.
    """
    left, out = np.arange(len(fps)), []
    while left.size > 1:
        todo, left = [left[0]], left[1:]
        while todo and left.size:
            p = todo.pop()
            hit = np.bitwise_count(fps[left] ^ fps[p]) <= radius
            new = left[hit]
            if new.size:
                out.extend((int(p), int(q)) for q in new)
                todo.extend(new.tolist())
                left = left[~hit]
    return out


def table_spots(distinct: DataFrame, radius: int = RADIUS) -> DataFrame:
    """(tbl, bucket, fp): the bucket of each fp in every covering table.

    A file of distinct fingerprints holds millions of them, and each becomes a row a table: they are dealt out first,
    so that what a task aggregates does not depend on the size of the files.
    """
    masks = [_signed(m) for m in covering_masks(radius)]
    dealt = distinct.select("fp").repartition(max(1, -(-distinct.count() // SPREAD)), "fp")
    return dealt.select("fp", F.posexplode(F.array([F.lit(m) for m in masks])).alias("tbl", "mask")).select(
        F.col("tbl").cast("byte").alias("tbl"), F.col("fp").bitwiseAND(F.col("mask")).alias("bucket"), "fp"
    )


def fingerprint_links(distinct: DataFrame, radius: int = RADIUS) -> DataFrame:
    """Pairs (a, b) of distinct fingerprints at `radius` or fewer bits, enough of them to connect all.

    Input: one row per distinct fp. Each fp goes to one bucket of every covering table. Buckets are
    first aggregated to a count, a smallest and a largest member: that settles buckets of one or two.
    Members of larger buckets meet in bounded blocks, where a search verifies distances exactly.
    """
    spots = table_spots(distinct, radius)
    found = spots.groupBy("tbl", "bucket").agg(F.count("*").alias("n"), F.min("fp").alias("a"), F.max("fp").alias("b")).where("n > 1")
    found = materialize(found, "buckets")
    two = found.where("n = 2").where(F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= radius).select("a", "b")
    large = found.where("n > 2").select("tbl", "bucket")
    members = spots.join(large, ["tbl", "bucket"])

    def run(key, t):
        ids = t.column("fp").to_numpy()
        edges = spanning_edges(ids.view(np.uint64), radius)
        a, b = (ids[[e[k] for e in edges]] if edges else np.zeros(0, np.int64) for k in (0, 1))
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    met = block_pairs(members, ["tbl", "bucket"], "fp").groupBy("tbl", "bucket", "blk_i", "blk_j").applyInArrow(run, "a long, b long")
    return two.unionByName(met).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def simhash_components(docs: DataFrame, radius: int = RADIUS, keep: tuple[str, ...] = (), root: bool = False) -> DataFrame:
    """One row per input row: doc_id, the columns of `keep`, fingerprint (16 hex digits), component_id;
    with `root` also the fingerprint, as a number and never null, that stands for the component.

    component_id is the smallest doc_id reachable over links of fingerprints that differ in `radius`
    or fewer bits; equal fingerprints are linked. Null and empty texts have fingerprint zero, which
    links like any other. A row with a null doc_id keeps its fingerprint, and its component_id is the
    smallest non-null id it reaches (null if there is none). Very long texts are hashed whole, in slices. Repeated rows give
    repeated rows. An empty table gives an empty one. Columns other than doc_id and text are ignored.
    """
    small_batches(docs.sparkSession)
    # what follows reads the fingerprints several times: written once
    fps = materialize(fingerprints(docs, keep), "fps")
    distinct = materialize(fps.groupBy("fp").agg(F.min("doc_id").alias("rep"), F.count("*").alias("copies")), "distinct")
    links = fingerprint_links(distinct.select("fp"), radius)
    # nodes are the fingerprints; the component's smallest doc_id comes after
    comp = components(links.select(F.col("a").alias("u"), F.col("b").alias("v")))
    # only fingerprints with a link are in comp; a root has no row of its own there
    rooted = comp.select(F.col("node").alias("fp"), F.col("component").alias("root"))
    rooted = materialize(rooted.union(rooted.select(F.col("root").alias("fp"), "root")).distinct(), "rooted")
    least = rooted.join(distinct, "fp").groupBy("root").agg(F.min("rep").alias("low"))
    linked = rooted.join(least, "root").select("fp", "root", "low")
    ids = distinct.join(linked, "fp", "left").select("fp", "copies", F.coalesce("low", "rep").alias("component_id"), F.coalesce("root", "fp").alias("root"))
    ids = materialize(ids, "ids")
    # a fingerprint of many copies would be one task of the join: these, at most COMMON of them, are sent out to the rows
    most = F.lit(max(1000, (distinct.agg(F.sum("copies").alias("n")).first()["n"] or 0) // COMMON))
    common, others = ids.where(F.col("copies") > most), ids.where(F.col("copies") <= most)
    rare = fps.join(F.broadcast(common.select("fp")), "fp", "left_anti").join(others, "fp")
    return fps.join(F.broadcast(common), "fp").unionByName(rare).select("doc_id", *keep, F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id", *["root"] * root)


def op6_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_components(table(spark, sf_dir, "documents"))
