"""Quality classifier: random-indexing word vectors and a small network (operator 3)."""

from __future__ import annotations

import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import fold, lean, materialize, small_batches, split_words, summed, table
from .words import frequent, word_counts

#: Frequent words with a vector of their own; the others share one by the hash of their ending.
HEAD, ENDINGS, ENDING = 16_384, 2_048, 3
SIZE = HEAD + ENDINGS
DIM, NONZERO, REACH = 64, 4, 2
BLOCK = 512
#: Bound of the labelled sample that the network is fitted on.
TRAIN_ROWS = 30_000
HIDDEN, EPOCHS, BATCH, RATE, DECAY = 32, 20, 256, 0.003, 1e-4
THRESHOLD = 0.3
MEMORY = 80_000
FEATURES = 2 * DIM + 4


def index_vectors(seed: int = 3) -> tuple[np.ndarray, np.ndarray]:
    """Where each word's sparse random index vector is not zero, and the signs there."""
    rng = np.random.default_rng(seed)
    return rng.integers(0, DIM, (SIZE, NONZERO)), rng.choice([-1.0, 1.0], (SIZE, NONZERO))


class Lexicon(dict):
    """Word to the row of its vector."""

    def __init__(self, head: list[bytes]):
        super().__init__(zip(head, range(len(head)), strict=True))
        self.head = head

    def __missing__(self, word: bytes) -> int:
        self[word] = row = HEAD + zlib.crc32(word[-ENDING:]) % ENDINGS
        return row

    def rows(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        if len(self) > len(self.head) + MEMORY:
            self.clear()
            self.update(zip(self.head, range(len(self.head)), strict=True))
        words, index, sizes = split_words(texts, lower=True)
        return np.fromiter(map(self.__getitem__, words), np.int64, len(words))[index], sizes


def word_vectors(docs: DataFrame, head) -> np.ndarray:
    """Each word's vector: the sum of the index vectors of its neighbours over the whole corpus, scaled
    to length one. SIZE x DIM numbers whatever the corpus: each task adds up its own share."""

    def run(batches):
        lex, (where, sign) = Lexicon(head.value), index_vectors()
        out = np.zeros(SIZE * DIM)
        for b in batches:
            ids, sizes = lex.rows(b.column(0))
            doc = np.repeat(np.arange(len(sizes)), sizes)
            for step in range(1, REACH + 1):
                same = np.flatnonzero(doc[step:] == doc[:-step])
                left, right = ids[same], ids[same + step]
                for word, near in ((left, right), (right, left)):
                    for k in range(NONZERO):
                        out += np.bincount(word * DIM + where[near, k], sign[near, k], SIZE * DIM)
        rows = out.reshape(-1, BLOCK * DIM)
        keys = np.arange(len(rows))
        yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array([r.tobytes() for r in rows], pa.binary())], names=["key", "vec"])

    parts = docs.select(F.col("text").cast("binary").alias("text")).mapInArrow(lean(run), "key long, vec binary")
    out = np.zeros((SIZE, DIM))
    for r in summed(parts, SIZE // BLOCK).collect():
        out[r["key"] * BLOCK : (r["key"] + 1) * BLOCK] = np.frombuffer(bytes(r["vec"]), np.float64).reshape(-1, DIM)
    out /= np.maximum(np.linalg.norm(out, axis=1, keepdims=True), 1e-9)
    out -= out.mean(axis=0)
    return (out / np.maximum(np.linalg.norm(out, axis=1, keepdims=True), 1e-9)).astype(np.float32)


def pooled(ids: np.ndarray, sizes: np.ndarray, vectors: np.ndarray) -> np.ndarray:
    """Features of each text: the mean vector of its words, what that differs by from the mean over its
    distinct words, length, share of distinct words, share of words that follow themselves, norm."""
    out = np.zeros((len(sizes), FEATURES), np.float32)
    doc = np.repeat(np.arange(len(sizes)), sizes)
    pairs, times = np.unique(doc * SIZE + ids, return_counts=True)
    of, word = pairs // SIZE, pairs % SIZE
    distinct = np.bincount(of, minlength=len(sizes))
    n, d = np.maximum(sizes, 1)[:, None], np.maximum(distinct, 1)[:, None]
    ends = np.cumsum(distinct)
    at = 0
    while at < len(sizes):  # so many rows of vectors at a time
        to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + 100_000, "right")))
        cut = slice(int(ends[at - 1]) if at else 0, int(ends[to - 1]))
        full = at + np.flatnonzero(distinct[at:to])
        if full.size:
            rows, starts = vectors[word[cut]], (ends - distinct)[full] - cut.start
            out[full, DIM : 2 * DIM] = np.add.reduceat(rows, starts, axis=0)
            out[full, :DIM] = np.add.reduceat(rows * times[cut, None], starts, axis=0)
        at = to
    out[:, :DIM] /= n
    out[:, DIM : 2 * DIM] = out[:, :DIM] - out[:, DIM : 2 * DIM] / d
    again = np.bincount(doc[1:], (ids[1:] == ids[:-1]) & (doc[1:] == doc[:-1]), len(sizes)) if len(ids) else np.zeros(len(sizes))
    out[:, 2 * DIM :] = np.stack([np.log1p(sizes) / 10, distinct / n[:, 0], again / n[:, 0], np.linalg.norm(out[:, :DIM], axis=1)], axis=1)
    return out


@dataclass
class Network:
    """Two layers; the logit is divided by the temperature."""

    mean: np.ndarray
    scale: np.ndarray
    w1: np.ndarray
    b1: np.ndarray
    w2: np.ndarray
    b2: float
    temperature: float = 1.0

    def logits(self, x: np.ndarray) -> np.ndarray:
        return np.tanh((x - self.mean) / self.scale @ self.w1 + self.b1) @ self.w2 + self.b2

    def scores(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.logits(x) / self.temperature, -30, 30)))


def fit(x: np.ndarray, y: np.ndarray, seed: int = 9) -> Network:
    """Adam on the logistic loss; the temperature that gives held-back rows (a fifth) the least loss."""
    rng = np.random.default_rng(seed)
    width = x.shape[1]
    rate = (y.sum() + 1) / (len(y) + 2)
    net = Network(x.mean(0) if len(x) else np.zeros(width), (x.std(0) if len(x) else np.zeros(width)) + 1e-3, rng.normal(0, width**-0.5, (width, HIDDEN)), np.zeros(HIDDEN), np.zeros(HIDDEN), float(np.log(rate / (1 - rate))))
    if len(np.unique(y)) < 2:
        return net  # the smoothed share of label 1 is the score of every text
    net.w2 = rng.normal(0, HIDDEN**-0.5, HIDDEN)
    order = rng.permutation(len(y))
    back, used = order[: len(y) // 5], order[len(y) // 5 :]
    z = (x - net.mean) / net.scale
    p = [net.w1, net.b1, net.w2, np.array([net.b2])]
    m, v, step = [np.zeros_like(a) for a in p], [np.zeros_like(a) for a in p], 0
    for _ in range(EPOCHS):
        for at in np.array_split(rng.permutation(used), max(1, len(used) // BATCH)):
            h = np.tanh(z[at] @ p[0] + p[1])
            err = (1 / (1 + np.exp(-np.clip(h @ p[2] + p[3], -30, 30))) - y[at]) / len(at)
            dh = err[:, None] * p[2] * (1 - h * h)
            grads = [z[at].T @ dh + DECAY * p[0], dh.sum(0), h.T @ err + DECAY * p[2], np.array([err.sum()])]
            step += 1
            for k, g in enumerate(grads):
                m[k], v[k] = 0.9 * m[k] + 0.1 * g, 0.999 * v[k] + 0.001 * g * g
                p[k] = p[k] - RATE * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.999**step)) + 1e-8)
    net.w1, net.b1, net.w2, net.b2 = p[0], p[1], p[2], float(p[3][0])
    if len(back):
        logits, tried = net.logits(x[back]), np.geomspace(0.25, 8, 61)
        loss = [np.logaddexp(0, np.where(y[back] > 0, -logits, logits) / t).mean() for t in tried]
        net.temperature = float(tried[int(np.argmin(loss))])
    return net


def _features(head, vectors, then):
    """A function over batches whose last column is the text: hands the columns and the features to `then`."""

    def run(batches):
        lex = Lexicon(head.value)
        for b in batches:
            yield then(b.columns, pooled(*lex.rows(b.columns[-1]), vectors.value))

    return run


def score_quality(docs: DataFrame, labels: DataFrame, held, keep: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, the columns of `keep`, held_out, score and predicted of each row of docs.

    Only a row's text makes its score. The network is fitted on rows that are not held out and have a
    label, TRAIN_ROWS at most, chosen by the hash of their id; word vectors come from all texts. An id
    with several labels counts as its majority, ties as 0; null labels and labels of unknown ids are
    left out. Without labels every score is 0.5; with one kind of label only, every score is its
    smoothed share. Null texts are empty; they are scored as any other, and very long texts whole. Repeated rows are scored
    each. An empty table gives an empty one. Other columns are ignored, whatever their names.
    """
    spark = docs.sparkSession
    counts = materialize(word_counts(docs.select("text")), "counts")
    head = spark.sparkContext.broadcast(frequent(counts, HEAD)[0])
    vectors = spark.sparkContext.broadcast(word_vectors(docs.select("text"), head))

    # at most TRAIN_ROWS labels go out to the documents: by the hash of the id, then the first of those
    marks = labels.where("quality is not null and doc_id is not null").groupBy("doc_id").agg(F.avg("quality").alias("y"))
    learned = marks.join(docs.where(~held).select("doc_id").distinct(), "doc_id", "left_semi")
    some = learned.orderBy(F.xxhash64("doc_id"), "doc_id").limit(TRAIN_ROWS)
    some = materialize(some, "marks")
    read = docs.where(~held).join(F.broadcast(some), "doc_id").select("doc_id", "y", F.col("text").cast("binary").alias("text"))
    kind = docs.schema["doc_id"].dataType.simpleString()
    take = lambda columns, x: pa.RecordBatch.from_arrays([*columns[:-1], pa.array([r.tobytes() for r in x], pa.binary())], names=["doc_id", "y", "x"])
    rows = read.mapInArrow(lean(_features(head, vectors, take)), f"doc_id {kind}, y double, x binary")
    rows = rows.groupBy("doc_id").agg(F.first("y").alias("y"), F.min("x").alias("x")).orderBy("doc_id").collect()
    x = np.frombuffer(b"".join(bytes(r["x"]) for r in rows), np.float32).reshape(-1, FEATURES).astype(np.float64)
    net = spark.sparkContext.broadcast(fit(x, np.array([float(r["y"] > 0.5) for r in rows])))

    # the text goes through Python once, whether it is kept or not
    text = ["text"] if "text" in keep else []
    names = ["doc_id", *(c for c in keep if c != "text"), "held_out", *text]

    def judge(columns, x):
        s = net.value.scores(x.astype(np.float64))
        return pa.RecordBatch.from_arrays([*columns[: len(names)], pa.array(s), pa.array((s >= THRESHOLD).astype(np.int32))], names=[*names, "score", "predicted"])

    read = docs.select("doc_id", *(c for c in keep if c != "text"), held.alias("held_out"), "text")
    schema = T.StructType([*(T.StructField(c, read.schema[c].dataType) for c in names), T.StructField("score", T.DoubleType()), T.StructField("predicted", T.IntegerType())])
    found = read.mapInArrow(lean(_features(head, vectors, judge)), schema)
    return found.select("doc_id", *keep, "held_out", "score", "predicted")


def op3_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    small_batches(spark, 1000)
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    return score_quality(docs.select("doc_id", "text"), labels.select("doc_id", "quality"), fold(F.col("doc_id"), 5) == 0)
