"""Log-bilinear language model trained with noise-contrastive estimation (operator 2)."""

from __future__ import annotations

import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import fold, lean, materialize, small_batches, split_words, summed, table
from .words import END, frequent, word_counts

#: What the network predicts: the end, the most frequent words, and classes of the other words: their frequent
#: endings, and hashes of rarer endings. The words before are told apart by fewer units of the same kinds.
OWN, SEEN, ENDINGS, HASHED = 8192, 255, 192, 64
CLASSES = ENDINGS + HASHED
UNITS, CONTEXTS = 1 + OWN + CLASSES, 1 + SEEN + CLASSES
#: Words with an id of their own, the most frequent ones; others are joined. Ids, and after them the classes, fit 16 bits.
HEAD = (1 << 16) - CLASSES
ENDING = 3
DIM, NOISE, BATCH, RATE, START = 16, 16, 4096, 0.05, 0.02
#: New words a task remembers at once.
MEMORY = 60_000


def sums_by(rows: np.ndarray, at: np.ndarray, n: int) -> np.ndarray:
    """n x DIM: the sum of the rows of each place."""
    cells = (at * rows.shape[1])[:, None] + np.arange(rows.shape[1])
    return np.bincount(cells.ravel(), rows.ravel(), n * rows.shape[1]).reshape(n, -1).astype(np.float32)


class Model:
    """Predicts a unit from the two before it: scores are (R[c1] W1 + R[c2] W2) . U[t] + b[t].

    `contexts` of the units' first vectors come from what pairs of units a corpus has (`start`)."""

    def __init__(self, unigram: np.ndarray, contexts: int = CONTEXTS, seed: int = 5):
        rng = np.random.default_rng(seed)
        n = len(unigram)
        self.noise = (unigram + 1.0) / (unigram + 1.0).sum()
        self.ladder = np.cumsum(self.noise)
        self.log_noise = np.log(NOISE * self.noise).astype(np.float32)
        halves = np.eye(2 * DIM)
        parts = [rng.normal(0, 0.05, (contexts, 2 * DIM)), halves[:, :DIM], halves[:, DIM:], rng.normal(0, 0.05, (n, DIM)), np.log(self.noise)]
        self.p = [np.ascontiguousarray(x, np.float32) for x in parts]
        self.g = [np.full_like(x, START) for x in self.p]

    def start(self, pairs: np.ndarray, unit_context: np.ndarray) -> Model:
        """From the counts of (unit before, unit) one and two apart, as contexts: the vectors whose products come
        nearest to the logarithm of how much oftener than by chance a pair occurs. A unit starts as its context does."""
        logs = []
        for n in pairs.astype(np.float64):
            chance = n.sum(1, keepdims=True) * n.sum(0, keepdims=True) / max(1.0, n.sum())
            logs.append(np.log((n + 1) / (chance + 1)))
        # both distances tell partly the same: the farther one is halved
        u, s, v = np.linalg.svd(np.concatenate([logs[0], 0.5 * logs[1]]), full_matrices=False)
        root = np.sqrt(s[:DIM])
        left, right, m = u[:, :DIM] * root, v[:DIM].T * root, len(logs[0])
        self.p[0][:, : left.shape[1]] = left[:m]
        self.p[0][:, DIM : DIM + left.shape[1]] = left[m:]
        self.p[3][:, : right.shape[1]] = right[unit_context]
        return self

    def flat(self) -> np.ndarray:
        return np.concatenate([x.ravel() for x in (*self.p, *self.g)])

    def load(self, flat: np.ndarray) -> Model:
        at = 0
        for xs in (self.p, self.g):
            for k, x in enumerate(xs):
                xs[k] = flat[at : at + x.size].astype(np.float32).reshape(x.shape)
                at += x.size
        return self

    def _step(self, k: int, grad: np.ndarray, at=slice(None)) -> None:
        g = self.g[k][at] + grad * grad
        self.g[k][at] = g
        self.p[k][at] -= RATE * grad / np.sqrt(g)

    def before(self) -> tuple[np.ndarray, np.ndarray]:
        """What each unit adds to the prediction one and two tokens later."""
        return self.p[0] @ self.p[1], self.p[0] @ self.p[2]

    def train(self, c1: np.ndarray, c2: np.ndarray, t: np.ndarray, rng: np.random.Generator) -> None:
        """Noise-contrastive estimation, every position once; a minibatch shares its noise samples."""
        order = rng.permutation(len(t))
        for at in range(0, len(t), BATCH):
            at = order[at : at + BATCH]  # noqa: PLW2901
            a, b, y = c1[at], c2[at], t[at]
            r, w1, w2, u, bias = self.p
            noise = np.minimum(np.searchsorted(self.ladder, rng.random(NOISE)), len(u) - 1)
            one, two = self.before()
            h, uy, un = one[a] + two[b], u[y], u[noise]
            good = 1 / (1 + np.exp(np.minimum(self.log_noise[y] - bias[y] - np.einsum("ij,ij->i", h, uy), 60))) - 1
            bad = 1 / (1 + np.exp(np.minimum(self.log_noise[noise] - bias[noise] - h @ un.T, 60)))
            dh = bad @ un + good[:, None] * uy
            scale = np.float32(1 / len(y))
            d1, d2 = sums_by(dh, a, len(one)), sums_by(dh, b, len(two))
            place, of = np.unique(np.concatenate([y, noise]), return_inverse=True)
            du = sums_by(np.concatenate([good[:, None] * h, bad.T @ h]), of, len(place))
            db = np.bincount(of, np.concatenate([good, bad.sum(0)]), len(place)).astype(np.float32)
            self._step(0, (d1 @ w1.T + d2 @ w2.T) * scale)
            self._step(1, r.T @ d1 * scale)
            self._step(2, r.T @ d2 * scale)
            self._step(3, du * scale, place)
            self._step(4, db * scale, place)

    def scorer(self) -> Scorer:
        """Normalisers of all pairs of contexts: the sum over all units of the product of what either context
        gives, which is one matrix product."""
        one, two = self.before()
        u, bias = self.p[3], self.p[4]
        first, second = (one @ u.T + bias).astype(np.float64), (two @ u.T).astype(np.float64)
        top1, top2 = first.max(1, keepdims=True), second.max(1, keepdims=True)
        norm = top1 + top2.T + np.log(np.exp(first - top1) @ np.exp(second - top2).T)
        return Scorer(one, two, u.copy(), bias.copy(), norm.astype(np.float32))


@dataclass
class Scorer:
    one: np.ndarray
    two: np.ndarray
    u: np.ndarray
    bias: np.ndarray
    norm: np.ndarray

    def log_p(self, c1: np.ndarray, c2: np.ndarray, t: np.ndarray) -> np.ndarray:
        """Logarithm of each unit's probability after the two contexts before it, slice by slice."""
        out = np.empty(len(t))
        for at in range(0, len(t), 1 << 16):
            a, b, y = c1[at : at + (1 << 16)], c2[at : at + (1 << 16)], t[at : at + (1 << 16)]
            out[at : at + len(y)] = np.einsum("ij,ij->i", self.one[a] + self.two[b], self.u[y]) + self.bias[y] - self.norm[a, b]
        return out


@dataclass
class Vocabulary:
    """The frequent words by falling count, and what tells the class of another."""

    words: list[bytes]
    counts: np.ndarray
    endings: dict[bytes, int]

    def class_of(self, word: bytes) -> int:
        found = self.endings.get(word[-ENDING:])
        return ENDINGS + zlib.crc32(word[-ENDING:]) % HASHED if found is None else found

    def units(self, own: int) -> np.ndarray:
        """Of each id: its unit, where the end and the `own` most frequent words have one of their own. Ids after the
        words stand for the classes."""
        rank = np.cumsum([w != END for w in self.words])
        found = [0 if w == END else (int(k) if k <= own else 1 + own + self.class_of(w)) for k, w in zip(rank, self.words, strict=True)]
        return np.array(found + [1 + own + k for k in range(CLASSES)], np.int64)


def vocabulary(counts: DataFrame, size: int = HEAD) -> tuple[Vocabulary, DataFrame]:
    """The most frequent words, `size` at most, with the endings most frequent among them; and the counts
    of the other words."""
    words, n, rest = frequent(counts, size)
    by_ending: dict[bytes, int] = {}
    for w, c in zip(words[SEEN + 1 :], n.tolist()[SEEN + 1 :], strict=True):
        by_ending[w[-ENDING:]] = by_ending.get(w[-ENDING:], 0) + c
    best = sorted(by_ending, key=lambda e: (-by_ending[e], e))[:ENDINGS]
    return Vocabulary(words, n, {e: k for k, e in enumerate(best)}), rest


class Lexicon(dict):
    """Word to id; a word outside the vocabulary gets the next number when first seen."""

    def __init__(self, vocab: Vocabulary):
        super().__init__(zip(vocab.words, range(len(vocab.words)), strict=True))
        self.vocab, self.base, self.new = vocab, len(vocab.words), []
        self.cls = np.zeros(0, np.int64)
        if END not in self:
            self[END] = self.base + self.vocab.class_of(END)

    def __missing__(self, word: bytes) -> int:
        self[word] = place = self.base + CLASSES + len(self.new)
        self.new.append(word)
        return place

    def ids(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids of all tokens, ends included, those outside the vocabulary as their classes; the place among the new
        words of each such token, else -1; and the tokens of each text."""
        if len(self.new) > MEMORY:
            for w in self.new:
                del self[w]
            self.new, self.cls = [], np.zeros(0, np.int64)
        words, index, sizes = split_words(texts, lower=True)
        ids = np.fromiter(map(self.__getitem__, words), np.int64, len(words))[index]
        ids, sizes = np.insert(ids, np.cumsum(sizes), self[END]), sizes + 1
        fresh = [self.vocab.class_of(w) for w in self.new[len(self.cls) :]]
        self.cls = np.concatenate([self.cls, np.array(fresh, np.int64)])
        new = ids - (self.base + CLASSES)
        out = new >= 0
        ids[out] = self.base + self.cls[new[out]]
        return ids, np.where(out, new, -1), sizes


def contexts(units: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Units one and two tokens before each token; before a text stand ends."""
    c1, c2 = np.zeros_like(units), np.zeros_like(units)
    c1[1:], c2[2:] = units[:-1], units[:-2]
    starts = np.cumsum(sizes) - sizes
    c1[starts] = c2[starts] = 0
    c2[starts[sizes > 1] + 1] = 0
    return c1, c2


def unit_totals(rest: DataFrame, vocab: Vocabulary, units: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Tokens and distinct words of each unit, over the whole vocabulary."""
    shared = rest.sparkSession.sparkContext.broadcast(vocab.endings)

    def run(batches):
        of, out = Vocabulary([], np.zeros(0), shared.value).class_of, np.zeros((2, CLASSES), np.int64)
        for b in batches:
            cls = np.fromiter((of(w) for w in b.column(0).to_pylist()), np.int64, b.num_rows)
            out[0] += np.bincount(cls, b.column(1).to_numpy(), CLASSES).astype(np.int64)
            out[1] += np.bincount(cls, minlength=CLASSES)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(CLASSES)), pa.array(out[0]), pa.array(out[1])], names=["cls", "n", "types"])

    rows = rest.mapInArrow(lean(run), "cls long, n long, types long").groupBy("cls").agg(F.sum("n").alias("n"), F.sum("types").alias("types")).collect()
    shared.destroy()
    head = units[: len(vocab.words)]
    n, types = np.bincount(head, vocab.counts, UNITS).astype(np.int64), np.bincount(head, minlength=UNITS)
    for r in rows:
        n[1 + OWN + r["cls"]] += r["n"]
        types[1 + OWN + r["cls"]] += r["types"]
    return n, types


def encode(docs: DataFrame, vocab, own) -> DataFrame:
    """row, doc_id, held_out, n_tokens, head_known and head_own (tokens of the vocabulary, and the sum of their logarithms),
    ids (of all tokens, 16 bits each) and tail (each word outside the vocabulary, and how often) of each row."""

    def run(batches):
        lex, row = Lexicon(vocab.value), TaskContext.get().partitionId() << 33
        log_n = np.log10(vocab.value.counts + 0.5)
        for b in batches:
            ids, new, sizes = lex.ids(b.column(2))
            known = (new < 0) & (ids < lex.base)
            value = np.zeros(len(ids))
            value[known] = log_n[ids[known]]
            starts = np.cumsum(sizes) - sizes
            sums = [np.add.reduceat(x, starts) for x in (known.astype(np.int64), value)]
            where = np.flatnonzero(~known)
            end = len(lex.new)  # stands for an end the vocabulary lacks
            pairs, times = np.unique(np.repeat(np.arange(len(sizes)), sizes)[where] * (end + 1) + np.where(new[where] < 0, end, new[where]), return_counts=True)
            of, place = pairs // (end + 1), pairs % (end + 1)
            words = pa.array([lex.new[p] if p < end else END for p in place.tolist()], pa.binary())
            at = np.concatenate([[0], np.cumsum(np.bincount(of, minlength=len(sizes)))]).astype(np.int32)
            tail = pa.ListArray.from_arrays(pa.array(at), pa.StructArray.from_arrays([words, pa.array(times, pa.int64())], names=["word", "times"]))
            raw, ends = ids.astype("<u2").tobytes(), (2 * np.cumsum(sizes)).tolist()
            packed = pa.array([raw[x:y] for x, y in zip([0, *ends], ends, strict=False)], pa.binary())
            key = pa.array(np.arange(row, row + len(sizes)))
            row += len(sizes)
            yield pa.RecordBatch.from_arrays([key, b.column(0), b.column(1), pa.array(sizes), *map(pa.array, sums), packed, tail], names=names)

    names = ["row", "doc_id", "held_out", "n_tokens", "head_known", "head_own", "ids", "tail"]
    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = f"row long, doc_id {kind}, held_out boolean, n_tokens long, head_known long, head_own double, ids binary, tail array<struct<word: binary, times: bigint>>"
    read = docs.select("doc_id", own.alias("held_out"), F.col("text").cast("binary").alias("text"))
    return read.mapInArrow(lean(run), schema)


def unpacked(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All ids of a column, and how many each row has."""
    sizes = pa.compute.binary_length(column).to_numpy() // 2
    return np.frombuffer(b"".join(column.to_pylist()), "<u2").astype(np.int64), sizes.astype(np.int64)


def pair_counts(learned: DataFrame, seen) -> np.ndarray:
    """2 x CONTEXTS x CONTEXTS: how often one unit stands one and two before another, over all rows. A task
    adds up its own share; the size does not depend on the corpus."""

    def run(batches):
        out = np.zeros((2, CONTEXTS * CONTEXTS))
        for b in batches:
            ids, sizes = unpacked(b.column(0))
            t = seen.value[ids]
            for k, c in enumerate(contexts(t, sizes)):
                out[k] += np.bincount(c * CONTEXTS + t, minlength=CONTEXTS * CONTEXTS)
        rows = out.reshape(16, -1)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(16)), pa.array([r.tobytes() for r in rows], pa.binary())], names=["key", "vec"])

    out = np.zeros((16, 2 * CONTEXTS * CONTEXTS // 16))
    for r in summed(learned.mapInArrow(lean(run), "key long, vec binary"), 16).collect():
        out[r["key"]] = np.frombuffer(bytes(r["vec"]), np.float64)
    return out.reshape(2, CONTEXTS, CONTEXTS)


def train(learned: DataFrame, totals: np.ndarray, tables, unit_context: np.ndarray, seed: int = 7) -> Model:
    """The model starts from counts of pairs over all rows. Then every task goes over its own rows from there,
    each position a target, and the mean of what the tasks come to, weighted by their tokens, is the model."""
    spark = learned.sparkSession
    model = Model(totals).start(pair_counts(learned, tables[1]), unit_context)
    start = spark.sparkContext.broadcast((model.flat(), totals))

    def run(batches):
        own, draw, tokens = Model(start.value[1]).load(start.value[0]), np.random.default_rng((seed, TaskContext.get().partitionId())), 0
        for b in batches:
            ids, sizes = unpacked(b.column(0))
            own.train(*contexts(tables[1].value[ids], sizes), tables[0].value[ids], draw)
            tokens += len(ids)
        if tokens:
            flat = np.append(own.flat().astype(np.float64) * tokens, tokens).tobytes()
            yield pa.RecordBatch.from_arrays([pa.array([TaskContext.get().partitionId() % 16]), pa.array([flat], pa.binary())], names=["key", "vec"])

    sums = summed(learned.mapInArrow(lean(run), "key long, vec binary"), 16)
    rows = summed(sums.withColumn("key", F.lit(0).cast("long")), 1).collect()  # one at most; it adds up 16
    start.destroy()
    if rows:
        total = np.frombuffer(bytes(rows[0]["vec"]), np.float64)
        model.load(total[:-1] / total[-1])
    return model


def score_texts(docs: DataFrame, held) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score of each row.

    Learns from the rows that `held` says are not held out. A token's probability is that of its
    unit after the two before it, by the network, times its own share of its unit. A frequent word is a unit, and its share is one;
    in a class of other words it is (c + 0.5) / (n + 0.5 (v + 1)) with c its count, n and v the class's tokens
    and distinct words: each class so holds one unseen word, and the probabilities of all tokens sum to one in any context.
    Null texts are empty: one token, the end. Very long texts are scored whole, in slices. Without a learnable row, all counts
    are zero. Rows with a null doc_id are learned from. Repeated rows are scored and counted each. An empty table gives an
    empty one; columns other than doc_id and text are ignored, whatever their names.
    """
    spark = docs.sparkSession
    send = spark.sparkContext.broadcast
    rows = docs.select("doc_id", "text")
    counts = materialize(word_counts(rows.where(~held), end=True), "counts")
    size = counts.agg(F.sum("n").alias("n"), F.count("*").alias("v")).first()
    n, v = size["n"] or 0, size["v"]
    vocab, rest = vocabulary(counts)
    units, seen = vocab.units(OWN), vocab.units(SEEN)
    shared = send(vocab)
    coded = materialize(encode(rows, shared, held), "coded")
    shared.destroy()
    in_unit, types = unit_totals(rest, vocab, units)
    unit_context = np.zeros(UNITS, np.int64)
    unit_context[units] = seen  # a unit's words beyond SEEN have one class
    tables = (send(units), send(seen))
    scorer = send(train(coded.where("not held_out").select("ids"), in_unit, tables, unit_context).scorer())
    # a unit of one word has that word's whole share
    whole = np.arange(UNITS) <= OWN
    log_total = send(np.where(whole, np.log10(in_unit + 0.5), np.log10(in_unit + 0.5 * (types + 1.0))))
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches):
        for b in batches:
            ids, sizes = unpacked(b.columns[-1])
            t = tables[0].value[ids]
            lp = scorer.value.log_p(*contexts(tables[1].value[ids], sizes), t) / np.log(10.0) - log_total.value[t]
            net = np.add.reduceat(lp, np.cumsum(sizes) - sizes)
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(net)], names=[*names, "net"])

    names = ["row", "doc_id", "held_out", "n_tokens", "head_known", "head_own"]
    schema = f"row long, doc_id {kind}, held_out boolean, n_tokens long, head_known long, head_own double, net double"
    scored = coded.select(*names, "ids").mapInArrow(lean(run), schema)
    tail = coded.select("row", F.explode("tail").alias("t")).select("row", "t.word", "t.times")
    joined = tail.join(rest, "word", "left").select("row", "times", F.coalesce("n", F.lit(0)).alias("n"))
    sums = joined.groupBy("row").agg(
        F.sum(F.col("times") * F.log10(F.col("n") + 0.5)).alias("own"), F.sum(F.when(F.col("n") > 0, F.col("times")).otherwise(0)).alias("known")
    )
    own, known = F.col("head_own") + F.coalesce("own", F.lit(0.0)), F.coalesce("known", F.lit(0))
    return scored.join(sums, "row", "left").select(
        "doc_id", "held_out", "n_tokens", (F.col("head_known") + known).alias("n_known"), F.lit(n).cast("long").alias("train_tokens"),
        (own - F.col("n_tokens") * float(np.log10(n + 0.5 * (v + 1)))).alias("base_score"), (F.col("net") + own).alias("score"),
    )


def op2_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    small_batches(spark, 500)
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return score_texts(docs, fold(F.col("doc_id"), 5) == 1)
