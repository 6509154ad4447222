"""Quality rules and n-gram perplexity bands by language (operator 5).

The n-grams are bigrams of whole words. Their model grows with the corpus, so it is never in one place: texts are written
once as chunks of local word numbers; each chunk asks for the counts of its distinct bigrams, then of its distinct words, and
gets them back from tasks that each hold a range of the hashes. What travels is packed: sorted hashes as differences, by byte planes.
"""

from __future__ import annotations

import atexit
import contextlib
import hashlib
import itertools
import struct
import uuid
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.shared import _drop, release, shared_dir
from .common import lean, materialize, small_batches, split_words, table

#: Words that the uniform distribution under the lower order is over.
UNITS = 1 << 24
#: Bits of the hash of a word of a language, and of a bigram: of 2^32 different bigrams about one in a million meets another.
BITS = 52
MASK = np.uint64((1 << BITS) - 1)
#: Half-width of a band: so many robust deviations, but at least a floor (in nats a word); that of a
#: text of n words is wider by the factor 1 + sqrt(FEW / n), as the mean over few words varies more.
DEVIATIONS, FLOOR, FEW = 5.0, 1.25, 20.0
#: Words with their ends, and distinct words, after which a chunk is closed; a text is never cut.
CHUNK, WORDS = 6_000_000, 1_000_000
#: Bigrams and words a task that sums them holds, about; partitions of the table of chunks.
HELD, FILES = 2_000_000, 128
#: Languages up to which a list of them is sent to every task.
MANY = 10_000
SYMBOLS = b"#*$%&|<>"
WINDOW = 8
BASE = "n_words word_chars n_symbols n_dup_lines n_repeat_words".split()


def unit_of(word: str) -> int:
    """A hash of the whole word; upper case is as lower case. 0, which no word has, is the start and end of a text."""
    return 1 + (int.from_bytes(hashlib.blake2b(word.lower().encode("utf-8", "replace"), digest_size=8).digest(), "little") >> 2)


def before_of(cur: np.ndarray, events: np.ndarray) -> np.ndarray:
    """The one before each of the texts end to end, each of so many words and its end; before the first stands the end."""
    before = np.empty_like(cur)
    before[1:] = cur[:-1]
    ends = np.cumsum(events[events > 0])
    before[ends - events[events > 0]] = cur[ends - 1]
    return before


def mixed(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """A hash of BITS bits of two numbers."""
    h = a.astype(np.uint64) ^ (b.astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
    h = (h ^ h >> np.uint64(30)) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ h >> np.uint64(27)) * np.uint64(0x94D049BB133111EB)
    return (h ^ h >> np.uint64(31)) >> np.uint64(64 - BITS)


def pack(x: np.ndarray) -> bytes:
    """Numbers from 0 as byte planes, compressed."""
    x = np.ascontiguousarray(x, np.uint64)
    wide = max(1, (int(x.max(initial=0)).bit_length() + 7) // 8)
    planes = np.ascontiguousarray(x.view(np.uint8).reshape(-1, 8)[:, :wide].T)
    return struct.pack("<QB", len(x), wide) + pa.Codec("zstd", 1).compress(planes.tobytes(), asbytes=True)


def unpack(data: bytes) -> np.ndarray:
    n, wide = struct.unpack_from("<QB", data)
    out = np.zeros((n, 8), np.uint8)
    if n:
        out[:, :wide] = np.frombuffer(pa.Codec("zstd").decompress(data[9:], n * wide, asbytes=True), np.uint8).reshape(wide, n).T
    return out.view(np.int64).reshape(-1)


def pack_keys(x: np.ndarray) -> bytes:
    """Hashes, best sorted, as differences."""
    return pack(np.diff(x, prepend=np.uint64(0)) & MASK)


def unpack_keys(data: bytes) -> np.ndarray:
    return np.cumsum(unpack(data).view(np.uint64), dtype=np.uint64) & MASK


def discounts(c: np.ndarray) -> np.ndarray:
    """groups x 4: what counts of 0, 1, 2 and 3 or more lose, from how many counts are 1 to 4."""
    c = np.maximum(1, c.reshape(-1, 4)).T.astype(np.float64)
    y = c[0] / (c[0] + 2 * c[1])
    d = np.stack([0 * y, 1 - 2 * y * c[1] / c[0], 2 - 3 * y * c[2] / c[1], 3 - 4 * y * c[3] / c[2]], axis=1)
    return np.clip(d, 0, [0, 0.95, 1.9, 2.85])


#: Of a word: how often a word follows it; how many words follow it once, twice, 3, 4 and more times; how many stand before it.
STATS = 7


def word_stats(v: np.ndarray, w: np.ndarray, n: np.ndarray, follows: np.ndarray) -> np.ndarray:
    """STATS x words, of distinct bigrams (v, w) met n times; follows is the first of them."""
    size = len(follows)
    return np.stack([follows, *(np.bincount(v[n == k], minlength=size) for k in (1, 2, 3, 4)), np.bincount(v[n > 4], minlength=size), np.bincount(w, minlength=size)]).astype(np.int64)


def language_sums(stats: np.ndarray, slot: np.ndarray, slots: int) -> np.ndarray:
    """slots x 10, all sums over a language's words: how many bigrams are met 1 to 4 times; how many words stand after
    1 to 4 others, after 3 or more; after how many in all."""
    kinds = stats[6]
    cols = [*stats[1:5], *(kinds == k for k in (1, 2, 3, 4)), kinds >= 3, kinds]
    return np.stack([np.bincount(slot, c, slots) for c in cols], axis=1).round().astype(np.int64)


def word_weights(stats: np.ndarray, slot: np.ndarray, sums: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Lower-order probability of each word, its weight of the lower order, and the discounts of each language."""
    high, low = discounts(sums[:, :4]), discounts(sums[:, 4:8])
    total = np.maximum(1, sums[:, 9])
    spare = (low[:, 1] * sums[:, 4] + low[:, 2] * sums[:, 5] + low[:, 3] * sums[:, 8]) / total
    kinds = stats[6]
    p = (kinds - low[slot, np.minimum(kinds, 3)]) / total[slot] + spare[slot] / UNITS
    left = high[slot, 1] * stats[1] + high[slot, 2] * stats[2] + high[slot, 3] * stats[3:6].sum(0)
    return p, np.where(stats[0] > 0, left / np.maximum(1, stats[0]), 1.0), high


def gram_counts(docs: DataFrame) -> DataFrame:
    """lang (a hash), pair (the units of a word and of the one before, as bytes), n over all texts with a word, of docs
    (lang, text): for tables of which one memory holds all bigrams, as KneserNey does, to score other texts by them."""

    def run(batches):
        for b in batches:
            measures = Measures()
            ids, sizes = measures.ids(b.column(1))
            events = np.where(sizes > 0, sizes + 1, 0)
            cur = np.insert(measures.units[ids], np.cumsum(sizes[sizes > 0]), 0)
            pairs = np.stack([before_of(cur, events), cur], axis=1).astype("<i8")
            langs = np.repeat(b.column(0).to_numpy(), events)
            yield pa.RecordBatch.from_arrays([pa.array(langs), pa.array([x.tobytes() for x in pairs], pa.binary())], names=["lang", "pair"])

    parts = docs.select("lang", F.col("text").cast("binary").alias("text")).mapInArrow(lean(run), "lang long, pair binary")
    return parts.groupBy("lang", "pair").agg(F.count("*").alias("n"))


@dataclass
class KneserNey:
    """Interpolated modified Kneser-Ney over bigrams of words, of all languages, in sorted arrays of hashes."""

    langs: np.ndarray
    sums: np.ndarray
    words: np.ndarray
    stats: np.ndarray
    slot: np.ndarray
    pairs: np.ndarray
    n: np.ndarray

    @classmethod
    def fit(cls, lang: np.ndarray, pair: np.ndarray, n: np.ndarray) -> KneserNey:
        units = np.frombuffer(b"".join(pair), "<i8").reshape(-1, 2)
        before, cur = mixed(lang, units[:, 0]), mixed(lang, units[:, 1])
        langs, own = np.unique(lang, return_inverse=True)
        words, place = np.unique(np.concatenate([before, cur]), return_inverse=True)
        v, w = place[: len(n)], place[len(n) :]
        slot = np.zeros(len(words), np.int64)
        slot[v] = slot[w] = own
        stats = word_stats(v, w, n, np.bincount(v, n, len(words)))
        h = mixed(before, cur)
        order = np.argsort(h)
        return cls(langs, language_sums(stats, slot, len(langs)), words, stats, slot, h[order], n[order])

    def score(self, lang: np.ndarray, before: np.ndarray, cur: np.ndarray) -> np.ndarray:
        """Log-probability of each unit after the one before; languages that the model has."""

        def find(where, key):
            at = np.minimum(np.searchsorted(where, key), len(where) - 1)
            return at, where[at] == key

        slot = np.searchsorted(self.langs, lang)
        a, b = mixed(lang, before), mixed(lang, cur)
        (v, has_v), (w, has_w), (at, met) = find(self.words, a), find(self.words, b), find(self.pairs, mixed(a, b))
        known = [np.where(has, self.stats[:, x], 0) for x, has in ((v, has_v), (w, has_w))]
        return _log(np.where(met, self.n[at], 0), known[0][0], word_weights(known[0], slot, self.sums)[1], word_weights(known[1], slot, self.sums)[0], discounts(self.sums[:, :4])[slot])


def _log(n: np.ndarray, follows: np.ndarray, weight: np.ndarray, lower: np.ndarray, cut: np.ndarray) -> np.ndarray:
    return np.log(np.maximum((n - cut[np.arange(len(n)), np.minimum(n, 3)]) / np.maximum(1, follows) + weight * lower, 1e-12))


class _Words(dict):
    def __missing__(self, word: bytes) -> int:
        self[word] = place = len(self)
        return place


class Measures:
    """Base measures of texts, and their log-probabilities by a model; what a word adds is worked out once for each word."""

    def __init__(self, model: KneserNey | None = None):
        self.model = model
        self.clear()

    def clear(self) -> None:
        self.words, self.chars, self.symbols, self.units = _Words(), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)

    def _grow(self) -> None:
        if fresh := list(itertools.islice(self.words, len(self.chars), None)):
            text = [w.decode("utf-8", "replace") for w in fresh]
            self.chars = np.concatenate([self.chars, np.fromiter(map(len, text), np.int64, len(text))])
            marks = np.fromiter((len(w) - len(w.translate(None, SYMBOLS)) for w in fresh), np.int64, len(fresh))
            self.symbols = np.concatenate([self.symbols, marks])
            self.units = np.concatenate([self.units, np.fromiter(map(unit_of, text), np.int64, len(text))])

    def ids(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        found, index, n = split_words(texts)
        ids = np.fromiter(map(self.words.__getitem__, found), np.int64, len(found))[index]
        self._grow()
        return ids, n

    def base(self, texts: pa.Array) -> tuple[np.ndarray, dict[str, np.ndarray]]:
        ids, n = self.ids(texts)
        doc = np.repeat(np.arange(len(n)), n)
        sums = lambda x: np.bincount(doc, x, len(n)).astype(np.int64)
        lines = [[x for x in (t or b"").split(b"\n") if x.strip()] for t in texts.to_pylist()]
        dup = np.array([len(x) - len(set(x)) for x in lines], np.int64)
        return ids, dict(zip(BASE, (n, sums(self.chars[ids]), sums(self.symbols[ids]), dup, repeated(ids, doc, len(n))), strict=True))

    def of(self, texts: pa.Array, langs: np.ndarray) -> dict[str, np.ndarray]:
        ids, found = self.base(texts)
        n = found["n_words"]
        events = np.where(n > 0, n + 1, 0)
        cur = np.insert(self.units[ids], np.cumsum(n[n > 0]), 0)
        doc = np.repeat(np.arange(len(n)), events)
        logp = self.model.score(langs[doc], before_of(cur, events), cur)
        return found | {"nats": -np.bincount(doc, logp, len(n)) / np.maximum(1, events)}


def repeated(ids: np.ndarray, doc: np.ndarray, texts: int) -> np.ndarray:
    """Words of each text in windows of WINDOW words that the text has twice or more, by 64-bit hash."""
    out = np.zeros(texts, np.int64)
    if len(ids) < WINDOW:
        return out
    mixed = (ids.astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
    mixed ^= mixed >> np.uint64(29)
    mixed *= np.uint64(0xBF58476D1CE4E5B9)
    m = len(ids) - WINDOW + 1
    h = np.zeros(m, np.uint64)
    for k in range(WINDOW):
        h = h * np.uint64(0xD6E8FEB86659FD93) + mixed[k : k + m]
    h ^= h >> np.uint64(31)
    h = (h + doc[:m].astype(np.uint64)) * np.uint64(0x94D049BB133111EB)  # equal windows of other texts differ
    inside = doc[:m] == doc[WINDOW - 1 :]
    at = np.flatnonzero(inside)
    order = at[np.argsort(h[at], kind="stable")]
    same = (h[order[1:]] == h[order[:-1]]) & (doc[order[1:]] == doc[order[:-1]])
    twice = np.zeros(len(order), bool)
    twice[1:] |= same
    twice[:-1] |= same
    step = np.zeros(len(ids) + 1, np.int64)
    starts = order[twice]
    step[starts] += 1
    step[starts + WINDOW] -= 1
    return np.bincount(doc, np.cumsum(step[:-1]) > 0, texts).astype(np.int64)


def _lists(parts: list[pa.Array]) -> pa.Array:
    """One list of all values."""
    values = pa.concat_arrays(parts)
    return pa.ListArray.from_arrays(pa.array([0, len(values)], pa.int32()), values)


def chunked(rows: DataFrame) -> DataFrame:
    """Rows (doc_id, lang, text) as chunks: the measures of the texts, the hashes of the distinct words, each language's
    by falling count, and the words of the texts with their ends by place among those of their language."""

    def closed(chunk, measures, held):
        ids, langs = (np.concatenate([h[k] for h in held]) for k in (0, 1))
        found = {k: np.concatenate([h[2][k] for h in held]) for k in BASE}
        n = found["n_words"]
        events = np.where(n > 0, n + 1, 0)
        langs, slot = np.unique(langs, return_inverse=True)
        units, of = np.unique(np.append(measures.units, 0), return_inverse=True)  # 0, the end, is the first
        each = np.repeat(slot, events) * len(units) + np.insert(of[ids], np.cumsum(n[n > 0]), 0)
        if len(langs) * len(units) <= 1 << 25:
            counts = np.bincount(each, minlength=len(langs) * len(units))
            kinds = np.flatnonzero(counts)
            counts, at = counts[kinds], np.zeros(len(counts), np.int64)
            at[kinds] = np.arange(len(kinds))
            at = at[each]
        else:
            kinds, at, counts = np.unique(each, return_inverse=True, return_counts=True)
        own = kinds // len(units)
        keys = mixed(langs[own], units[kinds % len(units)])
        order = np.lexsort((keys, -counts, own))
        place = np.empty(len(order), np.int64)
        place[order] = np.arange(len(order))
        width = np.bincount(own, minlength=len(langs))
        tokens = place[at] - np.repeat((np.cumsum(width) - width)[slot], events)
        cols = [pa.array([chunk]), pa.array([int(events.sum())]), pa.array([len(keys)]), _lists([h[3] for h in held]), _lists([pa.array(slot, pa.int64())]), _lists([pa.array(langs, pa.int64())]), _lists([pa.array(width, pa.int64())])]
        cols += [_lists([pa.array(found[k], pa.int64())]) for k in BASE] + [pa.array([pack_keys(keys[order])]), pa.array([pack(tokens)])]
        return pa.RecordBatch.from_arrays(cols, names=names)

    def run(batches):
        first, made, held, size, measures = TaskContext.get().partitionId() << 32, 0, [], 0, Measures()
        for b in batches:
            ids, found = measures.base(b.column(2))
            held.append((ids.astype(np.int32), b.column(1).to_numpy(), found, b.column(0)))
            size += len(ids) + b.num_rows
            if size > CHUNK or len(measures.words) > WORDS:
                yield closed(first + made, measures, held)
                made, held, size = made + 1, [], 0
                measures.clear()
        if held:
            yield closed(first + made, measures, held)

    names = ["chunk", "events", "kinds", "ids", "slot", "langs", "width", *BASE, "words", "tokens"]
    kind = rows.schema["doc_id"].dataType.simpleString()
    schema = f"chunk long, events long, kinds long, ids array<{kind}>, slot array<long>, langs array<long>, width array<long>, {', '.join(f'{k} array<long>' for k in BASE)}, words binary, tokens binary"
    return rows.withColumn("text", F.col("text").cast("binary")).mapInArrow(lean(run), schema)


def bucketed(df: DataFrame) -> tuple[DataFrame, str]:
    """df written to the shared folder, in files by its chunk, so that it is met by chunk without a shuffle of its own."""
    spark, name = df.sparkSession, f"morphlake_chunks_{uuid.uuid4().hex}"
    path = f"{shared_dir(spark)}/morphlake/{name}"
    df.write.option("path", path).option("compression", "uncompressed").bucketBy(FILES, "chunk").saveAsTable(name)  # what is large is compressed
    atexit.register(_drop, spark, path)
    return spark.table(name), name


@contextlib.contextmanager
def cleaned(spark: SparkSession):
    """Inside, the shuffle files of each query go when it has ended: what it wrote is all that is read again."""
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    was = spark.conf.get(key, "false")
    spark.conf.set(key, "true")
    try:
        yield
    finally:
        spark.conf.set(key, was)


class Chunk:
    """A chunk's words and distinct bigrams: of each the hash, and their order by it."""

    def __init__(self, rows: pa.Table | pa.RecordBatch):
        row = {k: rows.column(k)[0] for k in rows.schema.names}
        array = lambda k: row[k].values.to_numpy(zero_copy_only=False).astype(np.int64)
        self.chunk, self.slot, self.langs, self.width, self.n = row["chunk"].as_py(), array("slot"), array("langs"), array("width"), array("n_words")
        self.keys = unpack_keys(row["words"].as_py())
        self.events = np.where(self.n > 0, self.n + 1, 0)
        self.base = np.cumsum(self.width) - self.width
        self.cur = (unpack(row["tokens"].as_py()) + np.repeat(self.base[self.slot], self.events)).astype(np.int32)
        self.before = before_of(self.cur, self.events)
        self.own = np.repeat(np.arange(len(self.langs)), self.width)

    def bigrams(self, inverse: bool = False) -> None:
        packed = self.before.astype(np.int64) * max(1, len(self.keys)) + self.cur
        found = np.unique(packed, return_inverse=inverse, return_counts=not inverse)
        self.met = found[1]  # how often, or of each word its bigram
        self.v, self.w = (x.astype(np.int32) for x in np.divmod(found[0], max(1, len(self.keys))))
        self.h = mixed(self.keys[self.v], self.keys[self.w])
        self.order = np.argsort(self.h)

    def answered(self, rows: pa.Table) -> np.ndarray:
        """What came back of each bigram."""
        got = sorted(zip(rows.column("bucket").to_pylist(), rows.column("data").to_pylist(), strict=True))
        out = np.empty(len(self.order), np.int64)
        out[self.order] = np.concatenate([np.zeros(0, np.int64), *(unpack(d) for _, d in got)])
        return out

    def by_bucket(self, bits: int):
        """(bucket, language's slot, places of its words by hash), in runs."""
        for k, (base, width) in enumerate(zip(self.base.tolist(), self.width.tolist(), strict=True)):
            at = base + np.argsort(self.keys[base : base + width])
            for bucket, a, b in spans(self.keys[at], bits):
                yield bucket, k, at[a:b]


def spans(keys: np.ndarray, bits: int) -> list[tuple[int, int, int]]:
    """(bucket, from, to) of sorted hashes: their first bits are the bucket."""
    top = (keys >> np.uint64(BITS - bits)).astype(np.int64)
    starts = np.flatnonzero(np.diff(top, prepend=-1))
    if not len(starts):
        return []
    return list(zip(top[starts].tolist(), starts.tolist(), np.append(starts[1:], len(top)).tolist(), strict=True))


def bits_for(total: int, least: int) -> int:
    return max(least, (total // HELD).bit_length())


def _merged(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Order by hash, where in it each distinct one starts, and of each hash its place among the distinct ones."""
    order = np.argsort(keys, kind="stable")
    new = np.append(True, keys[order][1:] != keys[order][:-1])
    place = np.empty(len(keys), np.int64)
    place[order] = np.cumsum(new) - 1
    return order, np.flatnonzero(new), place


def bigram_counts(chunks: DataFrame, bits: int) -> DataFrame:
    """chunk, bucket, data: of each distinct bigram of a chunk, by hash, twice its count over all chunks, and 1 more in one of the chunks."""

    def ask(batches):
        for b in batches:
            for k in range(b.num_rows):
                c = Chunk(b.slice(k, 1))
                c.bigrams()
                h, n = c.h[c.order], c.met[c.order]
                at = spans(h, bits)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([x[0] for x in at], pa.int32()), pa.array([c.chunk] * len(at), pa.int64()), pa.array([pack_keys(h[i:j]) for _, i, j in at], pa.binary()), pa.array([pack(n[i:j]) for _, i, j in at], pa.binary())], names=["bucket", "chunk", "keys", "n"]
                )

    def count(rows: pa.Table) -> pa.Table:
        keys, n = [unpack_keys(x) for x in rows.column("keys").to_pylist()], [unpack(x) for x in rows.column("n").to_pylist()]
        ends = np.cumsum([len(x) for x in keys])[:-1]
        keys, n = np.concatenate(keys), np.concatenate(n)
        order, starts, place = _merged(keys)
        out = 2 * np.add.reduceat(n[order], starts)[place]
        out[order[starts]] += 1
        return pa.table({"chunk": rows.column("chunk"), "bucket": rows.column("bucket"), "data": pa.array([pack(x) for x in np.split(out, ends)], pa.binary())})

    return chunks.select(*CHUNK_WORDS).mapInArrow(lean(ask), "bucket int, chunk long, keys binary, n binary").groupBy("bucket").applyInArrow(lean_group(count), "chunk long, bucket int, data binary")


CHUNK_WORDS = ["chunk", "slot", "langs", "width", "n_words", "words", "tokens"]


def lean_group(f):
    """As lean, of a function of one group, or of one of each side."""

    def run(*tables):
        return next(lean(lambda got: iter([f(*got)]))(tables))

    return (lambda left, right: run(left, right)) if f.__code__.co_argcount == 2 else (lambda rows: run(rows))


def word_counts(chunks: DataFrame, pairs: DataFrame, bits: int) -> DataFrame:
    """chunk, bucket, lang, data: the STATS over all chunks of a chunk's words of a language, by hash; and rows of chunk null: lang, sums of the languages' words."""

    def ask(left: pa.Table, right: pa.Table) -> pa.Table:
        c = Chunk(left)
        c.bigrams()
        got = c.answered(right)
        first = got % 2 == 1
        stats = word_stats(c.v[first], c.w[first], got[first] // 2, np.bincount(c.before, minlength=len(c.keys)))
        rows = [(bucket, c.chunk, int(c.langs[k]), pack_keys(c.keys[at]), pack(stats[:, at].ravel())) for bucket, k, at in c.by_bucket(bits)]
        kinds = [pa.int32(), pa.int64(), pa.int64(), pa.binary(), pa.binary()]
        return pa.table([pa.array([r[k] for r in rows], t) for k, t in enumerate(kinds)], names=["bucket", "chunk", "lang", "keys", "stats"])

    def count(rows: pa.Table) -> pa.Table:
        keys = [unpack_keys(x) for x in rows.column("keys").to_pylist()]
        sizes = [len(x) for x in keys]
        stats = np.concatenate([unpack(x).reshape(STATS, -1) for x in rows.column("stats").to_pylist()], axis=1)
        langs, slot = np.unique(rows.column("lang").to_numpy(), return_inverse=True)
        order, starts, place = _merged(np.concatenate(keys))
        total = np.add.reduceat(stats[:, order], starts, axis=1)
        sums = language_sums(total, np.repeat(slot, sizes)[order[starts]], len(langs))
        data = [pack(x.ravel()) for x in np.split(total[:, place], np.cumsum(sizes)[:-1], axis=1)]
        none = [None] * len(langs)
        return pa.table({
            "chunk": pa.array(rows.column("chunk").to_pylist() + none, pa.int64()), "bucket": pa.array(rows.column("bucket").to_pylist() + none, pa.int32()),
            "lang": pa.array(rows.column("lang").to_pylist() + langs.tolist(), pa.int64()), "data": pa.array(data + none, pa.binary()), "sums": pa.array([None] * len(data) + sums.tolist(), pa.list_(pa.int64())),
        })

    asked = chunks.select(*CHUNK_WORDS).groupBy("chunk").cogroup(pairs.groupBy("chunk")).applyInArrow(lean_group(ask), "bucket int, chunk long, lang long, keys binary, stats binary")
    return asked.groupBy("bucket").applyInArrow(lean_group(count), "chunk long, bucket int, lang long, data binary, sums array<long>")


def scored(chunks: DataFrame, answers: DataFrame) -> DataFrame:
    """doc_id, lang, the base measures and nats of each text, of answers (chunk, bucket, lang, data, sums): of bigrams where lang is null, else of words."""
    kind = chunks.schema["ids"].dataType.elementType.simpleString()

    def score(left: pa.Table, right: pa.Table) -> pa.Table:
        c = Chunk(left)
        c.bigrams(inverse=True)
        c.cur = c.before = c.h = None  # large
        asks = right.column("sums").is_null()
        n = c.answered(right.filter(asks)) // 2
        stats, sums = np.zeros((STATS, len(c.keys)), np.int64), np.zeros((len(c.langs), 10), np.int64)
        by_lang: dict[int, list[dict]] = {}  # the words of a language, by hash, are its buckets' one after the other
        for r in right.filter(pc.invert(asks)).sort_by("bucket").select(["lang", "data", "sums"]).to_pylist():
            by_lang.setdefault(r["lang"], []).append(r)
        for k, (base, width) in enumerate(zip(c.base.tolist(), c.width.tolist(), strict=True)):
            if width:
                own = by_lang[int(c.langs[k])]
                stats[:, base + np.argsort(c.keys[base : base + width])] = np.concatenate([unpack(r["data"]).reshape(STATS, -1) for r in own], axis=1)
                sums[k] = own[0]["sums"]
        p, weight, high = word_weights(stats, c.own, sums)
        logp = _log(n, stats[0][c.v], weight[c.v], p[c.w], high[c.own[c.v]])
        doc = np.repeat(np.arange(len(c.n)), c.events)
        nats = -np.bincount(doc, logp[c.met], len(c.n)) / np.maximum(1, c.events)
        flat = lambda k: left.column(k)[0].values
        return pa.table([flat("ids"), pa.array(c.langs[c.slot]), *(flat(k) for k in BASE), pa.array(nats)], names=["doc_id", "lang", *BASE, "nats"])

    schema = f"doc_id {kind}, lang long, {', '.join(f'{k} long' for k in BASE)}, nats double"
    return chunks.groupBy("chunk").cogroup(answers.groupBy("chunk")).applyInArrow(lean_group(score), schema)


def rule_verdicts(docs: DataFrame) -> DataFrame:
    """Measures and verdict of each row: doc_id, n_words, word_chars, n_symbols, n_dup_lines,
    n_repeat_words, base_failed, kept, nats (log-perplexity a word, the end counted as one), low and high (the band).

    The model of a language, any number of them, is counted over all its texts, word after word. Its band is the
    median of the nats of its texts that pass the base rules, plus and minus the larger of DEVIATIONS robust deviations
    and FLOOR, wider for short texts; a text outside is rejected. Null texts are empty, and fail for their length. Null
    languages are a language. Very long texts are measured whole. Repeated rows are counted and measured each. An empty table
    gives an empty one. Columns other than doc_id, text and lang are ignored, whatever their names.
    """
    spark, rows = docs.sparkSession, docs.select("doc_id", F.xxhash64("lang").alias("lang"), "text")
    chunks, name = bucketed(chunked(rows))
    events, kinds = (int(x or 0) for x in chunks.agg(F.sum("events"), F.sum("kinds")).first())
    with cleaned(spark):
        pairs = materialize(bigram_counts(chunks, bits_for(events, 6)), "bigrams")
        words = materialize(word_counts(chunks, pairs, bits_for(kinds, 5)), "words")

        # a row a language, sent out to the texts unless there are very many: else one language would be one task
        sums = materialize(words.where("chunk is null").groupBy("lang").agg(F.array(*[F.sum(F.col("sums")[k]) for k in range(10)]).alias("sums")), "languages")
        few = sums.count() <= MANY
        sent = (lambda df: F.broadcast(df)) if few else (lambda df: df)
        told = words.where("chunk is not null").drop("sums").join(sent(sums), "lang").select("chunk", "bucket", "lang", "data", "sums")
        answers = pairs.select("chunk", "bucket", F.lit(None).cast("long").alias("lang"), "data", F.lit(None).cast("array<long>").alias("sums")).unionAll(told)
        failed = (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))
        made = materialize(scored(chunks, answers).withColumn("base_failed", failed), "measures")
    for done in (pairs, words):
        release(done)
    spark.sql(f"drop table {name}")
    _drop(spark, f"{shared_dir(spark)}/morphlake/{name}")

    passed = made.where("not base_failed")
    middle = materialize(passed.groupBy("lang").agg(F.percentile_approx("nats", 0.5, 10_000).alias("mid")), "middle")
    spread = passed.join(sent(middle), "lang").groupBy("lang", "mid").agg(F.percentile_approx(F.abs(F.col("nats") - F.col("mid")), 0.5, 10_000).alias("spread"))
    bands = materialize(spread.select("lang", "mid", F.greatest(F.lit(DEVIATIONS * 1.4826) * F.col("spread"), F.lit(FLOOR)).alias("half")), "bands")
    width = F.col("half") * (1 + F.sqrt(FEW / F.greatest("n_words", F.lit(1))))
    banded = made.join(sent(bands), "lang", "left").withColumns({"low": F.col("mid") - width, "high": F.col("mid") + width})
    kept = ~F.col("base_failed") & F.coalesce(F.col("nats").between(F.col("low"), F.col("high")), F.lit(True))
    return banded.select("doc_id", *BASE, "base_failed", kept.alias("kept"), "nats", "low", "high")


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    small_batches(spark, 500)
    return rule_verdicts(table(spark, sf_dir, "documents").select("doc_id", "text", "lang"))
