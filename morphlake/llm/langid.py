"""Language ID by cross-parsing entropy over suffix automata (operator 10)."""

from __future__ import annotations

import functools
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import fold, lean, small_batches, table

#: Bound of the labelled sample of a language: rows whose whole texts make its automaton, rows that the
#: score is calibrated on, and the most characters a row may have to be learned from.
SAMPLE_ROWS, FIT_ROWS, LONGEST = 16, 48, 65_536
#: Characters of a run: texts are parsed in runs of so many, and a phrase ends where its run does.
RUN = 512
#: Runs parsed at once.
LANES = 4096
SPACE = 0x20
#: Languages up to which a list of them is sent to every task.
MANY = 10_000
#: Places of a dense table, at four bytes each.
DENSE = 1 << 24


class SuffixAutomaton:
    """All substrings of a text; transitions in one table keyed by state and code point."""

    def __init__(self, text: str):
        step, link, length, last = {}, [-1], [0], 0
        out: list[list[int]] = [[]]  # code points that leave a state, for cloning
        for c in map(ord, text):
            cur = len(length)
            length.append(length[last] + 1)
            link.append(0)
            out.append([])
            p = last
            while p >= 0 and (p << 21 | c) not in step:
                step[p << 21 | c] = cur
                out[p].append(c)
                p = link[p]
            if p >= 0:
                q = step[p << 21 | c]
                if length[p] + 1 == length[q]:
                    link[cur] = q
                else:
                    clone = len(length)
                    length.append(length[p] + 1)
                    link.append(link[q])
                    out.append(list(out[q]))
                    for d in out[q]:
                        step[clone << 21 | d] = step[q << 21 | d]
                    while p >= 0 and step.get(p << 21 | c) == q:
                        step[p << 21 | c] = clone
                        p = link[p]
                    link[q] = link[cur] = clone
            last = cur
        self.step, self.states = step, len(length)


@functools.cache
def _alphabet() -> tuple[np.ndarray, np.ndarray]:
    """Of each code point: 1 for a letter, 2 for white space, 0 for others; and its lower case, the first
    letter of it where that is several."""
    kind, lower = np.zeros(0x110000, np.uint8), np.arange(0x110000, dtype=np.uint32)
    for c in range(0x32000):  # no letter lies beyond
        x = chr(c)
        if x.isalpha():
            kind[c], lower[c] = 1, ord(x.lower()[0])
    kind[[SPACE, *range(9, 14)]] = 2
    return kind, lower


def streams(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(code points, sizes, letters) of UTF-8 texts: of each the lower-cased letters, words kept apart by
    one space, which also stands at both ends; how long that is, and how many letters it has."""
    kind, lower = _alphabet()
    padded = pc.binary_join_element_wise(pa.scalar(b" "), texts.cast(pa.binary()).fill_null(b""), pa.scalar(b" "), pa.scalar(b""))
    raw = [x.decode("utf-8", "replace") for x in padded.to_pylist()]
    sizes = np.fromiter(map(len, raw), np.int64, len(raw))
    codes = np.frombuffer("".join(raw).encode("utf-32-le", "surrogatepass"), np.uint32)
    what = kind[codes]
    doc = np.repeat(np.arange(len(raw)), sizes)
    at = np.flatnonzero(what)
    what, doc = what[at], doc[at]
    again = np.zeros(len(at), bool)
    again[1:] = (what[1:] == 2) & (what[:-1] == 2) & (doc[1:] == doc[:-1])
    at, what, doc = at[~again], what[~again], doc[~again]
    return np.where(what == 2, SPACE, lower[codes[at]]).astype(np.int64), np.bincount(doc, minlength=len(raw)), np.bincount(doc[what == 1], minlength=len(raw))


class CrossParser:
    """The automata of all languages as one table of states and symbols, each language's after the other.

    A state is the place of its row. The table is dense unless that would exceed DENSE places, as with
    large alphabets; then its keys are kept sorted and searched: slower, with the same results."""

    def __init__(self, samples: dict[str, str], dense: int = DENSE):
        self.langs = sorted(samples)
        alphabet = np.unique(np.frombuffer("".join(samples.values()).encode("utf-32-le"), np.uint32))
        #: Symbol of each code point; 0 for what no sample has.
        self.symbol = np.zeros(0x110000, np.int32)
        self.symbol[alphabet] = np.arange(1, len(alphabet) + 1)
        width = len(alphabet) + 1
        keys, to, roots, base = [], [], [], 0
        for lang in self.langs:
            a = SuffixAutomaton(samples[lang])
            from_ = np.fromiter(a.step.keys(), np.int64, len(a.step))
            keys.append(((from_ >> 21) + base) * width + self.symbol[from_ & 0x1FFFFF])
            to.append((np.fromiter(a.step.values(), np.int64, len(a.step)) + base) * width)
            roots.append(base * width)
            base += a.states
        #: What a phrase costs: the logarithm of the places in the sample that it can point to.
        self.cost = np.array([np.log(max(2, len(samples[x]))) for x in self.langs])
        keys, to = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (keys, to))
        self.kind = np.int32 if base * width < 1 << 31 else np.int64
        self.roots = np.array(roots, self.kind)
        #: Where each language's first state goes by each symbol.
        self.first = np.full((width, len(self.langs)), -1, self.kind)
        for k, root in enumerate(roots):
            own = (keys >= root) & (keys < root + width)
            self.first[keys[own] - root, k] = to[own]
        self.table = self.keys = None
        if base * width <= dense:
            self.table = np.full(base * width, -1, self.kind)
            self.table[keys] = to
        else:
            order = np.argsort(keys)
            self.keys, self.to = keys[order], to[order].astype(self.kind)

    def _next(self, keys: np.ndarray) -> np.ndarray:
        """The state each key leads to, -1 if none."""
        if self.table is not None:
            return self.table.take(keys)
        at = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
        return np.where(self.keys[at] == keys, self.to[at], self.kind(-1))

    def phrases(self, symbols: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """texts x languages: the phrases of each text's cross-parsing. A phrase is the longest match
        from where the last one ended; a character that the sample never has is one of its own."""
        runs = -(-sizes // RUN)
        doc = np.repeat(np.arange(len(sizes)), runs)
        k = np.arange(len(doc)) - np.repeat(np.cumsum(runs) - runs, runs)
        start, length = np.repeat(np.cumsum(sizes) - sizes, runs) + k * RUN, np.minimum(RUN, np.repeat(sizes, runs) - k * RUN)
        out = np.zeros((len(sizes), len(self.langs)))
        order = np.argsort(-length, kind="stable")
        for at in range(0, len(order), LANES):
            lanes = order[at : at + LANES]
            found = self._parse(symbols, start[lanes], length[lanes])
            np.add.at(out, doc[lanes], found)
        return out

    def _parse(self, symbols: np.ndarray, start: np.ndarray, length: np.ndarray) -> np.ndarray:
        """lanes x languages; lanes by falling length, so that those still open stand first."""
        n, m = len(start), len(self.roots)
        root = np.tile(self.roots, n)
        state, count = root.copy(), np.zeros(n * m, np.int32)
        open_ = np.searchsorted(-length, -np.arange(int(length[0])), "left") if n else []
        for t, k in enumerate(open_):
            c = symbols[start[:k] + t]
            now, own, counted = state[: k * m], root[: k * m], count[: k * m]
            to, again = self._next(now + np.repeat(c, m)), self.first.take(c, axis=0).ravel()
            miss, never = to < 0, again < 0
            counted += miss & (now != own)
            counted += miss & never
            np.copyto(again, own, where=never)
            np.copyto(to, again, where=miss)
            now[:] = to
        return (count + (state != root)).reshape(n, m)

    def normalised(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(texts x languages: phrases by their cost, a character; characters; letters)."""
        codes, sizes, letters = streams(texts)
        return self.phrases(self.symbol[codes], sizes) * self.cost / np.maximum(sizes, 1)[:, None], sizes, letters


@dataclass
class Model:
    parser: CrossParser
    #: What a unit of normalised phrases counts in the score, for a text of one character.
    sharpness: float

    def shares(self, cost: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """Of each language: its share when a difference of normalised phrases counts as the root of the length."""
        x = -self.sharpness * np.sqrt(sizes)[:, None] * cost
        x = np.exp(x - x.max(axis=1, keepdims=True))
        return x / x.sum(axis=1, keepdims=True)


def learn(docs: DataFrame, rows: int = SAMPLE_ROWS, fit_rows: int = FIT_ROWS, longest: int = LONGEST) -> Model | None:
    """Automata and calibration from rows that the caller says may be learned from; None without any.

    The sample is bounded per language: the `rows` labelled texts of the smallest hashes of their ids make the
    automaton, whole; the `fit_rows` after them choose the sharpness of the score, that of the least loss.
    Texts of more than `longest` characters are not learned from.
    """
    spark = docs.sparkSession
    known = docs.where(F.col("lang").isNotNull() & (F.length("text") <= longest))
    counts = known.groupBy("lang").count().collect()  # a row a language
    if not counts:
        return None
    unit = F.pmod(F.xxhash64(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), F.lit(1 << 30))
    share = spark.createDataFrame([(r["lang"], int(min(1.0, 2 * (rows + fit_rows) / r["count"]) * (1 << 30))) for r in counts], "lang string, most long")
    # a row a language: sent out to the rows, so that no text is shuffled by language, unless there are very many
    picked = known.select("lang", unit.alias("h"), "text").join(F.broadcast(share) if len(counts) <= MANY else share, "lang")
    found: dict[str, list] = {}
    for r in picked.where("h <= most").select("lang", "h", "text").collect():
        found.setdefault(r["lang"], []).append((r["h"], r["text"]))
    samples, fit = {}, []
    for lang, texts in sorted(found.items()):
        texts = [t for _, t in sorted(texts)]
        words = "".join(map(chr, streams(pa.array([" ".join(texts[:rows])]))[0]))
        if words.strip():
            samples[lang] = words
            fit += [(lang, t) for t in texts[rows : rows + fit_rows]]
    if not samples:
        return None
    model = Model(CrossParser(samples), 1.0)
    if fit:
        cost, sizes, letters = model.parser.normalised(pa.array([t for _, t in fit]))
        truth = np.searchsorted(model.parser.langs, [x for x, _ in fit])
        tried, at = np.geomspace(0.01, 10, 61), np.flatnonzero(letters)
        loss, wrong = [], 1 / (len(at) + 2)  # that share of rows may be labelled or found wrong, however few they are
        for s in tried:
            p = np.clip(Model(model.parser, s).shares(cost[at], sizes[at])[np.arange(len(at)), truth[at]], 1e-12, 1 - 1e-12)
            loss.append(-((1 - wrong) * np.log(p) + wrong * np.log(1 - p)).sum())
        model.sharpness = float(tried[int(np.argmin(loss))])
    return model


def predict(docs: DataFrame, model: Model | None, keep: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, the columns of `keep`, lang_pred and score of each row.

    A whole text, lower-cased and reduced to its letters with one space between words, is cross-parsed
    against the automaton of each language; phrases may span words. The number of phrases, times
    the logarithm of the sample's length, is divided by the characters parsed; the language with the least wins, of
    equal ones the first by code point. score is its share when differences count as the learned
    sharpness says. Texts without a letter, null texts, and all texts when nothing was learned, are `und`
    with score 0. Very long texts are parsed whole, run by run. Repeated rows are predicted each; an empty table
    gives an empty one. Columns other than doc_id, text and those of `keep` are ignored, whatever
    their names.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        model = shared.value
        for b in batches:
            n = b.num_rows
            if model is None:
                pred, score = ["und"] * n, np.zeros(n)
            else:
                cost, sizes, letters = model.parser.normalised(b.columns[-1])
                best = cost.argmin(axis=1)
                score = np.where(letters > 0, model.shares(cost, sizes)[np.arange(n), best], 0.0)
                pred = [model.parser.langs[k] if x else "und" for k, x in zip(best.tolist(), letters.tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([*b.columns[: len(names)], pa.array(pred, pa.string()), pa.array(score)], names=[*names, "lang_pred", "score"])

    # the text goes through Python once, whether it is kept or not
    names = ["doc_id", *(c for c in keep if c != "text"), *(["text"] if "text" in keep else [])]
    read = docs.select("doc_id", *(c for c in keep if c != "text"), "text")
    schema = T.StructType([*(T.StructField(c, read.schema[c].dataType) for c in names), T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])
    found = read.mapInArrow(lean(run), schema)
    return found.select("doc_id", *keep, "lang_pred", "score")


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    small_batches(spark, 500)
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    held = (fold(F.col("doc_id"), 3) == 1).alias("held_out")
    found = predict(docs.select("doc_id", "text"), learn(docs.where(~held)))
    return found.select("doc_id", held, "lang_pred", "score")
