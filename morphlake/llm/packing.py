"""Hierarchical multi-length packing of tokenized documents (operator 9)."""

from __future__ import annotations

import heapq
import os
import zlib
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import lean, small_batches, split_words, table

WINDOW = 2048
#: Context sizes, largest first.
TIERS = (2048, 1024, 512, 256)
END_ID = 1
GROUPS = 8
#: Words a task remembers, words encoded at once, and those of them in one string.
MEMORY, CHUNK, JOINED = 300_000, 8192, 256
#: What a word is cut before: ASCII marks but the apostrophe, which makes endings of its own.
PUNCTUATION = b"!\"#$%&()*+,-./:;<=>?@[\\]^_`{|}~"


class WordTokenizer:
    """Ids of texts by a tokenizer for which white space always ends a token and is dropped, which
    lower-cases, takes letters and punctuation apart, and marks the last token of each piece.

    Each distinct word is worked out once and remembered; texts are then gathered from the memory. A
    word is cut before the ASCII punctuation it ends with, so that its letters are encoded once whatever
    follows them, and words of letters only are encoded many in one string, where the marks tell them apart.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core; threads would each keep memory
        from tokenizers import Tokenizer

        self.encoder = Tokenizer.from_file(path)
        self.encoder.encode_special_tokens = True  # their strings in a text are ordinary text
        vocab = self.encoder.get_vocab(with_added_tokens=True)
        self.last = np.zeros(max(vocab.values()) + 1, bool)
        self.last[[i for t, i in vocab.items() if t.endswith("</w>")]] = True
        self._clear()

    def _clear(self) -> None:
        self.places: dict[bytes, int] = _Places()
        self.parts: dict[bytes, int] = _Places({b"": 0})
        self.words, self.pieces = _Ids(), _Ids()
        self.pieces.add(np.zeros(0, np.uint32), np.zeros(1, np.int64))

    def _encode_parts(self) -> None:
        fresh = list(self.parts)[len(self.pieces.sizes) :]
        for at in range(0, len(fresh), CHUNK):  # an encoding holds far more than its ids
            part = [w.decode("utf-8", "replace") for w in fresh[at : at + CHUNK]]
            plain = [k for k, w in enumerate(part) if w.isalpha()]
            joined = [plain[k : k + JOINED] for k in range(0, len(plain), JOINED)]
            found = self.encoder.encode_batch([" ".join(part[k] for k in ks) for ks in joined], add_special_tokens=False)
            ids, sizes, order = [], [], []
            for ks, e in zip(joined, found, strict=True):
                got = np.array(e.ids, np.uint32)
                ends = np.flatnonzero(self.last[got]) + 1
                if len(ends) == len(ks):  # else a letter was taken apart: these are encoded alone
                    ids.append(got)
                    sizes.append(np.diff(ends, prepend=0))
                    order += ks
            alone = sorted(set(range(len(part))).difference(order))
            got = [e.ids for e in self.encoder.encode_batch([part[k] for k in alone], add_special_tokens=False)]
            ids.append(np.fromiter(chain.from_iterable(got), np.uint32))
            sizes.append(np.fromiter(map(len, got), np.int64, len(got)))
            self.pieces.add(np.concatenate(ids), np.concatenate(sizes), np.array(order + alone, np.int64))

    def _encode_new(self) -> None:
        if not (fresh := list(self.places)[len(self.words.sizes) :]):
            return
        cores = [w.rstrip(PUNCTUATION) for w in fresh]
        for k, (w, c) in enumerate(zip(fresh, cores, strict=True)):
            if len(c) < len(w) and c and not (c[-1:].isalnum() if c[-1] < 128 else c.decode("utf-8", "replace").lower()[-1].isalnum()):
                cores[k] = w  # what stands before may join the punctuation
        place = np.empty(2 * len(fresh), np.int64)
        place[::2] = np.fromiter(map(self.parts.__getitem__, cores), np.int64, len(fresh))
        place[1::2] = np.fromiter((self.parts[w[len(c) :]] for w, c in zip(fresh, cores, strict=True)), np.int64, len(fresh))
        self._encode_parts()
        ids, sizes = self.pieces.gather(place)
        self.words.add(ids, sizes[::2] + sizes[1::2])

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids in one array, the end id after each text, and the ids of each text counted."""
        if len(self.places) > MEMORY:
            self._clear()
        found, index, words = split_words(texts, lower=True)
        place = np.fromiter(map(self.places.__getitem__, found), np.int64, len(found))[index]
        self._encode_new()
        ids, of_word = self.words.gather(place)
        before = np.concatenate([[0], np.cumsum(of_word)])
        ends = np.cumsum(words)
        return np.insert(ids, before[ends], END_ID), before[ends] - before[ends - words] + 1


class _Places(dict):
    def __missing__(self, word: bytes) -> int:
        self[word] = place = len(self)
        return place


class _Ids:
    """Id lists of different lengths, end to end."""

    def __init__(self):
        self.flat, self.starts, self.sizes = np.zeros(0, np.uint32), np.zeros(0, np.int64), np.zeros(0, np.int64)

    def add(self, ids: np.ndarray, sizes: np.ndarray, order: np.ndarray | None = None) -> None:
        """Appends lists; with `order`, the k-th of them stands at place order[k] of the new ones."""
        starts = len(self.flat) + np.cumsum(sizes) - sizes
        if order is not None:
            back = np.argsort(order)
            starts, sizes = starts[back], sizes[back]
        self.starts, self.sizes = np.concatenate([self.starts, starts]), np.concatenate([self.sizes, sizes])
        self.flat = np.concatenate([self.flat, ids])

    def gather(self, place: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The lists at the places, end to end, and their lengths."""
        sizes = self.sizes[place]
        before = np.cumsum(sizes) - sizes
        return self.flat[np.repeat(self.starts[place] - before, sizes) + np.arange(int(sizes.sum()))], sizes


class Packer:
    """Packs pieces (doc, start, ids) into sequences; out gets a tuple for each piece laid down.

    Whole windows are cut from long documents at once. What remains goes to the tier of the smallest
    context that holds it; each tier's piece opens a window of that size and the gap is filled from
    shorter tiers, the longest piece that fits first, the last one cut to fit. A window that cannot
    be filled yet waits for more documents. At the end what waits is laid end to end and cut into
    windows that are powers of two, which need no padding.
    """

    def __init__(self, tiers: tuple[int, ...] = TIERS, groups: int = GROUPS):
        self.tiers, self.waiting = tiers, {t: [] for t in tiers}
        self.loads = [(0, g) for g in range(groups)]
        self.sequence, self.out = 0, []

    def _tier(self, n: int) -> int:
        return next(t for t in reversed(self.tiers) if n <= t)

    def add(self, doc, ids: np.ndarray) -> None:
        """Takes all ids of one document."""
        full, top = len(ids) // self.tiers[0] * self.tiers[0], self.tiers[0]
        for at in range(0, full, top):
            self._lay([(doc, at, ids[at : at + top])])
        if full < len(ids):
            self._wait((doc, full, ids[full:]))

    def _wait(self, piece) -> None:
        self.waiting[self._tier(len(piece[2]))].append(piece)

    def _lay(self, pieces) -> None:
        """One sequence; it goes to the step group with the fewest tokens so far."""
        size = sum(len(p[2]) for p in pieces)
        load, group = heapq.heappop(self.loads)
        heapq.heappush(self.loads, (load + size, group))
        at = 0
        for doc, start, ids in pieces:
            self.out.append((doc, start, len(ids), zlib.crc32(ids.astype("<u4", copy=False).tobytes()), self.sequence, at, size, group))
            at += len(ids)
        self.sequence += 1

    def pack(self) -> None:
        """Closes every window that can be filled."""
        for k, tier in enumerate(self.tiers[:-1]):
            shorter = self.tiers[k + 1 :]
            spare = sum(len(p[2]) for t in shorter for p in self.waiting[t])
            opened, self.waiting[tier] = self.waiting[tier], []
            for n, piece in enumerate(opened):
                gap, window = tier - len(piece[2]), [piece]
                if gap > spare:
                    self.waiting[tier].extend(opened[n:])
                    break
                spare -= gap
                while gap:
                    fits = next((t for t in shorter if self.waiting[t] and len(self.waiting[t][-1][2]) <= gap), None)
                    if fits:
                        window.append(self.waiting[fits].pop())
                    else:  # cut one: the shortest tier's, so that longer pieces stay whole
                        doc, start, ids = self.waiting[next(t for t in reversed(shorter) if self.waiting[t])].pop()
                        window.append((doc, start, ids[:gap]))
                        self._wait((doc, start + gap, ids[gap:]))
                    gap -= len(window[-1][2])
                self._lay(window)
        small, low = self.tiers[-1], self.waiting[self.tiers[-1]]
        held = sum(len(p[2]) for p in low)
        while held >= small and len(low) > 64:  # the shortest tier fills its own windows; some stay to fill gaps
            self._cut(low, small)
            held -= small

    def _cut(self, pieces: list, size: int) -> None:
        """Lays `size` ids from the end of `pieces` as one sequence."""
        window = []
        while size:
            doc, start, ids = pieces.pop()
            if len(ids) > size:
                pieces.append((doc, start + size, ids[size:]))
                ids = ids[:size]
            window.append((doc, start, ids))
            size -= len(ids)
        self._lay(window)

    def finish(self) -> None:
        rest = [p for t in reversed(self.tiers) for p in self.waiting[t]]
        self.waiting = {t: [] for t in self.tiers}
        left = sum(len(p[2]) for p in rest)
        while left:
            size = min(self.tiers[0], 1 << (left.bit_length() - 1))
            self._cut(rest, size)
            left -= size


def pack_documents(docs: DataFrame, path: str, tiers: tuple[int, ...] = TIERS) -> DataFrame:
    """Packs every row's text; one row per piece.

    Columns: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, sequence_tokens,
    context (the tier the sequence fits) and step_group. Each task packs its own rows in one pass:
    nothing is shuffled, and a lost task's rerun over the same rows gives the same pieces. Null
    and empty texts are a document of the end id alone; a very long text is encoded whole and cut into windows. Repeated rows are documents of their own.
    Columns other than doc_id and text are ignored; an empty table gives an empty one.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches):
        tokenizer, packer, base = WordTokenizer(path), Packer(tiers), TaskContext.get().partitionId() << 33
        names = {}

        def laid():
            rows, packer.out = packer.out, []
            cols = list(zip(*rows, strict=True)) if rows else [[]] * 8
            ids, totals = zip(*(names[d] for d in cols[0]), strict=True) if rows else ([], [])
            open_ = {p[0] for t in packer.tiers for p in packer.waiting[t]}
            for d in [d for d in names if d not in open_]:
                del names[d]
            sizes = np.array(cols[6], np.int64)
            contexts = np.array([packer._tier(int(s)) for s in sizes], np.int32)
            seq = np.array(cols[4], np.int64) + base
            arrays = [pa.array(ids, kind_arrow[0]), cols[1], cols[2], cols[3], totals, seq, cols[5], sizes, contexts, cols[7]]
            types = [kind_arrow[0], *[pa.int64()] * 7, pa.int32(), pa.int32()]
            return pa.RecordBatch.from_arrays([pa.array(a, t) for a, t in zip(arrays, types, strict=True)], names=columns)

        kind_arrow, doc = [pa.int64()], 0
        for b in batches:
            kind_arrow[0] = b.column(0).type
            ids, sizes = tokenizer.encode(b.column(1))
            ends = np.cumsum(sizes)
            for name, end, size in zip(b.column(0).to_pylist(), ends.tolist(), sizes.tolist(), strict=True):
                names[doc] = (name, size)
                packer.add(doc, ids[end - size : end])
                doc += 1
            packer.pack()
            for t in packer.tiers:  # what waits must not hold its whole batch in memory
                packer.waiting[t] = [(d, s, x.copy()) for d, s, x in packer.waiting[t]]
            if packer.out:
                yield laid()
        packer.finish()
        if packer.out:
            yield laid()

    columns = "doc_id start length ids_crc32 doc_tokens sequence_id offset sequence_tokens context step_group".split()
    schema = f"doc_id {kind}, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, `offset` long, sequence_tokens long, context int, step_group int"
    return docs.select("doc_id", F.col("text").cast("binary").alias("text")).mapInArrow(lean(run), schema)


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    small_batches(spark, 1000)
    return pack_documents(table(spark, sf_dir, "documents"), tokenizer_path())
