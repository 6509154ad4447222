"""Main text of web pages: markup zones and a suffix array over each host's pages (operator 8)."""

from __future__ import annotations

import html
import re
from hashlib import blake2b
from itertools import chain

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import lean, materialize, small_batches, table

#: Tokens of the shortest repeated run; the distinct pages, and the share of a host's, that make it boilerplate;
#: and the same inside an article element, where a passage may be quoted.
RUN = 8
PAGES, SHARE = 3, 0.2
ARTICLE_PAGES, ARTICLE_SHARE = 5, 0.5
#: A page that repeated runs cover by more than this inside its article, main or content elements is a copy of others: it keeps them.
COPY = 0.5
#: Pages, and characters, that meet in one suffix array.
CHUNK_PAGES, CHUNK_CHARS = 256, 16_000_000
#: Hosts of several chunks, up to which a task gets the list of them and of what they repeat.
HOT_HOSTS = 100_000

#: Zones of a block, the better the higher.
DROPPED, LOOSE, CONTENT, MAIN, ARTICLE = range(5)

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style noscript template textarea title iframe xmp noembed noframes svg math".split())
DROP_TAGS = frozenset("head nav footer aside form button select option optgroup datalist fieldset label menu dialog canvas audio video object map".split()) | RAW
BLOCK_TAGS = frozenset(
    "address article aside blockquote body br caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
    "header hgroup hr html legend li main menu nav ol option p pre section select summary table tbody td tfoot th thead tr ul".split()
)
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: An open tag of the first kind ends where one of the second begins.
IMPLIED = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
ROLES = frozenset("navigation banner contentinfo complementary search form dialog alertdialog alert menu menubar toolbar".split())
#: Words of a class or id that mark boilerplate as its last word; those of STRONG also as its first.
STRONG = frozenset(
    "ad ads advert adverts advertisement advertising sponsor sponsored promo promotion cookie cookies consent gdpr nav navbar navigation menu "
    "sidebar breadcrumb breadcrumbs comment comments disqus newsletter subscribe share sharing social related recommended popup modal".split()
)
WEAK = STRONG | frozenset("header masthead footer foot banner notice notices alert disclaimer signup login search widget widgets aside replies respond reply pagination pager toolbar copyright legal form responses discussion reviews teaser outbrain taboola topbar bottombar".split())
#: Elements that bound an implied end.
LISTS = ("ul", "ol", "dl", "table", "select")
NOT_FIRST = frozenset("with has no without not hide show is".split())
TITLED = frozenset("article entry post page story content".split())
BODY_NAMES = frozenset("content article post story entry entry-content post-content article-body article-content articlebody main-content maincontent story-body post-body content-body page-content main".split())

#: A tag with its attributes, whose quoted values may hold `>`; and one that ends at the next `>`.
QUOTED = re.compile(r"<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']++|\"[^\"]*\"|'[^']*')*+)>")
SIMPLE = re.compile(r"<(/?)([a-zA-Z][^\s/>]*)([^>]*)>")
RAW_END = {t: re.compile(rf"</{t}\s*[^>]*>", re.I) for t in RAW}
ATTRIBUTE = re.compile(r"([a-zA-Z_:][-\w:.]*)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
NAME_WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])|\d+")


def _name_kind(name: str) -> str:
    """"drop", "title" or "" for one class name or id."""
    words = [w.lower() for w in NAME_WORD.findall(name)]
    if not words or words[0] in NOT_FIRST:
        return ""
    if words[-1] == "header" and words[0] in TITLED:
        return "title"
    while len(words) > 1 and words[-1] in ("container", "wrapper", "wrap", "box", "list", "section", "area", "inner", "bar", "block", "links", "item", "slot", "unit") or words[-1].isdigit() and len(words) > 1:
        words.pop()
    return "drop" if words[-1] in WEAK or words[0] in STRONG else ""


def _element(tag: str, attrs: str) -> tuple[str, int]:
    """What an element is by its tag and attributes: "drop", "title" or "", and its zone."""
    zone = ARTICLE if tag == "article" else MAIN if tag == "main" else LOOSE
    if tag in DROP_TAGS:
        return "drop", LOOSE
    kind = "title" if tag == "header" else ""
    if attrs and not attrs.isspace():
        for name, *values in ATTRIBUTE.findall(attrs):
            name, value = name.lower(), next(filter(None, values), "")
            if name == "hidden" or name == "aria-hidden" and value.lower() == "true" or name == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value, re.I):
                return "drop", zone
            if name == "role":
                role = value.strip().lower()
                zone = max(zone, MAIN if role == "main" else ARTICLE if role == "article" else zone)
                if role in ROLES:
                    kind = "drop"
            elif name == "itemprop" and value.lower() == "articlebody":
                zone = max(zone, ARTICLE)
            elif name in ("class", "id"):
                for part in value.split():
                    if part.lower() in BODY_NAMES:
                        zone = max(zone, CONTENT)
                    elif tag not in ("html", "body", "main", "article"):
                        kind = _name_kind(part) or kind
    return kind, zone


class _Open:
    """The open elements, outermost first: tag, dropped, inside a title header, zone. Where each tag is open
    is kept beside, so that no question walks the elements: pages may nest without end."""

    def __init__(self):
        self.stack: list[tuple[str, bool, bool, int]] = [("", False, False, LOOSE)]
        self.places: dict[str, list[int]] = {}
        self.headings = 0

    def push(self, element: tuple[str, bool, bool, int]) -> None:
        self.places.setdefault(element[0], []).append(len(self.stack))
        self.headings += element[0] in HEADINGS
        self.stack.append(element)

    def nearest(self, tags) -> int:
        """Place of the innermost open element of these tags; 0 if none is."""
        return max((x[-1] for t in tags if (x := self.places.get(t))), default=0)

    def cut(self, k: int) -> None:
        for t, *_ in self.stack[k:]:
            self.places[t].pop()
            self.headings -= t in HEADINGS
        del self.stack[k:]


def blocks(page: str) -> list[tuple[int, str]]:
    """(zone, text) of each block of a page in page order; dropped markup has zone DROPPED.

    Character references are decoded, white space is one space, blocks are not empty. A header inside
    an article keeps its headings. Unclosed elements end with what holds them; an unclosed tag is text, and where a quoted value never
    ends, tags end at the next `>` from there on. The time is in proportion to the page.
    """
    out: list[tuple[int, str]] = []
    text: list[str] = []
    open_ = _Open()
    stack = open_.stack

    def flush() -> None:
        if text:
            joined = " ".join("".join(text).split())
            text.clear()
            if joined:
                _, dropped, titled, zone = stack[-1]
                out.append((DROPPED if dropped or titled and not open_.headings else zone, joined))

    def close(k: int) -> None:
        if any(t in BLOCK_TAGS or d != stack[k - 1][1] for t, d, *_ in stack[k:]):
            flush()
        open_.cut(k)

    at, n, tag_of, last = 0, len(page), QUOTED, page.rfind(">")
    while at < n:
        start = page.find("<", at)
        if start < 0 or start > last:
            text.append(html.unescape(page[at:]))
            break
        if start > at:
            text.append(html.unescape(page[at:start]))
        if page.startswith("<!--", start) or page.startswith("<![CDATA[", start):
            mark, skip = ("-->", 4) if page.startswith("<!--", start) else ("]]>", 9)
            stop = page.find(mark, start + skip)
            at = n if stop < 0 else stop + len(mark)
            continue
        if page[start + 1 : start + 2] in ("!", "?"):
            at = page.find(">", start) + 1
            continue
        m = tag_of.match(page, start)
        if not m and tag_of is QUOTED and SIMPLE.match(page, start):
            tag_of, m = SIMPLE, SIMPLE.match(page, start)
        if not m:
            text.append("<")
            at = start + 1
            continue
        at, end, tag, attrs = m.end(), m[1], m[2].lower(), m[3]
        if end:
            k = open_.nearest((tag,))
            if k:
                close(k)
            elif tag in BLOCK_TAGS:
                flush()
            continue
        if tag in BLOCK_TAGS and tag != "br":
            flush()
            if k := open_.nearest(("p",)):
                close(k)  # a block ends an open paragraph
            if tag in IMPLIED and (k := open_.nearest(IMPLIED[tag])) and k > open_.nearest(LISTS):
                close(k)
        if tag in VOID:
            if tag in ("br", "hr"):
                text.append(" ")
            continue
        if tag in RAW and not attrs.rstrip().endswith("/"):
            stop = RAW_END[tag].search(page, at) if page.find("</", at) <= last else None
            at = stop.end() if stop else n
            continue
        if attrs.rstrip().endswith("/") and tag not in BLOCK_TAGS:
            continue
        kind, zone = _element(tag, attrs)
        _, dropped, titled, inherited = stack[-1]
        if kind == "drop" and not dropped and tag not in BLOCK_TAGS:
            flush()
        inside = inherited >= MAIN or zone >= MAIN
        open_.push((tag, dropped or kind == "drop" or kind == "title" and not inside, titled or kind == "title" and inside, max(zone, inherited)))
    flush()
    return out


def suffix_array(tokens: np.ndarray, page: np.ndarray, depth: int = RUN) -> tuple[np.ndarray, np.ndarray]:
    """The suffixes of all pages' token streams in order, and how many tokens each shares with the one before it,
    `depth` standing for that many or more. A suffix ends with its page; page numbers ascend.

    By prefix doubling up to `depth`: the ranks of every power of two are kept, and the shared lengths are read off
    them from the largest down.
    """
    n = len(tokens)
    ranks, size = [np.unique(tokens, return_inverse=True)[1].astype(np.int64)], 1
    while size < depth:
        rank, after = ranks[-1], np.full(n, -1, np.int64)
        after[: n - size] = np.where(page[size:] == page[: n - size], rank[size:], -1)
        ranks.append(np.unique(rank * (n + 2) + after + 1, return_inverse=True)[1].astype(np.int64))
        size *= 2
    order = np.argsort(ranks[-1], kind="stable")
    end = np.searchsorted(page, page, "right")
    i, j, shared = order[:-1], order[1:], np.zeros(max(0, n - 1), np.int64)
    most = np.minimum(end[i] - i, end[j] - j)
    for k in range(len(ranks) - 1, -1, -1):
        open_ = np.flatnonzero(shared < most)
        same = ranks[k][i[open_] + shared[open_]] == ranks[k][j[open_] + shared[open_]]
        shared[open_[same]] += 1 << k
    return order, np.concatenate([[0], np.minimum(np.minimum(shared, most), depth)])[:n]


def repeated_cover(tokens: np.ndarray, page: np.ndarray, run: int = RUN, pages: int = PAGES, share: float = SHARE, stream: np.ndarray | None = None) -> np.ndarray:
    """Which tokens stand in a run of `run` or more tokens that enough distinct pages have: `pages`, and that
    share of them. Pages of one `stream` (a number of each page) are copies and count as one.

    Suffixes that share `run` tokens or more stand together in the suffix array. A longer run on so many pages
    is made of windows of `run` tokens that are on as many, so that these tell all that is covered.
    """
    n = len(tokens)
    cover = np.zeros(n, bool)
    if n < run:
        return cover
    order, shared = suffix_array(tokens, page, run)
    group = np.cumsum(shared < run) - 1
    of = page if stream is None else stream[page]
    count = int(of.max()) + 1
    held = np.unique(group * count + of[order]) // count
    often = np.bincount(held, minlength=int(group[-1]) + 1) >= max(pages, int(np.ceil(share * len(np.unique(of)))))
    starts = order[often[group]]
    starts = starts[starts + run <= n]
    starts = starts[page[starts + run - 1] == page[starts]]
    step = np.zeros(n + 1, np.int64)
    np.add.at(step, starts, 1)
    np.add.at(step, starts + run, -1)
    return np.cumsum(step[:-1]) > 0


def needed(found: list[tuple[int, str]]) -> list[tuple[int, str]]:
    """The blocks that may be main text: those in article, main or content elements, of a page without any all
    that no boilerplate element holds."""
    low = CONTENT if any(z >= CONTENT for z, _ in found) else LOOSE
    return [(z, text) for z, text in found if z >= low]


def _cleaned(blocks_: list[tuple[int, list[str]]], usual: np.ndarray, strict: np.ndarray) -> str:
    """A page's needed blocks without repeated runs: inside an article `strict` ones, elsewhere `usual` ones. A page
    whose article, main and content elements are mostly repeated is a copy and loses nothing."""
    if usual.any():
        inside = np.repeat([z == ARTICLE for z, _ in blocks_], [len(b) for _, b in blocks_])
        gone = np.where(inside, strict, usual)
        if blocks_[0][0] < CONTENT or gone.mean() <= COPY:
            return " ".join(w for w, g in zip(chain.from_iterable(b for _, b in blocks_), gone.tolist(), strict=True) if not g)
    return " ".join(chain.from_iterable(b for _, b in blocks_))


def main_text(pages: list[list[tuple[int, str]]]) -> list[str]:
    """The main text of each page of one host.

    Of the tokens of the needed blocks go the runs that the host's suffix array finds on enough distinct
    pages; inside an article that takes more pages, as several articles may quote one passage. Unique runs stay
    where they are.
    """
    words: dict[str, int] = {}
    streams: dict[tuple, int] = {}
    kept = [[(z, text.split()) for z, text in needed(found)] for found in pages]
    ids = [[words.setdefault(w, len(words)) for _, b in blocks_ for w in b] for blocks_ in kept]
    sizes = [len(x) for x in ids]
    stream = np.array([streams.setdefault(tuple(x), len(streams)) for x in ids], np.int64)
    tokens = np.fromiter(chain.from_iterable(ids), np.int64, sum(sizes))
    page = np.repeat(np.arange(len(pages)), sizes)
    usual = repeated_cover(tokens, page, stream=stream)
    strict = usual if not usual.any() else repeated_cover(tokens, page, RUN, ARTICLE_PAGES, ARTICLE_SHARE, stream)
    ends = np.cumsum([0, *sizes])
    return [_cleaned(b, usual[i:j], strict[i:j]) for b, i, j in zip(kept, ends[:-1], ends[1:], strict=True)]


def windows(text: list[str]) -> np.ndarray:
    """A 64-bit hash of each run of RUN tokens of one page."""
    if len(text) < RUN:
        return np.zeros(0, np.int64)
    ids: dict[str, int] = {}
    at = [ids.setdefault(w, len(ids)) for w in text]
    own = np.fromiter((int.from_bytes(blake2b(w.encode(), digest_size=8).digest(), "little") for w in ids), np.uint64, len(ids))[at]
    h = np.zeros(len(text) - RUN + 1, np.uint64)
    for k in range(RUN):
        h = (h ^ h >> np.uint64(29)) * np.uint64(0xD6E8FEB86659FD93) + own[k : k + len(h)]
    return h.view(np.int64)


def frequent_windows(pages: list[list[str]]) -> np.ndarray:
    """Hashes of the runs of RUN tokens that stand on SHARE of these distinct pages or more, by their suffix array. What stands
    on that share of a host's pages stands on it in one chunk of them at least."""
    words: dict[str, int] = {}
    tokens = np.fromiter((words.setdefault(w, len(words)) for p in pages for w in p), np.int64)
    # a little less than the share, so that no rounding loses a run
    cover = repeated_cover(tokens, np.repeat(np.arange(len(pages)), [len(p) for p in pages]), RUN, 1, SHARE * (1 - 1e-9))
    out, at = [np.zeros(0, np.int64)], 0
    for p in pages:
        if len(p) >= RUN:  # all windows that lie in covered tokens: those asked for among them
            whole = np.lib.stride_tricks.sliding_window_view(cover[at : at + len(p)], RUN).all(axis=1)
            out.append(windows(p)[whole])
        at += len(p)
    return np.unique(np.concatenate(out))


def _packed(found: list[tuple[int, str]]) -> bytes:
    return "\0".join([*(str(z) for z, _ in found), *(t.replace("\0", "�") for _, t in found)]).encode()


def _unpacked(raw: bytes) -> list[tuple[int, str]]:
    parts = raw.decode().split("\0")
    k = len(parts) // 2
    return [(int(z), x) for z, x in zip(parts[:k], parts[k:], strict=True)] if k else []


def extract_pages(pages: DataFrame) -> DataFrame:
    """page_id, url, text (empty if none) and n_chars of each row.

    Null html is empty. Pages meet by host (null and odd urls: one host of their own). A host of more
    than CHUNK_PAGES pages is dealt into chunks of about that many, so that no task holds a whole large host: the
    chunks' suffix arrays tell which runs may be on enough pages, then these are counted over all pages of the host, so that
    the result is that of one array over all. Repeated rows are pages of their own, but count as one page where they repeat
    a run. A very long page is parsed and searched whole, in time in proportion to it. An empty table gives an
    empty one. Other columns are ignored, whatever their names.
    """
    spark = pages.sparkSession
    small_batches(spark, 500)
    kinds = {c: pages.schema[c].dataType.simpleString() for c in ("page_id", "url")}

    def parse(batches):
        packer = zstandard.ZstdCompressor(level=1)
        seen = set()
        for b in batches:
            data, stream, fresh = [], [], []
            for host_, h in zip(b.column(2).to_pylist(), b.column(3).to_pylist(), strict=True):
                found = needed(blocks(h.decode("utf-8", "replace"))) if h else []
                data.append(packer.compress(_packed(found)))
                digest = blake2b(" ".join(t.replace("\0", "�") for _, t in found).encode(), digest_size=8).digest()
                stream.append(int.from_bytes(digest, "little", signed=True))
                fresh.append(bool(found) and (host_, digest) not in seen)
                seen.add((host_, digest))
            made = [pa.array(data, pa.binary()), pa.array(stream, pa.int64()), pa.array(fresh, pa.bool_())]
            yield pa.RecordBatch.from_arrays([*b.columns[:3], *made], names=["page_id", "url", "host", "data", "stream", "fresh"])

    def texts_of(column):
        packer = zstandard.ZstdDecompressor()
        return [_unpacked(packer.decompress(d)) for d in column.to_pylist()]

    def table_of(t, texts):
        return {"page_id": t.column("page_id"), "url": t.column("url"), "text": pa.array(texts, pa.string()), "n_chars": pa.array([len(x) for x in texts], pa.int64())}

    host = F.lower(F.coalesce(F.regexp_extract("url", r"^[a-zA-Z][a-zA-Z0-9+.-]*://([^/?#]*)", 1), F.lit("")))
    keyed = pages.select("page_id", "url", host.alias("host"), F.col("html").cast("binary").alias("html"))
    # chunks are told by the raw sizes, before anything is parsed
    sizes = keyed.groupBy("host").agg(F.ceil(F.greatest(F.count("*") / CHUNK_PAGES, F.sum(F.octet_length("html")) / CHUNK_CHARS, F.lit(1))).cast("int").alias("chunks"))
    hot = materialize(sizes.where("chunks > 1"), "hot")
    sent = F.broadcast if hot.count() <= HOT_HOSTS else lambda df: df
    order = ["page_id", "url", "host", "html"]
    parsed = f"page_id {kinds['page_id']}, url {kinds['url']}, host string, data binary, stream long, fresh boolean"
    schema = f"page_id {kinds['page_id']}, url {kinds['url']}, text string, n_chars long"

    def host_text(t):
        return pa.table(table_of(t, main_text(texts_of(t.column("data")))))

    small = keyed.join(sent(hot), "host", "left_anti").select(*order).mapInArrow(lean(parse), parsed)
    done = small.groupBy("host").applyInArrow(host_text, schema)

    large = keyed.join(sent(hot), "host", "left_semi").select(*order).mapInArrow(lean(parse), parsed)
    large = materialize(large.withColumn("row", F.monotonically_increasing_id()), "pages")
    # each text of a host counts once: of copies in several tasks the first row
    copies = large.where("fresh").groupBy("host", "stream").agg(F.min("row").alias("owner"), F.count("*").alias("n"))
    copies = materialize(copies, "copies")
    twins = materialize(copies.where("n > 1").drop("n"), "twins")  # a table of its own size: mostly so few that they are sent out
    once = large.where("fresh").join(twins, ["host", "stream"], "left").where("owner is null or owner = row")
    total = materialize(copies.groupBy("host").agg(F.count("*").alias("total")), "totals")

    def candidates(t):
        found = frequent_windows([[w for _, x in p for w in x.split()] for p in texts_of(t.column("data"))])
        return pa.table({"host": pa.array([t.column("host")[0].as_py()] * len(found), pa.string()), "h": pa.array(found, pa.int64())})

    chunk = F.pmod(F.xxhash64("stream"), "chunks").cast("int").alias("chunk")
    met = once.join(sent(hot), "host").select("host", chunk, "data").groupBy("host", "chunk").applyInArrow(candidates, "host string, h long")
    may = materialize(met.groupBy("host").agg(F.collect_set("h").alias("may")), "candidates")

    def count(batches):
        counts, sets = {}, {}
        for b in batches:
            for host_, found, may_ in zip(b.column(0).to_pylist(), texts_of(b.column(1)), b.column(2), strict=True):
                if host_ not in sets:
                    sets[host_] = np.sort(may_.values.to_numpy())
                own = np.unique(windows([w for _, x in found for w in x.split()]))
                for h in own[np.isin(own, sets[host_])].tolist():
                    counts[host_, h] = counts.get((host_, h), 0) + 1
        if counts:
            keys = list(counts)
            yield pa.RecordBatch.from_arrays([pa.array([k[0] for k in keys], pa.string()), pa.array([k[1] for k in keys], pa.int64()), pa.array(counts.values(), pa.int64())], names=["host", "h", "n"])

    counted = once.select("host", "data").join(sent(may), "host").mapInArrow(lean(count), "host string, h long, n long").groupBy("host", "h").agg(F.sum("n").alias("n"))
    enough = lambda least, share: F.col("n") >= F.greatest(F.lit(least), F.ceil(F.lit(share) * F.col("total")))
    often = counted.join(sent(total), "host").where(enough(PAGES, SHARE))
    strict = F.collect_list(F.when(enough(ARTICLE_PAGES, ARTICLE_SHARE), F.col("h"))).alias("strict")
    often = materialize(often.groupBy("host").agg(F.collect_list("h").alias("usual"), strict), "repeated")

    def page_text(batches):
        sets = {}
        for b in batches:
            texts = []
            for host_, found, u, s in zip(b.column("host").to_pylist(), texts_of(b.column("data")), b.column("usual"), b.column("strict"), strict=True):
                if host_ not in sets:
                    sets[host_] = [x.values.to_numpy() if x.is_valid else np.zeros(0, np.int64) for x in (u, s)]
                kept = [(z, x.split()) for z, x in found]
                own = windows([w for _, x in kept for w in x]) if len(sets[host_][0]) else np.zeros(0, np.int64)
                covers = []
                for runs in sets[host_]:
                    step = np.zeros(sum(len(x) for _, x in kept) + 1, np.int64)
                    starts = np.flatnonzero(np.isin(own, runs))
                    step[starts] += 1
                    step[starts + RUN] -= 1
                    covers.append(np.cumsum(step[:-1]) > 0)
                texts.append(_cleaned(kept, *covers))
            yield pa.RecordBatch.from_pydict(table_of(b, texts))

    cleaned = large.select("page_id", "url", "host", "data").join(sent(often), "host", "left").mapInArrow(lean(page_text), schema)
    return done.unionByName(cleaned)


def op8_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_pages(table(spark, sf_dir, "pages"))
