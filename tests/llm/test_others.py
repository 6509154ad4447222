"""Operators over vectors, pages and conversations, and the pipeline, against brute force."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from morphlake.llm import chat, neardup, pages
from morphlake.llm.common import table
from test_texts import components

SF = "/root/testdata/sf0.001"


# near duplicates of vectors


def slow_links(rows, threshold=0.98):
    ok = {}
    for k, (_, label, x) in enumerate(rows):
        v = np.array([np.nan if e is None else e for e in x], float) if x is not None else np.zeros(0)
        if label is not None and v.size and np.isfinite(v).all() and np.linalg.norm(v) > 0:
            ok[k] = (label, v / np.linalg.norm(v))
    return [(a, b) for a in ok for b in ok if a < b and ok[a][0] == ok[b][0] and len(ok[a][1]) == len(ok[b][1]) and ok[a][1] @ ok[b][1] >= threshold]


def test_near_duplicates(spark):
    rng = np.random.default_rng(5)
    base = rng.normal(size=(30, 16))
    rows = []
    for k in range(400):
        v = base[k % 30] + rng.normal(size=16) * rng.choice([0.02, 0.12, 0.25])
        rows.append((k, int(k % 30 % 3), [float(np.float32(e)) for e in v]))
    rows += [(400 + k, 0, rows[3][2]) for k in range(20)]
    rows += [(500, 1, None), (501, 1, [0.0] * 16), (502, 1, [float("nan")] + [1.0] * 15), (503, 1, [None] + [1.0] * 15), (504, None, rows[0][2]), (505, 1, [float("inf")] + [0.0] * 15), (506, 0, [2 * e for e in rows[3][2]])]
    df = spark.createDataFrame(rows, "vec_id long, label int, embedding array<float>")
    rows = [tuple(r) for r in df.collect()]
    links = slow_links(rows)
    assert len(links) > 500
    n = np.zeros(len(rows), int)
    for a, b in links:
        n[a] += 1
        n[b] += 1
    of = components(range(len(rows)), links)
    got = {r["vec_id"]: r for r in neardup.near_duplicates(df, recall=1.0).collect()}
    for k, (vec, _, _) in enumerate(rows):
        r = got[vec]
        assert (r["n_links"], r["component_id"], r["kept"]) == (n[k], rows[of[k]][0], rows[of[k]][0] == vec), vec
    # with small blocks the work is dealt out, and the result is the same
    neardup.BLOCK, old = 16, neardup.BLOCK
    try:
        again = {r["vec_id"]: tuple(r) for r in neardup.near_duplicates(df, recall=1.0).collect()}
    finally:
        neardup.BLOCK = old
    assert again == {k: tuple(r) for k, r in got.items()}
    low = neardup.near_duplicates(df).agg(F.sum("n_links")).first()[0]
    assert 0.99 * 2 * len(links) <= low <= 2 * len(links)
    assert neardup.near_duplicates(df.limit(0)).count() == 0


def test_traversal_order():
    rng = np.random.default_rng(2)
    a, b = rng.random(9), rng.random(7)
    cells = list(neardup.multi_sequence(a, b, 1.2))
    sums = [a[i] + b[j] for i, j in cells]
    assert sums == sorted(sums) and len(set(cells)) == len(cells) == sum(x + y <= 1.2 for x in a for y in b)


# pages


@pytest.mark.parametrize(
    ("page", "text"),
    [
        ("<html><head><title>T</title><style>p{}</style></head><body><nav><ul><li>Home</ul></nav><article><h1>Head</h1><p>One &amp; <b>two</b>three<p>Four<br>five</article><footer>F</footer></body></html>", "Head One & twothree Four five"),
        ('<body><div class="cookie-notice">Cookies</div><main><p>Main &lt;text&gt;</p><aside>Side</aside><div id="comments"><p>Nice!</p></div></main></body>', "Main <text>"),
        ("<article><script>if (a < b) document.write('</p>')</script><p>Kept&nbsp;&#x41;</p><form><input><button>Go</button></form></article>", "Kept A"),
        ('<header>Site</header><div class="sidebar">S</div><div class="content"><p>Body</p><div class="ad">Buy</div></div><div class="comment-list">C</div>', "Body"),
        ("<article><header><h1>Title</h1><p>by me</p></header><p>Text</p></article>", "Title Text"),
        ("plain text &copy; only", "plain text © only"),
        ("<p>unclosed <b>bold <i>and <p>next", "unclosed bold and next"),
        ("<!-- <p>no</p> --><p title='a > b'>yes</p><![CDATA[no]]>", "yes"),
        ("", ""),
    ],
)
def test_markup(page, text):
    assert pages.main_text([pages.blocks(page)]) == [text]


def test_repeated_runs_of_a_host_go():
    boiler = "all rights reserved by the owners of this site and their heirs"
    text = [" ".join(f"word{k}{j}" for j in range(12)) for k in range(6)]
    own = [f"<div><p>{t}</p><p>{boiler}</p></div>" for t in text]
    assert pages.main_text([pages.blocks(p) for p in own]) == text
    quoted = [f"<article><p>intro {k}</p><p>{boiler}</p></article>" for k in range(6)]
    assert pages.main_text([pages.blocks(p) for p in quoted]) == [f"intro {k} {boiler}" for k in range(6)]


def test_cover_against_search():
    rng = np.random.default_rng(4)
    streams = [rng.integers(0, 6, rng.integers(0, 40)).tolist() for _ in range(8)]
    common = [1, 2, 3, 4, 5, 0, 1, 1, 2]
    for k in (1, 3, 4, 6):
        streams[k][2:2] = common
    tokens, page = np.array([t for s in streams for t in s]), np.repeat(np.arange(8), [len(s) for s in streams])
    got = pages.repeated_cover(tokens, page, 8, 3, 0.1)
    want, at = np.zeros(len(tokens), bool), 0
    windows = {}
    for p, s in enumerate(streams):
        for k in range(len(s) - 7):
            windows.setdefault(tuple(s[k : k + 8]), []).append((p, at + k))
        at += len(s)
    for spots in windows.values():
        if len({p for p, _ in spots}) >= 3:
            for _, k in spots:
                want[k : k + 8] = True
    assert want.any() and (got == want).all()


def test_pages_table(spark):
    rows = pages.op8_html_extraction(spark, SF).collect()
    raw = {r["page_id"]: r["html"] for r in table(spark, SF, "pages").collect()}
    assert len(rows) == len(raw) and all(r["n_chars"] == len(r["text"]) for r in rows)
    odd = spark.createDataFrame([(1, "http://a/x", None), (2, None, "<p>hi</p>"), (2, None, "<p>hi</p>"), (None, "not a url", "")], "page_id long, url string, html string")
    got = sorted((r["page_id"] or 0, r["text"], r["n_chars"]) for r in pages.extract_pages(odd.withColumn("host", F.lit("z"))).collect())
    assert got == [(0, "", 0), (1, "", 0), (2, "hi", 2), (2, "hi", 2)]
    assert pages.extract_pages(odd.limit(0)).count() == 0
    # a host of several chunks, dealt either way
    many = spark.createDataFrame([(k, "http://hot/x", f"<p>page{k}</p>") for k in range(40)], "page_id long, url string, html string")
    old, pages.CHUNK_PAGES = pages.CHUNK_PAGES, 10
    try:
        for most in (100, 0):
            pages.HOT_HOSTS = most
            assert {(r["page_id"], r["text"]) for r in pages.extract_pages(many).collect()} == {(k, f"page{k}") for k in range(40)}
    finally:
        pages.CHUNK_PAGES, pages.HOT_HOSTS = old, 100_000


# conversations


def test_parse_quotes():
    body, quotes = chat.parse_quotes("Hello\n\nOn Monday Ann wrote:\n> first\n> line\n>> deeper\n> back\n\nMy answer\n\n\nend\n")
    assert body == "Hello\n\nMy answer\n\nend" and quotes == [(1, "first\nline"), (2, "deeper"), (1, "back")]
    assert chat.parse_quotes("> only") == ("", [(1, "only")]) and chat.parse_quotes("") == ("", [])


def test_quotations(spark):
    rows = [
        ("c1", 0, "user", "How do I sort a list?\n\nAnd reverse it?"), ("c1", 1, "assistant", "Use sorted."), ("c1", 2, "user", "> Use SORTED.\n\nthanks"),
        ("c1", 3, "assistant", "> And reverse  it?\n\nUse reverse."), ("c1", 4, "user", "ok"), ("c1", 5, "user", ">> Use reverse.\n> ok\nfine"),
        ("c2", 0, "user", "> Use sorted.\nwhat is this"), ("c2", 1, None, None), (None, None, "user", "alone"), ("c3", 0, "user", "same"), ("c3", 0, "user", "same"), ("c3", 1, "user", "> same"),
    ]
    df = spark.createDataFrame([(*r, 1, "x") for r in rows], "conv_id string, turn long, role string, text string, position int, body string")
    got = chat.link_quotations(df).collect()
    assert len(got) == len(rows)
    by = {(r["conv_id"], r["turn"]): r for r in got}
    assert (by["c1", 2]["quoted_turn"], by["c1", 2]["body"], by["c1", 2]["n_quotes"]) == (1, "thanks", 1)
    assert by["c1", 3]["quoted_turn"] == 0 and by["c1", 3]["parent_turn"] == 0 and by["c1", 5]["max_level"] == 2
    assert by["c1", 5]["quoted_turn"] == 4 and by["c1", 5]["n_linked"] == 2
    assert (by["c2", 0]["quoted_conv"], by["c2", 0]["quoted_turn"], by["c2", 0]["parent_turn"]) == ("c1", 1, None)
    # turn 3 answers turn 0 and opens a branch, which stands after what follows turn 0
    assert [t for _, t in sorted((by["c1", t]["position"], t) for t in range(6))] == [0, 1, 2, 3, 4, 5]
    assert by["c3", 1]["quoted_turn"] == 0 and sorted(r["position"] for r in got if r["conv_id"] == "c3") == [1, 2, 3]
    assert chat.link_quotations(df.limit(0)).count() == 0


def test_branches_in_reply_order(spark):
    rows = [(1, t, "user", x) for t, x in enumerate(["alpha", "beta", "gamma", "> alpha\ndelta", "> beta\neps", "> delta\nzeta", "eta", "> gamma\ntheta"])]
    got = chat.link_quotations(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()
    order = [r["turn"] for r in sorted(got, key=lambda r: r["position"])]
    # the chain 0 1 2, then branches of later parents first: 7 on 2, 4 on 1, 3 on 0 and 5 6 on 3
    assert order == [0, 1, 2, 7, 4, 3, 5, 6]


# pipeline


def test_pipeline(spark):
    import corpus_pipeline

    sf = "/root/testdata/sf0.001"
    docs = table(spark, sf, "documents")
    sizes, columns = [], docs.columns
    for name, stage in corpus_pipeline.STAGES[:-1]:
        kept = stage(spark, docs, sf)
        assert kept.columns == columns and [f.dataType for f in kept.schema] == [f.dataType for f in docs.schema], name
        rows = kept.collect()
        before = {r["doc_id"]: r for r in docs.collect()}
        if name != "mixing":
            assert all(tuple(r) == tuple(before[r["doc_id"]]) for r in rows)
            assert len({r["doc_id"] for r in rows}) == len(rows)
        else:
            want = sum(len(r["text"].split()) for r in before.values())
            assert abs(sum(len(r["text"].split()) for r in rows) - want) <= 20
            assert all(r["text"] in before[r["doc_id"]]["text"] and r["n_chars"] == len(r["text"]) for r in rows)
        sizes.append(len(rows))
        docs = spark.createDataFrame(rows, docs.schema)
    assert 0 < sizes[2] <= sizes[1] <= sizes[0]
    pieces = corpus_pipeline.STAGES[-1][1](spark, docs, sf)
    assert pieces.agg(F.sum("length")).first()[0] > 0


def test_pipeline_on_odd_tables(spark, odd, none):
    import corpus_pipeline

    docs, ids = odd, []
    for name, stage in corpus_pipeline.STAGES[:-1]:
        kept = stage(spark, docs, SF)
        assert kept.columns == odd.columns, name
        rows = kept.collect()
        ids.append([r["doc_id"] for r in rows])
        docs = spark.createDataFrame(rows, odd.schema)
        assert stage(spark, none, SF).count() == 0, name
    assert 4 not in ids[0] and 8 not in ids[0] and {1, 2, 7} <= set(ids[0])
    assert ids[2].count(1) <= 1 and 2 not in ids[2] and ids[2].count(10) <= 1
    corpus_pipeline.STAGES[-1][1](spark, docs, SF).count()
