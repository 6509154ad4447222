"""Repeated runs go from every zone but articles."""

from __future__ import annotations

import pytest

from morphlake.llm import pages

BOILER = "all rights reserved by the owners of this site and their heirs"


@pytest.mark.parametrize("zone", ["<main>{}</main>", "<div class='content'>{}</div>", "<div class='post'>{}</div>", "<div>{}</div>"])
def test_repeated_runs_of_a_zone_go(zone):
    text = [" ".join(f"word{k}{j}" for j in range(12)) for k in range(6)]
    own = [zone.format(f"<p>{t}</p><p>{BOILER}</p>") for t in text]
    assert pages.main_text([pages.blocks(p) for p in own]) == text


def test_all_zones_of_text_are_kept():
    two = ['<main><p>Long real text</p><article class="teaser-x"><p>Teaser</p></article></main>', '<div class="content"><p>Body</p></div><article><p>Read also</p></article>']
    assert pages.main_text([pages.blocks(p) for p in two]) == ["Long real text Teaser", "Body Read also"]


def notices(n=8, article=True):
    own = [" ".join(f"word{k}x{j}" for j in range(30)) for k in range(n)]
    tag = "article" if article else "div"
    return own, [f"<{tag}><p>{t[:60]}{t[60:]} {BOILER}</p><p>{BOILER}</p></{tag}>" for t in own]


@pytest.mark.parametrize("article", [True, False])
def test_the_array_decides(article, monkeypatch):
    """Runs go out of the middle of blocks, in articles too; without the array they stay."""
    own, html = notices(article=article)
    assert pages.main_text([pages.blocks(p) for p in html]) == own
    monkeypatch.setattr(pages, "repeated_cover", lambda tokens, *a, **b: pages.np.zeros(len(tokens), bool))
    assert pages.main_text([pages.blocks(p) for p in html]) != own


def test_copies_and_quotations_stay():
    own, html = notices()
    assert pages.main_text([pages.blocks(html[0])] * 9) == [f"{own[0]} {BOILER} {BOILER}"] * 9
    near = [f"<article><p>{own[0]} version{k}</p></article>" for k in range(8)]
    assert pages.main_text([pages.blocks(p) for p in near]) == [f"{own[0]} version{k}" for k in range(8)]
    quoted = [f"<article><p>{t}{' ' + BOILER if k < 4 else ''}</p></article>" for k, t in enumerate(own + [t.replace('word', 'term') for t in own])]
    assert [BOILER in t for t in pages.main_text([pages.blocks(p) for p in quoted])] == [True] * 4 + [False] * 12


def test_suffix_array_against_sorting():
    rng = pages.np.random.default_rng(6)
    streams = [rng.integers(0, 3, rng.integers(0, 30)).tolist() for _ in range(6)]
    streams[4] = list(streams[2])
    tokens, page = pages.np.array([t for s in streams for t in s]), pages.np.repeat(pages.np.arange(6), [len(s) for s in streams])
    suffixes = [s[k:] for s in streams for k in range(len(s))]
    order, shared = pages.suffix_array(tokens, page, 8)
    ranked = [suffixes[k] for k in order]
    assert [x[:8] for x in ranked] == sorted(x[:8] for x in suffixes)
    for a, b, n in zip(ranked, ranked[1:], shared[1:], strict=False):
        assert n == next((k for k in range(8) if k >= len(a) or k >= len(b) or a[k] != b[k]), 8)


@pytest.mark.parametrize("page", ["<div>" * 60_000, "<a " * 100_000, "<a \">\"" * 60_000, "<ul>" + "<div><li>" * 30_000, "</script" * 40_000 + ">", "<!--" * 80_000, "<p><b>" * 50_000])
def test_time_grows_with_the_page(page):
    import time

    began = time.perf_counter()
    pages.blocks(page)
    assert time.perf_counter() - began < 5


def test_chunks_do_not_change_texts(spark, monkeypatch):
    """A host dealt into chunks of 10 or 25 pages gives what one array over all its pages gives, at the very share; copies count once."""
    often, seldom, quoted = (" ".join(f"{x}{k}" for k in range(9)) for x in ("often", "seldom", "quoted"))
    html = [f"<p>body{k} has its own words {k * k}</p>" + (f"<p>{often}</p>" if k < 12 else "") + (f"<p>{seldom}</p>" if 20 <= k < 31 else "") for k in range(50)]
    html += [f"<article><p>piece{k} stands {k}</p>{f'<p>{quoted}</p>' if k < 3 else ''}</article>" for k in range(10)] + [html[25]] * 8 + ["", "<nav>menu</nav>"]
    want = sorted(zip(range(len(html)), pages.main_text([pages.blocks(p) for p in html]), strict=True))
    assert often not in " ".join(t for _, t in want) and sum(seldom in t for _, t in want) == 19 and sum(quoted in t for _, t in want) == 3
    table = spark.createDataFrame([(k, f"http://h/{k}", p) for k, p in enumerate(html)] + [(99, "http://other/", html[0])], "page_id long, url string, html string")
    for size in (10, 25):
        monkeypatch.setattr(pages, "CHUNK_PAGES", size)
        got = sorted((r["page_id"], r["text"]) for r in pages.extract_pages(table).collect())
        assert got == [*want, (99, f"body0 has its own words 0 {often}")]
