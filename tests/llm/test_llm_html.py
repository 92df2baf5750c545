"""HTML extraction: planted articles, dropped parts, surge and dive, odd pages."""

import random

import pytest

from sirenframe.llm.html_text import extract, main_text, regions

PARAGRAPH = "This is a paragraph of the article that is long enough to be a surge of text by itself."


def test_article_without_its_surroundings():
    page = f"""<!DOCTYPE html><html><head><title>No</title><style>p {{}}</style>
    <script>var t="</p><article>no</article>";</script></head><body class="with-sidebar">
    <header><h1>Site</h1></header><nav><ul><li><a href="/a">Menu</a></li></ul></nav>
    <div class="cookie-notice">We use cookies</div><!-- <p>no</p> --><div class="ad">Buy</div>
    <div id="wrap" class="page with-sidebar"><article><header><h1>Title &amp;
       more</h1></header><p><b>{PARAGRAPH}<br>after the break<p>Short.</p>
    <form>Name <input name=x></form><aside>See also</aside><p title="a > b">a &lt; b &#233;&nbsp;x</p>
    <div class="advert">Buy</div><ul><li>one<li>two</ul><p>End.</p>
    <section class="comments"><p>{PARAGRAPH}</p></section></article></div>
    <div class="sidebar">{PARAGRAPH}</div><footer>&copy; no</footer></body></html>"""
    assert main_text(page).split("\n\n") == [
        "Title & more", PARAGRAPH + " after the break", "Short.", "a < b é x", "one", "two", "End.",
    ]


def test_surge_and_dive_without_marked_article():
    links = "".join(f"<li><a href=/{i}>Link number {i} with some text in it</a></li>" for i in range(9))
    page = (
        f"<body><ul>{links}</ul><div>{PARAGRAPH}</div><div>Tiny</div><div>{PARAGRAPH}</div>"
        f"<ul>{links}</ul><div>Imprint</div></body>"
    )
    assert main_text(page) == f"{PARAGRAPH}\n\nTiny\n\n{PARAGRAPH}"


def test_regions():
    assert regions([0, 0, 0, 90, 1, 0, 90, 0, 0, 0, 5], 3, 80) == [(3, 7)]
    assert regions([5, 0, 0, 0, 7], 3, 80) == [(4, 5)]
    assert regions([], 3, 80) == []
    assert regions([0, 0], 3, 80) == []


@pytest.mark.parametrize(
    "page, text",
    [
        (None, ""),
        ("", ""),
        (" \n ", ""),
        ("plain &amp; text", "plain & text"),
        ("<p>open", "open"),
        ("<p>a < b and c > d</p>", "a < b and c > d"),
        ("<article></article>", ""),
        ("<script>only", ""),
        ("<!-- never closed <p>x</p>", ""),
        ("<article><p>1<p>2<h2>3</h2></article>", "1\n\n2\n\n3"),
        ("<main><table><tr><td>a</td><td>b</td></tr></table></main>", "a b"),
        ("</div></p>text", "text"),
        ("<article><p hidden>no</p><p>yes</article>", "yes"),
    ],
)
def test_small_pages(page, text):
    assert main_text(page) == text


def test_planted_articles_come_back_whole(spark):
    rng = random.Random(2)
    rows, want = [], {}
    for i in range(60):
        blocks = [" ".join(rng.choices(["ab", "cde.", "é", "<", "&"], k=rng.randint(1, 60))) for _ in range(rng.randint(1, 12))]
        safe = [b.replace("&", "&amp;").replace("<", "&lt;") for b in blocks]
        inner = "".join(f"<p>{b.replace(' ', rng.choice([' ', '\n', ' \t']))}</p>" for b in safe)
        rows.append((i, f"u{i}", f"<nav>Menu {i}</nav><article>{inner}</article><footer>f</footer>", "x"))
        want[i] = "\n\n".join(blocks)
    rows += [(100, None, None, None), (5, "u5", rows[5][2], "x"), (101, "u", "<p>" + "long " * 100000, "x")]
    want |= {100: "", 101: ("long " * 100000).strip()}
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, text string")
    got = extract(pages).collect()
    assert len(got) == len(rows)
    assert all(r.text == want[r.page_id] and r.n_chars == len(r.text) for r in got)
    assert extract(pages.limit(0)).count() == 0


@pytest.mark.parametrize(
    "before, after",
    [
        ('<div class="page-with-sidebar">', "</div>"),
        ('<div id="has-header">', "</div>"),
        ('<div id="widget-content"><div class="side">', "</div></div>"),
        ("<form method=post action=x>", "</form>"),
        ('<form class="search"><div role="form">', "</div></form>"),
    ],
)
def test_wrappers_of_the_prose_stay(before, after):
    inner = f'<p>{PARAGRAPH}</p><p>{PARAGRAPH} Twice.</p><div class="sidebar"><p>{PARAGRAPH}</p></div><p>{PARAGRAPH}</p>'
    page = f"<body>{before}{inner}{after}<div class=notice>{PARAGRAPH}</div></body>"
    assert main_text(page) == f"{PARAGRAPH}\n\n{PARAGRAPH} Twice.\n\n{PARAGRAPH}"


def test_a_small_form_or_named_part_goes():
    page = f"<p>{PARAGRAPH}</p><form><p>{PARAGRAPH[:60]}</p></form><p>{PARAGRAPH} Again.</p>"
    assert main_text(page) == f"{PARAGRAPH}\n\n{PARAGRAPH} Again."


def test_anchors_and_longer_names_inside_the_article_stay():
    page = (
        f'<article><h2 id="related-work">Related work</h2><p id="share">{PARAGRAPH}</p>'
        f'<div class="legal-history"><p>{PARAGRAPH}</p></div><div class="legal"><p>small print</p></div></article>'
    )
    assert main_text(page) == f"Related work\n\n{PARAGRAPH}\n\n{PARAGRAPH}"


def test_a_teaser_article_does_not_hide_the_text():
    page = f"<div>{PARAGRAPH}</div><article><a href=x>teaser</a></article><div>{PARAGRAPH}</div><div>{PARAGRAPH}</div>"
    text = main_text(page)
    assert text.count(PARAGRAPH) == 3


def _slow_regions(lengths, window, surge):
    """Regions by looking at every line anew: a line belongs to the region of the lines with text near it."""
    own = [i for i, n in enumerate(lengths) if n]
    groups = []
    for i in own:
        if groups and not any(all(not lengths[j] for j in range(b, b + window)) for b in range(groups[-1][-1] + 1, i - window + 1)):
            groups[-1].append(i)
        else:
            groups.append([i])
    windows = [(b, sum(lengths[b : b + window])) for b in range(len(lengths))]
    strong = [g for g in groups if any(n >= surge and b + window > g[0] and b <= g[-1] for b, n in windows)]
    most = sorted(groups, key=lambda g: sum(lengths[i] for i in g))[-1:]
    return [(g[0], g[-1] + 1) for g in strong or most]


def test_surge_and_dive_against_brute_force():
    rng = random.Random(9)
    for _ in range(3000):
        lengths = [rng.choice([0, 0, 0, 1, 5, 30, 79, 80, 200]) for _ in range(rng.randrange(25))]
        window, surge = rng.randrange(1, 6), rng.choice([1, 80, 150])
        assert regions(lengths, window, surge) == _slow_regions(lengths, window, surge), (lengths, window, surge)


def test_a_short_article_beside_a_long_advert():
    page = f"<div class=ad>{PARAGRAPH}</div><article><h1>One.</h1><p>Two.</p></article><div class=sidebar><p>{PARAGRAPH}</p></div>"
    assert main_text(page) == "One.\n\nTwo."
