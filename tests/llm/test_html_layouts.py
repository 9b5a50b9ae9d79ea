"""Layouts that the tables lack, with the truth written by hand; what marks, texts and learned weights decide."""

import pytest

from ledgerspark.llm import html

PROSE = "Many words of the main text that go on and on here."

LAYOUTS = {
    "chrome words in classes of an article": (
        f'<body><nav><a>Home</a></nav><article><h1>T</h1><p>{PROSE}</p><div class="navigation-history"><p>History of navigation at sea in words.</p></div><div class="banner-image"><figure><figcaption>Caption words</figcaption></figure></div>'
        '<div class="promo-text"><p>Text of the promotion, in words.</p></div><div class="footer-notes"><p>Notes of the text.</p></div><div class="comment-section"><p>A comment of the editor.</p></div></article></body>',
        f"T\n{PROSE}\nHistory of navigation at sea in words.\nCaption words\nText of the promotion, in words.\nNotes of the text.\nA comment of the editor.",
    ),
    "buttons and related links in an article": (
        f'<body><article><h1>T</h1><p>{PROSE}</p><div class="share-buttons">Share this on X</div><div class="related">Related posts <a>one</a> <a>two</a></div></article></body>',
        f"T\n{PROSE}",
    ),
    "teasers beside the text of main": (
        f"<body><main><h1>Head</h1><p>{PROSE}</p><p>More of them follow in this one.</p><article><h2>Teaser one</h2><p>Short.</p></article><article><h2>Teaser two</h2><p>Short too.</p></article></main></body>",
        f"Head\n{PROSE}\nMore of them follow in this one.",
    ),
    "a wrapper named after a sidebar": (
        f'<body><div class="layout has-sidebar"><div class="content"><h1>Head</h1><p>{PROSE}</p><p>More of them follow in this one.</p></div><div class="sidebar"><p>Side words.</p></div></div></body>',
        f"Head\n{PROSE}\nMore of them follow in this one.",
    ),
    "table layout": (
        f"<body><table><tr><td><a>Home</a> <a>News</a> <a>About</a></td></tr><tr><td><h1>Head</h1><p>{PROSE}</p><p>And more words in a second paragraph.</p></td></tr><tr><td><a>Imprint</a> <a>Contact</a></td></tr></table></body>",
        f"Head\n{PROSE}\nAnd more words in a second paragraph.",
    ),
    "adverts and comments keep out, whatever they say": (
        f'<body><article><p>{PROSE}</p><div class="ad-box"><p>Buy this now, it is good for you.</p></div><p>The text goes on here.</p><div id="user-comments"><p>I liked this text a lot, thanks.</p></div></article></body>',
        f"{PROSE}\nThe text goes on here.",
    ),
    "notice and form inside": (
        f'<body><article><p>{PROSE}</p><div class="cookie-notice"><p>We use cookies on this page, as all do.</p></div><form><p>Your mail address, please.</p></form><p>The end of the text.</p></article></body>',
        f"{PROSE}\nThe end of the text.",
    ),
}


@pytest.mark.parametrize("name", LAYOUTS)
def test_layouts(name):
    page, want = LAYOUTS[name]
    assert html.extract(page, html.Weights()) == want


def test_learned_weights_decide(spark, monkeypatch):
    """A class that labelled pages have beside their articles goes from others too, by what was learned and not by the lists."""
    pages = [(i, "u", f'<body><div class="qz"><p>Box number {i} says so.</p></div><article><h1>T{i}</h1><p>{PROSE}</p><p class="lead">{PROSE}</p></article><div class="qz"><p>Once more, box {i}.</p></div></body>') for i in range(60)]
    learned = html.fit(spark.createDataFrame(pages, "page_id long, url string, html string"))
    page = f'<body><div class="text"><h1>T</h1><p>{PROSE}</p><div class="qz">Box words here</div><p class="lead">{PROSE}</p></div></body>'
    assert html.extract(page, html.Weights()) == f"T\n{PROSE}\nBox words here\n{PROSE}"
    for name in ("CHROME", "CHROME_ROLE", "CHROME_WORD", "CHROME_STRONG", "CHROME_SLIGHT"):
        monkeypatch.setattr(html, name, frozenset())
    assert html.extract(page, learned) == f"T\n{PROSE}\n{PROSE}"


def test_deep_and_wide_pages_in_linear_time():
    import time

    def took(k):
        began = time.process_time()
        html.extract("<div class='a b-nav'>" * k + f"<p>{PROSE}</p>" * k + "<article><p>x y.</p></article>" * k, html.Weights())
        return time.process_time() - began

    assert took(4_000) < 12 * took(1_000) + 0.3


def test_a_page_of_several_megabytes():
    import tracemalloc

    page = "<article>" + f"<p>{PROSE}</p>" * 60_000 + "</article>"
    tracemalloc.start()
    text = html.extract(page, html.Weights())
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert text.count("\n") == 59_999 and peak < 120 * len(page)
