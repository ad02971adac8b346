"""Main text on pages that the weights weren't fitted on, odd markup, and time linear in the page."""

import collections
import time

import pytest

from textmap.llm import html_text

# Held out: (page, its main text). Structures and most names aren't those of the labelled pages.
HELD_OUT = (
    ("<body><div id='top-nav'><a href='/'>Home</a> <a href='/a'>About</a></div><div class='wrap'><h2>Old bridges</h2><p>The bridge was built of stone, and it still stands today.</p><p>Trains no longer cross it, though walkers do on most days.</p></div><div class='footer-links'><a href='/t'>Terms</a> <a href='/p'>Privacy</a></div></body>",
     "Old bridges\n\nThe bridge was built of stone, and it still stands today.\n\nTrains no longer cross it, though walkers do on most days."),
    ("<body><div class='content with-sidebar'><h1>Bread</h1><p>Flour, water and salt are all you need.</p></div><div class='sidebar-widget'><p>Our most popular recipes of the last year are listed here for you.</p></div></body>",
     "Bread\n\nFlour, water and salt are all you need."),
    ("<body><p>One short paragraph comes first here.</p><ul><li><a href='/x'>a link</a></li><li><a href='/y'>another</a></li></ul><p>Then the text goes on after the list of links.</p><div class='comments-list'><p>I liked this text a lot, thank you very much for it!</p></div></body>",
     "One short paragraph comes first here.\n\na link\n\nanother\n\nThen the text goes on after the list of links."),
    ("<body><div class='banner wrapper'><main><h1>Wind</h1><p>It blew all night.</p></main></div><div class='ad-box'><p>Cheap flights to the sun, book today and save a lot of money!</p></div></body>", "Wind\n\nIt blew all night."),
    ("<body><div class='cookie-bar'><p>This site uses cookies to make your visit better, and to count our readers.</p></div><div class='prose'><p>Snow fell.</p><p>The road was shut at noon, so we stayed in the village.</p></div></body>", "Snow fell.\n\nThe road was shut at noon, so we stayed in the village."),
    ("<body><article><div class='share-price'>Up by two pence</div><p>The firm did well.</p><div class='social-share'><span>Tell your friends about this text and more</span></div></article><div class='related-stories'><article><p>Another firm did badly in the very same year, we hear.</p></article></div></body>", "Up by two pence\n\nThe firm did well."),
    ("<body><section class='story'><header><h1>Title</h1></header><p title=it's>An apostrophe here.</p><p title=\"open>An open quote <b>there</b>.</p></section><div class='newsletter-signup'><p>Join thousands of readers who get our letter each week, free.</p></div></body>", "Title\n\nAn apostrophe here.\n\nAn open quote there."),
    ("<body><div role='navigation'>Start News Sport</div><div class='post'><p>a &lt; b &amp; c</p><pre>x\n  y</pre></div><div hidden>secret words that nobody sees on this page</div></body>", "a < b & c\n\nx y"),
)


def f1(got, want):
    a, b = collections.Counter(got.split()), collections.Counter(want.split())
    both = sum((a & b).values())
    return 2 * both / max(1, sum(a.values()) + sum(b.values()))


@pytest.mark.parametrize("page, want", HELD_OUT)
def test_held_out_pages(page, want):
    assert html_text.main_text(page) == want


def test_weights_matter():
    """Without the fitted names and kinds (words 1, tags -0.1) boilerplate comes in and text goes."""
    flat = {"w": 1.0, "a": 1.0, "x": -1.0, "t": -0.1}
    fitted, unfitted = (sum(f1(html_text.main_text(p, w), t) for p, t in HELD_OUT) / len(HELD_OUT) for w in (None, flat))
    assert fitted == 1.0 and unfitted < 0.85


def test_labelled_pages_are_read_as_labelled():
    for page in html_text.labelled_pages():
        marked = html_text.Page(page)
        (a, b), *_ = marked.main
        want = " ".join("".join(t[1] if t[0] != "t" else " " * (html_text._breaks(t) or t[1] == "br") for t in marked.tokens[a:b]).split())
        assert f1(html_text.main_text(page), want) > 0.99


@pytest.mark.parametrize("piece", ["<a \"", "<div>", "<b><p>w ", "<a x=\"", "<p>a b</q>", "<div class='a b'>text ", "<", "<!--", "<p a='>", "</p>", "&amp"])
def test_time_is_linear(piece):
    def took(n):
        start = time.perf_counter()
        html_text.main_text(piece * n)
        return time.perf_counter() - start

    took(500)
    assert min(took(16_000), took(16_000)) < 30 * min(took(2_000), took(2_000)) + 0.05


def test_equal_scores_take_the_first_region():
    assert html_text.best_region([1.0, -2.0, 1.0]) == (0, 1)
    assert html_text.best_region([-1.0, 0.0]) == (0, 0)
