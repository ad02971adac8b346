"""Main text of web pages by the maximum-scoring subsequence.

A page becomes a sequence of tokens: words score positive, tags negative, and a
linear scan (the running sum, restarted when it falls below zero) finds the
contiguous region of the highest score. The weights are log odds counted on
labelled pages (LABELLED): of a word in running text, of a word in a link, of a
word below boilerplate, of every tag, and of the names in class and id attributes.
A name counts whole if the labelled pages have it, else by its parts; those that
say what an element lacks or has beside it (`with-sidebar`, `no-banner`) don't count.
A word's score has those of the names of the elements around it added.

Around the region: if it begins or ends inside an article or main element, or one
named as such, it is widened to that element's bounds; else to those of the block, and
over the blocks beside it (paragraphs, headings, lists, quotes, tables of the same
parent) whose own sum is positive. Inside it, what is never content goes, whatever it
scores: elements that are no text (scripts, menus, forms, asides and the like), hidden ones, and
those whose names the labelled pages tell to be boilerplate (adverts, notices, comments).
An article or main element inside one of those last is read again, if no comment or
related page is meant. Character references are decoded, white space inside a block
becomes one space, blocks are joined by a blank line.

Time is linear in the page: tags are read in one pass, a quote that isn't closed ends with
its tag, and open elements are found by their tag.

Defined cases: a null or empty page has no text; unclosed and stray tags close as
browsers would have it, roughly; a page whose article has no words gives ''; null
ids and URLs keep their rows, repeated rows are read alike; extra columns are ignored.
"""

from __future__ import annotations

import html
import itertools
import math
import re
from collections import Counter, defaultdict

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textmap.llm.shared import table, with_columns_renamed_apart

_NEVER = frozenset("script style noscript template svg math head title nav footer aside form button select option textarea iframe object embed canvas audio video dialog menu input label fieldset".split())
_RAW = ("script", "style", "textarea", "title", "noscript", "iframe", "svg", "template")
_NEVER_ROLES = frozenset("navigation banner contentinfo complementary search alert dialog form menu menubar".split())
_MAIN_CALLED = frozenset("content main article post entry story main-content post-content entry-content article-content article-body post-body entry-body story-body".split())
_ASIDE_CALLED = frozenset("comment comments commentlist reply replies respond related recommended teaser teasers".split())
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol option p pre section summary table tbody td tfoot th thead tr ul".split()
)
_TEXT_BLOCKS = frozenset("p h1 h2 h3 h4 h5 h6 ul ol dl blockquote pre table figure div section".split())
_ENDS = {"p": ("p",), "li": ("li",), "td": ("td", "th"), "th": ("td", "th"), "tr": ("tr", "td", "th"), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "option": ("option",)}
_HOLDERS = ("ul", "ol", "table", "div", "article", "section", "main", "body", "dl", "select")
_OPEN = re.compile(r"<(/?)([a-zA-Z][^\s/>]*)")
_ATTR = re.compile(r"[\s/]*([^\s/>=][^\s/>=]*)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]*)))?")
#: A quoted value that holds the end of a tag and the start of another was never closed.
_UNCLOSED = re.compile(r">[^<]*<[a-zA-Z/!]")
_KEPT = frozenset(("class", "id", "role", "data-main", "hidden", "aria-hidden"))
#: First parts of names that say what is beside an element, or what state it is in.
_BESIDE = frozenset("with has no without is js hide show end after before".split())
#: Names whose mean score is at most this are boilerplate.
NAME_LIMIT = -1.0
_CLIP = (-3.0, 1.0)


def _names(attrs: dict[str, str]) -> list[str]:
    return [n for a in ("class", "id") for n in attrs.get(a, "").lower().split()]


def _parts(name: str) -> list[str]:
    return [p for p in re.split(r"[^a-z]+", name) if p]


def name_score(name: str, weights: dict[str, float]) -> float:
    """The log odds of a class or id name: its own, or of several parts their mean."""
    parts = _parts(name)
    if not parts or len(parts) > 1 and parts[0] in _BESIDE:
        return 0.0
    if "=" + name in weights:
        return weights["=" + name]
    return sum(weights.get("~" + p, 0.0) for p in parts) / len(parts) if len(parts) > 1 else 0.0


def _attributes(source: str, at: int) -> tuple[dict[str, str], int]:
    """The attributes that matter of the tag whose name ends at `at`, and where the tag ends."""
    found: dict[str, str] = {}
    n = len(source)
    while at < n:
        if source[at] == ">":
            return found, at + 1
        m = _ATTR.match(source, at)
        if not m:
            at += 1
            continue
        k = 2 if m[2] is not None else 3 if m[3] is not None else 0
        if k:
            open_ = _UNCLOSED.search(source, m.start(k), m.end(k))
            if open_:
                return found, open_.start() + 1
        name = m[1].lower()
        if name in _KEPT and name not in found:
            found[name] = m[2] or m[3] or m[4] or ""
        at = m.end()
    return found, n


class Page:
    """The tokens of a page: words with their context, tags, block bounds."""

    def __init__(self, source: str, weights: dict[str, float] | None = None):
        self.weights = weights or {}
        #: (kind, value, sum of the names' scores around it): kind 'w' word in running text, 'a' word in a link, 'x' below boilerplate, 't' tag
        self.tokens: list[tuple[str, str, float]] = []
        #: the token range of each article or main element, of what `data-main` marks, and of each block (with its parent's number, and its tag)
        self.wide: list[tuple[int, int]] = []
        self.main: list[tuple[int, int]] = []
        self.blocks: list[list] = []
        #: per element with names: those and its token range
        self.named: list[tuple[list[str], int, int]] = []
        self._read(source)

    def _is_never(self, tag: str, attrs: dict[str, str], in_content: bool) -> bool:
        if tag in _NEVER:
            return True
        if tag in ("body", "html", "article", "main"):
            return False
        if "hidden" in attrs or attrs.get("aria-hidden", "").lower() == "true" or attrs.get("role", "").lower() in _NEVER_ROLES:
            return True
        if in_content and tag in ("header", "h1", "h2", "h3"):
            return False
        return tag == "header" or any(name_score(n, self.weights) <= NAME_LIMIT for n in _names(attrs))

    def _read(self, source: str) -> None:
        # tag, whether it opens boilerplate, whether marked, first token, may hold the content, sum of names' scores before, its block, names, boilerplate before a rescue
        stack: list[tuple] = []
        places: dict[str, list[int]] = defaultdict(list)  # where each tag is open
        never = links = content = 0
        around = 0.0
        parent = -1
        at, n = 0, len(source)
        tokens, blocks = self.tokens, self.blocks

        def close(k: int) -> None:
            nonlocal never, links, content, around, parent
            while len(stack) > k:
                tag, bad, marked, first, wide, before, block, names, rescued = stack.pop()
                places[tag].pop()
                never = never - bad if rescued is None else rescued
                links -= tag == "a"
                content -= wide or tag in ("article", "main")
                around = before
                if wide and not never:
                    self.wide.append((first, len(tokens)))
                if marked:
                    self.main.append((first, len(tokens)))
                if names:
                    self.named.append((names, first, len(tokens)))
                if block >= 0:
                    blocks[block][1] = len(tokens)
                    parent = blocks[block][2]

        text_from = 0
        while at < n:
            lt = source.find("<", at)
            if lt < 0:
                break
            m = _OPEN.match(source, lt)
            mark = source.startswith(("<!", "<?"), lt)
            if not m and not mark:
                at = lt + 1
                continue
            if lt > text_from:
                tokens.append(("x" if never else "a" if links else "w", source[text_from:lt], around))
            if mark:
                end = source.find("-->", lt + 4) + 3 if source.startswith("<!--", lt) else source.find("]]>", lt) + 3 if source.startswith("<![CDATA[", lt) else source.find(">", lt) + 1
                at = text_from = end if end > 3 or end > lt else n
                continue
            attrs, at = _attributes(source, m.end())
            text_from = at
            tag = m[2].lower()
            if m[1]:
                tokens.append(("t", "/" + tag, 0.0))
                if places[tag]:
                    close(places[tag][-1])
                continue
            holder = max((places[h][-1] for h in _HOLDERS if places[h]), default=-1)
            ends = _ENDS.get(tag, ())
            if tag in _BLOCK and "p" not in ends:
                ends = (*ends, "p")
            open_ = [places[e][-1] for e in ends if places[e] and places[e][-1] > holder]
            if open_:
                close(min(open_))
            rescued, before = None, around
            if tag in ("article", "main") and never:
                left_open = [places[t][0] for t in ("nav", "header", "form", "menu") if places[t]]
                bad_at = next(i for i, s in enumerate(stack) if s[1])
                if left_open and left_open[0] == bad_at:  # left open: content can't be below these
                    close(bad_at)
                elif stack[bad_at][0] not in _NEVER and (tag == "main" or not any(_ASIDE_CALLED.intersection(_parts(x)) for s in stack if s[1] for x in s[7])):
                    rescued, never, around = never, 0, 0.0
            names = _names(attrs)
            bad = not never and self._is_never(tag, attrs, content > 0)
            first = len(tokens)
            tokens.append(("t", tag, 0.0))
            if tag in _VOID:
                continue
            block = -1
            if tag in _BLOCK:
                block = len(blocks)
                blocks.append([first, first, parent, tag])
                parent = block
            wide = not bad and (tag in ("article", "main") or attrs.get("role", "").lower() == "main" or tag in ("div", "section") and not _MAIN_CALLED.isdisjoint(names))
            stack.append((tag, bad, "data-main" in attrs, first, wide, before, block, names, rescued))
            places[tag].append(len(stack) - 1)
            around += sum(name_score(x, self.weights) for x in names)
            never += bad
            links += tag == "a"
            content += wide or tag in ("article", "main")
            if tag in _RAW and tag not in ("svg", "noscript", "template"):
                end = re.compile(rf"</{tag}\b", re.I).search(source, at)
                at = end.start() if end else n
                if at > text_from:
                    tokens.append(("x", source[text_from:at], around))
                text_from = at
        if n > text_from:
            tokens.append(("x" if never else "a" if links else "w", source[text_from:], around))
        close(0)

    def scores(self) -> list[float]:
        w, out = self.weights, []
        for kind, value, around in self.tokens:
            if kind == "t":
                out.append(w.get(f"t:{value}", w["t"]))
            elif kind == "x":
                out.append(w["x"] * len(value.split()))
            else:
                out.append((w[kind] + min(max(around, _CLIP[0]), _CLIP[1])) * len(value.split()))
        return out


# Labelled pages: written for this purpose. What `data-main` encloses is the content. The frames around it are
# composed: each page has some of the usual parts of a site, under the names that sites give them.
_TEXTS = (
    "<h1>The harbour opens again</h1><p>After two years of work the old harbour opened on Monday to a small crowd.</p><p>Boats came in before noon, and the <b>first</b> ferry left an hour later with forty people on board.</p>",
    "<h2>Growing beans</h2><p>Beans need warm soil and a stake to climb. Sow them in May, two to a hole, and water well.</p><p>They can be picked from July on. <a href='/m'>More about soil</a> can be found in our guide, which covers clay and sand.</p><ul><li>Water in the evening.</li><li>Pick often.</li></ul>",
    "<h1>Notes on rivers</h1><p>A river carries more than water: sand, leaves and salt move with it to the sea.</p><blockquote>No man steps twice into the same river.</blockquote><p>In spring the flow is fast<br>and the banks give way in places.</p><table><tr><td>Depth</td><td>four metres</td></tr></table>",
    "<header class='article-header'><h1>A quiet year for the firm</h1></header><div class='share-price'>The price rose by three pence on the day.</div><p>Sales were flat, the board said, and <a href='/b'>no dividend</a> will be paid.</p><p>Read on below for the figures of each branch, which the firm gave for the first time.</p>",
    "<h1>Three walks</h1><ol><li><a href='/1'>The hill</a>, an hour up and half an hour down, best before noon.</li><li><a href='/2'>The shore</a>, flat and windy, with a place for tea.</li></ol><p>All of them start at the station. Take a map and some bread with you.</p>",
)
_SITE_PARTS = (
    ("<ul><li><a href='/'>Home</a></li><li><a href='/n'>News</a></li><li><a href='/s'>Sport</a></li></ul>", "nav navbar menu breadcrumb breadcrumbs navigation main-nav site-nav menubar toolbar pagination pager"),
    ("<p>We use cookies on this site. <button>Accept</button></p>", "cookie cookies cookie-notice cookie-banner consent gdpr notice popup modal overlay notification notifications"),
    ("<p>Buy now and save on shoes.</p>", "ad ads advert adverts advertisement advertising banner promo promotion sponsor sponsored ad-slot"),
    ("<h3>Most read</h3><ul><li><a href='/1'>Ten tips</a></li><li><a href='/2'>A quiet lake</a></li></ul>", "sidebar related recommended widget widgets related-posts sidebar-left popular trending"),
    ("<h3>Comments</h3><p>Great post, thanks! Mine never grew.</p><p>Same here, for years.</p>", "comments comment commentlist comment-list replies reply respond disqus comments-area"),
    ("<p>All rights reserved. <a href='/t'>Terms</a> <a href='/p'>Privacy</a></p>", "footer site-footer page-footer masthead site-header copyright colophon"),
    ("<a href='/f'>Share</a> <a href='/x'>Send</a> <a href='/m'>Mail</a>", "share sharing social share-buttons social-links follow skip"),
    ("<p>Get our letter each week.</p><form><input name='e'><button>Join</button></form>", "newsletter subscribe subscription signup newsletter-box"),
)
_FRAMES = ("article", "div class='post'", "main", "div class='content'", "section class='story'", "div id='article'", "div class='entry-content'", "div class='text'", "div class='article-body'", "div class='post-content'")


def labelled_pages() -> list[str]:
    """Pages of every frame and text, with the parts of a site before and after; each name of a part is on several pages."""
    pages = []
    names = [[n for n in part.split()] for _, part in _SITE_PARTS]
    for k in range(max(map(len, names)) * 4):
        part = [f"<div class='{own[k % len(own)]}'>{body}</div>" for (body, _), own in zip(_SITE_PARTS, names)]
        frame = _FRAMES[k % len(_FRAMES)]
        main = f"<{frame} data-main>{_TEXTS[k % len(_TEXTS)]}</{frame.split()[0]}>"
        head = f"<head><title>T</title><script>go()</script></head><body><header><a href='/'>Daily Post</a></header><nav>{_SITE_PARTS[0][0]}</nav>"
        foot = f"<aside>{_SITE_PARTS[3][0]}</aside><footer><p>All rights reserved. <a href='/i'>Imprint</a></p></footer></body>"
        pages.append(f"<html>{head}{part[0]}{part[1]}{part[2]}{main}{part[6]}{part[4]}{part[3]}{part[7]}{part[5]}{foot}</html>")
    return pages


def fit(pages) -> dict[str, float]:
    """Weights from pages whose content is marked: log odds of being content, of words by their kind, of tags, of names and parts of names.

    Words in running text are scored over those in links, and tags below zero, by what the method asks; names may score either way.
    """
    inside, outside = Counter(), Counter()
    for source in pages:
        page = Page(source)
        marks = [0] * (len(page.tokens) + 1)
        for a, b in page.main:
            marks[a] += 1
            marks[b] -= 1
        within = list(itertools.accumulate(marks))
        for k, (kind, value, _) in enumerate(page.tokens):
            into = inside if within[k] else outside
            if kind == "t":
                into[f"t:{value}"] += 1
                into["t"] += 1
            else:
                into[kind] += len(value.split())
        for names, first, end in page.named:
            if any(first < a and b <= end for a, b in page.main):
                continue  # a frame around the content: says nothing
            into = inside if within[first] else outside
            for name in names:
                into.update({"=" + name, *("~" + p for p in _parts(name))})
    odds = lambda key: math.log((inside[key] + 0.5) / (outside[key] + 0.5))
    weights = {key: odds(key) for key in {*inside, *outside} if key[0] in "=~"}
    for key in {*inside, *outside}:
        if key == "t" or key.startswith("t:"):
            weights[key] = -0.1 - max(0.0, -odds(key)) / 4
    word = max(1.0, odds("w"))
    return weights | {"w": word, "a": min(odds("a"), word / 2), "x": -word}


WEIGHTS = fit(labelled_pages())


def best_region(scores: list[float]) -> tuple[int, int]:
    """The contiguous range of the largest sum; of equal ones the first. Empty if nothing is positive."""
    best, total, start, found = 0.0, 0.0, 0, (0, 0)
    for k, s in enumerate(scores):
        if total <= 0:
            total, start = 0.0, k
        total += s
        if total > best:
            best, found = total, (start, k + 1)
    return found


def _breaks(token: tuple) -> bool:
    return token[0] == "t" and token[1].lstrip("/") in _BLOCK


def _with_neighbours(page: Page, scores: list[float], a: int, b: int) -> tuple[int, int]:
    """The range over the text blocks beside it, of the same parent, whose own sum is positive."""
    parent = -1
    for k, (x, y, _, _) in enumerate(page.blocks):  # the last that holds the range is the innermost
        if x <= a and b <= y and (x, y) != (a, b):
            parent = k
    sums = [0.0, *itertools.accumulate(scores)]
    for x, y, above, tag in page.blocks:
        if above == parent and tag in _TEXT_BLOCKS and sums[y] - sums[x] > 0:
            a, b = min(a, x), max(b, y)
    return a, b


def main_text(source: str, weights: dict[str, float] | None = None) -> str:
    page = Page(source, WEIGHTS if weights is None else weights)
    scores = page.scores()
    a, b = best_region(scores)
    if a == b:
        return ""
    inside = False
    for x, y in page.wide:
        if x <= a < y:
            a, inside = x, True
        if x < b <= y:
            b, inside = y, True
    while a and not _breaks(page.tokens[a]):
        a -= 1
    while b < len(page.tokens) and not _breaks(page.tokens[b - 1]):
        b += 1
    if not inside:
        a, b = _with_neighbours(page, scores, a, b)
    blocks, own = [], []
    for token in page.tokens[a:b]:
        if token[0] == "t":
            if _breaks(token):
                blocks.append(own)
                own = []
            elif token[1] == "br":
                own.append(" ")
        elif token[0] != "x":
            own.append(token[1])
    blocks.append(own)
    texts = (" ".join(html.unescape("".join(x)).split()) for x in blocks)
    return "\n\n".join(x for x in texts if x)


def _extract(stream):
    for batch in stream:
        texts = [main_text(x) if x else "" for x in batch.column(2).to_pylist()]
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(x) for x in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"]
        )


def extracted(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """page_id, url, text, n_chars of each page."""
    rows = with_columns_renamed_apart(pages, {id_col: "page_id", url_col: "url", html_col: "html"})
    rows = rows.select(F.col("page_id").cast("long"), F.col("url").cast("string"), F.col("html").cast("string"))
    return rows.mapInArrow(_extract, "page_id long, url string, text string, n_chars long")


def op6_max_subsequence(spark, sf_dir: str) -> DataFrame:
    return extracted(table(spark, sf_dir, "pages"))
