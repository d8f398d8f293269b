"""Main text of web pages by a linear-chain conditional random field over DOM leaf blocks.

A leaf block is a stretch of text between two block-level tags. Its features are its ancestors' tags and name tokens, and
what its text looks like: length, links, marks; words are no features, so the field holds for any language. It is fitted on
labelled pages that this module lays out from a few page plans, and decoded by Viterbi: main text or not.
"""

from __future__ import annotations

import re
from functools import lru_cache
from html import escape
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowsieve.llm.common import small_slices
from flowsieve.llm.crf import Crf, fit, hashed, viterbi

BUCKETS = 1 << 13
# fixed values of HTML: elements without content, without text of their own, within a line, and those that a like one ends
VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
SILENT = frozenset("head script style template noscript svg math iframe object canvas audio video".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd label mark q s samp small span strike strong sub sup time tt u var wbr br".split())
CLOSED_BY = {
    "p": frozenset("address article aside blockquote details div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul".split()),
    "li": frozenset(["li"]), "dt": frozenset(["dt", "dd"]), "dd": frozenset(["dt", "dd"]), "tr": frozenset(["tr"]), "td": frozenset(["td", "th", "tr"]),
    "th": frozenset(["td", "th", "tr"]), "option": frozenset(["option"]),
}
# what a head may hold: anything else ends it, closed or not
HEAD = frozenset("base basefont bgsound html link meta noframes noscript script style template title".split())
_HOLDS = frozenset("ul ol dl table div section article".split())
_TOKEN = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|\d+")


class _Blocks(HTMLParser):
    """Cuts a page into ``(path, text, linked characters)``; ``path`` has (tag, name tokens) of the open elements."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.open: list[tuple[str, tuple[str, ...]]] = []
        self.found: list[tuple] = []
        self.parts: list[str] = []
        self.linked, self.links, self.silent = 0, 0, 0

    def flush(self) -> None:
        text = " ".join("".join(self.parts).split())
        if text:
            self.found.append((tuple(self.open), text, self.linked))
        self.parts, self.linked = [], 0

    def _end_head(self, wherever: bool) -> None:
        """Close a head that is left open; inside one of its elements only a body does."""
        for k in range(len(self.open) - 1, -1, -1):
            if self.open[k][0] == "head":
                self.flush()
                self._close(k)
                break
            if not wherever:
                break

    def handle_starttag(self, tag, attrs):
        if tag not in HEAD:
            self._end_head(tag == "body")
        if tag in INLINE:
            self.links += tag == "a"
            if tag == "br":
                self.parts.append(" ")
            return
        self.flush()
        if tag in VOID:
            return
        for k in range(len(self.open) - 1, -1, -1):
            name = self.open[k][0]
            if tag in CLOSED_BY.get(name, ()):
                self._close(k)
                break
            if name in _HOLDS:
                break
        names = tuple(t.lower() for key, value in attrs if key in ("class", "id", "role", "itemprop", "aria-label") and value for t in _TOKEN.findall(value))
        self.open.append((tag, names + tuple("data-main" for key, _ in attrs if key == "data-main")))
        self.silent += tag in SILENT

    def _close(self, k: int) -> None:
        self.silent -= sum(t in SILENT for t, _ in self.open[k:])
        self.links = 0
        del self.open[k:]

    def handle_endtag(self, tag):
        if tag in INLINE:
            self.links = max(0, self.links - (tag == "a"))
            return
        self.flush()
        for k in range(len(self.open) - 1, -1, -1):
            if self.open[k][0] == tag:
                self._close(k)
                break

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)

    def handle_data(self, data):
        if self.silent and data.strip():
            self._end_head(False)
        if not self.silent:
            self.parts.append(data)
            if self.links:
                self.linked += len(data.strip())


def blocks(html: str) -> list[tuple]:
    parser = _Blocks()
    parser.feed(html)
    parser.close()
    parser.flush()
    return parser.found


def look(text: str, linked: int) -> tuple:
    """What a block's text looks like, in steps, so that like blocks share their features."""
    size = len(text)
    return (
        min(size.bit_length(), 9), 4 * min(linked, size) // max(size, 1), text[-1] in ".!?:;\"')…", text.count(". ") > 0,
        text[0] == "©" or "©" in text[:80], "|" in text or "·" in text[:80],
    )


def block_features(path: tuple, seen: tuple) -> list[int]:
    """Hashed features of a block: each ancestor's tag and name tokens, the innermost two tags, and the text's look."""
    tags = [t for t, _ in path]
    names = {n for _, own in path for n in own if n != "data-main"}
    out = [f"t{t}" for t in set(tags)] + [f"n{n}" for n in names] + [f"i{'>'.join(tags[-1:])}", f"j{'>'.join(tags[-2:])}"]
    out += [f"l{k}:{v}" for k, v in enumerate(seen)] + [f"b{seen[0]}{seen[1]}", "bias"]
    return [hashed(f, BUCKETS) for f in out]


# page plans: (markup before, what stands in it, markup behind, whether it is main text)
_OUTER = [
    ('<nav{}><ul>', "links", "</ul></nav>", False), ('<div{}>', "short", "</div>", False), ('<header{}>', "short", "</header>", False), ('<aside{}>', "mixed", "</aside>", False),
    ('<div{}><ul>', "links", "</ul></div>", False), ('<form{}>', "form", "</form>", False), ('<section{}>', "comments", "</section>", False), ('<div{}>', "text", "</div>", False),
]
_NAMES = {
    "<nav": ["nav", "menu", "navbar", "breadcrumb", ""], "<header": ["header", "site-header", "masthead", "banner", ""], "<aside": ["sidebar", "related", "widget", "promo", ""],
    "<form": ["form", "search-form", "newsletter", "login", "subscribe", ""], "<section": ["comments", "comment-list", "responses", "discussion"],
    "<div": ["ad", "ads", "advert", "advertisement", "sponsor", "sponsored", "banner", "cookie-notice", "cookie", "consent", "notice", "gdpr", "popup", "modal", "newsletter", "share", "social", "related", "sidebar", "menu", "topbar", "breadcrumbs", "comments", "comment", "widget", "promo", "footer", "header", "nav", "tags", "pagination", "disclaimer", "copyright", "toolbar", "alert"],
}
_MAIN = ["<article{}>", "<main{}>", "<main><article{}>", '<div class="{}">', '<div id="{}">', '<section class="{}">', "<article><div{}>"]
_MAIN_NAMES = ["content", "article", "post", "entry-content", "article-body", "post-content", "main", "story", "text", "body"]


def _words(rng, n: int) -> str:
    return " ".join("".join(rng.choice(list("abdeghilmnorstuz"), rng.integers(2, 9))) for _ in range(n)).capitalize()


def _prose(rng, longest: int = 12) -> str:
    return " ".join(_words(rng, int(rng.integers(1, 16))) + "." for _ in range(int(rng.integers(1, longest))))


def _filled(rng, kind: str) -> str:
    if kind == "links":
        return "".join(f'<li><a href="/{i}">{_words(rng, int(rng.integers(1, 4)))}</a></li>' for i in range(int(rng.integers(2, 9))))
    if kind == "form":
        return f"<label>{_words(rng, 2)}</label><input><p>{_prose(rng, 3)}</p><button>{_words(rng, 1)}</button>"
    if kind == "comments":
        return "".join(f'<div class="comment"><h4>{_words(rng, 2)}</h4><p>{_prose(rng, 5)}</p></div>' for _ in range(int(rng.integers(1, 5))))
    if kind == "mixed":
        return f"<h3>{_words(rng, 3)}</h3><p>{_prose(rng, 4)}</p><ul>{_filled(rng, 'links')}</ul>"
    if kind == "text":
        return rng.choice([f"<p>{_prose(rng, 6)}</p>", _prose(rng, 4)])
    return rng.choice([_words(rng, int(rng.integers(1, 12))), _prose(rng, 3), f'<a href="/">{_words(rng, 2)}</a>', f"<p>{_words(rng, 5)}</p>"])


def _other(rng) -> str:
    before, kind, after, _ = _OUTER[int(rng.integers(len(_OUTER)))]
    name = str(rng.choice(_NAMES[before.split("{")[0]]))
    key = "id" if rng.random() < 0.3 else "class"
    return before.format(f' {key}="{name}"' if name else "") + _filled(rng, kind) + after


def labelled_page(rng) -> str:
    """A page whose main blocks stand in elements marked ``data-main``."""
    first = [_other(rng) for _ in range(int(rng.integers(0, 4)))]
    frame = str(rng.choice(_MAIN))
    name = str(rng.choice(_MAIN_NAMES))
    opening = frame.format(name if '"{}"' in frame else f' class="{name}"' if rng.random() < 0.4 else "")
    body = [f"<h1 data-main>{_words(rng, int(rng.integers(2, 10)))}</h1>"] if rng.random() < 0.85 else []
    for _ in range(int(rng.integers(1, 12))):
        r = rng.random()
        if r < 0.72:
            text = _prose(rng)
            text = f"<b>{text[:20]}</b>{text[20:]}" if rng.random() < 0.2 else text
            body.append(f"<p data-main>{text}" + "</p>" * (rng.random() < 0.9))
        elif r < 0.8:
            body.append(f"<h2 data-main>{_words(rng, int(rng.integers(1, 6)))}</h2>")
        elif r < 0.86:
            body.append("<ul>" + "".join(f"<li data-main>{_prose(rng, 3)}</li>" for _ in range(3)) + "</ul>")
        elif r < 0.9:
            body.append(f"<blockquote data-main>{_prose(rng, 4)}</blockquote>")
        elif r < 0.93:
            body.append(f"<table><tr><td data-main>{_words(rng, 2)}</td><td data-main>{_words(rng, 1)}</td></tr></table>")
        else:
            body.append(_other(rng))
    closing = "".join(f"</{t}>" for t in reversed(re.findall(r"<(\w+)", opening)))
    last = [_other(rng) for _ in range(int(rng.integers(0, 4)))]
    if rng.random() < 0.8:
        last.append(f"<footer>{rng.choice(['© ', ''])}{_words(rng, 2)} {rng.choice(['· ', '| ', ''])}{_prose(rng, 4)}</footer>")
    page = "".join([*first, opening, *body, closing, *last])
    return f"<html><head><title>{escape(_words(rng, 3))}</title></head><body>{page}</body></html>"


@lru_cache(1)
def fitted(pages: int = 800, seed: int = 8) -> Crf:
    rng = np.random.default_rng(seed)
    sequences, targets = [], []
    for _ in range(pages):
        found = blocks(labelled_page(rng))
        sequences.append([block_features(path, look(text, linked)) for path, text, linked in found])
        targets.append([int(bool(path) and "data-main" in path[-1][1]) for path, _, _ in found])
    return fit(sequences, targets, ["other", "main"], BUCKETS, rounds=4, batch=64)


class Extractor:
    def __init__(self, crf: Crf):
        self.crf, self.known = crf, {}

    def __call__(self, html: str) -> str:
        found = blocks(html)
        rows = []
        for path, text, linked in found:
            key = (path, look(text, linked))
            if key not in self.known:
                if len(self.known) > 50_000:
                    self.known.clear()
                self.known[key] = self.crf.score(block_features(*key))
            rows.append(self.known[key])
        labels = viterbi(np.array(rows), self.crf) if rows else []
        return "\n".join(text for (_, text, _), label in zip(found, labels) if label)


_OUT = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("text", pa.string()), ("n_chars", pa.int64())])


def extracted(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """One row per page: ``page_id, url, text, n_chars``.

    Blocks labelled main, in page order, one line each; character references are decoded and white space in a block becomes
    one space. A null or empty page, or one without main text, gives an empty text. Repeated rows and null ids are
    carried through. Other columns are ignored. An empty table gives an empty result.
    """
    crf = fitted()

    def run(batches):
        extract = Extractor(crf)
        for batch in batches:
            for part in small_slices(batch, 1):
                texts = [extract(h) if h else "" for h in part.column(1).to_pylist()]
                yield pa.RecordBatch.from_pydict({"page_id": part.column(0), "url": part.column(2), "text": texts, "n_chars": [len(t) for t in texts]}, schema=_OUT)
    rows = pages.select(F.col(id_col).cast("bigint").alias("page_id"), F.col(html_col).cast("string").alias("html"), F.col(url_col).cast("string").alias("url"))
    return rows.mapInArrow(run, "page_id bigint, url string, text string, n_chars bigint")
