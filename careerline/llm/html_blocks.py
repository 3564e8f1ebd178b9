"""Flat text blocks of an HTML page and what is measured on them."""

from __future__ import annotations

import html
import re
from collections import Counter

#: What is measured on each block, in the order of its feature list.
FEATURES = (
    "words",
    "link_density",
    "words_before",
    "link_density_before",
    "words_after",
    "link_density_after",
    "place",
    "aside",
)

# Element and class names by their usual meaning. A head's own text is in dropped elements, and its
# end tag may be left out, so the head is not dropped as a whole.
_BLOCK_TAGS = frozenset(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split()
)
_VOID_TAGS = frozenset("hr".split())
_DROPPED_TAGS = "script|style|noscript|template|textarea|svg|iframe|title"
#: Their text is no part of a page either, but they end with the element around them if they are not closed.
_SKIPPED_TAGS = frozenset("select button object".split())
_HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: A linked heading belongs to the text below it if that has so many words, mostly without links.
_RUNNING_WORDS = 20
_ASIDE_TAGS = frozenset("nav footer aside form menu dialog header".split())
_MAIN_TAGS = frozenset("article main".split())
_ASIDE_WORDS = frozenset(
    "ad ads adv advert adverts advertisement advertising sponsor sponsored promo promotion banner cookie cookies consent gdpr "
    "notice notices popup modal overlay newsletter subscribe subscription signup sidebar rail menu nav navbar navigation "
    "breadcrumb breadcrumbs header masthead topbar footer bottombar copyright comment comments commentlist disqus reply replies respond "
    "discussion share sharing social related recommended recommendations widget login search searchform toolbar pagination pager "
    "complementary contentinfo alert disclaimer form hidden".split()
)
_CLOSED_BY = {
    "li": frozenset(["li"]),
    "dd": frozenset(["dd", "dt"]),
    "dt": frozenset(["dd", "dt"]),
    "td": frozenset(["td", "th"]),
    "th": frozenset(["td", "th"]),
    "tr": frozenset(["tr", "td", "th"]),
}
_LISTS = frozenset("ul ol dl menu table body article main section div".split())

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)"
    # A slash ends foreign elements only.
    r"|<svg(?=[\s/])(?:[^>\"'/]|/(?!>)|\"[^\"]*\"|'[^']*')*+/>"
    r"|<(?P<dropped>" + _DROPPED_TAGS + r")(?=[\s/>])(?:[^>\"']|\"[^\"]*\"|'[^']*')*+>.*?(?:</(?P=dropped)(?=[\s/>])[^>]*>|\Z)"
    r"|<(?P<end>/?)(?P<name>[a-zA-Z][^\s/>]*)(?P<rest>(?:[^>\"']|\"[^\"]*\"|'[^']*'|[\"'])*?)(?:>|\Z)"
    r"|<[!?/][^>]*(?:>|\Z)",
    re.DOTALL | re.IGNORECASE,
)
_ATTRIBUTE = re.compile(r"([^\s=/>\"']+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?")
_NO_DISPLAY = re.compile(r"\bdisplay\s*:\s*none\b", re.IGNORECASE)
_WORD = re.compile(r"[a-z]+")


def _names_aside(value: str) -> bool:
    """Whether one of the names in a class, id or role says so: all words of it are listed ones."""
    return any(_ASIDE_WORDS.issuperset(words) for name in value.lower().split() if (words := _WORD.findall(name)))


def _stands_aside(name: str, rest: str, in_main: bool) -> bool:
    """Whether an element is one of the parts around an article; a body, main or article element is none by its names."""
    if name in _ASIDE_TAGS and not (name == "header" and in_main):
        return True
    if name == "body" or not rest.strip():
        return False
    for m in _ATTRIBUTE.finditer(rest):
        attribute, value = m[1].lower(), m[2] or m[3] or m[4] or ""
        if attribute in ("hidden", "aria-hidden") and value.lower() != "false":
            return True
        if attribute == "style" and _NO_DISPLAY.search(value):
            return True
        if attribute in ("class", "id", "role") and name not in _MAIN_TAGS and _names_aside(value):
            return True
    return False


class _Page:
    """Collects blocks while the page is read from start to end."""

    def __init__(self) -> None:
        self.blocks: list[tuple[str, int, int, bool, bool, tuple[int, ...]]] = []
        # Name, numbers of the elements around it that stand aside, whether in an article; both hold for all inside.
        self.stack: list[tuple[str, tuple[int, ...], bool]] = []
        self.asides = 0
        self.mains: list[tuple[int, ...]] = []  # for each article or main element, what it is inside of
        self.parts: list[str] = []
        self.linked: list[str] = []
        # Inline elements that end at the latest with the block around them: how deep that block lies.
        self.link: int | None = None
        self.skips: list[tuple[str, int]] = []

    def text(self, raw: str) -> None:
        if raw and not self.skips:
            plain = html.unescape(raw) if "&" in raw else raw
            self.parts.append(plain)
            if self.link is not None:
                self.linked.append(plain)

    def cut(self) -> None:
        """Ends the block; blocks without text are none."""
        words = "".join(self.parts).split()
        if words:
            linked = sum(map(len, "".join(self.linked).split()))
            name, aside, main = self.stack[-1] if self.stack else ("", (), False)
            self.blocks.append((" ".join(words), len(words), linked, name in _HEADINGS, main, aside))
        self.parts, self.linked = [], []

    def open(self, name: str, rest: str) -> None:
        if name == "a":
            # An anchor without a target is a place, not a link.
            self.link = len(self.stack) if any(m[1].lower() == "href" for m in _ATTRIBUTE.finditer(rest)) else None
        elif name in _SKIPPED_TAGS:
            self.skips.append((name, len(self.stack)))
        elif name == "br":
            self.parts.append("\n")
            self.linked.append("\n")
        elif name in _BLOCK_TAGS:
            self.cut()
            if name in _VOID_TAGS:
                return
            if self.stack and self.stack[-1][0] in ("p", *_HEADINGS):
                self._leave(len(self.stack) - 1)
            self._close_open_item(name)
            _, aside, main = self.stack[-1] if self.stack else ("", (), False)
            if _stands_aside(name, rest, main):
                aside = (*aside, self.asides)
                self.asides += 1
            if name in _MAIN_TAGS and not main:
                self.mains.append(aside)
            self.stack.append((name, aside, main or name in _MAIN_TAGS))

    def _close_open_item(self, name: str) -> None:
        ends = _CLOSED_BY.get(name, ())
        for k in range(len(self.stack) - 1, -1, -1):
            if self.stack[k][0] in ends:
                self._leave(k)
            elif self.stack[k][0] in _LISTS:
                return

    def close(self, name: str) -> None:
        if name == "a":
            self.link = None
        elif name in _SKIPPED_TAGS:
            for k in range(len(self.skips) - 1, -1, -1):
                if self.skips[k][0] == name:
                    del self.skips[k:]
                    return
        elif name in _BLOCK_TAGS:
            self.cut()
            for k in range(len(self.stack) - 1, -1, -1):
                if self.stack[k][0] == name:
                    self._leave(k)
                    return

    def _leave(self, depth: int) -> None:
        """Ends the elements from ``depth`` on, and what was opened inside them."""
        del self.stack[depth:]
        if self.link is not None and self.link > depth:
            self.link = None
        self.skips = [skip for skip in self.skips if skip[1] <= depth]


def _wrappers(page: _Page) -> set[int]:
    """The elements that stand aside by their tag or names but hold most words of the page and all its articles."""
    inside = Counter()
    for _, words, *_, around in page.blocks:
        inside.update(dict.fromkeys(around, words))
    total = sum(words for _, words, *_ in page.blocks)
    return {k for k, words in inside.items() if 2 * words > total and all(k in around for around in page.mains)}


def page_blocks(source: str | None) -> tuple[list[str], list[list[float]]]:
    """The texts of a page's blocks and their features.

    ``link_density`` is the share of a block's characters inside links. Neighbours are the blocks before and
    after it on the page; a missing one has no words. Links of a heading over running text do not count. ``place`` is 2 inside an article or main
    element, 0 outside it, and 1 on a page where these hold less than half of the words that do not stand aside;
    ``aside`` is 1 inside a part around the article, unless it is a wrapper around most of the page.
    """
    page, at = _Page(), 0
    for token in _TOKEN.finditer(source or ""):
        page.text(source[at : token.start()])
        at = token.end()
        name = (token["name"] or "").lower()
        if name and token["end"]:
            page.close(name)
        elif name:
            page.open(name, token["rest"])
    page.text((source or "")[at:])
    page.cut()
    wrappers = _wrappers(page)
    blocks = [(*block, not wrappers.issuperset(around)) for *block, around in page.blocks]
    measured = [(float(n), linked / sum(map(len, text.split()))) for text, n, linked, *_ in blocks]
    # A linked heading over running text is the heading of that text.
    for k, (_, _, _, heading, *_) in enumerate(blocks[:-1]):
        if heading and measured[k + 1][0] >= _RUNNING_WORDS and measured[k + 1][1] < 0.5:
            measured[k] = (measured[k][0], 0.0)
    around = [(0.0, 0.0), *measured, (0.0, 0.0)]
    in_main = sum(n for _, n, *_, main, aside in blocks if main and not aside)
    has_main = in_main and 2 * in_main >= sum(n for _, n, *_, aside in blocks if not aside)
    features = [
        [*measured[k], *around[k], *around[k + 2], (2.0 if main else 0.0) if has_main else 1.0, float(aside)]
        for k, (*_, main, aside) in enumerate(blocks)
    ]
    return [text for text, *_ in blocks], features
