"""Main text of HTML pages by two-pass block rules.

A page is cut into blocks at block-level tags; what stands in elements that are never text (scripts,
styles, forms) or that name themselves as menus, sidebars, notices, adverts or comments is left out. The first
pass judges each block by its length, the share of its characters in links and the share of stop words: long
blocks with few links and many stop words are text, blocks of links are not, short ones stay open. Inside an
article or main element a block without links needs no stop words. The second pass gives open blocks the label of their
nearest decided neighbours; where these differ, a block of some length counts as text.

One narrow pass: pages are handled one by one, whole, and nothing is shuffled.

Defined results: null, empty and tag-only pages have an empty text; repeated pages give the same each; unclosed
or stray tags end with the page or are ignored; an empty table gives no rows. Extra columns do not take part.
"""

from __future__ import annotations

import html
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MAX_LINK_SHARE = 0.35
SHORT, LONG = 70, 200
FEW_STOP_WORDS, MANY_STOP_WORDS = 0.1, 0.2

# Frequent words of the four languages.
STOP_WORDS = frozenset(
    [
        *["the", "of", "and", "to", "in", "is", "that", "it", "was", "for", "on", "are", "as", "with", "by", "be", "this", "from", "or", "at", "an", "a", "not", "but"],
        *["der", "die", "das", "und", "den", "von", "zu", "mit", "sich", "auf", "für", "ist", "im", "dem", "nicht", "ein", "eine", "als", "auch", "des", "es", "er"],
        *["le", "la", "les", "de", "du", "et", "un", "une", "en", "que", "qui", "dans", "pour", "pas", "sur", "au", "par", "avec", "est", "ce", "il", "ne"],
        *["el", "los", "las", "y", "por", "con", "no", "una", "su", "para", "lo", "como", "se", "del", "al", "o", "más"],
    ]
)
RAW = ["script", "style", "noscript", "template", "svg", "math", "iframe", "object", "textarea", "select", "title", "canvas", "video", "audio"]
SKIPPED = frozenset(["nav", "footer", "aside", "form", "button", "menu", "dialog", "fieldset", "label", "datalist", "head"])
VOID = frozenset(["area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"])
BLOCKS = frozenset(
    [
        *["p", "div", "section", "article", "main", "header", "footer", "nav", "aside", "form", "ul", "ol", "li", "dl", "dt", "dd"],
        *["h1", "h2", "h3", "h4", "h5", "h6", "table", "thead", "tbody", "tfoot", "tr", "td", "th", "caption", "pre", "blockquote"],
        *["figure", "figcaption", "hr", "body", "html", "address", "details", "summary", "fieldset", "center", "head", "menu", "dialog"],
    ]
)
HEADINGS = frozenset(["h1", "h2", "h3", "h4", "h5", "h6"])
CLOSED_BY_SELF = frozenset(["p", "li", "dt", "dd", "tr", "td", "th", "option"])
BODIES = frozenset(["article", "main"])
ROLES = frozenset(["navigation", "banner", "contentinfo", "complementary", "search", "dialog", "alert", "alertdialog", "menu", "menubar"])
NAMES = re.compile(
    r"(?:ads?|adv|advert\w*|adsense|banner\w*|sponsor\w*|promo\w*|cookies?\w*|consent|gdpr|notice\w*|popup\w*|modal|newsletter\w*|subscri\w*|"
    r"signup|login|sidebar\w*|widgets?|menu\w*|nav|navbar|navigation|breadcrumbs?|footer\w*|masthead|comment\w*|respond|replies|discussion|"
    r"disqus\w*|share|sharing|social|related|recommend\w*|pagination|pager|toolbar|search\w*|skip|copyright|disclaimer)"
)

# Parts of a class that say something about the page, and classes of the article itself.
STATES = frozenset(["has", "no", "not", "with", "without", "show", "hide"])
OWN = frozenset(["article", "article-body", "article-content", "content", "main", "main-content", "entry-content", "post-content", "post-body"])

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)"
    rf"|<(?P<raw>{'|'.join(RAW)})\b(?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+(?:/>|>.*?(?:</(?P=raw)\s*>|\Z))"
    r"|<(?P<close>/?)(?P<name>[a-zA-Z][a-zA-Z0-9:-]*)(?P<rest>(?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>"
    r"|<[!?/a-zA-Z][^>]*>",
    re.DOTALL | re.IGNORECASE,
)
_ATTRIBUTE = re.compile(r"""\b(class|id|role|hidden|aria-hidden)\b(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""", re.IGNORECASE)
_WORD = re.compile(r"[^\W\d_]+")

TEXT, NOISE, OPEN, MAYBE = "text", "noise", "open", "maybe"


def _names_other(value: str) -> bool:
    """Whether a class or id names a menu, notice or the like, by one of its parts, and not the article."""
    tokens = value.split()
    if any(t in OWN for t in tokens):
        return False
    parts = [[p for p in re.split(r"[^a-z]+", t) if p] for t in tokens]
    return any(NAMES.fullmatch(p) for ps in parts if not STATES.intersection(ps) for p in ps)


def _unwanted(name: str, rest: str, in_body: bool) -> bool:
    """Whether an element is left out with all it holds."""
    if name in SKIPPED or (name == "header" and not in_body):
        return True
    if name in BODIES or name in ("body", "html") or not rest:
        return False
    for attribute, value in _ATTRIBUTE.findall(rest):
        attribute, value = attribute.lower(), value.strip("\"'").lower()
        if attribute == "hidden" or (attribute == "aria-hidden" and value == "true"):
            return True
        if attribute == "role" and value in ROLES:
            return True
        if attribute in ("class", "id") and _names_other(value):
            return True
    return False


class _Blocks:
    """Collects the blocks of a page: (text, characters in links, inside an article, heading)."""

    def __init__(self) -> None:
        self.found: list[tuple[str, int, bool, bool]] = []
        self.stack: list[tuple[str, bool]] = []
        self.open: Counter[str] = Counter()  # names on the stack
        self.headings = 0
        self.skipping = self.links = self.bodies = 0
        self.breaks = 0
        self._start()

    def _start(self) -> None:
        self.parts: list[str] = []
        self.linked = 0

    def end(self) -> None:
        text = " ".join(html.unescape("".join(self.parts)).split())
        if text:
            self.found.append((text, min(self.linked, len(text)), self.bodies > 0, self.headings > 0))
        self._start()

    def text(self, part: str) -> None:
        if self.skipping or not part:
            return
        if part.strip():
            self.breaks = 0
        self.parts.append(part)
        if self.links:
            self.linked += len(" ".join(html.unescape(part).split()))

    def _pop(self) -> None:
        name, unwanted = self.stack.pop()
        self.open[name] -= 1
        self.headings -= name in HEADINGS
        self.skipping -= unwanted
        self.links -= name == "a"
        self.bodies -= name in BODIES

    def tag(self, close: str, name: str, rest: str) -> None:
        if name == "br":
            self.breaks += 1
            self.parts.append(" ")
            if self.breaks > 1:
                self.end()
            return
        if name in BLOCKS:
            self.end()
        if close:
            if self.open[name]:
                while self.stack[-1][0] != name:
                    self._pop()
                self._pop()
            return
        if name in VOID:
            return
        if name in CLOSED_BY_SELF and self.stack and self.stack[-1][0] == name:
            self._pop()
        unwanted = _unwanted(name, rest, self.bodies > 0)
        self.stack.append((name, unwanted))
        self.open[name] += 1
        self.headings += name in HEADINGS
        self.skipping += unwanted
        self.links += name == "a"
        self.bodies += name in BODIES


def blocks(page: str) -> list[tuple[str, int, bool, bool]]:
    """The blocks of a page that no element rules out, in order."""
    out, at = _Blocks(), 0
    for m in _TOKEN.finditer(page):
        out.text(page[at : m.start()])
        at = m.end()
        if m["name"]:
            out.tag(m["close"], m["name"].lower(), m["rest"])
    out.text(page[at:])
    out.end()
    return out.found


def first_label(text: str, linked: int, in_body: bool, heading: bool) -> str:
    """Label of a block by itself."""
    if linked > MAX_LINK_SHARE * len(text):
        return NOISE
    if heading:
        return TEXT if in_body else OPEN
    if len(text) < SHORT:
        return NOISE if linked and not in_body else OPEN
    if in_body:
        return TEXT
    words = _WORD.findall(text.lower())
    share = sum(w in STOP_WORDS for w in words) / max(len(words), 1)
    if share >= MANY_STOP_WORDS:
        return TEXT if len(text) >= LONG else MAYBE
    return MAYBE if share >= FEW_STOP_WORDS else NOISE


def final_labels(labels: list[str], in_body: list[bool]) -> list[bool]:
    """Whether each block is text, with open ones decided by their nearest decided neighbours.

    Neighbours count inside the article for blocks of it, outside for others. Without any neighbour, an open block of an
    article is text and any other is not.
    """

    def nearest(order: Iterator[int]) -> dict[int, str | None]:
        last, out = {True: None, False: None}, {}
        for i in order:
            out[i] = last[in_body[i]]
            if labels[i] in (TEXT, NOISE):
                last[in_body[i]] = labels[i]
        return out

    before, after = nearest(range(len(labels))), nearest(reversed(range(len(labels))))
    out = []
    for i, label in enumerate(labels):
        if label in (TEXT, NOISE):
            out.append(label == TEXT)
            continue
        around = {x for x in (before[i], after[i]) if x}
        if in_body[i]:
            out.append(around != {NOISE})
        else:
            out.append(around == {TEXT} and None not in (before[i], after[i]) or (label == MAYBE and TEXT in around))
    return out


def main_text(page: str | None) -> str:
    """The text blocks of a page, one a line."""
    found = blocks(page) if page else []
    labels = [first_label(*b) for b in found]
    kept = final_labels(labels, [b[2] for b in found])
    return "\n".join(b[0] for b, k in zip(found, kept, strict=True) if k)


def _extracted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = [main_text(page) for page in batch.column(batch.num_columns - 1).to_pylist()]
        columns = [*batch.columns[:-1], pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())]
        yield pa.RecordBatch.from_arrays(columns, [*batch.schema.names[:-1], "text", "n_chars"])


def extract_text(pages: DataFrame, id_column: str = "page_id", url_column: str = "url", html_column: str = "html") -> DataFrame:
    """(page_id, url, text, n_chars) of every page."""
    rows = pages.select(F.col(id_column).alias("page_id"), F.col(url_column).alias("url"), F.col(html_column).alias("html"))
    kind = rows.schema["page_id"].dataType.simpleString()
    return rows.mapInArrow(_extracted, f"page_id {kind}, url string, text string, n_chars bigint")
