"""The main text of web pages by line-block distribution.

A page becomes lines: the text between the borders of block elements, markup stripped. A line
weighs its length; one in a menu, footer, form, advert and the like weighs nothing, nor does one
that is mostly links. The sums of ``window`` lines in a row rise at the surge point where prose
begins and fall to nothing at the dive point where it ends; the text between them is kept. Lines
of an ``article`` or ``main`` element weigh a surge by themselves, so that short paragraphs do
not part an article, and where a page has such an element the lines around it weigh nothing.
"""

from __future__ import annotations

import html
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame

from kbspark.llm._store import small_batches


@dataclass(frozen=True)
class Lines:
    """``window``: lines of a block; ``surge``: characters in a window at which prose begins; ``share``: least part of the largest run of lines that another run must weigh; ``links``: part of a line in links from which it is a menu."""

    window: int = 3
    surge: int = 60
    share: float = 0.2
    links: float = 0.5


#: Names of HTML.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCK = frozenset("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol optgroup option p pre search section summary table tbody tfoot thead tr ul".split())
RAW = frozenset("script style noscript template iframe svg math textarea title noframes noembed object canvas audio video select".split())
CHROME = frozenset("nav footer aside form fieldset button dialog menu search label".split())
SCOPE = frozenset("html table td th caption".split())
ROLES = frozenset("navigation banner contentinfo complementary search alert alertdialog dialog form menu menubar toolbar".split())
#: Words in classes and ids that name what is not the article.
NAMES = frozenset(
    "ad ads adv advert adverts advertisement advertisements sponsor sponsored promo promotion banner nav navbar navigation menu menus submenu breadcrumb breadcrumbs footer sidebar sidebars aside cookie cookies consent gdpr "
    "notice notices alert popup modal overlay newsletter subscribe subscription signup login share sharing social related recommended recommendations pagination pager toolbar copyright form search skip masthead topbar".split()
)
REPLY = frozenset(("comment", "reply"))
COMMENTS = REPLY | frozenset("comments commentlist disqus respond replies discussion".split())
#: A class or id with ``header`` names the page's header if it has no other words than these.
SITE = frozenset("header site page main top global wrapper container inner".split())

_TOKEN = re.compile(r"<!--.*?(?:--!?>|\Z)|<[!?][^>]*+(?:>|\Z)|</([a-zA-Z][^\s/>]*+)[^>]*+(?:>|\Z)|<([a-zA-Z][^\s/>]*+)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)(?:>|\Z)|<([a-zA-Z][^\s/>]*+)([^>]*+)(?:>|\Z)", re.S)
_MARKS = re.compile(r"(?<![\w-])(class|id|role|hidden)(?![\w-])(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?", re.I)
_WORDS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")
_NOT = frozenset("has with no without".split())


def _marks(attributes: str) -> tuple[bool, set[str], str]:
    """Whether an element is hidden, the words of its class and id, its role."""
    hidden, words, role = False, set(), ""
    for name, *values in _MARKS.findall(attributes):
        value = "".join(values)
        if name.lower() == "hidden":
            hidden = True
        elif name.lower() == "role":
            role = value.lower().strip()
        else:
            for name_ in value.split():
                found = [w.lower() for w in _WORDS.findall(name_)]
                words |= {w for before, w in zip(["", *found], found) if before not in _NOT}
    return hidden, words, role


class _Page:
    """The lines of a page: ``text, length in links, chrome, inside an article``."""

    def __init__(self, source: str):
        self.lines: list[tuple[str, int, bool, bool]] = []
        self.stack: list[tuple[str, str, bool]] = [("", "", False)]  # element, "chrome" or "comments" or "named" or "", inside
        self.open: Counter[str] = Counter()
        self.text: list[str] = []
        self.links, self.linked = 0, 0
        self._read(source)
        self._end()

    def _end(self) -> None:
        line = " ".join(html.unescape("".join(self.text)).split())
        if line:
            _, state, inside = self.stack[-1]
            self.lines.append((line, self.linked, bool(state), inside and not state))
        self.text, self.linked = [], 0

    def _read(self, source: str) -> None:
        at = 0
        low = None
        while (m := _TOKEN.search(source, at)) is not None:
            self._say(source[at : m.start()])
            at = m.end()
            close, tag = m.group(1), m.group(2) or m.group(4)
            if close:
                self._close(close.lower())
            elif tag:
                tag = tag.lower()
                if tag in RAW:
                    if low is None:
                        low = re.sub("[A-Z]+", lambda x: x.group().lower(), source)
                    end = low.find(f"</{tag}", at)
                    if tag in BLOCK or tag in ("title", "textarea", "select"):
                        self._end()
                    at = len(source) if end < 0 else end
                else:
                    self._open(tag, m.group(3) or m.group(5) or "")
        self._say(source[at:])

    def _say(self, text: str) -> None:
        if text:
            self.text.append(text)
            if self.links:
                self.linked += len(text.strip())

    def _open(self, tag: str, attributes: str) -> None:
        if tag == "a":
            self.links = 1
        if tag == "br" or tag in ("td", "th"):
            self.text.append(" ")
        if tag in BLOCK:
            self._end()
            if self.stack[-1][0] == "p":
                self._pop()
            if tag == "li":
                self._close_in("li", ("ul", "ol", "menu"))
            elif tag in ("dd", "dt"):
                self._close_in("dd", ("dl",)), self._close_in("dt", ("dl",))
        if tag in VOID or tag not in BLOCK | SCOPE | CHROME and not _MARKS.search(attributes):
            return
        _, state, inside = self.stack[-1]
        hidden, words, role = _marks(attributes) if attributes else (False, set(), "")
        frame = tag in ("html", "body", "main")
        if state == "comments" or not frame and words & (REPLY if tag == "article" else COMMENTS):
            state = "comments"
        elif tag in ("article", "main"):
            state, inside = "" if state in ("", "named") else state, True
        elif not state:
            if tag in CHROME or hidden or role in ROLES or tag == "header" and not inside:
                state = "chrome"
            elif not frame and (words & NAMES or not inside and "header" in words and words <= SITE):
                state = "named"
        self.stack.append((tag, state, inside))
        self.open[tag] += 1

    def _close(self, tag: str) -> None:
        if tag == "a":
            self.links = 0
        if tag in BLOCK:
            self._end()
            self._close_in(tag, SCOPE - {tag})
        elif tag in SCOPE:
            self._close_in(tag, ())
        elif any(x[0] == tag for x in self.stack[-8:]):  # a marked inline element: it closes itself, not the blocks around it
            while self.stack[-1][0] != tag and self.stack[-1][0] not in BLOCK:
                self._pop()
            if self.stack[-1][0] == tag:
                if self.stack[-1][1] != self.stack[-2][1]:
                    self._end()
                self._pop()

    def _pop(self) -> None:
        self.open[self.stack.pop()[0]] -= 1

    def _close_in(self, tag: str, scope: tuple | frozenset) -> None:
        """Close the last open ``tag`` and all in it, but nothing beyond an element of ``scope``."""
        if not self.open[tag]:
            return
        for i in range(len(self.stack) - 1, 0, -1):
            if self.stack[i][0] == tag:
                while len(self.stack) > i:
                    self._pop()
                return
            if self.stack[i][0] in scope:
                return


def extract(source: str, rules: Lines = Lines()) -> str:
    """The main text of one page, a line for each block."""
    lines = _Page(source).lines
    within = any(inside for *_, inside in lines)
    kept, weights = [], []
    for text, linked, chrome, inside in lines:
        if within and chrome and kept and kept[-1] is not None:
            continue  # what stands in an article's way does not part it
        weigh = inside if within else not chrome and linked <= rules.links * len(text)
        kept.append(text if weigh else None)
        weights.append((len(text) + rules.surge * within) * weigh)
    runs = surges(weights, rules)
    most = max((sum(weights[a:b]) for a, b in runs), default=0)
    return "\n".join(kept[i] for a, b in runs if sum(weights[a:b]) >= rules.share * most for i in range(a, b) if kept[i] is not None)


def surges(weights: list[int], rules: Lines) -> list[tuple[int, int]]:
    """From surge to dive: runs of lines, first to past the last, without the blank lines at their ends."""
    sums = [sum(weights[i : i + rules.window]) for i in range(len(weights))]
    runs, start = [], None
    for i, total in enumerate(sums):
        if start is None and total >= rules.surge and weights[i]:
            start = i
        if start is not None and (not total or i == len(sums) - 1):
            end = i + 1
            while not weights[end - 1]:
                end -= 1
            runs.append((start, end))
            start = None
    return runs


def main_text(pages: DataFrame, rules: Lines = Lines()) -> DataFrame:
    """``page_id, url, text, n_chars`` for every row of ``pages(page_id, url, html)``.

    Character references are decoded, white space in a block is one space (``br`` and cells too),
    blocks are joined in page order by line feeds; headings of the article are text. Null and
    empty pages, and pages without main text, have an empty text. Every row stands for itself:
    repeated rows and null ids too. Other columns are not looked at; an empty table gives an
    empty result; pages are read whole.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 64):
                part = batch.slice(lo, 64)
                texts = [extract(cell.as_py() or "", rules) for cell in part.column(2)]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])

    small_batches(pages.sparkSession)
    rows = pages.select(pages["page_id"].cast("long"), "url", "html")
    return rows.mapInArrow(run, "page_id long, url string, text string, n_chars long")
