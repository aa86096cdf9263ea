"""Main text of web pages by tree scoring.

A forgiving parser builds the element tree (void elements, implied ends of paragraphs, list items and table parts,
stray end tags ignored). Each paragraph of at least ``LEAST`` characters earns one point, one for each comma and one
for each hundred characters, three at most. Its parent gets all of them, its grandparent half, the k-th ancestor
beyond a part 1 / 3k. Containers start from points for their tag and for words in class and id, and their sum is
multiplied by one less their link density, the share of their text that stands in links. The best container is
kept, with those siblings that score a fifth of it or are paragraphs of prose. Points go up ``LEVELS`` elements that
are not inline. Navigation, forms, advertisements and the like are left out wherever they stand; a page that has no
paragraph outside them (one big form, say) is read again with forms and what only class and id speak against, and
then with everything.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame

from .common import col, kind

LEAST, LEVELS = 25, 5
DEPTH = 512  # elements below this depth are put at it, as browsers do
_TAG = re.compile(r"<(/?)([a-zA-Z][^\s/>]*+)((?:[^>\"']|\"[^\"]*+\"|'[^']*+')*+)>", re.S)
_ATTRIBUTE = re.compile(r"(?<![\w-])(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)
_UNLIKELY = re.compile(r"\b(?:ads?|advert\w*|banner|breadcrumbs?|combx|comments?|cookie\w*|disqus|foot(?:er)?|menu|modal|nav\w*|pager|pagination|popup|promo\w*|related|share|sidebar|social|sponsor\w*|subscribe|widget)\b", re.I)
_LIKELY = re.compile(r"\b(?:article|body|blog|content|entry|h-?entry|main|page|post|story|text)\b", re.I)
_RAW = {"script", "style", "noscript", "template", "textarea", "svg", "math", "iframe", "object", "canvas", "xmp", "noembed", "noframes", "plaintext", "title"}
_VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
_DROPPED = {"nav", "footer", "aside", "form", "button", "select", "menu", "dialog", "head"}
_BLOCK = {"address", "article", "aside", "blockquote", "body", "caption", "center", "dd", "details", "dialog", "div", "dl", "dt", "fieldset", "figcaption", "figure", "footer", "form", "h1", "h2", "h3", "h4", "h5", "h6", "header", "hgroup", "hr", "html", "li", "main", "menu", "nav", "ol", "p", "pre", "section", "summary", "table", "tbody", "td", "tfoot", "th", "thead", "tr", "ul"}
_ENDS = {"li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "tbody": ({"thead", "tbody", "tfoot", "tr", "td", "th"}, {"table"}), "tfoot": ({"thead", "tbody", "tr", "td", "th"}, {"table"}), "option": ({"option"}, {"select"})}
_TAG_POINTS = {"div": 5, "article": 10, "main": 10, "section": 5, "pre": 3, "td": 3, "blockquote": 3, "address": -3, "ol": -3, "ul": -3, "dl": -3, "dd": -3, "dt": -3, "li": -3, "h1": -5, "h2": -5, "h3": -5, "h4": -5, "h5": -5, "h6": -5, "th": -5}
_PARAGRAPH, _CONTAINER = {"p", "pre", "td", "blockquote"}, {"div", "section", "article", "main", "body", "center", "figure", "dd", "li"}
_COMMA, _END = re.compile("[,،、，]"), re.compile(r"[.!?](?:\s|$)")


class Page:
    """The tree of a page: elements in the order of their start tags, and runs of text with their element."""

    def __init__(self, html: str):
        self.tag, self.parent, self.last, self.marks, self.title = ["#"], [0], [0], [""], ""
        self.runs: list[tuple[int, str | None]] = []  # None is a line's end
        self.open: Counter[str] = Counter()
        self.beyond: Counter[str] = Counter()  # open elements below DEPTH
        stack, at, n, start = [0], 0, len(html), 0
        while True:
            at = html.find("<", at)
            if at < 0:
                break
            if html.startswith("<!--", at):
                end = html.find("-->", at + 4)
                end = n if end < 0 else end + 3
                name = ""
            elif html[at + 1 : at + 2] in ("!", "?") and html.find(">", at) > 0:
                end, name = html.find(">", at) + 1, ""
            else:
                m = _TAG.match(html, at)
                if not m and html[at + 1 : at + 3].strip("/")[:1].isalpha() and html.find(">", at) > 0:  # a quote that doesn't end
                    m = _TAG.match(html[at : html.find(">", at) + 1].translate({34: None, 39: None}))
                    end = html.find(">", at) + 1
                elif m:
                    end = m.end()
                if not m:
                    at += 1
                    if html.find(">", at) < 0:
                        break
                    continue
                name = m[2].lower()
            if at > start:
                self.runs.append((stack[-1], html[start:at]))
            at = start = end
            if not name:
                continue
            if m[1]:
                self._close(stack, name)
                continue
            if name in _RAW:
                end = re.compile(rf"</{re.escape(name)}(?=[\s/>])[^>]*>", re.I).search(html, at) if name != "plaintext" else None
                if name == "title" and not self.title:
                    self.title = " ".join(unescape(html[at : end.start() if end else n]).split())
                at = start = end.end() if end else n
                continue
            if name in _BLOCK:
                self._end(stack, {"p"}, {"td", "th", "table", "button", "body", "html"})
            if name in _ENDS:
                self._end(stack, *_ENDS[name])
            if name == "br":
                self.runs.append((stack[-1], None))
            self.tag.append(name)
            self.parent.append(stack[-1])
            self.last.append(len(self.tag) - 1)
            self.marks.append(" ".join("".join(x) for x in _ATTRIBUTE.findall(m[3])) if m[3] else "")
            if name in _VOID or m[3].endswith("/") and name not in _BLOCK:
                continue
            if len(stack) >= DEPTH:
                self.beyond[name] += 1
                continue
            stack.append(len(self.tag) - 1)
            self.open[name] += 1
        if start < n:
            self.runs.append((stack[-1], html[start:]))
        self._pop(stack, 0)

    def _pop(self, stack: list[int], to: int) -> None:
        if len(stack) > to and self.beyond:
            self.beyond.clear()
        while len(stack) > to:
            k = stack.pop()
            self.last[k] = len(self.tag) - 1
            self.open[self.tag[k]] -= 1

    def _close(self, stack: list[int], name: str) -> None:
        if self.beyond[name]:
            self.beyond[name] -= 1
            return
        if not self.open[name]:
            return
        for k in range(len(stack) - 1, 0, -1):
            if self.tag[stack[k]] == name:
                self._pop(stack, k)
                return
            if self.tag[stack[k]] in ("td", "th", "table") and name not in ("table", "tr", "tbody", "thead", "tfoot", "td", "th", "body", "html"):
                return

    def _end(self, stack: list[int], ended: set[str], bounds: set[str]) -> None:
        """End the outermost of the given elements that is open inside the nearest bound."""
        if not any(self.open[x] for x in ended):
            return
        cut = None
        for k in range(len(stack) - 1, 0, -1):
            if self.tag[stack[k]] in bounds:
                break
            if self.tag[stack[k]] in ended:
                cut = k
        if cut is not None:
            self._pop(stack, cut)


def extract(html: str | None) -> tuple[str | None, str | None, float]:
    """(title, text, score of the best container); nulls and 0 for null."""
    if html is None:
        return None, None, 0.0
    page = Page(html)
    tries = []
    for strict in (2, 1, 0):
        text, best, scored = _read(page, strict)
        if scored:
            return page.title or None, text, best
        tries.append(text)
        if strict == 2 and not any(t and t in page.tag for t in _DROPPED) and not any(page.marks):
            break  # nothing was left out
    return page.title or None, next((t for t in tries if t), ""), 0.0


def _read(page: Page, strict: int) -> tuple[str, float, bool]:
    """(text, score of the best container, whether there is any), without the elements that strict is against."""
    tag, parent, n = page.tag, page.parent, len(page.tag)
    dropped = (set(), _DROPPED - {"form"}, _DROPPED)[strict]
    out = [False] * n  # inside something that is left out
    link = [False] * n
    for k in range(1, n):
        up = parent[k]
        marks = page.marks[k] if strict == 2 else ""
        against = marks and tag[k] not in ("body", "html", "a") and _UNLIKELY.search(marks) and not _LIKELY.search(marks)
        out[k] = out[up] or tag[k] in dropped or bool(against)
        link[k] = link[up] or tag[k] == "a"
    runs = []
    length, commas, linked = [0] * n, [0] * n, [0] * n
    blocks, ends = [False] * n, [False] * n
    for k, raw in page.runs:
        if out[k]:
            continue
        if raw is None:
            runs.append((k, None))
            continue
        text = unescape(raw) if "&" in raw else raw
        size = len(" ".join(text.split()))
        runs.append((k, text))
        if size:
            length[k] += size
            commas[k] += len(_COMMA.findall(text))
            ends[k] = ends[k] or _END.search(text) is not None
            if link[k]:
                linked[k] += size
    for k in range(n - 1, 0, -1):
        up = parent[k]
        length[up] += length[k]
        commas[up] += commas[k]
        linked[up] += linked[k]
        ends[up] = ends[up] or ends[k]
        if tag[k] in _BLOCK and not out[k]:
            blocks[up] = True
        elif blocks[k] and not out[k]:
            blocks[up] = True
    inline = [tag[k] not in _BLOCK for k in range(n)]
    points: dict[int, float] = {}
    for k in range(1, n):
        if out[k] or length[k] < LEAST or not (tag[k] in _PARAGRAPH or tag[k] in _CONTAINER and not blocks[k]):
            continue
        worth, up, level = 1 + commas[k] + min(length[k] // 100, 3), parent[k], 0
        while up and level < LEVELS:
            if not inline[up]:
                if up not in points:
                    points[up] = _TAG_POINTS.get(tag[up], 0) + (25 if page.marks[up] and _LIKELY.search(page.marks[up]) else 0)
                points[up] += worth / (1 if level == 0 else 2 if level == 1 else 3 * level)
                level += 1
            up = parent[up]
    score = {k: x * (1 - linked[k] / length[k]) for k, x in points.items() if length[k]}
    if not score:  # no paragraph below anything: what there is of the page
        kept, best = [0], 0.0
    else:
        top = min(score, key=lambda k: (-score[k], k))
        best, kept = score[top], []
        for k in range(1, n):
            if parent[k] != parent[top] or out[k] or k == 0:
                continue
            density = linked[k] / length[k] if length[k] else 0.0
            bonus = best * 0.2 if page.marks[k] and page.marks[k] == page.marks[top] else 0.0
            prose = tag[k] == "p" and (length[k] > 80 and density < 0.25 or 0 < length[k] <= 80 and density == 0 and ends[k])
            if k == top or k in score and score[k] + bonus >= max(10.0, best * 0.2) or prose:
                kept.append(k)
    return _text(page, runs, kept), best, bool(score)


def _text(page: Page, runs: list[tuple[int, str | None]], kept: list[int]) -> str:
    """The text of the kept elements, a line for each block."""
    inside, depth = [0] * (len(page.tag) + 1), 0
    for k in kept:
        inside[k] += 1
        inside[page.last[k] + 1] -= 1
    for k in range(len(page.tag)):
        depth += inside[k]
        inside[k] = depth
    lines, line, block = [], [], None
    home: dict[int, int] = {}

    def block_of(k: int) -> int:
        way = []
        while k and k not in home and page.tag[k] not in _BLOCK:
            way.append(k)
            k = page.parent[k]
        k = home.get(k, k)
        for x in way:
            home[x] = k
        return k

    for k, text in runs:
        if not inside[k]:
            continue
        own = block_of(k)
        if (own != block or text is None) and line:
            lines.append(" ".join("".join(line).split()))
            line = []
        block = own
        if text is not None:
            line.append(text)
    lines.append(" ".join("".join(line).split()))
    return "\n".join(x for x in lines if x)


def _run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = [extract(h.as_py()) for h in batch.column(1)]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([f[0] for f in found], pa.string()), pa.array([f[1] for f in found], pa.string()), pa.array([f[2] for f in found], pa.float64())], names=["page_id", "title", "text", "score"])


def extract_pages(pages: DataFrame, id_col: str = "page_id", html_col: str = "html") -> DataFrame:
    """(page_id, title, text, score) for every row of pages, in place: nothing is shuffled.

    Null pages have null title and text, pages without a title a null title, and empty pages an empty text. A page
    without any paragraph long enough gives all its text outside what is left out (or, if there is none, all its
    text), with score 0. Ties between containers go to the one that starts first. Ids keep their type; repeated rows, and
    rows without an id, get rows of their own. Long pages are read whole, in time that grows with their length. An
    empty table gives an empty result. Other columns are never looked at, whatever their names.
    """
    rows = pages.select(col(id_col).alias("i"), col(html_col).cast("string").alias("h"))
    return rows.mapInArrow(_run, f"page_id {kind(pages, id_col)}, title string, text string, score double")
