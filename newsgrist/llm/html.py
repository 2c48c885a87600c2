"""Main text of web pages by line-block distribution.

A page becomes lines, one for each block of text, without scripts, menus and other parts
that its markup names as such. Text lengths are summed over sliding windows of lines; the
text lies between the first line where the sum surges and the last before it dives.
"""

from __future__ import annotations

import html
import re
from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from newsgrist.llm.common import small_batches

# Lines in a window, and the share of the largest window sum from which a page without a
# marked article surges; a marked one surges with its first text.
WINDOW = 3
SURGE = 0.15
SURGE_MOST = 80

_TOKEN = re.compile(
    r"""<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)
    |<(?P<end>/?)(?P<name>[a-zA-Z][^\s/>]*)(?P<attributes>(?>[^>"']|"[^"]*"|'[^']*'|["'])*+)(?:>|\Z)""",
    re.S | re.X,
)
_ATTRIBUTE = re.compile(r"""([a-zA-Z-]+)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""")
_RAW = {"script", "style", "textarea", "title", "iframe", "xmp", "noembed", "noframes"}
_SKIPPED = _RAW | {
    "head", "nav", "header", "footer", "aside", "form", "noscript", "template", "svg", "math",
    "button", "select", "dialog", "menu", "object", "canvas", "audio", "video", "map",
}
_BLOCKS = {
    "address", "article", "aside", "blockquote", "body", "br", "caption", "center", "dd",
    "details", "dialog", "dir", "div", "dl", "dt", "fieldset", "figcaption", "figure",
    "footer", "form", "h1", "h2", "h3", "h4", "h5", "h6", "head", "header", "hgroup", "hr",
    "html", "legend", "li", "main", "menu", "nav", "ol", "optgroup", "option", "p", "pre",
    "section", "summary", "table", "tbody", "td", "tfoot", "th", "thead", "title", "tr", "ul",
}
_HEADINGS = {"h1", "h2", "h3", "h4", "h5", "h6"}
# Where end tags may be left out: a start tag ends the open elements of ``_ENDS[name]`` that
# are not beyond one of ``_BOUNDS[name]``.
_ENDS_P = {
    "address", "article", "aside", "blockquote", "center", "dd", "details", "dialog", "dir", "div", "dl", "dt", "fieldset",
    "figcaption", "figure", "footer", "form", "header", "hgroup", "hr", "li", "main", "menu", "nav", "ol", "p", "pre",
    "section", "summary", "table", "ul",
} | _HEADINGS
_CELLS = {"td", "th", "caption"}
_ROWS = {"tr"} | _CELLS
_GROUPS = {"tbody", "thead", "tfoot"} | _ROWS
_ENDS = {
    "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "td": _CELLS, "th": _CELLS, "tr": _ROWS,
    "tbody": _GROUPS, "thead": _GROUPS, "tfoot": _GROUPS, "option": {"option"}, "optgroup": {"option", "optgroup"},
}
_BOUNDS = {
    name: ends | {"table"} if ends & _CELLS else {"select"} if "option" in ends else _BLOCKS - {"address", "div", "p"} - ends
    for name, ends in _ENDS.items()
}
_P_BOUNDS = _SKIPPED | _CELLS | {"table"}
# End tags of these also end what was left open in a table; others stay inside their cell.
_SECTIONS = {"article", "main", "section", "body", "html", "header", "footer", "nav", "aside"}
_IN_HEAD = _RAW | {"base", "basefont", "bgsound", "link", "meta", "noscript", "template", "object"}
_VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
# Words in class, id and role that name a part which is not the article.
_SIDE_WORDS = re.compile(
    r"(?:^|[\s_-])(?:ads?|ad(?:box|sense|sbygoogle|slot|unit|wrap|block|banner)|advert\w*|banner|sponsor\w*|promo\w*|"
    r"cookies?|consent|gdpr|notices?|disclaimer|legal|privacy|discussion|"
    r"alerts?|popups?|modal|overlay|comments?|commentlist|disqus|replies|respond|responses|sidebars?|side|"
    r"aside|widgets?|nav|navbar|navigation|menus?|breadcrumbs?|header|masthead|topbar|footer|foot|footnotes?bar|"
    r"copyright|share|sharing|social|related|recommend\w*|newsletter|subscribe|signup|login|search|"
    r"pagination|pager|tags|toolbar|skip|contentinfo|complementary|hidden|sr-only)(?=$|[\s_-])",
    re.I,
)
# Inside an article only words of adverts, comments and sharing count, and roles that stand
# for elements which are left out: other words also name parts of its text.
_SIDE_IN_ARTICLE = re.compile(
    r"(?:^|[\s_-])(?:ads?|ad(?:box|sense|sbygoogle|slot|unit|wrap|block|banner)|advert\w*|sponsor(?:s|ed|ship)?|promos?|promoted|"
    r"comments?|commentlist|disqus|replies|share(?![_-](?:price|holder|index|value))|sharing|sharethis|addthis|"
    r"social[_-](?:links?|buttons?|icons?|bar)|cookies?[_-](?:notice|banner|bar|consent))(?=$|[\s_-])",
    re.I,
)
_SIDE_ROLES = {"navigation", "search", "complementary", "contentinfo", "dialog", "alertdialog", "menu", "menubar", "toolbar"}
_TITLED = re.compile(r"(?:\s|<!--.*?-->|<(?:div|header|hgroup)\b[^>]*>)*+<h[1-6]\b", re.I | re.S)
# Names that only speak of such a part, and those of an article's own heading.
_NOT_SIDE = re.compile(
    r"\b(?:has|with|no|without|is)[-_][\w-]+|\b(?:article|entry|post|story|content)[-_](?:header|heading|title)\b", re.I
)
_HIDDEN = re.compile(r"\bhidden\b|aria-hidden\s*=\s*[\"']?true|display\s*:\s*none|visibility\s*:\s*hidden", re.I)
_MAIN_WORDS = re.compile(
    r"(?:^|[\s_-])(?:article|articlebody|post|entry|story|content|main|body|text)(?=$|[\s_-])", re.I
)


@dataclass(slots=True)
class Line:
    text: str
    linked: int  # characters inside links
    main: int  # 2 inside an article, 1 inside another main part, 0 elsewhere
    part: int = 0  # number of the outermost main part around it that is no article
    heading: bool = False


def _values(attributes: str) -> dict[str, str]:
    return {m[1].lower(): m[2] or m[3] or m[4] or "" for m in _ATTRIBUTE.finditer(attributes)}


def _words(found: dict[str, str], *keys: str) -> str:
    names = " ".join(found.get(k, "") for k in keys)
    # camelCase is read as camel-Case
    return _NOT_SIDE.sub(" ", re.sub("(?<=[a-z])(?=[A-Z])", "-", names)).strip()


def _side_in_article(name: str, attributes: str, page: str, at: int) -> bool:
    """Whether a part of an article is no text of it. Its id and label count only if it is a
    plain container without a title."""
    found = _values(attributes)
    if _SIDE_IN_ARTICLE.search(_words(found, "class", "role")) or _SIDE_ROLES & set(found.get("role", "").lower().split()):
        return True
    if name not in ("div", "section", "ul", "ol", "span") or not _SIDE_IN_ARTICLE.search(_words(found, "id", "aria-label")):
        return False
    return "aria-labelledby" not in found and not _TITLED.match(page, at)


def _names(attributes: str) -> tuple[str, bool]:
    """Class, id, role and label as one string, and whether the element is hidden."""
    if "=" not in attributes and "hidden" not in attributes:
        return "", False
    found = _values(attributes)
    bare = _ATTRIBUTE.sub(" ", attributes)
    hidden = bool(
        re.search(r"(?:^|\s)hidden(?:\s|/|$)", bare)
        or found.get("aria-hidden") == "true"
        or _HIDDEN.search("style:" + found.get("style", "")) and "style" in found
    )
    return _words(found, "class", "id", "role", "aria-label"), hidden


class _Open:
    """Names of the open elements, outermost first."""

    def __init__(self) -> None:
        self.names: list[str] = []
        self.counts: Counter[str] = Counter()

    def push(self, name: str) -> None:
        self.names.append(name)
        self.counts[name] += 1

    def cut(self, size: int) -> None:
        for name in self.names[size:]:
            self.counts[name] -= 1
        del self.names[size:]

    def _innermost(self, names: set[str], bounds: set[str]) -> int | None:
        if not any(self.counts[n] for n in names):
            return None
        for k in range(len(self.names) - 1, -1, -1):
            if self.names[k] in names:
                return k
            if self.names[k] in bounds:
                return None
        return None

    def start(self, name: str) -> None:
        """Close what a start tag of this name ends without an end tag."""
        if name in _ENDS_P and (k := self._innermost({"p"}, _P_BOUNDS)) is not None:
            self.cut(k)
        while name in _ENDS and (k := self._innermost(_ENDS[name], _BOUNDS[name] - _ENDS[name])) is not None:
            self.cut(k)

    def end(self, name: str) -> int | None:
        """Close the innermost element of this name and, if it is a block, all inside it;
        its place, or null if there is none."""
        if name not in _BLOCKS and name not in _SKIPPED:
            k = self._innermost({name}, set())
            if k is not None:
                inner = self.names[k + 1 :]
                self.cut(k)
                if any(n in _BLOCKS for n in inner):  # blocks that reach beyond it stay open
                    for n in inner:
                        self.push(n)
            return k
        if name in _SECTIONS:
            bounds: set[str] = set()
        elif name in _GROUPS or name == "table":
            bounds = {"table"}
        elif name == "li":
            bounds = _CELLS | {"table", "ul", "ol", "menu", "dir"}
        else:
            bounds = _CELLS | {"table"} | ({"dl"} if name in ("dt", "dd") else set())
        k = self._innermost({name}, bounds)
        if k is not None:
            self.cut(k)
        return k


def lines_of(page: str) -> list[Line]:
    """Lines of a page in its order, without what its markup sets aside.

    A part that is set aside ends with its own end tag, with a start tag that implies this
    end, or with the end of an element around it. One that never closes ends where the
    article begins.
    """
    out: list[Line] = []
    parts: list[str] = []
    linked, heading = 0, False
    links = 0
    open_ = _Open()
    skipped, skipped_at = "", 0  # name of the part being left out, and its place in ``open_``
    skipped_by_name = False
    # Open elements that mark the main part: (name, kind, open tags of that name inside, number).
    marks: list[list] = []
    n_marks = 0
    seen_article = False

    def flush() -> None:
        nonlocal linked, heading
        text = " ".join("".join(parts).split())
        if text:
            part = next((m[3] for m in marks if m[1] == 1), 0)
            out.append(Line(text, linked, max((m[1] for m in marks), default=0), part, heading))
        parts.clear()
        linked, heading = 0, False

    at, size = 0, len(page)
    while at < size:
        token = _TOKEN.search(page, at)
        text = page[at : token.start() if token else size]
        if text and not skipped:
            text = html.unescape(text) if "&" in text else text
            parts.append(text)
            heading = heading or not text.isspace() and any(open_.counts[h] for h in _HEADINGS)
            if links:
                linked += len(text.strip())
        if not token:
            break
        at = token.end()
        name = token["name"]
        if name is None:
            continue
        name = name.lower()
        if token["end"]:
            if skipped:
                inline = name not in _BLOCKS and name not in _SKIPPED
                if inline and name not in open_.names[skipped_at:]:
                    continue  # text signs around the part do not end it
                k = open_.end(name)
                if k is None or k > skipped_at:
                    continue
                skipped = ""
                if k == skipped_at:
                    continue
            else:
                open_.end(name)
            if name in _BLOCKS:
                flush()
            if name == "a":
                links = max(0, links - 1)
            for k in range(len(marks) - 1, -1, -1):
                if marks[k][0] == name:
                    marks[k][2] -= 1
                    if not marks[k][2]:
                        del marks[k:]
                    break
            continue
        attributes = token["attributes"]
        if name in _RAW and not attributes.endswith("/"):
            close = re.compile(rf"</{name}[^>]*>", re.I).search(page, at)
            at = close.end() if close else size
            continue
        if name in _ENDS_P or name in _ENDS:
            open_.start(name)
            if skipped and len(open_.names) <= skipped_at:
                skipped = ""
        if skipped:
            opens_article = name in ("article", "main") and not seen_article and not _SIDE_WORDS.search(_names(attributes)[0])
            in_head = skipped == "head" and len(open_.names) == skipped_at + 1
            ends_head = skipped == "head" and name == "body" or in_head and name not in _IN_HEAD
            if not ends_head and not (opens_article and skipped_by_name):
                if name not in _VOID and not attributes.endswith("/"):
                    open_.push(name)
                continue
            open_.cut(skipped_at)
            skipped = ""
        if name in _BLOCKS:
            flush()
        if name in _VOID:
            continue
        names, hidden = _names(attributes)
        own_header = name == "header" and any(m[1] == 2 for m in marks)
        side = bool(names) and name not in ("html", "body") and bool(_SIDE_WORDS.search(names))
        if side and any(m[1] == 2 and m[0] not in ("html", "body") for m in marks):
            side = _side_in_article(name, attributes, page, at)
        if side and name in ("article", "main") and not re.search(r"comment|repl(?:y|ies)", names, re.I):
            side = False
        if (name in _SKIPPED and not own_header) or side or (hidden and name not in ("html", "body")):
            if not attributes.endswith("/"):
                skipped, skipped_at = name, len(open_.names)
                open_.push(name)
                skipped_by_name = name in ("div", "section", "aside", "header", "nav", "ul", "p", "span")
            continue
        if name == "a":
            links += 1
        if not attributes.endswith("/"):
            open_.push(name)
        for m in marks:
            m[2] += m[0] == name
        kind = 2 if name == "article" or "article" in names.lower().split() else 1 if name == "main" or _MAIN_WORDS.search(names) and name in ("div", "section", "td") else 0
        if kind:
            n_marks += 1
            marks.append([name, kind, 1, n_marks])
            seen_article = seen_article or kind == 2
    flush()
    return out


def window_sums(weights: list[int], window: int = WINDOW) -> list[int]:
    """Sum of the weights of each line and the ``window - 1`` after it."""
    total = [0]
    for w in weights:
        total.append(total[-1] + w)
    return [total[min(i + window, len(weights))] - total[i] for i in range(len(weights))]


def _leads(lines: list[Line]) -> list[int]:
    """Heading and lead: lines before the first article of a main part, in that part."""
    out: list[int] = []
    before: dict[int, list[int]] = defaultdict(list)
    done = {0}
    for i, line in enumerate(lines):
        if line.part in done:
            continue
        if line.main == 2:
            out += before.pop(line.part, [])
            done.add(line.part)
        elif line.heading or 2 * line.linked < len(line.text):
            before[line.part].append(i)
    return out


def main_text(page: str | None) -> str:
    """The text between surge and dive, blocks joined by a space; empty if there is none."""
    if not page:
        return ""
    lines = lines_of(page)
    region = max((line.main for line in lines), default=0)
    # Marks that do not hold most of the text outside links do not mark the article: a
    # teaser, a name.
    own = [max(0, len(x.text) - x.linked) for x in lines]
    while region and 2 * sum(n for n, x in zip(own, lines) if x.main >= region) < sum(own):
        region -= 1
    if region:
        weights = [len(x.text) if x.main >= region else 0 for x in lines]
        if region == 2:
            for i in _leads(lines):
                weights[i] = len(lines[i].text)
        level = 1
    else:
        weights = [len(x.text) if 2 * x.linked < len(x.text) else 0 for x in lines]
        level = max(1, min(SURGE_MOST, int(SURGE * max(window_sums(weights), default=0))))
    sums = window_sums(weights)
    high = [i for i, s in enumerate(sums) if s >= level]
    if not high:
        return ""
    # The window that surges ends in text; its own first line with weight is the start.
    start = high[0]
    while not weights[start]:
        start += 1
    end = high[-1]
    stop = end + WINDOW
    found = list(zip(lines[start:stop], weights[start:stop]))
    while not found[-1][1]:
        found.pop()
    # Outside the region lines are left out; of an unmarked page all between surge and dive
    # stay, lists of links too.
    return " ".join(x.text for x, w in found if w or not region)


def extract_text(pages: DataFrame) -> DataFrame:
    """``page_id, url, text, n_chars`` for every row of ``pages``.

    ``text`` is empty for a null or empty page and one without an article; ``n_chars``
    counts its code points. Null ids and urls and repeated rows pass through; other columns
    are ignored. Pages are taken whole, one at a time.
    """

    def extracted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches, "html"):
            texts = [main_text(page) for page in batch.column("html").to_pylist()]
            yield pa.record_batch(
                [
                    batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()),
                    pa.array([len(t) for t in texts], pa.int64()),
                ],
                ["page_id", "url", "text", "n_chars"],
            )

    rows = pages.select(F.col("page_id").cast("bigint").alias("page_id"), "url", "html")
    return rows.mapInArrow(extracted, "page_id bigint, url string, text string, n_chars bigint")
