"""Main text of web pages: parser events, text-to-tag ratio by line, Gaussian smoothing, threshold clustering.

The standard library's streaming parser turns a page into lines, one for each block element's run of text. Text inside
elements that never hold article text (navigation, headers of the page, footers, asides, forms, scripts, styles, ...),
or whose class, id or role names such a part, is dropped as it streams by. Each remaining line has its number of
characters and of tags; the ratio of the two, times MARKED in a marked article, is smoothed over neighbouring lines
with a Gaussian. The threshold, a share of the smoothed ratio's standard deviation, clusters the lines: those above it,
by their own ratio too, are seeds of content.

Regions grow from the seeds. Where seeds lie in marked articles (article, main or an itemprop), each such element is a
region. Elsewhere a region is the innermost element that holds most of the seeds' text; in it the plain blocks that
stand together with the seeds belong to the text, boxes only if their own ratio is above the threshold, or if
they lie between seeds. Boxes that are mostly links never do; lists and tables of links belong to the article they
are in.

Defined cases: a null or empty page, and one without text, give an empty text; unclosed and stray tags are
tolerated, a page cut off in the middle gives what precedes; ties with the threshold count as content; several marked
articles with seeds all count, in page order; repeated rows and null ids each give a row; an empty table gives no
rows; extra columns, also of the output's names, are ignored; pages of any length are read whole.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from dataclasses import dataclass
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import DataFrame

from graphspark.llm.common import plain, small_batches, texts_of

# HTML elements by their part in a page.
BLOCKS = frozenset("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav noscript ol p pre search section summary table tbody td tfoot th thead title tr ul".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
SKIPPED = frozenset("nav footer aside form script style noscript template head title iframe object svg canvas button select textarea menu dialog audio video map datalist".split())
HIDING = re.compile(r"(?:^|[\s_-])(?:ad|ads|advert|advertisement|adverts|banner|sponsor|sponsored|promo|nav|navbar|navigation|menu|breadcrumb|breadcrumbs|sidebar|side|footer|header|masthead|comment|comments|disqus|replies|notice|cookie|cookies|consent|popup|modal|newsletter|subscribe|signup|login|share|sharing|social|related|recommended|widget|toolbar|pagination|pager|skip|copyright|legal)(?:$|[\s_-])", re.I)
ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert menu menubar".split())
_SPACE = re.compile(r"\s+")


# Elements that hold one block of text each, lists and tables with their parts, and headings.
LEAVES = frozenset("p h1 h2 h3 h4 h5 h6 li dt dd td th tr caption pre blockquote figcaption legend hr summary".split())
LISTS = frozenset("ul ol dl table tbody thead tfoot".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: How much more a line's ratio counts inside a marked article.
MARKED = 4.0
#: An element is gone into while it holds this share of the seeds' text.
MOST = 0.9


@dataclass
class Line:
    text: str
    tags: int
    link_chars: int
    article: int  # number of the article it stands in, 0 for none
    path: tuple[tuple[int, str], ...]  # the open block elements, outermost first: number and name
    head: bool  # in a header outside any marked article
    wrapper: bool = False  # in a main part, but in no article in it

    @property
    def own_chars(self) -> int:
        return max(0, len(self.text) - self.link_chars)

    @property
    def linked(self) -> bool:
        return self.link_chars > 0.6 * len(self.text)


class Reader(HTMLParser):
    """Collects the lines of a page from the parser's events."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.lines: list[Line] = []
        self.open: list[tuple[str, bool, int, bool]] = []  # element, hidden by itself, article it opens, page header
        self.path: list[tuple[int, str]] = []
        self.hidden = self.tags = self.links = self.link_chars = self.articles = self.heads = self.blocks = 0
        self.inside: list[int] = []
        self.wrappers: set[int] = set()
        self.parts: list[str] = []

    def end_line(self) -> None:
        text = _SPACE.sub(" ", "".join(self.parts)).strip()
        if text:
            inside = self.inside[-1] if self.inside else 0
            wrapper = inside in self.wrappers
            self.lines.append(Line(text, self.tags, self.link_chars, inside, tuple(self.path), self.heads > 0, wrapper))
            self.tags = 0
        self.parts, self.link_chars = [], 0

    def _hides(self, tag: str, attrs: dict[str, str | None]) -> bool:
        if tag in SKIPPED:
            return True
        if tag in ("html", "body", "main", "article"):
            return False
        if "hidden" in attrs or (attrs.get("aria-hidden") or "").lower() == "true" or (attrs.get("role") or "").lower() in ROLES:
            return True
        return tag in BLOCKS and any(HIDING.search(re.sub("([a-z])([A-Z])", r"\1-\2", attrs.get(k) or "")) for k in ("class", "id"))

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        self.tags += 1
        if tag == "br":
            self.parts.append(" ")
            return
        if tag in BLOCKS:
            self.end_line()
            if tag in ("p", "li", "dd", "dt", "td", "th", "tr"):  # these end an open one of their kind
                self._close({"p": "p", "li": "li", "dd": "dd", "dt": "dt", "td": "td", "th": "th", "tr": "tr"}[tag], BLOCKS - {"p", "li", "dd", "dt", "td", "th", "tr", "html"})
        if tag in VOID:
            return
        given = dict(attrs)
        hides = self._hides(tag, given)
        opens = 0
        if not self.hidden and not hides and (tag in ("article", "main") or (given.get("role") or "").lower() == "main" or (given.get("itemprop") or "").lower() == "articlebody"):
            if not self.inside or tag == "article" and self.inside[-1] in self.wrappers:
                self.articles += 1
                if tag != "article":
                    self.wrappers.add(self.articles)
                self.inside.append(self.articles)
            else:
                self.inside.append(self.inside[-1])
            opens = self.inside[-1]
        head = tag == "header" and not self.inside  # an article's own header holds its headline
        self.hidden += hides
        self.heads += head
        self.links += tag == "a"
        self.open.append((tag, hides, opens, head))
        if tag in BLOCKS:
            self.blocks += 1
            self.path.append((self.blocks, tag))

    def handle_startendtag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        self.handle_starttag(tag, attrs)
        if tag not in VOID:
            self.handle_endtag(tag)

    def _close(self, tag: str, barriers: frozenset[str] = frozenset()) -> None:
        for k in range(len(self.open) - 1, -1, -1):
            if self.open[k][0] == tag:
                for name, hides, opens, head in self.open[k:]:
                    self.hidden -= hides
                    self.heads -= head
                    self.links -= name == "a"
                    if opens:
                        self.inside.pop()
                    if name in BLOCKS:
                        self.path.pop()
                del self.open[k:]
                return
            if self.open[k][0] in barriers:
                return

    def handle_endtag(self, tag: str) -> None:
        self.tags += 1
        if tag in BLOCKS:
            self.end_line()
        self._close(tag, BLOCKS if tag not in BLOCKS else frozenset())

    def handle_data(self, data: str) -> None:
        if not self.hidden:
            self.parts.append(data)
            if self.links:
                self.link_chars += len(data.strip())


def smoothed(values: list[float], sigma: float) -> list[float]:
    """Gaussian smoothing over neighbours; at the ends the weights are those of the values there."""
    reach = max(1, math.ceil(2 * sigma))
    kernel = [math.exp(-(d * d) / (2 * sigma * sigma)) for d in range(reach + 1)]
    out = []
    for i in range(len(values)):
        near = range(max(0, i - reach), min(len(values), i + reach + 1))
        out.append(sum(kernel[abs(i - j)] * values[j] for j in near) / sum(kernel[abs(i - j)] for j in near))
    return out


def seeds_of(lines: list[Line], sigma: float, share: float) -> tuple[list[bool], float]:
    """Which lines the threshold on the smoothed ratio marks as content, and the threshold."""
    own = [(MARKED if x.article else 1.0) * x.own_chars / max(1, x.tags) for x in lines]
    ratio = smoothed(own, sigma)
    mean = sum(ratio) / len(ratio)
    threshold = min(mean, share * math.sqrt(sum((r - mean) ** 2 for r in ratio) / len(ratio)))
    threshold = threshold if len(ratio) > 1 else 0.0
    found = [r >= threshold and o >= threshold and x.own_chars > 0 and not x.linked for x, r, o in zip(lines, ratio, own)]
    if not any(found):  # smoothing alone lifts lines over the threshold: take its own highest
        found = [r >= threshold and x.own_chars > 0 and not x.linked for x, r in zip(lines, ratio)]
    return found, threshold


def _container(lines: list[Line], seeds: list[bool]) -> int:
    """The depth of the innermost element that holds MOST of the seeds' text; lines outside it stop being seeds."""
    depth, live = 0, [i for i, s in enumerate(seeds) if s]
    while True:
        mass: dict[tuple[int, str], int] = {}
        for i in live:
            if depth < len(lines[i].path):
                mass[lines[i].path[depth]] = mass.get(lines[i].path[depth], 0) + lines[i].own_chars
        top = max(mass, key=lambda k: (mass[k], -k[0]), default=None)
        if top is None or top[1] in LEAVES or top[1] in LISTS or mass[top] < MOST * sum(lines[i].own_chars for i in live):
            return depth
        for i in live:
            seeds[i] = depth < len(lines[i].path) and lines[i].path[depth] == top
        live, depth = [i for i in live if seeds[i]], depth + 1


def _boxes(lines: list[Line], at: list[int], depth: int) -> list[list[int]]:
    """The lines `at`, cut into the children of the element at `depth - 1`."""
    out: list[list[int]] = []
    last = None
    for i in at:
        child = lines[i].path[depth] if depth < len(lines[i].path) else None
        if out and child is not None and child == last:
            out[-1].append(i)
        else:
            out.append([i])
        last = child
    return out


def _grown(lines: list[Line], seeds: list[bool], threshold: float) -> list[int]:
    """The lines of the region around the seeds outside of marked articles."""
    depth = _container(lines, seeds)
    live = [i for i, s in enumerate(seeds) if s]
    if not live:
        return []
    trunk = lines[live[0]].path[:depth]
    inner = depth > 0 and trunk[-1][1] not in ("body", "html")
    boxes = _boxes(lines, [i for i, x in enumerate(lines) if x.path[:depth] == trunk], depth)
    plain, good = [], []
    for box in boxes:
        first = lines[box[0]]
        tag = first.path[depth][1] if depth < len(first.path) else ""
        leaf = tag in LEAVES or not tag
        chars, links = sum(len(lines[i].text) for i in box), sum(lines[i].link_chars for i in box)
        ratio = sum(lines[i].own_chars for i in box) / max(1, sum(lines[i].tags for i in box))
        heads = first.head and not all(h[1] in HEADINGS for h in (lines[i].path[-1] for i in box))
        linked = links > 0.6 * chars
        plain.append((leaf or (inner and tag in LISTS)) and not heads and not (linked and not inner))
        good.append(not linked and not heads and any(seeds[i] for i in box) and (leaf or ratio >= threshold or tag in LISTS))
    at = [k for k, g in enumerate(good) if g] or [k for k, b in enumerate(boxes) if any(seeds[i] for i in b)]
    lo, hi = at[0], at[-1]
    while lo and plain[lo - 1]:
        lo -= 1
    while hi + 1 < len(boxes) and plain[hi + 1]:
        hi += 1
    kept = []
    for k in range(lo, hi + 1):
        chars, links = sum(len(lines[i].text) for i in boxes[k]), sum(lines[i].link_chars for i in boxes[k])
        if good[k] or plain[k] or links <= 0.3 * chars and not lines[boxes[k][0]].head:
            kept += boxes[k]
    return kept


def _of_article(lines: list[Line], number: int) -> list[int]:
    """The lines of a marked article, without its boxes that are mostly links and hold no list."""
    at = [i for i, x in enumerate(lines) if x.article == number]
    depth = min(len(lines[i].path) for i in at)
    while depth and any(lines[i].path[:depth] != lines[at[0]].path[:depth] for i in at):
        depth -= 1
    chars: dict[int, int] = {}
    links: dict[int, int] = {}
    lists: set[int] = set()
    for i in at:
        path = lines[i].path[depth:]
        listed = any(tag in LISTS for _, tag in path)
        for box, tag in path:
            if tag in LEAVES or tag in LISTS:
                break
            chars[box] = chars.get(box, 0) + len(lines[i].text)
            links[box] = links.get(box, 0) + lines[i].link_chars
            if listed:
                lists.add(box)
    dropped = {b for b in chars if links[b] > 0.6 * chars[b] and b not in lists}
    return [i for i in at if not any(b in dropped for b, _ in lines[i].path[depth:])]


def content(lines: list[Line], sigma: float = 1.0, share: float = 0.5) -> list[Line]:
    """The lines in content regions."""
    if not lines:
        return []
    seeds, threshold = seeds_of(lines, sigma, share)
    marked = sorted({x.article for x, s in zip(lines, seeds) if s and x.article})
    if marked:
        kept = sorted(i for number in marked for i in _of_article(lines, number))
        whole = {x.article for x in lines if x.wrapper}  # main parts around articles: only their headings count
        inner = any(lines[i].article not in whole for i in kept)
        return [lines[i] for i in kept if not (inner and lines[i].article in whole and lines[i].path[-1][1] not in HEADINGS)]
    return [lines[i] for i in _grown(lines, seeds, threshold)]


def page_lines(page: str) -> list[Line]:
    reader = Reader()
    reader.feed(page)
    reader.close()
    reader.end_line()
    return reader.lines


def main_text(page: str | None) -> str:
    """The page's main text: its blocks in page order, joined by line feeds."""
    return "\n".join(x.text for x in content(page_lines(page))) if page else ""


def extract(df: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """page_id, url, text and n_chars (code points) of each page."""
    small_batches(df.sparkSession)
    rows = plain(df, ("page_id", id_col), ("url", url_col), ("html", html_col))
    kind = rows.schema["page_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = [main_text(t) for t in texts_of(b, "html")]
            yield pa.RecordBatch.from_arrays([b.column("page_id"), b.column("url"), pa.array(out, pa.string()), pa.array(list(map(len, out)), pa.int64())], ["page_id", "url", "text", "n_chars"])

    return rows.mapInArrow(run, f"page_id {kind}, url string, text string, n_chars long")


