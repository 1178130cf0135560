"""HTML extraction (operator 7): text-to-tag ratios, Gaussian smoothing, clustering.

The standard library's parser streams events over the whole page.  Text between
two block boundaries is a *line*; a line's ratio is its characters over the tags
met since the line before.  Lines inside boilerplate elements (by tag, role, or a
word of ``class`` or ``id``) stay in the sequence with ratio 0.  The ratios are
smoothed with a Gaussian over neighbouring lines; lines above the standard
deviation of the smoothed ratios (the threshold) form the content cluster.

Lines belong to containers (article, main, section, division, list, table cell
...).  If the cluster has a line in an article, every outermost article of the page
is content; else, if in a main element, those; else the smallest container around
the cluster, after strays (single lines in a block of their own beside a block that
holds most of the cluster's text) are left out.  Every line of a region is kept,
in containers at any depth.  Boilerplate is left out; inside an article, names that
its sections may have too count only in a class or id without other words, and some
only where the text is thin or mostly links.  Lists of links are left out where they
are not in an article or main element.

Character references are decoded, white space inside a line becomes one space,
and lines are joined by one space.  Row-local: there is no shuffle; memory is one
batch of pages and one page's lines.

Defined cases: a null, empty or blank page, and one that is all boilerplate, has
the empty text.  Unclosed and stray tags are tolerated.  Repeated rows get equal
texts.  A null ``page_id`` or ``url`` is passed through.  Extra columns are
ignored.  An empty table gives an empty result.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import DataFrame

SIGMA = 1.0
RADIUS = 2
LINK_SHARE = 0.5

# Fixed values of HTML.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCK = frozenset("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset "
                  "figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup html legend li main menu nav ol "
                  "option p pre search section select summary table tbody td template textarea tfoot th thead tr ul".split())
BREAKS = frozenset(["br", "hr"])
CONTAINERS = frozenset("article aside blockquote body dialog div dl fieldset figure footer form header main menu nav ol "
                       "search section table td template th ul".split())
# Tags an opening tag closes when they are still open.
IMPLIED_END = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"},
               "th": {"td", "th"}, "option": {"option"}}
# Boilerplate by tag, by role and by a word of class or id.
SKIPPED = frozenset("aside button dialog footer form head iframe menu nav noscript object script search select style "
                    "svg template textarea title".split())
SKIPPED_ROLES = frozenset("alert alertdialog banner complementary contentinfo dialog menu menubar navigation "
                          "search toolbar".split())
SKIPPED_NAMES = frozenset("ad ads adsense advert advertisement advertising adverts aside banner breadcrumb breadcrumbs "
                          "comment commentlist comments consent cookie cookies copyright disclaimer disqus footer gdpr "
                          "hidden legal login masthead menu modal nav navbar navigation newsletter notice notices "
                          "overlay pager pagination popup promo promotion recommended related replies reply respond "
                          "share sharing sidebar signup skip social sponsor sponsored subscribe subscription toolbar "
                          "widget widgets".split())
# Of these, names that an article's own sections may have too: inside an article they
# only count where the text is thin or mostly links.
WEAK_NAMES = frozenset("ad ads aside banner copyright disclaimer hidden legal login menu notice notices overlay popup promo "
                       "promotion recommended related share sharing skip social toolbar widget widgets".split())
# Words of a compound class or id beside which such a name keeps its meaning.
PLAIN_NAMES = frozenset("area bar block body bottom box button buttons container content footer group header icon icons inner item items "
                        "left link links list main media outer page panel post right row section site slot text thread title "
                        "top unit wrap wrapper".split())
THIN_CHARS = 120
DOMINANT_SHARE = 0.7
# Boilerplate only outside an article or main element.
PAGE_HEADERS = frozenset(["header"])

_NAME = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
_WEIGHTS = [math.exp(-0.5 * (d / SIGMA) ** 2) for d in range(-RADIUS, RADIUS + 1)]


class _Region:
    __slots__ = ("parent", "boilerplate", "article", "top", "suspect", "chars", "link_chars", "content")

    def __init__(self, parent: "_Region | None", boilerplate: bool, article: bool, top: str = "", suspect: bool = False):
        self.parent, self.boilerplate, self.article, self.top, self.suspect = parent, boilerplate, article, top, suspect
        self.chars = self.link_chars = 0
        self.content = False


class PageLines(HTMLParser):
    """Collects the lines of a page and the region of each."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        root = _Region(None, False, False)
        self.regions = [root]
        self.open: list[tuple[str, _Region]] = [("", root)]
        self.lines: list[tuple[str, int, _Region]] = []
        self.text: list[str] = []
        self.tags = self.links = 0

    def end_line(self) -> None:
        if self.text:
            line = " ".join("".join(self.text).split())
            self.text = []
            if line:
                self.lines.append((line, self.tags, self.open[-1][1]))
                self.tags = 0

    def _boilerplate(self, tag: str, attrs: list, region: _Region) -> bool | None:
        """None: only if the text turns out thin or mostly links."""
        if tag in SKIPPED or (tag in PAGE_HEADERS and not region.article):
            return True
        weak = False
        for key, value in attrs:
            if key in ("class", "id") and value:
                if region.article:
                    found = set().union(*map(_article_names, value.split()))
                    if found - WEAK_NAMES:
                        return True
                    weak = weak or bool(found)
                    continue
                names = {w.lower() for w in _NAME.findall(value)}
                if names & SKIPPED_NAMES or (names & PAGE_HEADERS and tag != "body"):
                    return tag not in ("html", "body", "main")
            elif key == "role" and value and value.lower() in SKIPPED_ROLES:
                return True
            elif key == "hidden" or (key == "aria-hidden" and value == "true"):
                return True
            elif key == "style" and value and re.search(r"display\s*:\s*none", value):
                return True
        return None if weak else False

    def handle_starttag(self, tag: str, attrs: list) -> None:
        self.tags += 1
        if tag in BREAKS:
            self.end_line()
        if tag in VOID:
            return
        if tag == "a":
            self.links += 1
        block = tag in BLOCK
        if block:
            self.end_line()
            while len(self.open) > 1 and (self.open[-1][0] == "p" or self.open[-1][0] in IMPLIED_END.get(tag, ())):
                self.open.pop()
        region = self.open[-1][1]
        drop = region.boilerplate or self._boilerplate(tag, attrs, region)
        suspect, drop = drop is None, bool(drop)
        if (drop or suspect) and not region.boilerplate and not block:
            self.end_line()
        if block or drop or suspect:
            if tag in CONTAINERS or suspect or drop != region.boilerplate:
                top = tag if tag in ("article", "main") else ""
                region = _Region(region, drop, region.article or bool(top), top, suspect)
                self.regions.append(region)
            self.open.append((tag, region))

    def handle_startendtag(self, tag: str, attrs: list) -> None:
        self.handle_starttag(tag, attrs)
        if tag not in VOID:
            self.handle_endtag(tag)

    def handle_endtag(self, tag: str) -> None:
        self.tags += 1
        if tag == "a":
            self.links = max(0, self.links - 1)
        for at in range(len(self.open) - 1, 0, -1):
            if self.open[at][0] == tag:
                self.end_line()
                del self.open[at:]
                return
        if tag in BLOCK:
            self.end_line()

    def handle_data(self, data: str) -> None:
        region = self.open[-1][1]
        n = len(data)
        region.chars += n
        if self.links:
            region.link_chars += n
        self.text.append(data)


def _article_names(name: str) -> set[str]:
    """The boilerplate words of one class or id of an element inside an article, if all
    its other words are plain ones (not ``social-history`` or ``share-prices``)."""
    names = {w.lower() for w in _NAME.findall(name)}
    found = names & SKIPPED_NAMES
    return found if names <= SKIPPED_NAMES | PLAIN_NAMES else set()


def settle_suspects(regions: list[_Region]) -> None:
    """Suspect regions that are thin or mostly links, with all inside them, are boilerplate."""
    held = {id(r): [r.chars, r.link_chars] for r in regions}
    for r in reversed(regions):  # parents come before the regions inside them
        if r.parent is not None:
            for k, n in enumerate(held[id(r)]):
                held[id(r.parent)][k] += n
    for r in regions:
        chars, links = held[id(r)]
        if r.parent is not None and r.parent.boilerplate or r.suspect and (chars < THIN_CHARS or links > LINK_SHARE * chars):
            r.boilerplate = True


def articles(regions: list[_Region], cluster: list[_Region]) -> list[_Region]:
    """Every outermost article element if the cluster has a line in one; else the outermost
    main elements with such a line; else none."""
    def outer(r: _Region | None, top: str) -> _Region | None:
        out = None
        while r is not None:
            out = r if r.top == top else out
            r = r.parent
        return out

    if any(outer(r, "article") for r in cluster):
        return [r for r in regions if r.top == "article" and not r.boilerplate and outer(r.parent, "article") is None]
    return list(dict.fromkeys(m for r in cluster if (m := outer(r, "main"))))


def main_region(cluster: list[tuple[str, _Region]], lines: list[tuple[str, int, _Region]]) -> _Region:
    """The smallest region around the cluster, after leaving out strays: single lines in a
    block of their own beside a block that holds most of the cluster's text."""
    while True:
        around = common_ancestor([r for _, r in cluster])

        def branch(r: _Region) -> _Region | None:
            while r is not around and r.parent is not around:
                r = r.parent
            return r if r is not around else None

        text: dict[int, int] = {}
        for t, r in cluster:
            text[id(branch(r))] = text.get(id(branch(r)), 0) + len(t)
        most = max(text, key=text.get)
        if most == id(None) or len(text) < 2 or text[most] < DOMINANT_SHARE * sum(text.values()):
            return around
        inside: dict[int, int] = {}
        for _, _, r in lines:
            up = r
            while up is not None and up is not around:
                up = up.parent
            if up is around:
                inside[id(branch(r))] = inside.get(id(branch(r)), 0) + 1
        if any(b != most and (b == id(None) or inside[b] > 1) for b in text):
            return around
        cluster = [(t, r) for t, r in cluster if id(branch(r)) == most]


def common_ancestor(regions: list[_Region]) -> _Region:
    """The smallest region that holds all of ``regions``."""
    def path(r: _Region | None) -> list[_Region]:
        out = []
        while r is not None:
            out.append(r)
            r = r.parent
        return out[::-1]

    common = path(regions[0])
    for r in regions[1:]:
        if r is not regions[0]:
            common = [x for x, y in zip(common, path(r)) if x is y]
    return common[-1]


def smooth(values: list[float]) -> list[float]:
    out = []
    for i in range(len(values)):
        total = weight = 0.0
        for d, w in zip(range(-RADIUS, RADIUS + 1), _WEIGHTS):
            if 0 <= i + d < len(values):
                total += w * values[i + d]
                weight += w
        out.append(total / weight)
    return out


def extract(html: str | None) -> str:
    """The main text of a page."""
    page = PageLines()
    page.feed(html or "")
    page.close()
    page.end_line()
    lines = page.lines
    if not lines:
        return ""
    settle_suspects(page.regions)
    ratios = smooth([0.0 if r.boilerplate else len(t) / max(1, n) for t, n, r in lines])
    mean = sum(ratios) / len(ratios)
    threshold = math.sqrt(sum((x - mean) ** 2 for x in ratios) / len(ratios))
    # an article's lists of links are part of it, others are menus
    plain = [not r.boilerplate and (r.article or r.link_chars <= LINK_SHARE * r.chars) for _, _, r in lines]
    own = [x for x, p in zip(ratios, plain) if p]
    if not own:
        return ""
    threshold = min(threshold, max(own))
    cluster = [(t, r) for x, p, (t, _, r) in zip(ratios, plain, lines) if x >= threshold and p]
    for r in articles(page.regions, [r for _, r in cluster]) or [main_region(cluster, lines)]:
        r.content = True
    for r in page.regions:  # parents come before the regions inside them
        if r.parent is not None and r.parent.content and not r.boilerplate:
            r.content = True
    return " ".join(t for (t, _, r), p in zip(lines, plain) if r.content and p)


def _extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        texts = [extract(h.as_py()) for h in b.column("html")]
        yield pa.RecordBatch.from_arrays(
            [b.column("page_id"), b.column("url"), pa.array(texts, pa.string()),
             pa.array([len(t) for t in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"])


def main_texts(pages: DataFrame) -> DataFrame:
    """Per row: page_id, url, text, n_chars."""
    kind = dict(pages.dtypes)["page_id"]
    return pages.select("page_id", "url", "html").mapInArrow(
        _extract, f"page_id {kind}, url string, text string, n_chars bigint")
