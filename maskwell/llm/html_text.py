"""Main text of web pages: parser events, text-to-tag ratios, smoothing, threshold."""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterator
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SIGMA = 1.5
DESCEND = 0.8
LINKED = 0.8
#: Clusters part a page's lines if their means differ by this factor; characters of a line that is a paragraph.
APART, PARAGRAPH = 3.0, 80

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements whose content is never main text.
DROPPED = frozenset(
    "script style noscript template head nav footer aside button select textarea iframe object svg canvas "
    "menu dialog audio video map datalist".split()
)
#: Elements whose content is main text only where they hold the page's paragraphs.
DOUBTFUL = frozenset(("form",))
HEADINGS = frozenset(("h1", "h2", "h3", "h4", "h5", "h6"))
#: Elements that end the running line at both of their tags.
BLOCKS = frozenset(
    "html body main article section div header p h1 h2 h3 h4 h5 h6 ul ol li dl dt dd blockquote pre table caption thead tbody "
    "tfoot tr figure figcaption hr address details summary fieldset legend hgroup center".split()
) | DROPPED | DOUBTFUL
#: Elements that an open p, li, ... ends at.
CLOSES_P = BLOCKS - frozenset("script style noscript template iframe object svg canvas button select textarea audio video map".split())
SIBLINGS = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th")}
SCOPES = frozenset("ul ol dl table div section article body".split())
#: Words of class and id, and roles, that mark what isn't main text.
HINTS = frozenset(
    "ad ads advert adverts advertisement advertising banner sponsor sponsored promo promotion menu nav navbar navigation "
    "breadcrumb breadcrumbs sidebar widget footer header masthead cookie cookies consent gdpr notice popup modal overlay "
    "newsletter subscribe subscription social share sharing comment comments respond disqus related recommended login "
    "signup search pagination pager toolbar skip".split()
)
ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar toolbar".split())
WHOLE = frozenset("html body main article".split())
#: Elements that mark content.
MARKS = frozenset(("article", "main", "h1"))
_WORDS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
_CUT_TAG = re.compile(r"<[a-zA-Z/!?][^<>]*\Z")


def _dropped(tag: str, attrs: list[tuple[str, str | None]], in_article: bool) -> bool:
    if tag in DROPPED or (tag == "header" and not in_article):
        return True
    if tag in WHOLE:
        return False
    for name, value in attrs:
        if name == "hidden" or (name == "aria-hidden" and value == "true"):
            return True
        if name == "role" and value in ROLES:
            return True
    return False


def _hinted(tag: str, attrs: list[tuple[str, str | None]], in_article: bool) -> bool:
    """Is the element doubtful by its tag or by a hint word in class or id? That alone
    doesn't drop an element, see ``_released``. An article in another one (a reader's
    comment, say) is judged like any element."""
    if tag in DOUBTFUL:
        return True
    if tag in WHOLE and not (tag == "article" and in_article):
        return False
    return any(
        name in ("class", "id") and value and not HINTS.isdisjoint(w.lower() for w in _WORDS.findall(value)) for name, value in attrs
    )


class _Lines(HTMLParser):
    """Lines of a page: (text, tags, characters in links, enclosing elements or None where
    dropped, enclosing elements with hint words)."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.lines: list[tuple[str, int, int, tuple | None, tuple]] = []
        self.open: list[tuple[str, int, bool, bool]] = []
        self.hinted: tuple[int, ...] = ()
        #: For article, main and h1: the hinted elements around each one that has text.
        self.around: dict[str, set[tuple[int, ...]]] = defaultdict(set)
        self.boxes: tuple[int, ...] = ()
        #: Numbers of the hinted elements that are so by their tag, and of lines in headings.
        self.forms: set[int] = set()
        self.headings: set[int] = set()
        self.kinds: dict[int, str] = {}
        self.off = self.articles = self.links = self.count = self.hints = 0
        self.text: list[str] = []
        self.tags = self.linked = 0

    def end_line(self) -> None:
        text = " ".join("".join(self.text).split())
        if text:
            if any(tag in HEADINGS for tag, *_ in self.open[-3:]):
                self.headings.add(len(self.lines))
            self.lines.append((text, self.tags, self.linked, None if self.off else self.boxes, self.hinted))
            if not self.off:
                under, title = self.hinted, None
                for tag, _, _, hint in reversed(self.open):
                    if tag == "h1":
                        title = len(under)
                    elif tag in MARKS:
                        self.around[tag].add(under)
                        if title is not None:
                            # what is around the title's article is judged by the article
                            self.around["h1"].add(self.hinted[len(under) : title])
                            title = None
                    if hint:
                        under = under[:-1]
                if title is not None:
                    self.around["h1"].add(self.hinted[:title])
            self.tags = self.linked = 0
        self.text = []

    def pop_to(self, i: int) -> None:
        for tag, box, off, hint in reversed(self.open[i:]):
            if tag in BLOCKS:
                self.end_line()
            self.off -= off
            self.articles -= tag == "article"
            self.links -= tag == "a"
            if box:
                self.boxes = self.boxes[:-1]
            if hint:
                self.hinted = self.hinted[:-1]
        del self.open[i:]

    def close_open(self, names, until=frozenset()) -> None:
        for i in range(len(self.open) - 1, -1, -1):
            if self.open[i][0] in names:
                self.pop_to(i)
                return
            if self.open[i][0] in until:
                return

    def handle_starttag(self, tag: str, attrs) -> None:
        if tag in CLOSES_P:
            self.close_open(("p",), BLOCKS - {"p"})
        if tag in SIBLINGS:
            self.close_open(SIBLINGS[tag], SCOPES)
        if tag in BLOCKS:
            self.end_line()
        elif tag in ("br", "td", "th"):
            self.text.append(" ")
        self.tags += 1
        if tag in VOID:
            return
        off = _dropped(tag, attrs, self.articles > 0)
        box = 0
        if tag in SCOPES or tag in WHOLE:
            self.count += 1
            box = self.count
            self.kinds[box] = tag
            self.boxes = (*self.boxes, box)
        hint = not off and _hinted(tag, attrs, self.articles > 0)
        if hint:
            self.hints += 1
            if tag in DOUBTFUL:
                self.forms.add(self.hints)
            self.hinted = (*self.hinted, self.hints)
        self.open.append((tag, box, off, hint))
        self.off += off
        self.articles += tag == "article"
        self.links += tag == "a"

    def handle_startendtag(self, tag: str, attrs) -> None:
        self.handle_starttag(tag, attrs)

    def handle_endtag(self, tag: str) -> None:
        self.tags += 1
        until = SCOPES if tag not in SCOPES and tag not in WHOLE and tag not in DROPPED else frozenset()
        self.close_open((tag,), until)

    def handle_data(self, data: str) -> None:
        self.text.append(data)
        if self.links:
            self.linked += len(data)


def parse_lines(html: str) -> _Lines:
    parser = _Lines()
    parser.feed(_CUT_TAG.sub("", html))
    parser.close()
    parser.pop_to(0)
    parser.end_line()
    return parser


def _released(page: _Lines, high: np.ndarray) -> set[int]:
    """The doubtful elements that aren't dropped: those with hint words around an article,
    main or h1 where the page has none outside of such elements, and all around DESCEND
    of the text above the threshold; a form only if that text comes in paragraphs."""
    out: set[int] = set()
    for under in page.around.values():
        if () not in under:
            out.update(x for hinted in under for x in hinted if x not in page.forms)
    total, held, paragraphs = 0, defaultdict(int), defaultdict(int)
    for (text, _, _, boxes, hinted), chosen in zip(page.lines, high, strict=True):
        if chosen and boxes is not None:
            total += len(text)
            for x in hinted:
                held[x] += len(text)
                paragraphs[x] += len(text) if len(text) >= PARAGRAPH else 0
    return out | {x for x, n in held.items() if n >= DESCEND * total and (x not in page.forms or 2 * paragraphs[x] >= n)}


def smooth(values: np.ndarray, sigma: float = SIGMA) -> np.ndarray:
    """Gaussian smoothing, renormalised at the ends."""
    reach = int(np.ceil(3 * sigma))
    kernel = np.exp(-0.5 * (np.arange(-reach, reach + 1) / sigma) ** 2)
    full = np.convolve(values, kernel)[reach : reach + len(values)]
    return full / np.convolve(np.ones(len(values)), kernel)[reach : reach + len(values)]


def threshold(values: np.ndarray) -> float:
    """Midpoint between the means of two clusters of the values (1-D two-means)."""
    low, high = float(values.min()), float(values.max())
    for _ in range(20):
        cut = (low + high) / 2
        above = values >= cut
        if above.all() or not above.any():
            return cut
        new = float(values[~above].mean()), float(values[above].mean())
        if new == (low, high):
            return cut
        low, high = new
    return (low + high) / 2


def main_text(html: str | None, sigma: float = SIGMA) -> str:
    """The main text of a page.

    Text-to-tag ratios of all lines are smoothed and split in two clusters; the
    lines above the threshold vote, by length, for the element that holds the
    content: an article or main element where there is one, else the innermost
    one with at least DESCEND of the votes. Articles beside the chosen one that
    have votes are kept with it. Of its lines go those in dropped elements and
    in doubtful ones (hint words, forms) that don't hold the text above the
    threshold. Outside of articles, lines that are links go too, and, where the
    clusters' means differ by APART, so do the lines before the first and behind
    the last line above the threshold that stand in an element without such a
    line; headings directly before the first one stay.
    """
    if not html:
        return ""
    page = parse_lines(html)
    if not page.lines:
        return ""
    kinds = page.kinds
    ratio = np.array([len(text) / max(1, tags) for text, tags, *_ in page.lines])
    even = smooth(ratio, sigma)
    cut = threshold(even)
    high = even >= cut
    released = _released(page, high)
    lines = [(text, tags, linked, boxes if released.issuperset(hinted) else None) for text, tags, linked, boxes, hinted in page.lines]
    eligible = np.array([boxes is not None for *_, boxes in lines])
    if not eligible.any():
        return ""
    if not (high & eligible).any():
        high = eligible & (even >= even[eligible].max())
    votes: dict[int, int] = defaultdict(int)
    depth: dict[int, int] = {}
    total = 0
    for (text, _, _, boxes), chosen, ok in zip(lines, high, eligible, strict=True):
        if ok:
            for i, box in enumerate(boxes):
                depth[box] = i
                votes[box] += len(text) if chosen else 0
            total += len(text) if chosen else 0
    root, parent = None, {}
    for *_, boxes in lines:
        parent.update((b, boxes[:i]) for i, b in enumerate(boxes or ()))
    roots: set[int] = set()
    for wanted in ("article", "main"):
        of_kind = [b for b in votes if kinds[b] == wanted and votes[b]]
        if of_kind:
            root = max(of_kind, key=lambda b: (votes[b], -depth[b], -b))
            roots = {b for b in of_kind if parent[b] == parent[root]}
            break
    marked = root is not None
    if not marked:
        inside = [b for b in votes if votes[b] >= DESCEND * total]
        root = max(inside, key=lambda b: (depth[b], votes[b], -b), default=None)
        roots = {root}
    kept = [
        i
        for i, (text, _, linked, boxes) in enumerate(lines)
        if boxes is not None and (root is None or not roots.isdisjoint(boxes)) and (marked or linked < LINKED * len(text))
    ]
    if not marked:
        kept = _region(kept, lines, ratio, even, high, cut, page.headings)
    return "\n\n".join(lines[i][0] for i in kept)


def _region(kept: list[int], lines: list, ratio: np.ndarray, even: np.ndarray, high: np.ndarray, cut: float, headings: set[int]) -> list[int]:
    """``kept`` without what stands before and behind the content region in elements of its own."""
    dense = [k for k, i in enumerate(kept) if ratio[i] >= cut]
    if not dense or high.all() or even[high].mean() < APART * even[~high].mean():
        return kept
    held = {box for k in dense for box in lines[kept[k]][3]}
    first, last = dense[0], dense[-1]
    while first and kept[first - 1] in headings:
        first -= 1
    return [i for k, i in enumerate(kept) if first <= k <= last or held.issuperset(lines[i][3])]


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars for every row of ``pages``(page_id, url, html).

    Null or empty html, or nothing but dropped elements: empty text, 0. Broken
    markup, cut-off tags: parsed as far as it goes. Null ids, repeated rows: a
    row each. Empty table: no rows. Other columns are ignored.
    """
    schema = "page_id long, url string, text string, n_chars long"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(x.as_py()) for x in batch.column(2)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"]
            )

    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), "html")
    return rows.mapInArrow(run, schema)
