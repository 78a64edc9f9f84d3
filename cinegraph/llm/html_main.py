"""Main text of HTML pages: the best contiguous region of words over tags.

A page is cut into words and tags. Words score positive; tags score
negative, each by a weight that labelled pages give: the log-odds of a token of
its kind standing inside the main region. One linear scan finds the contiguous
region of the highest sum. Inside it, and at its edges, subtrees that hold
no article text (menus, notices, adverts, forms, scripts, styles, comments of
readers) are left out. Text is cut into blocks at block tags; character
references are decoded, white space inside a block becomes one space, and blocks are
joined by one space.

Null or empty pages give an empty text. Rows are treated one by one, so repeated
rows, ties and columns of other names need no care; of two regions of the same
score the first is taken.
"""

from __future__ import annotations

import html
import math
import re
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: How HTML names its elements.
BLOCKS = frozenset("address article aside blockquote body br caption dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html li main menu nav ol option p pre search section summary table tbody td tfoot th thead title tr ul".split())
TABLE = frozenset("table caption thead tbody tfoot tr td th".split())
#: What an opening tag ends: elements of these names, up to the last of those.
ENDS = {
    "li": ((("li",), ("ul", "ol", "menu")),), "dt": ((("dt", "dd"), ("dl",)),), "dd": ((("dt", "dd"), ("dl",)),), "tr": ((("tr", "caption"), ("table",)),), "td": ((("td", "th"), ("tr", "table")),),
    "th": ((("td", "th"), ("tr", "table")),), "thead": ((("caption", "thead", "tbody", "tfoot"), ("table",)),), "tbody": ((("caption", "thead", "tbody", "tfoot"), ("table",)),), "tfoot": ((("caption", "thead", "tbody", "tfoot"), ("table",)),),
    "option": ((("option",), ("select", "optgroup", "datalist")),), "body": ((("head",), ("body",)),),
}
VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
RAW = frozenset("script style noscript template textarea title svg iframe object select".split())
APART = frozenset("nav header footer aside form button menu dialog script style noscript template textarea svg iframe object select head".split())
#: Words in class, id or role that mark what is not the article, and words that only say where or how it stands. A name of several
#: words (ad-slot, siteFooter) marks it if one of the first kind is among them and no word besides these.
APART_WORDS = frozenset(
    "ad ads advert adverts advertisement banner promo sponsor sponsored nav navbar navigation menu breadcrumb breadcrumbs sidebar side footer header masthead cookie cookies consent notice popup modal newsletter subscribe "
    "share sharing social related comment comments discussion replies reply respond widget toolbar pagination pager form search login signup complementary contentinfo alert".split()
)
PLACE_WORDS = frozenset(
    "site page main top bottom left right upper lower inner outer box block wrap wrapper container holder area section list item items bar panel module link links post posts entry entries story stories article articles button buttons icon icons "
    "group slot unit primary secondary global mobile desktop fixed sticky row col column content text message count body field input control controls first last new user more".split()
)
#: Names of an article's own head, which holds its title.
OWN_HEAD = re.compile(r"^(?:article|entry|post|story|content|main)[-_]?header$", re.I)
NAME_PARTS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])|[0-9]+")
#: Subtrees of these names are never left out for their class.
MAIN = frozenset("html body main article h1".split())
TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*>|<(/?)([A-Za-z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>|</?[A-Za-z][^>]*(?:>|\Z)|[^<]+|<", re.S)
ATTRIBUTE = re.compile(r"\b(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
HIDDEN = re.compile(r"\bhidden\b(?!\s*=)|aria-hidden\s*=\s*[\"']?true|display\s*:\s*none", re.I)

#: Elements that mark the article, and those that stand between it and the rest of a page.
MARKS = frozenset("article main".split())
LANDMARKS = frozenset("nav header footer menu head".split())
#: Elements of lists and tables: their parts are short, and menus of links pay for the links.
STRUCTURE = "ul ol li dl dt dd table caption thead tbody tfoot tr td th".split()
#: Elements that only set off words of a sentence.
INLINE = "abbr b bdi bdo br cite code data del dfn em i ins kbd mark q s samp small span strong sub sup time u var wbr".split()

WORD_SCORE = 1.0
#: What either tag of an element that marks the article is worth; text after it costs twice as much to reach.
MARK = 20.0
#: Weights before any labelled page is seen.
PRIOR = {"a": -3.0, "nav": -20.0, "aside": -20.0, "footer": -20.0, "form": -20.0, "article": MARK, "main": MARK, "h1": 6.0} | dict.fromkeys(STRUCTURE, -0.25) | dict.fromkeys(INLINE, -0.05)
DEFAULT_TAG = -1.5
#: The labelled pages may share a template; what it has outside the article only costs no more than a link.
LEAST_TAG = -3.0
#: About so many labelled pages are read to fit the weights.
FIT_PAGES = 2000
#: Tags whose weight is fitted; others keep DEFAULT_TAG.
KNOWN = BLOCKS | VOID | RAW | frozenset("a abbr b bdi bdo cite code data del dfn em i ins kbd label legend mark meter output picture progress q ruby s samp small span strong sub sup time u var video audio font center".split())


def tokens(page: str) -> Iterator[tuple[str, str, str]]:
    """(kind, name, text): kind is text, open, close or skip; raw elements give no text of their own."""
    at, n = 0, len(page)
    while at < n:
        m = TOKEN.match(page, at)
        if m is None:  # a tag that never ends, or a lone quote in one
            end = page.find(">", at)
            at = n if end < 0 else end + 1
            continue
        at = m.end()
        name = (m[2] or "").lower()
        if not name:
            if page[m.start()] != "<" or m.end() - m.start() == 1:
                yield "text", "", m[0]
            elif m[0].startswith("<![CDATA["):
                yield "text", "", html.escape(m[0][9:].removesuffix("]]>"))
            continue
        yield ("close" if m[1] else "open"), name, m[3]
        if not m[1] and name in RAW and not m[3].endswith("/"):
            found = re.compile(rf"</{re.escape(name)}\b[^>]*>", re.I).search(page, at)
            at = found.end() if found else n
            yield "close", name, ""


@lru_cache(maxsize=20_000)
def marks_apart(word: str) -> bool:
    """Whether one name of a class, id or role says that its element is not the article."""
    if OWN_HEAD.match(word):
        return False
    parts = [p.lower() for p in NAME_PARTS.findall(word)]
    return any(p in APART_WORDS for p in parts) and all(p in APART_WORDS or p in PLACE_WORDS or p.isdigit() for p in parts)


def is_apart(name: str, attributes: str) -> bool:
    if name in APART:
        return True
    if not attributes or name in MAIN:
        return False
    if HIDDEN.search(attributes):
        return True
    return any(marks_apart(word) for a, b, c in ATTRIBUTE.findall(attributes) for word in (a or b or c or "").split())


class Tree:
    """The open elements of a page, with what HTML closes without being told. Each step is constant but for what it closes."""

    def __init__(self):
        self.stack: list[tuple[str, bool]] = []  # name, whether it is left out
        self.at: dict[str, list[int]] = {}  # places of the open elements of a name
        self.blocks: list[int] = []
        self.apart = self.mains = 0

    def _last(self, *names: str) -> int:
        return max((self.at[n][-1] for n in names if self.at.get(n)), default=-1)

    def _pop_to(self, place: int) -> None:
        while len(self.stack) > place:
            name, out = self.stack.pop()
            self.at[name].pop()
            if self.blocks and self.blocks[-1] == len(self.stack):
                self.blocks.pop()
            self.apart -= out
            self.mains -= name in MARKS

    def imply(self, name: str) -> None:
        """Closes what an opening tag of this name ends: a paragraph before a block, an item before the next one."""
        if name in BLOCKS and self.blocks and self.stack[self.blocks[-1]][0] == "p" and name not in ("br", "hr", "option"):
            self._pop_to(self.blocks[-1])
        for ended, scope in ENDS.get(name, ()):
            place = self._last(*ended)
            if place > self._last(*scope):
                self._pop_to(place)

    def open(self, name: str, out: bool) -> None:
        self.at.setdefault(name, []).append(len(self.stack))
        if name in BLOCKS:
            self.blocks.append(len(self.stack))
        self.stack.append((name, out))
        self.apart += out
        self.mains += name in MARKS

    def close(self, name: str) -> None:
        """Closes the last element of this name and what was left open inside; a tag that would close beyond its scope closes nothing."""
        place = self._last(name)
        if name not in BLOCKS:
            inside = place > (self.blocks[-1] if self.blocks else -1)
        else:
            inside = place >= 0 and (name in TABLE or place > self._last("td", "th", "caption"))
        if inside:
            self._pop_to(place)


def scored(page: str, weights: dict[str, float]) -> tuple[list[float], list[tuple[str, str, bool]]]:
    """Scores of the page's tokens, and the tokens as (kind, text or name, apart)."""
    scores, items, tree = [], [], Tree()
    marked, inside, landmark, left_out = False, False, False, []
    for kind, name, text in tokens(page):
        was = tree.apart > 0
        if kind == "text":
            words = len(text.split())
            scores.append(-words * WORD_SCORE if tree.apart else words * WORD_SCORE)
        elif kind == "open":
            tree.imply(name)
            was = tree.apart > 0
            out = is_apart(name, text)
            if name not in VOID and not text.endswith("/"):
                if out and not tree.apart:
                    inside, landmark = tree.mains > 0, name in LANDMARKS
                tree.open(name, out)
                marked |= name in MARKS and not tree.apart
            scores.append(weights.get(name, DEFAULT_TAG))
        else:
            mains = tree.mains
            tree.close(name)
            if name in MARKS and tree.mains < mains and not was:  # the region takes the whole article, and ends there
                scores.append(MARK)
                items.append((kind, name, False))
                kind, name = "end", ""
                scores.append(-2 * MARK)
            else:
                scores.append(min(weights.get(name, DEFAULT_TAG), -0.05))
        items.append((kind, text if kind == "text" else name, tree.apart > 0))
        if (was or tree.apart) and not (kind == "close" and name in MARKS and not tree.apart):
            left_out.append((len(scores) - 1, inside, landmark))
    for k, within, barrier in left_out:  # what is left out of a region does not split it
        if within or not (marked or barrier):
            scores[k] = 0.0
    return scores, items


def best_region(scores: list[float]) -> tuple[int, int]:
    """First contiguous run [start, end) of the highest sum, by one linear scan; empty if none is positive."""
    best, lo, hi, run, start = 0.0, 0, 0, 0.0, 0
    for i, s in enumerate(scores):
        if run <= 0:
            run, start = 0.0, i
        run += s
        if run > best:
            best, lo, hi = run, start, i + 1
    return lo, hi


def main_text(page: str | None, weights: dict[str, float]) -> str:
    if not page:
        return ""
    scores, items = scored(page, weights)
    lo, hi = best_region(scores)
    blocks, parts = [], []
    for kind, text, apart in items[lo:hi]:
        if kind == "text":
            if not apart:
                parts.append(html.unescape(text))
        elif text in BLOCKS and parts:
            blocks.append("".join(parts))
            parts = []
    blocks.append("".join(parts))
    return " ".join(x for x in (" ".join(b.split()) for b in blocks) if x)


def count_tags(page: str) -> tuple[Counter, Counter]:
    """Known tags inside and outside the elements that mark the article."""
    inside, outside, depth = Counter(), Counter(), 0
    for kind, name, _ in tokens(page):
        if kind == "text":
            continue
        if name in MARKS:
            depth += 1 if kind == "open" else -1
        elif kind == "open" and name in KNOWN:
            (inside if depth > 0 else outside)[name] += 1
    return inside, outside


def weights_of(inside: Counter, outside: Counter) -> dict[str, float]:
    """A tag's weight is minus the price of one that stands outside the marked region, by the log-odds of its kind; the region's own tag is the anchor and wins."""
    weights = dict(PRIOR)
    total_in, total_out = sum(inside.values()) + 1, sum(outside.values()) + 1
    for name in {*inside, *outside} - set(PRIOR):
        odds = math.log(((inside[name] + 0.5) / total_in) / ((outside[name] + 0.5) / total_out))
        weights[name] = -0.05 if odds > 0 else max(LEAST_TAG, odds - 0.5)  # tags of the region cost less than the shortest paragraph gives
    return weights


def fit_weights(pages: list[str]) -> dict[str, float]:
    """Weights from labelled pages: pages that mark their own article element."""
    inside, outside = Counter(), Counter()
    for page in pages:
        for total, found in zip((inside, outside), count_tags(page), strict=True):
            total.update(found)
    return weights_of(inside, outside)


def fit(pages: DataFrame, html_col: str = "html", most: int = FIT_PAGES) -> dict[str, float]:
    """Weights from a bounded sample: of the labelled pages the share by hash of their text that gives about `most` of all pages.

    Tags are counted where the pages are; one row a known tag reaches the driver.
    """
    total = pages.where(F.col(html_col).contains("<article")).count()
    share = min(1.0, most / max(1, total))
    some = pages.where(F.col(html_col).contains("<article") & (F.pmod(F.xxhash64(html_col), F.lit(1_000_000)) < int(share * 1_000_000) + 1))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = Counter(), Counter()
        for batch in batches:
            for page in batch.column(0).to_pylist():
                for total, found in zip(sums, count_tags(page), strict=True):
                    total.update(found)
        names = sorted({*sums[0], *sums[1]})
        yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), *[pa.array([t[n] for n in names], pa.int64()) for t in sums]], names=["name", "inside", "outside"])

    counted = some.select(F.col(html_col).cast("string").alias("h")).mapInArrow(work, "name string, inside long, outside long")
    rows = counted.groupBy("name").agg(F.sum("inside").alias("inside"), F.sum("outside").alias("outside")).collect()
    return weights_of(Counter({r["name"]: r["inside"] for r in rows}), Counter({r["name"]: r["outside"] for r in rows}))


def extract(pages: DataFrame, weights: dict[str, float], html_col: str = "html") -> DataFrame:
    """Adds text and n_chars; the other columns stay."""
    names = [c for c in pages.columns if c not in ("text", "n_chars")]
    keep = [c for c in names if c != html_col]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(h, weights) for h in batch.column("_html").to_pylist()]
            columns = [batch.column(c) for c in keep] + [pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, names=[*keep, "text", "n_chars"])

    rows = pages.select(*[f"`{c}`" for c in keep], F.col(html_col).cast("string").alias("_html"))
    schema = rows.select(*[f"`{c}`" for c in keep], F.lit("").alias("text"), F.lit(0).cast("long").alias("n_chars")).schema
    return rows.mapInArrow(work, schema)
