"""Main text of HTML pages by maximum-scoring subsequence (operator 1).

A page is read as one sequence of tokens: words and tags, menus, footers and asides included. Words score by how likely they are
content, tags score negative, and one linear scan finds the contiguous run of tokens with the largest sum. The weights come from
labelled pages: by default those whose author marked the content with one ``article`` or ``main`` element, of which a bounded
sample is read (``LABELLED`` pages, a documented parameter). A word's weight is its probability of being content, given
the container it stands in (menu, header, footer, sidebar, notice, advert, form or comments, by tag, role or name), its block element
and whether it is in a link, less one half; a context not learned takes the weight of the wider one around it. The weight of a tag is the
one of a few values with the best word-level F1 on the labelled pages. Pages without such an element use weights learned with that mark
hidden.

Only what a reader never sees as text is left out before scoring: scripts, styles, form controls, embedded objects and hidden
elements. Inside the best region words of containers with a negative weight are left out, and on marked pages words outside the mark. A container around the mark, or a
form around more than half of a page's words, is not one. Class and id are asked only of ``NAMED`` elements, and
inside the mark only for reader comments, adverts, share bars and the like; headings, paragraphs, code and formulas are left to the scores.
The mark is every ``article`` (with the ``h1`` of ``main``), or ``main`` where no article stands outside such containers.
The heading inside an article's own ``header`` is kept.

Text of the region: character references decoded, white space inside a block turned into one space and trimmed, blocks
joined by one newline in page order, empty blocks left out.

Defined cases: a null, empty or wordless page gives an empty string; a page may be cut off anywhere, have unclosed or deeply nested
elements (the work is linear) and stray quotes; a page with containers alone is read again with tags only and no names; a null key or url
stays null; repeated rows each give a row; other columns are ignored. Texts are never shortened.
"""

from __future__ import annotations

import html
import re
from bisect import bisect_left, bisect_right
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sightline.llm.common import hashed_sample, table, text_chunks

LABELLED = 2000
#: Weights of contexts that no labelled page shows: of a container, in a link, other.
UNKNOWN = (-0.5, -0.25, 0.25)
TAG_WEIGHTS = (-0.05, -0.2, -0.5, -1.0, -3.25)
#: Elements by what they are in HTML.
UNSEEN = frozenset("button select option textarea input label object embed canvas audio video map annotation annotation-xml".split())
ASIDE = frozenset("nav header footer aside form dialog menu".split())
RAW = frozenset("script style textarea title noscript template iframe svg".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 head header hgroup hr html li main menu nav ol option p pre search section summary table tbody td tfoot "
    "th thead title tr ul".split())
CLOSES_P = BLOCKS - frozenset("body html td th tr tbody thead tfoot caption head option".split())
MARKED = frozenset(("article", "main"))
MARK = r"<(?:article|main)[\s>]"
NEVER_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert menu menubar toolbar".split())
NEVER_NAMES = re.compile(
    r"(?:^|[\s_-])(?:ad|ads|advert|advertisement|advertising|adsense|banner|breadcrumb|breadcrumbs|comment|comments|commentlist|"
    r"cookie|cookies|consent|disqus|footer|gdpr|header|masthead|menu|modal|nav|navbar|navigation|newsletter|notice|pagination|pager|"
    r"popup|promo|promoted|related|replies|respond|share|sharing|sidebar|social|sponsor|sponsored|subscribe|toolbar|widget)s?(?=$|[\s_-])",
    re.IGNORECASE)
#: Elements whose class and id are asked, and what is asked of them inside the content mark.
NAMED = frozenset("div section ul ol table".split())
NEVER_INSIDE = re.compile(
    r"^(?:(?:post|article|page|entry|content|user|reader|blog|wp|google|inline|in-article|top|bottom|side)[_-])*"
    r"(?:ad|ads|advert|advertisement|adsense|breadcrumbs?|comments|commentlist|disqus|pagination|promoted|replies|respond|sidebar|sponsored)"
    r"(?:[_-](?:area|bar|box|container|form|list|section|slot|thread|unit|wrap|wrapper|\d+))*$|"
    r"^(?:(?:social|post|article)[_-])?(?:share|sharing)(?:[_-](?:this|bar|box|buttons?|icons?|links?|list|tools?|widget))+$|"
    r"^share$|^social[_-](?:share|sharing|bar|buttons?|icons?|links?|media)$",
    re.IGNORECASE)
#: Beginnings of class names that describe the layout around an element's content.
LAYOUT = ("has-", "with-", "no-", "without-", "is-", "layout-")
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
LISTS = frozenset("ul ol dl table select".split())
ITEMS = frozenset("li dt dd tr td th option".split())
# A quote opens a value only after an equals sign.
TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[(?P<cdata>.*?)(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|"
    r"<(?P<end>/?)(?P<tag>[a-zA-Z][^\s/>]*)(?P<attrs>(?:=\s*\"[^\"]*\"|=\s*'[^']*'|[^>])*+)(?:>|\Z)", re.DOTALL)
ATTR = re.compile(r"([^\s=>\"'/]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?")
UNDISPLAYED = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.IGNORECASE)
CLOSE = {t: re.compile(rf"</{t}(?=[\s/>])[^>]*>|\Z", re.IGNORECASE) for t in RAW}


@dataclass
class Run:
    """Consecutive words in one context, or one tag (no words); ``inside``: content by the mark, ``under``: below it in the page."""

    text: str = ""
    words: int = 0
    context: tuple = ()
    block: int = 0
    inside: bool = False
    under: bool = False


@dataclass
class Weights:
    """Probability of being content less one half by context, wider contexts included, and the weight of a tag."""

    content: dict = field(default_factory=dict)
    tag: float = -0.5

    def word(self, context: tuple) -> float:
        for c in _wider(context):
            if c in self.content:
                return self.content[c]
        container, link = ">" in context[1], context[2]
        return UNKNOWN[0 if container else 1 if link and not context[0] else 2]

    def score(self, t: Run) -> float:
        """What a token adds to a region. What the region would leave out again must not part it: under the mark neither tags nor
        containers count, and elsewhere a run of words in a container counts as one word."""
        if not t.words:
            return 0.0 if t.under else self.tag
        weight = self.word(t.context)
        if ">" in t.context[1] and weight < 0:
            return 0.0 if t.under else weight
        return t.words * weight


def _wider(context: tuple) -> list[tuple]:
    """The context and the wider ones to ask in turn: (under the mark, container>block, in a link)."""
    marked, near, link = context
    if ">" in near:
        # What a container holds is judged alike inside and outside the mark.
        kind = near.split(">")[0]
        return [(False, near, link), (False, kind + ">", None), (False, ">", None)]
    if marked:
        return [context, (True, "", None)]
    if link and near not in HEADINGS:
        return [context, (False, "a", None)]
    return [(False, near, False), (False, "", None)]


@dataclass
class Element:
    """An element that may be a container or the mark, as a span of tokens."""

    tag: str
    start: int
    outer: str | None  # what kind of container it is outside the mark
    inner: str | None  # and inside it
    end: int = -1


def _element(tag: str, attrs: str, at: int, by_name: bool) -> Element | None | bool:
    """False for an undisplayed element, None for an ordinary one."""
    outer = inner = tag if tag in ASIDE else None
    if tag == "form" and not by_name:
        outer = inner = None
    if attrs and tag not in ("html", "body"):
        for m in ATTR.finditer(attrs):
            name, value = m[1].lower(), m[2] or m[3] or m[4] or ""
            if name == "hidden" or (name == "aria-hidden" and value.lower() == "true") or (name == "style" and UNDISPLAYED.search(value)):
                return False
            if not by_name:
                continue
            if name == "role" and value.strip().lower() in NEVER_ROLES:
                outer = inner = outer or "role"
            if tag in NAMED and name in ("class", "id"):
                for t in value.split():
                    if not t.lower().startswith(LAYOUT):
                        outer = outer or ("name" if NEVER_NAMES.search(t) else None)
                        inner = inner or ("name" if NEVER_INSIDE.search(t) else None)
    if outer or inner or tag in MARKED or tag == "h1":
        return Element(tag, at, outer, inner)
    return None


class _Open:
    """Open elements, with the places of each tag, so that every question takes constant time."""

    def __init__(self):
        self.tags: list[str] = []
        self.elements: list[Element | None] = []
        self.places: dict[str, list[int]] = defaultdict(list)
        self.blocks: list[int] = []
        self.lists: list[int] = []

    def push(self, tag: str, element: Element | None) -> None:
        at = len(self.tags)
        self.tags.append(tag)
        self.elements.append(element)
        self.places[tag].append(at)
        if tag in BLOCKS:
            self.blocks.append(at)
        if tag in LISTS:
            self.lists.append(at)

    def cut(self, height: int, token: int) -> None:
        """Close all elements from ``height`` on."""
        while len(self.tags) > height:
            tag, element = self.tags.pop(), self.elements.pop()
            at = len(self.tags)
            for places in (self.places[tag], self.blocks, self.lists):
                if places and places[-1] == at:
                    places.pop()
            if element is not None:
                element.end = token

    def near(self) -> str:
        return self.tags[self.blocks[-1]] if self.blocks else "body"


def _scan(page: str, by_name: bool) -> tuple[list[Run], list[Element]]:
    """All tokens of a page, with contexts that know neither mark nor container yet, and the elements that decide these."""
    out: list[Run] = []
    found: list[Element] = []
    open_ = _Open()
    dropped = 0  # height of the open elements at which text stops counting
    block, at, n = 0, 0, len(page)

    def words(raw: str) -> None:
        if dropped or not raw:
            return
        text = html.unescape(raw)
        count = len(text.split())
        if count:
            out.append(Run(text, count, (False, open_.near(), bool(open_.places["a"])), block))
        elif out and out[-1].words and out[-1].block == block:
            if not out[-1].text[-1:].isspace():
                out[-1].text += " "
        else:
            out.append(Run(" ", 0, (), block))

    while at < n:
        start = page.find("<", at)
        if start < 0:
            words(page[at:])
            break
        m = TOKEN.match(page, start)
        if m is None:
            following = page.find("<", start + 1)
            following = n if following < 0 else following
            # A lone "<" is text, but a tag that the page's end cuts off is not.
            words(page[at:following] if not re.match(r"</?[a-zA-Z]", page[start:start + 3]) else page[at:start])
            at = following
            continue
        words(page[at:start])
        at = m.end()
        if m["cdata"]:
            words(m["cdata"])
            continue
        if m["tag"] is None:
            continue
        tag, attrs = m["tag"].lower(), m["attrs"] or ""
        if tag in BLOCKS:
            block += 1
        if m["end"]:
            if places := open_.places[tag]:
                place = places[-1]
                if tag in BLOCKS or tag in UNSEEN or not open_.blocks or open_.blocks[-1] < place:
                    open_.cut(place, len(out))
                else:  # an inline element that ends inside a block opened later leaves that block open
                    places.pop()
                    open_.tags[place] = ""
                if dropped and len(open_.tags) < dropped:
                    dropped = 0
            if not dropped:
                out.append(Run(block=block))
            continue
        if tag in CLOSES_P and open_.places["p"] and open_.blocks[-1] == open_.places["p"][-1]:
            # Formatting elements left open by the paragraph end with it.
            open_.cut(open_.places["p"][-1], len(out))
        if tag in ITEMS and open_.places[tag] and (not open_.lists or open_.lists[-1] < open_.places[tag][-1]):
            open_.cut(open_.places[tag][-1], len(out))
        if dropped and len(open_.tags) < dropped:
            dropped = 0
        if not dropped:
            out.append(Run(" " if tag == "br" else "", 0, (), block))
        if tag in RAW:
            at = CLOSE[tag].search(page, at).end()
            continue
        if tag in VOID or attrs.endswith("/"):
            continue
        element = None if dropped else _element(tag, attrs, len(out), by_name)
        open_.push(tag, element or None)
        if element:
            found.append(element)
        if not dropped and (element is False or tag in UNSEEN):
            dropped = len(open_.tags)
    open_.cut(0, len(out))
    return out, found


def _outermost(elements: list[Element]) -> list[Element]:
    """Those inside no other; elements come in page order and nest."""
    kept: list[Element] = []
    for e in elements:
        if not kept or e.start >= kept[-1].end:
            kept.append(e)
    return kept


def _within(elements: list[Element], outer: list[Element]) -> list[bool]:
    """Whether each element stands inside one of ``outer``, which do not nest."""
    starts = [o.start for o in outer]
    at = [bisect_right(starts, e.start) - 1 for e in elements]
    return [i >= 0 and e is not outer[i] and e.end <= outer[i].end and e.start < outer[i].end for e, i in zip(elements, at)]


def _marks(found: list[Element]) -> list[Element]:
    """The elements that hold the content by their author's mark, outermost ones."""
    containers = _outermost([e for e in found if e.outer])
    free = [e for e, inside in zip(found, _within(found, containers)) if not inside and not e.outer]
    for some in (free, [e for e in found if not e.outer]):
        main = [e for e in some if e.tag == "main"]
        if article := [e for e in some if e.tag == "article"]:
            titles = [e for e, inside in zip(some, _within(some, _outermost(main))) if inside and e.tag == "h1"]
            return _outermost(sorted(article + titles, key=lambda e: (e.start, -e.end)))
        if main:
            return _outermost(main)
    return []


def runs(page: str, by_name: bool = True) -> list[Run]:
    """The token sequence of a page; ``by_name`` also tells containers by role, class, id and form.

    Context of words: (under the mark, ``container>block`` or block, in a link).
    """
    out, found = _scan(page, by_name)
    marks = _marks(found)
    inside = _within(found, marks)
    ends = list(accumulate((t.words for t in out), initial=0))
    kinds: list[str | None] = [None] * len(out)
    starts = [m.start for m in marks]
    covered = 0
    for e, within in zip(found, inside):
        kind = e.inner if within else e.outer
        if e.start < covered or kind is None:
            continue
        if not within:
            following = bisect_left(starts, e.start)
            if following < len(starts) and starts[following] < e.end:
                continue
            if kind == "form" and 2 * (ends[e.end] - ends[e.start]) > ends[-1]:
                continue
        covered = e.end
        kinds[e.start:e.end] = [kind] * (e.end - e.start)
    for m in marks:
        for t in out[m.start:m.end]:
            t.under, t.inside = True, t.words > 0
    for t, kind in zip(out, kinds):
        if t.words:
            _, near, link = t.context
            if kind == "header" and t.inside and near in HEADINGS:
                kind = None
            t.context = (t.inside, f"{kind}>{near}" if kind else near, link)
            t.inside = t.inside and kind is None
    return out


def best_region(tokens: list[Run], weights: Weights) -> tuple[int, int]:
    """[from, to) of the contiguous tokens with the largest sum; one linear scan."""
    best, at = 0.0, (0, 0)
    total, start = 0.0, 0
    for i, t in enumerate(tokens):
        total += weights.score(t)
        if total <= 0:
            total, start = 0.0, i + 1
        elif total > best:
            best, at = total, (start, i + 1)
    return at


def region_text(tokens: list[Run]) -> str:
    blocks: dict[int, list[str]] = {}
    for t in tokens:
        if t.text:
            blocks.setdefault(t.block, []).append(t.text)
    lines = (" ".join("".join(parts).split()) for parts in blocks.values())
    return "\n".join(line for line in lines if line)


def _hidden(tokens: list[Run]) -> list[Run]:
    return [Run(t.text, t.words, (False, *t.context[1:]) if t.words else (), t.block, t.inside) for t in tokens]


def learn(pages: list[str]) -> tuple[Weights, Weights]:
    """Weights from labelled pages: (for pages with a content mark, for pages without).

    Words of a container inside the mark are not counted: whether they are content is what the containers outside teach.
    """
    labelled = [t for t in map(runs, pages) if any(r.inside for r in t)]
    out = []
    for tokens, hidden in ((labelled, False), ([_hidden(t) for t in labelled], True)):
        seen = defaultdict(lambda: [1.0, 1.0])
        for page, shown in zip(tokens, labelled):
            for t, own in zip(page, shown):
                if t.words and not (">" in own.context[1] and own.context[0]):
                    wider = _wider(t.context)
                    for c in {*wider, (False, "a", None)} if hidden and t.context[2] else wider:
                        seen[c][0 if t.inside else 1] += t.words
        content = {c: a / (a + b) - 0.5 for c, (a, b) in seen.items()}
        scored = []
        for tag in TAG_WEIGHTS:
            weights, right, found, wanted = Weights(content, tag), 0, 0, 0
            for page in tokens:
                a, b = best_region(page, weights)
                right += sum(t.words for t in page[a:b] if t.inside)
                found += sum(t.words for t in page[a:b])
                wanted += sum(t.words for t in page if t.inside)
            scored.append((2 * right / max(found + wanted, 1), tag))
        out.append(Weights(content, max(scored)[1]))
    return out[0], out[1]


def kept(region: list[Run], weights: Weights, marked: bool) -> list[Run]:
    """The region without words of containers that score negative and, on a marked page, without words outside the mark."""
    return [t for t in region if not t.words or not (
        (marked and not t.context[0]) or (">" in t.context[1] and weights.word(t.context) < 0))]


def main_text(page: str | None, marked: Weights, unmarked: Weights) -> str:
    """The text of the best region; names are not trusted where they would leave nothing."""
    if not page:
        return ""
    for by_name in (True, False):
        tokens = runs(page, by_name)
        has_mark = any(t.inside for t in tokens)
        weights = marked if has_mark else unmarked
        a, b = best_region(tokens, weights)
        if text := region_text(kept(tokens[a:b], weights, has_mark)):
            return text
    return ""


def labelled_sample(pages: DataFrame, text: str, limit: int = LABELLED) -> list[str]:
    """At most ``limit`` pages with exactly one content element, the first by a hash of the page."""
    rows = pages.select(F.col(text).alias("page")).filter(F.regexp_count(F.lower("page"), F.lit(MARK)) == 1)
    return sorted(r["page"] for r in hashed_sample(rows, F.xxhash64("page"), limit).collect())


def extract(pages: DataFrame, key: str = "page_id", url: str = "url", text: str = "html") -> DataFrame:
    """(key, url, text, n_chars) of every page."""
    plain = pages.select(pages[key].alias("key"), pages[url].alias("url"), pages[text].alias("html"))
    weights = learn(labelled_sample(plain, "html"))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_chunks(batches, "html"):
            texts = [main_text(p, *weights) for p in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())],
                names=["key", "url", "text", "n_chars"])

    kinds = {f.name: f.dataType.simpleString() for f in plain.schema}
    return plain.mapInArrow(work, f"key {kinds['key']}, url {kinds['url']}, text string, n_chars bigint").withColumnsRenamed(
        {"key": key, "url": url})


def op1_maximum_subsequence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(table(spark, sf_dir, "pages"))


QUERIES = {"op1_maximum_subsequence": op1_maximum_subsequence}
ORACLES: dict[str, str] = {}
