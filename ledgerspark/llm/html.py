"""HTML extraction: the best contiguous content region by maximum-scoring subsequence.

A page is a sequence of words and tags.  Words score positive and tags negative; how much depends on the block that a word is in, on
the marks (element names, classes, roles) around it and on the tag's name, learned from labelled pages.  A linear scan finds the
contiguous run with the largest sum.  The region is the element that holds the run.  Parts of it with marks of their own go if the marks
count against them more than their text speaks for them: blocks of prose, sentences and few links outweigh half a doubt.
"""

from __future__ import annotations

import html
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerspark.llm.common import hash_sample, parts, table

#: Pages that the weights are learned from at most (the first in hash order), and kinds of words, tags and marks that get a weight of their
#: own at most (the most frequent); others keep the weight that they have before learning.
MAX_LABELLED, MAX_KINDS = 2000, 5000
#: Elements without an end tag, whose content is no text, that break text into blocks, and whose own text is prose.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style noscript template svg math iframe object canvas textarea title".split())
BLOCKS = frozenset("address article aside blockquote body br center dd details dialog dir div dl dt fieldset figure figcaption footer form h1 h2 h3 h4 h5 h6 head header hr html li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split())
PROSE = frozenset("p h1 h2 h3 h4 h5 h6 li dd dt td th blockquote pre figcaption summary address".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
OUTER = frozenset("html body #page".split())
#: Element names and roles that mark what is no article, and words of the same sense in classes and ids.  They
#: weigh ``DOUBT`` before learning.  Words of adverts and readers' comments do so in any class; slight words only where the text itself is no prose.
CHROME = frozenset("nav footer aside form header menu dialog button select fieldset".split())
CHROME_ROLE = frozenset("navigation banner contentinfo complementary search form menu menubar dialog alert".split())
CHROME_WORD = frozenset("ad ads advert adverts advertisement advertising sponsor sponsored promo banner cookie cookies consent gdpr notice popup modal sidebar nav navbar navigation menu breadcrumb breadcrumbs masthead topbar header footer comment comments disqus replies newsletter subscribe signup login pagination toolbar".split())
CHROME_STRONG = frozenset("ad ads advert adverts advertisement advertising sponsor sponsored comments disqus replies".split())
CHROME_SLIGHT = frozenset("share sharing social related recommended buttons teaser teasers".split())
SECTIONS = frozenset("article main".split())
_TOKEN = re.compile(r"<!--.*?(?:-->|$)|<!\[CDATA\[.*?(?:\]\]>|$)|<[!?][^>]*(?:>|$)|<(/?)([A-Za-z][^\s/><]*)((?:[^<>\"']|\"[^\"]*\"|'[^']*')*)(?:>|$)|<(/?)([A-Za-z][^\s/><]*)([^<>]*)>|([^<]+|<)", re.S)
_RAW_END = {name: re.compile(rf"(?i)</{name}(?:[\s/][^>]*)?(?:>|$)") for name in RAW}
_ATTRIBUTE = re.compile(r"(?i)(?<![\w-])(class|id|role|hidden|aria-hidden)(?![\w-])(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?")
_SPACE = re.compile(r"\s+")
#: Weights before anything is learned: of a word in a prose block, outside of any, and in links; of a tag, of one inside a line; of a mark.
PROSE_WEIGHT, BARE_WEIGHT, LINK_WEIGHT, TAG_WEIGHT, INLINE_WEIGHT, DOUBT = 1.0, 0.5, -0.5, -1.0, -0.25, -3.0
#: Parts of the region go whose marks and text weigh less than this together; the range of what marks weigh together.
AGAINST, MARKS = -1.0, (-3.0, 1.0)
#: What speaks for a part of a page: shares of its words in prose blocks, in sentences, in links and outside of any block.
PROSE_SHARE, SENTENCE_SHARE, LINK_SHARE, BARE_SHARE = 1.0, 0.5, -1.5, -0.5
#: An element with so much of a page's words is the page, whatever its classes say.
WHOLE = 0.8
_SENTENCE = re.compile(r"[.!?…。！？][\s\"'”’)»]*$")
#: Share of its weight that a word keeps beside the elements that the author marked as articles.
BESIDE_MARKS = 0.5


@dataclass(eq=False)
class Element:
    """An element: its name, parent, the events it spans, whether it is in a link, and what marks it and those around it."""

    name: str
    parent: "Element | None"
    start: int
    link: bool = False
    hidden: bool = False
    prose: str = ""
    marks: tuple[str, ...] = ()
    own: tuple[str, ...] = ()
    number: int = 0
    end: int = -1


@dataclass
class Page:
    """A page as events.  ``kinds[i]`` is the feature of event i, ``sizes[i]`` its number of words (0: a tag)."""

    kinds: list[str] = field(default_factory=list)
    sizes: list[int] = field(default_factory=list)
    texts: list[str] = field(default_factory=list)
    blocks: list[int] = field(default_factory=list)
    holders: list[Element] = field(default_factory=list)
    elements: list[Element] = field(default_factory=list)

    def add(self, kind: str, text: str, block: int, holder: Element) -> None:
        self.kinds.append(kind)
        self.sizes.append(len(text.split()))
        self.texts.append(text)
        self.blocks.append(block)
        self.holders.append(holder)


def element(name: str, attributes: str, inside: Element, start: int) -> Element:
    """An element with the marks of its name, classes, id and role, and those of the elements around it."""
    e = Element(name, inside, start, inside.link or name == "a", inside.hidden or name in RAW or name == "head", inside.prose, inside.marks)
    own = [f"<{name}>"] if name in CHROME else []
    for key, a, b, c in _ATTRIBUTE.findall(attributes) if attributes else ():
        value, key = (a or b or c).lower(), key.lower()
        if key == "hidden" or key == "aria-hidden" and value == "true":
            e.hidden = True
        elif key == "role":
            own.append(f"role={value}")
        elif key in ("class", "id") and name not in OUTER:
            own += [f".{token}" for token in value.split()]
    e.own = tuple(own)
    e.marks += e.own
    if name in PROSE:
        e.prose = name
    elif name in BLOCKS:
        e.prose = ""
    return e


def read_page(source: str | None) -> Page:
    """Read tags and text in one pass, in linear time; unclosed elements end with the element around them.

    A quote that is never closed ends with its tag; a ``<`` that begins no tag is text.
    """
    page, block, source, at_char = Page(), 0, source or "", 0
    stack = [Element("#page", None, 0)]
    page.elements.append(stack[0])
    opened: Counter = Counter()
    block_at = [0]  # places of the open blocks in the stack

    def close_from(at: int) -> None:
        for e in stack[at:]:
            e.end = len(page.kinds)
            opened[e.name] -= 1
        del stack[at:]
        while block_at[-1] >= at:
            block_at.pop()

    while m := _TOKEN.match(source, at_char):
        at_char = m.end()
        close, name, attributes, text = m.group(1) or m.group(4), m.group(2) or m.group(5), m.group(3) or m.group(6), m.group(7)
        if name is None:
            cdata = m.group(0).startswith("<![CDATA[")
            if text is None and not cdata:
                continue
            top = stack[-1]
            page.add("link" if top.link else top.prose or "bare", html.unescape(text) if not cdata else m.group(0)[9:].removesuffix("]]>"), block, top)
            continue
        name, raw = name.lower(), False
        if name in BLOCKS:
            block += 1
        if close:
            if opened[name]:
                at = len(stack) - 1
                while stack[at].name != name:
                    at -= 1
                close_from(at)
        else:
            if name in BLOCKS and name not in VOID and stack[block_at[-1]].name == "p":  # an open paragraph ends at the next block
                close_from(block_at[-1])
            if name not in VOID:
                e = element(name, attributes, stack[-1], len(page.kinds))
                e.number = len(page.elements)
                page.elements.append(e)
                stack.append(e)
                opened[name] += 1
                if name in BLOCKS:
                    block_at.append(len(stack) - 1)
                raw = name in RAW and not (attributes or "").rstrip().endswith("/")
        page.add(f"<{name}>", "", block, stack[-1])
        if raw:  # what stands before its own end tag is neither tags nor comments
            ending = _RAW_END[name].search(source, at_char)
            at_char = ending.end() if ending else len(source)
            if ending:
                close_from(len(stack) - 1)
    for e in stack:
        e.end = len(page.kinds)
    return page


def class_words(mark: str) -> list[str]:
    return [w for w in re.split(r"[-_\W]+", mark) if w]


def doubt(mark: str) -> float:
    """Weight of a mark before learning: elements, roles and class words that stand for chrome count against; of a class of several words each has its share."""
    if mark[0] == "<":
        return DOUBT
    if mark.startswith("role="):
        return DOUBT if mark[5:] in CHROME_ROLE else 0.0
    words = class_words(mark)
    if any(w in CHROME_STRONG for w in words):
        return DOUBT
    return DOUBT * sum(w in CHROME_WORD for w in words) / max(1, len(words))


@dataclass
class Shares:
    """Running numbers of words over a page's events: all, in prose blocks, in links, outside of any block, and in blocks that end as sentences."""

    totals: np.ndarray

    def speaks_for(self, e: Element) -> float:
        """How much the text of an element speaks for it, from its words alone."""
        n, prose, link, bare, sentences = self.totals[e.end] - self.totals[e.start]
        return float(PROSE_SHARE * prose + SENTENCE_SHARE * sentences + LINK_SHARE * link + BARE_SHARE * bare) / max(1.0, float(n))

    def words(self, e: Element) -> float:
        return float(self.totals[e.end, 0] - self.totals[e.start, 0])


def shares_of(page: Page) -> Shares:
    """Words of hidden elements count nowhere.  A block is a sentence if its last word ends one."""
    n, blocks = len(page.kinds), np.array(page.blocks, dtype=np.int64)
    size = np.array([0 if h.hidden else k for k, h in zip(page.sizes, page.holders)], dtype=np.float64)
    kind = np.array(page.kinds, dtype=object)
    link, bare = kind == "link", kind == "bare"
    ends = {int(b): bool(_SENTENCE.search(t)) for b, t, k in zip(page.blocks, page.texts, size) if k}
    sentence = np.array([ends.get(int(b), False) for b in blocks], dtype=bool) & np.array([bool(h.prose) for h in page.holders], dtype=bool)
    rows = np.stack([size, size * ~(link | bare), size * link, size * bare, size * (sentence & ~link)], axis=1) if n else np.zeros((0, 5))
    return Shares(np.concatenate([np.zeros((1, 5)), np.cumsum(rows, axis=0)]))


@dataclass
class Weights:
    """Score of a word by its block, of a tag by its name, and of the marks around words."""

    words: dict[str, float] = field(default_factory=lambda: {"bare": BARE_WEIGHT, "link": LINK_WEIGHT})
    tags: dict[str, float] = field(default_factory=dict)
    marks: dict[str, float] = field(default_factory=dict)

    def weight(self, mark: str) -> float:
        return self.marks[mark] if mark in self.marks else doubt(mark)

    def against(self, page: Page, start: int = 0, end: int | None = None) -> list[tuple[float, float]]:
        """What the marks around the text of each element weigh together, for headings and for other text.

        Marks of elements that reach beyond a region (``start`` to ``end``), or hold nearly the whole page, say nothing.  A header
        counts against all but headings: an article's title stays.
        """
        shares, end, out = shares_of(page), len(page.kinds) if end is None else end, []
        whole = WHOLE * shares.totals[-1, 0]
        for e in page.elements:
            heading, other = out[e.parent.number] if e.parent else (0.0, 0.0)
            if e.own and start <= e.start and e.end <= end and (shares.words(e) < whole or e.name in CHROME):
                each = {m: self.weight(m) for m in e.own}
                other += sum(each.values())
                heading += sum(v for m, v in each.items() if m != "<header>")
            out.append((heading, other))
        return [(min(max(h, MARKS[0]), MARKS[1]), min(max(o, MARKS[0]), MARKS[1])) for h, o in out]

    def content(self, page: Page, start: int, end: int) -> np.ndarray:
        """Whether each event of a region is text that stays.

        An element inside with marks of its own goes as a whole if these, with those around it, weigh less than ``AGAINST`` and its text does
        not make up for it.  Nothing makes up for words of adverts and readers' comments; slight words count where the text speaks against itself.
        """
        shares, against = shares_of(page), self.against(page, start, end)
        gone: list[tuple[bool, bool]] = []
        for e in page.elements:
            up = gone[e.parent.number] if e.parent else (False, False)
            if e.own and start <= e.start and e.end <= end and (e.start, e.end) != (start, end):
                for_it = shares.speaks_for(e)
                words = [w for m in e.own if m[0] == "." for w in class_words(m)]
                slight = DOUBT * sum(w in CHROME_SLIGHT for w in words) / max(1, len(words)) if for_it < 0 else 0.0
                for_it = 0.0 if any(w in CHROME_STRONG for w in words) else max(for_it, 0.0)
                up = tuple(g or a + slight + for_it < AGAINST for g, a in zip(up, against[e.number]))
            gone.append(up)
        return np.array([k[0] != "<" and not e.hidden and not gone[e.number][0 if e.prose in HEADINGS else 1] for k, e in zip(page.kinds, page.holders)], dtype=bool)

    def scores(self, page: Page) -> np.ndarray:
        against = self.against(page)
        out = np.zeros(len(page.kinds))
        for i, (kind, n, e) in enumerate(zip(page.kinds, page.sizes, page.holders)):
            if kind[0] == "<":
                out[i] = self.tags[kind] if kind in self.tags else TAG_WEIGHT if kind[1:-1] in BLOCKS else INLINE_WEIGHT
            elif n:
                out[i] = n * (-PROSE_WEIGHT if e.hidden else self.words.get(kind, PROSE_WEIGHT) + against[e.number][0 if e.prose in HEADINGS else 1])
        return out


def best_run(scores: np.ndarray) -> tuple[int, int]:
    """Start and end of the contiguous run with the largest sum, the first of equal ones; (0, 0) without any above 0."""
    total = np.concatenate([[0.0], np.cumsum(scores)])
    lowest = np.minimum.accumulate(total[:-1]) if len(scores) else np.zeros(0)
    gain = total[1:] - lowest
    if not len(gain) or gain.max() <= 0:
        return 0, 0
    end = int(gain.argmax())
    return int(np.flatnonzero(total[: end + 1] == lowest[end])[-1]), end + 1


def region(page: Page, weights: Weights) -> tuple[int, int]:
    """The best run of the whole page, made whole at its ends.

    Where the author marked articles, or else main elements, words beside them score less.  The region is the marked or the smallest other
    element of several blocks that holds the run, with the heading beside it.  Where only the page's body holds it, the run itself
    goes on over neighbouring words that score positive, up to the first that do not.
    """
    scores = weights.scores(page)
    marked = [e for e in page.elements if e.name in SECTIONS and not e.hidden]
    marked = [e for e in marked if e.name == "article"] or marked
    if marked:
        beside = np.ones(len(scores), dtype=bool)
        for e in marked:
            beside[e.start : e.end] = False
        scores[beside & (scores > 0)] *= BESIDE_MARKS
    start, end = best_run(scores)
    inside = [i for i in range(start, end) if page.sizes[i] and scores[i] > 0]
    if not inside:
        return 0, 0
    first, last = inside[0], inside[-1]
    chain, e = [], page.holders[first]
    while e is not None:
        if e.start <= first and e.end > last:
            chain.append(e)
        e = e.parent
    among = {id(e) for e in marked}
    holder = next((e for e in chain if id(e) in among), None) or next((e for e in chain if e.name in OUTER or e.name in BLOCKS and e.name not in PROSE), chain[-1])
    if holder.name in OUTER:
        start, end = first, last + 1
        while (i := next((i for i in range(end, len(scores)) if page.sizes[i]), None)) is not None and scores[i] > 0:
            end = i + 1
        while (i := next((i for i in range(start - 1, -1, -1) if page.sizes[i]), None)) is not None and scores[i] > 0:
            start = i
        while start and page.blocks[start - 1] == page.blocks[start]:  # a block is never torn
            start -= 1
        while end < len(scores) and page.blocks[end] == page.blocks[end - 1]:
            end += 1
        return start, end
    start, end = holder.start, holder.end
    if not any(e.name in HEADINGS and start <= e.start < end for e in page.elements):
        near = [e for e in page.elements if e.name in HEADINGS and e.end <= start and e.parent in chain and e.parent.name not in OUTER]
        if near and (scores[near[-1].start : start][[page.sizes[i] > 0 for i in range(near[-1].start, start)]] > 0).all():
            start = near[-1].start
    return start, end


def teasers(page: Page, start: int, end: int) -> list[Element]:
    """Articles in a region that are parts of a list beside its own text: two or more, none of them as long as the text outside of them all."""
    inside: list[Element] = []
    for e in page.elements:
        if e.name == "article" and start <= e.start and e.end <= end and (e.start, e.end) != (start, end) and (not inside or e.start >= inside[-1].end):
            inside.append(e)
    shares = shares_of(page)
    rest = shares.totals[end, 0] - shares.totals[start, 0] - sum(shares.words(e) for e in inside)
    return inside if len(inside) > 1 and rest > max(shares.words(e) for e in inside) else []


def extract(source: str | None, weights: Weights) -> str:
    """Text of the article of a page: blocks in page order, one a line; empty if there is none."""
    page = read_page(source)
    start, end = region(page, weights)
    content = weights.content(page, start, end)
    for teaser in teasers(page, start, end):
        content[teaser.start : teaser.end] = False
    lines: dict[int, list[str]] = {}
    for i in range(start, end):
        if content[i]:
            lines.setdefault(page.blocks[i], []).append(page.texts[i])
    joined = (_SPACE.sub(" ", "".join(texts)).strip() for _, texts in sorted(lines.items()))
    return "\n".join(x for x in joined if x)


def count_kinds(source: str | None) -> Counter:
    """Words (by block and by mark) and tags of a labelled page inside (+) and outside (-) of its article; nothing for pages without one."""
    page, found = read_page(source), Counter()
    label = next((e for e in page.elements if e.name in SECTIONS), None)
    if label is not None:
        for i, (kind, n, e) in enumerate(zip(page.kinds, page.sizes, page.holders)):
            sign = "+" if label.start <= i < label.end else "-"
            if kind[0] == "<":
                found[sign + kind] += 1
            elif n and not e.hidden:
                found[sign + kind] += n
                for mark in set(e.marks):
                    found[f"{sign}@{mark}"] += n
    return found


def fit(pages: DataFrame, max_labelled: int = MAX_LABELLED) -> Weights:
    """Learn weights from pages whose author marked the article (``article`` or ``main`` element).

    Those among the ``max_labelled`` pages first in hash order are used.  A word weighs by its block's log-odds of being inside, a tag at
    most ``TAG_WEIGHT`` / 4, lower the more it is found outside, a mark by its log-odds on top of its doubt, but at most 1 above
    it: pages that have adverts inside their articles do not make these content.  Without labelled pages the weights stay as they are.
    """
    some = hash_sample(pages.where("html is not null").select("page_id", "url", "html"), max_labelled, "page_id", "url", "html")

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total: Counter = Counter()
        for b in batches:
            for source in b["html"]:
                total.update(count_kinds(source))
        yield pd.DataFrame({"kind": list(total), "n": list(total.values())}).astype({"kind": "object", "n": "int64"})

    n = Counter({r["kind"]: r["n"] for r in some.select("html").mapInPandas(count, "kind string, n long").groupBy("kind").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "kind").limit(MAX_KINDS).collect()})
    weights = Weights()
    if not any(k[0] == "+" for k in n):
        return weights
    kinds = {k[1:] for k in n}
    words, tags, marks = {k for k in kinds if k[0] not in "<@"}, {k for k in kinds if k[0] == "<"}, {k for k in kinds if k[0] == "@"}
    of = {s: sum(n[s + k] for k in words) for s in "+-"}
    all_tags = {s: sum(n[s + k] for k in tags) for s in "+-"}
    odds = lambda k, total, rest: float(np.log((n["+" + k] + 1) / (total["+"] + rest)) - np.log((n["-" + k] + 1) / (total["-"] + rest)))
    for kind in words | set(weights.words):
        weights.words[kind] = float(np.clip(odds(kind, of, 3), -2.0, 2.0 if kind not in ("link", "bare") else 0.5))
    for kind in tags:
        weights.tags[kind] = float(np.clip(odds(kind, all_tags, 50), -4.0, TAG_WEIGHT / 4))
    for kind in marks:
        weights.marks[kind[1:]] = doubt(kind[1:]) + float(np.clip(odds(kind, of, 50), DOUBT, 1.0))
    return weights


def extract_pages(pages: DataFrame, weights: Weights, source: str = "html") -> DataFrame:
    """Add ``text``: the article of each page; a null page is an empty one."""
    shared = pages.sparkSession.sparkContext.broadcast(weights)

    @F.pandas_udf("string")
    def text(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            sources = [s or "" for s in batch]
            for part in parts(sources):
                yield pd.Series([extract(s, shared.value) for s in sources[part]], dtype="object")

    return pages.withColumn("text", text(F.col(source)))


def op3_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of every page.

    A null page is an empty one and has the text ``''``; so have pages without any word that scores positive.
    Repeated rows are all extracted, null ids and urls kept; an empty table gives no rows; other columns are not looked at.
    """
    pages = table(spark, sf_dir, "pages").select("page_id", "url", "html")
    found = extract_pages(pages, fit(pages))
    return found.select("page_id", "url", "text", F.char_length("text").cast("long").alias("n_chars"))
