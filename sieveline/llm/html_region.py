"""HTML extraction: the maximum-scoring contiguous region of a page.

A page is read once into blocks of text and the tags between them. A word scores
by the evidence of the elements around its block: the strongest one for main text
and the strongest one against it, each a weight of a kind of element (its tag, the
words of its class, id and role), of link text, or of standing outside the page's
only article. Tags score negative. One linear scan finds the contiguous stretch with
the largest sum; its blocks whose words score above 0 are joined in page order.

Weights are log odds of being main text, by counts of words on labelled pages over
the prior counts below, so what the labels say of a kind outweighs what is taken
for granted. Labelled pages are pairs of ``html`` and ``main`` (the main text, blocks
joined by one space). ``label_by_markup`` makes such pairs from pages that mark
exactly one article, for corpora that bring no labels.

Nulls: a null page is an empty one and gives an empty text. Broken markup is read
as browsers do in outline: unclosed elements end with the element around them,
stray end tags are ignored, a tag without an end is text. Time is linear in a page's
length, whatever its markup; no page is cut. Repeated rows give the same text;
extra columns are left behind; an empty table gives no rows.
"""

from __future__ import annotations

import html as entities
import math
import re
from collections import Counter
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import only, ship

#: Labelled pages used for the weights, those of least hash, and the longest page that serves.
MAX_LABELLED = 300
MAX_LABELLED_CHARS = 200_000

_END = re.compile(r"=[ \t\r\n\f]*([\"'])|>")
_TAG = re.compile(r"(/?)([a-zA-Z][^\s/>]*)")
_NAMES = re.compile(r"""(?:^|\s)(?:class|id|role)\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+)""", re.I)
_HIDDEN = re.compile(r"""(?:^|\s)hidden(?:[\s=/]|$)|aria-hidden\s*=\s*["']?true|display\s*:\s*none|visibility\s*:\s*hidden""", re.I)
_SPLIT = re.compile(r"[^a-z]+")

INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = {tag: re.compile(rf"</{tag}(?=[\s/>]|\Z)[^>]*>?", re.I) for tag in ("script", "style", "textarea", "title")}
#: Elements whose text a reader doesn't see as text.
UNSEEN = frozenset("head script style noscript template iframe object svg math canvas audio video title textarea select option datalist".split())
#: Prior counts of words inside and outside the main text by kind of element: tags, then words of class, id or role.
PRIOR_TAGS = {
    **dict.fromkeys("article main".split(), (40, 1)), **dict.fromkeys("p h1 h2 h3 blockquote pre".split(), (20, 5)),
    **dict.fromkeys("nav menu aside footer form dialog button fieldset".split(), (0, 400)), "header": (0, 40),
}
PRIOR_NAMES = {
    **dict.fromkeys("article content main entry story post".split(), (20, 2)),
    **dict.fromkeys("ad ads advert adverts advertisement advertising sponsor sponsored promo promotion".split(), (0, 400)),
    **dict.fromkeys("cookie cookies consent gdpr popup modal newsletter subscribe subscription paywall overlay".split(), (0, 400)),
    **dict.fromkeys("comment comments disqus replies respond".split(), (0, 400)),
    **dict.fromkeys("side sidebar aside related recommended recommendations complementary".split(), (0, 400)),
    **dict.fromkeys("navbar nav navigation menu breadcrumb breadcrumbs pagination contentinfo footer masthead topbar".split(), (0, 400)),
    **dict.fromkeys("banner notice notices alert widget widgets rail share sharing social toolbar header search login signup reply discussion copyright pager".split(), (0, 40)),
}
PRIOR_OTHER = {"link": (1, 20), "outside": (1, 80)}
#: Words of class, id or role that tell how a part is made rather than what it is, and so say nothing.
STRUCTURAL = frozenset("area articles bar block body box button buttons col column container div form group icon icons inner item items left link links list outer panel posts right row section stories text title top bottom wrap wrapper".split())
#: Bounds on weights; link text alone doesn't outweigh an article, and paragraphs occur anywhere.
HIGH, HIGH_TEXT, LOW, LOW_LINK = 3.0, 1.5, -6.0, -3.0
#: The weight at which one word of a name is enough.
DECISIVE = -5.0
#: What a word scores without any evidence.
BASE = 1.0
#: What a tag costs at most and at least, and one of which no labels tell: less than a word of an article brings in.
TAG_LOW, TAG_HIGH, TAG_COST = -0.5, -0.05, -0.3


class Block:
    __slots__ = ("text", "words", "linked", "state", "inside", "tags")

    def __init__(self, text: str, linked: int, state, inside: bool, tags: list[str]):
        self.text, self.state, self.inside, self.tags = text, state, inside, tags
        self.words = text.count(" ") + 1
        self.linked = 2 * linked >= self.words


def names_of(attributes: str) -> list[str]:
    """The words of an element's class, id and role that may tell what it is."""
    return [w for m in _NAMES.finditer(attributes) for w in _SPLIT.split(m[1].lower()) if w and w not in STRUCTURAL]


def _tag_end(page: str, at: int, last: dict[str, int]) -> int:
    """Where the tag that begins before ``at`` ends (behind its ``>``), quoted values skipped; -1 if it doesn't."""
    if at > last[">"]:
        return -1
    here = at
    while here <= last[">"]:
        m = _END.search(page, here)
        if m is None:
            break
        quote = m[1]
        if quote is None:
            return m.end()
        if m.end() > last[quote]:  # never closed: the first > ends the tag
            break
        here = page.find(quote, m.end()) + 1
    return page.find(">", at) + 1


def blocks(page: str, fold: Callable, start) -> tuple[list[Block], int]:
    """Blocks in page order, each with the tags before it; and how many outermost main elements there are.

    ``fold(state, tag, names, inside)`` gives an element's state from the one around it.
    """
    out: list[Block] = []
    stack: list[tuple] = []  # open elements: tag, state, inside a main element, hidden
    names: Counter = Counter()  # open elements by tag, so a stray end tag costs nothing
    pieces: list[str] = []
    last = {c: page.rfind(c) for c in "><\"'"}
    state, inside, hidden = start, False, False
    linked, link_depth, mains, tags, unseen_inline, at, end = 0, 0, 0, [], 0, 0, len(page)

    def add(text: str) -> None:
        nonlocal linked
        if text and not hidden:
            pieces.append(text)
            if link_depth:
                linked += len(text.split())

    def close() -> None:
        nonlocal linked, tags
        if pieces:
            text = " ".join(entities.unescape("".join(pieces)).split())
            if text:
                out.append(Block(text, linked, state, inside, tags))
                tags = []
            pieces.clear()
        linked = 0

    def top() -> tuple:
        return stack[-1][1:] if stack else (start, False, False)

    def pop_to(tag: str) -> None:
        while stack:
            name = stack.pop()[0]
            names[name] -= 1
            if name == tag:
                return

    while at < end:
        lt = page.find("<", at) if at <= last["<"] else -1
        if lt < 0:
            add(page[at:])
            break
        add(page[at:lt])
        if page.startswith("<!--", lt):
            stop = page.find("-->", lt + 4)
            at = end if stop < 0 else stop + 3
            continue
        if page.startswith("<![CDATA[", lt):
            stop = page.find("]]>", lt)
            add(entities.escape(page[lt + 9 : stop if stop >= 0 else end]))
            at = end if stop < 0 else stop + 3
            continue
        m = _TAG.match(page, lt + 1)
        if m is None:
            if page[lt + 1 : lt + 2] in ("!", "?") and lt < last[">"]:
                at = page.find(">", lt) + 1
            else:
                add("&lt;")
                at = lt + 1
            continue
        stop = _tag_end(page, m.end(), last)
        if stop < 0:
            add(entities.escape(page[lt:]))
            break
        slash, tag, attributes, at = m[1], m[2].lower(), page[m.end() : stop - 1], stop
        if tag == "br" or tag == "hr":
            pieces.append(" ")
            continue
        if tag in INLINE:
            if tag == "a":
                link_depth = 0 if slash else 1
            if slash:
                if unseen_inline and names[tag]:
                    pop_to(tag)
                    state, inside, hidden = top()
                    unseen_inline = unseen_inline - 1
            elif tag not in VOID and (unseen_inline or attributes and _HIDDEN.search(attributes)):  # inline elements matter only in and below hidden ones
                stack.append((tag, state, inside, True))
                names[tag] += 1
                unseen_inline, hidden = unseen_inline + 1, True
            continue
        close()
        link_depth = 0
        tags.append(tag)
        if slash:
            if names[tag]:
                pop_to(tag)
                state, inside, hidden = top()
                unseen_inline = 0 if not hidden else unseen_inline
            continue
        if tag in RAW:
            stop = RAW[tag].search(page, at)
            at = stop.end() if stop else end
            continue
        if tag in VOID:
            continue
        if tag in ("p", "li") and stack and stack[-1][0] == tag:  # the last one ends where its next begins
            pop_to(tag)
            state, inside, hidden = top()
        if tag in ("article", "main", "body") and not inside and not hidden and stack:  # nothing left open before them holds them
            stack.clear()
            names.clear()
            state = start
        elif tag == "body" and stack:
            continue
        words = names_of(attributes) if attributes else []
        hidden = hidden or tag in UNSEEN or bool(attributes and _HIDDEN.search(attributes))
        begins = tag in ("article", "main") and not inside and not hidden
        mains += begins
        state, inside = fold(state, tag, words, inside), inside or begins
        stack.append((tag, state, inside, hidden))
        names[tag] += 1
    close()
    return out, mains


def kinds(state: frozenset, tag: str, names: list[str], inside: bool) -> frozenset:
    """The kinds of all elements around a block, for counting: ``tag:`` and ``name:`` features."""
    found = {f"name:{w}" for w in names}
    if tag in PRIOR_TAGS and not (tag == "header" and inside):  # an article's own heading says nothing
        found.add("tag:" + tag)
    return state | found if found else state


def _evidence(weights: dict[str, float]) -> Callable:
    """The strongest evidence for and against, ``(best, worst)``, of the elements around a block.

    An element's names count by their mean, unknown ones as 0, so one word among several says less;
    but one that stands almost only outside main text (``DECISIVE``) decides alone, so a footer
    named ``content-footer`` is a footer.
    """

    def fold(state: tuple, tag: str, names: list[str], inside: bool) -> tuple:
        best, worst = state
        if tag in PRIOR_TAGS and not (tag == "header" and inside):
            w = weights["tag:" + tag]
            best, worst = max(best, w), min(worst, w)
        if names:
            own = [weights.get("name:" + x, 0.0) for x in names]
            w = min(own) if min(own) <= DECISIVE else sum(own) / len(own)
            best, worst = max(best, w), min(worst, w)
        return best, worst

    return fold


def _word_score(b: Block, marked: bool, weights: dict[str, float]) -> float:
    best, worst = b.state
    if b.linked:
        worst = min(worst, weights["link"])
    if marked and not b.inside:
        worst = min(worst, weights["outside"])
    return BASE + best + worst


def default_weights() -> dict[str, float]:
    return weights_from([])


def weights_from(labelled: list[tuple[str, str]]) -> dict[str, float]:
    """Log odds by kind of element, and costs of tags (``<tag``), over ``(html, main text)`` pairs."""
    prior = {**{"tag:" + k: v for k, v in PRIOR_TAGS.items()}, **{"name:" + k: v for k, v in PRIOR_NAMES.items()}, **PRIOR_OTHER}
    within, without = (Counter({k: v[i] for k, v in prior.items()}) for i in range(2))
    for page, main in labelled:
        found, mains = blocks(page, kinds, frozenset())
        rest, at = " ".join(main.split()), 0
        for b in found:
            # the next words of the main text, or a long block further on; short ones may occur anywhere
            here = at if rest.startswith(b.text, at) and rest[at + len(b.text) : at + len(b.text) + 1] in ("", " ") else rest.find(b.text, at) if b.words >= 8 else -1
            hit = here >= 0
            at = here + len(b.text) + 1 if hit else at
            side = within if hit else without
            for k in b.state:
                side[k] += b.words
            if b.linked:
                side["link"] += b.words
            if mains == 1 and not b.inside:
                side["outside"] += b.words
            for t in b.tags:
                side["<" + t] += 1
    odds = {k: math.log((within[k] + 0.5) / (without[k] + 0.5)) for k in set(within) | set(without)}

    def bound(k: str, v: float) -> float:
        if k[0] == "<":
            return max(TAG_LOW, min(TAG_HIGH, (v - 1.0) / 4))
        text = k.startswith("tag:") and k not in ("tag:article", "tag:main")
        return max(LOW_LINK if k == "link" else LOW, min(HIGH_TEXT if text else HIGH, v))

    return {k: bound(k, v) for k, v in odds.items()}


def extract(page: str | None, weights: dict[str, float]) -> str:
    """The main text: blocks of the best region, joined by one space."""
    found, mains = blocks(page or "", _evidence(weights), (0.0, 0.0))
    best, best_from, best_to, total, begin = 0.0, 0, 0, 0.0, 0
    scores = [_word_score(b, mains == 1, weights) for b in found]
    for i, (b, score) in enumerate(zip(found, scores)):
        if total > 0:
            total += sum(weights.get("<" + t, TAG_COST) for t in b.tags)
        if total <= 0:
            total, begin = 0.0, i
        total += b.words * max(score, 0.0)  # what isn't main text costs its tags
        if total > best:
            best, best_from, best_to = total, begin, i + 1
    return " ".join(b.text for b, s in zip(found[best_from:best_to], scores[best_from:best_to]) if s > 0)


def label_by_markup(page: str | None) -> str | None:
    """The text of a page's only article or main element, without what the priors speak against; None if it hasn't exactly one."""
    weights = default_weights()
    found, mains = blocks(page or "", _evidence(weights), (0.0, 0.0))
    return " ".join(b.text for b in found if b.inside and _word_score(b, True, weights) > 0) if mains == 1 else None


def labelled_sample(pages: DataFrame, key: str, limit: int = MAX_LABELLED, max_chars: int = MAX_LABELLED_CHARS) -> list[tuple[str, str]]:
    """At most ``limit`` pages of least hash of their key, labelled by their own markup.

    A share of the hashes that gives about twice as many is taken first, so tasks
    send few pages whatever their number. Longer pages than ``max_chars`` don't serve.
    """
    share = min(1.0, 2 * limit / max(1, pages.count()))
    place = F.shiftrightunsigned(F.xxhash64(key), 11).cast("double") / F.lit(2.0**53)
    rows = pages.where((place < share) & (F.length("html") < max_chars)).orderBy(place, key, "html").select("html").limit(limit).collect()
    pairs = [(r.html, label_by_markup(r.html)) for r in rows]
    return [(h, m) for h, m in pairs if m]


def extract_main_text(pages: DataFrame, weights: dict[str, float], *, html_col: str = "html", keep: tuple[str, ...] = ("page_id", "url")) -> DataFrame:
    """The ``keep`` columns and ``text`` for each row of ``pages``."""
    ship(pages.sparkSession)
    slim = only(pages, **{c: c for c in keep}, **{"_html": html_col})
    schema = slim.drop("_html").withColumn("text", F.lit("")).schema

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 1000):
                part = batch.slice(at, 1000)
                texts = [extract(p.as_py(), weights) for p in part.column(len(keep))]
                yield pa.RecordBatch.from_arrays([*part.columns[: len(keep)], pa.array(texts, pa.string())], names=[*keep, "text"])

    return slim.mapInArrow(run, schema)
