"""Main text of web pages by a minimum cut.

A page is read into blocks: runs of text between block-level tags, in page order, character references decoded and white space
collapsed.  A classifier of the block and of what encloses it (its elements, the words of their class, id and role, lengths,
punctuation, the share of linked text) gives log-odds of content, which become capacities from the source (content) or to the sink
(boilerplate).  What an element's tag or names say against it weighs less the deeper below it a block stands, and less the more
of the page's prose the element holds with little prose outside: a form or a sidebar's name around the whole article says nothing.
Of several articles, those with a small part of the largest one's prose are teasers and count as outside.  Smoothness edges join neighbours in page order, and each block to its parent element and that to the next one up (DOM
proximity).  The maximum flow between the terminals leaves the cut of least cost: blocks that the source still reaches are content.

The costs are parameters (COSTS), not learned: the tables hold no labelled pages.

Defined results: a null or empty page, or one without text, gives the empty text; markup that is never closed or closed twice is read
as browsers do in outline; pages of any length and depth are read whole; repeated rows get equal results; an empty table gives an
empty one; other columns are left out.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

#: Log-odds of content, and weights of smoothness edges.
COSTS = {
    "boilerplate": -7.0, "named_by_head": -4.0, "named_in_part": -1.5, "own_content": 3.0, "article": 3.0, "named_content": 1.0, "paragraph": 0.8, "heading": 0.5, "long": 0.8, "sentences": 0.8,
    "short": -0.7, "linked": -2.5, "some_links": -0.6, "listed_link": -1.0, "rights": -2.0, "outside": -3.5,
    "next_sibling": 1.2, "next_cousin": 0.8, "next": 0.4, "parent": 0.5, "up": 0.3, "border": 0.3,
}

#: What a level of depth leaves of an element's cost; words of prose in an element, and outside of it, that count in full; the part of
#: the largest article's prose under which another one is a teaser.
DECAY, PROSE, PROSE_OUTSIDE, TEASER = 0.95, 15, 20, 0.4

_TAG = re.compile(r"""<!--.*?(?:-->|\Z)|<[!?]|<(/?)([a-zA-Z][^\s/>]*)""", re.S)
_ATTR = re.compile(r"""(class|id|role|itemprop|style|hidden|aria-hidden)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s>]+))?(?=[\s/>]|$)""", re.I)
_WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|[0-9]+")
_RIGHTS = re.compile(r"©|\bcopyright\b|\ball rights reserved\b|\bcookies?\b|\bsubscribe\b|\bsign up\b", re.I)
_END = re.compile(r"[.!?;:,。！？][\"'”»)]?(?:\s|$)")

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style noscript iframe title textarea noembed noframes".split())
#: Elements whose text is not shown as the page's; where none of the kind ends next, those of BREAKS end them.
MUTE = frozenset("template object svg canvas audio video select datalist".split())
BREAKS = frozenset("html body main article section div p h1 h2 h3 h4 h5 h6 ul ol dl table blockquote pre figure header footer nav aside form".split())
_SAME = {t: re.compile(rf"<(/?){t}(?=[\s/>])", re.I) for t in MUTE}
_QUOTE = re.compile("[\"'>]")
INLINE = frozenset("""a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark meter nobr output q rp rt ruby s samp small span strike strong sub sup time tt u var wbr
    math mi mn mo ms mtext mrow msup msub msubsup mfrac msqrt mroot mover munder munderover mtable mtr mtd mstyle mspace mpadded semantics""".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: Elements that an opening tag of the kind ends first.
ENDS = {
    "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"},
    "option": {"option"}, "thead": {"tr", "td", "th"}, "tbody": {"tr", "td", "th", "thead"}, "tfoot": {"tr", "td", "th", "tbody"},
}
BOILER_TAGS = frozenset("nav footer aside form button fieldset dialog menu header head".split())
BOILER_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar tablist toolbar".split())
#: Those whose cost no prose inside outweighs.
HARD_TAGS = frozenset("nav footer button dialog menu head".split())
#: Words of class and id that name boilerplate, and those that name content.
BOILER_WORDS = frozenset(
    """ad ads adv adsbygoogle advert adverts advertisement advertising adsense sponsor sponsored promo promotion banner banners nav navbar navigation
    menu menus submenu breadcrumb breadcrumbs pagination pager footer foot colophon header masthead topbar sidebar sidebars aside widget
    widgets related recommended recommendations trending popular cookie cookies consent gdpr notice notices alert alerts popup modal overlay
    newsletter subscribe subscription signup login signin register search form comment comments commentlist disqus reply replies respond
    discussion reviews share sharing social follow tags taglist toolbar skip hidden copyright legal disclaimer paywall rail outbrain taboola
    feedback toc""".split()
)
CONTENT_WORDS = frozenset("article content post entry story main body text prose page".split())
HARD_WORDS = frozenset("comment comments commentlist disqus cookie cookies consent nav navbar navigation menu menus breadcrumb breadcrumbs pagination".split())
#: Words that say nothing beside others; first words and last words that make a name speak of something else; words of titles.
FRAME_WORDS = frozenset("list box wrap wrapper container section area block inner outer top bottom left right site global primary secondary item items group panel bar unit slot col column content".split())
ABOUT_FIRST = frozenset("with has no without not is category cat tag type format show".split())
ABOUT_LAST = frozenset("open opened closed visible enabled disabled active on off true false".split())
TITLE_WORDS = frozenset("of for and the on in to a an".split())


class Element:
    __slots__ = ("tag", "up", "bad", "hard", "flag", "article", "story", "named", "node", "link", "listed", "mute", "loose", "prose", "holds", "told")

    def __init__(self, tag: str, up: "Element | None", attrs: str) -> None:
        self.tag, self.up, self.node, self.loose = tag, up, -1, False
        self.mute = up.mute if up else None  # the outermost element around whose text is not shown
        self.article, self.story, self.named, self.link, self.listed = (up.article, up.story, up.named, up.link, up.listed) if up else (False, None, False, False, False)
        #: What is said against the element, the nearest one around (itself too) of which something is, prose with that nearest one,
        #: whether it holds an article, and the cost of all around once it is known.
        self.bad, self.hard, self.flag, self.prose, self.holds, self.told = 0.0, False, up.flag if up else None, 0, False, None
        if tag == "a":
            self.link = True
        elif tag == "li":
            self.listed = True
        names, role, gone = _named(attrs) if attrs else ((), "", False)
        plain = tag in ("html", "body", "main")
        body = tag in ("article", "main") or role in ("main", "article")
        bad, content = 0.0, body
        for words in () if plain else names:
            b, c, h = spoken(words)
            bad, content, self.hard = min(bad, b), content or c, self.hard or h
        bad = min(0.0, bad + COSTS["own_content"]) if content else bad
        if tag in BOILER_TAGS and not (tag == "header" and self.article) or role in BOILER_ROLES or gone:
            bad, self.hard = COSTS["boilerplate"], self.hard or tag in HARD_TAGS
        if bad:
            self.bad, self.flag = bad, self
        if tag == "article" and bad > COSTS["named_by_head"]:
            self.story = self
        if body and bad > COSTS["named_by_head"] or ["articlebody"] in names:
            self.article, e = True, up
            while e and not e.holds:
                e.holds, e = True, e.up
        elif content and not plain:
            self.named = True

    def cost(self) -> float:
        """What is said against this element and those around it."""
        chain, e = [], self
        while e is not None and e.told is None:
            chain.append(e)
            e = e.up
        sum_ = e.told if e else 0.0
        for e in reversed(chain):
            sum_ = sum_ * DECAY + e.bad * (1.0 if e.hard else e.weight()) if e.bad else sum_ * DECAY
            e.told = sum_ = max(sum_, COSTS["boilerplate"])
        return self.told

    def weight(self) -> float:
        """How much of `bad` stands: all of it, unless the element holds an article or much prose and there is little outside."""
        outside, e = 0, self.up
        while e:  # the flagged ones around, and the top
            e = e.flag if e.flag is not None else e
            while e.flag is None and e.up:
                e = e.up
            outside += e.prose
            e = e.up
        inside = 1.0 if self.holds else min(1.0, self.prose / PROSE)
        return 1.0 - inside * (1.0 - min(1.0, outside / PROSE_OUTSIDE))


def spoken(words: list[str]) -> tuple[float, bool, bool]:
    """What the words of one name say: log-odds of boilerplate, whether it names content, and whether no prose outweighs it."""
    bad = [w for w in words if w in BOILER_WORDS]
    if not bad:
        return 0.0, any(w in CONTENT_WORDS for w in words), False
    if len(words) > 1 and (words[0] in ABOUT_FIRST or words[-1] in ABOUT_LAST or TITLE_WORDS.intersection(words)):
        return 0.0, False, False
    rest = [w for w in words if w not in BOILER_WORDS and w not in FRAME_WORDS and not w.isdigit()]
    if bad == ["header"] and CONTENT_WORDS.intersection(words):
        return 0.0, False, False
    hard = bool(HARD_WORDS.intersection(bad))
    if not rest:
        return COSTS["boilerplate"], False, hard
    if words[-1] in BOILER_WORDS or CONTENT_WORDS.issuperset(rest):
        return COSTS["boilerplate"] if hard or CONTENT_WORDS.issuperset(rest) else COSTS["named_by_head"], False, hard
    return COSTS["named_in_part"], False, False


def _named(attrs: str) -> tuple[list[list[str]], str, bool]:
    """The words of each name in class and id, the role, and whether the element is hidden."""
    names, role, gone = [], "", False
    for name, value in _ATTR.findall(attrs):
        name, value = name.lower(), value.strip("\"'")
        if name in ("class", "id"):
            names += [[w.lower() for w in _WORD.findall(token)] for token in value.split()]
        elif name == "role":
            role = value.lower()
        elif name == "itemprop":
            names.append([value.lower()])
        elif name == "style":
            gone = gone or bool(re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value, re.I))
        elif name == "hidden" or value.lower() == "true":
            gone = True
    return names, role, gone


class Block:
    __slots__ = ("text", "at", "linked", "tag")

    def __init__(self, text: str, at: Element, linked: int) -> None:
        self.text, self.at, self.linked, self.tag = text, at, linked, at.tag


def _ends(page: str):
    """A function of where a tag's attributes begin: where its > is, outside of quotes; -1 if there is none.  Quotes without a partner are
    plain.  What led to no end is remembered, so that a page is read in linear time."""
    dead, none = set(), {}

    def end(at: int) -> int:
        seen = []
        while m := _QUOTE.search(page, at):
            q, i = m[0], m.start()
            if q == ">":
                return i
            if i in dead:
                break
            seen.append(i)
            j = page.find(q, i + 1) if i < none.get(q, len(page)) else -1
            if j < 0:
                none[q] = min(i, none.get(q, i))
            at = max(j, i) + 1
        dead.update(seen)
        return -1

    return end


def blocks(page: str) -> list[Block]:
    """The text blocks of a page, in order."""
    top = Element("", None, "")
    now, found, parts, linked, holder = top, [], [], 0, top

    def close() -> None:
        nonlocal linked
        if parts:
            text = " ".join("".join(parts).split())
            if text:
                found.append(Block(text, holder, min(linked, len(text))))
            parts.clear()
            linked = 0

    def say(raw: str) -> None:
        nonlocal linked, holder
        if now.mute:
            return
        if not parts:
            if raw.isspace():
                return
            holder = now
            while holder.up and holder.tag in INLINE and holder.flag is holder.up.flag:
                holder = holder.up
        text = html.unescape(raw) if "&" in raw else raw
        parts.append(text)
        if now.link:
            linked += len(text.strip())

    at, size, end_of, ended = 0, len(page), _ends(page), False
    while at < size:
        m = _TAG.search(page, at)
        if not m:
            say(page[at:])
            break
        if m.start() > at:
            say(page[at : m.start()])
        at = m.end()
        tag = m[2]
        if not tag:
            if len(m[0]) == 2:  # a declaration
                close_at = -1 if ended else page.find(">", at)
                ended = close_at < 0
                at = at if ended else close_at + 1
                if ended:
                    say(m[0])
            continue
        close_at = -1 if ended else end_of(at)
        if close_at < 0 and (ended or (close_at := page.find(">", at)) < 0):
            ended = True
            say(m[0])
            continue
        attrs, at = page[at:close_at], close_at + 1
        tag = tag.lower()
        if now.mute and now.mute.loose and tag in BREAKS and not m[1]:
            now = now.mute.up
        if tag in MUTE and not m[1]:
            if not attrs.endswith("/"):
                same = _SAME[tag].search(page, at)
                now = Element(tag, now, "")
                if not now.mute:
                    now.mute, now.loose = now, not (same and same[1])
            continue
        if now.mute and tag not in RAW:
            e = now
            while e is not now.mute.up and e.tag != tag:
                e = e.up
            if not m[1]:
                if tag not in VOID and not attrs.endswith("/"):
                    now = Element(tag, now, "")
                continue
            if e is not now.mute.up:
                now = e.up
                continue
        if tag in RAW and not m[1]:
            if not attrs.endswith("/"):
                end = re.compile(rf"</{re.escape(tag)}\s*>", re.I).search(page, at)
                at = end.end() if end else size
            continue
        block = tag not in INLINE
        if block:
            close()
        if m[1]:
            e = now
            while e.up and e.tag != tag and (block or e.tag in INLINE):
                e = e.up
            if e.up and e.tag == tag:
                if e.flag is not e.up.flag:
                    close()
                now = e.up
        elif tag in VOID:
            if tag == "br" and parts:
                parts.append(" ")
        else:
            if block:
                e = now  # a block ends the paragraph, heading or item that cannot hold it, with what is open inside
                while e.up and e.tag in INLINE:
                    e = e.up
                if e.up and (e.tag == "p" or e.tag in HEADINGS and tag in HEADINGS):
                    now = e.up
                elif ends := ENDS.get(tag):
                    while e.up and e.tag in ends:
                        e = e.up
                        now = e
            if not attrs.endswith("/") or block:
                inner = Element(tag, now, attrs)
                if inner.flag is not now.flag:  # an advert in a line parts it
                    close()
                now = inner
    close()
    return found


def cost(b: Block, marked: bool, teasers: frozenset = frozenset()) -> float:
    """Log-odds of content.  marked: whether the page marks an article at all; teasers: articles that are none."""
    c, e = COSTS, b.at
    words = b.text.count(" ") + 1
    article = e.article and e.story not in teasers
    s = c["article"] if article else c["outside"] if marked else 0.0
    s += c["named_content"] * e.named
    s += c["paragraph"] if e.tag in ("p", "blockquote", "pre") else c["heading"] if e.tag in HEADINGS else 0.0
    share = b.linked / max(len(b.text), 1)
    s += c["linked"] * (share > 0.6) + c["some_links"] * (0.3 < share <= 0.6) + c["listed_link"] * (e.listed and share > 0.6)
    s += c["long"] * (words >= 12) + c["sentences"] * bool(words >= 5 and _END.search(b.text))
    if not article:
        s += c["short"] * (words < 4) + c["rights"] * bool(words < 40 and _RIGHTS.search(b.text))
    told = e.cost()
    # What is wholly boilerplate by name is so whatever its text is like.
    return told if told <= c["boilerplate"] * DECAY**8 else s + told


def labels(found: list[Block]) -> list[bool]:
    """Whether each block is content."""
    c = COSTS
    stories: dict[Element, int] = {}
    for b in found:
        e = b.at
        words = b.text.count(" ") + 1
        if words >= 5 and b.linked <= 0.3 * len(b.text):
            if e.story is not None and e.flag in (None, e.story.flag):
                stories[e.story] = stories.get(e.story, 0) + words
            if (f := e.flag) is None:
                f = e
                while f.up:
                    f = f.up
            f.prose += words
    most = max(stories.values(), default=0)
    around = {max(stories, key=stories.get, default=None)}
    for e in list(around):
        while e:
            around.add(e)
            e = e.up
    teasers = frozenset(s for b in found if (s := b.at.story) is not None and s not in around and stories.get(s, 0) < TEASER * most)
    marked = any(b.at.article and b.at.cost() > c["named_by_head"] for b in found)
    excess = [cost(b, marked, teasers) for b in found]
    apart = lambda p, q: abs(p.cost() - q.cost()) > 1.5
    flow = Flow(excess)
    for i, b in enumerate(found):
        e, child = b.at, i
        weight = c["parent"]
        while e.up:
            fresh = e.node < 0
            if fresh:
                e.node = flow.node()
            flow.join(child, e.node, weight * (c["border"] if apart(e.up, e) else 1))
            if not fresh:
                break
            child, e, weight = e.node, e.up, c["up"]
        if i:
            p, q = found[i - 1].at, b.at
            near = c["next_sibling"] if p is q or p.up is q.up else c["next_cousin"] if p.up and q.up and p.up.up is q.up.up else c["next"]
            flow.join(i - 1, i, near * (c["border"] if apart(p, q) else 1))
    for b in found:
        e = b.at
        while e and e.node >= 0:
            e.node, e = -1, e.up
    return flow.source_side()[: len(found)]


class Flow:
    """Maximum flow with the terminals implied: a node's excess is its capacity from the source, or if negative to the sink."""

    def __init__(self, excess: list[float]) -> None:
        self.excess, self.out = list(excess), [[] for _ in excess]
        self.to, self.cap = [], []

    def node(self) -> int:
        self.excess.append(0.0)
        self.out.append([])
        return len(self.excess) - 1

    def join(self, a: int, b: int, weight: float) -> None:
        """An edge of that weight in both directions; each is the other's residual."""
        self.out[a].append(len(self.to))
        self.out[b].append(len(self.to) + 1)
        self.to += [b, a]
        self.cap += [weight, weight]

    def levels(self) -> tuple[list[int], bool]:
        level, found = [-1] * len(self.excess), False
        queue = [i for i, x in enumerate(self.excess) if x > 1e-12]
        for i in queue:
            level[i] = 0
        for i in queue:  # grows while it is read
            if self.excess[i] < -1e-12:
                found = True
                continue
            for e in self.out[i]:
                if self.cap[e] > 1e-12 and level[self.to[e]] < 0:
                    level[self.to[e]] = level[i] + 1
                    queue.append(self.to[e])
        return level, found

    def source_side(self) -> list[bool]:
        if not any(x < 0 for x in self.excess) or not any(x > 0 for x in self.excess):
            return [x > 0 for x in self.excess]
        while True:
            level, found = self.levels()
            if not found:
                return [x >= 0 for x in level]
            tried = [0] * len(level)
            for source in [i for i, x in enumerate(self.excess) if x > 1e-12]:
                path, i = [], source
                while self.excess[source] > 1e-12:
                    if self.excess[i] < -1e-12:  # a sink side node: send what the path carries
                        much = min(self.excess[source], -self.excess[i], *(self.cap[e] for e in path))
                        for e in path:
                            self.cap[e] -= much
                            self.cap[e ^ 1] += much
                        self.excess[source] -= much
                        self.excess[i] += much
                        path, i = [], source
                        continue
                    edges = self.out[i]
                    while tried[i] < len(edges):
                        e = edges[tried[i]]
                        if self.cap[e] > 1e-12 and level[self.to[e]] == level[i] + 1:
                            break
                        tried[i] += 1
                    if tried[i] < len(edges):
                        path.append(e)
                        i = self.to[e]
                    elif path:
                        level[i] = -2
                        i = self.to[path.pop() ^ 1]
                    else:
                        break


def main_text(page: str | None) -> tuple[str, int, int]:
    """The main text of a page, its number of blocks and of those kept."""
    found = blocks(page or "")
    kept = [b.text for b, keep in zip(found, labels(found), strict=True) if keep] if found else []
    return " ".join(kept), len(found), len(kept)


def extracted(pages: DataFrame, page_id: str = "page_id", url: str = "url", page: str = "html") -> DataFrame:
    """page_id, url, text, n_chars, n_blocks, n_kept of each page."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in common.slices(batches, "html"):
            out = [main_text(h) for h in common.texts(batch, "html")]
            yield pa.RecordBatch.from_arrays(
                [
                    *batch.columns[:2],
                    pa.array([t for t, _, _ in out], pa.string()),
                    *(pa.array(x, pa.int64()) for x in ([len(t) for t, _, _ in out], [n for _, n, _ in out], [k for _, _, k in out])),
                ],
                ["page_id", "url", "text", "n_chars", "n_blocks", "n_kept"],
            )

    source = pages.select(F.col(page_id).alias("page_id"), F.col(url).alias("url"), F.col(page).alias("html"))
    kinds = ", ".join(f"{c} {source.schema[c].dataType.simpleString()}" for c in ("page_id", "url"))
    return common.mapped(source, run, f"{kinds}, text string, n_chars long, n_blocks long, n_kept long")
