"""Main text of web pages by minimum-cut labelling of blocks.

A page is read into blocks of text in page order, in one pass that looks at each character a fixed number of times. A
linear classifier of tags, names of containers, share of form fields, length and link share gives each block a log odds for
content; it becomes the capacity of the block's edge to the source (content) or to the sink (boilerplate). Neighbouring blocks,
and a container's blocks that follow each other there, are tied by smoothness edges, the stronger the closer they
are in the tree. The minimum cut is the cheapest labelling, and what stays with the source is the text.

All weights are natural log odds. An element or name that is nearly always boilerplate has -12 (one in 160,000 is content), enough
against any evidence of length, of ties and of containers of content, whose sum is at most 5. Two neighbours next to each other in one container have the same label 19 times
out of 20, ln 19 = 3 at a distance of two steps in the tree, and less with the square of the distance further apart; so the ties decide blocks
whose own evidence is below six, such as a one-word paragraph inside of a text or a full sentence among links.

A block whose own capacity reaches the sum of its ties keeps its side in some minimum cut, so it is settled first and
its ties are added to its neighbours' capacities; maximum flows run on the groups that are left.

Defined cases: null and empty html give the empty text; scripts, styles, comments and other parts
that are never shown have no blocks; very long and very deep pages take time and memory in proportion to their length; an element that is not closed ends with its container, an unclosed comment or script
with the page; references are decoded once; every input row gives one output row.
"""

from __future__ import annotations

import html
import math
import re
from collections import deque
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, LongType, StringType, StructField, StructType

from srcatlas.llm.common import Batches, id_field, map_batches, two_columns

# Names of elements as the HTML standard groups them.
RAW = {"script", "style", "title", "textarea", "noscript", "template", "iframe", "svg", "select", "noframes", "xmp"}
VOID = {"br", "img", "hr", "input", "meta", "link", "wbr", "area", "base", "col", "embed", "source", "track", "param"}
INLINE = {
    "a", "abbr", "acronym", "b", "bdi", "bdo", "big", "br", "cite", "code", "data", "del", "dfn", "em", "font", "i", "img", "ins", "kbd",
    "label", "mark", "q", "rp", "rt", "ruby", "s", "samp", "small", "span", "strike", "strong", "sub", "sup", "time", "tt", "u", "var", "wbr",
}
#: An element that begins ends these if they are open in the same container.
ENDS = {"p": {"p"}, "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}}
ENDS |= {name: {"p"} for name in ("div", "ul", "ol", "section", "article", "table", "h1", "h2", "h3", "h4", "h5", "h6", "pre", "form", "nav", "aside", "header", "footer", "main", "blockquote", "dl", "figure", "hr", "address")}
SCOPES = {"ul", "ol", "table", "div", "section", "article", "body", "html", "nav", "aside", "header", "footer", "main", "form", "dl", "blockquote", "figure"}

#: Log odds that a container adds to all blocks inside.
CONTAINERS = {
    "article": 4.0, "main": 3.0, "nav": -12.0, "footer": -12.0, "aside": -12.0, "menu": -12.0, "dialog": -12.0, "button": -12.0,
    "header": -5.0, "fieldset": -12.0, "head": -20.0,
}
#: Names of content; a container whose class, id or role begins with one, alone, is named as content.
CONTENT = set("article content entry main post story".split())
#: Log odds by the names in a container's class, id or role.
NAMES = dict.fromkeys(
    ("ad ads advert adverts advertisement advertising banner breadcrumb breadcrumbs comment comments consent cookie cookies copyright disclaimer "
     "disqus footer gdpr login masthead menu modal nav navbar navigation newsletter notice pagination popup promo promotion recommended related "
     "replies reply respond search share sharing sidebar signup skip social sponsor sponsored subscribe subscription tags toolbar widget "
     "alert complementary contentinfo alertdialog").split(),
    -12.0,
) | dict.fromkeys(CONTENT, 1.5) | {"header": -5.0}
#: A token that begins with one of these tells a state or a layout.
STATES = set("has have is no not with without show hide layout".split())
#: Words behind a name that still mean the container of that name, or a part of it.
PARTS = set(
    ("area articles author bar block body box button buttons container content date field form group head heading icon icons image images inner "
     "input item items label link links list message meta metadata outer overlay panel posts region section slot stories "
     "loop query text thread title to toggle top trail unit widgets wrap wrapper").split()
)
#: Words before a name that only tell who made it.
MAKERS = set("wp block js component module".split())
#: Elements that are filled in, and what one of them weighs against characters of text in a form.
FIELDS = {"input", "select", "textarea", "button"}
FIELD_CHARS, FORM = 40, -12.0
#: Log odds of a block's own element.
BLOCKS = {"p": 1.0, "h1": 1.0, "h2": 1.0, "h3": 1.0, "h4": 0.5, "h5": 0.5, "h6": 0.5, "blockquote": 1.0, "pre": 1.0, "li": -0.3}
BIAS, PER_LOG_WORD, LINKS = -1.5, 0.8, -5.0
#: Containers of content together add at most this.
MOST = 5.0
ADJACENT, SIBLING = 12.0, 1.0

_TAG = re.compile(r"<(/?)([a-zA-Z][^\s/>]*)(?:((?:\"[^\"]*\"|'[^']*'|[^\"'>])*+)>|([^>]*)>)", re.S)
_NAMED = re.compile(r"\b(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)
_HIDDEN = re.compile(r"\bhidden\b(?!\s*=\s*[\"']?false)|display\s*:\s*none|aria-hidden\s*=\s*[\"']?true", re.I)
_WORD = re.compile(r"[a-z]+")


class Block:
    """Text of one block with what the classifier and the ties need.

    ``depth`` counts the containers around it, ``lowest`` is the least depth since the block before, ``above`` the container of its own
    one, ``form`` the form it is in.
    """

    __slots__ = ("odds", "parts", "linked", "tag", "depth", "lowest", "above", "form")

    def __init__(self, odds: float, tag: str, depth: int, lowest: int, above: int, form: int):
        self.odds, self.tag, self.depth, self.lowest, self.above, self.form = odds, tag, depth, lowest, above, form
        self.parts: list[str] = []
        self.linked = 0

    def text(self) -> str:
        """White space turned into single blanks."""
        return " ".join("".join(self.parts).split())

    def logit(self, text: str) -> float:
        """The classifier."""
        size = len(text)
        words = text.count(" ") + 1
        share = min(1.0, self.linked / size)
        return BIAS + self.odds + BLOCKS.get(self.tag, 0.0) + PER_LOG_WORD * min(3.0, math.log(words + 1)) + LINKS * share


@lru_cache(maxsize=1 << 14)
def _token_odds(token: str) -> tuple[float, float]:
    """Log odds for and against content of a whole token: by any of its words, and by its name.

    The name is the last word, or the first one if the others are ``PARTS``.
    """
    words = _WORD.findall(token)
    good = sum(NAMES[w] for w in words if w in CONTENT)
    words = [w for w in words if len(w) > 1]
    while len(words) > 1 and words[0] in MAKERS:
        words = words[1:]
    if not words or words[0] in STATES:
        return good, 0.0
    bad = min(0.0, NAMES.get(words[-1], 0.0))
    if not bad and all(w in PARTS or NAMES.get(w, 0.0) < 0 for w in words[1:]):
        bad = min(0.0, NAMES.get(words[0], 0.0))
    return good, bad


def _odds(tag: str, attributes: str, doubted: bool = False) -> float:
    """Log odds of a container. ``doubted``: it lies in boilerplate, or is an article inside another.

    Names on the page's root say nothing about a part of it. Names against content in the class or id of an article, of
    main or of a container named as content are states or topics, unless it is doubted.
    """
    odds = CONTAINERS.get(tag, 0.0)
    if attributes:
        if tag not in ("html", "body"):
            found = [(name.lower(), (a or b or c).lower().split()) for name, a, b, c in _NAMED.findall(attributes)]
            content = not doubted and (tag in ("article", "main") or any(tokens[:1] and tokens[0] in CONTENT for _, tokens in found))
            for name, tokens in found:
                for good, bad in map(_token_odds, tokens):
                    odds += good + (0.0 if content and name != "role" else bad)
        if _HIDDEN.search(attributes):
            odds -= 12.0
    return max(odds, -20.0)


class _Open:
    """An open element: log odds so far, links open, and what lies around it."""

    __slots__ = ("tag", "odds", "links", "depth", "number", "above", "block", "scope", "form")

    def __init__(self, tag: str, odds: float, links: int, around: _Open | None, place: int, number: int, form: int):
        self.tag, self.odds, self.links, self.form = tag, odds, links, form
        inline = tag in INLINE and around is not None
        # The nearest element that isn't inline, with its number and depth.
        self.block = around.block if inline else tag
        self.depth = around.depth if inline else around.depth + 1 if around else 1
        self.number = around.number if inline else number
        self.above = around.above if inline else around.number if around else -1
        self.scope = place if tag in SCOPES else around.scope if around else 0


def _markup(page: str, at: int, last: int, last_section: int) -> tuple[int, int, re.Match | None]:
    """(start, end, tag) of the next markup from ``at``; no markup ends behind ``last``, the last ``>``."""
    while True:
        at = page.find("<", at)
        if at < 0:
            return len(page), len(page), None
        if page.startswith("<!--", at):
            end = page.find("-->", at + 4)
            return at, len(page) if end < 0 else end + 3, None
        if at > last:
            # Only an unclosed comment can still follow.
            at = page.find("<!--", at)
            return (at, len(page), None) if at >= 0 else (len(page), len(page), None)
        if at <= last_section and page.startswith("<![CDATA[", at):
            return at, page.find("]]>", at) + 3, None
        tag = _TAG.match(page, at)
        if tag:
            return at, tag.end(), tag
        if page[at + 1 : at + 2] in ("!", "?", "/"):
            return at, page.find(">", at) + 1, None
        at += 1


def read_blocks(page: str) -> list[Block]:
    """Blocks with text, in page order."""
    blocks: list[Block] = []
    current: Block | None = None
    stack = [_Open("", 0.0, 0, None, 0, 0, -1)]
    # Places of the open elements of each name, and (fields, characters) of each form.
    places: dict[str, list[int]] = {}
    forms: list[list[int]] = []
    serial, at, size, lowest = 0, 0, len(page), 1
    last, last_section = page.rfind(">"), page.rfind("]]>")

    def leave(place: int) -> None:
        while len(stack) > place:
            places[stack.pop().tag].pop()

    while at < size:
        start, end, found = _markup(page, at, last, last_section)
        if start > at:
            text = page[at:start]
            if "&" in text:
                text = html.unescape(text)
            top = stack[-1]
            if current is None and not text.isspace():
                lowest = min(lowest, top.depth)
                current = Block(top.odds, top.block, top.depth, lowest, top.above, top.form)
                lowest = top.depth
                blocks.append(current)
            if current is not None:
                current.parts.append(text)
                if top.links:
                    current.linked += len(text.strip())
                if top.form >= 0:
                    forms[top.form][1] += len(text.strip())
        at = end
        if found is None:
            continue
        closing, tag, attributes, loose = found.groups()
        attributes = attributes if attributes is not None else loose
        tag = tag.lower()
        if tag == "br" and current is not None:
            current.parts.append(" ")
        if tag not in INLINE:
            current = None
        if closing:
            if places.get(tag):
                leave(places[tag][-1])
                lowest = min(lowest, stack[-1].depth)
            continue
        if tag in FIELDS and stack[-1].form >= 0:
            forms[stack[-1].form][0] += 1
        if tag in RAW:
            if not attributes.endswith("/"):
                close = re.compile(rf"</{re.escape(tag)}\b", re.I).search(page, at)
                stop = page.find(">", close.end()) if close else -1
                at = stop + 1 if stop >= 0 else size
            continue
        if tag in ENDS:
            # Inside the nearest scope only.
            ended = max((p[-1] for t in ENDS[tag] if (p := places.get(t))), default=0)
            if ended > 0 and ended >= stack[-1].scope:
                leave(ended)
                lowest = min(lowest, stack[-1].depth)
        if tag in VOID or attributes.endswith("/"):
            continue
        top = stack[-1]
        odds = _odds(tag, attributes, top.odds < 0 or (tag == "article" and bool(places.get("article"))))
        if tag == "header" and (places.get("article") or places.get("main")):
            odds += 4.0  # the heading of the article itself
        serial += 1
        form = top.form
        if tag == "form":
            forms.append([0, 0])
            form = len(forms) - 1
        places.setdefault(tag, []).append(len(stack))
        stack.append(_Open(tag, min(MOST, top.odds + odds), top.links + (tag == "a"), top, len(stack), serial, form))
    for block in blocks:
        if block.form >= 0:
            fields, chars = forms[block.form]
            # A form that is mostly text is a page in a form.
            block.odds += FORM * FIELD_CHARS * fields / max(1, FIELD_CHARS * fields + chars)
    return blocks


def ties(blocks: list[Block]) -> dict[tuple[int, int], float]:
    """Smoothness edges between blocks: neighbours, and the next one of the same container."""
    out: dict[tuple[int, int], float] = {}
    last: dict[int, int] = {}
    for i, block in enumerate(blocks):
        if i:
            out[i - 1, i] = ADJACENT / max(2, blocks[i - 1].depth + block.depth - 2 * block.lowest) ** 2
        if block.above >= 0:
            if block.above in last and last[block.above] < i - 1:
                out[last[block.above], i] = out.get((last[block.above], i), 0.0) + SIBLING
            last[block.above] = i
    return out


def minimum_cut(logits: list[float], edges: dict[tuple[int, int], float]) -> list[bool]:
    """Whether each block is on the source's side of a minimum cut."""
    value = list(logits)
    near: list[dict[int, float]] = [{} for _ in logits]
    for (a, b), weight in edges.items():
        near[a][b] = near[a].get(b, 0.0) + weight
        near[b][a] = near[b].get(a, 0.0) + weight
    side: list[bool | None] = [None] * len(logits)
    ready = deque(range(len(logits)))
    while ready:
        i = ready.popleft()
        if side[i] is None and abs(value[i]) >= sum(near[i].values()):
            side[i] = value[i] > 0
            for j, weight in near[i].items():
                value[j] += weight if side[i] else -weight
                del near[j][i]
                ready.append(j)
            near[i] = {}
    for i in range(len(logits)):
        if side[i] is None:
            group, todo = {i}, [i]
            while todo:
                for j in near[todo.pop()]:
                    if j not in group:
                        group.add(j)
                        todo.append(j)
            for j, content in _maximum_flow({j: value[j] for j in group}, {j: near[j] for j in group}).items():
                side[j] = content
    return [bool(s) for s in side]


def _maximum_flow(value: dict[int, float], near: dict[int, dict[int, float]]) -> dict[int, bool]:
    """Shortest augmenting paths, one source after the other; True for what a source still reaches."""
    left = {i: dict(n) for i, n in near.items()}
    sink = {i: -v for i, v in value.items() if v < 0}
    tiny = 1e-12
    # What a source with capacity left reaches can't reach the sink any more, whatever flows elsewhere.
    kept: set[int] = set()
    for start, rest in value.items():
        while rest > tiny and start not in kept:
            came: dict[int, int | None] = {start: None}
            todo, end = deque([start]), None
            while todo:
                i = todo.popleft()
                if sink.get(i, 0.0) > tiny:
                    end = i
                    break
                for j, c in left[i].items():
                    if c > tiny and j not in came and j not in kept:
                        came[j] = i
                        todo.append(j)
            if end is None:
                kept.update(came)
                break
            path = [end]
            while came[path[-1]] is not None:
                path.append(came[path[-1]])
            path.reverse()
            flow = min([rest, sink[end], *(left[a][b] for a, b in zip(path, path[1:], strict=False))])
            rest -= flow
            sink[end] -= flow
            for a, b in zip(path, path[1:], strict=False):
                left[a][b] -= flow
                left[b][a] += flow
    return {i: i in kept for i in value}


def main_text(page: str | None) -> tuple[str, int, int]:
    """(text, blocks of the page, blocks kept)."""
    if not page:
        return "", 0, 0
    found = [(b, t) for b in read_blocks(page) if (t := b.text())]
    content = minimum_cut([b.logit(t) for b, t in found], ties([b for b, _ in found]))
    kept = [t for (_, t), keep in zip(found, content, strict=True) if keep]
    return "\n\n".join(kept), len(found), len(kept)


def extract(pages: DataFrame, id_col: str = "page_id", html_col: str = "html", url_col: str | None = "url") -> DataFrame:
    """(key, url, text, n_chars, n_blocks, n_kept) for every row; without ``url_col`` no url."""
    carried = [F.col(url_col).alias("url")] if url_col else []
    rows = two_columns(pages, id_col, html_col) if not url_col else pages.select(
        F.col(id_col).alias("id"), F.col(html_col).cast("string").alias("text"), *carried
    )
    fields = [id_field(pages, id_col)] + ([StructField("url", pages.schema[url_col].dataType, True)] if url_col else [])
    schema = StructType(
        [*fields, StructField("text", StringType()), StructField("n_chars", LongType()), StructField("n_blocks", IntegerType()), StructField("n_kept", IntegerType())]
    )

    def run(batches: Batches) -> Batches:
        for batch in batches:
            found = [main_text(page) for page in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    *([batch.column(2)] if url_col else []),
                    pa.array([t for t, _, _ in found], pa.string()),
                    pa.array([len(t) for t, _, _ in found], pa.int64()),
                    pa.array([n for _, n, _ in found], pa.int32()),
                    pa.array([n for _, _, n in found], pa.int32()),
                ],
                names=schema.names,
            )

    return map_batches(rows, run, schema)
