"""Main text of web pages by tag-path ratios.

A page is read once into text blocks, each with its path of block tags and classes from the root.  Text length and
punctuation are aggregated per path: the text by the root of the number of the path's blocks, so that both long blocks and much
text count, the punctuation by a block.  Both ratios are smoothed over neighbouring blocks, these weighed by how much of their
paths is one, fused by multiplication and averaged per path again: the path's score.  A heading counts as the best of the
blocks that it heads.  Priors weigh the scores, mildly on a page with text enough for ratios to tell: names (class, id, role)
that say no content, standing outside an <article> or <main> where the page has text in one, and the share of links.  On a
page with little text they weigh more, by a power that grows as the text gets less.

Paths whose score reaches `share` of the text-weighted mean score of paths without names against them are content, and so are
those of prose that reach a lower bar, such as the lede of a story whose text lies in another element.  With them go paths that no name speaks against and that lie between or, not in links only, around them (`content_paths`), so titles,
bylines, short lines, linked lists and captions of an article stay.  What is returned are the blocks of these paths, and of no
other.

As scores count against the page's own mean, a name that wraps a whole page changes nothing.  A name says no content by a
whole name, not by a part of one (`no-comments`, `has-sidebar`), and is not believed of most of a page's sentences, unless an
<article> or <main> has text elsewhere; adverts, which may outgrow an article, are believed unless there are no other
sentences.  What HTML itself names as no content (navigation, page headers and footers, asides, forms, scripts) or hides is
never read, and neither are reader comments by name, as their ratios are those of an article, unless a page has no other
sentences.

Null, empty and text-less pages give an empty text.  Tags may be unclosed, unopened or badly nested.  Whole pages are read,
in time linear in their length, however long.  Scores that tie with a threshold reach it.  An empty table gives no rows;
repeated rows give repeated results; other columns, whatever their names, are not read.
"""

from __future__ import annotations

import html
import re
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from . import common

TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>|<(/?)([a-zA-Z][^\s/>]*+)([^>]*+)>|<[!?/][^>]*+(?:>|\Z)", re.S)
ATTRIBUTE = re.compile(r"([^\s\"'<>/=]++)(?:\s*+=\s*+(?:\"([^\"]*+)\"?|'([^']*+)'?|([^\s\"'>]++)))?+")
WORD = re.compile(r"[a-z]+")
PUNCTUATION = re.compile(r"[.,;:!?、。，…¿¡]")

# Names of HTML elements.
RAW = frozenset("script style textarea title xmp noembed noframes".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
LEFT_OUT = frozenset("head nav footer header aside form noscript template menu dialog button select datalist iframe canvas audio video map".split())
BLOCK = frozenset("html body address article aside blockquote center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: What a start tag ends, if it is the innermost of its kind.
ENDS = {"li": {"li"}, "dd": {"dd", "dt"}, "dt": {"dd", "dt"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}}
#: Words of class, id or role that say: no article text.
NO_CONTENT = frozenset(
    "ad ads advert adverts advertisement advertising banner breadcrumb breadcrumbs comment comments complementary consent contentinfo cookie cookies disclaimer disqus footer gdpr header login masthead menu modal nav navbar navigation newsletter notice notices overlay pager pagination popup promo promoted promotion recommend recommended related search share sharing sidebar signup skip social sponsor sponsored subscribe subscription toolbar widget widgets".split()
)
#: Of these, what names text of readers, which nothing in its ratios tells from an article.
REMARKS = frozenset("comment comments disqus".split())
#: Of these, what names text of others, which may be longer than the article, and not a place on the page.
OTHERS = frozenset("ad ads advert adverts advertisement advertising banner comment comments consent cookie cookies disqus gdpr newsletter popup promo promoted promotion sponsor sponsored subscribe subscription".split())
#: What may stand beside these words in one name, as in `comment-list`; with any other word it's another thing.
PARTS = frozenset(
    "a above area bar bars below block body bottom box btn button buttons center col column container content custom default desktop element entry first fixed form frame global group holder icon icons id image inline inner item items js large last layer layout left link links list local main mobile module outer page panel policy post posts primary right row secondary section site slot small spot sticky strip tab tabs template text thread title top ui unit view wp wrap wrapper x zone".split()
)


@dataclass
class Element:
    tag: str
    path: int
    parent: Element | None = None
    out: bool = False  # in a part that is left out
    remark: bool = False  # in readers' comments
    inside: bool = False  # in an article
    heading_only: bool = False
    first: int = 0  # blocks first to last - 1 lie below it
    last: int = -1
    children: list[Element] = field(default_factory=list)


@dataclass
class Block:
    text: str
    element: Element
    linked: int  # characters inside links, at most


@dataclass
class Path:
    parent: int
    says: str  # NAMED, HEADER, OTHER or REMARK: its last element's name says that it's no content
    inside: bool  # in an article


HIDDEN, NAMED, HEADER, OTHER, REMARK = "hidden", "named", "header", "other", "remark"


def _says_no(attributes: str) -> str:
    """HIDDEN, NAMED, HEADER, OTHER or REMARK for what is no content by its attributes, else empty."""
    said = ""
    for name, a, b, c in ATTRIBUTE.findall(attributes):
        name = name.lower()
        value = (a or b or c).lower()
        if name == "hidden" or name == "aria-hidden" and value == "true" or name == "style" and "display:none" in value.replace(" ", ""):
            return HIDDEN
        if name in ("class", "id", "role"):
            for token in value.split():
                words = WORD.findall(token)
                against = NO_CONTENT.intersection(words)
                if against and all(w in NO_CONTENT or w in PARTS for w in words):
                    now = REMARK if not REMARKS.isdisjoint(words) else OTHER if not OTHERS.isdisjoint(words) else HEADER if against == {"header"} else NAMED
                    said = max(said, now, key=("", HEADER, NAMED, OTHER, REMARK).index)
    return said


def _class(attributes: str) -> str:
    for name, a, b, c in ATTRIBUTE.findall(attributes):
        if name.lower() == "class":
            return "." + (a or b or c).strip().lower()
    return ""


def _sentences(text: str) -> int:
    return len(text) if PUNCTUATION.search(text) else 0


def parse(page: str, names: bool = True) -> tuple[list[Block], Element, list[Path]]:
    """Text blocks in page order, each with its element, the root, and the paths by number.  Without `names`, inline parts
    are not left out for theirs."""
    root = Element("", 0)
    here, blocks, text = root, [], []
    paths, numbers = [Path(0, "", False)], {}
    inline: list = []  # an inline part that says it is no content: its tag, how often that is open, the text before, how it says so
    remarks = 0  # sentences in readers' comments
    dropped = 0  # sentences of inline parts left out for their names
    link, linked = False, 0

    def drop() -> None:
        nonlocal dropped
        if inline[3] != HIDDEN and not here.out:
            dropped += _sentences("".join(text[inline[2] :]))
        del text[inline[2] :]
        inline.clear()

    def close() -> None:
        nonlocal link, linked, remarks
        if inline:
            drop()
        joined = " ".join(html.unescape("".join(text)).split())
        text.clear()
        if here.remark:
            remarks += _sentences(joined)
        if joined and not here.out and not (here.heading_only and here.tag not in HEADINGS):
            blocks.append(Block(joined, here, min(linked, len(joined))))
        link, linked = False, 0

    def leave(to: Element) -> Element:
        """Ends all elements up to `to`, which stays open."""
        e = here
        while e is not to:
            e.last = len(blocks)
            e = e.parent
        return to

    at, n, lower = 0, len(page), None
    while at < n:
        token = TOKEN.search(page, at)
        until = n if token is None else token.start()
        if until > at:
            text.append(page[at:until])
            if link:
                linked += until - at
        if token is None:
            break
        at = token.end()
        tag = token[2] or token[5]
        if not tag:
            continue
        tag = tag.lower()
        block = tag in BLOCK or tag in LEFT_OUT
        if token[1] or token[4]:
            if block:
                to = here
                while to is not root and to.tag != tag:
                    to = to.parent
                close()
                if to is not root:
                    here = leave(to.parent)
            else:
                if tag == "a":
                    link = False
                if inline and inline[0] == tag:
                    inline[1] -= 1
                    if not inline[1]:
                        drop()
            continue
        attributes = token[3] or token[6] or ""
        if tag in RAW:
            if lower is None:
                lower = re.sub(r"[A-Z]", lambda m: m[0].lower(), page)
            end = lower.find(f"</{tag}", at)
            at = n if end < 0 else page.find(">", end) + 1 or n
            continue
        if tag == "br":
            text.append("\n")
            continue
        if tag in VOID and tag != "hr":
            continue
        no = _says_no(attributes) if attributes and not attributes.isspace() else ""
        if not block:
            link = link or tag == "a"
            if inline and inline[0] == tag:
                inline[1] += 1
            elif no and not inline and (names or no == HIDDEN):
                inline[:] = tag, 1, len(text), no
            continue
        close()
        if tag in BLOCK and here.tag == "p":
            here = leave(here.parent)
        if tag == "hr":
            continue
        if tag in ENDS:
            to = here
            while to is not root and to.tag not in ENDS[tag] and to.tag not in ("ul", "ol", "dl", "table"):
                to = to.parent
            if to.tag in ENDS[tag]:
                here = leave(to.parent)
        own_header = tag == "header" and here.inside
        remark = here.remark or names and no == REMARK and tag not in ("html", "body", "main")
        out = here.out or remark or tag in LEFT_OUT and not own_header or no == HIDDEN and tag not in ("html", "body", "article", "main")
        says = "" if tag in ("html", "body", "main") or tag == "article" and no not in (OTHER, REMARK) else no
        key = here.path, tag + _class(attributes), says
        path = numbers.setdefault(key, len(paths))
        if path == len(paths):
            paths.append(Path(here.path, says, paths[here.path].inside or tag in ("article", "main") and not says))
        child = Element(tag, path, here, out, remark, paths[path].inside, here.heading_only or own_header, len(blocks))
        here.children.append(child)
        here = child
    close()
    leave(root)
    root.last = len(blocks)
    read = sum(_sentences(b.text) for b in blocks)
    if dropped > read or remarks and not read:
        return parse(page, False)
    return blocks, root, paths


def _named(blocks: list[Block], paths: list[Path]) -> tuple[np.ndarray, np.ndarray]:
    """For each path, whether names on it that are believed say no content; and the same without names of headers."""
    n = len(paths)
    sums = np.zeros((3, n), np.int64)  # below each path: characters of sentences, of all text, of text in an article
    for b in blocks:
        sums[:, b.element.path] += _sentences(b.text), len(b.text), len(b.text) * b.element.inside
    for p in range(n - 1, 0, -1):  # a path has a larger number than its parent
        sums[:, paths[p].parent] += sums[:, p]
    sentences, text, marked = sums
    named, other_named = np.zeros(n, bool), np.zeros(n, bool)
    for p in range(1, n):
        path = paths[p]
        believed = False
        if path.says:
            other = int(sentences[0] - sentences[p])
            elsewhere = not path.inside and marked[0] > marked[p]
            believed = int(sentences[p]) <= other or elsewhere or path.says in (OTHER, REMARK) and bool(other or 2 * text[p] <= text[0])
        named[p] = named[path.parent] or believed
        other_named[p] = other_named[path.parent] or believed and path.says != HEADER
    return named, other_named


KERNEL = 0.25, 0.5, 0.25
#: Priors of paths that names speak against, of those outside the page's <article> or <main>, and of text that is all links.
AGAINST, OUTSIDE, LINKS = 0.5, 0.7, 0.5
#: Characters of text at which priors count twice: of little text ratios tell little.
LITTLE = 250


def likeness(paths: list[Path], a: int, b: int) -> float:
    """The part of two paths, from the root, that is one, squared."""
    if a == b:
        return 1.0
    up, other = [a], [b]
    for chain in (up, other):
        while chain[-1]:
            chain.append(paths[chain[-1]].parent)
    same = sum(x == y for x, y in zip(reversed(up), reversed(other), strict=False)) - 1  # the root, which has no tag, is in all
    return (same / (max(len(up), len(other)) - 1)) ** 2


def smooth(x: np.ndarray, alike: np.ndarray) -> np.ndarray:
    """Means over each block and its neighbours, these weighed by the likeness of their paths (`alike`, between i and i + 1)."""
    left, right = np.concatenate([[0.0], alike]) * KERNEL[0], np.concatenate([alike, [0.0]]) * KERNEL[2]
    y = np.pad(x, 1)
    return (y[:-2] * left + x * KERNEL[1] + y[2:] * right) / (left + KERNEL[1] + right)


def ratios(blocks: list[Block], of: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Text length and punctuation of the path of each block (`of`: its number), a block of it; a heading counts as the best of the
    blocks that it heads."""
    count = np.bincount(of)
    length = np.array([len(b.text) for b in blocks], float)
    points = np.array([len(PUNCTUATION.findall(b.text)) for b in blocks], float)
    ratio, marks = (np.bincount(of, length) / np.sqrt(count))[of], (np.bincount(of, points) / count)[of]
    best = (0.0, 0.0)
    headed = False
    for i in range(len(blocks) - 1, -1, -1):
        if blocks[i].element.tag not in HEADINGS:
            best = max(best, (ratio[i], marks[i])) if not headed else (ratio[i], marks[i])
            headed = False
        else:
            headed = True
            if best[0]:
                ratio[i], marks[i] = best
    return ratio, marks


def path_scores(blocks: list[Block], paths: list[Path]) -> tuple[dict[int, float], np.ndarray, set[int]]:
    """The score of each path that has blocks, the paths that believed names speak against, and those of prose: with punctuation in
    half of their blocks or more, and in an <article> or <main> where the page has text in one."""
    own = [b.element.path for b in blocks]
    number = {p: i for i, p in enumerate(dict.fromkeys(own))}
    of = np.array([number[p] for p in own])
    count = np.bincount(of)
    length = np.array([len(b.text) for b in blocks], float)
    linked = np.bincount(of, [float(b.linked) for b in blocks]) / np.bincount(of, length)
    named, _ = _named(blocks, paths)
    inside = any(b.element.inside for b in blocks)
    prior = {p: (AGAINST if named[p] else 1.0) * (OUTSIDE if inside and not paths[p].inside else 1.0) * (1 - (1 - LINKS) * linked[k]) for p, k in number.items()}
    free = sum(len(b.text) for b in blocks if not named[b.element.path])
    prior = {p: x ** (1 + (LITTLE / max(free, 1)) ** 2) for p, x in prior.items()}
    ratio, marks = ratios(blocks, of)
    alike = np.array([likeness(paths, a, b) for a, b in zip(own, own[1:], strict=False)])
    fused = smooth(ratio, alike) * np.sqrt(1 + smooth(marks, alike))
    score = np.bincount(of, fused) / count
    prose = {p for p, i in zip(own, range(len(own)), strict=True) if marks[i] >= 0.5 and (paths[p].inside or not inside)}
    return {p: float(score[k]) * prior[p] for p, k in number.items()}, named, prose


def content_paths(blocks: list[Block], root: Element, paths: list[Path], share: float = 0.3, low: float = 0.02) -> set[int]:
    """Paths whose score reaches `share` of the text-weighted mean, paths of prose (`path_scores`) without names against them that
    reach `low` of it, and those that go with them.

    These are paths that no name speaks against, with most of their text between the first and the last block of the former, or
    else in the smallest element that holds all of these and not in links only, if it isn't in an <article> or <main>."""
    scores, named, prose = path_scores(blocks, paths)
    length = [len(b.text) for b in blocks]
    plain = [(scores[b.element.path], n) for b, n in zip(blocks, length, strict=True) if not named[b.element.path]]
    plain = plain or [(scores[b.element.path], n) for b, n in zip(blocks, length, strict=True)]
    mean = sum(x * n for x, n in plain) / sum(n for _, n in plain)
    content = {p for p, x in scores.items() if x >= share * mean or p in prose and not named[p] and x >= low * mean}
    chosen = [i for i, b in enumerate(blocks) if b.element.path in content]
    here = root
    while inner := next((c for c in here.children if c.first <= chosen[0] and chosen[-1] < c.last), None):
        here = inner
    whole, within = dict.fromkeys(scores, 0), dict.fromkeys(scores, 0)
    for i, b in enumerate(blocks):
        between, in_here = chosen[0] <= i <= chosen[-1], here.first <= i < here.last
        whole[b.element.path] += length[i]
        within[b.element.path] += length[i] * (between or in_here and (b.element.inside or b.linked < length[i]))
    return content | {p for p in scores if not named[p] and 2 * within[p] > whole[p]}


def main_text(page: str | None) -> str:
    """The blocks of content paths, in page order, one a line."""
    if not page:
        return ""
    blocks, root, paths = parse(page)
    if not blocks:
        return ""
    chosen = content_paths(blocks, root, paths)
    return "\n".join(b.text for b in blocks if b.element.path in chosen)


def extract(pages: DataFrame, html_col: str = "html", keep: tuple[str, ...] = ("page_id", "url"), name: str = "text") -> DataFrame:
    """`keep`, the main text and n_chars, its number of code points."""
    rows = pages.select(*keep, common.as_bytes(html_col).alias("_html"))

    def run(batches):
        for b in batches:
            texts = [main_text(x.decode("utf-8", "replace")) for x in b.column(len(keep)).to_pylist()]
            yield pa.RecordBatch.from_arrays(b.columns[: len(keep)] + [pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=[*keep, name, "n_chars"])

    kinds = [f"`{f.name}` {f.dataType.simpleString()}" for f in rows.select(*keep).schema]
    return rows.mapInArrow(run, ", ".join([*kinds, f"`{name}` string", "n_chars long"]))
