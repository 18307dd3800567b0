"""Tag-path scores against a plain recomputation, and pages on which single steps would go wrong."""

import math
import os
from html.parser import HTMLParser

import numpy as np
import pytest

from thermolith.llm import html_extract as h

STORY = "".join(f"<p>Sentence {i} of the story, which goes on, and on, for a while.</p>" for i in range(6))
TEXT = "\n".join(f"Sentence {i} of the story, which goes on, and on, for a while." for i in range(6))
LEDE = "What the story is about, said in one sentence."
PAGES = [
    f"<body><div class=top><a href=1>one</a></div><h1>Title</h1>{STORY}<ul><li>item<li>other, <a>linked</a> item</ul><div class=comments><h2>Said</h2><p>Good, so good.</p></div></body>",
    f"<body><div class=ad>Buy, now.</div><article><h1>Title</h1>{STORY}<h2>More</h2><p>Yes.</p></article><p>After all, that was it.</p></body>",
    f"<body><div class=x><div class=notice>{STORY}</div></div><div>z</div></body>",
    "<body><p>a</p></body>",
]


class Plain(HTMLParser):
    """Blocks (text, path from the root, linked characters) of well-formed pages, by the standard library."""

    BLOCKS = "html body div article main p h1 h2 ul li section blockquote".split()

    def __init__(self, page):
        super().__init__()
        self.path, self.text, self.link, self.linked, self.blocks = (), "", False, 0, []
        self.feed(page)
        self.close()
        self._end()

    def _end(self):
        if text := " ".join(self.text.split()):
            self.blocks.append((text, self.path, min(self.linked, len(text))))
        self.text, self.linked = "", 0

    def handle_starttag(self, tag, attrs):
        if tag in self.BLOCKS:
            self._end()
            name = dict(attrs).get("class")
            self.path += (tag + (f".{name}" if name else ""),)
        self.link = self.link or tag == "a"

    def handle_endtag(self, tag):
        if tag in self.BLOCKS:
            self._end()
            self.path = self.path[:-1]
        self.link = self.link and tag != "a"

    def handle_data(self, data):
        self.text += data
        self.linked += len(data) * self.link


def plain_scores(page, against=("ad", "notice", "related")):
    """Scores of paths in the order of their first blocks, step by step from the page's text."""
    blocks = Plain(page).blocks
    own = [b[1] for b in blocks]
    of = {p: [i for i, q in enumerate(own) if q == p] for p in own}
    total = {p: sum(len(blocks[i][0]) for i in of[p]) for p in of}
    inside = {p: any(x.split(".")[0] in ("article", "main") for x in p) for p in of}
    named = {p: any(x.endswith(f".{a}") for x in p for a in against) for p in of}
    free = sum(n for p, n in total.items() if not named[p])
    prior = {}
    for p in of:
        x = (0.5 if named[p] else 1) * (0.7 if any(inside.values()) and not inside[p] else 1) * (1 - 0.5 * sum(blocks[i][2] for i in of[p]) / total[p])
        prior[p] = x ** (1 + (250 / max(free, 1)) ** 2)
    length = [total[p] / math.sqrt(len(of[p])) for p in own]
    marks = [sum(c in ".,;:!?、。，…¿¡" for i in of[p] for c in blocks[i][0]) / len(of[p]) for p in own]
    heading = [p[-1] in ("h1", "h2") for p in own]
    ratio = list(zip(length, marks, strict=True))
    for i in range(len(blocks)):
        if heading[i]:
            k = i
            while k < len(blocks) and heading[k]:
                k += 1
            headed = []
            while k < len(blocks) and not heading[k]:
                headed.append(ratio[k])
                k += 1
            ratio[i] = max(headed, default=ratio[i])

    def near(i, k, column):
        """The value at k, and its weight for i."""
        if not 0 <= k < len(blocks):
            return 0, 0
        a, b = own[i], own[k]
        same = next((n for n, (x, y) in enumerate(zip(a, b, strict=False)) if x != y), min(len(a), len(b)))
        return ratio[k][column], 0.25 * (1 if a == b else (same / max(len(a), len(b))) ** 2)

    def smooth(i, column):
        (x, u), (z, w) = near(i, i - 1, column), near(i, i + 1, column)
        return (x * u + ratio[i][column] * 0.5 + z * w) / (u + 0.5 + w)

    fused = [smooth(i, 0) * math.sqrt(1 + smooth(i, 1)) for i in range(len(blocks))]
    return [prior[p] * sum(fused[i] for i in of[p]) / len(of[p]) for p in of]


WELL_FORMED = [
    f"<html><body><div class=ad>Buy, now.</div><article><h1>Title</h1>{STORY}<h2>More</h2><p>Yes.</p></article><p>After all, that was it.</p></body></html>",
    f"<html><body><div><a>one</a> <a>two</a></div><div class=story><h1>T</h1>{STORY}<ul><li>item</li><li>other, <a>linked</a> item</li></ul></div><div class=related><p><a>Read, too.</a></p></div></body></html>",
    "<html><body><h1>One</h1><h2>Two</h2><p>a</p><blockquote>Said, and done: yes.</blockquote></body></html>",
    f"<html><body><main><section><h2>A</h2>{STORY}</section><section><h2>B</h2><p>Short.</p><h2>C</h2></section></main><div class=notice>Mind. The. Gap.</div></body></html>",
]


@pytest.mark.parametrize("page", WELL_FORMED)
def test_scores(page):
    blocks, _, paths = h.parse(page)
    assert [b.text for b in blocks] == [b[0] for b in Plain(page).blocks]
    scores, _, _ = h.path_scores(blocks, paths)
    assert list(scores.values()) == pytest.approx(plain_scores(page))


#: Nothing but ratios tells the sections of these pages apart.
SECTIONS = [
    f"<body><div class=a><span>one</span></div><div class=b>{STORY}</div><div class=c>tags here</div></body>",
    f"<body><div class=x><p>Login</p></div><div class=y><h1>T</h1>{STORY}</div><div class=z><p>All rights kept</p></div></body>",
    f"<body><div class=ad>Buy, now.</div><article><h1>T</h1>{STORY * 8}</article></body>",
]


@pytest.mark.parametrize("page", SECTIONS)
def test_ratios_decide(page, monkeypatch):
    want = h.main_text(page)
    assert "Sentence 5" in want and not any(x in want for x in ("one", "tags here", "Login", "All rights kept", "Buy"))
    with monkeypatch.context() as m:
        m.setattr(h, "AGAINST", 1.0)
        m.setattr(h, "OUTSIDE", 1.0)
        m.setattr(h, "LINKS", 1.0)
        assert h.main_text(page) == want  # without any prior
    monkeypatch.setattr(h, "ratios", lambda blocks, of: (np.ones(len(blocks)), np.ones(len(blocks))))
    assert h.main_text(page) != want


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.1"), reason="no test data")
def test_ratios_decide_on_given_pages(spark, monkeypatch):
    pages = [r["html"] for r in spark.read.parquet("/root/testdata/sf0.1/pages.parquet").limit(300).collect()]
    texts = [h.main_text(x) for x in pages]
    monkeypatch.setattr(h, "ratios", lambda blocks, of: (np.ones(len(blocks)), np.ones(len(blocks))))
    assert sum(h.main_text(x) != t for x, t in zip(pages, texts, strict=True)) > 100


def test_paths_choose_what_is_returned(monkeypatch):
    page = PAGES[0]
    assert h.main_text(page) == f"Title\n{TEXT}\nitem\nother, linked item"
    monkeypatch.setattr(h, "content_paths", lambda blocks, root, paths: {b.element.path for b in blocks})
    assert h.main_text(page) == f"one\nTitle\n{TEXT}\nitem\nother, linked item"


@pytest.mark.parametrize(
    "page, want",
    [
        (f'<body><div class="content-sidebar-wrap"><div class="post">{STORY}</div></div></body>', TEXT),
        (f'<body><div class="has-sidebar"><article>{STORY}</article></div></body>', TEXT),
        (f'<body><article><div class="entry-header"><h1>Title</h1></div>{STORY}</article></body>', f"Title\n{TEXT}"),
        (f"<body><article><p>Let <math><mi>x</mi></math> be, say, one.</p>{STORY}</article></body>", f"Let x be, say, one.\n{TEXT}"),
        (f"<body><ul><li><a>Home</a><li><a>News</a><li><a>Sport</a></ul><div>{STORY}</div></body>", TEXT),
        (f"<body><div>{STORY}</div><section class=comments><h2>Comments</h2>" + "<div class=c><p>I liked it, so much, and more.</p></div>" * 30 + "</section></body>", TEXT),
        (f"<body><header><h1>Site</h1></header><main><h1>T</h1><p class=lead>Short lead</p>{STORY}<aside>x, y.</aside></main><form>Your, name.</form></body>", f"T\nShort lead\n{TEXT}"),
        ("<body><div class=notice>All there is, here.</div></body>", "All there is, here."),
        ("<body><a href=x>Only a link</a></body>", "Only a link"),
        ("<p>a</p>" * 3, "a\na\na"),
        (f"<body><article class=comment><p>Me, too.</p></article><div>{STORY}</div></body>", TEXT),
        (f"<body><article><h1>The title</h1><p class=by><a>Jane Doe</a></p>{STORY}</article></body>", f"The title\nJane Doe\n{TEXT}"),
        (f"<body><h1>The title</h1><p class=by><a>Jane Doe</a></p>{STORY}</body>", f"The title\nJane Doe\n{TEXT}"),
        (f"<body><article>{STORY}<h2>Sources</h2><ul><li><a>One</a><li><a>Two</a></ul><p>And that was all, for now.</p></article></body>", f"{TEXT}\nSources\nOne\nTwo\nAnd that was all, for now."),
        (f"<body><div>{STORY}<h2>Sources</h2><ul><li><a>One</a></ul><p><a>A paragraph that is a link, wholly.</a></p><p>And that was all, for now.</p></div></body>", f"{TEXT}\nSources\nOne\nA paragraph that is a link, wholly.\nAnd that was all, for now."),
        (f"<body><div class=story><p>{LEDE}</p><div class=text>{STORY}</div><p>{LEDE}</p></div></body>", f"{LEDE}\n{TEXT}\n{LEDE}"),
        ("<body><div class=comments><p>Only readers, here.</p></div></body>", "Only readers, here."),
    ],
)
def test_pages(page, want):
    assert h.main_text(page) == want


def test_query_leaves_columns_of_the_same_names_alone(spark):
    rows = [(1, "u", PAGES[3], "x", 5), (None, None, None, None, None), (1, "u", PAGES[3], "y", 6)]
    out = h.extract(spark.createDataFrame(rows, "page_id long, url string, html string, text string, n_chars int"))
    assert sorted(map(str, out.collect())) == sorted(["Row(page_id=1, url='u', text='a', n_chars=1)"] * 2 + ["Row(page_id=None, url=None, text='', n_chars=0)"])
