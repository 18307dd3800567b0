"""Each operator against brute force, and on odd tables: nulls, empty and long texts, ties, repeated rows, no rows, clashing columns."""

import hashlib
import random
import re
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from thermolith.llm import bpe, common, html_extract, langid, minhash, mixing, pretoken, quality, sharding, suffix_dedup, token_store, topk

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
WORDS = [a + b for a in ("ka", "lo", "mi", "nu", "sé", "to") for b in ("ra", "ri", "ben", "das", "x")]
BLANK = re.compile(r"[^\x20\x09-\x0D]+")


def prose(r, n):
    return " ".join(r.choice(WORDS) + r.choice(["", "", "", ".", ",", "\n"]) for _ in range(n))


@pytest.fixture(scope="module")
def texts():
    r = random.Random(5)
    base = [prose(r, r.choice([1, 2, 5, 60, 120, 300])) for _ in range(60)]
    passage = prose(r, 40)
    out = base + base[:6] + [base[7].upper()] + [passage + prose(r, 30), prose(r, 5) + passage, passage]
    for x in base[10:30]:
        w = x.split(" ")
        for k in range(0, len(w), 40):
            w[k] = r.choice(WORDS)
        out.append(" ".join(w))
    return out + [None, "", " \n\t", "a", "日本語 テキスト", "1234 5678", "\x85 \xa0 x", "é" * 300]


def frame(spark, texts, twice=False):
    rows = [(i, t, ("en", "de", None)[i % 3], ("s1", "s1", None, "s2")[i % 4], None) for i, t in enumerate(texts)]
    rows += [(None, "no id at all " * 30, None, None, None), (None, None, None, None, None)] if twice else []
    rows += rows[:5] + [(0, "another text of id 0 " * 10, "en", "s1", 3)] if twice else []
    df = spark.createDataFrame(rows, DOCS).repartition(3)
    clash = ("t", "row", "w", "h", "ord", "th", "n", "key", "doc", "position", "pass", "size", "turns", "_bucket", "id", "ids", "_id", "label", "rank", "score", "v", "a", "b")
    return df.withColumns({c: F.lit(1) for c in clash})


@pytest.fixture(scope="module")
def docs(spark, texts):
    return frame(spark, texts).cache()


@pytest.fixture(scope="module")
def odd(spark, texts):
    return frame(spark, texts, True).cache()


def words(t):
    return BLANK.findall(t or "")


# 1

def brute_counts(t):
    w, t = words(t), t or ""
    lines = [x for x in t.split("\n") if BLANK.search(x)]
    grams = Counter(tuple(w[i : i + 3]) for i in range(len(w) - 2))
    cover = {i + k for i in range(len(w) - 2) if grams[tuple(w[i : i + 3])] > 1 for k in range(3)}
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t), len(lines) - len(set(lines)), len(cover)


def test_quality_counts(odd, spark):
    more = ["a a a a", "x y z x y z", "l1\nl1\n\n\nl1 ", "# | a\n" * 40, "ab " * 3]
    rows = quality.quality_rules(odd.unionByName(frame(spark, more).withColumn("doc_id", F.col("doc_id") + 1000))).collect()
    by = {r["doc_id"]: r["text"] for r in odd.where("doc_id > 0").collect()} | {1000 + i: t for i, t in enumerate(more)}
    seen = [r for r in rows if r["doc_id"]]
    assert len(rows) == odd.count() + len(more)
    for r in seen:
        want = brute_counts(by[r["doc_id"]])
        assert tuple(r[c] for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")) == want
        assert r["base_failed"] == (want[0] < 50 or 100 * want[4] > 50 * want[0]) and not (r["base_failed"] and r["kept"])


def test_quality_adapts(spark):
    r = random.Random(1)
    text = lambda junk: " ".join(r.choice(WORDS) + ("###" if junk else "") for _ in range(80))
    rows = [(i, text(i % 20 == 0), "en", "s", 0) for i in range(400)]
    out = {x["doc_id"]: x["kept"] for x in quality.quality_rules(spark.createDataFrame(rows, DOCS)).collect()}
    assert all(out[i] == (i % 20 != 0) for i in out)


def test_quality_of_sources_with_much_junk(spark):
    """40 % junk of a source go; a source whose documents are all like that stays, and so do clean ones among 60 % junk."""
    r = random.Random(7)
    text = lambda k: " ".join(r.choice(WORDS) * (1 + 6 * (k == "long")) + ("####" if k == "marks" else "") for _ in range(80))
    share = {"marks": ("marks", 0.4), "long": ("long", 0.4), "clean": ("", 0), "code": ("marks", 1), "most": ("long", 0.6)}
    rows, want = [], {}
    for s, (junk, part) in share.items():
        for i in range(1000):
            k = junk if i % 10 < 10 * part else ""
            if s != "most" or not k:
                want[len(rows)] = not k or s == "code"
            rows.append((len(rows), text(k), "en", s, 0))
    out = {x["doc_id"]: x["kept"] for x in quality.quality_rules(spark.createDataFrame(rows, DOCS)).collect()}
    assert all(out[i] == k for i, k in want.items())


def test_quartiles_of_sketches(spark):
    r = random.Random(2)
    xs = [r.expovariate(0.1) for _ in range(3000)]
    df = spark.createDataFrame([("a", "symbols", int(np.ceil(np.log(x) / np.log(quality.GAMMA)))) for x in xs], "g string, rule string, bucket long").groupBy("g", "rule", "bucket").agg(F.count(F.lit(1)).alias("n"))
    q = quality.quartiles(df, ["g"]).first()
    assert q["total"] == 3000 and abs(q["q1"] / np.quantile(xs, 0.25) - 1) < 0.05 and abs(q["q3"] / np.quantile(xs, 0.75) - 1) < 0.05


# 2

def brute_near(rows, width, percent):
    sets = {}
    for i, t in rows:
        w = [re.sub("[A-Z]+", lambda m: m[0].lower(), x) for x in words(t)]
        sets[i] = {tuple(w[k : k + width]) for k in range(len(w) - width + 1)} or ({tuple(w)} if w else set())
    parent = {i: i for i in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(sets)
    for n, i in enumerate(ids):
        for j in ids[n + 1 :]:
            both = len(sets[i] & sets[j])
            if sets[i] and sets[j] and 100 * both >= percent * (len(sets[i]) + len(sets[j]) - both):
                a, b = find(i), find(j)
                parent[max(a, b)] = min(a, b)
    return {i: (len(sets[i]), find(i)) for i in ids}


@pytest.mark.parametrize("width", [2, 5])
def test_near_duplicates(docs, texts, width):
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in minhash.near_duplicates(docs, width=width).collect()}
    assert got == brute_near(enumerate(texts), width, 80)


def test_near_duplicate_chains(spark):
    """Copies of copies, each near the last one only, and a large group of near copies of one text."""
    r = random.Random(3)
    w = [f"w{r.randrange(10**6)}" for _ in range(200)]
    rows = [(0, " ".join(w), None, None, 0)]
    for i in range(1, 25):
        w[(i * 7) % 200] = f"n{i}"
        w[(i * 11 + 3) % 200] = f"m{i}"
        rows.append((i, " ".join(w), None, None, 0))
    base = [f"b{k}" for k in range(150)]
    for i in range(100, 260):
        x = base.copy()
        for k in r.sample(range(150), 6):
            x[k] = f"q{i}_{k}"
        rows.append((i, " ".join(x), None, None, 0))
    df = spark.createDataFrame(rows, DOCS)
    got = {x["doc_id"]: (x["n_shingles"], x["component_id"]) for x in minhash.near_duplicates(df, width=2).collect()}
    assert got == brute_near([x[:2] for x in rows], 2, 80)


def test_near_duplicates_odd(odd):
    rows = minhash.near_duplicates(odd, width=2).collect()
    assert len(rows) == odd.count() and all(r["kept"] and r["component_id"] is None for r in rows if r["doc_id"] is None)
    kept = minhash.deduplicate(odd, width=2)
    assert kept.columns == odd.columns and kept.where("doc_id is null").count() == 2


def test_estimate_is_corrected():
    rng = np.random.default_rng(1)
    for share in (0.0, 0.5, 0.8):
        n, est = 4000, []
        for _ in range(20):
            x = rng.integers(0, 1 << 63, 2 * n, dtype=np.uint64) * np.uint64(2)
            both = int(2 * n * share / (1 + share))
            sets = [np.sort(x[:n]), np.sort(x[n - both : 2 * n - both])]
            regs = [minhash.registers(np.zeros(n, np.int64), s, 1) for s in sets]
            est.append(minhash.estimate(np.array([(regs[0] == regs[1]).sum()]), np.array([n]), np.array([n]))[0])
        assert abs(np.mean(est) - share) < 0.03


def test_components(spark):
    r = random.Random(4)
    for _ in range(2):
        edges = [(r.randrange(60), r.randrange(60)) for _ in range(45)] + [(100 + i, 101 + i) for i in range(30)]
        parent = {x: x for e in edges for x in e}

        def find(x, parent=parent):
            while parent[x] != x:
                x = parent[x]
            return x

        for a, b in edges:
            a, b = find(a), find(b)
            parent[max(a, b)] = min(a, b)
        got = {x["node"]: x["component"] for x in minhash.components(spark.createDataFrame(edges, "a long, b long")).collect()}
        assert got == {x: find(x) for e in edges for x in e if e[0] != e[1]}


# 3

PAGE = """<html><head><title>T</title><script>var x = "</p>";</script></head><body class="home"><header class=site><h1>Site</h1></header>
<div id=cookie-notice><p>We use cookies, please accept them all, thanks.</p></div><div class="layout">
<div class="sidebar"><ul><li>One<li>Two</ul><p>Long sidebar text, with commas, and so on, and so forth. Yes, really.</p></div>
<div class="content"><h1>T &amp; x</h1><p>First para&nbsp;of   text, it is long enough, surely.<p>Second <i>one</i> goes on, and on; and on.</p><ul><li>item a<li>item b</ul>
<form><p>Your mail, please</p></form><div class="comments"><p>Reader says: this is wrong, very wrong, and long.</p></div></div></div><footer>f</footer></body>"""


def test_main_text():
    assert html_extract.main_text(PAGE) == "T & x\nFirst para of text, it is long enough, surely.\nSecond one goes on, and on; and on.\nitem a\nitem b"
    for page, want in ((None, ""), ("", ""), ("plain &lt;text", "plain <text"), ("<nav>x</nav>", ""), ("<p>a<br>b", "a b"), ("<article><p>x <b c='d>e</article>", "x e"), ("<p>a <span class='ad'>b <span>c</span> d</span> e", "a e"), ("<p>a <span class='ad'>b <p>c", "a\nc"), ("<!-- x", ""), ("<div>" * 5000 + "x", "x")):
        assert html_extract.main_text(page) == want


def test_main_text_keeps_what_lies_around_the_largest_part():
    """Pages without <article> or <main>: content and headings outside the part that holds over 90% of the text."""
    lede, close, body = "The lede, in short: it rained, and then, again, it rained.", "The closing words, as ever, are few, and far between.", [f"Sentence {i} of the story, which goes on, and on, for a while. " * 6 for i in range(8)]
    inner = "".join(f"<p>{x}</p>" for x in body)
    all_ = "\n".join(x.strip() for x in body)
    for page, want in (
        (f"<body><div id=story><p>{lede}</p><div class=text>{inner}</div><p>{close}</p></div></body>", f"{lede}\n{all_}\n{close}"),
        (f"<body><div id=story><p>{lede}</p><div class=text>{' '.join(body)}</div><p>{close}</p></div></body>", f"{lede}\n{' '.join(' '.join(body).split())}\n{close}"),
        (f"<body><div class=a><div class=text>{inner}</div><div class=more><p>{close * 3}</p></div></div></body>", f"{all_}\n{close * 3}"),
        (f"<body><div class=a><div class=head><h1>Title</h1></div><div class=text>{inner}</div></div></body>", f"Title\n{all_}"),
        (f"<body><h1>Title</h1><div class=text>{inner}</div></body>", f"Title\n{all_}"),
        (f"<body><div class=text>{inner}</div><div class=z><h4>Links</h4><ul><li>one<li>two</ul></div></body>", all_),
        (f"<body><div class=x>Home</div><article><h1>Title</h1>{inner}</article><div class=y>Up</div></body>", f"Title\n{all_}"),
    ):
        assert html_extract.main_text(page) == want


def test_main_text_of_pages_named_like_no_content():
    lines = [f"Sentence {i} of the story, which goes on, and on, for a while." for i in range(8)]
    inner, all_ = "".join(f"<p>{x}</p>" for x in lines), "\n".join(lines)
    side = "<p>Some words, and others, of no use.</p>"
    for name in ("content has-sidebar", "page with-header", "post no-comments", "related-work", "notice", "content sidebar", "share-price"):
        assert html_extract.main_text(f'<body><div class="{name}">{inner}</div></body>') == all_
        assert html_extract.main_text(f'<body><div id="{name.split()[-1]}">{inner}<div class="sidebar">{side}</div></div><div>x</div></body>') == all_
    assert html_extract.main_text(f"<body><p>{lines[0]}</p><div class=related-work>{inner[:200]}</div>{inner * 3}</body>").count("Sentence") == 1 + 3 + 24
    for name in ("sidebar", "sidebar-left", "comment-list", "ad_slot", "site-footer widget-area", "cookie-notice"):
        assert html_extract.main_text(f'<body><div class="text">{inner}</div><div class="{name}">{side}</div></body>') == all_
    assert html_extract.main_text(f"<body><div class=text>{inner}</div><div id=comments>{side * 90}</div></body>") == all_
    for name in ("ad", "widget"):
        assert html_extract.main_text(f"<body><div class={name}>{side}</div><article><p>Short, this.</p></article></body>") == "Short, this."
        assert html_extract.main_text(f"<body><div class={name}>{side}</div><article><p>No mark</p></article></body>") == "No mark"
    for attributes in ('title="the hidden truth"', "title='so hidden'", 'data-x1="a hidden b"', 'data-hidden="no"'):
        assert html_extract.main_text(f"<body><p>{lines[0]}</p><p {attributes}>{lines[1]}</p></body>") == f"{lines[0]}\n{lines[1]}"
    for attributes in ("hidden", "class=a HIDDEN", 'hidden=""', "hidden=until-found", 'style="display: none"', "aria-hidden=true"):
        assert html_extract.main_text(f"<body><p>{lines[0]}</p><p {attributes}>{lines[1]}</p></body>") == lines[0]
    assert html_extract.main_text(f"<body><p><span class=notice>{lines[0]}</span></p><p>x</p></body>") == f"{lines[0]}\nx"


def test_extract(spark):
    rows = [(1, "u", PAGE), (2, None, None), (2, None, None), (None, "u", "<p>" + "long text. " * 200000)]
    out = html_extract.extract(spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("text", F.lit(1)))
    got = sorted((r["page_id"] or 0, r["n_chars"], len(r["text"])) for r in out.collect())
    assert [g[0] for g in got] == [0, 1, 2, 2] and all(a == b for _, a, b in got) and got[0][1] == 2199999


# 4

def test_network_learns_and_tables_agree(spark):
    r = random.Random(6)
    kinds = {"xx": ["ka", "lo", "mi"], "yy": ["tz", "sch", "ung"], "zz": ["ção", "nh", "em"]}
    rows = [(i, " ".join("".join(r.choice(kinds[k]) for _ in range(3)) for _ in range(r.choice([3, 40, 200]))), k, "s", 0) for i in range(360) for k in [list(kinds)[i % 3]]]
    rows += [(1000, None, "xx", None, 0), (1001, "", "xx", None, 0), (1002, "123 !?", "xx", None, 0), (1003, "kalomi", None, None, 0), (None, "tzschung", None, None, 0), (1004, "kalo " * 100000, None, None, 0)]
    df = spark.createDataFrame(rows, DOCS)
    got = {x["doc_id"]: x for x in langid.identify(df).collect()}
    assert len(got) == len(rows) and all(0 <= x["score"] <= 1 for x in got.values())
    held = [i for i in range(360) if zlib.crc32(str(i).encode()) % 3 == 1]
    assert all(got[i]["held_out"] == (i in held) for i in range(360))
    assert np.mean([got[i]["lang_pred"] == rows[i][2] for i in held]) > 0.97
    assert [got[i]["lang_pred"] for i in (1000, 1001, 1002, 1003, None, 1004)] == ["und", "und", "und", "xx", "yy", "xx"]
    kept = langid.accepted(df, least=0.3)
    assert kept.columns == df.columns and {1000, 1001, 1002}.isdisjoint(r["doc_id"] for r in kept.collect()) and kept.count() == len(rows) - 3


def test_every_label_is_learnt(spark):
    rows = [(i, f"text {i} of label", f"l{i % 230:03}", "s", 0) for i in range(690)]
    langs, x, y = langid.sample(spark.createDataFrame(rows, DOCS), F.lit(True), per_lang=2, windows=1)
    assert langs == [f"l{k:03}" for k in range(230)] and set(y.tolist()) == set(range(230))


def test_texts_of_no_learnt_language_are_not_accepted(spark):
    """One, two or three learnt languages, for which the softmax is 1/3 at least: another one and gibberish go."""
    r = random.Random(9)
    kinds = {"xx": ["ka", "lo", "mi"], "yy": ["tz", "sch", "ung"], "zz": ["ção", "nh", "em"], None: ["wy", "pur", "gdo"]}
    text = lambda k, n: " ".join("".join(r.choice(kinds[k]) for _ in range(3)) for _ in range(n))
    for langs in (["xx"], ["xx", "yy"], ["xx", "yy", "zz"]):
        rows = [(i, text(k, r.choice([3, 40, 200])), k, "s", 0) for i in range(240) for k in [langs[i % len(langs)]]]
        rows += [(1000 + i, text(None, n), None, "s", 0) for i, n in enumerate([10, 40, 200] * 10)]
        rows += [(2000 + i, "".join(r.choice("bcdfghjqvwx ") for _ in range(400)), None, "s", 0) for i in range(10)]
        rows += [(3000, text(langs[0], 100).upper(), None, "s", 0)]
        kept = {x["doc_id"] for x in langid.accepted(spark.createDataFrame(rows, DOCS), least=0.3).collect()}
        assert kept == {*range(240), 3000}


def test_gradients():
    rng = np.random.default_rng(2)
    net = langid.Network.new(["a", "b", "c"])
    for p in net.parameters():
        p[...] += rng.normal(0, 0.1, p.shape)
    net = langid.Network(net.langs, *(x.astype(np.float64) if isinstance(x, np.ndarray) else [y.astype(np.float64) for y in x] for x in (net.embedding, net.filters, net.bias, net.out, net.out_bias)))
    x, y = rng.integers(0, 257, (5, langid.WINDOW)), np.array([0, 1, 2, 0, 1])
    loss = lambda: -net.log_probabilities(x, net.tables())[np.arange(5), y].mean()
    for p, g in zip(net.parameters(), net.gradients(x, y), strict=True):
        at = np.unravel_index(np.abs(g).argmax(), g.shape)
        p[at] += 1e-6
        up = loss()
        p[at] -= 2e-6
        down = loss()
        p[at] += 1e-6
        assert abs((up - down) / 2e-6 - g[at]) < 1e-4


def test_no_labels(docs):
    out = langid.identify(docs.withColumn("lang", F.lit(None).cast("string")))
    assert {r["lang_pred"] for r in out.collect()} == {"und"}


# 5

def brute_spans(rows):
    seen, out = set(), {}
    for i, t in rows:
        b = (t or "").encode()
        cover = np.zeros(len(b), bool)
        for k in range(len(b) - 99):
            x = b[k : k + 100]
            if x in seen:
                cover[k : k + 100] = True
            seen.add(x)
        edges = np.diff(np.concatenate([[0], cover.astype(int)]))
        out[i] = (len(b), int(cover.sum()), int((edges == 1).sum()), hashlib.sha256(np.frombuffer(b, np.uint8)[~cover].tobytes()).hexdigest())
    return out


@pytest.mark.parametrize("how", [{}, {"block_bytes": 500}, {"many": 1, "together": 40}, {"many": 2, "block_bytes": 300}])
def test_repeated_spans(spark, texts, how):
    more = texts + ["ab" * 400, "x" * 100, "x" * 101, "x" * 99, "y" * 250 + texts[40], (texts[41] or "")[:150] + "z" + (texts[41] or "")[:150]]
    got = {r["doc_id"]: (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in suffix_dedup.digest(frame(spark, more), **how).collect()}
    assert got == brute_spans(enumerate(more))


def test_repeated_spans_odd(odd):
    rows = suffix_dedup.digest(odd).collect()
    assert len(rows) == odd.count()
    by = {}
    for r in rows:
        by.setdefault((r["doc_id"], r["n_bytes"]), set()).add(r["kept_sha256"])
    assert all(len(v) == 1 for v in by.values())  # repeated rows have one result
    out = suffix_dedup.deduplicate(odd)
    assert out.columns == odd.columns and out.count() == odd.count()


def test_merge_sorts_and_shares():
    """The merged order is that of all suffixes, cut to four symbols."""
    r = random.Random(8)
    parts = ["".join(r.choice("ab") for _ in range(60)).encode() for _ in range(3)]
    data = [b"".join(r.choice(parts) for _ in range(4)) for _ in range(12)]
    off = np.concatenate([[0], np.cumsum([len(x) for x in data])])
    flat = np.frombuffer(b"".join(data), np.uint8)
    shards = [suffix_dedup.Shard(flat[off[a] : off[b]], off[a : b + 1] - off[a]) for a, b in ((0, 5), (5, 6), (6, 12))]
    order, shared = suffix_dedup.merge(shards)
    row = np.concatenate([s.row + a for s, a in zip(shards, (0, 5, 6), strict=True)])[order]
    pos = np.concatenate([s.pos for s in shards])[order]
    symbol = lambda k: [data[row[k]][p : p + 25] for p in range(pos[k], len(data[row[k]]) - 24, 25)][:4]
    common_ = lambda a, b: next((i for i, (x, y) in enumerate(zip(a, b, strict=False)) if x != y), min(len(a), len(b)))
    for k in range(1, len(order)):
        assert shared[k] == common_(symbol(k - 1), symbol(k))
    for a in range(0, len(order), 37):
        for b in range(0, len(order), 41):
            n = common_(symbol(a), symbol(b))
            assert n == (4 if a == b and len(symbol(a)) == 4 else n)
            if a < b:
                assert min(shared[a + 1 : b + 1]) == n  # all between share as much: sorted


# 6

@pytest.mark.parametrize("bytes_", [1 << 24, 3000])
def test_shards(odd, bytes_):
    out = sharding.write_shards(odd, shards=8, bucket_bytes=bytes_)
    assert set(odd.columns) <= set(out.columns)
    by = {}
    for r in out.select("_shard", "_slot").collect():
        by.setdefault(r["_shard"], []).append(r["_slot"])
    assert all(sorted(v) == list(range(len(v))) for v in by.values())
    sizes = [len(by.get(k, [])) for k in range(8)]
    assert sum(sizes) == odd.count() and max(sizes) - min(sizes) <= 1
    count = lambda d: Counter((r["doc_id"], r["text"]) for r in d.select("doc_id", "text").collect())
    assert count(out) == count(odd)
    place = lambda d: Counter((r["doc_id"], r["text"], r["_shard"], r["_slot"]) for r in d.collect())
    assert place(sharding.shard(odd, 8, bucket_bytes=bytes_)) == place(sharding.shard(odd, 8, bucket_bytes=bytes_))


def test_shards_need_no_python(docs):
    plan = sharding.shard(docs, 8)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Arrow|Pandas", plan)


# 7 and 9

ODD = ["", "'s", " 's", "!'s", "it's  'll\n'd x", "  a", "a  ", "\n\n a\n", "é İ ΣΣ ΣΑΣ", "<|endoftext|>", "a <|endoftext|> b<|endoftext|>", "x<|startoftext|>'s", "I'M we're they'veX 've", "１２３ 12³ ½ 4a", "日本語 テキスト。", "🙂🙂 👩‍👩‍👧 a", "\x85\x1c\x1da b", "''s '' 's", "à̖b", "ﬁ Ａ", "'", "'r", "<|endoftext|", None, "a" * 3000]


@pytest.fixture(scope="module")
def odd_texts(texts):
    r = random.Random(9)
    alpha = list(" \n\t'sdtmrevlla1é.!ñ'   Σ日")
    return ODD + texts + ["".join(r.choice(alpha) for _ in range(r.randint(0, 30))) for _ in range(3000)]


def library(name, texts):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(public_tokenizers.path(name))
    return t, [e.ids for e in t.encode_batch([x or "" for x in texts], add_special_tokens=False)]


def test_bpe(spark, odd_texts):
    t, ids = library("byte_bpe_50k.json", odd_texts)
    got = {r["doc_id"]: r for r in bpe.digest(frame(spark, odd_texts), public_tokenizers.path("byte_bpe_50k.json"), with_ids=True).collect()}
    for i, want in enumerate(ids):
        assert got[i]["ids"] == want and got[i]["n_tokens"] == len(want)
        assert got[i]["ids_sha256"] == hashlib.sha256(np.array(want, "<u4").tobytes()).hexdigest()
        assert got[i]["decoded"] == t.decode(want, skip_special_tokens=False) == (odd_texts[i] or "")
        assert got[i]["decoded_sha256"] == hashlib.sha256((odd_texts[i] or "").encode()).hexdigest()


def test_bpe_merges_only_what_fails():
    model = bpe.Bpe(public_tokenizers.path("byte_bpe_50k.json"))
    model.encode_words([" the"] + ["".join(x) for x in zip(WORDS, reversed(WORDS))])
    assert 0 < model.counts["merged"] < model.counts["words"]


def test_words_are_forgotten():
    model = bpe.Bpe(public_tokenizers.path("byte_bpe_50k.json"))
    model.words.most = 10
    for part in (["some words here"], ["other words there, and many more of them than ten"], ["some words here"]):
        ids, _ = model.encode(part)
        assert model.decode(ids)[0].tobytes().decode() == part[0]
    assert list(pretoken.in_slices(["ab", "c", "defg"], 3)) == [["ab", "c"], ["defg"]]


def test_token_store(spark, odd_texts):
    _, ids = library("word_bpe_49k.json", odd_texts)
    path = token_store.write(frame(spark, odd_texts), public_tokenizers.path("word_bpe_49k.json"), stride=1000)
    got = {r["doc_id"]: r for r in token_store.digest(spark, path).collect()}
    start = 0
    for i, want in enumerate(ids):
        full = [*want, 1]
        assert (got[i]["start"], got[i]["n_tokens"], got[i]["ids_crc32"]) == (start, len(full), zlib.crc32(np.array(full, "<u4").tobytes()))
        start += len(full)
    assert token_store.look_up(spark, path, [5]).first()["ids"] == [*ids[5], 1]
    plan = token_store.look_up(spark, path, [5])._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [IsNotNull(doc_id), EqualTo(doc_id,5)]" in plan


def test_token_store_odd(spark, odd):
    rows = sorted((r["start"], r["n_tokens"]) for r in token_store.digest(spark, token_store.write(odd, public_tokenizers.path("word_bpe_49k.json"))).collect())
    assert len(rows) == odd.count() and all(a + n == b for (a, n), (b, _) in zip(rows, rows[1:], strict=False))


# 8

def fill(sizes, weights=(5, 2, 1), share=1.5, most=2):
    target, left = dict.fromkeys(sizes, 0.0), share * sum(sizes.values())
    weight = {s: weights[k % 3] for k, s in enumerate(sorted(sizes, key=lambda s: (s is None, s or "")))}
    free = set(sizes)
    while free:
        level = left / sum(weight[s] for s in free)
        full = {s for s in free if level * weight[s] > most * sizes[s]}
        if not full:
            return target | {s: level * weight[s] for s in free}
        for s in full:
            target[s] = most * sizes[s]
            left -= target[s]
        free -= full
    return target


def test_mix(odd):
    rows = mixing.plan(odd).collect()
    sizes, taken = Counter(), Counter()
    for r in rows:
        sizes[r["source"]] += r["size"]
        taken[r["source"]] += r["taken"]
    want = fill(sizes)
    assert len(rows) == odd.count()
    for r in rows:
        assert r["target"] == pytest.approx(want[r["source"]]) and r["source_size"] == sizes[r["source"]] and 0 <= r["taken"] <= 2 * r["size"]
        assert all(0 <= t["position"] <= 1 for t in r["turns"])
    assert all(taken[s] == int(want[s] + 1e-6) for s in sizes)
    again = mixing.plan(odd.repartition(5)).collect()
    assert Counter((r["doc_id"], r["size"], r["taken"]) for r in again) == Counter((r["doc_id"], r["size"], r["taken"]) for r in rows)
    out = mixing.mix(odd)
    assert out.columns == odd.columns and out.count() == sum(len(r["turns"]) for r in rows)


def test_curriculum(spark):
    t = [spark.range(101).select(mixing.inverse_demand(F.col("id") / 100, k).alias("t")).collect() for k in mixing.SCHEDULES]
    for got, knots in zip(t, mixing.SCHEDULES, strict=True):
        times = np.linspace(0, 1, 10001)
        rate = np.interp(times, *zip(*knots, strict=True))
        demand = np.concatenate([[0], np.cumsum((rate[1:] + rate[:-1]) / 2)])
        want = np.interp(np.arange(101) / 100, demand / demand[-1], times)
        assert np.allclose([r["t"] for r in got], want, atol=1e-3)


def test_mix_is_in_order(docs):
    at = {r["doc_id"]: r["turns"][0]["position"] for r in mixing.plan(docs).collect() if len(r["turns"]) == 1}
    seen = [at[r["doc_id"]] for r in mixing.mix(docs).collect() if r["doc_id"] in at]
    assert seen == sorted(seen)


# 10

def brute_top(q, qid, r, rid, k):
    out = {}
    for i, v in zip(qid, q, strict=True):
        every = sorted((-int(v @ w), j) for j, w in zip(rid, r, strict=True) if j != i)
        out[i] = [(j, -s) for s, j in every[:k]]
    return out


@pytest.mark.parametrize("block", [2048, 40])
def test_top_k(spark, block):
    rng = np.random.default_rng(3)
    x = np.round(rng.normal(0, 0.2, (300, 6)) + rng.choice([0, 1], (300, 1)), 1).astype(np.float32)
    x[50:60] = x[49]
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(300, None), (400, [0.1, None]), (500, [float("nan")] * 6), (600, [float("inf")] * 6)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumns({c: F.lit(1) for c in ("id", "v", "h", "a", "b", "rank", "score")})
    got = {}
    for r in topk.top_k(df.where("vec_id % 20 = 0"), df, block=block).orderBy("query_id", "rank").collect():
        got.setdefault(r["query_id"], []).append((r["vec_id"], r["score"]))
    whole = np.floor(1024 * x.astype(np.float64)).astype(np.int64)
    assert got == brute_top(whole[::20], range(0, 300, 20), whole, range(300), 10)


def test_dual_tree():
    rng = np.random.default_rng(1)
    for t in range(30):
        dim, n, m = rng.integers(1, 6), rng.integers(1, 300), rng.integers(1, 60)
        r = rng.integers(-5, 6, (n, dim)) if t % 2 else (rng.normal(0, 1, (n, dim)) * rng.choice([1, 1000], n)[:, None] + rng.choice([0, 5000], n)[:, None]).astype(np.int64)
        rid, q, qid = rng.permutation(n), r[rng.integers(0, n, m)], rng.integers(0, n, m)
        d = topk.DualTree(q, qid, r, rid, 7)
        want = [brute_top([v], [i], r, rid, 7)[i] for i, v in zip(qid, q, strict=True)]
        assert [[(int(j), int(s)) for j, s, f in zip(*x, strict=True) if f] for x in zip(d.best, d.score, d.found, strict=True)] == want
    clustered = np.repeat(rng.integers(-4000, 4000, (20, 8)), 50, axis=0) + rng.integers(-5, 6, (1000, 8))
    assert topk.DualTree(clustered[::20], np.arange(0, 1000, 20), clustered, np.arange(1000), 5).pairs < 50 * 1000 / 2


# all

def test_empty_tables(spark):
    none = spark.createDataFrame([], DOCS)
    byte, word = (public_tokenizers.path(x) for x in ("byte_bpe_50k.json", "word_bpe_49k.json"))
    for out in (quality.quality_rules(none), minhash.near_duplicates(none), minhash.deduplicate(none), langid.identify(none), langid.accepted(none), suffix_dedup.digest(none), suffix_dedup.deduplicate(none), sharding.write_shards(none), bpe.digest(none, byte), mixing.plan(none), mixing.mix(none), token_store.digest(spark, token_store.write(none, word)), html_extract.extract(spark.createDataFrame([], "page_id long, url string, html string")), topk.top_k(*[spark.createDataFrame([], "vec_id long, embedding array<float>")] * 2)):
        assert out.count() == 0


def test_long_text(spark):
    r = random.Random(7)
    long = prose(r, 300_000)
    df = spark.createDataFrame([(1, long, "en", "s", 0), (2, long[:500_000] + "!", "en", "s", 0)], DOCS)
    assert {x["n_words"] for x in quality.quality_rules(df).collect()} == {len(words(long)), len(words(long[:500_000] + "!"))}
    got = {x["doc_id"]: x for x in suffix_dedup.digest(df).collect()}
    assert got[2]["n_removed"] >= len(long[:500_000].encode())
    assert {x["kept"] for x in minhash.near_duplicates(df, width=2).collect()} <= {True, False}


def test_pipeline(spark, tmp_path):
    import corpus_pipeline

    r = random.Random(11)
    base = [prose(r, 120) for _ in range(40)]
    rows = [(i, t, "en", f"s{i % 3}", 0) for i, t in enumerate(base + base[:5] + ["123", None, ""])]
    spark.createDataFrame(rows, DOCS).write.parquet(str(tmp_path / "documents.parquet"))
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, str(tmp_path))
        assert k == 4 or out.columns == docs.columns
        out.write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        if k < 3:
            assert sorted(x["doc_id"] for x in docs.collect()) == list(range(45 if k == 0 else 40))
    direct = corpus_pipeline.run(spark, str(tmp_path))
    key = lambda d: Counter((x["doc_id"], x["n_tokens"], x["ids_sha256"]) for x in d.collect())
    assert key(direct) == key(docs)
