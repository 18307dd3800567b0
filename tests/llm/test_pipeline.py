"""Each stage of the pipeline against a plain version, on a table with nulls, copies, shared passages and more columns."""

import hashlib
import random
from collections import Counter

import duckdb
import numpy as np
import pytest
from test_llm import prose

corpus_pipeline = pytest.importorskip("corpus_pipeline")
COLUMNS = "doc_id long, text string, lang string, source string, n_chars long, _row string, _low int"


def components(texts):
    """doc -> least doc of its component, by all pairs of five-word shingle sets."""
    sets = {}
    for i, t in texts.items():
        w = "".join(c.lower() if c.isascii() else c for c in t or "").replace("\n", " ").split(" ")
        w = [x for x in w if x]
        sets[i] = {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()
    of = {i: i for i in texts}
    for i in sorted(texts):
        for j in sorted(texts):
            if i < j and sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]):
                a, b = sorted((of[i], of[j]))
                of = {k: a if v == b else v for k, v in of.items()}
    return of


def without_repeats(texts):
    seen, out = set(), {}
    for i in sorted(texts):
        b = texts[i].encode()
        cover = np.zeros(len(b), bool)
        for k in range(len(b) - 99):
            cover[k : k + 100] |= b[k : k + 100] in seen
            seen.add(b[k : k + 100])
        out[i] = np.frombuffer(b, np.uint8)[~cover].tobytes().decode("utf-8", "ignore")
    return out


def test_stages(spark, tmp_path):
    import public_tokenizers
    from tokenizers import Tokenizer

    from thermolith.llm import oracles

    r = random.Random(21)
    base = [prose(r, 140) for _ in range(30)]
    passage = prose(r, 45)
    near = [x.rsplit(" ", 3)[0] + " " + prose(r, 3) for x in base[:8]]
    texts = base + near + base[8:12] + [f"{prose(r, 60)} {passage} {prose(r, 60)}" for _ in range(4)] + ["123 456", None, "", " \n"]
    rows = [(i, t, "en" if i % 2 else None, f"s{i % 3}", 0, "x", i) for i, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, COLUMNS).repartition(3)
    stage = dict(corpus_pipeline.STAGES)
    held = lambda d: {x["doc_id"]: x["text"] for x in d.select("doc_id", "text").collect()}

    def write(name, df):
        df.write.parquet(str(tmp_path / name))
        return spark.read.parquet(str(tmp_path / name))

    one = write("one", stage["language_id"](spark, docs, ""))
    assert one.columns == docs.columns and held(one) == {i: t for i, t in enumerate(texts) if t and any(c.isalpha() for c in t)}
    two = write("two", stage["near_duplicates"](spark, one, ""))
    of = components(held(one))
    assert two.columns == docs.columns and held(two) == {i: t for i, t in held(one).items() if of[i] == i} and len(held(two)) < len(held(one))
    three = write("three", stage["repeated_strings"](spark, two, ""))
    assert three.columns == docs.columns and held(three) == without_repeats(held(two)) != held(two)
    four = write("documents", stage["mixing_sources"](spark, three, ""))
    duck = duckdb.connect()
    duck.execute(f"CREATE VIEW documents AS SELECT doc_id, text, source FROM '{tmp_path}/three/*.parquet'")
    passes = {d: 2 if taken > size else int(taken > 0) for d, size, taken in duck.execute(f"SELECT doc_id, size, taken FROM ({oracles.mixed()})").fetchall()}
    assert four.columns == docs.columns and Counter(x["doc_id"] for x in four.select("doc_id").collect()) == Counter({d: n for d, n in passes.items() if n})
    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    tokenizer.no_truncation()
    tokenizer.no_padding()

    def digest(t):
        ids = tokenizer.encode(t or "", add_special_tokens=False).ids
        return len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(tokenizer.decode(ids, skip_special_tokens=False).encode()).hexdigest()

    want = Counter((x["doc_id"], *digest(x["text"])) for x in four.select("doc_id", "text").collect())
    assert Counter(map(tuple, stage["tokens"](spark, four, "").select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256").collect())) == want


def test_stages_of_empty_and_repeated_rows(spark, tmp_path):
    none = spark.createDataFrame([], COLUMNS)
    text = prose(random.Random(3), 80)
    twice = spark.createDataFrame([(1, text, "en", "s", 0, "a", 1), (1, text, "en", "s", 0, "b", 2), (None, text, None, None, None, None, None), (2, text + " more", "en", "s", 0, "c", 3)], COLUMNS)
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, none, "").count() == 0
        out = stage(spark, twice, "")
        assert out.count() >= (3 if name == "near_duplicates" else 1)
