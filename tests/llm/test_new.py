"""Pieces, runs of words, and clusters against plain versions."""

import hashlib
import os
import random
import zlib

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from thermolith.llm import blocknorm, periodic, piece_bpe, queries

MODEL = public_tokenizers.path("piece_bpe_32k.model")
ODD = [None, "", " ", "   ", "\n", "▁", "▁▁ a", "a  b\n\tc ", "<s></s><unk><0x41>", "\x00é中\U0001f600\u200d", "ab" * 3000, " " * 999, "the end of the line " * 2000, "Same words", "Same words"]


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=MODEL)


def plain_merge(text, library):
    """Merging by looking for the best adjacent pair again and again, without an agenda."""
    known = {library.id_to_piece(i): library.get_score(i) for i in range(library.get_piece_size()) if not (library.is_byte(i) or library.is_control(i) or library.is_unknown(i))}
    out = list(("▁" + text.replace(" ", "▁")) if text else "")
    while True:
        best = max(((known[a + b], -i) for i, (a, b) in enumerate(zip(out, out[1:], strict=False)) if a + b in known), default=None)
        if best is None:
            return [i for s in out for i in ([library.piece_to_id(s)] if s in known else [library.piece_to_id(f"<0x{b:02X}>") for b in s.encode()])]
        i = -best[1]
        out[i : i + 2] = [out[i] + out[i + 1]]


@pytest.mark.parametrize("check", ["words", "texts", None])
def test_pieces_equal_the_library(spark, library, check):
    rows = [(i if i != 3 else None, t, "x") for i, t in enumerate(ODD)]
    got = piece_bpe.encode(spark.createDataFrame(rows, "doc_id long, text string, ids string"), MODEL, check=check, with_ids=True).collect()
    assert len(got) == len(ODD)
    by = {r["doc_id"]: r for r in got}
    for i, text, _ in rows:
        r, ids = by[i], library.encode(text or "", add_eos=True)
        assert (r["ids"], r["n_tokens"], r["decoded"]) == (ids, len(ids), library.decode(ids))
        assert r["ids_sha256"] == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert r["decoded_sha256"] == hashlib.sha256(library.decode(ids).encode()).hexdigest()


@given(st.text(st.sampled_from("abeht ing▁\n<0x>é中"), max_size=60))
@settings(max_examples=60, deadline=None)
def test_agenda_equals_plain_merging(text):
    lib = piece_bpe.model(MODEL, None).library
    own = piece_bpe.model(MODEL, None)
    ids, _ = own.encode([text])
    assert ids.tolist()[:-1] == plain_merge(text, lib) == lib.encode(text)


def test_a_wrong_agenda_is_found(monkeypatch):
    own = piece_bpe.PieceBpe(MODEL)
    monkeypatch.setattr(own, "merge", lambda part: [5])
    with pytest.raises(ValueError, match="differ"):
        own.encode(["some words"])
    with pytest.raises(ValueError, match="check"):
        piece_bpe.PieceBpe(MODEL, "all")


def test_pieces_of_an_empty_table(spark):
    assert piece_bpe.encode(spark.createDataFrame([], "doc_id int, text string"), MODEL).count() == 0


def plain_runs(x, times=4, least=6):
    out = {}
    for q in range(1, len(x) // times + 1):
        i = 0
        while i < len(x) - q:
            j = i
            while j < len(x) - q and x[j] == x[j + q]:
                j += 1
            if j > i and j - i + q >= max(least, times * q):
                out.setdefault((i, j - i + q), q)  # the smallest period comes first
            i = max(j, i + 1)
    return sorted([(s, n, q) for (s, n), q in out.items()], key=lambda r: (r[0], r[2]))


@given(st.lists(st.lists(st.integers(0, 2), max_size=60), min_size=1, max_size=5), st.sampled_from([(2, 1), (2, 2), (3, 6), (4, 6)]))
@settings(max_examples=300, deadline=None)
def test_runs_equal_plain_search(documents, how):
    assert periodic.find_runs([np.array(d, np.int64) for d in documents], *how) == [plain_runs(d, *how) for d in documents]


def test_runs_of_long_documents():
    rng = random.Random(4)
    block = [rng.randrange(500) for _ in range(700)]
    documents = [block * 4 + [7], [rng.randrange(3) for _ in range(4000)], [1] * 3000, [1, 2] * 900 + block + [3, 4, 5] * 300, []]
    fib = ([0], [0, 1])
    while len(fib[1]) < 2000:
        fib = fib[1], fib[1] + fib[0]
    documents.append(fib[1])
    for how in ((4, 6), (2, 2)):
        assert periodic.find_runs([np.array(d, np.int64) for d in documents], *how) == [plain_runs(d, *how) for d in documents]


def test_smaller_parts_split():
    """Positions are moved about log n times, not once for every length."""
    n = 1 << 14
    one = periodic.Refinement(np.append(np.arange(n) % 2048, 5000), np.full(n + 1, n))
    touched = 0
    for _ in range(3000):
        touched += len(one.splitters)
        one.refine()
    assert touched < n * 14


def planted(i, text):
    w = (text or "").encode().split()
    h = zlib.crc32(str(i).encode())
    g, n = h // 10, len(w)
    if h % 10 == 0 and n and i is not None:
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        w = [w[k] if k < a else w[a + (k - a) % p] for k in range(n)]
    return w


def test_periodic_query_equals_plain_version(spark, tmp_path):
    rng = random.Random(5)
    texts = [None, "", "  ", "a", "a a a a a a", "b a a a a a a b a a a a a a", "x y " * 40 + "ü  z\tz z z z z z", "ha " * 5000]
    texts += [" ".join(rng.choice("abcdefgh") for _ in range(rng.randrange(1, 200))) for _ in range(300)]
    rows = [(i, t, i) for i, t in enumerate(texts)] + [(40, texts[40], 0), (None, "q q q q q q q", 0)]
    spark.createDataFrame(rows, "doc_id long, text string, runs long").write.parquet(f"{tmp_path}/documents.parquet")
    got = queries.op12_periodic_runs(spark, str(tmp_path)).collect()
    want = []
    for i, t, _ in rows:
        w = planted(i, t)
        runs = plain_runs(w)
        gone = {k for s, n, q in runs for k in range(s + q, s + n)}
        best = min(runs, key=lambda r: (-r[1] / r[2], r[0], r[2])) if runs else (None,) * 3
        sha = lambda b: hashlib.sha256(b).hexdigest()
        want.append((i, len(runs), *best, 1000 * best[1] // best[2] if runs else None, sha("".join(f"{s},{n},{q}\n" for s, n, q in runs).encode()), sha(b" ".join(x for k, x in enumerate(w) if k not in gone))))
    assert sorted(map(tuple, got), key=str) == sorted(want, key=str)
    assert sum(r["n_runs"] > 0 for r in got) > 10


def test_runs_of_an_empty_table(spark):
    out = periodic.periodic_runs(spark.createDataFrame([], "doc_id string, text string"))
    assert out.columns == ["doc_id", "n_words", "runs", "strongest", "collapsed"] and out.count() == 0
    with pytest.raises(ValueError, match="two periods"):
        periodic.find_runs([np.array([1])], times=1)


def plain_kmeans(vectors, k=8, rounds=10):
    kept = sorted(((i, [int(np.floor(1024 * float(x))) for x in v]) for i, v in vectors), key=lambda r: (hashlib.sha256(f"3:{r[0]}".encode()).hexdigest(), r))
    centres = [v for _, v in kept[:k]]
    where = lambda v: min((sum((a - b) ** 2 for a, b in zip(v, c, strict=True)), n) for n, c in enumerate(centres))
    for _ in range(rounds):
        of = [where(v)[1] for _, v in kept]
        for c in range(len(centres)):
            own = [v for (_, v), o in zip(kept, of, strict=True) if o == c]
            if own:
                centres[c] = [sum(col) // len(own) for col in zip(*own, strict=True)]
    return {(i, tuple(v)): where(v) for i, v in kept}, centres


def test_clusters_equal_plain_rounds(spark, tmp_path):
    rng = np.random.default_rng(6)
    good = [(i, (rng.normal(size=64) * 0.1 + (i % 5)).round(3).tolist()) for i in range(200)]
    good += [(900, good[0][1]), (900, good[0][1]), (901, [0.0] * 64), (902, [-0.5] * 64)]
    bad = [(1000, None), (1001, [0.1] * 63), (1002, [0.1] * 63 + [None]), (1003, [float("nan")] * 64), (1004, [float("inf")] * 64), (1005, []), (1006, [0.1] * 65)]
    spark.createDataFrame([(i, v, "c") for i, v in good + bad], "vec_id long, embedding array<double>, cluster string").repartition(5).write.parquet(f"{tmp_path}/embeddings.parquet")
    got = queries.op13_blocknorm(spark, str(tmp_path)).collect()
    near, centres = plain_kmeans(good)
    assert len(got) == len(good)
    total = sum(near[i, tuple(int(np.floor(1024 * x)) for x in v)][0] for i, v in good)
    by = {r["vec_id"]: r for r in got}
    for i, v in good:
        d, c = near[i, tuple(int(np.floor(1024 * x)) for x in v)]
        assert (by[i]["cluster"], by[i]["distance"], by[i]["inertia"]) == (c, d, total)
        assert by[i]["centroid_sha256"] == hashlib.sha256(",".join(map(str, centres[c])).encode()).hexdigest()
    for c in {r["cluster"] for r in got}:
        assert {r["cluster_inertia"] for r in got if r["cluster"] == c} == {sum(r["distance"] for r in got if r["cluster"] == c)}


@given(st.integers(0, 2**32), st.integers(1, 9), st.sampled_from([1, 3, 4, 8, 64]))
@settings(max_examples=60, deadline=None)
def test_screening_loses_nothing(seed, k, segment):
    rng = np.random.default_rng(seed)
    x = rng.integers(-50, 50, (60, 10)) * rng.choice([1, 1000, 1 << 18])
    x[::7] = x[0]
    c = blocknorm.Centroids(np.concatenate([x[:k], rng.integers(-9, 9, (2, 10)), x[:1]]), segment)
    d = ((x[:, None] - c.whole[None]) ** 2).sum(2)
    number, least, measured = c.nearest(x, blocknorm.segment_norms(x, segment))
    assert (number == d.argmin(1)).all() and (least == d.min(1)).all()
    assert (c.bounds(blocknorm.segment_norms(x, segment)) <= d).all()
    assert len(x) <= measured <= len(x) * len(c.whole)


def test_screening_spares_distances(spark):
    rng = np.random.default_rng(8)
    rows = [(i, (rng.normal(size=64) * 0.05 + np.where(np.arange(64) // 8 == i % 8, 1.0, 0.0)).tolist()) for i in range(800)]
    seen = []
    blocknorm.fit(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), seen=seen)
    assert seen[-1]["vectors"] == 800 and seen[-1]["measured"] < 800 * 8 / 2


def test_clusters_without_vectors(spark):
    none = spark.createDataFrame([], "vec_id long, embedding array<float>")
    assert blocknorm.fit(none) is None
    out = blocknorm.with_inertia(blocknorm.assign(none, None), None)
    assert set(out.columns) == {"vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"} and out.count() == 0
    huge = spark.createDataFrame([(1, [1e9] * 64)], "vec_id long, embedding array<double>")
    with pytest.raises(Exception, match="exceeds"):
        blocknorm.fit(huge)


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.01"), reason="no test data")
def test_pieces_of_given_documents(spark, library):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    texts = {r["doc_id"]: r["text"] or "" for r in docs.select("doc_id", "text").collect()}
    out = piece_bpe.encode(docs, MODEL).withColumn("n", F.lit(1)).collect()
    assert len(out) == len(texts)
    for r in out:
        ids = library.encode(texts[r["doc_id"]], add_eos=True)
        assert (r["n_tokens"], r["ids_sha256"]) == (len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest())
