"""Blocks of groups, contexts settled by tasks, and a passage with as many surroundings as documents."""

import random

import numpy as np
import pyarrow as pa
import pytest
from test_llm import brute_spans

from thermolith.llm import suffix_dedup


def batches(groups, rows):
    """Arrow batches of `rows` rows each, of groups given as (mh, place, bytes of each row)."""
    flat = [(m, p, b"x" * n) for m, p, sizes in groups for n in sizes]
    for k in range(0, len(flat), rows):
        part = flat[k : k + rows]
        cols = [pa.array([x[0] for x in part], pa.int64()), pa.array([x[1] for x in part], pa.int32()), pa.array([False] * len(part)), *(pa.array([k + i for i in range(len(part))], pa.int64()) for _ in range(3)), pa.array([x[2] for x in part], pa.binary())]
        yield pa.RecordBatch.from_arrays(cols, names=["mh", "place", "dealt", "ord", "th", "spot", "c"])


@pytest.mark.parametrize("rows", [1, 3, 7, 1000])
@pytest.mark.parametrize("limit", [1, 10, 50, 10_000])
def test_blocks(rows, limit):
    r = random.Random(rows * limit)
    groups = [(g // 2, g % 2, [r.randint(1, 9) for _ in range(r.choice([1, 2, 3, 40]))]) for g in range(60)]
    out = list(suffix_dedup._blocks(batches(groups, rows), limit))
    assert sorted(x for t, _ in out for x in t["ord"].to_pylist()) == list(range(sum(len(g[2]) for g in groups)))
    parts = {}
    for number, (t, parted) in enumerate(out):
        keys = set(zip(t["mh"].to_pylist(), t["place"].to_pylist(), strict=True))
        assert not parted or len(keys) == 1
        for k in keys:
            parts.setdefault(k, []).append((number, parted))
        assert sum(map(len, t["c"].to_pylist())) < limit + 9 * rows + max(sum(g[2]) for g in groups if g[:2] in keys) * (not parted)
    assert all(len(v) == 1 or all(parted for _, parted in v) for v in parts.values())  # in several blocks only what is told of


def test_settled():
    mh, ch = np.array([1, 1, 1, 1, 2, 1], np.uint64), np.array([5, 5, 5, 6, 5, 5], np.uint64)
    o, th, spot = np.array([3, 2, 2, 1, 0, 2]), np.zeros(6, np.int64), np.array([1, 7, 9, 0, 0, 7])
    again, crowded = suffix_dedup._settled(mh, ch, [spot, th, o], 2)
    assert again.tolist() == [True, False, True, False, False, False]  # rows alike are one
    assert crowded.tolist() == [True, True, True, True, False, True]


@pytest.mark.parametrize("how", [{}, {"many": 3, "together": 100}, {"block_bytes": 2000}])
def test_one_passage_in_every_document(spark, how):
    r = random.Random(9)
    word = lambda n: "".join(r.choice("abcdefghij ") for _ in range(n))
    passage = word(130)
    texts = [word(60) + passage + word(60) for _ in range(120)] + [passage, passage[:100], passage[:99]] + [word(250)] * 3
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(5)
    got = {x["doc_id"]: (x["n_bytes"], x["n_removed"], x["n_spans"], x["kept_sha256"]) for x in suffix_dedup.digest(df, **how).collect()}
    assert got == brute_spans(enumerate(texts))


def test_ids_must_be_integers(spark):
    with pytest.raises(TypeError, match="doc_id"):
        suffix_dedup.digest(spark.createDataFrame([("a", "b")], "doc_id string, text string"))
