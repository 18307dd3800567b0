"""What the bounds of the two levels of trees prune, and what they must not."""

import numpy as np
import pytest

from thermolith.llm import topk


def clustered(n=4000, clusters=20, width=16, seed=3):
    r = np.random.default_rng(seed)
    middle = r.normal(size=(clusters, width)) * 2
    return np.floor(1024 * (middle[r.integers(0, clusters, n)] + r.normal(size=(n, width)) * 0.05)).astype(np.int64)


def best(q, r, k):
    return np.sort(q @ r.T, axis=1)[:, ::-1][:, :k]


def test_most_pairs_of_clustered_vectors_are_pruned():
    x = clustered()
    q, k = x[::100], 10
    want = best(q, x, k)
    got = topk.DualTree(q, np.arange(len(q)) + 10**6, x, np.arange(len(x)), k)
    assert (got.score == want).all() and got.pairs < 0.5 * len(q) * len(x)
    # with a score to beat, fewer still, and nothing that reaches it is lost
    beat = want[:, -1].astype(float)
    told = topk.DualTree(q, np.arange(len(q)) + 10**6, x, np.arange(len(x)), k, beat)
    assert (told.score == want).all() and told.pairs <= got.pairs
    # top level: queries are sent to few centres, and to all that hold one of their best
    centres = topk.choose_centres(x[:1000].astype(float), 64)
    away = np.sqrt(((x[:, None] - centres[None]) ** 2).sum(2))
    node = away.argmin(1)
    radii = np.array([away[node == c, c].max(initial=0) for c in range(len(centres))])
    sent = topk.may_hold(q.astype(float), beat, centres, radii)
    count = np.bincount(node, minlength=len(centres))
    assert (sent * count).sum() < 0.5 * len(q) * len(x)
    products = q @ x.T
    for i in range(len(q)):
        assert sent[i, node[products[i] >= want[i, -1]]].all()


@pytest.mark.parametrize("how", [{}, {"block": 50, "group": 7, "pivots": 5, "sample": 40}, {"pivots": 1}])
def test_search(spark, how):
    x = clustered(600, 8, 6).astype(float) / 1024
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(600, None), (601, [float("nan")] * 6), (602, [1.0, None]), (603, [5.0]), (604, [0.5] * 9), (3, x[3].tolist()), (None, x[5].tolist())]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(3)
    got = topk.top_k(df.where("vec_id % 50 = 0"), df, k=4, **how).collect()
    usable = [(i, np.pad(np.floor(1024 * np.array(v)), (0, 9 - len(v))).astype(np.int64)) for i, v in rows if v is not None and all(c is not None and np.isfinite(c) for c in v)]
    for i, v in usable:
        if i is not None and i % 50 == 0:
            want = sorted(((-int(v @ w), j if j is not None else 10**9) for j, w in usable if j != i))[:4]
            mine = sorted((r["rank"], r["score"], r["vec_id"] if r["vec_id"] is not None else 10**9) for r in got if r["query_id"] == i)
            assert [(-s, j) for s, j in want] == [(s, j) for _, s, j in mine]


def test_ids_must_be_integers(spark):
    df = spark.createDataFrame([("a", [1.0])], "vec_id string, embedding array<double>")
    with pytest.raises(TypeError, match="vec_id"):
        topk.top_k(df, df)
