"""Exact top-k inner products by dual-tree search over cover trees.

Top level: up to `pivots` centres, chosen farthest first from a sample of `sample` candidates, are the first level of a cover
tree; every candidate and every query is put under its nearest centre, and a centre's covering radius is taken over all its
candidates.  A centre's candidates are dealt into blocks of bounded size, its queries into groups.  Each query is first
compared with one block under its nearest centre, which gives a kth score to beat.  No product of query q with a candidate
under centre c of radius b exceeds <q, c> + |q| b: where that is below the query's kth score, the query isn't sent there.

In a task, a query group and a candidate block are indexed by cover trees, and pairs of nodes are walked.  Two nodes with
centres q, r and covering radii a, b hold no product above <q, r> + |q| b + |r| a + a b; a pair is pruned when that is below
the worst kth score that any query under the query node has so far, its score to beat included.  Leaves are compared with
exact integer arithmetic.  The best k of each block meet in a window by query.

What bounds can't rule out is compared: in directions without structure (vectors drawn evenly from a sphere of many
dimensions) covering radii are as large as the vectors and nothing is pruned, here or by any bound of this kind.

Components are scaled and floored: floor(scale * x).  Vectors that are null, or hold a null or non-finite component, take
no part; shorter vectors count as padded with zeros, very long ones are read whole.  Ids must be integers; anything else
raises.  Ties go to the smaller id (null last).  A query's own row is each row with its id.  Queries alike in id and vector
are answered once.  No queries or no candidates: no rows.  Other columns, whatever their names, are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from . import common

LEAF = 24
LAST = np.iinfo(np.int64).max


class CoverTree:
    """Nodes of a cover tree over the rows of X: centre row, covering radius, children or member rows.

    A node's children are chosen farthest first until each member lies within half the node's radius of a child, so
    the children are half a radius apart and radii halve from level to level."""

    def __init__(self, x: np.ndarray, leaf: int = LEAF):
        self.x, self.centre, self.radius, self.children, self.members = x, [], [], [], []
        if len(x):
            self.squares = (x**2).sum(1)
            self._grow(leaf)
        self.centre, self.radius = np.array(self.centre, np.int64), np.array(self.radius)
        self.norm = np.sqrt((x[self.centre] ** 2).sum(1))
        self.is_leaf = np.array([not c for c in self.children], bool)

    def _node(self, centre: int, members: np.ndarray, away: np.ndarray) -> int:
        self.centre.append(centre)
        self.radius.append(float(away.max()) * (1 + 1e-9))
        self.children.append([])
        self.members.append(members)
        return len(self.centre) - 1

    def _away(self, centre: int, x: np.ndarray, squares: np.ndarray) -> np.ndarray:
        return np.sqrt(np.maximum(squares + self.squares[centre] - 2 * (x @ self.x[centre]), 0))

    def _grow(self, leaf: int) -> None:
        everyone = np.arange(len(self.x))
        todo = [self._node(0, everyone, self._away(0, self.x, self.squares))]
        while todo:
            node = todo.pop()
            members = self.members[node]
            if len(members) <= leaf or self.radius[node] == 0:
                continue
            x, squares = self.x[members], self.squares[members]
            centres, nearest, away = [self.centre[node]], np.zeros(len(members), np.int64), self._away(self.centre[node], x, squares)
            while away.max() > self.radius[node] / 2:
                centres.append(int(members[away.argmax()]))
                d = self._away(centres[-1], x, squares)
                closer = d < away
                nearest[closer], away[closer] = len(centres) - 1, d[closer]
            for k, c in enumerate(centres):
                own = nearest == k
                child = self._node(c, members[own], away[own])
                self.children[node].append(child)
                todo.append(child)
            self.members[node] = members[:0]


class DualTree:
    """The k best candidates of each query; rows of `q` and `r` are integers.  Scores below `beat` need not be found."""

    def __init__(self, q: np.ndarray, qid: np.ndarray, r: np.ndarray, rid: np.ndarray, k: int, beat: np.ndarray | None = None):
        self.beat = np.full(len(q), -np.inf) if beat is None else beat
        self.q, self.qid, self.r, self.rid, self.k = q, qid, r, rid, k
        largest = float(np.abs(q).max(initial=0)) * float(np.abs(r).max(initial=0)) * max(1, q.shape[1])
        self.exact = q.dtype if largest >= 2**53 else np.float64  # products up to 2**53 are exact in doubles
        self.qt, self.rt = CoverTree(q.astype(np.float64)), CoverTree(r.astype(np.float64))
        self.score = np.full((len(q), k), -LAST, np.int64)
        self.best = np.full((len(q), k), LAST, np.int64)
        self.found = np.zeros((len(q), k), bool)
        self.worst = np.full(len(self.qt.centre), -np.inf)
        for n in reversed(range(len(self.qt.centre))):  # children have larger numbers
            below = self.qt.children[n]
            self.worst[n] = self.worst[below].min() if below else self.beat[self.qt.members[n]].min(initial=np.inf)
        self.pairs = 0
        if len(q) and len(r):
            self._walk()

    def _bounds(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """What no product of members of query nodes a and candidate nodes b exceeds."""
        qt, rt = self.qt, self.rt
        up = qt.x[qt.centre[a]] @ rt.x[rt.centre[b]].T
        ra, rb = qt.radius[a][:, None], rt.radius[b][None]
        up += qt.norm[a][:, None] * rb + rt.norm[b][None] * ra + ra * rb
        return up + 1e-9 * (np.abs(up) + 1)

    def _walk(self) -> None:
        qt, rt = self.qt, self.rt
        self.inner = [n for n in reversed(range(len(qt.centre))) if qt.children[n]]  # children have larger numbers
        todo = [(0, 0, np.inf)]
        while todo:
            a, b, up = todo.pop()
            if up < self.worst[a]:
                continue
            below = np.array(qt.children[a] or [a]), np.array(rt.children[b] or [b])
            ups = self._bounds(*below)
            keep = ups >= self.worst[below[0]][:, None]
            leaf = qt.is_leaf[below[0]][:, None] & rt.is_leaf[below[1]][None]
            deeper = np.argwhere(keep & ~leaf)
            order = np.argsort(ups[deeper[:, 0], deeper[:, 1]], kind="stable")  # the most promising comes off the stack first
            todo += [(int(below[0][i]), int(below[1][j]), float(ups[i, j])) for i, j in deeper[order]]
            self._leaves(*below, np.where(keep & leaf, ups, -np.inf))

    def _leaves(self, a: np.ndarray, b: np.ndarray, ups: np.ndarray) -> None:
        """Compares leaves: for each query leaf the candidates of the highest bounds first, then those above its worst kth score."""
        first = min(ups.shape[1], 2 * self.k)
        top = np.argpartition(-ups, first - 1, axis=1)[:, :first]
        chosen = np.zeros(ups.shape, bool)
        np.put_along_axis(chosen, top, True, 1)
        chosen &= ups > -np.inf
        self._compare(a, b, chosen)
        self._compare(a, b, ~chosen & (ups > -np.inf) & (ups >= self.worst[a][:, None]))

    def _compare(self, a: np.ndarray, b: np.ndarray, pairs: np.ndarray, most: int = 1 << 18) -> None:
        """Exact products of all members of the chosen pairs of leaves, in parts of bounded size."""
        i, j = np.nonzero(pairs)
        if not len(i):
            return
        rsize = np.array([len(self.rt.members[n]) for n in b])
        rall, rbegin = np.concatenate([self.rt.members[n] for n in b]), np.cumsum(rsize) - rsize
        qsize = np.array([len(self.qt.members[n]) for n in a])
        qall, qbegin = np.concatenate([self.qt.members[n] for n in a]), np.cumsum(qsize) - qsize
        step = max(1, most // int(qsize.max() * rsize.max()))
        for k in range(0, len(i), step):
            x, y = i[k : k + step], j[k : k + step]
            n = qsize[x] * rsize[y]
            inner = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
            width = np.repeat(rsize[y], n)
            qs = qall[np.repeat(qbegin[x], n) + inner // width]
            rs = rall[np.repeat(rbegin[y], n) + inner % width]
            self._take(qs, rs)
        for n in a[qsize > 0]:
            own = self.qt.members[n]
            self.worst[n] = np.maximum(self.beat[own], np.where(self.found[own, -1], self.score[own, -1], -np.inf)).min()
        for n in self.inner:  # a group's bound is the worst kth score below it
            self.worst[n] = self.worst[self.qt.children[n]].min()

    def _take(self, qs: np.ndarray, rs: np.ndarray) -> None:
        """Merges the products of queries qs with candidates rs into the best k."""
        self.pairs += len(qs)
        s = np.einsum("nd,nd->n", self.q[qs].astype(self.exact), self.r[rs].astype(self.exact)).astype(np.int64)
        ids = self.rid[rs]
        ok = (ids != self.qid[qs]) | (ids == LAST)
        qs, s, ids = qs[ok], s[ok], ids[ok]
        touched = np.unique(qs)
        held = np.nonzero(self.found[touched])
        query = np.concatenate([touched[held[0]], qs])
        score = np.concatenate([self.score[touched][held], s])
        best = np.concatenate([self.best[touched][held], ids])
        order = np.lexsort((best, -score, query))
        query, score, best = query[order], score[order], best[order]
        place = np.arange(len(query)) - np.searchsorted(query, query)
        top = place < self.k
        self.score[query[top], place[top]], self.best[query[top], place[top]], self.found[query[top], place[top]] = score[top], best[top], True


def quantised(vector: str, scale: float) -> Column:
    """floor(scale * x) of each component, or null if the vector takes no part."""
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != F.lit(float("inf"))))
    return F.when(F.col(vector).isNotNull() & finite, F.transform(vector, lambda x: F.floor(x.cast("double") * scale)))


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    lists = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    off = lists.offsets.to_numpy().astype(np.int64)
    values = lists.values.to_numpy(zero_copy_only=False).astype(np.int64)
    size = np.diff(off)
    out = np.zeros((len(size), width), np.int64)
    at = np.repeat(np.arange(len(size)), size)
    out[at, np.arange(int(size.sum())) - np.repeat(np.cumsum(size) - size, size)] = values[off[0] : off[-1]]
    return out


def choose_centres(x: np.ndarray, pivots: int) -> np.ndarray:
    """Rows of x, farthest first, until each row lies within half the first one's radius or there are `pivots`."""
    if not len(x):
        return x
    squares = (x**2).sum(1)
    away = lambda c: np.sqrt(np.maximum(squares + squares[c] - 2 * (x @ x[c]), 0))
    centres, near = [0], away(0)
    radius = near.max()
    while len(centres) < pivots and near.max() > radius / 2:
        centres.append(int(near.argmax()))
        near = np.minimum(near, away(centres[-1]))
    return x[centres]


def may_hold(q: np.ndarray, beat: np.ndarray, centres: np.ndarray, radii: np.ndarray) -> np.ndarray:
    """Queries x centres: whether a candidate under the centre may reach the query's score to beat."""
    up = q @ centres.T + np.sqrt((q**2).sum(1))[:, None] * radii[None]
    return up + 1e-9 * (np.abs(up) + 1) >= beat[:, None]


def _width(column: pa.ChunkedArray | pa.Array) -> int:
    lists = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return int(np.diff(lists.offsets.to_numpy()).max(initial=0)) if len(lists) else 0


def _as_wide(x: np.ndarray, width: int) -> np.ndarray:
    return np.pad(x, ((0, 0), (0, max(0, width - x.shape[1]))))


def _placed(df: DataFrame, centres: np.ndarray) -> DataFrame:
    """Adds the number of the nearest centre, `node`, and the distance to it, `away`."""

    def run(batches):
        for b in batches:
            x = _matrix(b.column(1), max(_width(b.column(1)), centres.shape[1])).astype(np.float64)
            c = _as_wide(centres, x.shape[1])
            squares = np.maximum((x**2).sum(1)[:, None] + (c**2).sum(1)[None] - 2 * (x @ c.T), 0)
            node = squares.argmin(1)
            away = np.sqrt(((x - c[node]) ** 2).sum(1)) * (1 + 1e-9)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(node.astype(np.int32)), pa.array(away)], names=["id", "v", "h", "node", "away"])

    return df.select("id", "v", "h").mapInArrow(run, "id long, v array<long>, h long, node int, away double")


FOUND = "h long, query_id long, vec_id long, score long"


def _searched(left: DataFrame, right: DataFrame, k: int) -> DataFrame:
    """The best k of each query (id, v, h, beat) among the candidates (id, v) of its spot."""

    def search(a: pa.Table, b: pa.Table) -> pa.Table:
        if not len(a) or not len(b):
            empty = pa.array([], pa.int64())
            return pa.table({"h": empty, "query_id": empty, "vec_id": empty, "score": empty})
        width = max(1, _width(a["v"]), _width(b["v"]))
        ids = [t["id"].combine_chunks().fill_null(LAST).to_numpy() for t in (a, b)]
        got = DualTree(_matrix(a["v"], width), ids[0], _matrix(b["v"], width), ids[1], k, a["beat"].combine_chunks().to_numpy())
        at, col = np.nonzero(got.found)
        best = got.best[at, col]
        return pa.table({"h": a["h"].combine_chunks().to_numpy()[at], "query_id": pa.array(ids[0][at], mask=ids[0][at] == LAST), "vec_id": pa.array(best, mask=best == LAST), "score": got.score[at, col]})

    spot = F.struct("node", "block", "group")
    left, right = (df.withColumn("spot", spot) for df in (left.select("id", "v", "h", "beat", "node", "block", "group"), right.select("id", "v", "node", "block", "group")))
    return left.select("spot", "id", "v", "h", "beat").groupBy("spot").cogroup(right.select("spot", "id", "v").groupBy("spot")).applyInArrow(search, FOUND)


def _number(of: dict[int, int], node: str = "node") -> Column:
    """The entry of each node in a table of as many entries as there are centres."""
    return F.coalesce(F.create_map(*(F.lit(int(x)) for e in of.items() for x in e))[F.col(node)], F.lit(0)) if of else F.lit(0)


def top_k(queries: DataFrame, candidates: DataFrame, k: int = 10, id_col: str = "vec_id", vector: str = "embedding", scale: float = 1024, block: int = 8192, group: int = 2048, pivots: int = 64, sample: int = 2048) -> DataFrame:
    """query_id, rank (from 1), vec_id, score: the k highest products of each query."""
    common.integral(candidates, id_col)
    common.integral(queries, id_col)
    take = lambda df: df.select(F.col(id_col).cast("long").alias("id"), quantised(vector, scale).alias("v")).where(F.col("v").isNotNull()).withColumn("h", F.xxhash64("id", "v"))
    numbers = lambda n: F.explode(F.sequence(F.lit(0), F.greatest(n, F.lit(1)) - 1))
    with common.Tables(candidates.sparkSession) as tables:
        some = take(candidates).orderBy("h").limit(sample).select("v").toArrow()["v"]
        centres = choose_centres(_matrix(some, max(1, _width(some))).astype(np.float64), pivots) if len(some) else np.zeros((1, 1))
        r = tables.store(_placed(take(candidates), centres))
        q = tables.store(_placed(take(queries).distinct(), centres))
        nodes = {x["node"]: (x["n"], x["far"]) for x in r.groupBy("node").agg(F.count(F.lit(1)).alias("n"), F.max("away").alias("far")).collect()}
        blocks = {c: -(-n // block) for c, (n, _) in nodes.items()}
        groups = lambda df: {x["node"]: -(-x["n"] // group) for x in df.groupBy("node").agg(F.count(F.lit(1)).alias("n")).collect()}
        r = r.withColumn("block", F.pmod("h", F.greatest(_number(blocks), F.lit(1))).cast("int"))
        # a score to beat from one block under the nearest centre
        at_home = groups(q)
        first = q.withColumns({"block": F.lit(0), "beat": F.lit(float("-inf")), "group": F.pmod("h", F.greatest(_number(at_home), F.lit(1))).cast("int")})
        seeds = tables.store(_searched(first, r.where("block = 0").withColumn("group", numbers(_number(at_home))), k))
        beat = seeds.groupBy(F.col("h").alias("_h"), F.col("query_id").alias("_q")).agg(F.min("score").alias("low"), F.count(F.lit(1)).alias("n"))
        known = F.when(F.col("n") >= k, F.col("low").cast("double")).otherwise(F.lit(float("-inf")))
        q = q.join(beat, (F.col("h") == F.col("_h")) & F.col("id").eqNullSafe(F.col("_q")), "left").select("id", "v", "h", F.col("node").alias("home"), F.coalesce(known, F.lit(float("-inf"))).alias("beat"))
        there = sorted(nodes)
        radii = np.array([nodes[c][1] for c in there])

        def run(batches):
            for b in batches:
                x = _matrix(b.column(1), max(_width(b.column(1)), centres.shape[1])).astype(np.float64)
                row, col = np.nonzero(may_hold(x, b.column(4).to_numpy(), _as_wide(centres[there], x.shape[1]), radii))
                yield pa.RecordBatch.from_arrays([*(c.take(pa.array(row)) for c in b.columns), pa.array(np.array(there, np.int32)[col])], names=["id", "v", "h", "home", "beat", "node"])

        sent = tables.store(q.mapInArrow(run, "id long, v array<long>, h long, home int, beat double, node int"))
        met = groups(sent)
        sent = sent.withColumns({"block": numbers(_number(blocks)), "group": F.pmod("h", F.greatest(_number(met), F.lit(1))).cast("int")}).where("node != home or block != 0")
        rest = _searched(sent, r.where(F.col("node").isin([int(c) for c in met])).withColumn("group", numbers(_number(met))), k)
        order = W.partitionBy("query_id", "h").orderBy(F.desc("score"), F.asc_nulls_last("vec_id"))
        out = seeds.unionByName(rest).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
        return common.store(out.select("query_id", "rank", "vec_id", "score"))
