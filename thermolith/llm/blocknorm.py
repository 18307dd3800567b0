"""Centroid clustering of integer vectors, screened by norms of segments.

Each vector is cut into segments, and their norms, found once, stand beside it as its compressed form.  By Cauchy and
Schwarz no inner product of two segments exceeds the product of their norms, so the squared distance of a vector from a
centroid is at least the sum over segments of (norm - norm)^2, which needs the compressed forms only.  For every vector
the centroid of the least bound is measured first, in exact integers; of the others only those whose bound does not
exceed the least distance so far are measured.  Bounds are lowered by more than their rounding errors, so that no nearest
centroid is ever screened out, and ties go to the smaller number.

A round is one pass over the stored vectors.  A task gives one row of counts and sums for each cluster, Spark adds these
up, and k x width sums reach the driver, whatever the number of vectors.  Means are exact: floor(sum / count) of whole
numbers.  Without movement of a centroid the rounds left would change nothing and are left out.

Components are scaled and floored: floor(scale * x).  Vectors that are null, hold a null or non-finite component or have
another number of components take no part; components of 2^26 or more after scaling raise.  First centroids are the k
vectors with the smallest sha256 of `seed:id` (then by id and components, as ids may repeat); with fewer vectors there are
fewer centroids, without any there are no rows.  Rows alike are vectors of their own; a null id makes a null hash and comes
first.  Other columns, whatever their names, are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common
from .topk import quantised

LARGEST = 1 << 26


def vectors(df: DataFrame, width: int, scale: float = 1024, id_col: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(id, v) of the vectors that take part."""
    kept = df.select(F.col(id_col).alias("id"), F.when(F.size(vector) == width, quantised(vector, scale)).alias("v")).where(F.col("v").isNotNull())
    fits = F.forall("v", lambda x: F.abs(x) < LARGEST)
    return kept.withColumn("v", F.when(fits, F.col("v")).otherwise(F.raise_error(F.lit(f"a component exceeds {LARGEST - 1} after scaling")).cast("array<bigint>")).cast("array<int>"))


def segment_norms(x: np.ndarray, segment: int) -> np.ndarray:
    """Euclidean norms of consecutive segments of each row; the last one may be shorter."""
    return np.sqrt(np.add.reduceat(x.astype(np.float64) ** 2, np.arange(0, max(x.shape[1], 1), segment), axis=1))


class Centroids:
    """Whole centroids, their compressed forms, and the search for the nearest."""

    def __init__(self, whole: np.ndarray, segment: int):
        self.whole, self.segment = whole.astype(np.int64), segment
        self.norms = segment_norms(self.whole, segment)

    def bounds(self, norms: np.ndarray) -> np.ndarray:
        """Vectors x centroids: what no squared distance is below."""
        low = np.stack([((norms - c) ** 2).sum(1) for c in self.norms], 1)
        size = (norms**2).sum(1)[:, None] + (self.norms**2).sum(1)[None]
        return np.floor(low - 1e-9 * size) - 1

    def nearest(self, x: np.ndarray, norms: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
        """Number of each row's nearest centroid, its squared distance, and how many distances were measured."""
        low = self.bounds(norms)
        where = low.argmin(1)
        least = self._distance(x, where)
        number, measured = where.copy(), len(x)
        for c in range(len(self.whole)):
            open_ = np.flatnonzero((low[:, c] <= least) & (where != c))
            d = self._distance(x[open_], np.full(len(open_), c))
            better = (d < least[open_]) | ((d == least[open_]) & (c < number[open_]))
            least[open_[better]], number[open_[better]] = d[better], c
            measured += len(open_)
        return number, least, measured

    def _distance(self, x: np.ndarray, c: np.ndarray) -> np.ndarray:
        away = x - self.whole[c]
        return np.einsum("nd,nd->n", away, away)

    def digests(self) -> list[str]:
        return [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in self.whole.tolist()]


def _rows(batch: pa.RecordBatch, width: int, column: int) -> np.ndarray:
    return batch.column(column).flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(-1, width)


def compress(df: DataFrame, segment: int, width: int) -> DataFrame:
    """Adds `norms`, the compressed form, to (v)."""

    def run(batches: Iterator[pa.RecordBatch]):
        for b in batches:
            norms = segment_norms(_rows(b, width, 0), segment)
            off = np.arange(len(norms) + 1, dtype=np.int32) * norms.shape[1]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.ListArray.from_arrays(pa.array(off), pa.array(norms.ravel()))], names=["v", "norms"])

    return df.select("v").mapInArrow(run, "v array<int>, norms array<double>")


def totals(compressed: DataFrame, centroids: Centroids, width: int) -> dict[int, tuple[int, list[int], int]]:
    """Of each cluster that has any: its vectors' number, their sums by component, and the distances measured for all."""
    segments = centroids.norms.shape[1]
    k = len(centroids.whole)

    def run(batches: Iterator[pa.RecordBatch]):
        count, sums, measured = np.zeros(k, np.int64), np.zeros((k, width), np.int64), 0
        for b in batches:
            x, norms = _rows(b, width, 0), b.column(1).flatten().to_numpy(zero_copy_only=False).reshape(-1, segments)
            number, _, m = centroids.nearest(x, norms)
            measured += m
            count += np.bincount(number, minlength=k)
            for c in np.unique(number):
                sums[c] += x[number == c].sum(0)
        there = np.flatnonzero(count)
        rows = [[int(c), int(count[c]), sums[c].tolist(), measured if c == there[0] else 0] for c in there]
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate((pa.int32(), pa.int64(), pa.list_(pa.int64()), pa.int64()))], names=["c", "n", "s", "m"])

    part = compressed.mapInArrow(run, "c int, n long, s array<bigint>, m long")
    sums = [F.sum(F.get("s", F.lit(i)).cast("decimal(38,0)")).alias(f"s{i}") for i in range(width)]
    rows = part.groupBy("c").agg(F.sum("n").alias("n"), F.sum("m").alias("m"), *sums).collect()  # a row for each cluster
    return {r["c"]: (r["n"], [int(r[f"s{i}"]) for i in range(width)], r["m"]) for r in rows}


def fit(df: DataFrame, k: int = 8, rounds: int = 10, width: int = 64, segment: int = 4, scale: float = 1024, seed: str = "3", id_col: str = "vec_id", vector: str = "embedding", seen: list[dict] | None = None) -> Centroids | None:
    """The centroids after `rounds` rounds, or None without vectors.  `seen` gets the counts of each round."""
    kept = vectors(df, width, scale, id_col, vector)
    key = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("id").cast("string")), 256)
    first = kept.select("v", key.alias("key"), "id").orderBy(F.asc_nulls_first("key"), "id", "v").limit(k).collect()
    if not first:
        return None
    whole = np.array([r["v"] for r in first], np.int64)
    with common.Tables(df.sparkSession) as tables:
        compressed = tables.store(compress(kept, segment, width))
        for _ in range(rounds):
            found = totals(compressed, Centroids(whole, segment), width)
            new = whole.copy()
            for c, (n, sums, _) in found.items():
                new[c] = [s // n for s in sums]
            if seen is not None:
                seen.append({"vectors": sum(n for n, _, _ in found.values()), "measured": sum(m for *_, m in found.values())})
            if (new == whole).all():
                break
            whole = new
    return Centroids(whole, segment)


def assign(df: DataFrame, centroids: Centroids | None, width: int = 64, scale: float = 1024, id_col: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """id, cluster, distance (squared) of every vector that takes part."""
    kept = vectors(df, width, scale, id_col, vector)
    kind = kept.schema["id"].dataType.simpleString()
    if centroids is None:
        return kept.select(F.col("id").alias(id_col), F.lit(0).alias("cluster"), F.lit(0).cast("long").alias("distance")).where(F.lit(False))

    def run(batches: Iterator[pa.RecordBatch]):
        for b in batches:
            x = _rows(b, width, 1)
            number, distance, _ = centroids.nearest(x, segment_norms(x, centroids.segment))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(number.astype(np.int32)), pa.array(distance)], names=[id_col, "cluster", "distance"])

    return kept.mapInArrow(run, f"`{id_col}` {kind}, cluster int, distance long")


def with_inertia(assigned: DataFrame, centroids: Centroids | None) -> DataFrame:
    """Adds cluster_inertia and inertia, the sums of distances over the cluster and over all, and centroid_sha256."""
    spark = assigned.sparkSession
    # one row for each cluster
    sums = {r["cluster"]: r["s"] for r in assigned.groupBy("cluster").agg(F.sum("distance").alias("s")).collect()}
    digests = centroids.digests() if centroids else []
    rows = [(c, s, sum(sums.values()), digests[c]) for c, s in sums.items()]
    return assigned.join(F.broadcast(spark.createDataFrame(rows, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")), "cluster")
