"""What the operators of this package share: tables, cut lineage, byte slices, rolling hashes.

Hashes are 64-bit polynomial hashes over a random byte table, finished with a bit mixer.  They depend only on the
bytes, so every executor computes the same values.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from functools import lru_cache, reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

U64 = np.uint64


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Has Spark remove the shuffle files of a query when it ends.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def tidy(spark: SparkSession) -> Iterator[None]:
    """Shuffle files of the queries run inside go with them: what they have written stands without these."""
    before = spark.conf.get(CLEANUP, None)
    spark.conf.set(CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.unset(CLEANUP) if before is None else spark.conf.set(CLEANUP, before)


#: Bytes of rows that Spark hands to a Python worker at a time.
BATCH = "spark.sql.execution.arrow.maxBytesPerBatch"


@contextmanager
def small_batches(spark: SparkSession, most: int = 16 << 20) -> Iterator[None]:
    """Queries run inside hand Python workers no more than `most` bytes at a time, or one row."""
    before = spark.conf.get(BATCH, None)
    spark.conf.set(BATCH, str(most))
    try:
        yield
    finally:
        spark.conf.unset(BATCH) if before is None else spark.conf.set(BATCH, before)


def cut(df: DataFrame) -> DataFrame:
    """The same rows from reliable checkpoint files, which outlive any executor."""
    shared_dir(df.sparkSession)
    with tidy(df.sparkSession):
        return df.checkpoint(eager=True)


def store(df: DataFrame, path: str | None = None) -> DataFrame:
    """The same rows from compressed Parquet files in the shared folder: `cut` for wide or many rows."""
    spark = df.sparkSession
    path = path or f"{shared_dir(spark)}/table-{uuid.uuid4().hex}"
    with tidy(spark):
        df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def delete(spark: SparkSession, path: str) -> None:
    """Deletes a folder of the shared file system."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


class Tables:
    """Stored tables of one operator, deleted when it ends.  What the operator returns must not read them."""

    def __init__(self, spark: SparkSession):
        self.spark, self.paths = spark, []

    def __enter__(self) -> Tables:
        return self

    def store(self, df: DataFrame) -> DataFrame:
        self.paths.append(f"{shared_dir(self.spark)}/table-{uuid.uuid4().hex}")
        return store(df, self.paths[-1])

    def drop(self, keep: int = 0) -> None:
        """Deletes all tables but the `keep` latest."""
        while len(self.paths) > keep:
            delete(self.spark, self.paths.pop(0))

    def __exit__(self, *_) -> None:
        self.drop()


def shared_dir(spark: SparkSession) -> str:
    """This application's folder for written tables, beside its checkpoints, where every executor sees it.

    It is in spark.checkpoint.dir; only where that is unset and all executors are this machine (tests) is it in the warehouse."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        top = spark.conf.get("spark.checkpoint.dir", None)
        if top is None and not re.fullmatch(r"local(\[[^\]]*\])?", sc.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        sc.setCheckpointDir(top or f"{spark.conf.get('spark.sql.warehouse.dir', 'spark-warehouse')}/checkpoints")
    return sc.getCheckpointDir()


#: Keys with at least this part of all rows are dealt over several places; so there are no more of them than this.
HEAVY = 1000


def spread(rows: DataFrame, info: DataFrame, on: list[str], count: str, total: int, by: list[str] | None = None) -> DataFrame:
    """rows join info, which has one row for each key with the number `count` of its rows, `total` in all.

    A key with a thousandth of all rows or more is dealt over as many places as its share of the shuffle's partitions, and
    its row of info goes to each.  There are a thousand such keys at most, which bounds the list that is broadcast.  Rows are
    dealt by a hash of `by` (all columns) and of the task they come from."""
    places = F.ceil(F.col(count) * partitions(rows.sparkSession) / max(total, 1)).cast("int")
    heavy = F.broadcast(info.where(F.col(count) * HEAVY >= total).select(*(F.col(c).alias(f"_h{i}") for i, c in enumerate(on)), F.greatest(places, F.lit(1)).alias("_places")))
    same = lambda df: reduce(lambda a, b: a & b, (df[c] == heavy[f"_h{i}"] for i, c in enumerate(on)))
    marked = rows.join(heavy, same(rows), "left")
    salt = F.pmod(F.xxhash64(*(by or rows.columns), F.spark_partition_id()), F.col("_places"))
    marked = marked.withColumn("_salt", F.when(F.col("_places").isNull(), 0).otherwise(salt).cast("int")).select(*rows.columns, "_salt")
    copied = info.withColumn("_salt", F.explode(F.when(F.col(count) * HEAVY >= total, F.sequence(F.lit(0), F.greatest(places, F.lit(1)) - 1)).otherwise(F.array(F.lit(0)))))
    return marked.join(copied, [*on, "_salt"]).drop("_salt")


def integral(docs: DataFrame, column: str) -> None:
    """Raises unless the column holds whole numbers."""
    kind = docs.schema[column].dataType.simpleString()
    if kind not in ("tinyint", "smallint", "int", "bigint"):
        raise TypeError(f"{column} must hold integers, not {kind}")


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def as_bytes(col: str = "text") -> F.Column:
    """UTF-8 bytes of a text column; a null text is empty."""
    return F.coalesce(F.col(col).cast("binary"), F.lit(b""))


def byte_view(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Offsets and bytes of a binary Arrow array without nulls, without copying."""
    _, offsets, data = column.buffers()
    off = np.frombuffer(offsets, np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    return off, np.frombuffer(data, np.uint8) if data is not None and data.size else np.empty(0, np.uint8)


def slices(column: pa.Array, limit: int = 1 << 21) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, offsets from 0, bytes) of consecutive whole rows of about `limit` bytes; a longer row comes alone."""
    off, data = byte_view(column)
    first, n = 0, len(column)
    while first < n:
        end = max(first + 1, int(np.searchsorted(off, off[first] + limit, "right")) - 1)
        end = min(end, n)
        yield first, end, off[first : end + 1] - off[first], data[off[first] : off[end]]
        first = end


BASE = 0x9E3779B97F4A7C15 | 3
INVERSE = pow(BASE, -1, 1 << 64)
BYTES = np.random.Generator(np.random.PCG64(20240229)).integers(0, 1 << 63, 256, dtype=np.uint64) * U64(2) + U64(1)


@lru_cache(maxsize=2)
def powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, U64)
    if n:
        out[0] = 1
    with np.errstate(over="ignore"):
        return np.multiply.accumulate(out)


def _powers(base: int, n: int) -> np.ndarray:
    return powers(base, 1 << max(12, (n - 1).bit_length()))[:n]


def prefix_hash(data: np.ndarray) -> np.ndarray:
    """P with P[e] - P[s] = BASE**s * (polynomial hash of data[s:e])."""
    out = np.zeros(len(data) + 1, U64)
    np.cumsum(BYTES[data] * _powers(BASE, len(data)), out=out[1:])
    return out


def mix(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> U64(30))
    x *= U64(0xBF58476D1CE4E5B9)
    x ^= x >> U64(27)
    x *= U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


def span_hash(prefix: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Mixed 64-bit hashes of data[start:end] for arrays of bounds."""
    return mix((prefix[end] - prefix[start]) * _powers(INVERSE, len(prefix))[start] + (end - start).astype(U64))


SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True


def word_bounds(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends and row of every word `[^\\x20\\x09-\\x0D]+`; words don't cross rows."""
    inside = ~SPACE[data]
    n = len(data)
    first = np.zeros(n + 1, bool)
    first[off] = True  # a row begins here
    start = inside.copy()
    start[1:] &= ~inside[:-1] | first[1:n]
    starts = np.flatnonzero(start)
    stop = inside.copy()
    stop[:-1] &= ~inside[1:] | first[1:n]
    ends = np.flatnonzero(stop) + 1
    return starts, ends, np.searchsorted(off, starts, "right") - 1
