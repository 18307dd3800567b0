"""Token ids in ORC files.

Documents are range-partitioned and sorted by id, encoded where they lie, and written by Spark's ORC writer: integer
run-length encoding inside stripes of bounded bytes, row indexes every `stride` rows and Bloom filters on the document
id.  Readers take stripes in parallel, and filters on the id skip files, stripes and row groups by their statistics.

Words are split from whole texts with arrays, and each different word is encoded by the tokenizers library's own model.
A null text is empty and has only the end id.  Null ids come first; rows alike in id are ordered by text hash.  An empty
table gives files without rows.  Other columns are ignored.
"""

from __future__ import annotations

import uuid
import zlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from . import common, pretoken

END = 1


@lru_cache(maxsize=2)
def encoder(path: str):
    """texts -> (ids, counts), for a vocabulary with word ends; kept by each Python worker."""
    import json

    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    model, letters = tokenizer.model, pretoken.byte_letters()
    special = {t["content"]: t["id"] for t in json.loads(tokenizer.to_str())["added_tokens"]}
    spell = lambda w: w.encode().decode("latin-1").translate(letters)
    words = pretoken.Words(lambda ws: [[t.id for t in model.tokenize(spell(w))] for w in ws])
    return lambda texts: pretoken.encode_rows(texts, words, pretoken.folded_words, special, pretoken.fold)


def encode(docs: DataFrame, path: str, end: int = END) -> DataFrame:
    """(doc_id, text as binary) -> (doc_id, ids array<int>), row by row in the order they come."""

    def run(batches):
        call = encoder(path)
        for b in batches:
            first = 0
            for part in pretoken.in_slices([x.decode("utf-8", "replace") for x in b.column(1).to_pylist()]):
                ids, size = call(part)
                ends = np.cumsum(size)
                full = np.insert(ids.astype(np.int32), ends, end)
                off = np.concatenate([[0], ends + np.arange(1, len(size) + 1)]).astype(np.int32)
                yield pa.RecordBatch.from_arrays([b.column(0).slice(first, len(part)), pa.ListArray.from_arrays(pa.array(off), pa.array(full))], names=["doc_id", "ids"])
                first += len(part)

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.mapInArrow(run, f"doc_id {kind}, ids array<int>")


def write(docs: DataFrame, vocabulary: str, path: str | None = None, id_col: str = "doc_id", text: str = "text", end: int = END, stripe: int = 8 << 20, stride: int = 5000, files: int | None = None) -> str:
    """Writes (doc_id, ids) in ascending order of ids, over all files in the order of their numbers; returns the folder."""
    spark = docs.sparkSession
    path = path or f"{common.shared_dir(spark)}/tokens-{uuid.uuid4().hex}"
    rows = docs.select(F.col(id_col).alias("doc_id"), common.as_bytes(text).alias("_text"))
    rows = rows.repartitionByRange(files or common.partitions(spark), "doc_id", F.xxhash64("_text")).sortWithinPartitions("doc_id", F.xxhash64("_text"))
    how = {"orc.stripe.size": stripe, "orc.row.index.stride": stride, "orc.bloom.filter.columns": "doc_id", "orc.bloom.filter.fpp": 0.01, "compression": "zstd"}
    encode(rows, vocabulary, end).write.options(**how).orc(path)
    return path


def read(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, ids); filters on doc_id reach the files' statistics and Bloom filters."""
    return spark.read.orc(path)


def look_up(spark: SparkSession, path: str, ids: list[int]) -> DataFrame:
    return read(spark, path).where(F.col("doc_id").isin(ids))


def digest(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start (ids of all documents before it in the files), n_tokens, ids_crc32, from the files.

    Files are in the order of the numbers that Spark's writer gives them: that of the task, then that of the file among the
    task's (spark.sql.files.maxRecordsPerFile makes several).  Rows are in the order of the files."""
    number = lambda p: F.regexp_extract("_metadata.file_name", p, 1).cast("long")
    stored = read(spark, path).select("doc_id", "ids", F.struct(number(r"^part-(\d+)").alias("task"), number(r"-c(\d+)\.[^-]*$").alias("file")).alias("file"), F.col("_metadata.file_block_start").alias("block"))

    def run(batches):
        row = 0  # rows of a file's block come in their order, in one task
        for b in batches:
            lists = b.column(1)
            at = pa.array(np.arange(row, row + len(b)))
            row += len(b)
            off = lists.offsets.to_numpy().astype(np.int64)
            flat = np.ascontiguousarray(lists.values.to_numpy(zero_copy_only=False).astype("<u4"))
            crc = [zlib.crc32(flat[s:e]) for s, e in zip(off[:-1].tolist(), off[1:].tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), b.column(3), at, pa.array(np.diff(off), pa.int64()), pa.array(crc, pa.int64())], names=["doc_id", "file", "block", "row", "n_tokens", "ids_crc32"])

    kind = stored.schema["doc_id"].dataType.simpleString()
    rows = common.cut(stored.mapInArrow(run, f"doc_id {kind}, file struct<task:bigint,file:bigint>, block long, row long, n_tokens long, ids_crc32 long"))
    # files hold consecutive ranges: sums of files first, then inside each
    files = rows.groupBy("file").agg(F.sum("n_tokens").alias("_sum"))
    files = files.select(F.col("file").alias("_file"), (F.sum("_sum").over(W.orderBy("file")) - F.col("_sum")).alias("_begin"))
    inside = F.sum("n_tokens").over(W.partitionBy("file").orderBy("block", "row").rowsBetween(W.unboundedPreceding, W.currentRow)) - F.col("n_tokens")
    out = rows.withColumn("_inside", inside).join(files, F.col("file") == F.col("_file"))
    return out.select("doc_id", (F.col("_begin") + F.col("_inside")).alias("start"), "n_tokens", "ids_crc32")
