"""Two-pass external shuffle into shards, with DataFrame functions only.

Pass 1 counts and scatters: a seeded hash of the whole row deals records uniformly into buckets small enough for an
executor's memory.  Pass 2 shuffles each bucket by Fisher-Yates (Spark's shuffle(array, seed)) and gives its records
consecutive places after those of the earlier buckets; the shards are even cuts of these places and are written as
files.  The law is `rows`: shard sizes differ by one record at most.

The bucket hash covers id and text, so copies of one text spread over all buckets, and bucket k is dealt to task k, so a task
holds no more than one.  Rows alike in id and text share a bucket; then a bucket can be larger than planned.  Bucket arrays
are sorted before the shuffle, so reruns agree at any number of partitions and of buckets; rows alike in all columns are interchangeable.  Very long texts are whole
records.  Null ids and texts are hashed like values; an empty table gives empty shards.  All columns are carried, whatever
their names and types: where `docs` has a column _shard or _slot, the new one has one more _ before it.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from . import common


def _size(text: str) -> Column:
    return F.coalesce(F.octet_length(F.col(text)), F.lit(0)).cast("long") + 1


def bucket_of(id_col: str, text: str, n: int, seed: int) -> Column:
    return F.pmod(F.xxhash64(F.lit(seed), F.col(id_col), F.col(text)), F.lit(n)).cast("int")


def _sorted_rows(docs: DataFrame) -> Column:
    """The group's rows as a sorted array; maps, which have no order, are sorted by their JSON."""
    maps = [c for c, kind in docs.dtypes if "map<" in kind]
    if not maps:
        return F.sort_array(F.collect_list("_row"))  # the list leaves the row that says where the bucket begins out
    plain = [F.col(f"_row.`{c}`").alias(f"k{i}") for i, c in enumerate(docs.columns) if c not in maps]
    keyed = F.struct(F.struct(*plain, F.to_json(F.struct(*(F.col(f"_row.`{c}`") for c in maps))).alias("json")).alias("key"), F.col("_row"))
    order = lambda a, b: F.when(a["key"] < b["key"], -1).when(a["key"] > b["key"], 1).otherwise(0)
    return F.transform(F.array_sort(F.collect_list(F.when(F.col("_row").isNotNull(), keyed)), order), lambda x: x["_row"])


def shuffled(docs: DataFrame, id_col: str = "doc_id", text: str = "text", seed: int = 17, bucket_bytes: int = 16 << 20) -> tuple[DataFrame, int]:
    """(_row: all columns of `docs`, _place: 0 to rows - 1, a seeded permutation) of all rows; the number of rows."""
    total = docs.agg(F.sum(_size(text)).alias("b"), F.count(F.lit(1)).alias("n")).first()
    n = max(1, -(-int(total["b"] or 0) // bucket_bytes))
    row = F.struct(*(F.col(f"`{c}`") for c in docs.columns))
    dealt = docs.select(row.alias("_row"), bucket_of(id_col, text, n, seed).alias("_bucket"), F.lit(None).cast("long").alias("_begin"))
    filled = dealt.groupBy(F.col("_bucket").alias("_b")).agg(F.count(F.lit(1)).alias("_count"))
    begins = filled.select(F.lit(None).cast(dealt.schema["_row"].dataType).alias("_row"), F.col("_b").alias("_bucket"), (F.sum("_count").over(W.orderBy("_b")) - F.col("_count")).alias("_begin"))
    # where a bucket begins travels with its rows, so nothing has to meet them later, whatever the number of buckets; one array
    # for each bucket of bounded bytes, sorted first, as rows arrive in any order; bucket k is task k, as Spark adds the
    # partition's number to the shuffle's seed
    turned = dealt.unionByName(begins).repartitionById(n, "_bucket").groupBy("_bucket").agg(_sorted_rows(docs).alias("_rows"), F.max("_begin").alias("_begin"))
    placed = turned.select("_begin", F.posexplode(F.shuffle("_rows", seed)).alias("_pos", "_row"))
    return placed.select("_row", (F.col("_begin") + F.col("_pos")).alias("_place")), int(total["n"])


def even_cut(place: Column, rows: int, shards: int) -> tuple[Column, Column]:
    """Shard and slot of a place when `rows` places are cut into `shards` runs of lengths at most one apart."""
    small, longer = divmod(rows, shards)
    edge = longer * (small + 1)
    shard = F.when(place < edge, F.floor(place / (small + 1))).otherwise(longer + F.floor((place - edge) / max(small, 1)))
    slot = F.when(place < edge, place % (small + 1)).otherwise((place - edge) % max(small, 1))
    return shard.cast("int"), slot.cast("long")


def names(docs: DataFrame) -> tuple[str, str]:
    """Names of the shard's and the slot's column that `docs` doesn't have."""
    taken = {c.lower() for c in docs.columns}
    out = []
    for name in ("_shard", "_slot"):
        while name in taken:
            name = f"_{name}"
        out.append(name)
    return out[0], out[1]


def shard(docs: DataFrame, shards: int = 8, id_col: str = "doc_id", text: str = "text", seed: int = 17, bucket_bytes: int = 16 << 20) -> DataFrame:
    """All rows and columns of `docs` with `_shard` and `_slot` (see `names`)."""
    placed, rows = shuffled(docs, id_col, text, seed, bucket_bytes)
    where, slot = even_cut(F.col("_place"), rows, shards)
    shard_name, slot_name = names(docs)
    return placed.select(*(F.col("_row")[c].alias(c) for c in docs.columns), where.alias(shard_name), slot.alias(slot_name))


def write_shards(docs: DataFrame, path: str | None = None, **how) -> DataFrame:
    """Writes the shards as Parquet in folders `_shard=K`, records in slot order, and returns what was written."""
    out = shard(docs, **how)
    if path is None:
        path = f"{common.shared_dir(docs.sparkSession)}/shards-{uuid.uuid4().hex}"
    shard_name, slot_name = names(docs)
    with common.tidy(docs.sparkSession):
        out.sortWithinPartitions(shard_name, slot_name).write.partitionBy(shard_name).parquet(path)
    return docs.sparkSession.read.schema(out.schema).parquet(path).select(*out.columns)
