"""Orders that must not depend on how Spark cuts its work."""

import zlib

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from thermolith.llm import sharding, token_store

WORDS = public_tokenizers.path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, None if i % 11 == 3 else f"text {i % 7} " * (i % 5) + ("x" * 3000 if i == 40 else ""), str(i)) for i in range(240)] + [(5, "text", "a"), (5, "text", "b"), (None, None, None)]
    return spark.createDataFrame(rows, "doc_id long, text string, _place string").cache()


@pytest.mark.parametrize("most", ["7", "50", "0"])
def test_starts_with_several_files_of_a_task(spark, docs, most):
    before = token_store.digest(spark, token_store.write(docs, WORDS, files=3)).collect()
    spark.conf.set("spark.sql.files.maxRecordsPerFile", most)
    try:
        path = token_store.write(docs, WORDS, files=3)
    finally:
        spark.conf.unset("spark.sql.files.maxRecordsPerFile")
    got = token_store.digest(spark, path).collect()
    assert sorted(map(tuple, got), key=str) == sorted(map(tuple, before), key=str)
    upto = 0
    for r in sorted(got, key=lambda r: r["start"]):
        assert r["start"] == upto
        upto += r["n_tokens"]
    ids = [i for r in sorted(token_store.read(spark, path).where("doc_id = 40").collect()) for i in r["ids"]]
    assert next(r for r in got if r["doc_id"] == 40)["ids_crc32"] == zlib.crc32(np.array(ids, "<u4").tobytes())


def places(out):
    return sorted(((r["doc_id"], r["text"], r["_place"], r["_shard"], r["_slot"]) for r in out.collect()), key=str)


def test_shards_do_not_depend_on_partitions(spark, docs):
    for size in (1 << 30, 2000, 60):  # one bucket, some, and nearly one for each record
        want = places(sharding.shard(docs, 8, bucket_bytes=size))
        before = spark.conf.get("spark.sql.shuffle.partitions")
        spark.conf.set("spark.sql.shuffle.partitions", "3")
        try:
            assert places(sharding.shard(docs.repartition(5), 8, bucket_bytes=size)) == want
        finally:
            spark.conf.set("spark.sql.shuffle.partitions", before)


def test_shuffle_against_a_plain_one(spark, docs):
    """Buckets by the same hash, in order; in each any permutation of its rows, all different from the sorted ones on the whole;
    then even cuts."""
    size = 1500
    n = -(-docs.select(F.sum(F.coalesce(F.octet_length("text"), F.lit(0)) + 1)).first()[0] // size)
    rows = docs.withColumn("_b", sharding.bucket_of("doc_id", "text", n, 17)).collect()
    of = {(r["doc_id"], r["text"], r["_place"]): r["_b"] for r in rows}
    got = sorted(sharding.shard(docs, 8, bucket_bytes=size).collect(), key=lambda r: (r["_shard"], r["_slot"]))
    order = [(r["doc_id"], r["text"], r["_place"]) for r in got]
    assert sorted(order, key=str) == sorted(of, key=str)
    met = [of[x] for x in order]
    assert met == sorted(met) and len(set(met)) > 3
    sizes = [sum(r["_shard"] == s for r in got) for s in range(8)]
    assert max(sizes) - min(sizes) <= 1 and sizes == sorted(sizes, reverse=True)
    assert [r["_slot"] for r in got] == [k for s in sizes for k in range(s)]
    inside = [[x for x, b in zip(order, met, strict=True) if b == k] for k in sorted(set(met))]
    assert any(x != sorted(x, key=str) for x in inside)
    other = places(sharding.shard(docs, 8, bucket_bytes=size, seed=18))
    assert other != places(sharding.shard(docs, 8, bucket_bytes=size))


def test_no_join_moves_the_rows(spark, docs):
    plan = sharding.shard(docs, 8, bucket_bytes=60)._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and "ArrowEval" not in plan and "Python" not in plan
