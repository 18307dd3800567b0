"""Shards of frames with clashing names and maps; buckets in tasks; samples of many languages; files by number."""

import time

import pytest
from pyspark.sql import functions as F

from thermolith.llm import langid, pretoken, sharding, token_store


def test_shards_carry_clashing_names_and_maps(spark):
    df = spark.createDataFrame([(i % 40, f"text {i % 40}", i, {"a": i % 3, "b": 1}, "x") for i in range(200)], "doc_id long, text string, _shard long, m map<string,int>, _place string")
    out = sharding.write_shards(df, shards=3, bucket_bytes=400)
    assert out.columns == [*df.columns, "__shard", "_slot"]
    key = lambda d: sorted((r["doc_id"], r["text"], r["_shard"], tuple(sorted(r["m"].items())), r["_place"]) for r in d.collect())
    assert key(out) == key(df)
    again = sharding.write_shards(df.repartition(7), shards=3, bucket_bytes=400)
    place = lambda d: sorted((r["_shard"], r["__shard"], r["_slot"]) for r in d.collect())
    assert place(out) == place(again)


def test_each_bucket_has_a_task(spark):
    df = spark.createDataFrame([(i, "x" * 99) for i in range(640)], "doc_id long, text string")
    placed, rows = sharding.shuffled(df, bucket_bytes=6400)
    assert rows == 640
    tasks = placed.groupBy(F.spark_partition_id().alias("p")).count().collect()
    assert len(tasks) == 10 and max(r["count"] for r in tasks) < 110


def test_sample_is_bounded_and_knows_every_language(spark):
    rows = [(i, f"l{i % 30:02d}", f"some text {i} " * 40) for i in range(3000)] + [(5, "l05", "other")] * 3
    df = spark.createDataFrame(rows, "doc_id long, lang string, text string")
    for most in (100_000, 300, 10):
        langs, x, y = langid.sample(df, F.lit(True), per_lang=20, windows=4, most=most)
        assert langs == sorted({r[1] for r in rows}) and set(y.tolist()) == set(range(30))
        assert len(x) <= max(most, 30) and len(x) <= 30 * 20 * 4
    assert langid.sample(df, F.lit(True), per_lang=20)[1].tolist() == langid.sample(df.repartition(5), F.lit(True), per_lang=20)[1].tolist()


def test_special_tokens_are_found_in_linear_time():
    words = pretoken.Words(lambda ws: [[len(w)] for w in ws])
    bounds = lambda codes, rows: pretoken.folded_words(codes, rows)
    text = "ab <s> " * 40_000
    began = time.time()
    ids, size = pretoken.encode_rows([text, "<s><s>x", ""], words, bounds, {"<s>": 7, "<s": 8})
    assert size[2] == 0 and (ids == 8).sum() == 40_002
    assert time.time() - began < 5


@pytest.mark.parametrize("files", [1, 3])
def test_rows_of_one_id_start_in_the_order_of_the_files(spark, files):
    import public_tokenizers

    texts = ["b c d", "a", "", "a b", "zz top of the hill", None]
    df = spark.createDataFrame([(1, t) for t in texts] + [(i, "word " * i) for i in range(2, 9)], "doc_id long, text string")
    path = token_store.write(df, public_tokenizers.path("word_bpe_49k.json"), files=files)
    got = token_store.digest(spark, path).orderBy("start").collect()
    at = 0
    for r, (doc, ids) in zip(got, [(x["doc_id"], x["ids"]) for x in spark.read.orc(path).withColumn("f", F.col("_metadata.file_name")).orderBy("f", F.monotonically_increasing_id()).collect()], strict=True):
        assert r["start"] == at and r["doc_id"] == doc and r["n_tokens"] == len(ids)
        at += r["n_tokens"]
