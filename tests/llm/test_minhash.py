"""Rows that share ids, recall near the threshold, and joins that deal heavy keys over several places."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from thermolith.llm import common, minhash

DOCS = "doc_id long, text string, n int, _low int"
A, B = "one text of a few words " * 5, "quite another text with words of its own, and more of these"


def test_a_text_that_nothing_else_holds_survives(spark):
    """Rows (1, A), (5, A), (5, B): B is in no other document."""
    docs = spark.createDataFrame([(1, A, 1, 1), (5, A, 2, 2), (5, B, 3, 3), (7, None, 4, 4), (None, A, 5, 5), (8, "", 6, 6), (5, B, 7, 7)], DOCS)
    rows = sorted((r["doc_id"] or 0, r["n_shingles"], r["component_id"], r["kept"]) for r in minhash.near_duplicates(docs, width=2).collect())
    n = [r[1] for r in rows]
    assert [(r[0], r[2], r[3]) for r in rows] == [(0, None, True), (1, 1, True), *sorted([(5, 1, False), (5, 5, True), (5, 5, True)], key=lambda r: n[0] if r[1] == 1 else 99), (7, 7, True), (8, 8, True)]
    kept = minhash.deduplicate(docs, width=2)
    assert kept.columns == docs.columns
    assert sorted(r["n"] for r in kept.collect()) == [1, 3, 4, 5, 6, 7]  # the row (5, A) goes


def test_ids_must_be_integers(spark):
    with pytest.raises(TypeError, match="doc_id"):
        minhash.near_duplicates(spark.createDataFrame([("a", A)], "doc_id string, text string"))


def test_recall_near_the_threshold():
    """Of pairs of sets at 0.80 to 0.85 all share a band key: 3e-6 are expected to miss."""
    r = np.random.default_rng(11)
    missed = total = 0
    for n in (40, 200, 1000, 5000):
        for _ in range(250 if n < 5000 else 50):
            union = r.integers(0, 1 << 63, n, dtype=np.uint64)
            j = r.uniform(0.80, 0.85)
            both = int(np.ceil(j * n))
            only = n - both
            cut = int(r.integers(0, only + 1))
            sets = np.sort(union[: both + cut]), np.sort(np.concatenate([union[:both], union[both + cut :]]))
            keys = [minhash.band_keys(minhash.registers(np.zeros(len(s), np.int64), s, 1))[0] for s in sets]
            missed += not (keys[0] == keys[1]).any()
            total += 1
    assert total == 800 and missed == 0


def test_spread_is_a_join(spark):
    rows = spark.createDataFrame([(k, i) for i in range(400) for k in ([0] * 5 if i % 2 else [i])], "k int, i int")
    info = rows.groupBy("k").agg(F.count(F.lit(1)).alias("n")).where("k % 4 = 0 or k = 0").withColumn("x", F.col("k") * 10)
    got = common.spread(rows, info, ["k"], "n", rows.count())
    want = rows.join(info, "k")
    assert sorted(map(tuple, got.select("k", "i", "n", "x").collect())) == sorted(map(tuple, want.select("k", "i", "n", "x").collect()))
    assert got.where("k = 0").withColumn("p", F.spark_partition_id()).select("p").distinct().count() >= 1


def test_tables_of_an_operator_go_with_it(spark, tmp_path):
    with common.Tables(spark) as tables:
        a = tables.store(spark.range(3))
        path = tables.paths[0]
        assert a.count() == 3
        b = common.store(a.where("id > 0"))
    assert b.count() == 2
    fs = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    assert not fs.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(fs)


def test_without_a_shared_folder_only_one_machine_runs(monkeypatch):
    class Context:
        master, dir = "spark://host:7077", None

        def getCheckpointDir(self):
            return self.dir

        def setCheckpointDir(self, d):
            self.dir = d

    class Session:
        sparkContext = Context()
        conf = type("conf", (), {"get": staticmethod(lambda k, d=None: d)})

    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        common.shared_dir(Session())
    Session.sparkContext.master = "local[4]"
    assert common.shared_dir(Session())
