"""Mixing sources to target weights by a time-varying curriculum.

Targets: the mix takes `share` of all words, split over the sources by weight; no source gives more than `most` times
its words, and what is over goes to the others by weight.  That water filling has a closed form over sources sorted by
cap / weight, computed with windows over the table of sources.

Curriculum: a source's weight moves over training time t in [0, 1] along a piecewise linear schedule.  Its integral,
scaled to the target, is the source's cumulative demand of words.  A source's documents stand in a seeded order,
repeated pass by pass; the words before a document say when the demand reaches it: the inverse of the demand is its
training position.  The mix is range-sorted by position.  The last document of a source is cut so that the target is met.

The seeded order is that of md5(seed, id).  Running sums are taken in two steps, over `slots` hash ranges of each source
and inside them, so a source with a third of all rows is no single task; there are more ranges the more rows there are (at
least 256), and their number changes no result.  The windows over the table of sources are one task: a row for each source,
however many documents it has.  Null texts have size 0 and are never taken.
Null sources come last, as a source of their own.  Rows alike in id are ordered by text hash; rows alike in both stand
one after the other.  An empty table gives no rows.  Other columns are kept by `mix`.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from . import common

WEIGHTS = (5.0, 2.0, 1.0)
#: (time, factor of the weight) knots, by a source's number modulo their count: rising, even, falling.
SCHEDULES = (((0.0, 0.5), (1.0, 1.5)), ((0.0, 1.0), (1.0, 1.0)), ((0.0, 1.5), (0.5, 1.0), (1.0, 0.5)))


#: Rows of a source that one task runs through, about.
ROWS_A_SLOT = 250_000


def words(text: str = "text") -> Column:
    """Number of `[^\\x20\\x09-\\x0D]+` in a text; null: 0."""
    return F.coalesce(F.regexp_count(F.col(text), F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def targets(sizes: DataFrame, weights: tuple[float, ...] = WEIGHTS, share: float = 1.5, most: float = 2.0) -> DataFrame:
    """(source, source_size) -> also number, weight and target of each source."""
    everything = W.orderBy(F.col("source").isNull(), F.col("source"))
    weight = F.element_at(F.array(*(F.lit(float(w)) for w in weights)), (F.col("number") % len(weights) + 1).cast("int"))
    t = sizes.withColumn("number", F.row_number().over(everything) - 1).withColumn("weight", weight)
    t = t.withColumn("cap", most * F.col("source_size"))
    order = W.orderBy(F.col("cap") / F.col("weight"), "number")
    upto, after = order.rowsBetween(W.unboundedPreceding, -1), order.rowsBetween(0, W.unboundedFollowing)
    t = t.withColumns({"_full": F.coalesce(F.sum("cap").over(upto), F.lit(0.0)), "_open": F.sum("weight").over(after), "_all": F.sum("source_size").over(W.orderBy(F.lit(0)).rowsBetween(W.unboundedPreceding, W.unboundedFollowing))})
    # the level at which the sources from here on share what the earlier, filled ones leave
    t = t.withColumn("_level", (share * F.col("_all") - F.col("_full")) / F.col("_open"))
    # ... and the first source that the level doesn't fill sets it for all that follow
    whole = W.orderBy(F.lit(0)).rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    first = F.min(F.when(F.col("_level") * F.col("weight") <= F.col("cap"), F.struct(F.col("cap") / F.col("weight"), "number", "_level"))).over(whole)
    level = t.withColumn("_first", first["_level"])
    target = F.least(F.col("cap"), F.coalesce(F.col("_first") * F.col("weight"), F.col("cap")))
    return level.select("source", "source_size", F.col("number").cast("int").alias("number"), "weight", target.alias("target"))


def inverse_demand(done: Column, knots: tuple[tuple[float, float], ...]) -> Column:
    """Time at which a schedule's integral reaches the fraction `done` of its whole."""
    pieces, area = [], 0.0
    for (t0, w0), (t1, w1) in zip(knots, knots[1:], strict=False):
        pieces.append((t0, w0, (w1 - w0) / (t1 - t0), area))
        area += (w0 + w1) / 2 * (t1 - t0)
    out = None
    for t0, w0, slope, before in pieces:
        over = done * area - before
        t = t0 + (over / w0 if slope == 0 else (F.sqrt(F.greatest(w0 * w0 + 2 * slope * over, F.lit(0.0))) - w0) / slope)
        out = t if out is None else F.when(done * area < before, out).otherwise(t)
    return out


def sized(docs: DataFrame, id_col: str = "doc_id", text: str = "text", source: str = "source", seed: int = 8, slots: int = 256) -> DataFrame:
    """id, source, size, the seeded order (`_key`, `_tie`) and the hash range `_slot` of every row."""
    key = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(id_col).cast("string"), F.lit("null"))))
    rows = docs.select(F.col(id_col).alias("id"), F.col(source).alias("source"), words(text).alias("size"), key.alias("_key"), F.xxhash64(text).alias("_tie"))
    return rows.withColumn("_slot", F.floor(F.conv(F.substring("_key", 1, 8), 16, 10).cast("long") / (2**32 // slots)))


def plan(docs: DataFrame, id_col: str = "doc_id", text: str = "text", source: str = "source", weights: tuple[float, ...] = WEIGHTS, share: float = 1.5, most: float = 2.0, schedules=SCHEDULES, seed: int = 8, slots: int | None = None) -> DataFrame:
    """A row for every row of `docs`: id, source, size, source_size, target, taken, and `turns`: an array of
    (pass, words, position) for each pass that takes any of it."""
    slots = slots or max(256, 1 << (docs.count() // ROWS_A_SLOT).bit_length())
    rows = common.cut(sized(docs, id_col, text, source, seed, slots))
    parts = rows.groupBy("source", "_slot").agg(F.sum("size").alias("_part"))
    parts = parts.withColumn("_earlier", F.sum("_part").over(W.partitionBy("source").orderBy("_slot")) - F.col("_part"))
    goals = targets(parts.groupBy("source").agg(F.sum("_part").alias("source_size")), weights, share, most)
    starts = parts.join(goals.withColumnRenamed("source", "_s"), F.col("source").eqNullSafe(F.col("_s")))
    starts = starts.select(F.col("source").alias("_s"), F.col("_slot").alias("_p"), "_earlier", "source_size", "number", "target")
    run = F.sum("size").over(W.partitionBy("source", "_slot").orderBy("_key", "_tie", "size").rowsBetween(W.unboundedPreceding, W.currentRow)) - F.col("size")
    out = rows.withColumn("_before", run).join(starts, F.col("source").eqNullSafe(F.col("_s")) & (F.col("_slot") == F.col("_p")))
    before, goal = F.col("_earlier") + F.col("_before"), F.floor("target")
    turns = []
    for k in range(int(-(-most // 1))):
        begin = before + k * F.col("source_size")
        got = F.greatest(F.lit(0).cast("long"), F.least(F.col("size"), goal - begin))
        when = None
        for i, knots in enumerate(schedules):
            t = inverse_demand(begin / F.col("target"), knots)
            when = t if when is None else F.when(F.col("number") % len(schedules) == i, t).otherwise(when)
        turns.append(F.struct(F.lit(k).alias("pass"), got.alias("words"), F.when(got > 0, when).alias("position")))
    out = out.withColumn("turns", F.filter(F.array(*turns), lambda x: x["words"] > 0))
    taken = F.aggregate("turns", F.lit(0).cast("long"), lambda a, x: a + x["words"])
    return out.select(F.col("id").alias(id_col), F.col("source").alias(source), "size", "source_size", "target", taken.alias("taken"), "turns", "_tie")


def mix(docs: DataFrame, id_col: str = "doc_id", text: str = "text", **how) -> DataFrame:
    """The columns of `docs`, a row for each pass that takes any of a document (whole, the last one of a source too),
    range-sorted by training position."""
    planned = plan(docs, id_col, text, **how)
    turns = planned.select(F.col(id_col).alias("_id"), "_tie", F.explode("turns").alias("_turn")).select("_id", "_tie", "_turn.pass", "_turn.position")
    count = planned.agg(F.count(F.lit(1)).alias("n"), F.count_distinct(F.struct(F.col(id_col))).alias("d")).first()
    rows = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("_row"), F.col(id_col).alias("_id2"), F.xxhash64(text).alias("_tie2"))
    same = F.col("_id2").eqNullSafe(F.col("_id"))
    if count["n"] != count["d"]:  # rows alike in id: turns and rows are numbered on both sides
        turns = turns.withColumn("_nth", F.row_number().over(W.partitionBy("_id", "_tie", "pass").orderBy("position")))
        # rows alike in text too by all they hold; those alike in all are interchangeable
        rows = rows.withColumn("_nth2", F.row_number().over(W.partitionBy("_id2", "_tie2").orderBy(F.to_json("_row"))))
        same &= (F.col("_tie2") == F.col("_tie")) & (F.col("_nth2") == F.col("_nth"))
    both = rows.join(turns, same).repartitionByRange("position", "pass", "_id2").sortWithinPartitions("position", "pass", "_id2")
    return both.select(*(F.col("_row")[c].alias(c) for c in docs.columns))
