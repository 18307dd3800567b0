"""Exact quantiles of groups of any size by distributed selection.

A double's 64 bits, read so that their order is the numbers' order, are settled 16 at a time.  Each pass counts the rows of
a group by the next 16 bits, looks up which count holds each rank asked for, and goes on with the rows of these counts
only.  A pass is one scan with partial aggregation: of the data only counts are shuffled, at most 65,536 for each group and
rank, and no group's values ever stand in one buffer.  After four passes a rank's bits, and so its number, are known; passes
end before where all numbers left for each rank are one."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ..sources import scratch

PASSES = 4
BITS = 16
#: Rows of a state table that are sent to every task; larger ones are joined by Spark's own choice.
SMALL = 50_000


def ordered_bits(x: Column) -> Column:
    """A long whose order is the order of doubles (-0.0 as 0.0), from exact arithmetic; null for null and for no number.

    Scaling by a power of two is exact, so exponent and fraction are those of the number's own bits."""
    a = F.abs(x)
    power = lambda e: F.pow(F.lit(2.0), e)
    guess = F.floor(F.log2(a))
    e = F.greatest(F.lit(-1022), F.when(power(guess) > a, guess - 1).when(power(guess + 1) <= a, guess + 1).otherwise(guess))
    # below 2^-1022 the leading bit is 0 and the exponent's field, too
    part = a / power(e)
    normal = part >= 1.0
    field = F.when(normal, e + 1023).otherwise(F.lit(0)).cast("long")
    fraction = F.floor(F.when(normal, part - 1.0).otherwise(part) * float(1 << 52)).cast("long")
    bits = F.when(a == float("inf"), F.shiftleft(F.lit(2047).cast("long"), 52)).when(a == 0.0, F.lit(0).cast("long")).otherwise(F.shiftleft(field, 52) + fraction)
    return F.when(x.isNotNull() & ~F.isnan(x), F.when(x < 0.0, -bits).otherwise(bits))


def _same(a: DataFrame, b: DataFrame, keys: list[str]) -> Column:
    return reduce(lambda x, y: x & y, (a[k].eqNullSafe(b[f"_{k}"]) for k in keys))


def quantiles(df: DataFrame, keys: list[str], values: list[str], q: tuple[float, ...], name: str = "quantiles") -> DataFrame:
    """keys, `variable` and an array of the exact quantiles of each of `values`, linear between neighbouring ranks.

    Nulls and values that are no number are left out; a group without any other has no row."""
    if not all(0 <= x <= 1 for x in q):
        raise ValueError("quantiles lie between 0 and 1")
    spark = df.sparkSession
    series = F.explode(F.array(*(F.struct(F.lit(v).alias("variable"), F.col(v).cast("double").alias("x")) for v in values)))
    rows = df.select(*keys, series.alias("_s")).select(*keys, "_s.variable", "_s.x").withColumn("bits", ordered_bits(F.col("x"))).where("bits is not null")
    by = [*keys, "variable"]
    position = lambda k: F.lit(q[k]) * (F.col("n") - 1)
    ranks = F.array_distinct(F.flatten(F.array(*(F.array(F.floor(position(k)), F.ceil(position(k))) for k in range(len(q))))))
    state, rows_of_state = None, 0
    for k in range(PASSES):
        digit = F.shiftright("bits", BITS * (PASSES - 1 - k))
        if state is None:
            inside, within = rows, by
        else:
            small = F.broadcast(state) if rows_of_state <= SMALL else state
            small = small.select(*(F.col(c).alias(f"_{c}") for c in by), F.col("digit").alias("_digit"), "wanted", "n")
            met = _same(rows, small, by) & (F.shiftright(rows["bits"], BITS * (PASSES - k)) == small["_digit"])
            inside, within = rows.join(small, met).drop(*(f"_{c}" for c in by)), [*by, "_digit"]
        counted = inside.groupBy(*within, digit.alias("digit")).agg(F.count(F.lit(1)).alias("c"), F.min("x").alias("x"), F.max("x").alias("hi"), *((F.first("wanted").alias("wanted"), F.first("n").alias("n")) if state is not None else ()))
        w = W.partitionBy(*within)
        upto = counted.withColumn("below", F.sum("c").over(w.orderBy("digit")) - F.col("c"))
        if state is None:
            upto = upto.withColumn("n", F.sum("c").over(w))
            upto = upto.withColumn("wanted", F.transform(ranks, lambda r: F.struct(r.alias("rank"), r.alias("rest"))))
        hit = F.filter("wanted", lambda r: (r["rest"] >= F.col("below")) & (r["rest"] < F.col("below") + F.col("c")))
        hit = F.transform(hit, lambda r: F.struct(r["rank"].alias("rank"), (r["rest"] - F.col("below")).alias("rest")))
        state = scratch.table(upto.select(*by, "digit", "n", "x", "hi", hit.alias("wanted")).where(F.size("wanted") > 0), "ranks")
        seen = state.agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("x") < F.col("hi")).alias("open")).first()
        rows_of_state = seen["n"]
        if not seen["open"]:
            break
    found = state.select(*by, "n", "x", F.explode("wanted").alias("r")).groupBy(*by).agg(F.first("n").alias("n"), F.map_from_entries(F.collect_list(F.struct("r.rank", "x"))).alias("at"))

    def between(k: int) -> Column:
        low, high = (F.element_at("at", f(position(k)).cast("long")) for f in (F.floor, F.ceil))
        return F.when(low == high, low).otherwise(low + (high - low) * (position(k) - F.floor(position(k))))

    return found.select(*by, F.array(*(between(k) for k in range(len(q)))).alias(name))
