"""Nearest lookup of numbers on an axis of any spacing, as an equality join."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W


def nearest(left: DataFrame, axis: DataFrame, on: tuple[str, str], keys: tuple[str, ...] = (), name: str = "nearest") -> DataFrame:
    """Every row of `left` with `name`: the value on[1] of `axis`, among rows with its keys, that is nearest to its value on[0].

    Distances are taken in doubles and ties go up.  It is null where the value is null or no number, or where no axis has these
    keys.  Values beyond an axis take its end.

    An axis is cut into the gaps between neighbouring values.  These meet the rows by a bucket, as wide as the mean gap, so a gap
    touches few buckets on the whole; the exact gap is a filter, and no row carries an axis.  Only the axis is sorted."""
    x, g = on
    points = axis.select(*(F.col(k).alias(f"__{k}") for k in keys), F.col(g).cast("double").alias("__a")).where("__a is not null and not isnan(__a)").distinct()
    w = W.partitionBy(*(f"__{k}" for k in keys), F.lit(0))
    ends = {"__lo": F.min("__a").over(w), "__hi": F.max("__a").over(w), "__n": F.count(F.lit(1)).over(w)}
    gaps = points.withColumns(ends | {"__b": F.lead("__a").over(w.orderBy("__a"))})
    width = F.when(F.col("__hi") > F.col("__lo"), (F.col("__hi") - F.col("__lo")) / F.col("__n")).otherwise(1.0)
    bucket = lambda v: F.floor((v - F.col("__lo")) / F.col("__width")).cast("long")
    gaps = gaps.withColumn("__width", width).withColumn("__bucket", F.explode(F.sequence(bucket(F.col("__a")), bucket(F.coalesce("__b", "__a")))))
    gaps = gaps.select(*(f"__{k}" for k in keys), "__bucket", "__a", "__b")
    ruler = points.groupBy(*(f"__{k}" for k in keys)).agg(F.min("__a").alias("__lo"), F.max("__a").alias("__hi"), F.count(F.lit(1)).alias("__n")).where("__n > 0").withColumn("__width", width).drop("__n")
    same = lambda df: reduce(lambda a, b: a & b, (left[k].eqNullSafe(df[f"__{k}"]) for k in keys))
    ruled = left.join(ruler, same(ruler), "left").drop(*(f"__{k}" for k in keys)) if keys else left.join(F.broadcast(ruler), how="left")  # one row
    v = F.nanvl(F.col(x).cast("double"), F.lit(None))
    ruled = ruled.withColumn("__x", F.greatest("__lo", F.least("__hi", v))).withColumn("__x", F.when(v.isNotNull(), F.col("__x")))
    ruled = ruled.withColumn("__at", bucket(F.col("__x")))
    inside = (F.col("__at") == F.col("__bucket")) & (F.col("__x") >= F.col("__a")) & (F.col("__b").isNull() | (F.col("__x") < F.col("__b")))
    met = ruled.join(gaps, (reduce(lambda a, b: a & b, (ruled[k].eqNullSafe(gaps[f"__{k}"]) for k in keys)) & inside) if keys else inside, "left")
    upper = F.col("__b").isNotNull() & (F.abs(F.col("__b") - F.col("__x")) <= F.abs(F.col("__a") - F.col("__x")))
    return met.select(*(left[c] for c in left.columns), F.when(upper, F.col("__b")).otherwise(F.col("__a")).alias(name))
