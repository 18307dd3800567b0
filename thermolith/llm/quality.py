"""Quality rules with adaptive thresholds.

Each document gets counts from its whole text, then ratios of them.  For each ratio and each (language, source) a
log-bucket quantile sketch is kept: counts of documents by ceil(log_gamma(ratio)).  Such sketches merge by adding
counts, in any order and with the same result, so Spark's partial aggregation merges them before the shuffle and a
source with a third of all rows costs no more than another.  Quartiles read from the sketches give each group its
fences (Tukey: quartile +- reach * interquartile range, at least `slack` wide), and groups with few documents lean on
the sketch of their language.  Junk in over a quarter of a group moves a quartile, so such fences go no further than the
steady ones of the group or its language, whichever are wider: the same from the median and the shorter of its distances
to the quartiles, which less than half of the documents can't move to one side.  The fences are joined to the documents,
which filters them.

Null, empty and word-less texts: no words, base_failed.  Null language or source: a group of their own.  Repeated rows
give repeated results.  Other columns are not touched.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from . import common

BLANK = b" \t\n\r\x0b\x0c"
CONTINUATION = bytes(range(0x80, 0xC0))
SYMBOLS = b"#*$%&|<>"
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines")


@dataclass(frozen=True)
class Rule:
    """A ratio and the least distance of its fences from the quartiles; without `low` it is only bounded above."""

    name: str
    over: str
    under: str
    slack: float
    low: bool = False


RULES = (
    Rule("symbols", "n_symbols", "word_chars", 0.05),
    Rule("dup_lines", "n_dup_lines", "n_lines", 0.35),
    Rule("repeats", "n_repeat_words", "n_words", 0.35),
    Rule("word_length", "word_chars", "n_words", 1.5, True),
)
GAMMA = 1.02


def counts(text: bytes) -> tuple[int, ...]:
    """The counts of COUNTS for one text in UTF-8."""
    words = text.split()  # bytes.split() knows exactly the blanks x20 and x09-x0D
    n = len(words)
    lines = [x for x in text.split(b"\n") if x.strip(BLANK)]
    repeated = 0
    if n > 3:
        ids: dict[bytes, int] = {}
        a = np.fromiter((ids.setdefault(w, len(ids)) for w in words), np.int64, n)
        pairs = a[:-1] * len(ids) + a[1:]
        if len(ids) > 2_000_000:  # so that the third word fits into 64 bits
            pairs = np.unique(pairs, return_inverse=True)[1].astype(np.int64)
        _, where, times = np.unique(pairs[:-1] * len(ids) + a[2:], return_inverse=True, return_counts=True)
        if len(times) < n - 2:
            again = times[where] > 1
            covered = np.zeros(n, bool)
            for k in range(3):
                covered[k : n - 2 + k] |= again
            repeated = int(covered.sum())
    return n, len(text.translate(None, BLANK + CONTINUATION)), len(text) - len(text.translate(None, SYMBOLS)), len(lines) - len(set(lines)), repeated, len(lines)


def measure(docs: DataFrame, text: str = "text", keys: tuple[str, ...] = ("doc_id", "lang", "source")) -> DataFrame:
    """`keys` and the counts of every row's text."""
    source = docs.select(*keys, common.as_bytes(text).alias("_text"))

    def run(batches):
        for b in batches:
            rows = [counts(x) for x in b.column(len(keys)).to_pylist()]
            yield pa.RecordBatch.from_arrays(b.columns[: len(keys)] + [pa.array([r[i] for r in rows], pa.int64()) for i in range(len(COUNTS))], names=[*keys, *COUNTS])

    kinds = [f"`{f.name}` {f.dataType.simpleString()}" for f in source.select(*keys).schema]
    return source.mapInArrow(run, ", ".join([*kinds, *(f"{c} long" for c in COUNTS)]))


def base_failed(min_words: int = 50, max_repeat: float = 50) -> Column:
    return (F.col("n_words") < min_words) | (100 * F.col("n_repeat_words") > max_repeat * F.col("n_words"))


def ratio(r: Rule) -> Column:
    return F.when(F.col(r.under) > 0, F.col(r.over).cast("double") / F.col(r.under)).otherwise(F.lit(0.0))


def sketches(measured: DataFrame, groups: list[str]) -> DataFrame:
    """One row per group, rule and non-empty bucket: the mergeable sketch."""
    bucket = F.when(F.col("_ratio") > 0, F.ceil(F.log(F.col("_ratio")) / math.log(GAMMA))).otherwise(F.lit(-(1 << 40))).cast("long")
    stacked = measured.select(*groups, F.explode(F.array(*(F.struct(F.lit(r.name).alias("rule"), ratio(r).alias("_ratio")) for r in RULES))).alias("_x"))
    return stacked.select(*groups, "_x.rule", F.col("_x._ratio").alias("_ratio")).withColumn("bucket", bucket).groupBy(*groups, "rule", "bucket").agg(F.count(F.lit(1)).alias("n"))


def merged(sketch: DataFrame, groups: list[str]) -> DataFrame:
    return sketch.groupBy(*groups, "rule", "bucket").agg(F.sum("n").alias("n"))


def quartiles(sketch: DataFrame, groups: list[str]) -> DataFrame:
    """q1, q2, q3 and total of each group and rule: the upper value of the bucket that holds the rank."""
    key = [*groups, "rule"]
    upto, whole = F.sum("n").over(W.partitionBy(*key).orderBy("bucket")), F.sum("n").over(W.partitionBy(*key))
    value = F.when(F.col("bucket") < -(1 << 39), F.lit(0.0)).otherwise(F.pow(F.lit(GAMMA), F.col("bucket")))
    at = lambda q: F.min(F.when(F.col("_upto") >= q * F.col("_total"), F.col("_value")))
    return sketch.withColumns({"_upto": upto, "_total": whole, "_value": value}).groupBy(*key).agg(at(0.25).alias("q1"), at(0.5).alias("q2"), at(0.75).alias("q3"), F.max("_total").alias("total"))


def thresholds(sketch: DataFrame, lang: str, source: str, reach: float, lean: float) -> DataFrame:
    """One row per (lang, source) with <rule>_low and <rule>_high.

    A group's quartiles are averaged with its language's, with weights total : lean."""
    own = quartiles(sketch, [lang, source])
    wide = quartiles(merged(sketch, [lang]), [lang]).select(F.col(lang).alias("_l"), F.col("rule").alias("_r"), *(F.col(q).alias(f"_{q}") for q in ("q1", "q2", "q3")))
    both = own.join(wide, own[lang].eqNullSafe(wide["_l"]) & (own["rule"] == wide["_r"]))
    for q in ("q1", "q3"):
        both = both.withColumn(f"lean_{q}", (F.col(q) * F.col("total") + F.col(f"_{q}") * lean) / (F.col("total") + lean))
    slack = F.create_map(*(x for r in RULES for x in (F.lit(r.name), F.lit(r.slack))))[F.col("rule")]
    width = F.greatest(slack, reach * (F.col("lean_q3") - F.col("lean_q1")))
    tukey = F.col("lean_q1") - width, F.col("lean_q3") + width

    def steady(q1: str, q2: str, q3: str) -> tuple[Column, Column]:
        near = F.least(F.col(q2) - F.col(q1), F.col(q3) - F.col(q2))
        away = near + F.greatest(slack, reach * 2 * near)
        return F.col(q2) - away, F.col(q2) + away

    (low, high), (wide_low, wide_high) = steady("q1", "q2", "q3"), steady("_q1", "_q2", "_q3")
    both = both.withColumns({"_low": F.greatest(tukey[0], F.least(low, wide_low)), "_high": F.least(tukey[1], F.greatest(high, wide_high))})
    pick = lambda r, c: F.max(F.when(F.col("rule") == r.name, F.col(c)))
    return both.groupBy(lang, source).agg(*(pick(r, "_high").alias(f"{r.name}_high") for r in RULES), *(pick(r, "_low").alias(f"{r.name}_low") for r in RULES if r.low))


def quality_rules(docs: DataFrame, text: str = "text", id_col: str = "doc_id", lang: str = "lang", source: str = "source", min_words: int = 50, max_repeat: float = 50, reach: float = 6.0, lean: float = 200.0) -> DataFrame:
    """id, language, source, the counts, base_failed, the group's fences and `kept`, a row for every row of `docs`."""
    measured = common.cut(measure(docs, text, (id_col, lang, source)).withColumn("base_failed", base_failed(min_words, max_repeat)))
    fences = thresholds(sketches(measured.where(~F.col("base_failed")), [lang, source]), lang, source, reach, lean)
    fences = fences.withColumnsRenamed({lang: "_lang", source: "_source"})
    out = measured.join(fences, measured[lang].eqNullSafe(fences["_lang"]) & measured[source].eqNullSafe(fences["_source"]), "left").drop("_lang", "_source")
    good = ~F.col("base_failed")
    for r in RULES:
        good &= F.coalesce(ratio(r) <= F.col(f"{r.name}_high"), F.lit(True))
        if r.low:
            good &= F.coalesce(ratio(r) >= F.col(f"{r.name}_low"), F.lit(True))
    return out.withColumn("kept", good)
