"""Removal of repeated byte strings with merged Burrows-Wheeler transforms.

A byte goes if a string of `span` (100) bytes over it also starts earlier: in a document of smaller id, or earlier in its
own document.

1. Each 100-byte window is assigned to its minimizer, the leftmost least hash among its 40-byte strings.  Windows that
   share a minimizer form a context, a run of bytes.  Equal windows have equal minimizers, so equal strings only need to
   be looked for among contexts of one minimizer; minimizers met once hold nothing.
2. Equal contexts of a minimizer need no transform: all but the earliest are repeats.  Each task settles those among a
   million contexts of its own and sends the earliest on, so a passage that a third of all documents share is a few rows of
   each task.  The different ones go on.
3. Contexts are gathered by minimizer into blocks of bounded memory and cut into shards.  Each shard gets a
   Burrows-Wheeler transform over symbols of 25 bytes (a context is 25 interleaved strings of such symbols), and the
   shards' transforms are merged by iterative interleave refinement: starting with one shard behind the other, each
   round deals the merged transform stably by symbol, which sorts the merged suffixes by one symbol more, while block
   starts give the common prefixes.  No suffix of the merged text is compared or sorted again.  After four rounds the
   runs with common prefixes of four symbols are the repeated 100-byte intervals.
4. A minimizer may have more different contexts than a block holds, or than one task should get: a thousandth of a task's
   million and more are dealt over many places.  Each block still finds its own repeats; of what is left, one window of
   each interval of such a minimizer is sent by a 128-bit hash of its bytes to those of the other blocks, which finds the
   intervals that blocks share.  So blocks of any size and dealing give the same result.

Symbols and strings are compared by 64-bit (contexts: with the minimizer, 128-bit) hashes.  Texts are read whole, however
long.  Null texts are empty.  Ids must be integers; anything else raises.  Null ids come last; documents alike in id are
ordered by text hash; rows alike in both are one document and get the same result.  An empty table gives no rows.  Other
columns, whatever their names, are not touched.
"""

from __future__ import annotations

import hashlib
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from . import common

U64 = np.uint64
SPAN, GRAM, STRIDE = 100, 40, 25
DEPTH = SPAN // STRIDE
REACH = SPAN - GRAM + 1
LAST = (1 << 63) - 1


def contexts(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, ...]:
    """(row, start in row, number of windows, minimizer hash, context hash) of every context of the rows."""
    n = len(data)
    if n < SPAN:
        return (np.empty(0, np.int64),) * 3 + (np.empty(0, U64),) * 2
    prefix = common.prefix_hash(data)
    at = np.arange(n - GRAM + 1)
    value = common.span_hash(prefix, at, at + GRAM)
    spot = at.astype(np.int32)
    least, where, width = value, spot, 1
    while width * 2 <= REACH:
        left = least[:-width] <= least[width:]
        least, where = np.where(left, least[:-width], least[width:]), np.where(left, where[:-width], where[width:])
        width *= 2
    if width < REACH:
        d = REACH - width
        left = least[:-d] <= least[d:]
        where = np.where(left, where[:-d], where[d:])
    size = np.diff(off)
    windows = np.maximum(size - SPAN + 1, 0)
    row = np.repeat(np.arange(len(size)), windows)
    start = np.arange(len(row)) - np.repeat(np.cumsum(windows) - windows, windows) + off[:-1][row]
    spot = where[start]
    first = np.ones(len(row), bool)
    first[1:] = (spot[1:] != spot[:-1]) | (row[1:] != row[:-1])
    head = np.flatnonzero(first)
    count = np.diff(np.append(head, len(row)))
    start = start[head]
    return row[head], start - off[:-1][row[head]], count, value[spot[head]], common.span_hash(prefix, start, start + count + SPAN - 1)


class Shard:
    """Suffixes of some contexts in sorted order, and what the Burrows-Wheeler transform says of each."""

    def __init__(self, data: np.ndarray, off: np.ndarray):
        """Rows of `off` are contexts; a context of length m has suffixes 0 to m, those of less than a symbol being ends."""
        size = np.diff(off)
        slots = size + 1
        n = int(slots.sum())
        begin = np.cumsum(slots) - slots
        self.row = np.repeat(np.arange(len(size)), slots)
        self.pos = np.arange(n) - np.repeat(begin, slots)
        left = size[self.row] - self.pos
        end = left < STRIDE
        at = off[:-1][self.row] + self.pos
        symbol = np.zeros(n, U64)
        symbol[~end] = common.span_hash(common.prefix_hash(data), at[~end], at[~end] + STRIDE)
        rank = np.empty(n, np.int64)
        ends = int(end.sum())
        rank[end] = np.arange(ends)  # ends differ from each other and come first
        rank[~end] = ends + np.unique(symbol[~end], return_inverse=True)[1]
        step, most = 1, int(size.max(initial=0)) // STRIDE + 1
        while step < most:
            ahead = np.arange(n) + step * STRIDE
            there = left >= step * STRIDE
            second = np.zeros(n, np.int64)
            second[there] = rank[ahead[there]] + 1
            rank = np.unique(rank * (n + 2) + second, return_inverse=True)[1]
            step *= 2
        order = np.argsort(rank)  # ranks are all different now
        place = np.empty(n, np.int64)
        place[order] = np.arange(n)
        self.row, self.pos = self.row[order], self.pos[order]
        self.ends = ends
        self.begins = self.pos < STRIDE  # nothing stands before these
        self.before = np.where(self.begins, U64(0), symbol[np.maximum(order - STRIDE, 0)])
        self.to = np.where(self.begins, -1, place[np.maximum(order - STRIDE, 0)])  # where the suffix one symbol longer is


def merge(shards: list[Shard], depth: int = DEPTH) -> tuple[np.ndarray, np.ndarray]:
    """Order of the suffixes of all shards (numbers into the shards laid end to end), sorted by `depth` symbols, and for
    each the symbols it shares with the one before it, `depth` at most."""
    base = np.cumsum([0] + [len(s.pos) for s in shards])
    begins = np.concatenate([s.begins for s in shards])
    to = np.concatenate([s.to + b for s, b in zip(shards, base, strict=False)])
    code = np.unique(np.concatenate([s.before for s in shards]), return_inverse=True)[1].astype(np.int32)
    ends = np.concatenate([np.arange(s.ends) + b for s, b in zip(shards, base, strict=False)])
    n, k = int(base[-1]), len(ends)
    order, block = np.arange(n), np.zeros(n, np.int64)
    shared = np.full(n, depth, np.int64)
    shared[:1] = 0
    for h in range(depth):
        inner = ~begins[order]
        source, blocks = order[inner], block[inner]
        c = code[source]
        deal = np.argsort(c, kind="stable")
        c, blocks = c[deal], blocks[deal]
        order = np.concatenate([ends, to[source[deal]]])
        fresh = np.ones(n, bool)
        fresh[k + 1 :] = (c[1:] != c[:-1]) | (blocks[1:] != blocks[:-1])
        shared[fresh & (shared == depth)] = h
        block = np.cumsum(fresh)
    return order, shared


def repeats(data: np.ndarray, off: np.ndarray, keys: list[np.ndarray], start: np.ndarray, shard_bytes: int = 1 << 17) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(context, first window, number of windows) of runs of windows that also start earlier, for contexts that begin at
    `start` in the documents ordered by `keys` (most important first)."""
    shards, first = [], 0
    while first < len(off) - 1:
        end = max(first + 1, int(np.searchsorted(off, off[first] + shard_bytes, "right")) - 1)
        end = min(end, len(off) - 1)
        s = Shard(data[off[first] : off[end]], off[first : end + 1] - off[first])
        s.row = s.row + first
        shards.append(s)
        first = end
    order, shared = merge(shards)
    row, pos = np.concatenate([s.row for s in shards])[order], np.concatenate([s.pos for s in shards])[order]
    same = shared >= DEPTH  # as long as a window with the one before
    interval = np.cumsum(~same)
    member = same.copy()
    member[:-1] |= same[1:]
    row, pos, interval = row[member], pos[member], interval[member]
    by = np.lexsort([start[row] + pos, *(k[row] for k in reversed(keys)), interval])
    row, pos, interval = row[by], pos[by], interval[by]
    later = np.zeros(len(row), bool)
    later[1:] = interval[1:] == interval[:-1]
    row, pos = row[later], pos[later]
    by = np.lexsort((pos, row))
    row, pos = row[by], pos[by]
    head = np.ones(len(row), bool)
    head[1:] = (row[1:] != row[:-1]) | (pos[1:] != pos[:-1] + 1)
    at = np.flatnonzero(head)
    return row[at], pos[at], np.diff(np.append(at, len(row)))


def _keyed(docs: DataFrame, id_col: str, text: str) -> tuple[DataFrame, bool]:
    """(row, ord, th, t): `row` holds all other columns; `th` tells documents of one id apart and is 0 if ids are unique."""
    common.integral(docs, id_col)
    ids = docs.agg(F.count(F.lit(1)).alias("n"), F.count_distinct(id_col).alias("d")).first()
    unique = ids["n"] == ids["d"]
    th = F.lit(0).cast("long") if unique else F.xxhash64(text)
    row = F.struct(*(F.col(f"`{c}`") for c in docs.columns if c != text))
    return docs.select(row.alias("row"), F.coalesce(F.col(id_col).cast("long"), F.lit(LAST)).alias("ord"), th.alias("th"), common.as_bytes(text).alias("t")), unique


#: Contexts that a task looks at together; a minimizer with a thousandth of them is dealt over several places.
TOGETHER, MANY = 1_000_000, 1_000
#: What a row of _contexts is: a context, one of a minimizer dealt over places, word that a minimizer is, a repeat.
ONE, DEALT, WORD, AGAIN = 0, 1, 2, 3


def _settled(mh, ch, order: list[np.ndarray], many: int) -> tuple[np.ndarray, np.ndarray]:
    """(whether an equal context stands earlier among these, whether the minimizer has `many` different ones)."""
    by = np.lexsort((ch, mh))
    m, c = mh[by], ch[by]
    same = np.zeros(len(by), bool)
    same[1:] = (m[1:] == m[:-1]) & (c[1:] == c[:-1])
    again = np.zeros(len(by), bool)
    member = same.copy()
    member[:-1] |= same[1:]
    among = by[member]
    if len(among):
        group = np.cumsum(~same)[member]
        rank = np.lexsort([k[among] for k in order] + [group])
        among, group = among[rank], group[rank]
        least = among[np.searchsorted(group, group)]  # the earliest of the group; rows alike with it are it
        again[among] = np.any([k[among] != k[least] for k in order], 0)
    first = np.ones(len(by), bool)
    first[1:] = m[1:] != m[:-1]
    number = np.cumsum(first) - 1
    crowd = np.bincount(number, weights=~same) >= many
    crowded = np.zeros(len(by), bool)
    crowded[by] = crowd[number]
    return again, crowded


def _contexts(keyed: DataFrame, together: int = TOGETHER, many: int = MANY) -> DataFrame:
    """(mh, place, ch, ord, th, spot, kind) of every context; spot: start * 256 + number of windows."""
    places = max(1, common.partitions(keyed.sparkSession))
    names = ["mh", "place", "ch", "ord", "th", "spot", "kind"]

    def rows(mh, place, ch, o, th, spot, kind):
        kind = np.broadcast_to(np.int32(kind), len(mh)) if np.ndim(kind) == 0 else kind
        return pa.RecordBatch.from_arrays([pa.array(x) for x in (mh.view(np.int64), place, ch.view(np.int64), o, th, spot, kind)], names=names)

    def flush(held):
        mh, ch, o, th, spot = (np.concatenate(x) for x in zip(*held, strict=True))
        again, crowded = _settled(mh, ch, [spot, th, o], many)
        place = np.where(crowded & ~again, 1 + (ch % U64(places)).astype(np.int32), 0).astype(np.int32)
        kind = np.where(again, AGAIN, np.where(crowded, DEALT, ONE)).astype(np.int32)
        mh_to = np.where(again, common.mix(o.view(U64) * U64(31) + spot.view(U64)), mh)  # a repeat is dealt anywhere
        for k in range(0, len(mh), 100_000):
            e = slice(k, k + 100_000)
            yield rows(mh_to[e], place[e], ch[e], o[e], th[e], spot[e], kind[e])
        if crowded.any():
            word = np.unique(mh[crowded])
            none = np.zeros(len(word), np.int64)
            yield rows(word, none.astype(np.int32), none.view(U64), none, none, none, WORD)

    def run(batches):
        held, n = [], 0
        for b in batches:
            for first, end, off, data in common.slices(b.column(2), 1 << 20):
                row, start, count, mh, ch = contexts(data, off)
                o, th = (b.column(i).to_numpy()[first:end][row] for i in (0, 1))
                held.append((mh, ch, o, th, start * 256 + count))
                n += len(mh)
                if n >= together:
                    yield from flush(held)
                    held, n = [], 0
        if n:
            yield from flush(held)

    return keyed.select("ord", "th", "t").mapInArrow(run, "mh long, place int, ch long, ord long, th long, spot long, kind int")


def _cut_out(wanted: DataFrame, keyed: DataFrame, unique: bool) -> DataFrame:
    """Adds the bytes of each wanted context."""
    lists = wanted.groupBy("ord", "th").agg(F.collect_list(F.struct("spot", "mh", "place", "dealt")).alias("w"))
    rows = keyed.select("ord", "th", "t")
    rows = rows if unique else rows.dropDuplicates(["ord", "th"])
    joined = rows.join(lists, ["ord", "th"]).select("ord", "th", "t", "w")
    names = ["mh", "place", "dealt", "ord", "th", "spot", "c"]

    def run(batches):
        for b in batches:
            off, data = common.byte_view(b.column(2))
            w = b.column(3)
            upto = w.offsets.to_numpy().astype(np.int64)
            spots = w.values.field("spot").to_numpy()[upto[0] : upto[-1]]
            row = np.repeat(np.arange(len(w)), np.diff(upto))
            # in parts of bounded bytes
            size = (spots & 255) + SPAN - 1
            total = np.cumsum(size)
            first = 0
            while first < len(spots):
                end = max(first + 1, int(np.searchsorted(total, total[first] - size[first] + (1 << 20), "right")))
                s, m = off[row[first:end]] + (spots[first:end] >> 8), size[first:end]
                to = np.cumsum(m)
                text = data[np.repeat(s - (to - m), m) + np.arange(int(to[-1]))]
                r = pa.array(row[first:end])
                value = lambda f: w.values.field(f).slice(upto[0] + first, end - first)  # noqa: B023, E731
                c = pa.Array.from_buffers(pa.binary(), len(m), [None, pa.py_buffer(np.concatenate([[0], to]).astype(np.int32)), pa.py_buffer(np.ascontiguousarray(text))])
                yield pa.RecordBatch.from_arrays([value("mh"), value("place"), value("dealt"), b.column(0).take(r), b.column(1).take(r), value("spot"), c], names=names)
                first = end

    return joined.mapInArrow(run, "mh long, place int, dealt boolean, ord long, th long, spot long, c binary")


def _blocks(batches, block_bytes: int):
    """(table, False) of whole groups of equal (mh, place), and (table, True) of each part of a group that fills a block;
    beyond the block's bytes a table holds no more than one batch."""
    held: list[pa.RecordBatch] = []  # whole groups
    part: list[pa.RecordBatch] = []  # the group that may go on
    size = part_size = 0
    last, parted = None, False

    def bytes_of(b):
        off, _ = common.byte_view(b.column(6))
        return int(off[-1] - off[0])

    for b in batches:
        while len(b):
            mh, place = b.column(0).to_numpy(), b.column(1).to_numpy()
            edges = np.append(np.flatnonzero((mh[1:] != mh[:-1]) | (place[1:] != place[:-1])) + 1, len(b))
            key = mh[0], place[0]
            if key != last:  # the group before has ended
                if part and parted:
                    yield pa.Table.from_batches(part), True
                elif part:
                    held, size = held + part, size + part_size
                part, part_size, parted = [], 0, False
                if size >= block_bytes:
                    yield pa.Table.from_batches(held), False
                    held, size = [], 0
                off, _ = common.byte_view(b.column(6))
                at, begin = 0, int(edges[-2]) if len(edges) > 1 else 0
                while at < begin:  # groups that end in this batch
                    stop = int(np.searchsorted(off, off[at] + max(0, block_bytes - size), "left"))
                    stop = int(edges[np.searchsorted(edges, min(begin, max(stop, at + 1)))])
                    held.append(b.slice(at, stop - at))
                    size += int(off[stop] - off[at])
                    at = stop
                    if size >= block_bytes:
                        yield pa.Table.from_batches(held), False
                        held, size = [], 0
                now, b = b.slice(begin), b.slice(len(b))
            else:
                now, b = b.slice(0, int(edges[0])), b.slice(int(edges[0]))
            part.append(now)
            part_size += bytes_of(now)
            last = now.column(0)[0].as_py(), now.column(1)[0].as_py()
            if part_size >= block_bytes:
                yield pa.Table.from_batches(part), True
                part, part_size, parted = [], 0, True
    if part and parted:
        yield pa.Table.from_batches(part), True
    elif part:
        held += part
    if held:
        yield pa.Table.from_batches(held), False


def _merged(cut: DataFrame, block_bytes: int) -> DataFrame:
    """(ord, th, spot) of the repeats inside blocks, with null h1, h2; and of minimizers in several blocks one window of
    each interval, with its hash."""
    names = ["ord", "th", "spot", "h1", "h2"]

    def left_over(data, off, o, th, spot, mine, row, pos, count):
        """Windows of the contexts `mine` that no run (row, pos, count) takes, and their hashes."""
        windows = np.where(mine, np.diff(off) - SPAN + 1, 0)
        begin = np.cumsum(windows) - windows
        free = np.ones(int(windows.sum()) + 1, np.int32)
        gone = mine[row]
        step = np.zeros(len(free), np.int32)
        np.add.at(step, begin[row[gone]] + pos[gone], 1)
        np.add.at(step, begin[row[gone]] + pos[gone] + count[gone], -1)
        free = np.flatnonzero(np.cumsum(step)[:-1] == 0)
        r = np.searchsorted(begin + windows, free, "right")
        inner = free - begin[r]
        at = off[:-1][r] + inner
        prefix = common.prefix_hash(data)
        h1 = common.span_hash(prefix, at, at + SPAN)
        h2 = common.mix(common.span_hash(prefix, at, at + SPAN // 2) + U64(3) * common.span_hash(prefix, at + SPAN // 2, at + SPAN))
        return o[r], th[r], ((spot[r] >> 8) + inner) * 256 + 1, h1.view(np.int64), h2.view(np.int64)

    def run(batches):
        for t, parted in _blocks(batches, block_bytes):
            c = t.column("c").combine_chunks()
            c = c.chunk(0) if isinstance(c, pa.ChunkedArray) else c
            off, data = common.byte_view(c)
            data, off = data[off[0] : off[-1]], off - off[0]
            o, th, spot = (t.column(x).to_numpy() for x in ("ord", "th", "spot"))
            row, pos, count = repeats(data, off, [o, th], spot >> 8)
            none = pa.nulls(len(row), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(o[row]), pa.array(th[row]), pa.array(((spot[row] >> 8) + pos) * 256 + count), none, none], names=names)
            mine = np.ones(len(o), bool) if parted else t.column("dealt").to_numpy()
            if mine.any():
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in left_over(data, off, o, th, spot, mine, row, pos, count)], names=names)

    rows = cut.repartition(common.partitions(cut.sparkSession), "mh", "place").sortWithinPartitions("mh", "place")
    return rows.select("mh", "place", "dealt", "ord", "th", "spot", "c").mapInArrow(run, "ord long, th long, spot long, h1 long, h2 long")


def repeated_spans(docs: DataFrame, id_col: str = "doc_id", text: str = "text", block_bytes: int = 1 << 19, together: int = TOGETHER, many: int = MANY) -> DataFrame:
    """(ord, th, spot): runs of windows to remove; spot: start byte * 256 + number of windows (up to 61)."""
    keyed, unique = _keyed(docs, id_col, text)
    spark = docs.sparkSession
    with common.Tables(spark) as tables:
        same = W.partitionBy("mh", "place", "ch").orderBy("ord", "th", "spot")
        group = W.partitionBy("mh", "place")  # each task sends an equal context once
        met = _contexts(keyed, together, many).repartition(common.partitions(spark), "mh", "place")
        mine = F.when(F.col("kind") < WORD, F.col("ch"))
        earliest = reduce(lambda a, b: a & b, (F.first(c).over(same) == F.col(c) for c in ("ord", "th", "spot")))
        met = met.withColumn("first", (F.col("kind") < WORD) & earliest)
        met = met.withColumns({"lo": F.min(mine).over(group), "hi": F.max(mine).over(group), "dealt": F.max(F.when(F.col("kind").isin(DEALT, WORD), True).otherwise(False)).over(group)})
        wanted = F.col("first") & ((F.col("lo") != F.col("hi")) | F.col("dealt"))
        met = met.where(f"kind != {WORD}").where(~F.col("first") | wanted).select("mh", "place", "ord", "th", "spot", "first", "dealt")
        met = tables.store(met)
        first = met.where("first").select("mh", "place", "ord", "th", "spot", "dealt")
        cut = tables.store(_cut_out(first if unique else first.distinct(), keyed, unique))
        merged = tables.store(_merged(cut, block_bytes))
        found = met.where(~F.col("first")).select("ord", "th", "spot").union(merged.where("h1 is null").select("ord", "th", "spot"))
        left = merged.where("h1 is not null")
        least = left.groupBy(F.col("h1").alias("g1"), F.col("h2").alias("g2")).agg(F.min(F.struct("ord", "th", "spot")).alias("least"), F.count(F.lit(1)).alias("_n")).where("_n > 1")
        across = left.join(least, (F.col("h1") == F.col("g1")) & (F.col("h2") == F.col("g2"))).where(F.struct("ord", "th", "spot") != F.col("least"))
        return common.store(found.union(across.select("ord", "th", "spot")))


def _remaining(docs: DataFrame, id_col: str, text: str, fields: dict[str, str], make, **how) -> DataFrame:
    """docs without `text`, with the columns that make(text bytes, covered bytes or None) gives."""
    spans = repeated_spans(docs, id_col, text, **how).groupBy("ord", "th").agg(F.collect_list("spot").alias("w"))
    keyed, _ = _keyed(docs, id_col, text)
    keep = [c for c in docs.columns if c != text]
    joined = keyed.join(spans, ["ord", "th"], "left").select("row", "t", "w")

    def run(batches):
        for b in batches:
            off, data = common.byte_view(b.column(1))
            w = b.column(2)
            upto, spots = w.offsets.to_numpy(), w.values.to_numpy(zero_copy_only=False)
            out = []
            for i in range(len(w)):
                t, s = data[off[i] : off[i + 1]], spots[upto[i] : upto[i + 1]]
                covered = None
                if len(s):
                    edge = np.zeros(len(t) + 1, np.int32)
                    np.add.at(edge, s >> 8, 1)
                    np.add.at(edge, (s >> 8) + (s & 255) + SPAN - 1, -1)
                    covered = np.cumsum(edge[:-1]) > 0
                out.append(make(t, covered))
            yield pa.RecordBatch.from_arrays([b.column(0)] + [pa.array([x[k] for x in out], kind) for k, kind in enumerate({"long": pa.int64(), "string": pa.string()}[v] for v in fields.values())], names=["row", *fields])

    kind = joined.schema["row"].dataType.simpleString()
    made = joined.mapInArrow(run, f"row {kind}, " + ", ".join(f"{k} {v}" for k, v in fields.items()))
    return made.select(*(F.col("row")[c].alias(c) for c in keep), *fields)


def digest(docs: DataFrame, id_col: str = "doc_id", text: str = "text", **how) -> DataFrame:
    """id, n_bytes, n_removed, n_spans, kept_sha256 of every row."""

    def make(t, covered):
        if covered is None:
            return len(t), 0, 0, hashlib.sha256(t).hexdigest()
        return len(t), int(covered.sum()), int(covered[0]) + int((covered[1:] & ~covered[:-1]).sum()), hashlib.sha256(t[~covered]).hexdigest()

    fields = {"n_bytes": "long", "n_removed": "long", "n_spans": "long", "kept_sha256": "string"}
    return _remaining(docs.select(id_col, text), id_col, text, fields, make, **how)


def deduplicate(docs: DataFrame, id_col: str = "doc_id", text: str = "text", **how) -> DataFrame:
    """`docs` with the repeated bytes cut from `text`; a character of which a byte goes, goes whole."""
    field = "_kept_text"
    make = lambda t, covered: ((t if covered is None else t[~covered]).tobytes().decode("utf-8", "ignore"),)
    out = _remaining(docs, id_col, text, {field: "string"}, make, **how)
    return out.select(*(F.col(field).alias(text) if c == text else F.col(f"`{c}`") for c in docs.columns))
