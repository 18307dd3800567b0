"""Near-duplicate components by HyperMinHash.

A document's word shingles are hashed to 64 bits.  The top bits choose one of 256 buckets; of each bucket's smallest
remainder only the number of leading zeros and the next ten bits are stored, 16 bits in all.  Empty buckets borrow
from a filled one in an order fixed for each bucket, so that equal registers are as likely as shingles are shared.
Bands of compressed registers are hashed to keys.  Documents that share a key are candidates; a Jaccard estimate from
all registers, corrected for the chance collisions of compressed registers, drops the unlikely ones, and the shingle
sets of the whole texts decide the rest.  With 42 bands of 6 registers a pair at similarity 0.8 is missed with
probability 3e-6.

Rows with equal sets are one class, numbered; what follows is about classes.  Inside a band key classes are not paired
with each other: each is compared with the key's pivot, the class that shares keys with most others, which is often the
text that the others were copied from.  Where a key then still holds several components, the classes connected by such keys
form a cluster, and those outside the cluster's largest component are compared with all of it, in blocks of bounded size on
both sides; of each component only one link is reported.  So the links found give the same components as all links.  This
last step takes time that grows with the product of a cluster's largest component and the rest; there is no exact way known
to us that doesn't for texts that share bands but no link.  Components come from alternating large and small stars over
stored edges.

No step gathers a key's rows in one task: counts, least values and pivots come from aggregates that are combined before the
shuffle, and joins deal keys with a thousandth of all rows or more over several places.

Null, empty and word-less texts have an empty set and no links.  Texts with fewer words than a shingle have the whole
sequence as one; very long texts are read whole.  Ids must be integers; anything else raises.  Rows without an id take no
part: their component is null and they are kept.  Rows of one id with different sets are documents of their own, each with
its own component, whose number is the least id in it; rows of one id with one set are one document and are kept or dropped
together.  An empty table gives no rows.  Other columns, whatever their names, are not touched.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

U64 = np.uint64
BUCKET_BITS, MANTISSA = 8, 10
BUCKETS = 1 << BUCKET_BITS
REST = 64 - BUCKET_BITS
BANDS, BAND = 42, 6
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
#: RANK[j, b]: how late empty bucket j asks bucket b.
RANK = np.argsort(np.random.Generator(np.random.PCG64(7)).random((BUCKETS, BUCKETS)), axis=1).argsort(axis=1).astype(np.int16) + 1
RANK[np.arange(BUCKETS), np.arange(BUCKETS)] = 0


def shingles(data: np.ndarray, off: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, hash) of each row's distinct shingles, sorted by both."""
    data = LOWER[data]
    starts, ends, row = common.word_bounds(data, off)
    word = common.span_hash(common.prefix_hash(data), starts, ends)
    n = len(word)
    count = np.bincount(row, minlength=len(off) - 1)
    left = np.cumsum(count)[row] - np.arange(n) if n else np.empty(0, np.int64)  # words from here to the row's end
    first = np.ones(n, bool)
    first[1:] = row[1:] != row[:-1]
    size = np.minimum(left, width)
    take = (left >= width) | first
    at, size = np.flatnonzero(take), size[take]
    h = np.zeros(len(at), U64)
    for k in range(width):
        more = size > k
        h[more] = common.mix(h[more] * U64(0xD6E8FEB86659FD93) + word[at[more] + k] + U64(k + 1))
    row = row[at]
    order = np.lexsort((h, row))
    row, h = row[order], h[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (row[1:] != row[:-1])
    return row[new], h[new]


def registers(row: np.ndarray, h: np.ndarray, rows: int) -> np.ndarray:
    """rows x 256 registers: 1 + (leading zeros << 10 | mantissa) of each bucket's least remainder; rows without shingles 0."""
    bucket = (h >> U64(REST)).astype(np.int64)
    first = np.ones(len(h), bool)
    first[1:] = (row[1:] != row[:-1]) | (bucket[1:] != bucket[:-1])
    row, bucket, rest = row[first], bucket[first], h[first] & U64((1 << REST) - 1)
    length = np.minimum(np.frexp(rest.astype(np.float64))[1], REST).astype(np.int64)
    shift = length - 1 - MANTISSA
    mantissa = np.where(shift >= 0, rest >> np.maximum(shift, 0).astype(U64), rest << np.maximum(-shift, 0).astype(U64)) & U64((1 << MANTISSA) - 1)
    out = np.zeros((rows, BUCKETS), np.uint16)
    out[row, bucket] = 1 + ((REST - length) << MANTISSA) + mantissa.astype(np.int64)
    for r in np.flatnonzero((out == 0).any(1) & (out != 0).any(1)).tolist():
        own = out[r]
        filled, empty = np.flatnonzero(own), np.flatnonzero(own == 0)
        own[empty] = own[filled[RANK[np.ix_(empty, filled)].argmin(1)]]
    return out


def band_keys(regs: np.ndarray) -> np.ndarray:
    """rows x BANDS keys."""
    parts = regs[:, : BANDS * BAND].reshape(-1, BANDS, BAND).astype(U64)
    h = np.broadcast_to(np.arange(BANDS, dtype=U64) + U64(77), parts.shape[:2]).copy()
    for k in range(BAND):
        h = common.mix(h * U64(0x9FB21C651E98DF25) + parts[:, :, k])
    return h


def chance(n: np.ndarray, m: np.ndarray) -> np.ndarray:
    """Probability that registers of disjoint sets of n and m shingles are equal."""
    a, b = n / BUCKETS, m / BUCKETS
    zeros = np.arange(REST)[:, None]
    above, below = np.exp2(-(zeros + 1.0)), np.exp2(-zeros * 1.0)
    width = np.exp2(-(zeros + 1.0 + MANTISSA))
    return a * b / (a + b) * (width * (np.exp(-(a + b) * above) - np.exp(-(a + b) * below))).sum(0)


def estimate(equal: np.ndarray, n: np.ndarray, m: np.ndarray) -> np.ndarray:
    """Jaccard similarity from the number of equal registers, corrected for chance collisions."""
    p = chance(n.astype(float), m.astype(float))
    return (equal / BUCKETS - p) / (1 - p)


def signatures(docs: DataFrame, id_col: str, text: str, width: int) -> DataFrame:
    """doc, th (hash of the text), n (set size), k1, k2 (set fingerprint), regs."""
    rows = docs.select(F.col(id_col).alias("doc"), F.xxhash64(text).alias("th"), common.as_bytes(text).alias("t"))

    def run(batches):
        for b in batches:
            for first, end, off, data in common.slices(b.column(2)):
                row, h = shingles(data, off, width)
                n = np.bincount(row, minlength=end - first)
                upto = np.concatenate([[0], np.cumsum(n)])
                keys = []
                for salt in (0x1F83D9ABFB41BD6B, 0x5BE0CD19137E2179):
                    s = np.concatenate([np.zeros(1, U64), np.cumsum(common.mix(h ^ U64(salt)))])
                    keys.append((s[upto[1:]] - s[upto[:-1]]).astype(np.int64))
                regs = registers(row, h, end - first)
                packed = pa.Array.from_buffers(pa.binary(), len(regs), [None, pa.py_buffer((np.arange(len(regs) + 1) * 2 * BUCKETS).astype(np.int32)), pa.py_buffer(np.ascontiguousarray(regs))])
                yield pa.RecordBatch.from_arrays([b.column(0).slice(first, end - first), b.column(1).slice(first, end - first), pa.array(n, pa.int64()), pa.array(keys[0]), pa.array(keys[1]), packed], names=["doc", "th", "n", "k1", "k2", "regs"])

    return rows.mapInArrow(run, f"doc {rows.schema['doc'].dataType.simpleString()}, th long, n long, k1 long, k2 long, regs binary")


def _registers_of(column: pa.Array) -> np.ndarray:
    off, data = common.byte_view(column)
    return data[off[0] : off[-1]].view(np.uint16).reshape(-1, BUCKETS) if len(column) else np.empty((0, BUCKETS), np.uint16)


def bands(classes: DataFrame) -> DataFrame:
    """(key, node) for each band of each class."""

    def run(batches):
        for b in batches:
            keys = band_keys(_registers_of(b.column(1)))
            nodes = b.column(0).take(pa.array(np.repeat(np.arange(len(keys)), BANDS)))
            yield pa.RecordBatch.from_arrays([pa.array(keys.reshape(-1).view(np.int64)), nodes], names=["key", "node"])

    return classes.select("node", "regs").mapInArrow(run, "key long, node long")


def shared_sizes(sets: tuple[np.ndarray, np.ndarray], others: tuple[np.ndarray, np.ndarray], rows: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sizes of row-wise intersections and of both sides' sets."""
    row, h = np.concatenate([sets[0], others[0]]), np.concatenate([sets[1], others[1]])
    order = np.lexsort((h, row))
    row, h = row[order], h[order]
    shared = np.bincount(row[1:][(row[1:] == row[:-1]) & (h[1:] == h[:-1])], minlength=rows)
    return shared, np.bincount(sets[0], minlength=rows), np.bincount(others[0], minlength=rows)


def confirmed(pairs: DataFrame, known: DataFrame, width: int, percent: int, sigmas: float = 6.0) -> DataFrame:
    """The pairs (a, b), a a pivot, whose sets have 100 * intersection >= percent * union.

    `known` has node, n, regs and the whole text t; pairs whose sizes or estimates rule the threshold out are not verified.
    A pivot's row goes to as many places as its pairs need."""
    threshold = percent / 100
    side = lambda x: known.select(F.col("node").alias(x), F.col("n").alias(f"n{x}"), F.col("regs").alias(f"r{x}"), F.col("t").alias(f"t{x}"))
    total, joined = pairs.count(), pairs
    for x in ("b", "a"):
        counted = side(x).join(pairs.groupBy(x).agg(F.count(F.lit(1)).alias("_n")), x)
        joined = common.spread(joined, counted, [x], "_n", total, ["a", "b"]).drop("_n")
    joined = joined.where(F.least("na", "nb") >= threshold * F.greatest("na", "nb"))

    def run(batches):
        for t in batches:
            n, m = t.column(2).to_numpy(), t.column(3).to_numpy()
            equal = (_registers_of(t.column(4)) == _registers_of(t.column(5))).sum(1)
            spread = sigmas * np.sqrt(threshold * (1 - threshold) / np.minimum(BUCKETS, np.minimum(n, m)))
            t = t.filter(pa.array(estimate(equal, n, m) >= threshold - spread))
            first = 0
            while first < len(t):
                part = t.slice(first)
                each = [next(common.slices(part.column(i), 1 << 20)) for i in (6, 7)]
                rows = min(x[1] for x in each)
                sets = []
                for _, _, off, data in each:
                    off = off[: rows + 1]
                    sets.append(shingles(data[: off[-1]], off, width))
                shared, one, two = shared_sizes(*sets, rows)
                ok = pa.array((shared > 0) & (100 * shared >= percent * (one + two - shared)))
                yield pa.RecordBatch.from_arrays([part.column(i).slice(0, rows).filter(ok) for i in (0, 1)], names=["a", "b"])
                first += rows

    return joined.select("a", "b", "na", "nb", "ra", "rb", "ta", "tb").mapInArrow(run, "a long, b long").distinct()


def crossing(left: tuple[np.ndarray, np.ndarray], right: tuple[np.ndarray, np.ndarray], labels: tuple[np.ndarray, np.ndarray], percent: int) -> tuple[np.ndarray, np.ndarray]:
    """(row of left, row of right) of pairs that reach `percent` and differ in label; one for each left row and label.

    The sides are (row, hash) of sets; the right side is an inverted index."""
    order = np.argsort(right[1], kind="stable")
    index, owner = right[1][order], right[0][order]
    sizes = np.bincount(right[0], minlength=len(labels[1]))
    upto = np.searchsorted(left[0], np.arange(len(labels[0]) + 1))
    out: tuple[list, list] = ([], [])
    for i in range(len(labels[0])):
        h = left[1][upto[i] : upto[i + 1]]
        a, b = np.searchsorted(index, h, "left"), np.searchsorted(index, h, "right")
        n = b - a
        hits = owner[np.repeat(a - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))]
        shared = np.bincount(hits, minlength=len(sizes))
        ok = np.flatnonzero((shared > 0) & (100 * shared >= percent * (len(h) + sizes - shared)) & (labels[1] != labels[0][i]))
        ok = ok[np.unique(labels[1][ok], return_index=True)[1]]
        out[0].append(np.full(len(ok), i))
        out[1].append(ok)
    return np.concatenate(out[0]) if out[0] else np.empty(0, np.int64), np.concatenate(out[1]) if out[1] else np.empty(0, np.int64)


def cross_links(tables: common.Tables, nodes: DataFrame, met_labels: DataFrame, known: DataFrame, width: int, percent: int, left_block: int = 400, right_block: int = 1000, block_shingles: int = 1_000_000) -> DataFrame:
    """Links (a, b) between labels, for pairs of classes of different labels in the clusters that rows (key, label) connect;
    `nodes` are the classes (node, label).

    A block holds about `left_block` or `right_block` classes, or those of `block_shingles` shingles where these are fewer, so
    that long texts make smaller blocks; a longer text is one by itself."""
    firsts = met_labels.groupBy("key").agg(F.min("label").alias("first"))
    edges = met_labels.join(firsts, "key").where("first != label").select(F.col("first").alias("a"), F.col("label").alias("b"))
    clusters = components(edges, tables).select(F.col("node").alias("label"), F.col("component").alias("cluster"))
    clusters = clusters.join(nodes.groupBy("label").agg(F.count(F.lit(1)).alias("_n")), "label")
    clusters = tables.store(clusters)
    members = common.spread(nodes, clusters, ["label"], "_n", nodes.count()).select("node", "label", "cluster")
    members = tables.store(members.join(known.select("node", F.col("n").alias("w")), "node"))
    sizes = members.groupBy("cluster", "label").agg(F.count(F.lit(1)).alias("n"), F.sum("w").alias("w"))
    largest = F.max_by(F.struct("label", "n", "w"), F.struct("n", "label"))
    sizes = sizes.groupBy("cluster").agg(F.sum("n").alias("m"), F.sum("w").alias("w"), largest.alias("x"))
    blocks = lambda n, w, size: F.greatest(F.ceil(n / size), F.ceil(w / block_shingles))
    sizes = sizes.select("cluster", F.col("x.label").alias("main"), "m", blocks(F.col("m"), F.col("w"), right_block).alias("rights"), blocks(F.col("m") - F.col("x.n"), F.col("w") - F.col("x.w"), left_block).alias("lefts"))
    sizes = tables.store(sizes)
    placed = common.spread(members, sizes, ["cluster"], "m", members.count()).withColumn("h", F.xxhash64("node"))
    right = placed.select("cluster", "node", "label", F.lit(False).alias("left"), F.pmod("h", "rights").alias("j"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("lefts") - 1)).alias("i"))
    left = placed.where("label != main").select("cluster", "node", "label", F.lit(True).alias("left"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("rights") - 1)).alias("j"), F.pmod("h", "lefts").alias("i"))
    rows = right.unionByName(left).join(known.select("node", "t"), "node")

    def run(t: pa.Table) -> pa.Table:
        sides = []
        for flag in (True, False):
            part = t.filter(pa.compute.equal(t["left"], flag)).combine_chunks()
            row, h, base = [], [], 0
            for c in part["t"].chunks:
                for first, _, off, data in common.slices(c, 1 << 20):
                    r, x = shingles(data, off, width)
                    row.append(r + first + base)
                    h.append(x)
                base += len(c)
            sides.append((np.concatenate(row) if row else np.empty(0, np.int64), np.concatenate(h) if h else np.empty(0, U64), part["label"].to_numpy()))
        (lr, lh, ll), (rr, rh, rl) = sides
        i, j = crossing((lr, lh), (rr, rh), (ll, rl), percent)
        return pa.table({"a": np.minimum(ll[i], rl[j]), "b": np.maximum(ll[i], rl[j])})

    spot = F.struct("cluster", "i", "j")
    return rows.withColumn("spot", spot).select("spot", "label", "left", "t").groupBy("spot").applyInArrow(run, "a long, b long").distinct()


def components(links: DataFrame, into: common.Tables | None = None) -> DataFrame:
    """(node, component): the smallest node reachable over links (a, b), for nodes with a link; stored in `into`."""

    def state(e):
        return e.agg(F.count(F.lit(1)), F.expr("bit_xor(xxhash64(a, b))")).first()

    def stars(edges, large, total):
        """Each node's neighbours (of the smaller ones: with `large` unset) are hung on the smallest of them and itself."""
        near = edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
        if large:
            near = near.union(near.select("v", "u"))
        least = near.groupBy("u").agg(F.min("v").alias("m"), F.count(F.lit(1)).alias("_n"))
        hung = common.spread(near, least.withColumn("m", F.least("m", "u")), ["u"], "_n", total)
        if large:
            out = hung.where(F.col("v") > F.col("u")).select(F.col("v").alias("a"), F.col("m").alias("b"))
        else:
            out = hung.select(F.explode(F.array(F.struct(F.col("v").alias("a"), F.col("m").alias("b")), F.struct(F.col("u").alias("a"), F.col("m").alias("b")))).alias("e")).select("e.a", "e.b")
        return out.where("a != b").distinct()

    spark = links.sparkSession
    with common.Tables(spark) as tables:
        edges = tables.store(links.where("a != b").select("a", "b").distinct())
        before = state(edges)
        while before[0]:
            grown = tables.store(stars(edges, True, 2 * before[0]))
            edges = tables.store(stars(grown, False, grown.count()))
            tables.drop(keep=1)
            now = state(edges)
            if now == before:
                break
            before = now
        one = edges.select(F.greatest("a", "b").alias("node"), F.least("a", "b").alias("component"))
        return (into.store if into else common.store)(one.union(one.select("component", "component").distinct()))


def _verdicts(docs: DataFrame, id_col: str, text: str, width: int, percent: int) -> DataFrame:
    """doc, th (hash of the text), n and component of every row of `docs`."""
    common.integral(docs, id_col)
    spark = docs.sparkSession
    with common.Tables(spark) as tables, common.small_batches(spark):
        full = tables.store(signatures(docs, id_col, text, width))
        able = full.where((F.col("n") > 0) & F.col("doc").isNotNull())
        classes = able.groupBy("k1", "k2").agg(F.min(F.col("doc").cast("long")).alias("rep"), F.count(F.lit(1)).alias("copies"), F.first("n").alias("n"), F.first("regs").alias("regs"))
        classes = tables.store(classes.withColumn("node", F.monotonically_increasing_id()))  # written, the numbers stay
        signed = tables.store(full.drop("regs"))
        tables.drop(keep=2)
        # keys that classes share
        keys = tables.store(bands(classes))
        shared = tables.store(keys.groupBy("key").agg(F.count(F.lit(1)).alias("size")).where("size > 1"))
        met = tables.store(common.spread(keys, shared, ["key"], "size", BANDS * classes.count()))
        total = met.count()
        weight = met.groupBy("node").agg(F.sum("size").alias("weight"))
        texts = docs.select(F.col(id_col).cast("long").alias("rep"), F.xxhash64(text).alias("th"), common.as_bytes(text).alias("t"))
        wanted = classes.join(weight.select("node"), "node").select("node", "rep", "k1", "k2", "n", "regs")
        first = signed.where("n > 0").groupBy(F.col("doc").cast("long").alias("rep"), "k1", "k2").agg(F.min("th").alias("th"))
        wanted = wanted.join(first, ["rep", "k1", "k2"])
        known = tables.store(texts.join(wanted, ["rep", "th"]).dropDuplicates(["rep", "th"]).select("node", "n", "regs", "t"))
        # a class for each key that all others of the key are compared with; the hash orders equal weights
        order = F.least(F.col("weight"), F.lit(1 << 40)) * (1 << 20) + F.pmod(F.xxhash64("node"), F.lit(1 << 20))
        pivots = met.join(weight, "node").groupBy("key").agg(F.max_by("node", order).alias("pivot"), F.max("size").alias("_n"))
        pairs = common.spread(met.select("key", "node"), tables.store(pivots), ["key"], "_n", total).where("node != pivot")
        pairs = tables.store(pairs.select(F.col("pivot").alias("a"), F.col("node").alias("b")).distinct())
        links = tables.store(confirmed(pairs, known, width, percent))
        found = components(links, tables)
        labelled = tables.store(met.select("key", "node").join(found, "node", "left").select("key", "node", F.coalesce("component", "node").alias("label")))
        nodes = tables.store(labelled.select("node", "label").distinct())
        mixed = labelled.groupBy("key").agg(F.count(F.lit(1)).alias("_n"), F.min("label").alias("lo"), F.max("label").alias("hi")).where("lo != hi and _n > 2")  # two classes have been compared
        met_labels = tables.store(labelled.select("key", "label").distinct().join(mixed.select("key"), "key"))
        renamed = nodes.groupBy("label").agg(F.count(F.lit(1)).alias("_n"))
        if not met_labels.isEmpty():  # components of components
            above = components(cross_links(tables, nodes, met_labels, known, width, percent), tables).select(F.col("node").alias("label"), F.col("component").alias("above"))
            renamed = renamed.join(above, "label", "left").withColumn("component", F.coalesce("above", "label"))
        else:
            renamed = renamed.withColumn("component", F.col("label"))
        found = tables.store(common.spread(nodes, renamed, ["label"], "_n", nodes.count()).select("node", "component"))
        # a component's number is its least id
        linked = classes.select("node", "rep", "k1", "k2").join(found, "node")
        least = linked.groupBy("component").agg(F.min("rep").alias("least"), F.count(F.lit(1)).alias("_n"))
        numbered = common.spread(linked, least, ["component"], "_n", linked.count()).select("k1", "k2", "least")
        named = classes.select("k1", "k2", "rep", "copies").join(numbered, ["k1", "k2"], "left").select("k1", "k2", "copies", F.coalesce("least", "rep").alias("component"))
        takes_part = (F.col("n") > 0) & F.col("doc").isNotNull()
        done = common.spread(signed.where(takes_part), named, ["k1", "k2"], "copies", signed.count()).select("doc", "th", "n", "component")
        alone = signed.where(~takes_part).select("doc", "th", "n", F.col("doc").cast("long").alias("component"))
        return common.store(done.unionByName(alone))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text: str = "text", width: int = 5, percent: int = 80) -> DataFrame:
    """id, n_shingles, component_id and kept of every row of `docs`."""
    out = _verdicts(docs, id_col, text, width, percent).select(F.col("doc").alias(id_col), F.col("n").alias("n_shingles"), F.col("component").alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col(id_col) == F.col("component_id"), F.lit(True)))


def deduplicate(docs: DataFrame, id_col: str = "doc_id", text: str = "text", width: int = 5, percent: int = 80) -> DataFrame:
    """The rows of `docs` that near_duplicates keeps, with their columns."""
    dropped = _verdicts(docs, id_col, text, width, percent).where("doc != component").select(F.col("doc").alias("_dropped"), F.col("th").alias("_th")).distinct()
    return docs.join(dropped, (docs[id_col] == dropped["_dropped"]) & (F.xxhash64(docs[text]) == dropped["_th"]), "left_anti")
