"""Language identification by a byte convolutional network.

Text is read as UTF-8 bytes in fixed windows of 128.  Bytes are embedded, convolved by filters of several widths,
rectified and max-pooled over the window; a softmax layer gives the language.  The network is trained in numpy by Adam
on windows of a bounded sample: up to `per_lang` labelled documents of each language, chosen by hash, and up to
`windows` windows of each, `most` windows (of 128 bytes) in all, which bounds what the driver holds.  Every label is learnt,
up to `labels` of them.  A text's probabilities are the geometric mean over all its windows, so whole texts count.

A softmax over the learnt languages is sure of one for any text, so `accepted` also asks how likely the text's byte pairs
are in the language found (or, if they lie over FAR spreads off, in the nearest): the mean log-likelihood of a pair may lie
`away` spreads below that of the language's own windows, whatever the number of languages.  Pairs are counted and the spread is taken on the same bounded sample.

For prediction the embedding and the filters are multiplied out into tables over single bytes and byte pairs, and a
convolution becomes a few look-ups a byte.

Null texts and texts without a letter are `und` with score 0.  With one language in the sample all others are that
language; with none, `und`.  Null languages are never learnt from.  Ids, sources and labels are no inputs: rows alike in
text get the same language and score, and of languages with equal scores it is the first by name.  Very long texts are read
whole, in parts.  An empty table gives no rows.  Other columns, whatever their names, are not read; `accepted` keeps them.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common

WINDOW, DIM, FILTERS, WIDTHS = 128, 8, 12, (2, 3, 4)
PAD = 256
FAR = 3.0
UNKNOWN = "und"
LOWER = np.array([i + 32 * (65 <= i <= 90) for i in range(257)], np.int32)
ASCII_LETTER = re.compile(rb"[A-Za-z]")


@dataclass
class Network:
    langs: list[str]
    embedding: np.ndarray  # 257 x DIM
    filters: list[np.ndarray]  # for each width: width * DIM x FILTERS
    bias: list[np.ndarray]
    out: np.ndarray
    out_bias: np.ndarray

    @classmethod
    def new(cls, langs: list[str], seed: int = 4) -> Network:
        r = np.random.default_rng(seed)
        draw = lambda *shape, fan: (r.standard_normal(shape) / np.sqrt(fan)).astype(np.float32)
        return cls(langs, draw(257, DIM, fan=1), [draw(w * DIM, FILTERS, fan=w * DIM) for w in WIDTHS], [np.zeros(FILTERS, np.float32) for _ in WIDTHS], draw(FILTERS * len(WIDTHS), len(langs), fan=FILTERS), np.zeros(len(langs), np.float32))

    def parameters(self) -> list[np.ndarray]:
        return [self.embedding, *self.filters, *self.bias, self.out, self.out_bias]

    def gradients(self, x: np.ndarray, y: np.ndarray) -> list[np.ndarray]:
        """Of the mean cross entropy over windows x (n x WINDOW) with labels y."""
        n = len(x)
        e = self.embedding[x]
        patches = [np.lib.stride_tricks.sliding_window_view(e, w, axis=1).transpose(0, 1, 3, 2).reshape(n, WINDOW - w + 1, w * DIM) for w in WIDTHS]
        pooled, at = [], []
        for p, f, b in zip(patches, self.filters, self.bias, strict=True):
            r = p @ f + b
            best = r.argmax(1)
            at.append(best)
            pooled.append(np.maximum(np.take_along_axis(r, best[:, None], 1)[:, 0], 0))
        h = np.concatenate(pooled, 1)
        z = h @ self.out + self.out_bias
        z = np.exp(z - z.max(1, keepdims=True))
        z /= z.sum(1, keepdims=True)
        z[np.arange(n), y] -= 1
        z /= n
        dh = (z @ self.out.T) * (h > 0)
        d_embedding = np.zeros_like(self.embedding)
        d_filters, d_bias = [], []
        for k, w in enumerate(WIDTHS):
            g = dh[:, k * FILTERS : (k + 1) * FILTERS]
            chosen = patches[k][np.arange(n)[:, None], at[k]]  # n x FILTERS x w * DIM
            d_filters.append(np.einsum("nf,nfp->pf", g, chosen))
            d_bias.append(g.sum(0))
            back = (g[:, :, None] * self.filters[k].T[None]).reshape(-1, DIM)
            spots = (at[k][:, :, None] + np.arange(w)).reshape(n, -1)
            np.add.at(d_embedding, np.take_along_axis(x, spots, 1).reshape(-1), back)
        return [d_embedding, *d_filters, *d_bias, h.T @ z, z.sum(0)]

    def train(self, x: np.ndarray, y: np.ndarray, epochs: int = 3, batch: int = 128, rate: float = 0.01, seed: int = 4) -> Network:
        r = np.random.default_rng(seed)
        ps = self.parameters()
        first, second, step = [np.zeros_like(p) for p in ps], [np.zeros_like(p) for p in ps], 0
        for epoch in range(epochs):
            order = r.permutation(len(x))
            for k in range(0, len(x), batch):
                step += 1
                now = order[k : k + batch]
                speed = rate * 0.3**epoch * np.sqrt(1 - 0.999**step) / (1 - 0.9**step)
                for p, g, m, v in zip(ps, self.gradients(x[now], y[now]), first, second, strict=True):
                    m += 0.1 * (g - m)
                    v += 0.001 * (g * g - v)
                    p -= (speed * m / (np.sqrt(v) + 1e-8)).astype(np.float32)
        return self

    def tables(self) -> list[list[np.ndarray]]:
        """For each width, look-up tables over bytes or byte pairs whose sum is the filters' answer."""
        out = []
        for w, f in zip(WIDTHS, self.filters, strict=True):
            each = [self.embedding @ f[j * DIM : (j + 1) * DIM] for j in range(w)]
            pairs = [(each[j][:, None] + each[j + 1][None]).reshape(-1, FILTERS) for j in range(0, w - 1, 2)]
            out.append(pairs + ([each[-1]] if w % 2 else []))
        return out

    def log_probabilities(self, windows: np.ndarray, tables: list[list[np.ndarray]]) -> np.ndarray:
        n = len(windows)
        pair = windows[:, :-1] * 257 + windows[:, 1:]
        pooled = []
        for w, b, ts in zip(WIDTHS, self.bias, tables, strict=True):
            m = WINDOW - w + 1
            total = None
            for j, t in enumerate(ts):
                got = t.take((pair if len(t) > 257 else windows)[:, 2 * j : 2 * j + m].reshape(-1), axis=0)
                total = got if total is None else np.add(total, got, out=total)
            pooled.append(np.maximum(total.reshape(n, m, FILTERS).max(1) + b, 0))
        z = np.concatenate(pooled, 1) @ self.out + self.out_bias
        z -= z.max(1, keepdims=True)
        return z - np.log(np.exp(z).sum(1, keepdims=True))


#: Tables of byte pairs, at most.
TABLES = 256


@dataclass
class Likelihood:
    """Log-probabilities of a byte (A-Z as a-z) after another in each language, and where its windows' means lie.

    A table takes 264 KB in every task, so there are no more than `TABLES`: of more languages those with the fewest windows share
    the last one."""

    tables: np.ndarray  # tables x 257 * 257
    of: np.ndarray  # the table of each language
    middle: np.ndarray
    spread: np.ndarray

    @staticmethod
    def table(x: np.ndarray) -> np.ndarray:
        x = LOWER[x]
        pair = x[:, :-1] * 257 + x[:, 1:]
        n = np.bincount(pair[x[:, 1:] != PAD], minlength=257 * 257).reshape(257, 257) + 0.02
        return np.log(n / n.sum(1, keepdims=True)).astype(np.float32).reshape(-1)

    @staticmethod
    def sums(x: np.ndarray, tables: np.ndarray, lang: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Of each window, the sum over its pairs in its language, and their number."""
        x = LOWER[x]
        real = x[:, 1:] != PAD
        return np.where(real, tables[lang[:, None], x[:, :-1] * 257 + x[:, 1:]], 0).sum(1, dtype=np.float64), real.sum(1)

    @classmethod
    def fit(cls, langs: list[str], x: np.ndarray, y: np.ndarray) -> Likelihood:
        """Half of the windows are measured by the other half's counts."""
        rank = np.argsort(np.argsort(-np.bincount(y, minlength=len(langs)), kind="stable"), kind="stable")
        of = np.minimum(rank, TABLES - 1) if len(langs) > TABLES else np.arange(len(langs))
        y, langs = of[y], langs[: TABLES]
        half, means = np.arange(len(x)) % 2, np.zeros(len(x))
        for part in (0, 1):
            tables = np.stack([cls.table(x[(y == k) & (half != part)]) for k in range(len(langs))])
            total, n = cls.sums(x[half == part], tables, y[half == part])
            means[half == part] = total / np.maximum(n, 1)
        full = x[:, -1] != PAD
        middle, spread = np.zeros(len(langs)), np.full(len(langs), np.inf)  # without windows: all are accepted
        for k in range(len(langs)):
            own = means[(y == k) & full] if ((y == k) & full).any() else means[y == k]
            if len(own):
                middle[k] = np.median(own)
                spread[k] = max(middle[k] - np.quantile(own, 0.16), 0.05)
        return cls(np.stack([cls.table(x[y == k]) for k in range(len(langs))]), of, middle, spread)

    def away(self, row: np.ndarray, x: np.ndarray, lang: np.ndarray) -> np.ndarray:
        """Spreads of each row's windows below the middle of its language, which `lang` gives by its table; a text shorter than a
        window may vary more."""
        total, n = np.zeros(len(lang)), np.zeros(len(lang))
        for k in range(0, len(x), 4096):
            at = row[k : k + 4096]
            for into, add in zip((total, n), self.sums(x[k : k + 4096], self.tables, lang[at]), strict=True):
                np.add.at(into, at, add)
        short = np.sqrt(np.minimum(n, WINDOW - 1) / (WINDOW - 1))
        return (self.middle[lang] - total / np.maximum(n, 1)) / self.spread[lang] * short


def windows_of(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, windows) of all rows' bytes, the last window of a row padded."""
    size = np.diff(off)
    count = -(-size // WINDOW)
    row = np.repeat(np.arange(len(size)), count)
    begin = off[:-1][row] + (np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count)) * WINDOW
    at = begin[:, None] + np.arange(WINDOW)
    out = np.where(at < off[1:][row][:, None], np.append(data, 0)[np.minimum(at, len(data))], PAD)
    return row, out.astype(np.int32)


def _has_letter(text: bytes) -> bool:
    return bool(ASCII_LETTER.search(text)) or any(map(str.isalpha, text.decode("utf-8", "ignore")))


def held_out(id_col: str = "doc_id") -> Column:
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 3 == 1, F.lit(False))


def sample(docs: DataFrame, may_learn: Column, text: str = "text", lang: str = "lang", id_col: str = "doc_id", per_lang: int = 300, windows: int = 24, most: int = 100_000, labels: int = 10_000) -> tuple[list[str], np.ndarray, np.ndarray]:
    """(languages, windows, labels): the bounded training sample, the same for the same documents.

    With so many languages that these would have over `most` windows, all have fewer windows of each document, and if it
    must be fewer documents; no language less than one.  Of more than `labels` different labels, as in a column that holds
    no languages, those with the fewest rows (then the last by name) are no languages, so that all this stays bounded."""
    learn = docs.where(may_learn & F.col(lang).isNotNull()).select(F.col(lang).cast("string").alias("lang"), F.col(text).alias("t"), F.xxhash64(F.lit(4), id_col, text).alias("h"))
    counts = learn.groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(labels).collect()
    langs = sorted(r["lang"] for r in counts)
    if not langs:
        return [], np.empty((0, WINDOW), np.int32), np.empty(0, np.int64)
    windows = max(1, min(windows, most // (per_lang * len(langs))))
    per_lang = max(1, min(per_lang, most // (windows * len(langs))))
    # rows under a hash limit that leaves about 1.5 times per_lang of each language, then the least of these
    known = docs.sparkSession.createDataFrame([(r["lang"], min(1.0, 1.5 * per_lang / r["count"] + 30 / r["count"])) for r in counts], "lang string, part double")
    low = learn.join(F.broadcast(known), "lang").where(F.pmod("h", F.lit(1 << 30)) < F.col("part") * (1 << 30))  # a row for each label
    picked: dict[str, list[int]] = {x: [] for x in langs}
    for r in low.select("lang", "h").distinct().collect():
        picked[r["lang"]].append(r["h"])
    chosen = [(x, h) for x in langs for h in sorted(picked[x])[:per_lang]]
    few = docs.sparkSession.createDataFrame(chosen, "lang string, h long")
    low = low.join(F.broadcast(few), ["lang", "h"]).select("lang", "h", common.as_bytes("t").alias("t"))  # `most` rows or less

    def run(batches):
        for b in batches:
            for first, end, off, data in common.slices(b.column(2)):
                row, x = windows_of(data, off)
                size = np.bincount(row, minlength=end - first)
                inner = np.arange(len(row)) - np.repeat(np.cumsum(size) - size, size)
                every = np.maximum(1, -(-size // windows))[row]
                chosen = inner % every == 0
                x = x[chosen]
                flat = pa.Array.from_buffers(pa.binary(), len(x), [None, pa.py_buffer((np.arange(len(x) + 1) * 2 * WINDOW).astype(np.int32)), pa.py_buffer(np.ascontiguousarray(x.astype("<u2")))])
                r = pa.array(row[chosen] + first)
                yield pa.RecordBatch.from_arrays([b.column(0).take(r), b.column(1).take(r), pa.array(inner[chosen]), flat], names=["lang", "h", "i", "x"])

    got = low.dropDuplicates(["lang", "h"]).mapInArrow(run, "lang string, h long, i long, x binary").collect()
    number = {x: i for i, x in enumerate(langs)}
    kept = sorted(got, key=lambda r: (r["h"], r["i"], bytes(r["x"])))
    x = np.frombuffer(b"".join(bytes(r["x"]) for r in kept), "<u2").reshape(-1, WINDOW).astype(np.int32)
    return langs, x, np.array([number[r["lang"]] for r in kept], np.int64)


def fit(langs: list[str], x: np.ndarray, y: np.ndarray, seed: int = 4) -> Network | None:
    """A network trained on the windows, and on as many that are cut short."""
    if not langs:
        return None
    short = x.copy()
    cut = np.random.default_rng(seed).integers(8, WINDOW, len(x))
    short[np.arange(WINDOW)[None] >= cut[:, None]] = PAD
    return Network.new(langs, seed).train(np.concatenate([x, short]), np.concatenate([y, y]), seed=seed)


def predict(docs: DataFrame, network: Network | None, text: str = "text", keep: tuple[str, ...] = ("doc_id",), likely: Likelihood | None = None) -> DataFrame:
    """`keep`, lang_pred and score of every row; with `likely` also away."""
    rows = docs.select(*keep, F.col(text).cast("binary").alias("_text"))

    def run(batches):
        tables = network.tables() if network else []
        for b in batches:
            column = b.column(len(keep))
            lettered = np.array([x is not None and _has_letter(x) for x in column.to_pylist()], bool)
            column = column.fill_null(b"")
            for first, end, off, data in common.slices(column, 1 << 18):
                n = end - first
                away = np.zeros(n)
                logs, count = np.zeros((n, len(network.langs) if network else 1)), np.zeros(n)
                if network and len(data):
                    row, x = windows_of(data, off)
                    for k in range(0, len(x), 4096):  # a very long text comes alone
                        np.add.at(logs, row[k : k + 4096], network.log_probabilities(x[k : k + 4096], tables))
                    count = np.bincount(row, minlength=n)
                logs /= np.maximum(count, 1)[:, None]
                p = np.exp(logs - logs.max(1, keepdims=True))
                p /= p.sum(1, keepdims=True)
                best = p.argmax(1)
                if network and likely and len(data):
                    away = likely.away(row, x, likely.of[best])
                    far = away > FAR
                    if far.any():  # the network may have named the wrong one
                        own = far[row]
                        others = [likely.away(row[own], x[own], np.full(n, k)) for k in range(len(likely.tables))]
                        away = np.where(far, np.min(others, axis=0), away)
                ok = lettered[first:end] & (network is not None)
                names = [network.langs[i] if k else UNKNOWN for i, k in zip(best.tolist(), ok.tolist(), strict=True)]
                more = [pa.array(away)] if likely else []
                yield pa.RecordBatch.from_arrays([b.column(i).slice(first, n) for i in range(len(keep))] + [pa.array(names, pa.string()), pa.array(np.where(ok, p.max(1), 0.0)), *more], names=[*keep, "lang_pred", "score", *["away"] * len(more)])

    kinds = [f"`{f.name}` {f.dataType.simpleString()}" for f in rows.select(*keep).schema]
    return rows.mapInArrow(run, ", ".join([*kinds, "lang_pred string", "score double", *["away double"] * bool(likely)]))


def identify(docs: DataFrame, id_col: str = "doc_id", text: str = "text", lang: str = "lang", **how) -> DataFrame:
    """id, held_out, lang_pred and score of every row; learns from the rows that are not held out."""
    network = fit(*sample(docs, F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 3 != 1, F.lit(False)), text, lang, id_col, **how))
    return predict(docs, network, text, (id_col,)).select(id_col, held_out(id_col).alias("held_out"), "lang_pred", "score")


def accepted(docs: DataFrame, text: str = "text", lang: str = "lang", id_col: str = "doc_id", least: float = 0.4, away: float = 8.0, **how) -> DataFrame:
    """The rows of `docs` in which a language is found with a score of at least `least`, and whose byte pairs are no less
    likely in a learnt language than `away` spreads below its own, with their columns."""
    langs, x, y = sample(docs, F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 3 != 1, F.lit(False)), text, lang, id_col, **how)
    row = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("_row"), F.col(text).alias("_text"))
    found = predict(row, fit(langs, x, y), "_text", ("_row",), Likelihood.fit(langs, x, y) if langs else None)
    found = found.where((F.col("lang_pred") != UNKNOWN) & (F.col("score") >= least))
    if langs:
        found = found.where(F.col("away") <= away)
    return found.select(*(F.col("_row")[c].alias(c) for c in docs.columns))
