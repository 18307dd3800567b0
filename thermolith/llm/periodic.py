"""Runs of repeated words by Crochemore's refinement of classes of positions.

Positions of a document are in one class of length l if the l words from there are equal.  Classes of length l + 1 come from
those of length l by splitting each class by the classes of its positions' right neighbours; only the smaller parts of a class
split before need be used to split others, so each position is moved O(log n) times for n words, whatever the lengths.
Positions of a class are linked in order.  Two neighbours in a class of length l at distance l are a square, and one whose
half is no power: between them the half would occur again.  Squares of one period at consecutive positions are one run,
with this as its smallest period.

Many documents are refined at once, in arrays: each ends with a word of its own, and no class holds positions of two
documents.  Documents of like lengths meet, and one takes part as long as the period asked for still fits into it.

Words are `[^\\x20\\x09-\\x0D]+`; a null or wordless text has none and no runs.  Very long texts are read whole, in one task
each: memory is a few dozen bytes for each word.  Runs of one document that are equal in exponent are ordered by start, then
period.  Repeated rows are treated alike, ids need not differ and may be null, an empty table gives no rows, and other columns,
whatever their names, are not read.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from fractions import Fraction
from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from . import common


def ragged(begin: np.ndarray, size: np.ndarray) -> np.ndarray:
    """begin, begin + 1, ... for `size` places, for all ranges in a row."""
    ends = np.cumsum(size)
    return np.repeat(begin - (ends - size), size) + np.arange(int(ends[-1]) if len(ends) else 0)


class Distances:
    """Positions by the distance to their next neighbour, as noted; a later note of a position may have made one stale."""

    MANY = 512

    def __init__(self) -> None:
        self.few: dict[int, list[int]] = defaultdict(list)
        self.sorted: list[tuple[np.ndarray, np.ndarray]] = []

    def note(self, distance: np.ndarray, position: np.ndarray) -> None:
        if len(distance) < self.MANY:
            for d, x in zip(distance.tolist(), position.tolist(), strict=True):
                self.few[d].append(x)
            return
        if len(self.sorted) == 16:  # lists as long as ever, but few
            self.sorted.append((distance, position))
            distance, position = (np.concatenate(x) for x in zip(*self.sorted, strict=True))
            self.sorted = []
        order = np.argsort(distance, kind="stable")
        self.sorted.append((distance[order], position[order]))

    def take(self, distance: int) -> np.ndarray:
        parts = [np.array(self.few.pop(distance, ()), np.int64)]
        for d, x in self.sorted:
            s, e = d.searchsorted(distance), d.searchsorted(distance, "right")
            if s < e:
                parts.append(x[s:e])
        return np.unique(np.concatenate(parts)) if len(parts) > 1 else np.unique(parts[0])


class Refinement:
    """Classes of equal factors of all positions of several documents; `longest` is each position's last length of use."""

    def __init__(self, symbols: np.ndarray, longest: np.ndarray):
        n = len(symbols)
        self.longest, self.length, self.far = longest, 1, Distances()
        _, self.cls, size = np.unique(symbols, return_inverse=True, return_counts=True)
        self.classes = len(size)
        self.begin, self.size = np.zeros(n, np.int64), np.zeros(n, np.int64)
        self.size[: len(size)] = size
        self.begin[: len(size)] = np.cumsum(size) - size
        #: positions by class, and where each one stands
        self.order = np.argsort(self.cls, kind="stable")
        self.place = np.empty(n, np.int64)
        self.place[self.order] = np.arange(n)
        self.next, self.last = np.full(n, -1), np.full(n, -1)
        self.splitters = self.order
        same = np.flatnonzero(self.cls[self.order[:-1]] == self.cls[self.order[1:]])
        self._link(self.order[same], self.order[same + 1])

    def _link(self, a: np.ndarray, b: np.ndarray) -> None:
        self.next[a], self.last[b] = b, a
        distance = b - a
        use = (distance >= self.length) & (distance <= self.longest[a])
        self.far.note(distance[use], a[use])

    def squares(self) -> np.ndarray:
        """Starts, in order, of the squares whose period is the present length."""
        x = self.far.take(self.length)
        return x[self.next[x] - x == self.length]

    def refine(self) -> None:
        """From classes of one length to those of the next."""
        self.length += 1
        right = self.splitters[self.splitters > 0]
        x = right - 1
        use = (self.size[self.cls[x]] > 1) & (self.longest[x] >= self.length)
        x, by = x[use], self.cls[right[use]]
        self.splitters = x[:0]
        if not len(x):
            return
        of = self.cls[x]
        order = np.lexsort((x, by, of))
        x, by, of = x[order], by[order], of[order]
        # groups: one class, one class of right neighbours
        first = np.flatnonzero(np.concatenate([[True], (of[1:] != of[:-1]) | (by[1:] != by[:-1])]))
        count, home = np.diff(np.append(first, len(x))), of[first]
        # a class that is used up leaves its largest group where it is
        lead = np.flatnonzero(np.concatenate([[True], home[1:] != home[:-1]]))
        used = np.add.reduceat(count, lead) == self.size[home[lead]]
        by_size = np.lexsort((count, home))
        largest = by_size[np.append(lead[1:], len(home)) - 1]
        moves = np.ones(len(home), bool)
        moves[largest[used]] = False
        if not moves.any():
            return
        keep = np.repeat(moves, count)
        x, of, home, count = x[keep], of[keep], home[moves], count[moves]
        self._unlink(x, of)
        self._move(x, of, home, count)

    def _unlink(self, x: np.ndarray, of: np.ndarray) -> None:
        """Takes positions (by class) out of their classes' links; neighbours that go together are one chain."""
        x = x[np.lexsort((x, of))]
        apart = self.next[x[:-1]] != x[1:]
        a, b = self.last[x[np.concatenate([[True], apart])]], self.next[x[np.concatenate([apart, [True]])]]
        self.next[a[a >= 0]], self.last[b[b >= 0]] = b[a >= 0], a[b >= 0]
        both = (a >= 0) & (b >= 0)
        self._link(a[both], b[both])

    def _move(self, x: np.ndarray, of: np.ndarray, home: np.ndarray, count: np.ndarray) -> None:
        """Makes each group (of `count` of the positions x, out of class `home`) a class at the end of its old one's places."""
        lead = np.flatnonzero(np.concatenate([[True], home[1:] != home[:-1]]))
        old, gone = home[lead], np.add.reduceat(count, lead)
        tail = self.begin[old] + self.size[old] - gone
        places = ragged(tail, gone)
        there = self.order[places]
        going = np.zeros(len(places), bool)
        inside = self.place[x] >= np.repeat(tail, gone)
        offset = np.repeat(np.cumsum(gone) - gone - tail, gone)  # from a place to its number among all tails
        going[(self.place[x] + offset)[inside]] = True
        stay, front = there[~going], self.place[x[~inside]]
        self.order[front], self.place[stay] = stay, front
        self.order[places], self.place[x] = x, places
        first = np.cumsum(count) - count
        new = self.classes + np.arange(len(count))
        self.classes += len(count)
        self.begin[new], self.size[new] = places[first], count
        self.size[old] -= gone
        self.cls[x] = np.repeat(new, count)
        self.next[x], self.last[x] = -1, -1
        group = np.repeat(np.arange(len(count)), count)
        same = np.flatnonzero(group[:-1] == group[1:])
        self._link(x[same], x[same + 1])
        # all parts of a class but the largest split others next
        parts = np.concatenate([old, new])
        owner = np.concatenate([np.arange(len(old)), np.repeat(np.arange(len(old)), np.diff(np.append(lead, len(home))))])
        by_size = np.lexsort((self.size[parts], owner))
        is_last = np.append(owner[by_size][1:] != owner[by_size][:-1], True)
        small = parts[by_size[~is_last]]
        self.splitters = self.order[ragged(self.begin[small], self.size[small])]


def find_runs(documents: list[np.ndarray], times: int = 4, least: int = 6) -> list[list[tuple[int, int, int]]]:
    """(start, length, smallest period) of every maximal run of each document's symbols (whole numbers) whose length is at
    least `times` periods and `least`, by start, then period."""
    if times < 2:
        raise ValueError("a run has two periods at least")
    sizes = np.fromiter(map(len, documents), np.int64, len(documents))
    out: list[list[tuple[int, int, int]]] = [[] for _ in documents]
    total = int(sizes.sum()) + len(sizes)
    if total == len(sizes):
        return out
    # symbols of different documents differ, and so do the words that end them
    highest = np.fromiter((int(d.max()) + 1 if len(d) else 0 for d in documents), np.int64, len(documents))
    base = np.cumsum(highest + 1) - (highest + 1)
    starts = np.cumsum(sizes + 1) - (sizes + 1)
    symbols = np.empty(total, np.int64)
    for d, s, b, h in zip(documents, starts.tolist(), base.tolist(), highest.tolist(), strict=True):
        symbols[s : s + len(d)] = d + b
        symbols[s + len(d)] = b + h
    longest = np.repeat(sizes // times, sizes + 1)
    classes = Refinement(symbols, longest)
    for period in range(1, int(longest.max()) + 1):
        if period > 1:
            classes.refine()
        at = classes.squares()
        if len(at):
            edge = np.flatnonzero(np.diff(at) != 1)
            first, last = at[np.concatenate([[0], edge + 1])], at[np.append(edge, len(at) - 1)]
            size = last - first + 2 * period
            ok = size >= max(least, times * period)
            for s, n in zip(first[ok].tolist(), size[ok].tolist(), strict=True):
                doc = int(np.searchsorted(starts, s, "right")) - 1
                out[doc].append((s - int(starts[doc]), n, period))
        if not len(classes.splitters):
            break  # classes that nothing splits any more would stay whole for ever, but every document's end is its own
    for runs in out:
        runs.sort(key=lambda r: (r[0], r[2]))
    return out


def strongest(runs: list[tuple[int, int, int]]) -> tuple[int, int, int] | None:
    """The run of the greatest exact exponent; ties go to the smallest start, then period."""
    return min(runs, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2])) if runs else None


def collapse(words: list[bytes], runs: list[tuple[int, int, int]]) -> bytes:
    """The words outside runs and the first period of each, joined by spaces; a word in any run's rest goes."""
    if not runs:
        return b" ".join(words)
    cover = np.zeros(len(words) + 1, np.int64)
    for s, n, p in runs:
        cover[s + p] += 1
        cover[s + n] -= 1
    return b" ".join(compress(words, (np.cumsum(cover[:-1]) == 0).tolist()))


RUN = "struct<start:bigint,length:bigint,period:bigint>"


def periodic_runs(docs: DataFrame, id_col: str = "doc_id", text: str = "text", times: int = 4, least: int = 6, words_at_once: int = 1_000_000) -> DataFrame:
    """id, n_words, runs (by start, then period), strongest (null without runs) and collapsed, the text with one period left of
    each run, its words joined by spaces, of every whole text."""
    rows = docs.select(id_col, common.as_bytes(text).alias("_text"))
    kind = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]):
        named = lambda r: dict(zip(("start", "length", "period"), r, strict=True))
        for b in batches:
            words = [t.split() for t in b.column(1).to_pylist()]  # bytes split at these six blanks
            found: list = [None] * len(words)
            for part in _alike(words, words_at_once):
                numbers: list[np.ndarray] = []
                for i in part:
                    of: dict[bytes, int] = {}
                    numbers.append(np.fromiter((of.setdefault(w, len(of)) for w in words[i]), np.int64, len(words[i])))
                for i, runs in zip(part, find_runs(numbers, times, least), strict=True):
                    found[i] = runs
            best = [strongest(r) for r in found]
            yield pa.RecordBatch.from_arrays(
                [
                    b.column(0), pa.array(map(len, words), pa.int64()), pa.array([[named(x) for x in r] for r in found], pa.list_(kind)),
                    pa.array([named(x) if x else None for x in best], kind), pa.array([collapse(w, r).decode("utf-8", "replace") for w, r in zip(words, found, strict=True)]),
                ],
                names=[id_col, "n_words", "runs", "strongest", "collapsed"],
            )

    id_kind = rows.schema[id_col].dataType.simpleString()
    return rows.mapInArrow(run, f"`{id_col}` {id_kind}, n_words long, runs array<{RUN}>, strongest {RUN}, collapsed string")


def _alike(words: list[list[bytes]], most: int) -> Iterator[list[int]]:
    """Rows in order of their number of words, in parts of about `most` words."""
    part, size = [], 0
    for i in sorted(range(len(words)), key=lambda i: len(words[i])):
        if part and size + len(words[i]) > most:
            yield part
            part, size = [], 0
        part.append(i)
        size += len(words[i]) + 1
    if part:
        yield part
