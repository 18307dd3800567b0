"""Vectorised splitting of texts into the words that a tokenizer file encodes one by one.

A slice of texts becomes one array of code points; classes of code points and rules about neighbours give all word
bounds at once.  Equal words are encoded once: a word's 64-bit hash finds its ids in a table that each Python worker
keeps, and only words not met before are encoded.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np

from . import common

LETTER, NUMBER, SPACE, OTHER = 1, 2, 3, 4
_kinds = np.zeros(0x110000, np.uint8)  # 0: not yet asked for


@lru_cache(maxsize=1)
def _askers():
    from tokenizers import Regex, pre_tokenizers

    return [(k, pre_tokenizers.Split(Regex(p), "removed")) for k, p in ((LETTER, r"\p{L}"), (NUMBER, r"\p{N}"), (SPACE, r"\s"))]


def kinds(codes: np.ndarray) -> np.ndarray:
    """Class of each code point, by the tokenizers library's own regular expressions."""
    out = _kinds[codes]
    if len(out) and not out.all():
        for c in np.unique(codes[out == 0]):
            ch = chr(c)
            _kinds[c] = next((k for k, asker in _askers() if not asker.pre_tokenize_str(ch)), OTHER)
        out = _kinds[codes]
    return out


@lru_cache(maxsize=1)
def _code_values() -> np.ndarray:
    return common.mix(np.arange(0x110000, dtype=np.uint64) + np.uint64(0x51ED270B)) | np.uint64(1)


def _contractions(codes: np.ndarray, kind: np.ndarray, row_start: np.ndarray, free: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where an apostrophe with s t m d re ve ll begins (`free`: a word may begin here), and the length of these."""
    n = len(codes)
    at = np.flatnonzero((codes == 0x27) & free)
    at = at[at + 1 < n]
    at = at[~row_start[at + 1]]
    a = codes[at + 1]
    inner = np.minimum(at + 2, n - 1)
    b = np.where((at + 2 < n) & ~row_start[inner], codes[inner], 0)
    one = np.isin(a, [ord(x) for x in "stmd"])
    two = ((a == ord("r")) & (b == ord("e"))) | ((a == ord("v")) & (b == ord("e"))) | ((a == ord("l")) & (b == ord("l")))
    ok = one | two
    return at[ok], np.where(one, 2, 3)[ok]


def _runs(codes: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Classes, row starts and starts of runs of one class."""
    kind = kinds(codes)
    row_start = np.zeros(len(codes), bool)
    row_start[rows[:-1][np.diff(rows) > 0]] = True
    start = row_start.copy()
    start[1:] |= kind[1:] != kind[:-1]
    return kind, row_start, start


def byte_level_words(codes: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of words, covering all, as by
    's|'t|'re|'ve|'m|'ll|'d| ?\\p{L}+| ?\\p{N}+| ?[^\\s\\p{L}\\p{N}]+|\\s+(?!\\S)|\\s+"""
    n = len(codes)
    if not n:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    kind, row_start, start = _runs(codes, rows)
    last = np.zeros(n, bool)  # a blank before something else in its row
    last[:-1] = (kind[:-1] == SPACE) & (kind[1:] != SPACE) & ~row_start[1:]
    led = np.zeros(n, bool)  # behind a space that belongs to it
    led[1:] = last[:-1] & (codes[:-1] == 0x20)
    start = (start & ~led) | last
    at, size = _contractions(codes, kind, row_start, start)
    start[at + 1] = False
    rest = at + size
    start[rest[rest < n]] = True
    starts = np.flatnonzero(start)
    return starts, np.append(starts[1:], n)


def folded_words(codes: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of words without blanks, as by
    's|'t|'re|'ve|'m|'ll|'d|\\p{L}+|\\p{N}|[^\\s\\p{L}\\p{N}]+"""
    n = len(codes)
    if not n:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    kind, row_start, start = _runs(codes, rows)
    start |= kind == NUMBER
    at, size = _contractions(codes, kind, row_start, start)
    start[at + 1] = False
    rest = at + size
    start[rest[rest < n]] = True
    starts = np.flatnonzero(start)
    ends = np.append(starts[1:], n)
    word = kind[starts] != SPACE
    return starts[word], ends[word]


def fold(text: str) -> str:
    """NFC, then lower case letter by letter (no final sigma)."""
    if not text.isascii():
        text = unicodedata.normalize("NFC", text).replace("Σ", "σ")
    return text.lower()


class Words:
    """Ids of words by hash; `encode` gives the ids of words not met before.  Emptied when it holds over `most` words."""

    def __init__(self, encode: Callable[[list[str]], list[list[int]]], most: int = 1_500_000):
        self.encode, self.most = encode, most
        self.clear()

    def clear(self) -> None:
        self.keys = np.empty(0, np.uint64)
        self.begin, self.size = np.empty(0, np.int64), np.empty(0, np.int64)
        self.ids = np.empty(0, np.int32)

    def look_up(self, text: str, codes: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All words' ids in order, and the number of ids of each word."""
        values = np.zeros(len(codes) + 1, np.uint64)
        np.cumsum(_code_values()[codes] * common._powers(common.BASE, len(codes)), out=values[1:])
        keys, first, where = np.unique(common.span_hash(values, starts, ends), return_index=True, return_inverse=True)
        if len(self.keys) > self.most:
            self.clear()
        at = np.searchsorted(self.keys, keys)
        known = at < len(self.keys)
        known[known] = self.keys[at[known]] == keys[known]
        new = np.flatnonzero(~known)
        if len(new):
            got = self.encode([text[s:e] for s, e in zip(starts[first[new]].tolist(), ends[first[new]].tolist(), strict=True)])
            size = np.fromiter(map(len, got), np.int64, len(got))
            begin = len(self.ids) + np.cumsum(size) - size
            self.ids = np.concatenate([self.ids, np.fromiter((y for x in got for y in x), np.int32, int(size.sum()))])
            place = at[new]
            self.keys, self.begin, self.size = np.insert(self.keys, place, keys[new]), np.insert(self.begin, place, begin), np.insert(self.size, place, size)
            at = np.searchsorted(self.keys, keys)
        size, begin = self.size[at][where], self.begin[at][where]
        return self.ids[np.repeat(begin - (np.cumsum(size) - size), size) + np.arange(int(size.sum()))], size


def encode_rows(texts: list[str], words: Words, bounds: Callable, special: dict[str, int], change: Callable[[str], str] | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Ids of all texts in one array and the number of each text's ids.  Strings of `special` are single ids, found first."""
    any_special = re.compile("|".join(map(re.escape, sorted(special)))) if special else None
    pieces, owner, fixed = [], [], []  # pieces of text; their rows; (piece before which it stands, row, id)
    for row, text in enumerate(texts):
        at = 0
        for m in any_special.finditer(text) if any_special else ():
            pieces.append(text[at : m.start()])
            owner.append(row)
            fixed.append((len(pieces), row, special[m[0]]))
            at = m.end()
        pieces.append(text[at:])
        owner.append(row)
    if change:
        pieces = [change(x) for x in pieces]
    joined = "".join(pieces)
    codes = np.frombuffer(joined.encode("utf-32-le"), np.uint32)
    rows = np.concatenate([[0], np.cumsum(np.fromiter(map(len, pieces), np.int64, len(pieces)))])
    starts, ends = bounds(codes, rows)
    ids, size = words.look_up(joined, codes, starts, ends) if len(starts) else (np.empty(0, np.int32), np.empty(0, np.int64))
    upto = np.concatenate([[0], np.cumsum(size)])[np.searchsorted(starts, rows)]  # ids before each piece
    if fixed:
        ids = np.insert(ids, upto[[p for p, _, _ in fixed]], [i for _, _, i in fixed])
    each = np.bincount(owner, weights=np.diff(upto), minlength=len(texts)) + np.bincount([r for _, r, _ in fixed], minlength=len(texts))
    return ids, each.astype(np.int64)


def in_slices(texts: list[str], limit: int = 2_000_000) -> Iterator[list[str]]:
    part, size = [], 0
    for t in texts:
        if part and size + len(t) > limit:
            yield part
            part, size = [], 0
        part.append(t)
        size += len(t)
    if part:
        yield part


@lru_cache(maxsize=1)
def byte_letters() -> dict[int, str]:
    """Printable stand-ins of the 256 bytes in byte-level vocabularies: printable Latin-1 stands for itself, the others follow from U+0100."""
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in own]
    return {b: chr(b) for b in own} | {b: chr(0x100 + i) for i, b in enumerate(rest)}
