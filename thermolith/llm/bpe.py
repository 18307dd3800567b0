"""Byte-level BPE, speculate and verify.

A word is first cut greedily into the longest tokens of the vocabulary.  A cut is the BPE encoding of its word if and
only if each two neighbours are compatible, that is, if exact merging of their joined bytes gives just these two back.
Compatibility of pairs is looked up for all neighbours at once in a sorted table of pairs met before, so only new pairs
are decided one by one, and only words with an incompatible pair are merged exactly.  Decoding gathers the tokens' bytes
for all ids at once.

A null text is empty and has no ids.  The special token's string in a text is that token.  Repeated rows are encoded
alike; other columns are not touched.
"""

from __future__ import annotations

import hashlib
import json
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from . import common, pretoken


class Bpe:
    """A byte-level vocabulary with merges, from a tokenizer file."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            file = json.load(f)
        byte = {c: b for b, c in pretoken.byte_letters().items()}
        spell = lambda token: bytes(byte[c] for c in token)
        model = file["model"]
        self.special = {t["content"]: t["id"] for t in file["added_tokens"]}
        plain = {t: i for t, i in model["vocab"].items() if t not in self.special}
        self.ids = {spell(t): i for t, i in plain.items()}
        self.longest = max(map(len, self.ids))
        pairs = (m if isinstance(m, list) else m.split(" ") for m in model["merges"])
        self.ranks = {(plain[a], plain[b]): (rank, plain[a + b]) for rank, (a, b) in enumerate(pairs)}
        self.width = 1 + max([*plain.values(), *self.special.values()])
        spelled = [b""] * self.width
        for token, i in [*self.ids.items(), *((s.encode(), i) for s, i in self.special.items())]:
            spelled[i] = token
        self.spelled = spelled
        self.lengths = np.fromiter(map(len, spelled), np.int64, self.width)
        self.offsets = np.cumsum(self.lengths) - self.lengths
        self.letters = np.frombuffer(b"".join(spelled), np.uint8)
        self.pairs, self.fits = np.empty(0, np.int64), np.empty(0, bool)
        self.words = pretoken.Words(self.encode_words)
        self.counts = {"words": 0, "merged": 0, "pairs": 0}

    def merge(self, word: bytes) -> list[int]:
        """Exact merging: the pair of lowest rank first, from the left."""
        out = [self.ids[word[i : i + 1]] for i in range(len(word))]
        ranks = self.ranks
        while len(out) > 1:
            (best, new), at = min((((ranks.get(p) or (1 << 60, -1)), i) for i, p in enumerate(zip(out, out[1:], strict=False))))
            if new < 0:
                break
            out[at : at + 2] = [new]
        return out

    def greedy(self, word: bytes) -> list[int]:
        ids, longest, out, at, n = self.ids, self.longest, [], 0, len(word)
        while at < n:
            end = min(n, at + longest)
            while (i := ids.get(word[at:end])) is None:
                end -= 1
            out.append(i)
            at = end
        return out

    def compatible(self, keys: np.ndarray) -> np.ndarray:
        """Whether pairs (first id * width + second id) are compatible."""
        keys, where = np.unique(keys, return_inverse=True)
        at = np.searchsorted(self.pairs, keys)
        known = at < len(self.pairs)
        known[known] = self.pairs[at[known]] == keys[known]
        new = np.flatnonzero(~known)
        if len(new):
            fits = [self.merge(self.spelled[a] + self.spelled[b]) == [a, b] for a, b in (divmod(k, self.width) for k in keys[new].tolist())]
            self.pairs, self.fits = np.insert(self.pairs, at[new], keys[new]), np.insert(self.fits, at[new], fits)
            self.counts["pairs"] += len(new)
            at = np.searchsorted(self.pairs, keys)
        return self.fits[at][where]

    def encode_words(self, words: list[str]) -> list[list[int]]:
        spelled = [w.encode() for w in words]
        out = [self.greedy(w) for w in spelled]
        size = np.fromiter(map(len, out), np.int64, len(out))
        flat = np.fromiter((i for x in out for i in x), np.int64, int(size.sum()))
        owner = np.repeat(np.arange(len(out)), size)
        inner = np.flatnonzero(owner[:-1] == owner[1:])
        if len(inner):
            wrong = ~self.compatible(flat[inner] * self.width + flat[inner + 1])
            failed = np.unique(owner[inner[wrong]]).tolist()
            for i in failed:
                out[i] = self.merge(spelled[i])
            self.counts["merged"] += len(failed)
        self.counts["words"] += len(out)
        return out

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        return pretoken.encode_rows(texts, self.words, pretoken.byte_level_words, self.special)

    def decode(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All bytes in one array, and each id's end in it."""
        size = self.lengths[ids]
        ends = np.cumsum(size)
        return self.letters[np.repeat(self.offsets[ids] - (ends - size), size) + np.arange(int(ends[-1]) if len(ends) else 0)], ends


@lru_cache(maxsize=2)
def bpe(path: str) -> Bpe:
    """Kept by each Python worker."""
    return Bpe(path)


def digest(docs: DataFrame, vocabulary: str, id_col: str = "doc_id", text: str = "text", with_ids: bool = False) -> DataFrame:
    """id, n_tokens, ids_sha256, decoded_sha256 (and ids, decoded) of every whole text."""
    rows = docs.select(id_col, common.as_bytes(text).alias("_text"))

    def run(batches):
        model = bpe(vocabulary)
        for b in batches:
            first = 0
            for part in pretoken.in_slices([x.decode("utf-8", "replace") for x in b.column(1).to_pylist()], 1_000_000):
                ids, size = model.encode(part)
                decoded, ends = model.decode(ids)
                packed = np.ascontiguousarray(ids.astype("<u4"))
                to = np.cumsum(size)
                begin = to - size
                upto = np.concatenate([[0], ends])
                sides = list(zip(begin.tolist(), to.tolist(), upto[begin].tolist(), upto[to].tolist(), strict=True))
                # a library decodes bytes that are no UTF-8 to U+FFFD; whole texts never give such bytes
                columns = [b.column(0).slice(first, len(part)), pa.array(size, pa.int64()), pa.array([hashlib.sha256(packed[s:e]).hexdigest() for s, e, _, _ in sides]), pa.array([hashlib.sha256(decoded[s:e]).hexdigest() for _, _, s, e in sides])]
                if with_ids:
                    columns += [pa.ListArray.from_arrays(pa.array(np.concatenate([[0], to]).astype(np.int32)), pa.array(ids.astype(np.int32))), pa.array([decoded[s:e].tobytes().decode("utf-8", "replace") for _, _, s, e in sides])]
                yield pa.RecordBatch.from_arrays(columns, names=[id_col, "n_tokens", "ids_sha256", "decoded_sha256", *(["ids", "decoded"] if with_ids else [])])
                first += len(part)

    kind = rows.schema[id_col].dataType.simpleString()
    return rows.mapInArrow(run, f"`{id_col}` {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string" + (", ids array<int>, decoded string" if with_ids else ""))
