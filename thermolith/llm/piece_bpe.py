"""SentencePiece encoding and decoding of merge-type vocabularies by an agenda of adjacent symbols.

A text is normalised by the library (a space becomes U+2581, and one leads the text) and cut where a run of U+2581 begins:
no piece holds that sign behind another one, so nothing merges across a cut and each part is encoded alone.  In a part all
adjacent symbols whose joined string is a piece stand in an agenda, best score first, then leftmost.  The best is merged,
and its new neighbours enter; entries whose symbols have changed since are passed over when they come up.  Symbols that
are no piece at the end become an id for each of their bytes.  Decoding gathers the pieces' bytes of all ids at once.

Parts are encoded once in a worker and found by hash afterwards.  Every part not met before is also encoded by the
sentencepiece library, all new parts of an Arrow batch in one call (`check="texts"`: all whole texts of the batch), and
any difference raises.

A null text is empty; an empty text has only the end id and decodes to an empty one.  U+2581 in a text is a space, as in the
library.  Very long texts, and very long parts without a space, are encoded whole: the agenda grows with a part's length.
Repeated rows are encoded alike, ids need not differ and may be null, an empty table gives no rows, and other columns,
whatever their names, are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache
from heapq import heapify, heappop, heappush

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from . import common, pretoken

SPACE = "▁"
#: Kinds of pieces in a model file (fixed values of its format).
NORMAL, UNKNOWN, CONTROL, USER_DEFINED, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
MERGES = 2


def fields(message: bytes) -> Iterator[tuple[int, int | bytes]]:
    """Numbers and values of a protocol buffer message's fields; fixed-width ones as bytes."""
    at = 0

    def varint() -> int:
        nonlocal at
        out = shift = 0
        while True:
            b = message[at]
            at += 1
            out |= (b & 127) << shift
            shift += 7
            if b < 128:
                return out

    while at < len(message):
        number, wire = divmod(varint(), 8)
        if wire == 0:
            yield number, varint()
        else:
            size = varint() if wire == 2 else 8 if wire == 1 else 4
            yield number, message[at : at + size]
            at += size


class PieceBpe:
    """A vocabulary of pieces with scores, from a model file of the merge type with byte pieces."""

    def __init__(self, path: str, check: str | None = "words"):
        import sentencepiece

        if check not in ("words", "texts", None):
            raise ValueError(f"no check {check!r}")
        self.library, self.check = sentencepiece.SentencePieceProcessor(model_file=path), check
        names, kinds = [], []
        trainer: dict = {}
        for number, value in fields(self.library.serialized_model_proto()):
            if number == 1:
                piece = dict(fields(value))
                names.append(piece[1].decode())
                kinds.append(piece.get(3, NORMAL))
            elif number == 2:
                trainer = dict(fields(value))
        if trainer.get(3) != MERGES or {USER_DEFINED, UNUSED} & set(kinds) or kinds.count(BYTE) != 256:
            raise ValueError("the model must be of the merge type, with byte pieces and neither unused nor user-defined ones")
        self.ids = {n: i for i, (n, k) in enumerate(zip(names, kinds, strict=True)) if k == NORMAL}
        if any(SPACE in n.lstrip(SPACE) for n in self.ids):
            raise ValueError("a piece holds a space behind another sign")
        self.scores = {n: -self.library.get_score(i) for n, i in self.ids.items()}
        byte_ids = [i for i, k in enumerate(kinds) if k == BYTE]
        self.byte = {int(names[i][3:5], 16): i for i in byte_ids}
        self.end = self.library.eos_id()
        spelled = [b"" if k == CONTROL else bytes([int(n[3:5], 16)]) if k == BYTE else n.replace(SPACE, " ").encode() for n, k in zip(names, kinds, strict=True)]
        self.lengths = np.fromiter(map(len, spelled), np.int64, len(spelled))
        self.offsets = np.cumsum(self.lengths) - self.lengths
        self.letters = np.frombuffer(b"".join(spelled), np.uint8)
        self.decimal = [str(i) for i in range(len(names))]
        self.words = pretoken.Words(self.encode_parts)

    def merge(self, part: str) -> list[int]:
        """The ids of one part."""
        symbols: list[str] = list(part)
        n = len(symbols)
        before, behind = list(range(-1, n - 1)), [*range(1, n), -1]
        scores = self.scores
        agenda = [(scores[x], i, i + 1, x) for i in range(n - 1) if (x := symbols[i] + symbols[i + 1]) in scores]
        heapify(agenda)
        while agenda:
            _, i, j, joined = heappop(agenda)
            # a symbol merged into its left neighbour is empty, one that has grown makes the sum longer
            if not symbols[i] or not symbols[j] or len(symbols[i]) + len(symbols[j]) != len(joined):
                continue
            symbols[i], symbols[j] = joined, ""
            k = behind[i] = behind[j]
            if k >= 0:
                before[k] = i
                if (x := joined + symbols[k]) in scores:
                    heappush(agenda, (scores[x], i, k, x))
            if (h := before[i]) >= 0 and (x := symbols[h] + joined) in scores:
                heappush(agenda, (scores[x], h, i, x))
        out: list[int] = []
        for s in symbols:
            if s:
                out += [i] if (i := self.ids.get(s)) is not None else [self.byte[b] for b in s.encode()]
        return out

    def encode_parts(self, parts: list[str]) -> list[list[int]]:
        out = [self.merge(p) for p in parts]
        if self.check == "words":
            # each part begins with a space sign, which the library puts before its input
            self._same(out, self.library.encode([p[1:] if len(p) > 1 else p for p in parts], num_threads=1), parts)
        return out

    def _same(self, own: list[list[int]], other: list[list[int]], texts: list[str]) -> None:
        for a, b, t in zip(own, other, texts, strict=True):
            if a != b and t != SPACE:  # a lone space sign is one piece; the library would see two of them
                raise ValueError(f"agenda and library differ on {t[:100]!r}: {a[:20]} and {b[:20]}")

    @staticmethod
    def bounds(codes: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Starts and ends of parts, covering all: a part begins with a row or a run of space signs."""
        space = codes == ord(SPACE)
        start = space.copy()
        start[1:] &= ~space[:-1]
        start[rows[:-1][np.diff(rows) > 0]] = True
        starts = np.flatnonzero(start)
        return starts, np.append(starts[1:], len(codes))

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts in one array, an end id behind each text's, and the number of each text's ids."""
        ids, size = pretoken.encode_rows(texts, self.words, self.bounds, {}, self.library.normalize)
        ends = np.cumsum(size)
        if self.check == "texts":
            self._same([x.tolist() for x in np.split(ids, ends[:-1])] if texts else [], self.library.encode(texts, num_threads=1), texts)
        return np.insert(ids, ends, self.end), size + 1

    def decode(self, ids: np.ndarray, size: np.ndarray) -> list[bytes]:
        """The text of each row of ids, without the space that leads it."""
        width = self.lengths[ids]
        ends = np.cumsum(width)
        letters = self.letters[np.repeat(self.offsets[ids] - (ends - width), width) + np.arange(int(ends[-1]) if len(ends) else 0)].tobytes()
        upto = np.concatenate([[0], ends])[np.concatenate([[0], np.cumsum(size)])].tolist()
        texts = (letters[s:e] for s, e in zip(upto, upto[1:], strict=False))
        # whole texts never give bytes that are no UTF-8; a library decodes such to U+FFFD
        return [(t[1:] if t.startswith(b" ") else t).decode("utf-8", "replace").encode() for t in texts]


@lru_cache(maxsize=2)
def model(path: str, check: str | None) -> PieceBpe:
    """Kept by each Python worker."""
    return PieceBpe(path, check)


def encode(docs: DataFrame, path: str, id_col: str = "doc_id", text: str = "text", check: str | None = "words", with_ids: bool = False) -> DataFrame:
    """id, n_tokens, ids_sha256 (of decimal ids joined by spaces), decoded_sha256 (and ids, decoded) of every whole text."""
    rows = docs.select(id_col, common.as_bytes(text).alias("_text"))

    def run(batches):
        pieces = model(path, check)
        for b in batches:
            first = 0
            for part in pretoken.in_slices([x.decode("utf-8", "replace") for x in b.column(1).to_pylist()], 1_000_000):
                ids, size = pieces.encode(part)
                decoded = pieces.decode(ids, size)
                to = np.cumsum(size)
                decimal, sides = list(map(pieces.decimal.__getitem__, ids.tolist())), list(zip((to - size).tolist(), to.tolist(), strict=True))
                columns = [b.column(0).slice(first, len(part)), pa.array(size, pa.int64()), pa.array([hashlib.sha256(" ".join(decimal[s:e]).encode()).hexdigest() for s, e in sides]), pa.array([hashlib.sha256(t).hexdigest() for t in decoded])]
                if with_ids:
                    columns += [pa.ListArray.from_arrays(pa.array(np.concatenate([[0], to]).astype(np.int32)), pa.array(ids.astype(np.int32))), pa.array([t.decode() for t in decoded])]
                yield pa.RecordBatch.from_arrays(columns, names=[id_col, "n_tokens", "ids_sha256", "decoded_sha256", *(["ids", "decoded"] if with_ids else [])])
                first += len(part)

    kind = rows.schema[id_col].dataType.simpleString()
    return rows.mapInArrow(run, f"`{id_col}` {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string" + (", ids array<int>, decoded string" if with_ids else ""))
