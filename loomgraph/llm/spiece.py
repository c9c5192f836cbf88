"""SentencePiece encoding and decoding by a shared-prefix Viterbi.

The distinct marked words of a batch are sorted into a trie and walked depth first: the forward cells of a prefix are
kept on a stack and reused by every word that shares it. For unigram models a cell holds the best score of a
segmentation of its prefix. For BPE models segmentations are further restricted to those that merging would give: two
neighbouring pieces must be compatible, that is, merging their concatenation must give them back. As merging decides a
prefix's last piece, exactly one piece can end at each cell, and the best path is the library's own encoding.
"""

from __future__ import annotations

import struct
import zlib
from array import array
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import free_names, with_result

MARK = "▁"
#: Words and pairs that a worker remembers before it starts anew.
KEPT = 500_000
NORMAL, UNKNOWN, BYTE = 1, 2, 6


def _fields(data: bytes) -> Iterator[tuple[int, object]]:
    """(number, value) of a protobuf message's fields: ints, floats' four bytes, or bytes."""
    at = 0

    def varint() -> int:
        nonlocal at
        shift = value = 0
        while True:
            b = data[at]
            at += 1
            value |= (b & 127) << shift
            shift += 7
            if b < 128:
                return value

    while at < len(data):
        key = varint()
        kind = key & 7
        if kind == 0:
            yield key >> 3, varint()
        else:
            size = {1: 8, 5: 4}.get(kind) or varint()
            yield key >> 3, data[at : at + size]
            at += size


@dataclass
class Model:
    pieces: dict[str, int]  # those that segmentations are made of
    scores: dict[str, float]
    text: list[str]  # by id
    byte_of: dict[int, int]  # id -> byte
    bytes_: list[int]  # byte -> id; empty without byte fallback
    unknown: int
    merging: bool  # BPE
    dummy_prefix: bool
    longest: int
    pairs: dict[tuple[str, str], bool] = field(default_factory=dict)
    words: dict[str, bytes] = field(default_factory=dict)
    raw: list[bytes] = field(default_factory=list)  # what each id decodes to
    ends: dict[str, tuple | None] = field(default_factory=dict)  # one entry for each piece and character met

    @classmethod
    def load(cls, path: str) -> Model:
        """Reads a model with the identity normaliser that keeps white space as it is."""
        with open(path, "rb") as f:
            top = list(_fields(f.read()))
        trainer, normal = (dict(_fields(next((v for k, v in top if k == n), b""))) for n in (2, 3))
        if normal.get(2) or normal.get(1, b"identity") != b"identity" or normal.get(4, 1):
            raise ValueError("only models without character normalisation that keep extra white space are supported")
        text, scores, kinds = [], [], []
        for p in (dict(_fields(v)) for k, v in top if k == 1):
            text.append(p.get(1, b"").decode())
            scores.append(struct.unpack("<f", p[2])[0] if 2 in p else 0.0)
            kinds.append(p.get(3, NORMAL))
        if 4 in kinds:
            raise ValueError("models with symbols of the user's own are not supported")
        own = {t: i for i, (t, k) in enumerate(zip(text, kinds, strict=True)) if k == NORMAL}
        if any(MARK in t.lstrip(MARK) for t in own):
            raise ValueError("models with pieces that reach over white space are not supported")
        byte_of = {i: int(text[i][3:5], 16) for i, k in enumerate(kinds) if k == BYTE}
        back = {b: i for i, b in byte_of.items()}
        return cls(own, {t: scores[i] for t, i in own.items()}, text, byte_of, [back[b] for b in range(256)] if len(back) == 256 else [], kinds.index(UNKNOWN), trainer.get(3, 1) == 2, bool(normal.get(3, 1)), max(map(len, own)))

    def spines(self, piece: str) -> tuple[list[tuple[str, float]], list[tuple[str, float]]] | None:
        """How merging makes the piece, seen from its two ends: for the first and for the last symbol each symbol that stands
        there and the score of the merge that takes it (-inf for the piece itself). None if merging does not make it.

        A merge waits for those before it, so its score counts as the least so far.
        """
        if piece in self.ends:
            return self.ends[piece]
        parts, first, last, least = list(piece), [], [], float("inf")
        while len(parts) > 1:
            best = max(((self.scores[a + b], -i) for i, (a, b) in enumerate(zip(parts, parts[1:])) if a + b in self.scores), default=None)
            if best is None:
                break
            i, least = -best[1], min(least, best[0])
            if i == 0:
                first.append((parts[0], least))
            if i + 2 == len(parts):
                last.append((parts[-1], least))
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
        never = float("-inf")
        self.ends[piece] = ([*first, (piece, never)], [*last, (piece, never)]) if len(parts) == 1 else None
        return self.ends[piece]

    def compatible(self, a: str, b: str) -> bool:
        """Whether merging a + b gives a and b; with an empty a, whether merging b gives b.

        Follows the symbols on either side of the seam: merging across it wins if its score beats that of the merges
        that would take either symbol away (of equal merges the left one comes first).
        """
        key = (a, b)
        if (known := self.pairs.get(key)) is None:
            if len(self.pairs) >= KEPT:
                self.pairs.clear()
            known = self.pairs[key] = self._apart(a, b)
        return known

    def _apart(self, a: str, b: str) -> bool:
        right = self.spines(b)
        if right is None or not a:
            return right is not None
        left = self.spines(a)[1]
        i = j = 0
        while True:
            (x, goes_x), (y, goes_y) = left[i], right[0][j]
            across = self.scores.get(x + y)
            if across is not None and across > goes_x and across >= goes_y:
                return False
            if goes_x == goes_y == float("-inf"):
                return True
            if goes_x >= goes_y:
                i += 1
            else:
                j += 1

    def ids_of(self, piece: str) -> list[int]:
        if piece in self.pieces:
            return [self.pieces[piece]]
        return [self.bytes_[b] for b in piece.encode("utf-8", "surrogatepass")] if self.bytes_ else [self.unknown]

    def learn(self, words: dict[str, str]) -> None:
        """Walks the trie of the sorted words depth first; the stack holds the cells of the current path.

        words: marked word -> the part it is remembered by. A cell is the best score of its prefix, where the prefix's last piece starts, and that piece.
        """
        scores, pairs, longest, merging = self.scores, self.pairs, self.longest, self.merging
        cells: list[tuple[float, int, str]] = [(0.0, 0, "")]
        before = ""
        for word in sorted(words):
            shared = 0
            for a, b in zip(before, word, strict=False):
                if a != b:
                    break
                shared += 1
            del cells[shared + 1 :]
            for at in range(shared + 1, len(word) + 1):
                best = None
                for start in range(at - longest if at > longest else 0, at):
                    piece = word[start:at]
                    if piece in scores:
                        own = scores[piece]
                    elif start == at - 1:
                        own = -1e4
                    else:
                        continue
                    score, _, last = cells[start]
                    if merging:
                        known = pairs.get((last, piece))
                        if known is None:
                            known = self.compatible(last, piece)
                        if known:
                            best = (score + own, start, piece)
                            break
                    elif best is None or score + own > best[0]:
                        best = (score + own, start, piece)
                cells.append(best)
            ids: list[list[int]] = []
            at = len(word)
            while at:
                _, start, piece = cells[at]
                ids.append(self.ids_of(piece))
                at = start
            self.words[words[word]] = array("i", [i for part in reversed(ids) for i in part]).tobytes()
            before = word

    def parts(self, text: str) -> list[str]:
        """What the marked words of a text are looked up by: a word that follows one blank by itself, any other piece of
        the text with its marks (a run of blanks goes with the word after it, or stands alone at the end)."""
        if not text:
            return []
        if MARK in text:
            text = text.replace(MARK, " ")
        out = text.split(" ")
        if not self.dummy_prefix:  # the first word has no mark: "" + word
            out[0] = "\0" + out[0] if out[0] else ""
        if "" not in out:
            return out
        held, pending = [], 0
        for i, part in enumerate(out):
            pending += i > 0 or self.dummy_prefix
            if part:
                held.append(part if pending == 1 or (not i and not self.dummy_prefix) else MARK * pending + part)
                pending = 0
        return [*held, MARK * pending] if pending else held

    def marked(self, part: str) -> str:
        """The marked word of a part."""
        return part[1:] if part[0] == "\0" and not self.dummy_prefix else part if part[0] == MARK else MARK + part

    def encode(self, texts: list[str | None]) -> list[np.ndarray]:
        """Ids of each text; null counts as empty."""
        split = [self.parts(x or "") for x in texts]
        if len(self.words) >= KEPT:
            self.words.clear()
        new = {self.marked(x): x for x in set().union(*split).difference(self.words)}
        self.learn(new)
        return [np.frombuffer(b"".join(map(self.words.__getitem__, s)), np.int32) for s in split]

    def decode(self, ids) -> str:
        """The text of ids; control ids vanish, unknown ones give the replacement mark of the library."""
        if not self.raw:
            own = {self.unknown: " ⁇ ".encode()} | {i: bytes([b]) for i, b in self.byte_of.items()}
            self.raw = [own[i] if i in own else t.replace(MARK, " ").encode() if t in self.pieces else b"" for i, t in enumerate(self.text)]
        text = b"".join(map(self.raw.__getitem__, ids)).decode("utf-8", "replace")
        return text[1:] if self.dummy_prefix and text.startswith(" ") else text

    def __getstate__(self) -> dict:
        return self.__dict__ | {"pairs": {}, "words": {}, "ends": {}, "raw": []}


_LOADED: dict[str, Model] = {}


def model(path: str) -> Model:
    """The model at path, loaded once for each worker."""
    if path not in _LOADED:
        _LOADED[path] = Model.load(path)
    return _LOADED[path]


def encoded(docs: DataFrame, path: str, text_col: str = "text", ids_col: str = "ids") -> DataFrame:
    """docs with the ids of text_col as array<int>; null and empty texts: no ids. path: there on every executor."""

    @F.pandas_udf("array<int>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series(_in_parts(model(path), list(texts)), dtype=object)

    return with_result(docs, **{ids_col: run(F.col(text_col))})


def _in_parts(m: Model, texts: list[str | None], most: int = 12_000_000) -> list[np.ndarray]:
    """Texts are encoded together up to so many characters: the more words a trie holds, the more of them share a prefix."""
    out, held, n = [], [], 0
    for x in texts:
        held.append(x)
        n += len(x or "")
        if n > most:
            out += m.encode(held)
            held, n = [], 0
    return out + m.encode(held)


def decoded(rows: DataFrame, path: str, ids_col: str = "ids", text_col: str = "text") -> DataFrame:
    """rows with the text of ids_col; null ids: null, no ids: empty. A column of the name text_col gives way, all others stay."""

    @F.pandas_udf("string")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for ids in batches:
            yield pd.Series([None if x is None else model(path).decode(x) for x in ids], dtype=object)

    return with_result(rows, **{text_col: run(F.col(ids_col))})


def digests(docs: DataFrame, path: str, text_col: str = "text") -> DataFrame:
    """docs with n_ids, ids_crc32 (unsigned, of little-endian unsigned 32-bit ids) and round_trip (decoding gives the text).

    Null and empty texts have no ids and come back as empty. Texts of any length are encoded whole; repeated rows are
    encoded alike. Input columns of the three names give way, all others stay. No rows: no rows.
    """

    @F.pandas_udf("n_ids long, ids_crc32 long, round_trip boolean")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in batches:
            m = model(path)
            rows = [(len(ids), zlib.crc32(ids.astype("<u4").tobytes()), m.decode(ids.tolist()) == (text or "")) for text, ids in zip(texts, _in_parts(m, list(texts)), strict=True)]
            yield pd.DataFrame(rows, columns=["n_ids", "ids_crc32", "round_trip"])

    (found,) = free_names(docs, "found")
    held = docs.withColumn(found, run(F.col(text_col)))
    return with_result(held, **{c: F.col(f"`{found}`.{c}") for c in ("n_ids", "ids_crc32", "round_trip")}).drop(found)
