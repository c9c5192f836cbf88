"""Fill-in-middle transformation on ropes.

A text is a rope: a balanced tree whose leaves hold pieces of it, each node caching how many units (words with the
whitespace before them, and trailing whitespace) and how many code points lie below. The tree is split at two unit ranks,
the three subtrees are joined again in another order with sentinels between them, and nothing but the two leaves that are
cut is copied. The inverse splits the rope of the output at the code points where the sentinels stand.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import free_names, with_result

#: The sentinels before prefix, suffix and middle.
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
#: Units of a leaf, and the seed of the draws.
LEAF, SEED = 64, 42
_SPACE, _WORD = r"[\x20\x09-\x0D]", r"[^\x20\x09-\x0D]"
_UNIT = rf"{_SPACE}*+{_WORD}++"
_LEAF, _ONE = re.compile(rf"(?:{_UNIT}){{1,{LEAF}}}+"), re.compile(_UNIT)


@dataclass(frozen=True, slots=True)
class Rope:
    """A leaf (text) or two subtrees; units, chars: what lies below; height: 0 for a leaf."""

    units: int
    chars: int
    height: int = 0
    text: str = ""
    left: Rope | None = None
    right: Rope | None = None


EMPTY = Rope(0, 0)


def leaf(text: str, units: int) -> Rope:
    return Rope(units, len(text), 0, text) if text else EMPTY


def _node(a: Rope, b: Rope) -> Rope:
    return Rope(a.units + b.units, a.chars + b.chars, 1 + max(a.height, b.height), "", a, b)


def _balanced(a: Rope, b: Rope) -> Rope:
    """One node above a and b, whose heights differ by two at most, turned so that its sides differ by one."""
    if a.height > b.height + 1:
        if a.left.height >= a.right.height:
            return _node(a.left, _node(a.right, b))
        return _node(_node(a.left, a.right.left), _node(a.right.right, b))
    if b.height > a.height + 1:
        if b.right.height >= b.left.height:
            return _node(_node(a, b.left), b.right)
        return _node(_node(a, b.left.left), _node(b.left.right, b.right))
    return _node(a, b)


def join(a: Rope, b: Rope) -> Rope:
    """a, then b: the lower tree is hung in along the edge of the higher one, in time of the difference of heights."""
    if not a.chars:
        return b
    if not b.chars:
        return a
    if a.height > b.height + 1:
        return _balanced(a.left, join(a.right, b))
    if b.height > a.height + 1:
        return _balanced(join(a, b.left), b.right)
    return _node(a, b)


def split(rope: Rope, rank: int, by: str = "units") -> tuple[Rope, Rope]:
    """The first `rank` units (or chars) and the rest; only the leaf that holds the place is cut."""
    if rank <= 0:
        return EMPTY, rope
    if rank >= getattr(rope, by):
        return rope, EMPTY
    if rope.left is None:
        if by == "chars":  # a leaf cut inside a unit has no unit counts of its own: it counts as what it was cut from
            at, units = rank, min(rope.units, rank)
        else:
            at, units = re.compile(rf"(?:{_UNIT}){{{rank}}}+").match(rope.text).end(), rank
        return leaf(rope.text[:at], units), leaf(rope.text[at:], rope.units - units)
    held = getattr(rope.left, by)
    if rank < held:
        a, b = split(rope.left, rank, by)
        return a, join(b, rope.right)
    a, b = split(rope.right, rank - held, by)
    return join(rope.left, a), b


def leaves(rope: Rope) -> Iterator[str]:
    waiting = [rope]
    while waiting:
        r = waiting.pop()
        if r.left is None:
            yield r.text
        else:
            waiting += [r.right, r.left]


def written(rope: Rope) -> str:
    return "".join(leaves(rope))


def build(text: str) -> Rope:
    """The rope of a text: leaves of LEAF units, trailing whitespace as one unit, in a balanced tree."""
    parts, at = [], 0
    while m := _LEAF.match(text, at):
        parts.append(Rope(LEAF, m.end() - at, 0, m[0]))
        at = m.end()
    if parts:  # only the last leaf can hold fewer
        last = parts[-1].text
        parts[-1] = leaf(last, sum(1 for _ in _ONE.finditer(last)))
    if at < len(text):
        parts.append(leaf(text[at:], 1))

    def halved(lo: int, hi: int) -> Rope:
        return parts[lo] if hi - lo == 1 else _node(halved(lo, (lo + hi) // 2), halved((lo + hi) // 2, hi))

    return halved(0, len(parts)) if parts else EMPTY


def _sentinel(text: str) -> Rope:
    return leaf(text, 1)


def rearranged(rope: Rope, first: int, second: int, form: str) -> tuple[Rope, int, int]:
    """The rope cut at two unit ranks and joined as `form` (psm or spm) with sentinels; code points of prefix and middle."""
    head, suffix = split(rope, second)
    prefix, middle = split(head, first)
    p, s, m = (_sentinel(x) for x in (PREFIX, SUFFIX, MIDDLE))
    order = [p, prefix, s, suffix, m, middle] if form == "psm" else [s, suffix, p, prefix, m, middle]
    out = EMPTY
    for part in order:
        out = join(out, part)
    return out, prefix.chars, middle.chars


def inverted(output: str, form: str) -> str:
    """The text that rearranged() made the output from; the form plain leaves it as it is."""
    if form not in ("psm", "spm"):
        return output
    rope = build(output)
    first, second = (PREFIX, SUFFIX) if form == "psm" else (SUFFIX, PREFIX)
    at = output.index(second, len(first))
    end = output.index(MIDDLE, at)
    head, middle = split(rope, end, "chars")
    a, b = split(head, at, "chars")
    a, b, middle = (split(x, len(mark), "chars")[1] for x, mark in ((a, first), (b, second), (middle, MIDDLE)))
    prefix, suffix = (a, b) if form == "psm" else (b, a)
    return written(join(join(prefix, middle), suffix))


def draws(key: object, seed: int = SEED) -> tuple[int, int, int, int]:
    """Four unsigned numbers from the digest of seed and key; a null key is written as nothing."""
    digest = hashlib.sha256(f"{seed}:{'' if key is None else key}".encode()).hexdigest()
    return tuple(int(digest[i : i + 8], 16) for i in (0, 8, 16, 24))


def transform(text: str | None, key: object, seed: int = SEED, rate: int = 50, spm: int = 80) -> tuple[int, str, int | None, int | None, str]:
    """n units, form, code points of prefix and middle (None: plain), output. rate, spm: per cent transformed, and of those in suffix order."""
    text = text or ""
    rope = build(text)
    h1, h2, h3, h4 = draws(key, seed)
    if not text or h3 % 100 >= rate or PREFIX in text or SUFFIX in text or MIDDLE in text:
        return rope.units, "plain", None, None, text
    form = "spm" if h4 % 100 < spm else "psm"
    a, b = h1 % (rope.units + 1), h2 % (rope.units + 1)
    out, prefix, middle = rearranged(rope, min(a, b), max(a, b), form)
    return rope.units, form, prefix, middle, written(out)


def transformed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", seed: int = SEED, rate: int = 50, spm: int = 80) -> DataFrame:
    """docs with n, form, prefix_chars, middle_chars and output last; input columns of those names give way.

    Whole texts of any length; a null or empty text has no unit, the form plain and an empty output. The cuts follow from
    the id alone, so repeated rows are transformed alike; a null id is drawn for as nothing. No rows: no rows.
    """

    @F.pandas_udf("n long, form string, prefix_chars long, middle_chars long, output string")
    def run(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        for keys, texts in batches:
            rows = [transform(x, k, seed, rate, spm) for k, x in zip(keys, texts, strict=True)]
            yield pd.DataFrame(rows, columns=["n", "form", "prefix_chars", "middle_chars", "output"]).astype({"n": "int64", "prefix_chars": "Int64", "middle_chars": "Int64"})

    (made,) = free_names(docs, "made")
    held = docs.withColumn(made, run(F.col(f"`{id_col}`").cast("string"), F.col(f"`{text_col}`")))
    names = ("n", "form", "prefix_chars", "middle_chars", "output")
    return with_result(held, **{c: F.col(f"`{made}`.{c}") for c in names}).drop(made)


def restored(output: Column, form: Column) -> Column:
    """The text of transformed(), from its output and form alone; a null output or form stays null."""

    @F.pandas_udf("string")
    def run(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for outputs, forms in batches:
            yield pd.Series([None if x is None or f is None else inverted(x, f) for x, f in zip(outputs, forms, strict=True)], dtype=object)

    return run(output, form)
