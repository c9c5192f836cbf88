"""Personal data with offset-preserving deobfuscation.

The plain patterns run on the text itself (the base). Beside them a chain of transducers rewrites disguises - look-alike
and invisible characters, spelled digits, at/dot words - while each character of the rewritten text keeps the span of
source characters that it came from. The same patterns run on the rewritten text; what they find on rewritten
characters is mapped back to the source and added unless a base span of its kind holds it. Base spans always stay.
"""

from __future__ import annotations

import hashlib
import re
import unicodedata
from bisect import bisect_right
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import free_names, give_back, with_result

KINDS = ("email", "ip", "card", "phone")
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
#: A match always ends a run of digits, so none starts within one: the lookbehind only saves time.
IP = re.compile(r"(?<![0-9])[0-9]+(?:\.[0-9]+)(?:\.[0-9]+)(?:\.[0-9]+)")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
NOT_DIGIT = re.compile("[^0-9]")

Span = tuple[int, int, int]  # start, index of the kind, end


def luhn(digits: str) -> bool:
    total = sum(int(c) for c in digits[-1::-2]) + sum(sum(divmod(2 * int(c), 10)) for c in digits[-2::-2])
    return total % 10 == 0


def find(text: str) -> list[Span]:
    """The base spans, sorted: leftmost and non-overlapping in each kind, failing matches dropped without retries."""
    out: list[Span] = []
    at, free = text.find("@"), 0
    while at >= 0:
        start = at
        while start > free and text[start - 1] in LOCAL:
            start -= 1
        m = DOMAIN.match(text, at + 1) if start < at else None
        if m:
            out.append((start, 0, free := m.end()))
        at = text.find("@", max(at + 1, free))
    for m in IP.finditer(text):
        if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0")[:3] or 0) <= 255 for p in m[0].split(".")):
            out.append((m.start(), 1, m.end()))
    for m in CARD.finditer(text):
        if m.end() - m.start() >= 12 and 12 <= len(d := NOT_DIGIT.sub("", m[0])) <= 19 and luhn(d):
            out.append((m.start(), 2, m.end()))
    if "+" in text:
        for m in PHONE.finditer(text):
            if 9 <= len(NOT_DIGIT.sub("", m[0])) <= 15:
                out.append((m.start(), 3, m.end()))
    return sorted(out)


class Mapped:
    """A rewritten text; start[i], end[i]: the source characters of its character i; new[i]: whether it was rewritten."""

    def __init__(self, text: str):
        self.text, self.start, self.end, self.new = text, list(range(len(text))), list(range(1, len(text) + 1)), bytearray(len(text))

    def rewrite(self, pattern: re.Pattern, to) -> Mapped:
        """Each match becomes to(match); None leaves it as it is."""
        text, start, end, new, at = [], [], [], bytearray(), 0
        for m in pattern.finditer(self.text):
            if (r := to(m)) is None:
                continue
            s, e = m.span()
            text += (self.text[at:s], r)
            start += self.start[at:s] + [self.start[s]] * len(r)
            end += self.end[at:s] + [self.end[e - 1]] * len(r)
            new += self.new[at:s] + b"\1" * len(r)
            at = e
        if at:
            self.text = "".join([*text, self.text[at:]])
            self.start, self.end, self.new = start + self.start[at:], end + self.end[at:], new + self.new[at:]
        return self


#: Cyrillic, Greek and other letters that look like Latin ones, pairwise.
LOOKALIKES = dict(zip("АВЕКМНОРСТУХаеорсухкмтіјѕԁһԛԝΑΒΕΖΗΙΚΜΝΟΡΤΥΧοανικρτυεχıℓ", "ABEKMHOPCTYXaeopcyxkmtijsdhqwABEZHIKMNOPTYXoavikptuexil", strict=True))
#: Those, invisible characters, full-width forms, dashes, dots, raised, lowered and circled digits, styled letters, other digits.
DISGUISED = re.compile("[" + "".join(LOOKALIKES) + "­​-‏⁠﻿！-～‐-―․。﹒﹫²³¹⁰-₉①-⑨\U0001d400-\U0001d7ff]|(?![0-9])\\d")
#: Spelled digits of the languages at hand; each row has the words for 0 to 9.
SPELLED = """zero one two three four five six seven eight nine
null eins zwei drei vier fünf sechs sieben acht neun
zéro un deux trois quatre cinq six sept huit neuf
cero uno dos tres cuatro cinco seis siete ocho nueve"""
DIGIT = {w: str(i) for row in SPELLED.split("\n") for i, w in enumerate(row.split())}
ONE = "(?:" + "|".join(sorted(DIGIT, key=len, reverse=True)) + ")"
#: At least three spelled digits, parted by blanks or one mark.
DIGITS = re.compile(rf"(?<!\w){ONE}(?:[\s,/-]{{1,3}}{ONE}){{2,}}(?!\w)|(?<=[0-9.@+])[\s]?{ONE}(?:[\s,/-]{{1,3}}{ONE}){{1,}}(?!\w)", re.I)
WORD = re.compile(ONE, re.I)
#: Letters that stand for digits between digits.
LETTER_DIGIT = re.compile(r"(?<=[0-9.])[OoIl|]{1,4}(?=[0-9.])|(?<![A-Za-z0-9])[OoIl](?=[0-9OoIl]{0,3}[0-9][0-9.\x20-])|(?<=[0-9])[OoIl](?![A-Za-z0-9@])")
AS_DIGITS = str.maketrans("OoIl|", "00111")
AT, DOT = "(?:at|arroba|ät|arobase)", "(?:dot|punkt|punto|point)"
BRACKET_AT = re.compile(rf"\s{{0,3}}[\[({{<]\s?(?:{AT}|@)\s?[\])}}>]\s{{0,3}}", re.I)
BRACKET_DOT = re.compile(rf"\s{{0,3}}[\[({{<]\s?(?:{DOT}|\.)\s?[\])}}>]\s{{0,3}}", re.I)
DIGIT_DOT = re.compile(rf"(?<=[0-9])\s{{1,3}}{DOT}\s{{1,3}}(?=[0-9])", re.I)
PLUS = re.compile(r"(?<!\w)plus\s{1,3}(?=[0-9])", re.I)
NAME = "[A-Za-z0-9_%+-]"
def _worded(dot: str, at: str, top: str) -> str:
    return rf"(?<![A-Za-z0-9._%+-])(?:{NAME}+(?:\s{{1,3}}{dot}\s{{1,3}}|\.))*{NAME}+{at}[A-Za-z0-9-]+(?:(?:\s{{1,3}}{dot}\s{{1,3}}|\.)[A-Za-z0-9-]+)*\s{{1,3}}{dot}\s{{1,3}}{top}(?![A-Za-z0-9])"


WORDED = re.compile(_worded("(?:dot|punkt|punto)", rf"(?:\s{{1,3}}{AT}\s{{1,3}}|@)", "[A-Za-z]{2,24}"), re.I)
#: "looked at this point in" is English: between `at` and `point` only these ends make an address.
TOP = "(?:com|net|org|info|biz|edu|gov|eu|fr|ch|ca|lu|io)"
WORDED_POINT = re.compile(_worded("point", r"(?:\s{1,3}(?:arroba|ät|arobase)\s{1,3}|@)", "[A-Za-z]{2,24}") + "|" + _worded("point", r"\s{1,3}at\s{1,3}", TOP), re.I)
WORDS = re.compile(rf"\s{{1,3}}({DOT}|{AT})\s{{1,3}}", re.I)
IS_DOT = re.compile(DOT, re.I)
SPACED = re.compile(r"(?<=[A-Za-z0-9])\x20?@\x20(?=[A-Za-z0-9-]{1,63}\.[A-Za-z]{2})|(?<=[A-Za-z0-9])\x20@(?=[A-Za-z0-9-]{1,63}\.[A-Za-z]{2})")
#: What a match of each transducer contains, in their order: without any of these, none of them changes the text.
TRIGGERS = [
    re.compile(t, re.I)
    for t in (
        rf"(?<![^\W0-9]){ONE}[\s,/-]{{1,3}}{ONE}",  # DIGITS
        r"(?-i:[0-9.][OoIl|]|[OoIl][0-9])",  # LETTER_DIGIT
        rf"\s{DOT}\s",  # DIGIT_DOT, WORDED, WORDED_POINT
        r"plus\s{1,3}[0-9]",  # PLUS
        rf"[\[({{<]\s?(?:{AT}|{DOT}|@|\.)\s?[\])}}>]",  # BRACKET_AT, BRACKET_DOT
        r"\x20@|@\x20",  # SPACED
    )
]


def hinted(text: str) -> bool:
    return any(t.search(text) for t in TRIGGERS)


def _plain(m: re.Match) -> str:
    c = m[0]
    if c in LOOKALIKES:
        return LOOKALIKES[c]
    if "\u2010" <= c <= "\u2015":
        return "-"
    if c == "\u3002":
        return "."
    folded = unicodedata.normalize("NFKC", c)
    if folded.isascii():
        return folded
    return str(unicodedata.digit(c)) if unicodedata.digit(c, None) is not None else ""


def _joined(m: re.Match) -> str:
    return WORDS.sub(lambda x: "." if IS_DOT.fullmatch(x[1]) else "@", m[0])


def deobfuscate(text: str) -> Mapped:
    m = Mapped(text)
    if not text.isascii():
        m.rewrite(DISGUISED, _plain)
    if hinted(m.text):
        m.rewrite(DIGITS, lambda x: "".join(DIGIT[w.lower()] for w in WORD.findall(x[0])))
        m.rewrite(LETTER_DIGIT, lambda x: x[0].translate(AS_DIGITS))
        m.rewrite(DIGIT_DOT, lambda _: ".").rewrite(PLUS, lambda _: "+")
        m.rewrite(BRACKET_AT, lambda _: "@").rewrite(BRACKET_DOT, lambda _: ".")
        m.rewrite(WORDED, _joined).rewrite(WORDED_POINT, _joined).rewrite(SPACED, lambda _: "@")
    return m


def detect(text: str | None) -> tuple[list[Span], list[Span]]:
    """Base spans, and base and added spans together; both sorted, in code points of text. Null counts as empty."""
    text = text or ""
    base = find(text)
    if not (hinted(text) or (not text.isascii() and DISGUISED.search(text))):
        return base, base
    m, more = deobfuscate(text), []
    if 1 not in m.new and len(m.text) == len(text):
        return base, base
    starts, ends = ({k: [x[i] for x in base if x[1] == k] for k in range(len(KINDS))} for i in (0, 2))
    for s, k, e in find(m.text):
        a, b = m.start[s], m.end[e - 1]
        if 1 in m.new[s:e] or b - a != e - s:
            i = bisect_right(starts[k], a) - 1  # the only base span that could hold it
            if i < 0 or ends[k][i] < b:
                more.append((a, k, b))
    return base, sorted({*base, *more})


def written(spans: list[Span]) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in spans)


def redact(text: str | None) -> str | None:
    """text with each detected span, overlapping ones merged, replaced by its kind in brackets."""
    _, spans = detect(text)
    if not spans:
        return text
    out, at, i = [], 0, 0
    while i < len(spans):
        s, k, e = spans[i]
        while i + 1 < len(spans) and spans[i + 1][0] < e:
            i += 1
            e = max(e, spans[i][2])
        out += (text[at:s], f"[{KINDS[k].upper()}]")
        at, i = e, i + 1
    return "".join([*out, text[at:]])


FOUND = "n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, n_added long"


def with_pii(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """docs and n_email, n_ip, n_card, n_phone (base counts), base_sha256, spans and n_added (spans beyond the base).

    Null or empty text: no spans, and the digest of the empty string. Repeated rows each get the same result; texts
    of any length are read whole; input columns named like a result give way to it.
    """

    @F.pandas_udf(FOUND)
    def found(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in batches:
            rows = []
            for x in texts:
                base, spans = detect(x)
                kinds = [k for _, k, _ in base]
                rows.append((*(kinds.count(k) for k in range(len(KINDS))), hashlib.sha256(written(base).encode()).hexdigest(), written(spans), len(spans) - len(base)))
            yield pd.DataFrame(rows, columns=[c.split()[0] for c in FOUND.split(", ")])

    names = [c.split()[0] for c in FOUND.split(", ")]
    (own,) = free_names(docs, "found")
    held = docs.withColumn(own, found(F.col(text_col)))
    return with_result(held, **{c: F.col(f"{own}.{c}") for c in names}).drop(own)


def redacted(docs: DataFrame, text_col: str = "text", length_col: str | None = "n_chars") -> DataFrame:
    """docs with the personal data in text_col replaced and length_col, where there is one, brought up to date.

    A null text stays null, and its length as it was; repeated rows each get the same result; texts of any length are read
    whole; all other columns stay, in their order. No rows: no rows.
    """

    @F.pandas_udf("string")
    def clean(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series([redact(x) for x in texts], dtype=object)
        give_back()

    out = docs.withColumn(text_col, clean(F.col(text_col)))
    if length_col in docs.columns:
        out = out.withColumn(length_col, F.coalesce(F.length(text_col).cast(docs.schema[length_col].dataType), F.col(length_col)))
    return out.select(*docs.columns)
