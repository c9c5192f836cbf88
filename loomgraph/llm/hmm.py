"""Hidden Markov language model: Baum-Welch counts aggregated across partitions, scaled forward recursion for exact likelihoods.

Word counts come from all training texts. Words above a count threshold that at most `frequent` words pass are symbols
of their own; every other word is a symbol of its shape, times its smoothed share within that shape. So the tables that
travel to the executors have a fixed size, while rare words' counts meet their occurrences in a join, one row for each
word and block of texts. The model's parameters start from a few rounds over a bounded sample; then each pass of
Baum-Welch covers all training texts.
"""

from __future__ import annotations

from array import array
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import repeat

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialise

#: The end of a text; no word is empty.
END = b""
SHAPES = 16
#: Distinct words that a task holds before it hands on their counts, and tokens in a block of texts.
HELD_WORDS, BLOCK_TOKENS, BATCH_TOKENS = 300_000, 2_000_000, 400_000
#: Tokens that a task gathers before it counts: long texts take as many steps one by one as side by side.
TRAIN_TOKENS = 6_000_000
FINE = 64  # bins of counts for each doubling


def words(text: str | None) -> list[bytes]:
    return text.encode("utf-8", "surrogatepass").lower().split() if text else []


def shape(w: bytes) -> int:
    """One of SHAPES classes: by length, by a mark at the end, by characters beyond ASCII."""
    return min(len(w) // 5, 3) * 4 + 2 * (not (97 <= w[-1] <= 122 or w[-1] > 127)) + (not w.isascii())


def shapes(found: list[bytes]) -> np.ndarray:
    """shape() of many words at once."""
    size = np.fromiter(map(len, found), np.int64, len(found))
    chars, ends = np.frombuffer(b"".join(found), np.uint8), np.cumsum(size)
    last = chars[ends - 1]
    letter = ((last >= 97) & (last <= 122)) | (last > 127)
    wide = np.maximum.reduceat(chars, ends - size) > 127
    return (np.minimum(size // 5, 3) * 4 + 2 * (~letter).astype(np.int64) + wide).astype(np.int32)


def word_counts(texts: DataFrame, text_col: str = "text") -> DataFrame:
    """(word, shape, c) over all rows of texts; the end of a text is the empty word."""

    def partial(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: Counter[bytes] = Counter()

        def shaped(keys: list[bytes]) -> np.ndarray:
            kinds = np.full(len(keys), -1, np.int32)
            own = [i for i, w in enumerate(keys) if w]
            if own:
                kinds[own] = shapes([keys[i] for i in own])
            return kinds

        def out() -> pd.DataFrame:
            keys = list(held)
            frame = pd.DataFrame({"word": keys, "shape": shaped(keys), "c": np.fromiter(held.values(), np.int64, len(held))})
            held.clear()
            return frame

        for pdf in batches:
            for text in pdf[text_col]:
                held.update(words(text))
                held[END] += 1
                if len(held) > HELD_WORDS:
                    yield out()
        if held:
            yield out()

    return texts.select(text_col).mapInPandas(partial, "word binary, shape int, c long").groupBy("word", "shape").agg(F.sum("c").alias("c"))


@dataclass
class Vocabulary:
    ids: dict[bytes, int]  # frequent words; then SHAPES symbols, then the end
    counts: np.ndarray  # of every symbol in the training texts
    tokens: int  # N, with ends
    types: int  # V, with the end if there is one
    shape_tokens: np.ndarray
    shape_types: np.ndarray

    @property
    def size(self) -> int:
        return len(self.ids) + SHAPES + 1

    def symbols(self, found: list[bytes]) -> np.ndarray:
        """Ids of the words and the end; -1 for the other words."""
        out = np.fromiter(map(self.ids.get, found, repeat(-1)), np.int32, len(found))
        return np.append(out, np.int32(self.size - 1))

    def shaped(self, ids: np.ndarray, found: list[bytes]) -> np.ndarray:
        rare = np.flatnonzero(ids < 0)
        if len(rare):
            ids = ids.copy()
            ids[rare] = shapes([found[i] for i in rare]) + len(self.ids)
        return ids


def vocabulary(counts: DataFrame, frequent: int) -> Vocabulary:
    """The words whose count lies above the lowest bin at which at most `frequent` words remain, and the totals of the rest."""
    level = F.floor(F.log2("c") * FINE).cast("int")
    spread = counts.where("shape >= 0").groupBy(level.alias("level")).agg(F.count("*").alias("n")).orderBy(F.desc("level")).collect()
    total, lowest = 0, None
    for r in spread:
        if (total := total + r["n"]) > frequent:
            break
        lowest = r["level"]
    end = counts.where("shape < 0").select("c").first()
    words_ = [] if lowest is None else counts.where(F.col("shape") >= 0).where(level >= lowest).select("word", "c").toPandas().sort_values(["c", "word"], ascending=[False, True]).values.tolist()
    rest = counts.where("shape >= 0") if lowest is None else counts.where("shape >= 0").where(level < lowest)
    by_shape = {r["shape"]: (r["n"], r["v"]) for r in rest.groupBy("shape").agg(F.sum("c").alias("n"), F.count("*").alias("v")).collect()}
    n = np.array([by_shape.get(k, (0, 0))[0] for k in range(SHAPES)], dtype=np.int64)
    v = np.array([by_shape.get(k, (0, 0))[1] for k in range(SHAPES)], dtype=np.int64)
    own = np.array([*(c for _, c in words_), *n, end["c"] if end else 0], dtype=np.int64)
    return Vocabulary({bytes(w): i for i, (w, _) in enumerate(words_)}, own, int(own.sum()), len(words_) + int(v.sum()) + bool(end), n, v)


@dataclass
class Hmm:
    start: np.ndarray  # K
    move: np.ndarray  # K x K
    emit: np.ndarray  # symbols x K; each column sums to one

    def _batches(self, texts: list[np.ndarray]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
        """Texts in falling order of length, cut into batches; tokens lie step by step, so those of a step are contiguous."""
        order = np.argsort([-len(x) for x in texts], kind="stable")
        at = 0
        while at < len(order):
            stop, n = at, 0
            while stop < len(order) and (stop == at or n + len(texts[order[stop]]) <= BATCH_TOKENS):
                n += len(texts[order[stop]])
                stop += 1
            own = order[at:stop]
            lengths = np.array([len(texts[i]) for i in own])
            active = len(own) - np.searchsorted(np.sort(lengths), np.arange(1, lengths[0] + 1), side="left")
            offset = np.concatenate([[0], np.cumsum(active)])
            step = np.arange(n) - np.repeat(np.cumsum(lengths) - lengths, lengths)
            flat = np.empty(n, np.int64)
            flat[offset[step] + np.repeat(np.arange(len(own)), lengths)] = np.concatenate([texts[i] for i in own])
            yield own, active, offset, flat
            at = stop

    def _forward(self, active: np.ndarray, offset: np.ndarray, e: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Scaled forward variables (in e's place) and the scales of all tokens of a batch."""
        scale = np.empty(len(e))
        prior = np.broadcast_to(self.start, (active[0], len(self.start)))
        for t in range(len(active)):
            now = slice(offset[t], offset[t + 1])
            a = e[now]
            a *= prior
            s = a.sum(1)
            a /= s[:, None]
            scale[now] = s
            if t + 1 < len(active):
                prior = a[: active[t + 1]] @ self.move
        return e, scale

    def log10(self, texts: list[np.ndarray]) -> np.ndarray:
        """log10 probability of each symbol sequence, exactly."""
        out = np.zeros(len(texts))
        for own, active, offset, flat in self._batches(texts):
            _, scale = self._forward(active, offset, self.emit[flat])
            logs = np.log10(scale)
            who = np.arange(len(flat)) - np.repeat(offset[:-1], active)
            out[own] = np.bincount(who, weights=logs, minlength=len(own))
        return out

    def expect(self, texts: list[np.ndarray], start: np.ndarray, move: np.ndarray, emit: np.ndarray) -> float:
        """Adds the expected counts of the texts; returns their log10 likelihood."""
        total = 0.0
        for _, active, offset, flat in self._batches(texts):
            e = self.emit[flat]
            alpha, scale = self._forward(active, offset, e.copy())
            total += float(np.log10(scale).sum())
            beta = np.ones((active[-1], len(self.start)))
            for t in range(len(active) - 1, -1, -1):
                now = slice(offset[t], offset[t + 1])
                b = e[now] * beta / scale[now, None]  # what flows back over this step's token
                alpha[now] *= beta  # now the state posteriors
                if t:
                    back = slice(offset[t - 1], offset[t - 1] + active[t])
                    move += self.move * (alpha[back].T @ b)
                    beta = np.ones((active[t - 1], len(self.start)))
                    beta[: active[t]] = b @ self.move.T
            start += alpha[: active[0]].sum(0)
            for k in range(len(self.start)):
                emit[:, k] += np.bincount(flat, weights=alpha[:, k], minlength=len(emit))
        return total


def _maximise(start: np.ndarray, move: np.ndarray, emit: np.ndarray, prior: np.ndarray, share: float) -> Hmm:
    """Each state's emissions are mixed with the unigram prior, which gets the share."""
    k = len(start)
    m = move + 1.0
    m = m / m.sum(1, keepdims=True)
    own = (emit + prior[:, None]) / (emit.sum(0) + 1)
    return Hmm((start + 1) / (start.sum() + k), m, (1 - share) * own + share * prior[:, None])


def fit(texts: DataFrame, vocab: Vocabulary, text_col: str = "text", id_col: str = "doc_id", states: int = 6, warm_rows: int = 1200, warm_rounds: int = 15, passes: int = 2, share: float = 0.15, seed: int = 11) -> Hmm:
    """warm_rows: size bound of the sample (in the order of a hash of the id) whose rounds give the starting point."""
    prior = (vocab.counts + 1) / (vocab.counts.sum() + vocab.size)
    ids = [r[0] for r in texts.where(F.col(id_col).isNotNull()).select(id_col).orderBy(F.xxhash64(id_col), id_col).limit(warm_rows).collect()]

    @F.pandas_udf("binary")  # packed: the driver holds no objects for single tokens
    def encoded(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            yield pd.Series([vocab.shaped(vocab.symbols(w), w).tobytes() for w in map(words, batch)], dtype=object)

    rng = np.random.default_rng(seed)
    emit = prior[:, None] * rng.gamma(2.0, 0.5, (len(prior), states))
    model = Hmm(np.full(states, 1 / states), np.full((states, states), 0.1 / max(states - 1, 1)) + np.eye(states) * (0.9 - 0.1 / max(states - 1, 1)), emit / emit.sum(0))
    if states == 1:
        model.move = np.ones((1, 1))
    rows = texts.where(F.col(id_col).isin(ids)).select(encoded(F.col(text_col)).alias("x")).limit(2 * warm_rows).collect() if ids else []
    sample = [np.frombuffer(r["x"], np.int32) for r in rows]
    for _ in range(warm_rounds if sample else 0):
        counts = np.zeros(states), np.zeros((states, states)), np.zeros((vocab.size, states))
        model.expect(sample, *counts)
        model = _maximise(*counts, prior, share)
    names = [f"s{k}" for k in range(states)]
    for _ in range(passes if vocab.tokens else 0):

        def partial(batches: Iterator[pd.DataFrame], model: Hmm = model) -> Iterator[pd.DataFrame]:
            start, move, emit, held, n = np.zeros(states), np.zeros((states, states)), np.zeros((vocab.size, states)), [], 0
            for pdf in batches:
                for w in map(words, pdf[text_col]):
                    held.append(vocab.shaped(vocab.symbols(w), w))
                    n += len(w) + 1
                    if n > TRAIN_TOKENS:
                        model.expect(held, start, move, emit)
                        held, n = [], 0
            model.expect(held, start, move, emit)
            all_ = np.vstack([start[None, :], move, emit])
            used = np.flatnonzero(all_.any(1))
            yield pd.DataFrame({"row": used.astype(np.int32), **{c: all_[used, k] for k, c in enumerate(names)}})

        sums = texts.select(text_col).mapInPandas(partial, "row int, " + ", ".join(f"{c} double" for c in names)).groupBy("row").agg(*[F.sum(c).alias(c) for c in names]).toPandas()
        all_ = np.zeros((1 + states + vocab.size, states))
        all_[sums["row"].to_numpy(np.int64)] = sums[names].to_numpy()
        model = _maximise(all_[0], all_[1 : 1 + states], all_[1 + states :], prior, share)
    return model


def with_scores(docs: DataFrame, counts: DataFrame, vocab: Vocabulary, model: Hmm, id_col: str = "doc_id", held_col: str = "held_out", text_col: str = "text") -> DataFrame:
    """(id_col, held_col, n_tokens, n_known, train_tokens, base_score, score): one row for each row of docs.

    base_score: the smoothed unigram's log10 probability; score: the model's. Null text: empty, so the end alone.
    Repeated rows are scored each on its own; a null id is kept.
    """
    id_type = docs.schema[id_col].dataType.simpleString()
    base = np.log10((vocab.counts + 1) / (vocab.tokens + vocab.types + 1))
    schema = "block long, nth int, id string, held boolean, n_tokens long, known long, base double, score double, word binary, places binary"
    columns = [c.split()[0] for c in schema.split(", ")]

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        block, task = 0, TaskContext.get().partitionId()
        rows: list[tuple] = []
        coded: list[np.ndarray] = []
        rare: dict[bytes, array] = {}
        n = 0

        def out() -> Iterator[pd.DataFrame]:
            nonlocal block, n
            key = (task << 24) + block
            scores = model.log10(coded)
            yield pd.DataFrame([(key, i, *r, s, None, None) for i, (r, s) in enumerate(zip(rows, scores, strict=True))], columns=columns)
            keys = list(rare)
            for at in range(0, len(keys), 50_000):
                part = keys[at : at + 50_000]
                yield pd.DataFrame({**dict.fromkeys(columns), "block": key, "word": part, "places": [rare[w].tobytes() for w in part]}, columns=columns)
            rows.clear(), coded.clear(), rare.clear()
            block, n = block + 1, 0

        for pdf in batches:
            for key, held, text in zip(pdf["id"], pdf["held"], pdf["text"], strict=True):
                found = words(text)
                ids = vocab.symbols(found)
                nth = len(rows)
                for i in np.flatnonzero(ids < 0):
                    w = found[i]
                    if (own := rare.get(w)) is None:
                        own = rare[w] = array("i")
                    own.append(nth)
                frequent = ids[ids >= 0]
                rows.append((key, held, len(ids), int((vocab.counts[frequent] > 0).sum()), float(base[frequent].sum())))
                coded.append(vocab.shaped(ids, found))
                n += len(ids)
                if n > BLOCK_TOKENS:
                    yield from out()
        if rows:
            yield from out()

    found = materialise(docs.select(F.col(id_col).cast("string").alias("id"), F.col(held_col).alias("held"), F.coalesce(F.col(text_col), F.lit("")).alias("text")).mapInPandas(read, schema), "lm-blocks")
    rare = found.where("word is not null").select("block", "word", "places").join(counts.select("word", "c"), "word", "left")
    rare = rare.select("block", "places", F.coalesce("c", F.lit(0)).alias("c"), shape_of(F.col("word")).alias("shape"))
    texts = found.where("word is null").drop("word", "places")
    both = texts.unionByName(rare, allowMissingColumns=True)
    inside = np.log10(vocab.shape_tokens + vocab.shape_types + 1.0)
    whole = np.log10(vocab.tokens + vocab.types + 1.0)

    def finish(pdf: pd.DataFrame) -> pd.DataFrame:
        is_text = pdf["nth"].notna()
        t, r = pdf[is_text].sort_values("nth"), pdf[~is_text]
        known, b, s = t["known"].to_numpy(np.int64), t["base"].to_numpy(float), t["score"].to_numpy(float)
        if len(r):
            places = [np.frombuffer(x, np.int32) for x in r["places"]]
            times, c = [len(x) for x in places], r["c"].to_numpy(np.int64)
            at, log = np.concatenate(places), np.log10(c + 1.0)
            known = known + np.bincount(at, weights=np.repeat(c > 0, times), minlength=len(t)).astype(np.int64)
            b = b + np.bincount(at, weights=np.repeat(log - whole, times), minlength=len(t))
            s = s + np.bincount(at, weights=np.repeat(log - inside[r["shape"].to_numpy(np.int64)], times), minlength=len(t))
        return pd.DataFrame({"doc_id": t["id"], "held_out": t["held"], "n_tokens": t["n_tokens"].astype("int64"), "n_known": known, "train_tokens": vocab.tokens, "base_score": b, "score": s})

    out = both.groupBy("block").applyInPandas(finish, "doc_id string, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")
    return out.withColumn("doc_id", F.col("doc_id").cast(id_type)).withColumnsRenamed({"doc_id": id_col, "held_out": held_col})


def shape_of(word):
    """shape() as a Column."""
    size, last = F.octet_length(word), F.hex(F.substring(word, -1, 1))
    plain = F.conv(last, 16, 10).cast("int")
    wide = F.octet_length(word) != F.length(F.decode(word, "UTF-8"))
    letter = plain.between(97, 122) | (plain > 127)
    return F.least(F.floor(size / 5), F.lit(3)).cast("int") * 4 + F.when(letter, 0).otherwise(2) + wide.cast("int")


def language_model(docs: DataFrame, id_col: str = "doc_id", held_col: str = "held_out", text_col: str = "text", frequent: int = 50_000, **options) -> DataFrame:
    """docs scored by the model that its rows with held_col false train; see with_scores()."""
    texts = docs.where(~F.col(held_col))
    counts = materialise(word_counts(texts, text_col), "lm-counts")
    vocab = vocabulary(counts, frequent)
    return with_scores(docs, counts, vocab, fit(texts, vocab, text_col, id_col, **options), id_col, held_col, text_col)
