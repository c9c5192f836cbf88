"""SimHash near-dedup by the generalised pigeonhole principle.

Correlated bits of the fingerprints are grouped into m partitions; partition i gets a threshold t_i with
sum(t_i) = tau - m + 1 (-1: unused), so two fingerprints within tau bits agree within t_i on some partition i. m and the
thresholds come from a dynamic programme over estimated candidate counts. Probes (a partition's value with up to t_i bits
flipped) meet index rows on equal keys, in sorted runs that are compared in arrays. A task hands on stars that span the
groups it found, never all pairs, so its output is linear in its rows; a key that very many index rows share is dealt
into blocks, to each of which its probes go.

near_duplicates() links fingerprints of shingles. near_copies() links texts whose shingle sets are at least `least`
alike: it searches fingerprints of the texts' distinct words, which one edit moves far less than those of shingles, and a
wide shingle fingerprint discards what is not alike; the clusters so found are verified on the sets themselves. One edit of
a short text moves its fingerprints far, so texts of few shingles are joined exactly as well (jaccard.node_links).
"""

from __future__ import annotations

from collections.abc import Iterator
from fractions import Fraction
from itertools import combinations
from math import comb

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomgraph.operators.components import components

from .common import BROADCAST_ROWS, free_names, give_back, matching, materialise, release

BITS = 64
SEED = 42
#: Cost of making and shuffling one probe, against that of comparing one candidate in an array.
PROBE_COST, VERIFY_COST = 1.0, 0.004
#: Index rows of one key that a task holds; a key with more is dealt into blocks.
HELD = 20_000
#: Candidates that are compared at a time, and probes in a partition beyond which there are more partitions.
CHUNK, TASK_ROWS = 1 << 20, 4_000_000
#: Pairs of one key in a batch from which they are compared as a table.
LARGE = 4096
#: Near copies: words in a shingle, least share of shingles in common, and the bits by which fingerprints of words and of shingles may differ.
WIDTH, SIMILARITY, WORD_BITS, SHINGLE_BITS = 5, 0.8, 10, 21
#: Shingles up to which all texts alike a text are found by an exact join.
SHORT = 60
#: Nodes and bytes of text of a cluster that one task verifies; larger clusters are dealt into blocks.
CLUSTER_NODES, CLUSTER_BYTES = 1000, 1 << 25
#: Least values that a sketch keeps, and the share of equal ones below which a pair is not verified: at 0.8 alike,
#: more than five standard deviations lie between.
SKETCH, SKETCH_LEAST = 256, 0.66
_RNG = np.random.default_rng(42)
_TIMES, _PLUS = (_RNG.integers(0, 1 << 63, SKETCH, dtype=np.uint64) * np.uint64(2) + np.uint64(1) for _ in range(2))


def _words(text: str | None) -> list[bytes]:
    return text.encode("utf-8", "surrogatepass").lower().split() if text else []


def _majority(hashes: np.ndarray) -> np.ndarray:
    """64 bits, as one uint64: those set in over half the hashes; long inputs in blocks."""
    total = np.zeros(BITS, np.int64)
    for at in range(0, len(hashes), 4096):
        total += np.unpackbits(hashes[at : at + 4096].astype(">u8").view(np.uint8)).reshape(-1, BITS).sum(0, dtype=np.int64)
    return np.packbits(2 * total > len(hashes)).view(">u8")[0]


def fingerprint(text: str | None, width: int = 3) -> int:
    """Unsigned 64-bit SimHash of the text's shingles, repeats counted; null or no words: 0."""
    words = _words(text)
    if not words:
        return 0
    hashed = xxhash.xxh64_intdigest
    n = max(1, len(words) - width + 1)
    return int(_majority(np.fromiter((hashed(b" ".join(words[i : i + width]), SEED) for i in range(n)), np.uint64, n)))


def with_fingerprint(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 3) -> DataFrame:
    """(id_col, fp): one row for each row of docs, fp the fingerprint as a signed long."""

    @F.pandas_udf(T.LongType())
    def fp(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series(np.array([fingerprint(x, width) for x in texts], dtype=np.uint64).view(np.int64))

    return docs.select(F.col(id_col), fp(F.col(text_col)).alias("fp"))


def _bits(values: np.ndarray) -> np.ndarray:
    return np.unpackbits(values.astype(">i8").view(np.uint8)).reshape(-1, BITS)


def bit_counts(fps: DataFrame) -> tuple[int, np.ndarray]:
    """Number of fingerprints and the 64 x 64 counts of bits set together; a fixed number of rows reaches the driver."""

    def partial(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        n, both = 0, np.zeros((BITS, BITS))
        for pdf in batches:
            b = _bits(pdf["fp"].to_numpy(np.int64)).astype(np.float32)
            n, both = n + len(b), both + b.T @ b
        if n:
            yield pd.DataFrame({"cell": np.arange(BITS * BITS + 1), "n": np.append(both.ravel(), n).astype(np.int64)})

    rows = fps.select("fp").mapInPandas(partial, "cell int, n long").groupBy("cell").agg(F.sum("n").alias("n")).collect()
    flat = np.zeros(BITS * BITS + 1)
    for r in rows:
        flat[r["cell"]] = r["n"]
    return int(flat[-1]), flat[:-1].reshape(BITS, BITS)


def group_bits(n: int, both: np.ndarray, m: int) -> list[list[int]]:
    """m partitions of near-equal size that hold strongly correlated bits together."""
    p = np.diag(both) / max(n, 1)
    sd = np.sqrt(np.maximum(p * (1 - p), 1e-9))
    corr = np.abs((both / max(n, 1) - np.outer(p, p)) / np.outer(sd, sd))
    np.fill_diagonal(corr, 0)
    free, parts = set(range(BITS)), []
    for i in range(m):
        room = (BITS - sum(map(len, parts))) // (m - i)
        part = [max(free, key=lambda b: (corr[b, sorted(free)].sum(), -b))]
        free.discard(part[0])
        while len(part) < room:
            part.append(max(free, key=lambda b: (corr[b, part].sum(), -b)))
            free.discard(part[-1])
        parts.append(sorted(part))
    return parts


def within(p: np.ndarray, most: int) -> np.ndarray:
    """P(distance <= e), e = 0..most, of two fingerprints on bits set with probabilities p, taken as independent."""
    d = np.zeros(most + 1)
    d[0] = 1
    for x in p:
        differ = 2 * x * (1 - x)
        d = d * (1 - differ) + np.append(0, d[:-1]) * differ
    return np.cumsum(d)


def allocate(n: int, both: np.ndarray, tau: int) -> tuple[list[list[int]], list[int]]:
    """The partitions and thresholds of least estimated cost, over m = 1..tau + 1 and all legal thresholds."""
    p, pairs, best = np.diag(both) / max(n, 1), n * (n - 1) / 2, None
    for m in range(1, tau + 2):
        parts = group_bits(n, both, m)
        # costs[budget]: least cost so far with that sum of thresholds + 1 spent
        costs: dict[int, tuple[float, list[int]]] = {0: (0.0, [])}
        for part in parts:
            near = within(p[part], tau)
            step: dict[int, tuple[float, list[int]]] = {}
            for spent, (cost, chosen) in costs.items():
                for t in range(-1, tau - spent + 1):
                    if spent + t + 1 > tau + 1:
                        break
                    more = 0.0 if t < 0 else PROBE_COST * n * (1 + sum(comb(len(part), e) for e in range(t + 1))) + VERIFY_COST * pairs * near[t]
                    if spent + t + 1 not in step or cost + more < step[spent + t + 1][0]:
                        step[spent + t + 1] = (cost + more, [*chosen, t])
            costs = step
        cost, chosen = costs[tau + 1]
        if best is None or cost < best[0]:
            best = (cost, parts, chosen)
    return best[1], best[2]


def _mask(bits: list[int]) -> np.uint64:
    return np.uint64(sum(1 << (BITS - 1 - int(b)) for b in bits))


def stars(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Edges from the members of each connected group of the edges (a, b) to its least member, but for that itself."""
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = at[: len(a)], at[len(a) :]
    root = np.arange(len(nodes))
    while len(x):
        p, q = root[x], root[y]
        new = root.copy()
        np.minimum.at(new, p, q)
        np.minimum.at(new, q, p)
        while (new[new] != new).any():
            new = new[new]
        if (new == root).all():
            break
        root = new
        far = root[x] != root[y]
        x, y = x[far], y[far]
    own = np.flatnonzero(root != np.arange(len(nodes)))
    return nodes[own], nodes[root[own]]


def _pair(fp: np.ndarray, s: np.ndarray) -> np.ndarray:
    """One name for two fingerprints (uint64); names that collide only widen a cluster, which is verified on its sets."""
    x = (fp ^ (fp >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9) + s
    return (x ^ (x >> np.uint64(32))) * np.uint64(0x94D049BB133111EB)


def links(nodes: DataFrame, tau: int = 3, held: int = HELD, wide: int | None = None) -> DataFrame:
    """(a, b): edges whose connected groups are those of the pairs of nodes whose fingerprints differ in tau or fewer bits.

    nodes: a row for each distinct fingerprint fp, read more than once. With `wide`, a row for each distinct (fp, s), named
    by _pair(), where s may differ in `wide` or fewer bits as well.
    """
    n, both = bit_counts(nodes)
    parts, limits = allocate(n, both, tau)
    rules = {k: (part, t) for k, (part, t) in enumerate(x for x in zip(parts, limits, strict=True) if x[1] >= 0)}
    own = ["fp"] if wide is None else ["fp", "s"]

    def keys(sides: tuple[int, ...]):
        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for pdf in batches:
                for at in range(0, len(pdf), 2000):
                    rows = {c: pdf[c].to_numpy(np.int64)[at : at + 2000] for c in own}
                    x = rows["fp"].view(np.uint64)
                    for k, (part, t) in rules.items():
                        for side in sides:
                            flips = [_mask(list(c)) for e in range((t if side else 0) + 1) for c in combinations(part, e)]
                            key = (x[:, None] & _mask(part)) ^ np.array(flips, dtype=np.uint64)[None, :]
                            yield pd.DataFrame({"rule": np.int32(2 * k + side), "key": key.ravel().view(np.int64), **{c: np.repeat(v, len(flips)) for c, v in rows.items()}})

        return run

    # the rows that are shuffled hold no more than rule (2 * part + side), key and fingerprints
    schema = "rule int, key long, " + ", ".join(f"{c} long" for c in own)
    spark, by = nodes.sparkSession, [F.shiftright("rule", 1), F.col("key")]
    rows = nodes.select(*own).mapInPandas(keys((0, 1)), schema)
    if n > held:
        sizes = nodes.select(*own).mapInPandas(keys((0,)), schema).groupBy("rule", "key").count().where(F.col("count") > held)
        hot = materialise(sizes.select(F.col("rule").alias("hot_rule"), F.col("key").alias("hot_key"), F.ceil(F.col("count") / (held // 2)).cast("int").alias("blocks")), "simhash-hot")
        if (found := hot.count()):
            hot = F.broadcast(hot) if found <= BROADCAST_ROWS else hot
            dealt = rows.join(hot, (rows["rule"] - rows["rule"] % 2 == hot["hot_rule"]) & (rows["key"] == hot["hot_key"]), "left")
            places = F.when(F.col("rule") % 2 == 0, F.array(F.pmod(F.xxhash64(*own), "blocks").cast("int"))).otherwise(F.sequence(F.lit(0), F.col("blocks") - 1))
            rows = dealt.select("rule", "key", *own, F.explode(F.when(F.col("blocks").isNull(), F.array(F.lit(0))).otherwise(places)).alias("block"))
            by.append(F.col("block"))
    made = n * sum(1 + sum(comb(len(part), e) for e in range(t + 1)) for part, t in rules.values())
    tasks = -(-made // TASK_ROWS)
    dealt = rows.repartition(tasks, *by) if tasks > int(spark.conf.get("spark.sql.shuffle.partitions")) else rows.repartition(*by)

    def met(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        kept: dict[str, np.ndarray] | None = None  # the index rows of the key that the batch before ended with
        for pdf in batches:
            x = {c: pdf[c].to_numpy(np.int64).view(np.uint64) for c in own} | {c: pdf[c].to_numpy() for c in pdf.columns if c not in own}
            x["name"] = x["fp"] if wide is None else _pair(x["fp"], x["s"])
            if kept is not None:
                x = {c: np.concatenate([kept[c], v]) for c, v in x.items()}
            size = len(x["key"])
            if not size:
                continue
            new, side = np.ones(size, bool), x["rule"] & 1
            new[1:] = (x["key"][1:] != x["key"][:-1]) | (x["rule"][1:] >> 1 != x["rule"][:-1] >> 1)
            if "block" in x:
                new[1:] |= x["block"][1:] != x["block"][:-1]
            start = np.flatnonzero(new)
            run = np.cumsum(new) - 1
            index = np.bincount(run, weights=side == 0).astype(np.int64)
            asked = np.bincount(run, minlength=len(start)) - index
            a, b = [], []

            def near(p: np.ndarray, q: np.ndarray) -> None:
                """Keeps the groups of the pairs (p, q) of rows whose fingerprints are known to be near."""
                ok = x["name"][p] != x["name"][q]
                if wide is not None:
                    ok &= np.bitwise_count(x["s"][p] ^ x["s"][q]) <= wide
                u, v = stars(x["name"][p[ok]], x["name"][q[ok]])
                a.append(u)
                b.append(v)

            large = index * asked >= LARGE
            for r in np.flatnonzero(large):  # index rows against probes, as tables
                first, held_rows = start[r], x["fp"][start[r] : start[r] + index[r]]
                step = max(1, CHUNK // len(held_rows))
                for lo in range(first + index[r], first + index[r] + asked[r], step):
                    hi = min(lo + step, first + index[r] + asked[r])
                    p, q = np.nonzero(np.bitwise_count(x["fp"][lo:hi, None] ^ held_rows[None, :]) <= tau)
                    near(p + lo, q + first)
            probes = np.flatnonzero((side == 1) & ~large[run])  # the many small keys, pair by pair
            times = index[run[probes]]
            probes, times = probes[times > 0], times[times > 0]
            ends, lo = np.cumsum(times), 0
            while lo < len(probes):
                hi = max(lo + 1, int(np.searchsorted(ends, (ends[lo - 1] if lo else 0) + CHUNK, side="right")))
                k = times[lo:hi]
                p = np.repeat(probes[lo:hi], k)
                q = np.repeat(start[run[probes[lo:hi]]], k) + np.arange(len(p)) - np.repeat(np.cumsum(k) - k, k)
                close = np.flatnonzero(np.bitwise_count(x["fp"][p] ^ x["fp"][q]) <= tau)
                near(p[close], q[close])
                lo = hi
            if a:
                u, v = stars(np.concatenate(a), np.concatenate(b))
                yield pd.DataFrame({"a": u.view(np.int64), "b": v.view(np.int64)})
            last = slice(start[-1], start[-1] + index[-1])
            kept = {c: v[last] for c, v in x.items()}

    return dealt.sortWithinPartitions(*by, "rule").mapInPandas(met, "a long, b long")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", tau: int = 3, width: int = 3, held: int = HELD) -> DataFrame:
    """(id_col, fingerprint, component_id): one row for each row of docs.

    component_id: the smallest id reachable over links of tau or fewer differing bits, itself included; rows of the same
    text are linked whatever their ids. Null or wordless text: fingerprint 0, linked like any other. Texts of any length
    are read whole. A null id never is the smallest; where all ids of a group are null, component_id is null. Columns
    other than the two named take no part. No rows: no rows.
    """
    fps = materialise(with_fingerprint(docs, id_col, text_col, width), "simhash-fp")
    distinct = materialise(fps.groupBy("fp").agg(F.min(id_col).alias("least")), "simhash-distinct")
    found = materialise(links(distinct, tau, held).distinct(), "simhash-links")
    roots = components(found).withColumnRenamed("node", "fp")
    linked = distinct.join(roots, "fp", "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    least = linked.groupBy("root").agg(F.min("least").alias("component_id"))
    by_fp = linked.join(least, "root").select("fp", "component_id")
    return fps.join(by_fp, "fp").select(id_col, F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def shingles(words: list[bytes], width: int = WIDTH) -> np.ndarray:
    """Sorted distinct hashes of the runs of `width` words, of all words where there are fewer; none: empty."""
    if not words:
        return np.zeros(0, np.uint64)
    h = np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, len(words))
    n = max(1, len(words) - width + 1)
    out = np.full(n, min(width, len(words)), np.uint64)
    for j in range(min(width, len(words))):
        out = (out ^ h[j : j + n]) * np.uint64(0x9E3779B97F4A7C15)
        out ^= out >> np.uint64(29)
    return np.unique(out)


def _named(own: np.ndarray) -> int:
    """The name of a set of shingles, as a signed long."""
    return int(np.uint64(xxhash.xxh64_intdigest(own.tobytes())).view(np.int64))


def sign(text: str | None, width: int = WIDTH) -> tuple[int, int, int, int]:
    """node: the name of the set of shingles; fp: SimHash of the distinct words; s: that of the shingles; pair: the name of both."""
    words = _words(text)
    own = shingles(words, width)
    distinct = set(words)
    fp = _majority(np.fromiter((xxhash.xxh64_intdigest(w, SEED) for w in distinct), np.uint64, len(distinct)))
    both = np.array([fp, _majority(own)], np.uint64)
    return (_named(own), *both.view(np.int64).tolist(), int(_pair(both[:1], both[1:]).view(np.int64)[0]))


def similarity(x: np.ndarray, y: np.ndarray) -> float:
    """Share of shingles in common; two empty sets are alike."""
    if not len(x) or not len(y):
        return float(len(x) == len(y))
    both = len(np.intersect1d(x, y, assume_unique=True))
    return both / (len(x) + len(y) - both)


def sketch(own: np.ndarray) -> np.ndarray:
    least = np.full(SKETCH, np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(own), 1024):
        np.minimum(least, (own[at : at + 1024, None] * _TIMES + _PLUS).min(0), out=least)
    return (least >> np.uint64(20)).astype(np.uint16)


def grouped(sets: list[np.ndarray], sides: np.ndarray | None = None, least: float = SIMILARITY) -> np.ndarray:
    """The group of each set (the place of one of its members): connected by pairs at least `least` alike.

    sides: 0 or 1 for each set, where only pairs across the sides count. Likely pairs come first, and a pair that is
    connected by then is not compared. Up to 24 sets all pairs are candidates; of more, those with like sketches.
    """
    n = len(sets)
    root = np.arange(n)
    sizes = np.array([len(s) for s in sets])
    if n <= 24:
        i, j = np.triu_indices(n, 1)
        est = np.minimum(sizes[i], sizes[j]) / np.maximum(np.maximum(sizes[i], sizes[j]), 1)
    else:
        s = np.array([sketch(x) for x in sets])
        near = []
        step = max(1, (1 << 24) // (n * SKETCH))
        for at in range(0, n, step):
            same = (s[at : at + step, None, :] == s[None, at:, :]).sum(2, dtype=np.int16)
            a, b = np.nonzero(same >= SKETCH_LEAST * SKETCH)
            keep = a < b
            near.append(np.stack([a[keep] + at, b[keep] + at, same[a[keep], b[keep]]]))
        i, j, est = np.concatenate(near, axis=1)
    fits = np.minimum(sizes[i], sizes[j]) >= least * np.maximum(sizes[i], sizes[j])
    if sides is not None:
        fits &= sides[i] != sides[j]
    i, j, est = i[fits], j[fits], est[fits]
    order = np.argsort(-est, kind="stable")
    i, j = i[order], j[order]
    for at in range(0, len(i), 4096):
        a, b = i[at : at + 4096], j[at : at + 4096]
        far = root[a] != root[b]
        for x, y in zip(a[far].tolist(), b[far].tolist(), strict=True):
            p, q = root[x], root[y]
            if p != q and similarity(sets[x], sets[y]) >= least:
                root[root == max(p, q)] = min(p, q)
    return root


def near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: float = SIMILARITY, width: int = WIDTH, tau: int = WORD_BITS, wide: int = SHINGLE_BITS, held: int = HELD, cluster_nodes: int = CLUSTER_NODES, cluster_bytes: int = CLUSTER_BYTES, short: int = SHORT) -> DataFrame:
    """(id_col, node, root, component_id): one row for each row of docs whose id is not null.

    node names the row's set of shingles of `width` words and root its group; component_id is the smallest id reachable over pairs of sets
    that share `least` or more of their shingles, itself included: of all such pairs of which a set has `short` or fewer, of
    the others those whose fingerprints are near. Null and wordless texts have the empty set, which is
    like itself only. Texts of any length are read whole. Columns other than the two named take no part. No rows: no rows.
    """

    from . import jaccard  # which takes shingles from here

    @F.pandas_udf("node long, fp long, s long, pair long")
    def signed(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        give_back()  # of the stage before
        for texts in batches:
            yield pd.DataFrame([sign(x, width) for x in texts], columns=["node", "fp", "s", "pair"], dtype=np.int64)
        give_back()

    known = docs.where(F.col(id_col).isNotNull()).select(F.col(id_col), F.col(text_col).alias("text"))
    signs = materialise(known.select(id_col, F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("bytes"), signed("text").alias("sign")).select(id_col, "bytes", "sign.*"), "simhash-signs")
    nodes = materialise(signs.groupBy("node").agg(F.min(F.struct(id_col, "bytes")).alias("of"), *[F.first(c).alias(c) for c in ("fp", "s", "pair")]).select("node", F.col(f"of.{id_col}").alias("least"), "of.bytes", "fp", "s", "pair"), "simhash-nodes")
    pairs = materialise(nodes.select("fp", "s").distinct(), "simhash-pairs")
    coarse = materialise(links(pairs, tau, held, wide).distinct(), "simhash-coarse")
    # every set whose pair of fingerprints is linked or shared by several sets
    roots = components(coarse).withColumnRenamed("node", "pair")
    rooted = nodes.join(roots, "pair", "left").select("node", "least", "bytes", F.coalesce("root", "pair").alias("root"))
    several = rooted.groupBy("root").count().where(F.col("count") > 1).select("root")
    clusters = materialise(rooted.join(several, "root", "left_semi"), "simhash-clusters")
    release(pairs)
    release(coarse)
    sizes = clusters.groupBy("root").agg(F.greatest(F.ceil(F.count("*") / cluster_nodes), F.ceil(F.sum("bytes") / cluster_bytes)).cast("int").alias("blocks"))
    bins = -(-(clusters.agg(F.sum("bytes")).first()[0] or 0) // cluster_bytes)
    # a cluster that fits goes to a bin with others; one that does not, to a task for each pair of its blocks
    placed = clusters.join(sizes, "root").withColumn("own", F.pmod(F.xxhash64("node"), "blocks").cast("int"))
    pairs = F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda k: F.struct(F.least("own", k).alias("i"), F.greatest("own", k).alias("j")))
    placed = placed.withColumn("at", F.explode(pairs))
    whole = F.col("blocks") == 1
    # bins are finer than bytes ask for, so that all cores have some
    fine = max(4 * int(bins), 4 * docs.sparkSession.sparkContext.defaultParallelism)
    task = F.when(whole, F.concat(F.lit("bin "), F.pmod(F.xxhash64("root"), F.lit(fine)))).otherwise(F.concat_ws(" ", "root", "at.i", "at.j"))
    placed = placed.select(F.col("least").alias(id_col), "node", "root", task.alias("task"), F.when(whole | (F.col("at.i") == F.col("at.j")), F.lit(-1)).otherwise((F.col("own") == F.col("at.j")).cast("int")).alias("side"))

    def verified(pdf: pd.DataFrame) -> pd.DataFrame:
        give_back()  # of the task's groups before
        out = []
        for _, g in pdf.groupby("root", sort=True):
            sets = [shingles(_words(x), width) for x in g["text"]]
            names = g["node"].to_numpy(np.int64)
            # an id that repeats brings texts of other nodes, a repeated row the same one again
            first = dict(reversed([(k, i) for i, (k, s) in enumerate(zip(names.tolist(), sets, strict=True)) if _named(s) == k]))
            rows = np.array(sorted(first.values()))
            side = g["side"].to_numpy()[rows]
            root = grouped([sets[i] for i in rows], None if (side < 0).all() else side, least)
            linked = root != np.arange(len(rows))
            out.append(pd.DataFrame({"a": names[rows][linked], "b": names[rows][root[linked]]}))
        return pd.concat(out) if out else pd.DataFrame({"a": np.zeros(0, np.int64), "b": np.zeros(0, np.int64)})

    texts = matching(known, placed.select(id_col).distinct(), id_col, "left_semi")
    found = placed.join(texts, id_col).groupBy("task").applyInPandas(verified, "a long, b long")
    if short:
        alike = Fraction(least).limit_denominator(1000)
        _, _, exact = jaccard.node_links(known.withColumnRenamed(id_col, "id"), width, (alike.numerator, alike.denominator), int(short / alike))
        found = found.unionByName(exact)
    found = materialise(found, "simhash-links")
    roots = components(found)
    own = nodes.select("node", "least").join(roots, "node", "left").select("node", "least", F.coalesce("root", "node").alias("root"))
    ids = own.join(own.groupBy("root").agg(F.min("least").alias("component_id")), "root").select("node", "root", "component_id")
    return signs.select(id_col, "node").join(ids, "node").select(id_col, "node", "root", "component_id")


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: float = SIMILARITY, width: int = WIDTH, **options) -> DataFrame:
    """docs with one row of each group of near copies (see near_copies()): that with the smallest id.

    Of several rows of a group with that id the one with the smallest text stays, then that with the smallest hash of all
    columns; an id that is the smallest of several groups stays in each. Rows with a null id stay. All columns keep their values.
    """
    found = materialise(near_copies(docs, id_col, text_col, least, width, **options), "simhash-groups")
    twice = materialise(found.groupBy(id_col).count().where(F.col("count") > 1).select(id_col), "simhash-twice")
    gone = found.where(F.col(id_col) != F.col("component_id")).select(id_col).unionByName(twice).distinct()
    known = docs.where(F.col(id_col).isNotNull())
    out = matching(known, gone, id_col, "left_anti").select(*docs.columns).unionByName(docs.where(F.col(id_col).isNull()))
    if not twice.take(1):
        return out

    @F.pandas_udf("long")
    def named(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series([_named(shingles(_words(x), width)) for x in texts], dtype=np.int64)

    node, root, nth = free_names(docs, "node", "root", "nth")
    again = matching(known, twice, id_col, "left_semi").withColumn(node, named(F.col(text_col)))
    first = found.where(F.col(id_col) == F.col("component_id")).join(twice, id_col, "left_semi").select(id_col, F.col("node").alias(node), F.col("root").alias(root)).distinct()
    order = Window.partitionBy(id_col, root).orderBy(F.col(text_col).asc_nulls_first(), F.xxhash64(F.to_json(F.struct(*[F.col(f"`{c}`") for c in docs.columns]))))
    again = again.join(first, [id_col, node]).withColumn(nth, F.row_number().over(order)).where(F.col(nth) == 1)
    return out.unionByName(again.select(*docs.columns))
