"""Exact Jaccard join of shingle sets with a count-vector R-tree.

The shingles of a set are hashed into groups; how many fall into each group is the set's point. Two sets share at most the
sum over groups of the smaller count, and with a node of the tree at most that sum over the node's greatest counts, so a
tree packed by the counts is searched for the sets that can still share enough, and those are verified on the sets.

One tree over all sets would meet nearly all of its nodes for each query, as unrelated texts of one length have like
counts. So trees are built where sets can be alike at all: linked sets share one of their first shingles in a global order
(frequent ones last), rows meet on those shingles by equal joins, trees of coarse points find what may be linked, and the
clusters of that are searched and verified with fine points. Sets too large for coarse points to tell apart share several
of their first shingles where they are linked, and are met by their number. Links between members of one component need not be found twice,
so a tree forgets what has been reached: a family of near copies costs a search for each member, not for each pair.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomgraph.operators.components import components

from .common import matching, materialise, release
from .simhash import _named, _words, shingles, stars

#: Words of a shingle, and the least share in common as a fraction.
WIDTH, ALIKE = 4, (85, 100)
#: Groups of the points that meet by shingle, and of those within a cluster.
COARSE, FINE = 64, 256
#: Shingles from which a set is met by the number of shared keys, and up to how many such sets of a key are counted pair by pair.
LONG, COUNTED = 1000, 64
#: Sets in a leaf and nodes in a node.
LEAF, FAN = 16, 8
#: A shingle counts as frequent from so many texts; the most frequent so many are known to every task. Which shingles come
#: last in the order decides how much is compared, never what is found.
FREQUENT, FREQUENT_KEYS = 64, 1 << 20
#: Sets of one shingle among which a tree searches; more are clustered by size alone.
HELD = 1000
#: Nodes and bytes of text of a cluster that one task verifies; larger clusters are dealt into blocks with HUBS sets in common.
CLUSTER_NODES, CLUSTER_BYTES, HUBS = 20_000, 1 << 25, 16
#: Pairs compared at a time.
CHUNK = 1 << 14


def needed(a, b, alike: tuple[int, int] = ALIKE):
    """The least overlap that sets of a and b shingles need."""
    num, den = alike
    return -(-(num * (a + b)) // (num + den))


def points(own: np.ndarray, groups: int) -> np.ndarray:
    """How many of a set's shingles fall into each group (a power of two)."""
    at = (own * np.uint64(0xD6E8FEB86659FD93)) >> np.uint64(64 - (groups.bit_length() - 1))
    return np.bincount(at.astype(np.int64), minlength=groups)


def packed(counts: np.ndarray) -> bytes:
    """Counts in the narrowest unsigned type."""
    return counts.astype(np.min_scalar_type(int(counts.max(initial=0)))).tobytes()


def unpacked(data: list[bytes], groups: int) -> np.ndarray:
    out = np.zeros((len(data), groups), np.int32)
    for i, x in enumerate(data):
        out[i] = np.frombuffer(x, f"u{len(x) // groups}")
    return out


def in_common(n, alike: tuple[int, int] = ALIKE):
    """How many of the first shingles two linked sets share, of which one has n: more for larger sets (a tenth of what it may lack)."""
    num, den = alike
    return np.maximum(1, (n + (-n * num // den) + 1) // 10)


def first_shingles(own: np.ndarray, frequent: np.ndarray, alike: tuple[int, int] = ALIKE) -> np.ndarray:
    """So many of a set's first shingles (the frequent ones last) that any linked set shares in_common() of them; none: no other set can be linked."""
    num, den = alike
    n = len(own)
    least = -(-n * num // den)
    if least == n and n * den // num == n:
        return own[:0]
    take = n - least + int(in_common(n, alike))
    if not len(frequent):
        return own[:take]
    at = np.minimum(np.searchsorted(frequent, own), len(frequent) - 1)
    late = frequent[at] == own
    return np.concatenate([own[~late][:take], own[late][:take]])[:take]


class CountTree:
    """An R-tree over points (rows of counts) and set sizes, packed top-down by median cuts of the widest coordinate."""

    def __init__(self, counts: np.ndarray, sizes: np.ndarray, alike: tuple[int, int] = ALIKE):
        self.alike = alike
        todo, parts = [np.arange(len(sizes))], []
        while todo:
            own = todo.pop()
            if len(own) <= LEAF:
                parts.append(own)
                continue
            c = counts[own]
            wide = np.append(c.max(0) - c.min(0), np.ptp(sizes[own]))
            key = sizes[own] if wide.argmax() == counts.shape[1] else c[:, wide.argmax()]
            # leaves stay full: cuts fall on multiples of LEAF
            half = LEAF * max(1, round(len(own) / 2 / LEAF))
            order = np.argsort(key, kind="stable")
            todo += [own[order[half:]], own[order[:half]]]
        self.order = np.concatenate(parts) if parts else np.zeros(0, int)
        self.counts, self.sizes = counts[self.order], sizes[self.order]
        self.place = np.argsort(self.order)
        self.live = np.ones(len(sizes), bool)
        self.levels = []  # from the leaves up: greatest counts, least and greatest size, members not yet reached
        high, least, most, open_ = self.counts, self.sizes, self.sizes, np.ones(len(sizes), np.int64)
        step = LEAF
        while True:
            cuts = np.arange(0, len(least), step)
            if not len(cuts):
                break
            high, least, most = np.maximum.reduceat(high, cuts), np.minimum.reduceat(least, cuts), np.maximum.reduceat(most, cuts)
            open_ = np.add.reduceat(open_, cuts)
            self.levels.append((high, least, most, open_))
            if len(cuts) == 1:
                break
            step = FAN

    def reach(self, who: np.ndarray) -> None:
        """Forgets these sets."""
        at = self.place[who]
        self.live[at] = False
        step = LEAF
        for *_, open_ in self.levels:
            at = at // step
            np.subtract.at(open_, at, 1)
            step = FAN

    def search(self, counts: np.ndarray, size: int) -> np.ndarray:
        """The sets not yet reached whose overlap with a set of these counts and this size may be enough."""
        num, den = self.alike
        low, far = -(-size * num // den), size * den // num
        at = np.zeros(min(1, len(self.levels)), int)
        for level in range(len(self.levels) - 1, -1, -1):
            high, least, most, open_ = self.levels[level]
            at = at[(open_[at] > 0) & (most[at] >= low) & (least[at] <= far)]
            bound = np.minimum(high[at], counts).sum(1)
            at = at[bound >= needed(size, np.maximum(least[at], low), self.alike)]
            step = FAN if level else LEAF
            below = len(self.levels[level - 1][1]) if level else len(self.sizes)
            at = (at[:, None] * step + np.arange(step)).ravel()
            at = at[at < below]
        if not len(at):
            return at
        at = at[self.live[at] & (self.sizes[at] >= low) & (self.sizes[at] <= far)]
        bound = np.minimum(self.counts[at], counts).sum(1)
        return self.order[at[bound >= needed(size, self.sizes[at], self.alike)]]


def linked(counts: np.ndarray, sizes: np.ndarray, alike: tuple[int, int] = ALIKE, check: Callable[[int, np.ndarray], np.ndarray] | None = None) -> np.ndarray:
    """The group of each set (the place of its first member): connected by pairs whose bound is enough and that `check` accepts."""
    n = len(sizes)
    root = np.arange(n)
    if n < 2:
        return root
    tree = CountTree(counts, sizes, alike)
    left = n
    for seed in range(n):
        if not left:
            break
        if not tree.live[tree.place[seed]]:
            continue
        tree.reach(np.array([seed]))
        left -= 1
        waiting = [seed]
        while waiting and left:
            x = waiting.pop()
            found = tree.search(counts[x], int(sizes[x]))
            if check is not None and len(found):
                found = found[check(x, found)]
            if len(found):
                tree.reach(found)
                left -= len(found)
                root[found] = seed
                waiting += found.tolist()
    return root


def overlaps(own: np.ndarray, others: list[np.ndarray]) -> np.ndarray:
    """Shingles that each of the other sets (none empty) shares with a set."""
    out = np.zeros(len(others), np.int64)
    lo = 0
    while lo < len(others):
        hi, total = lo, 0
        while hi < len(others) and (hi == lo or total + len(others[hi]) <= 1 << 20):
            total += len(others[hi])
            hi += 1
        flat = np.concatenate(others[lo:hi])
        hit = own[np.minimum(np.searchsorted(own, flat), len(own) - 1)] == flat
        out[lo:hi] = np.add.reduceat(hit.astype(np.int64), np.cumsum([0, *map(len, others[lo : hi - 1])]))
        lo = hi
    return out


def connected(sets: list[np.ndarray], alike: tuple[int, int] = ALIKE) -> np.ndarray:
    """The group of each set: connected by pairs that are alike, exactly. Empty sets are linked with nothing."""
    sizes = np.array([len(s) for s in sets])
    full = np.flatnonzero(sizes)
    root = np.arange(len(sets))
    if not len(full):
        return root
    counts = np.stack([points(sets[i], FINE) for i in full])
    check = lambda x, found: overlaps(sets[full[x]], [sets[full[y]] for y in found]) >= needed(sizes[full[x]], sizes[full[found]], alike)
    root[full] = full[linked(counts.astype(np.int32), sizes[full], alike, check)]
    return root


def _pairs_of_runs(start: np.ndarray, run: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """All pairs of places within each run, a chunk at a time."""
    first = np.repeat(start, run) + np.arange(run.sum()) - np.repeat(np.cumsum(run) - run, run)
    times = np.repeat(start + run, run) - first - 1
    ends, lo = np.cumsum(times), 0
    while lo < len(first):
        hi = max(lo + 1, int(np.searchsorted(ends, (ends[lo - 1] if lo else 0) + CHUNK, side="right")))
        k = times[lo:hi]
        p = np.repeat(first[lo:hi], k)
        yield p, p + 1 + np.arange(len(p)) - np.repeat(np.cumsum(k) - k, k)
        lo = hi


def _meetings(rows: DataFrame, alike: tuple[int, int]) -> DataFrame:
    """(a, b): stars of the sets of each key that may be linked. rows: (key, node, n, counts), at most HELD of a key.

    Pairs of which no set is LONG pass by their points. The others pass if they share enough keys: those of up to COUNTED
    such sets are counted; a key of more of them joins those of like sizes.
    """
    num, den = alike

    def near(pdf: pd.DataFrame) -> pd.DataFrame:
        key, node, size = (pdf[c].to_numpy(np.int64) for c in ("key", "node", "n"))
        out = []

        def runs(keep: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
            at = np.flatnonzero(keep)
            new = np.ones(len(at), bool)
            new[1:] = key[at[1:]] != key[at[:-1]]
            start = np.flatnonzero(new)
            return at, start, np.diff(np.append(start, len(at)))

        # short sets, by points: small keys all at once, large ones by trees
        at, start, run = runs(size <= LONG)
        counts = unpacked(pdf["counts"].iloc[at].tolist(), COARSE)
        a, b = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for p, q in _pairs_of_runs(start[run <= LEAF], run[run <= LEAF]):
            ok = np.minimum(counts[p], counts[q]).sum(1) >= needed(size[at[p]], size[at[q]], alike)
            a.append(node[at[p[ok]]])
            b.append(node[at[q[ok]]])
        for lo, n in zip(start[run > LEAF], run[run > LEAF], strict=True):
            root = linked(counts[lo : lo + n], size[at[lo : lo + n]], alike)
            own = np.flatnonzero(root != np.arange(n))
            a.append(node[at[lo + own]])
            b.append(node[at[lo + root[own]]])
        # long ones, and those that may be linked with them, by the number of keys
        at, start, run = runs(size * den >= LONG * num)
        for p, q in _pairs_of_runs(start[run <= COUNTED], run[run <= COUNTED]):
            x, y = at[p], at[q]
            low, high = np.minimum(size[x], size[y]), np.maximum(size[x], size[y])
            ok = (high > LONG) & (low * den >= high * num)
            out.append(pd.DataFrame({"a": np.maximum(node[x[ok]], node[y[ok]]), "b": np.minimum(node[x[ok]], node[y[ok]]), "least": in_common(low[ok], alike)}))
        for lo, n in zip(start[run > COUNTED], run[run > COUNTED], strict=True):
            own = at[lo : lo + n][np.argsort(size[at[lo : lo + n]], kind="stable")]
            ok = size[own[:-1]] * den >= size[own[1:]] * num  # a chain through sizes joins all that are alike in size
            a.append(node[own[1:][ok]])
            b.append(node[own[:-1][ok]])
        a, b = np.concatenate(a), np.concatenate(b)
        if len(a):
            u, v = stars(a.view(np.uint64), b.view(np.uint64))
            out.append(pd.DataFrame({"a": u.view(np.int64), "b": v.view(np.int64), "least": np.zeros(len(u), np.int64)}))
        none = pd.DataFrame({"a": np.zeros(0, np.int64), "b": np.zeros(0, np.int64), "least": np.zeros(0, np.int64)})
        return pd.concat([none, *out]).groupby(["a", "b", "least"], as_index=False, sort=False).size()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = None
        for pdf in batches:
            pdf = pdf if held is None else pd.concat([held, pdf], ignore_index=True)
            if not len(pdf):
                continue
            whole = int(np.searchsorted(pdf["key"].to_numpy(), pdf["key"].iloc[-1]))  # the last key may go on
            held = pdf.iloc[whole:]
            yield near(pdf.iloc[:whole])
        if held is not None:
            yield near(held)

    met = rows.repartition("key").sortWithinPartitions("key").mapInPandas(run, "a long, b long, least long, size long")
    return met.groupBy("a", "b").agg(F.min("least").alias("least"), F.sum("size").alias("size")).where("size >= least").select("a", "b")


def _banded(rows: DataFrame, alike: tuple[int, int]) -> DataFrame:
    """(a, b): stars of the sets of a key of like sizes; bands overlap, so that sizes within the share meet in one of them."""
    at = F.log(F.col("n").cast("double")) / float(np.log(alike[1] / alike[0]))
    bands = F.array(F.struct(F.lit(0).alias("side"), F.floor(at / 2).alias("at")), F.struct(F.lit(1).alias("side"), F.floor(at / 2 + 0.5).alias("at")))
    each = rows.select("key", "node", F.explode(bands).alias("band"))
    heads = each.groupBy("key", "band").agg(F.min("node").alias("head"))
    return each.join(heads, ["key", "band"]).where("node <> head").select(F.col("node").alias("a"), F.col("head").alias("b")).distinct()


def node_links(own: DataFrame, width: int = WIDTH, alike: tuple[int, int] = ALIKE, most: int | None = None, frequent: int = FREQUENT, held: int = HELD, cluster_nodes: int = CLUSTER_NODES, cluster_bytes: int = CLUSTER_BYTES) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Of (id, text): signs (id, bytes, node, n), the sets with an id (node, least id), and links (a, b) that span the components.

    See similar(); most: sets of more shingles take no part.
    """
    spark = own.sparkSession

    def keys_of(text: str | None, late: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        s = shingles(_words(text), width)
        return s, first_shingles(s, late, alike) if most is None or len(s) <= most else s[:0]

    def counted(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        none = np.zeros(0, np.uint64)
        for pdf in batches:
            keys = [keys_of(x, none)[1] for x in pdf["text"]]
            found, n = np.unique(np.concatenate([none, *keys]), return_counts=True)
            yield pd.DataFrame({"key": found.view(np.int64), "n": n.astype(np.int64)})

    often = own.select("text").mapInPandas(counted, "key long, n long").groupBy("key").agg(F.sum("n").alias("n")).where(F.col("n") >= frequent)
    late = often.orderBy(F.desc("n"), "key").limit(FREQUENT_KEYS).select("key").toArrow()["key"].to_numpy()
    late = np.sort(late.astype(np.int64).view(np.uint64))

    @F.pandas_udf("node long, n long, counts binary, keys array<long>")
    def signed(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in batches:
            out = []
            for x in texts:
                s, keys = keys_of(x, late)
                out.append((_named(s), len(s), packed(points(s, COARSE)) if len(keys) and len(s) <= LONG else b"", keys.view(np.int64)))
            yield pd.DataFrame(out, columns=["node", "n", "counts", "keys"])

    size = F.coalesce(F.octet_length("text"), F.lit(0)).cast("long")
    signs = materialise(own.select("id", size.alias("bytes"), signed("text").alias("sign")).select("id", "bytes", "sign.*"), "jaccard-signs")
    # sets that only rows without an id have take no part, as no other row tells them
    known = signs.where("id IS NOT NULL").groupBy("node").agg(F.min(F.struct("id", "bytes")).alias("of"), F.first("n").alias("n"), F.first("counts").alias("counts"), F.first("keys").alias("keys"))
    nodes = materialise(known.select("node", F.col("of.id").alias("least"), "of.bytes", "n", "counts", "keys"), "jaccard-nodes")
    rows = nodes.select(F.explode("keys").alias("key"), "node", "n")
    shared = rows.groupBy("key").agg(F.count("*").alias("c")).where("c > 1")
    rows = materialise(rows.join(shared, "key"), "jaccard-keys")
    met = _meetings(rows.where(F.col("c") <= held).join(nodes.select("node", "counts"), "node").select("key", "node", "n", "counts"), alike)
    coarse = materialise(met.unionByName(_banded(rows.where(F.col("c") > held), alike)).distinct(), "jaccard-coarse")
    release(rows)
    roots = components(coarse)
    clusters = materialise(nodes.select("node", "least", "bytes").join(roots, "node"), "jaccard-clusters")
    release(coarse)

    # a cluster that fits goes to a bin with others; one that does not, in blocks with the hubs of the cluster
    sizes = clusters.groupBy("root").agg(F.greatest(F.ceil(F.count("*") / cluster_nodes), F.ceil(F.sum("bytes") / cluster_bytes), F.lit(1)).cast("int").alias("blocks"))
    total = clusters.agg(F.sum("bytes")).first()[0] or 0
    bins = max(4 * -(-int(total) // cluster_bytes), 4 * spark.sparkContext.defaultParallelism)
    placed = clusters.join(sizes, "root").withColumn("block", F.pmod(F.xxhash64("node"), "blocks").cast("int"))
    hubs = placed.where("blocks > 1").groupBy("root", F.pmod(F.hash("node"), F.lit(HUBS)).alias("h")).agg(F.min(F.struct("node", "least", "blocks")).alias("s"))
    hubs = hubs.select("root", F.col("s.node").alias("node"), F.col("s.least").alias("least"), F.explode(F.sequence(F.lit(0), F.col("s.blocks") - 1)).alias("block"))
    task = F.when(F.col("blocks") == 1, F.concat(F.lit("bin "), F.pmod(F.xxhash64("root"), F.lit(bins)))).otherwise(F.concat_ws(" ", "root", "block"))
    # the hubs of a cluster dealt into blocks go to its other blocks as well
    once = placed.select("root", "node", "least", task.alias("task")).unionByName(hubs.select("root", "node", "least", F.concat_ws(" ", "root", "block").alias("task"))).distinct()

    def verified(pdf: pd.DataFrame) -> pd.DataFrame:
        out = []
        for _, g in pdf.groupby("root", sort=True):
            names, first, sets = g["node"].to_numpy(np.int64), {}, []
            for name, text in zip(names.tolist(), g["text"], strict=True):
                if name not in first and _named(s := shingles(_words(text), width)) == name:  # an id that repeats brings other texts too
                    first[name] = len(sets)
                    sets.append(s)
            own = np.array(list(first), np.int64)
            root = connected(sets, alike)
            far = root != np.arange(len(own))
            out.append(pd.DataFrame({"a": own[far], "b": own[root[far]]}))
        return pd.concat(out) if out else pd.DataFrame({"a": np.zeros(0, np.int64), "b": np.zeros(0, np.int64)})

    texts = matching(own.where("id IS NOT NULL").select(F.col("id").alias("least"), "text"), clusters.select("least").distinct(), "least", "left_semi")
    verify = lambda where: where.join(texts, "least").groupBy("task").applyInPandas(verified, "a long, b long")
    found = materialise(verify(once), "jaccard-links")
    if placed.where("blocks > 1").take(1):
        # what the blocks and hubs have not joined to the largest group of its cluster meets all blocks of the cluster, part by part
        roots = materialise(components(found), "jaccard-roots")
        wide = placed.where("blocks > 1").join(roots.withColumnRenamed("root", "own"), "node", "left").withColumn("own", F.coalesce("own", "node"))
        most = wide.groupBy("root", "own").count().groupBy("root").agg(F.max(F.struct("count", "own")).alias("m")).select("root", F.col("m.own").alias("own"))
        apart = materialise(wide.join(most, ["root", "own"], "left_anti").select("root", "node", "least", "bytes", "blocks"), "jaccard-apart")
        parts = apart.groupBy("root").agg(F.greatest(F.ceil(F.count("*") / cluster_nodes), F.ceil(F.sum("bytes") / cluster_bytes), F.lit(1)).cast("int").alias("parts"))
        upto = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
        again = apart.join(parts, "root").withColumn("part", F.pmod(F.xxhash64("node"), "parts").cast("int")).select("root", "node", "least", upto("blocks").alias("block"), "part")
        affected = wide.join(parts, "root").select("root", "node", "least", "block", upto("parts").alias("part"))
        twice = again.unionByName(affected).distinct().select("root", "node", "least", F.concat_ws(" ", "root", "block", "part").alias("task"))
        found = materialise(found.unionByName(verify(twice)).distinct(), "jaccard-links")
    return signs, nodes, found


def similar(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = WIDTH, alike: tuple[int, int] = ALIKE, frequent: int = FREQUENT, held: int = HELD, cluster_nodes: int = CLUSTER_NODES, cluster_bytes: int = CLUSTER_BYTES) -> DataFrame:
    """(id_col, n_shingles, node, component_id): one row for each row of docs.

    node names the row's set of shingles of `width` words; component_id is the smallest id reachable over pairs of sets that
    share at least alike[0] / alike[1] of their union, itself included. A text with fewer words is one shingle; null and
    wordless texts have the empty set, which is linked with nothing: their component_id is their own id. Rows of one set are
    linked whatever their ids. A row without an id takes the component of the rows with its set, where one has an id; else its
    component_id is null. Texts of any length are read whole. Columns other than the two named take no part. No rows: no
    rows. Shingles are compared by 64-bit hashes.
    """
    own = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").alias("text"))
    signs, nodes, found = node_links(own, width, alike, None, frequent, held, cluster_nodes, cluster_bytes)
    roots = components(found)
    each = nodes.select("node", "least").join(roots, "node", "left").select("node", "least", F.coalesce("root", "node").alias("root"))
    of = each.join(each.groupBy("root").agg(F.min("least").alias("component_id")), "root").select("node", "component_id")
    out = signs.select("id", "node", "n").join(of, "node", "left")
    return out.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), "node", F.when(F.col("n") == 0, F.col("id")).otherwise(F.col("component_id")).alias("component_id"))
