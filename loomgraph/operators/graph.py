"""Neighbour graphs, weights, trees, folds and interpolation. Edges: (src, tgt[, weight]), undirected, src < tgt unless said otherwise."""

from __future__ import annotations

from collections import deque
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomgraph.operators.components import components
from loomgraph.operators.running import number_rows, running
from loomgraph.shared import materialise, release

#: Distances that agree to so many digits are ties, and ids decide.
DIGITS = 9


def both_ways(edges: DataFrame) -> DataFrame:
    rest = [c for c in edges.columns if c not in ("src", "tgt")]
    return edges.unionByName(edges.select(F.col("tgt").alias("src"), F.col("src").alias("tgt"), *rest))


def undirected(edges: DataFrame) -> DataFrame:
    """Each pair once, src < tgt, without self-loops; of rows of one pair that differ, the one whose other columns are greatest."""
    rest = [c for c in edges.columns if c not in ("src", "tgt")]
    pairs = edges.where("src <> tgt").select(F.least("src", "tgt").alias("src"), F.greatest("src", "tgt").alias("tgt"), *rest)
    if not rest:
        return pairs.distinct()
    if len(rest) == 1:
        return pairs.groupBy("src", "tgt").agg(F.max(rest[0]).alias(rest[0]))
    return pairs.groupBy("src", "tgt").agg(F.max(F.struct(*rest)).alias("_rest")).select("src", "tgt", *[F.col("_rest")[c].alias(c) for c in rest])


def unit_square(coords: DataFrame, keys: tuple[str, ...] = ()) -> DataFrame:
    """Coordinates less their minimum, both axes divided by the diagonal of the bounding box: that of all rows, or of each of the keys."""
    box = coords.groupBy(*keys).agg(F.min("x").alias("x0"), F.min("y").alias("y0"), F.max("x").alias("x1"), F.max("y").alias("y1"))
    side = F.sqrt(F.pow(F.col("x1") - F.col("x0"), 2) + F.pow(F.col("y1") - F.col("y0"), 2))
    met = coords.join(box, list(keys)) if keys else coords.crossJoin(F.broadcast(box))  # one row without keys
    return met.withColumns({"x": (F.col("x") - F.col("x0")) / side, "y": (F.col("y") - F.col("y0")) / side}).drop("x0", "y0", "x1", "y1")


def with_ends(edges: DataFrame, nodes: DataFrame, *values: str, key: str = "node") -> DataFrame:
    """Edges with the nodes' values at either end, as {value}_src and {value}_tgt."""
    for end in ("src", "tgt"):
        edges = edges.join(nodes.select(F.col(key).alias(end), *[F.col(v).alias(f"{v}_{end}") for v in values]), end)
    return edges


def squared_distance() -> Column:
    return F.pow(F.col("x_src") - F.col("x_tgt"), 2) + F.pow(F.col("y_src") - F.col("y_tgt"), 2)


def exp_weights(edges: DataFrame, coords: DataFrame, phi: float = 0.1) -> DataFrame:
    """weight = exp(-phi * squared distance) of each edge."""
    return with_ends(edges, coords, "x", "y").select("src", "tgt", F.exp(-phi * squared_distance()).alias("weight"))


def _curve(x_cuts: list[float], y_cuts: list[float], x: Column, y: Column) -> Column:
    """The place of a point on the Z-curve over the quantiles of x and y, so that dense and empty regions take equal parts of it."""

    @F.pandas_udf("long")
    def run(xs: pd.Series, ys: pd.Series) -> pd.Series:
        out = np.zeros(len(xs), np.int64)
        for k, (cuts, v) in enumerate(((x_cuts, xs), (y_cuts, ys))):
            at = np.searchsorted(np.asarray(cuts), v.to_numpy(float)).astype(np.int64)
            for bit in range(int(len(cuts)).bit_length()):
                out |= (at >> bit & 1) << (2 * bit + k)
        return pd.Series(out)

    return run(x, y)


def _gap(a: str, b: str, axis: str, far: bool) -> Column:
    """Least (or greatest) distance along an axis of two boxes, whose columns begin with a and b."""
    lo = lambda s: F.col(f"{s}{axis}0")
    hi = lambda s: F.col(f"{s}{axis}1")
    if far:
        return F.greatest(hi(b) - lo(a), hi(a) - lo(b))
    return F.greatest(F.lit(0.0), lo(b) - hi(a), lo(a) - hi(b))


def _between(a: str, b: str, far: bool) -> Column:
    return F.sqrt(F.pow(_gap(a, b, "x", far), 2) + F.pow(_gap(a, b, "y", far), 2))


def nearest(coords: DataFrame, k: int = 1, leaf: int | None = None, fan: int = 16) -> DataFrame:
    """(src, tgt, rank, distance): each node's k nearest other nodes, ties by id.

    Nodes at one place form a site, which keeps its k + 1 smallest ids, so a crowd at one place is never paired with
    itself. Sites are numbered along a Z-curve over the quantiles of both axes; runs of `leaf` of them are the leaves of a
    tree, runs of `fan` nodes the nodes above, so its depth follows from the count whatever the places are. Each leaf goes
    down the tree by joins, keeping the nodes that may hold a neighbour: those no farther than the least distance within
    which others surely hold k + 1 sites. A site meets the sites of the leaves kept that its own leaf's sites do not rule out.
    """
    coords = coords.where("x IS NOT NULL AND y IS NOT NULL AND NOT isnan(x) AND NOT isnan(y)").select("node", "x", "y")
    leaf = leaf or 2 * (k + 1)
    rank = F.row_number().over(Window.partitionBy("x", "y").orderBy("node"))
    few = coords.withColumn("r", rank).where(F.col("r") <= k + 1)
    sites = materialise(few.groupBy("x", "y").agg(F.sort_array(F.collect_list("node")).alias("ids")), "sites")
    probs = [i / 256 for i in range(1, 256)]
    box = sites.agg(F.count("*").alias("n"), *[F.percentile_approx(c, probs, 10_000).alias(c) for c in ("x", "y")]).first()
    if not box["n"]:
        return coords.select(F.col("node").alias("src"), F.col("node").alias("tgt"), F.lit(1).alias("rank"), F.lit(0.0).alias("distance")).limit(0)
    curve = sites.withColumn("z", _curve(box["x"], box["y"], F.col("x"), F.col("y")))
    placed = number_rows(curve, "z", "x", "y", name="pos").select("x", "y", "ids", F.floor(F.col("pos") / leaf).alias("leaf"))
    placed = materialise(placed, "sites-placed")
    boxes = [F.min("x").alias("x0"), F.max("x").alias("x1"), F.min("y").alias("y0"), F.max("y").alias("y1"), F.count("*").alias("n")]
    leaves = materialise(placed.groupBy("leaf").agg(*boxes), "leaves")
    levels, count = [leaves.withColumnRenamed("leaf", "id")], -(-box["n"] // leaf)
    while count > fan:
        up = levels[-1].groupBy(F.floor(F.col("id") / fan).alias("id")).agg(*[f(c).alias(c) for f, c in ((F.min, "x0"), (F.max, "x1"), (F.min, "y0"), (F.max, "y1"), (F.sum, "n"))])
        levels.append(up)
        count = -(-count // fan)
    # each row meets hundreds in the joins below, so rows are dealt by their number: by bytes they would all be one task's
    parts = -(-box["n"] // 4096)
    own = leaves.select("leaf", *[F.col(c).alias(f"a_{c}") for c in ("x0", "x1", "y0", "y1")]).repartition(parts, "leaf")
    held = lambda level: level.select("id", *[F.col(c).alias(f"b_{c}") for c in ("x0", "x1", "y0", "y1")], F.col("n").alias("b_n"))
    met = own.crossJoin(F.broadcast(held(levels[-1])))  # at most `fan` nodes on the right
    for level in [*reversed(levels[:-1]), None]:
        # the least distance within which nodes that lie there whole hold enough sites
        met = met.withColumns({"near": _between("a_", "b_", False), "far": _between("a_", "b_", True)})
        sure = F.sum("b_n").over(Window.partitionBy("leaf").orderBy("far").rangeBetween(Window.unboundedPreceding, 0))
        met = met.withColumn("sure", F.when(sure >= k + 1, F.col("far")))
        reach = F.coalesce(F.min("sure").over(Window.partitionBy("leaf")), F.lit(float("inf")))
        met = met.withColumn("reach", reach).where(F.col("near") <= F.col("reach") * (1 + 1e-12) + 2 * 10.0**-DIGITS)
        if level is not None:
            below = held(level).withColumn("up", F.floor(F.col("id") / fan))
            met = met.select("leaf", *own.columns[1:], F.col("id").alias("up")).join(below, "up")
    pairs = materialise(met.select("leaf", F.col("id").alias("other"), *[f"b_{c}" for c in ("x0", "x1", "y0", "y1")]), "leaf-pairs")

    d = F.round(F.sqrt(F.pow(F.col("x") - F.col("tx"), 2) + F.pow(F.col("y") - F.col("ty"), 2)), DIGITS)
    asked = placed.select("leaf", "x", "y").repartition(parts, "leaf")
    other = placed.select(F.col("leaf").alias("other"), F.col("x").alias("tx"), F.col("y").alias("ty"), "ids")
    best = F.row_number().over(Window.partitionBy("x", "y").orderBy("distance", "tgt"))
    top = lambda met: met.withColumn("r", best).where(F.col("r") <= k + 1).drop("r")
    first = top(asked.join(other.withColumnRenamed("other", "leaf"), "leaf").select("x", "y", d.alias("distance"), F.explode("ids").alias("tgt")))
    far = first.groupBy("x", "y").agg(F.count("*").alias("c"), F.max("distance").alias("far")).select("x", "y", F.when(F.col("c") > k, F.col("far")).alias("far"))
    site = asked.join(far, ["x", "y"], "left").withColumns({"s_x0": F.col("x"), "s_x1": F.col("x"), "s_y0": F.col("y"), "s_y1": F.col("y")})
    open_ = site.join(pairs, "leaf").where(F.col("far").isNull() | (_between("s_", "b_", False) <= F.col("far") * (1 + 1e-12) + 2 * 10.0**-DIGITS)).select("x", "y", "other").repartition(parts, "other")
    near = top(open_.join(other, "other").select("x", "y", d.alias("distance"), F.explode("ids").alias("tgt")))
    lists = near.groupBy("x", "y").agg(F.sort_array(F.collect_list(F.struct("distance", "tgt"))).alias("near"))
    mine = coords.join(lists, ["x", "y"])
    kept = F.slice(F.filter("near", lambda v: v["tgt"] != F.col("node")), 1, k)
    return materialise(mine.select(F.col("node").alias("src"), F.posexplode(kept).alias("p", "v")).select("src", F.col("v.tgt").alias("tgt"), (F.col("p") + 1).alias("rank"), F.col("v.distance").alias("distance")), "knn")


def rbf_graph(coords: DataFrame, k: int = 5, phi: float = 0.1) -> DataFrame:
    """(src, tgt, weight), both directions: exp(-phi d^2) to the k nearest, averaged with its transpose (one-sided: half)."""
    near = nearest(coords, k).select("src", "tgt", (F.exp(-phi * F.pow("distance", 2)) / 2).alias("weight"))
    return both_ways(near).groupBy("src", "tgt").agg(F.sum("weight").alias("weight"))


def within_radius(anchors: DataFrame, points: DataFrame, radius: float, axes: tuple[str, ...] = ("x", "y"), keys: tuple[str, ...] = ()) -> DataFrame:
    """(keys, anchor, node) of all points within the radius of each anchor, itself included if it is a point.

    Both are dealt into cells of the radius; an anchor looks into its 3^d cells, so the join is on equal cells.
    """
    cell = lambda p: F.array(*[F.floor(F.col(a) / radius).cast("long") for a in axes])
    steps = [[]]
    for _ in axes:
        steps = [[*s, i] for s in steps for i in (-1, 0, 1)]
    around = F.explode(F.array(*[F.zip_with(F.col("_c"), F.array(*[F.lit(i).cast("long") for i in s]), lambda a, b: a + b) for s in steps]))
    left = anchors.withColumn("_c", cell(anchors)).select(*keys, F.col("node").alias("anchor"), *[F.col(a).alias(f"_{a}") for a in axes], around.alias("_at"))
    right = points.withColumn("_at", cell(points)).select(*keys, "node", *axes, "_at")
    d2 = reduce(lambda s, t: s + t, [F.pow(F.col(a) - F.col(f"_{a}"), 2) for a in axes])
    return left.join(right, [*keys, "_at"]).where(d2 <= radius * radius).select(*keys, "anchor", "node")


def neighbourhood(anchors: DataFrame, points: DataFrame, radius: float, features: list[Column], axes: tuple[str, ...] = ("x", "y"), keys: tuple[str, ...] = ()) -> DataFrame:
    """(keys, anchor, features): aggregates, given as Columns over the points' own columns, of each anchor's neighbourhood.

    Anchors without neighbours vanish; without any neighbour at all there are no rows.
    """
    met = within_radius(anchors, points, radius, axes, keys)
    return met.join(points, [*keys, "node"]).groupBy(*keys, "anchor").agg(*features)


def shared_counts(items: DataFrame, size: int, top: int = 5, neighbours: DataFrame | None = None, held: int = 1000) -> DataFrame:
    """(src, tgt, shared, similarity, rank): each node's `top` most similar nodes by shared tokens, c / (size - c), ties by tgt.

    items: (node, token[, group]); neighbours: (group, other) pairs of groups that may meet. Nodes without a shared token
    have no edge. Tokens of at most `held` nodes meet by an equal join, so the work is linear in the rows. More frequent
    ones are read last and never joined with themselves: a pair met already asks how many of them it shares only if that can
    bring it among the `top`, and a node for which they alone could make a better pair meets, of the nodes with one and the
    same set of frequent tokens, those with the smallest ids, as no other of them can come before these. Without frequent
    tokens and groups, see _few_shared().
    """
    own = items.select("node", "token", *(["group"] if neighbours is not None else [F.lit(0).alias("group")])).dropDuplicates(["node", "token"])
    many = own.groupBy("token").agg(F.count("*").alias("c")).where(F.col("c") > held).select("token")
    many = materialise(many, "shared-frequent")
    some = bool(many.take(1))
    own = materialise(own, "shared-items") if some else own  # read several times
    rare = own.join(many, "token", "left_anti") if some else own
    allowed = None if neighbours is None else neighbours.select(F.col("group").alias("src_group"), F.col("other").alias("tgt_group")).distinct()

    def meeting(left: DataFrame, right: DataFrame, by: str) -> DataFrame:
        a, b = left.withColumnsRenamed({"node": "src", "group": "src_group"}), right.withColumnsRenamed({"node": "tgt", "group": "tgt_group"})
        return a.join(b, by) if allowed is None else a.join(allowed, "src_group").join(b, [by, "tgt_group"])

    if not some and allowed is None:
        shared = _few_shared(own.select("node", "token"), top)
    else:
        shared = meeting(rare, rare, "token").where("src <> tgt").groupBy("src", "tgt").agg(F.count("*").alias("shared"))
    if some:
        shared = materialise(shared, "shared-rare")
        often = own.join(many, "token", "left_semi").groupBy("node", "group").agg(F.sort_array(F.collect_list("token")).alias("often"))
        often = materialise(often, "shared-often")
        size_of = often.select(F.col("node").alias("src"), F.size("often").alias("more"))
        place = F.row_number().over(Window.partitionBy("src").orderBy(F.desc("shared"), "tgt"))
        least = shared.withColumn("r", place).where(F.col("r") == top).select("src", F.col("shared").alias("least"))
        # nodes whose frequent tokens alone may bring a node among their best
        open_ = often.join(least.withColumnRenamed("src", "node"), "node", "left").withColumn("least", F.coalesce("least", F.lit(0))).where(F.size("often") >= F.col("least"))
        head = F.row_number().over(Window.partitionBy("group", "often").orderBy("node"))
        heads = often.withColumn("r", head).where(F.col("r") <= top + 1)
        kinds = materialise(heads.groupBy("group", "often").agg(F.collect_list("node").alias("nodes")), "shared-kinds")
        met = meeting(open_.select("node", "group", "least", F.explode("often").alias("token")), kinds.select(F.struct("group", "often").alias("node"), "group", "nodes", F.explode("often").alias("token")), "token")
        alone = met.groupBy("src", "tgt").agg(F.count("*").alias("c"), F.first("least").alias("least"), F.first("nodes").alias("nodes")).where(F.col("c") >= F.col("least"))
        alone = alone.select("src", F.explode("nodes").alias("tgt")).where("src <> tgt").join(shared.select("src", "tgt"), ["src", "tgt"], "left_anti").withColumn("shared", F.lit(0).cast("long"))
        # of the pairs met, those that stay among the best whatever the others share
        bound = shared.join(least, "src", "left").join(size_of, "src", "left").where(F.col("shared") + F.coalesce("more", F.lit(0)) >= F.coalesce("least", F.lit(0))).select("src", "tgt", "shared")
        each = bound.unionByName(alone)
        for end in ("src", "tgt"):
            each = each.join(often.select(F.col("node").alias(end), F.col("often").alias(f"often_{end}")), end, "left")
        shared = each.select("src", "tgt", (F.col("shared") + F.coalesce(F.size(F.array_intersect("often_src", "often_tgt")), F.lit(0))).cast("long").alias("shared"))
    rank = F.row_number().over(Window.partitionBy("src").orderBy(F.desc("shared"), "tgt"))
    return shared.withColumn("rank", rank).where(F.col("rank") <= top).withColumn("similarity", F.col("shared") / (F.lit(size) - F.col("shared")))


def _few_shared(items: DataFrame, top: int, short: int = 16) -> DataFrame:
    """(src, tgt, shared): every pair that can be among the `top` of src, with all the tokens that it shares; items: (node, token), distinct.

    Most pairs share one token. Of the nodes of a token, such a pair can only be among the best of src with the `top` smallest
    others, as each of these shares a token with src too. Pairs that share s > 1 tokens meet in s (s - 1) / 2 pairs of tokens; a
    node of more than `short` tokens has too many of these, so it meets by its tokens.
    """
    items = materialise(items.where("node IS NOT NULL AND token IS NOT NULL"), "shared-items")
    place = F.row_number().over(Window.partitionBy("token").orderBy("node"))
    heads = items.withColumn("r", place).where(F.col("r") <= top + 1).select("token", F.col("node").alias("tgt"))
    once = items.withColumnRenamed("node", "src").join(heads, "token").where("src <> tgt").select("src", "tgt", F.lit(1).cast("long").alias("shared"))
    sets = items.groupBy("node").agg(F.sort_array(F.collect_list("token")).alias("own")).where(F.size("own") > 1)
    sets = materialise(sets, "shared-sets")
    two = sets.where(F.size("own") <= short).select("node", F.posexplode("own").alias("at", "a"), "own")
    two = two.select("node", "a", F.explode(F.slice("own", F.col("at") + 2, short)).alias("b"))
    # a pair of tokens that one node holds links nothing
    linked = two.groupBy("a", "b").agg(F.sort_array(F.collect_list("node")).alias("nodes")).where(F.size("nodes") > 1)
    ends = linked.select(F.posexplode("nodes").alias("at", "src"), "nodes")
    met = ends.select("src", F.explode(F.slice("nodes", F.col("at") + 2, F.size("nodes"))).alias("tgt"))
    more = met.groupBy("src", "tgt").agg(F.count("*").alias("c")).select("src", "tgt", ((1 + F.sqrt(1 + 8 * F.col("c"))) / 2).cast("long").alias("shared"))
    wide = sets.where(F.size("own") > short).select("node")
    if wide.take(1):
        long_ = items.join(wide, "node", "left_semi").withColumnRenamed("node", "src")
        other = items.join(wide.withColumn("_wide", F.lit(True)), "node", "left").withColumnRenamed("node", "tgt")
        # two wide nodes meet once
        met = long_.join(other, "token").where("src <> tgt AND (_wide IS NULL OR src < tgt)")
        more = more.unionByName(met.groupBy("src", "tgt").agg(F.count("*").alias("shared")).where("shared > 1"))
    more = more.unionByName(more.select(F.col("tgt").alias("src"), F.col("src").alias("tgt"), "shared"))
    return once.unionByName(more).groupBy("src", "tgt").agg(F.max("shared").alias("shared"))


def with_isolated(nodes: DataFrame, roots: DataFrame) -> DataFrame:
    """(node, root) of all nodes; a node without edges is its own root."""
    return nodes.select("node").join(roots, "node", "left").select("node", F.coalesce("root", "node").alias("root"))


def component_of(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """(node, root): each node's component, named by its least node."""
    return with_isolated(nodes, components(edges.select(F.col("src").alias("a"), F.col("tgt").alias("b"))))


def packed(sizes: DataFrame, limit: int) -> DataFrame:
    """(root, part): components (root, count) dealt into groups of less than `limit` nodes besides their first component."""
    dealt = running(sizes.select("root", F.col("count").cast("long").alias("count")), ["root"], ["count"])
    return materialise(dealt.select("root", F.floor(F.col("before_count") / limit).cast("long").alias("part")), "packed")


def _levels(n: int, src: np.ndarray, tgt: np.ndarray, start: np.ndarray) -> np.ndarray:
    """Breadth-first distance of each node from the nearest of the start nodes."""
    a, b = np.concatenate([src, tgt]), np.concatenate([tgt, src])
    order = np.argsort(a, kind="stable")
    b, first = b[order], np.searchsorted(a[order], np.arange(n + 1))
    hop, front, level = np.full(n, -1, np.int32), start, 0
    while len(front):
        hop[front] = level
        size = first[front + 1] - first[front]
        at = np.repeat(first[front], size) + np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
        front = np.unique(b[at])
        front = front[hop[front] < 0]
        level += 1
    return hop


def hops(edges: DataFrame, nodes: DataFrame, roots: DataFrame | None = None, largest: int = 200_000) -> DataFrame:
    """(node, root, hop): breadth-first distance from each component's least node.

    Components of up to `largest` nodes are walked in tasks, packed by size. In larger ones, chains of nodes with two
    neighbours are cut out first, by pointers that double in each round, so a round of the walk crosses a whole chain; the
    walk takes as many rounds as the paths have branching nodes.
    """
    roots = materialise(component_of(edges, nodes) if roots is None else roots, "roots")
    own = materialise(undirected(edges.select("src", "tgt")), "edges")
    sizes = materialise(roots.groupBy("root").count(), "sizes")
    parts = packed(sizes.where(F.col("count") <= largest), largest)
    held = materialise(roots.join(parts, "root"), "held")
    linked = materialise(own.join(held.select(F.col("node").alias("src"), "part"), "src").select("part", "src", "tgt"), "linked")
    kind = roots.schema["node"].dataType.simpleString()

    def walked(pdf: pd.DataFrame, e: pd.DataFrame) -> pd.DataFrame:
        if not len(pdf):
            return pd.DataFrame({"node": [], "root": [], "hop": []})
        pdf = pdf.sort_values("node")
        ids = pdf["node"].to_numpy()
        hop = _levels(len(ids), np.searchsorted(ids, e["src"].to_numpy()), np.searchsorted(ids, e["tgt"].to_numpy()), np.flatnonzero((pdf["node"] == pdf["root"]).to_numpy()))
        return pd.DataFrame({"node": ids, "root": pdf["root"].to_numpy(), "hop": hop})

    small = held.groupBy("part").cogroup(linked.groupBy("part")).applyInPandas(walked, f"node {kind}, root {kind}, hop int")
    large = roots.join(sizes.where(F.col("count") > largest).select("root"), "root").select("node", "root")
    if not sizes.where(F.col("count") > largest).take(1):
        return materialise(small, "hops")
    return materialise(small.unionByName(_hops_by_chains(own, materialise(large, "large"))), "hops")


def _hops_by_chains(edges: DataFrame, roots: DataFrame) -> DataFrame:
    """hops() of (node, root) by rounds of joins; edges: each pair once."""
    both = both_ways(edges).join(roots.select(F.col("node").alias("src")), "src", "left_semi")
    both = materialise(both, "both")
    degree = both.groupBy(F.col("src").alias("node")).count()
    inner = materialise(degree.join(roots, "node").where("count = 2 AND node <> root").select("node"), "inner")
    # a dart leaves a node of a chain for a neighbour; it goes on from there unless that is no node of a chain
    marked = both.join(inner.select(F.col("node").alias("src"), F.lit(True).alias("from_inner")), "src", "left").join(inner.select(F.col("node").alias("tgt"), F.lit(True).alias("to_inner")), "tgt", "left")
    marked = materialise(marked.select("src", "tgt", F.col("from_inner").isNotNull().alias("from_inner"), F.col("to_inner").isNotNull().alias("to_inner")), "marked")
    darts = marked.where("from_inner")
    onward = darts.select(F.col("src").alias("tgt"), F.col("tgt").alias("beyond"))
    going = darts.where("to_inner").join(onward, "tgt").where("beyond <> src").select("src", "tgt", F.col("tgt").alias("at"), F.col("beyond").alias("to"), F.lit(1).cast("long").alias("far"), F.lit(None).cast(edges.schema["src"].dataType).alias("end"))
    done = darts.where("NOT to_inner").select("src", "tgt", F.lit(None).cast(edges.schema["src"].dataType).alias("at"), F.lit(None).cast(edges.schema["src"].dataType).alias("to"), F.lit(1).cast("long").alias("far"), F.col("tgt").alias("end"))
    now = materialise(going.unionByName(done), "darts")
    while now.where("end IS NULL").take(1):
        next_ = now.select(F.col("src").alias("at"), F.col("tgt").alias("to"), F.col("at").alias("at2"), F.col("to").alias("to2"), F.col("far").alias("far2"), F.col("end").alias("end2"))
        step = now.where("end IS NULL").join(next_, ["at", "to"]).select("src", "tgt", F.col("at2").alias("at"), F.col("to2").alias("to"), (F.col("far") + F.col("far2")).alias("far"), F.col("end2").alias("end"))
        new = materialise(step.unionByName(now.where("end IS NOT NULL")), "darts")
        release(now)
        now = new
    # chains as edges of their length, besides the edges between other nodes
    pairs = now.select("src", F.struct("end", "far").alias("e"), "tgt").groupBy("src").agg(F.sort_array(F.collect_list("e")).alias("e"))
    chains = pairs.select(F.col("e")[0]["end"].alias("a"), F.col("e")[1]["end"].alias("b"), (F.col("e")[0]["far"] + F.col("e")[1]["far"]).alias("far"))
    direct = marked.where("NOT from_inner AND NOT to_inner").select(F.col("src").alias("a"), F.col("tgt").alias("b"), F.lit(1).cast("long").alias("far"))
    links = chains.unionByName(chains.select(F.col("b").alias("a"), F.col("a").alias("b"), "far")).unionByName(direct)
    links = materialise(links.groupBy("a", "b").agg(F.min("far").alias("far")), "links")
    known = materialise(roots.where("node = root").select("node", F.lit(0).cast("long").alias("hop")), "known")
    front = known
    while front.take(1):
        step = front.withColumnRenamed("node", "a").join(links, "a").groupBy(F.col("b").alias("node")).agg(F.min(F.col("hop") + F.col("far")).alias("new"))
        better = materialise(step.join(known, "node", "left").where("hop IS NULL OR new < hop").select("node", F.col("new").alias("hop")), "better")
        front, before = better, known
        known = materialise(known.join(better.select("node"), "node", "left_anti").unionByName(better), "known")
        release(before)
    ends = now.join(known.withColumnRenamed("node", "end"), "end").groupBy(F.col("src").alias("node")).agg(F.min(F.col("hop") + F.col("far")).alias("hop"))
    found = known.join(inner, "node", "left_anti").unionByName(ends)
    return roots.join(found, "node").select("node", "root", F.col("hop").cast("int").alias("hop"))


def tree_folds(edges: DataFrame, nodes: DataFrame, folds: int = 5) -> DataFrame:
    """(node, root, hop, fold): depth in the breadth-first tree, a spanning tree under unit lengths, modulo `folds`."""
    return hops(edges, nodes).withColumn("fold", F.col("hop") % folds)


def random_folds(nodes: DataFrame, folds: int, seed: int = 1) -> DataFrame:
    """(node, fold): folds whose sizes differ by one at most, dealt in the order of a digest of seed and node."""
    order = F.md5(F.concat_ws("/", F.lit(str(seed)), F.col("node").cast("string")))
    dealt = number_rows(nodes.select("node").withColumn("_order", order), "_order", "node", name="_pos")
    return dealt.select("node", F.pmod("_pos", F.lit(folds)).cast("int").alias("fold"))


def interpolated(values: DataFrame, edges: DataFrame, folds: DataFrame, fold: int | None = None) -> DataFrame:
    """(node, fold, term, x): the mean over each node's neighbours of other folds, zeros included; none: no rows.

    values: (node, term, x) in long form. fold: only that fold's nodes.
    """
    f = folds.select("node", "fold")
    ends = with_ends(both_ways(edges.select("src", "tgt")), f, "fold").where("fold_src <> fold_tgt")
    if fold is not None:
        ends = ends.where(F.col("fold_src") == fold)
    n = ends.groupBy("src").agg(F.count("*").alias("neighbours"))
    sums = ends.join(values.select(F.col("node").alias("tgt"), "term", "x"), "tgt").groupBy("src", "fold_src", "term").agg(F.sum("x").alias("s"))
    return sums.join(n, "src").select(F.col("src").alias("node"), F.col("fold_src").alias("fold"), "term", (F.col("s") / F.col("neighbours")).alias("x"))


def jump(edges: DataFrame, values: DataFrame) -> DataFrame:
    """One row: sum over edges of |x_src - x_tgt| * sqrt(weight), by the number of nodes. values: (node, v: array)."""
    norm = F.sqrt(F.aggregate(F.zip_with("v_src", "v_tgt", lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda s, x: s + x))
    total = with_ends(edges, values, "v").agg(F.coalesce(F.sum(norm * F.sqrt("weight")), F.lit(0.0)).alias("total"))
    return total.crossJoin(values.agg(F.count("*").alias("n"))).select((F.col("total") / F.col("n")).alias("jump"))


# trees and Voronoi neighbours of samples

Frame = tuple[float, float, float]  # the middle of a sample's box and its longer side


def _triangles(px: np.ndarray, py: np.ndarray, frame: Frame) -> tuple[np.ndarray, np.ndarray]:
    """Corners, and (x, y, squared radius) of the circles, of the Delaunay triangles of distinct places, added in their order.

    Three corners far outside the frame, numbered from len(px), close the triangulation.
    """
    n, (mx, my, span) = len(px), frame
    span = max(span, 1e-9)
    qx = np.concatenate([px.astype(float), [mx - 3e3 * span, mx, mx + 3e3 * span]])
    qy = np.concatenate([py.astype(float), [my - 3e3 * span, my + 3e3 * span, my - 3e3 * span]])
    xs, ys = qx.tolist(), qy.tolist()

    def circle(a: int, b: int, c: int) -> tuple[float, float, float]:
        bx, by, cx, cy = xs[b] - xs[a], ys[b] - ys[a], xs[c] - xs[a], ys[c] - ys[a]
        d = 2 * (bx * cy - by * cx)
        if d == 0:
            return xs[a], ys[a], np.inf
        ux, uy = (cy * (bx * bx + by * by) - by * (cx * cx + cy * cy)) / d, (bx * (cx * cx + cy * cy) - cx * (bx * bx + by * by)) / d
        return xs[a] + ux, ys[a] + uy, ux * ux + uy * uy

    # places of removed triangles are taken by new ones; a place without one has radius -1 and is never hit
    tri, round_ = np.zeros((2 * n + 8, 3), np.int64), np.full((3, 2 * n + 8), -1.0)
    tri[0], round_[:, 0], used = (n, n + 1, n + 2), circle(n, n + 1, n + 2), 1
    for i in range(n):
        c = round_[:, :used]
        hit = np.flatnonzero((c[0] - xs[i]) ** 2 + (c[1] - ys[i]) ** 2 < c[2] * (1 - 1e-12))
        edge: dict[tuple[int, int], int] = {}
        for a, b, d in tri[hit].tolist():
            for e in ((a, b), (b, d), (a, d)):
                edge[e] = edge.get(e, 0) + 1
        new = [sorted((*e, i)) for e, times in edge.items() if times == 1]
        if used + len(new) > len(tri):
            tri, round_ = np.concatenate([tri, np.zeros_like(tri)]), np.concatenate([round_, np.full_like(round_, -1.0)], axis=1)
        at = [*hit.tolist(), *range(used, used + len(new) - len(hit))]
        round_[2, at[len(new) :]] = -1.0
        for k, t in zip(at, new, strict=False):
            tri[k], round_[:, k] = t, circle(*t)
        used = max(used, used + len(new) - len(hit))
    live = round_[2, :used] >= 0
    return tri[:used][live], round_[:, :used].T[live]


def delaunay(x: np.ndarray, y: np.ndarray) -> set[tuple[int, int]]:
    """Neighbour pairs of the Delaunay triangulation (positions); coincident points are linked to the first of them."""
    place: dict[tuple[float, float], int] = {}
    pairs: set[tuple[int, int]] = set()
    own = []
    for i, p in enumerate(zip(x.tolist(), y.tolist(), strict=True)):
        if p in place:
            pairs.add((place[p], i))
        else:
            place[p] = i
            own.append(i)
    if len(own) < 2:
        return pairs
    px, py = x[own].astype(float), y[own].astype(float)
    tri, _ = _triangles(px, py, ((px.min() + px.max()) / 2, (py.min() + py.max()) / 2, max(np.ptp(px), np.ptp(py))))
    for a, b, c in tri.tolist():
        for u, v in ((a, b), (b, c), (a, c)):
            if v < len(own):
                pairs.add((own[u], own[v]))
    return pairs


_BOX = ("x0", "x1", "y0", "y1")


def _tree_levels(leaves: DataFrame, count: int, fan: int) -> list[DataFrame]:
    """Boxes (id, s0, s1, x0, x1, y0, y1) of runs of leaves, of runs of those and so on, the last level with `fan` or fewer."""
    levels = [leaves.select(F.col("leaf").alias("id"), F.col("sample").alias("s0"), F.col("sample").alias("s1"), *_BOX)]
    while count > fan:
        outer = [f(c).alias(c) for f, c in ((F.min, "s0"), (F.max, "s1"), (F.min, "x0"), (F.max, "x1"), (F.min, "y0"), (F.max, "y1"))]
        levels.append(levels[-1].groupBy(F.floor(F.col("id") / fan).alias("id")).agg(*outer))
        count = -(-count // fan)
    return levels


def _down(asked: DataFrame, levels: list[DataFrame], fan: int, keep) -> DataFrame:
    """asked, which has a sample, with the ids of the leaves that `keep` leaves over on each level of the tree."""
    met = asked.withColumn("id", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(fan - 1).cast("long"))))
    for k, level in enumerate(reversed(levels)):
        if k:
            met = met.withColumn("id", F.explode(F.sequence(F.col("id") * fan, F.col("id") * fan + fan - 1)))
        met = keep(met.join(level, "id").where("sample BETWEEN s0 AND s1")).select(*asked.columns, "id")
    return met


def tiled_delaunay(coords: DataFrame, tile: int = 512, fan: int = 16) -> DataFrame:
    """(sample, src, tgt): delaunay() of samples of any size, over many tasks; coords: (sample, node, x, y).

    Sites are numbered along a curve; runs of `tile` of them are tiles, whose boxes form a tree. A tile triangulates its
    sites and those around its box. A triangle at one of its sites is right if no site lies in its circle; circles that
    reach beyond what the tile knows go down the tree, the sites found in them are added, and the tile triangulates again,
    until no circle holds a site. A circle that holds a whole box needs no other box in that round, so wide circles cost a
    path down the tree. Of four or more sites on one circle, which diagonals are pairs is open. Rows with a null sample, or
    a null or NaN coordinate, take no part.
    """
    coords = coords.where("sample IS NOT NULL AND x IS NOT NULL AND y IS NOT NULL AND NOT isnan(x) AND NOT isnan(y)").select("sample", "node", F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y"))
    sites = materialise(coords.groupBy("sample", "x", "y").agg(F.min("node").alias("node")), "sites")
    probs = [i / 256 for i in range(1, 256)]
    cuts = sites.agg(*[F.percentile_approx(c, probs, 10_000).alias(c) for c in ("x", "y")]).first()
    curve = sites.withColumn("z", _curve(cuts["x"] or [], cuts["y"] or [], F.col("x"), F.col("y")))
    numbered = materialise(number_rows(curve, "sample", "z", "x", "y", name="pos").withColumn("run", F.floor(F.col("pos") / tile)), "numbered")
    box = [F.min("x").alias("x0"), F.max("x").alias("x1"), F.min("y").alias("y0"), F.max("y").alias("y1")]
    frame = numbered.groupBy("sample").agg(*[c.alias(f"f{n}") for c, n in zip(box, _BOX, strict=True)])
    leaves = number_rows(numbered.groupBy("sample", "run").agg(*box, F.count("*").alias("n")), "sample", "run", name="leaf")
    leaves = materialise(leaves.join(frame, "sample"), "leaves")
    placed = materialise(numbered.join(leaves.select("sample", "run", "leaf"), ["sample", "run"]).select("leaf", "pos", "x", "y"), "placed")
    levels = _tree_levels(leaves, leaves.count(), fan)

    # what lies within a quarter of a tile's longer side, unless that is much: then the circles alone ask
    more = F.greatest(F.col("x1") - F.col("x0"), F.col("y1") - F.col("y0")) / 4
    around = leaves.select("sample", "leaf", (F.col("x0") - more).alias("kx0"), (F.col("x1") + more).alias("kx1"), (F.col("y0") - more).alias("ky0"), (F.col("y1") + more).alias("ky1"))
    near = materialise(_down(around, levels, fan, lambda m: m.where("x0 <= kx1 AND x1 >= kx0 AND y0 <= ky1 AND y1 >= ky0")), "near")
    few = near.join(leaves.select(F.col("leaf").alias("id"), "n"), "id").groupBy("leaf").agg(F.sum("n").alias("n")).where(F.col("n") <= 32 * tile).select("leaf")
    near = near.join(few, "leaf").where("id <> leaf")
    other = placed.select(F.col("leaf").alias("id"), "pos", "x", "y")
    halo = near.join(other, "id").where("x BETWEEN kx0 AND kx1 AND y BETWEEN ky0 AND ky1").select("leaf", "pos", "x", "y", F.lit(False).alias("own"))
    held = materialise(placed.withColumn("own", F.lit(True)).unionByName(halo), "held")
    known = [F.when(F.col("few"), F.col(f"k{c}")).alias(f"k{c}") for c in _BOX]
    about = materialise(leaves.select("sample", "leaf", *[f"f{c}" for c in _BOX]).join(around.drop("sample"), "leaf").join(few.withColumn("few", F.lit(True)), "leaf", "left").select("sample", "leaf", *[f"f{c}" for c in _BOX], *known), "about")

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("pos")
        pos, own, one = pdf["pos"].to_numpy(), np.append(pdf["own"].to_numpy(bool), [False] * 3), pdf.iloc[0]
        x0, x1, y0, y1 = (float(one[f"f{c}"]) for c in _BOX)
        tri, round_ = _triangles(pdf["x"].to_numpy(), pdf["y"].to_numpy(), ((x0 + x1) / 2, (y0 + y1) / 2, max(x1 - x0, y1 - y0)))
        mine = own[tri].any(1)
        tri, round_ = tri[mine], round_[mine]
        ends = np.concatenate([tri[:, [0, 1]], tri[:, [1, 2]], tri[:, [0, 2]]])
        ends = np.unique(ends[(ends[:, 1] < len(pos)) & own[ends[:, 0]]], axis=0)
        cx, cy, r = round_[:, 0], round_[:, 1], np.sqrt(round_[:, 2])
        # beyond the sample's box there is nothing; a tile without a halo knows no box, and NaN compares as false
        closed = (np.maximum(cx - r, x0) >= one["kx0"]) & (np.minimum(cx + r, x1) <= one["kx1"]) & (np.maximum(cy - r, y0) >= one["ky0"]) & (np.minimum(cy + r, y1) <= one["ky1"])
        ask = round_[~closed & np.isfinite(r)]
        none = np.zeros(len(ends))
        return pd.DataFrame({
            "leaf": np.int64(one["leaf"]),
            "a": np.append(pos[ends[:, 0]], np.full(len(ask), -1)), "b": np.append(pos[ends[:, 1]], np.full(len(ask), -1)),
            "cx": np.append(none, ask[:, 0]), "cy": np.append(none, ask[:, 1]), "r2": np.append(none, ask[:, 2]),
        })

    def touched(met: DataFrame) -> DataFrame:
        """Boxes that meet the circle; of those wholly within it, where there are any, the one that is so by most."""
        gap = lambda lo, hi, c: F.greatest(F.lit(0.0), F.col(lo) - F.col(c), F.col(c) - F.col(hi))
        far = lambda lo, hi, c: F.greatest(F.abs(F.col(lo) - F.col(c)), F.abs(F.col(hi) - F.col(c)))
        square = lambda of: F.pow(of("x0", "x1", "cx"), 2) + F.pow(of("y0", "y1", "cy"), 2)
        within = F.when((F.col("far") < F.col("r2") * (1 - 1e-9)) & F.expr("s0 = s1"), F.struct("far", "id"))
        least = F.min("within").over(Window.partitionBy("leaf", "cx", "cy", "r2"))
        return met.where(square(gap) <= F.col("r2")).withColumn("far", square(far)).withColumn("within", within).withColumn("least", least).where("least IS NULL OR least = within")

    edges, active = [], held
    while True:
        made = materialise(active.join(about.drop("sample"), "leaf").groupBy("leaf").applyInPandas(run, "leaf long, a long, b long, cx double, cy double, r2 double"), "tiles")
        asked = made.where("a < 0").select("leaf", "cx", "cy", "r2").distinct().join(about.select("leaf", "sample"), "leaf")
        inside = F.pow(F.col("x") - F.col("cx"), 2) + F.pow(F.col("y") - F.col("cy"), 2)
        hits = _down(asked, levels, fan, touched).join(other, "id").withColumn("d2", inside).where(F.col("d2") < F.col("r2") * (1 - 1e-12))
        hits = hits.join(active.select("leaf", "pos"), ["leaf", "pos"], "left_anti")
        deepest = hits.groupBy("leaf", "cx", "cy", "r2", "id").agg(F.min(F.struct("d2", "pos", "x", "y")).alias("s"))
        found = materialise(deepest.select("leaf", "s.pos", "s.x", "s.y", F.lit(False).alias("own")).distinct(), "found")
        again = found.select("leaf").distinct()
        edges.append(made.where("a >= 0").join(again, "leaf", "left_anti").select("a", "b"))
        if not found.take(1):
            break
        active = materialise(active.join(again, "leaf", "left_semi").unionByName(found), "held")
    names = numbered.select("pos", "node", "sample")
    pairs = reduce(DataFrame.unionByName, edges).join(names.toDF("a", "na", "sample"), "a").join(names.drop("sample").toDF("b", "nb"), "b")
    pairs = pairs.select("sample", F.least("na", "nb").alias("src"), F.greatest("na", "nb").alias("tgt")).distinct()
    twins = coords.join(sites.withColumnRenamed("node", "first"), ["sample", "x", "y"]).where("node <> first")
    return materialise(pairs.unionByName(twins.select("sample", F.col("first").alias("src"), F.col("node").alias("tgt"))), "delaunay")


def spanning_tree(n: int, edges: list[tuple[float, int, int]]) -> list[int]:
    """Positions in `edges` (length, a, b) of a minimum spanning forest, ties by position."""
    root = list(range(n))

    def find(i: int) -> int:
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    kept = []
    for k in sorted(range(len(edges)), key=lambda k: (edges[k][0], k)):
        a, b = find(edges[k][1]), find(edges[k][2])
        if a != b:
            root[max(a, b)] = min(a, b)
            kept.append(k)
    return kept


def voronoi_graph(coords: DataFrame, sample: str = "sample_id", tree: bool = True, largest: int = 5000, tile: int = 512) -> DataFrame:
    """(sample, src, tgt, distance): Voronoi neighbours in each sample, or only the minimum spanning tree among them.

    A row is also a row of the difference matrix: +1 at src, -1 at tgt. A sample of up to `largest` nodes is one task's;
    larger ones are triangulated in tiles of `tile` sites (tiled_delaunay) and their trees grown by rounds of joins. Nodes
    are distinct within a sample; rows with a null sample, or a null or NaN coordinate, take no part.
    """
    types = {f.name: f.dataType.simpleString() for f in coords.schema}
    coords = coords.where(f"`{sample}` IS NOT NULL AND x IS NOT NULL AND y IS NOT NULL AND NOT isnan(x) AND NOT isnan(y)").select(sample, "node", "x", "y")

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("node").reset_index(drop=True)
        x, y, ids = pdf["x"].to_numpy(float), pdf["y"].to_numpy(float), pdf["node"].to_numpy()
        pairs = sorted(delaunay(x, y))
        edges = [(float(np.hypot(x[a] - x[b], y[a] - y[b])), a, b) for a, b in pairs]
        if tree:
            edges = [edges[k] for k in spanning_tree(len(ids), edges)]
        return pd.DataFrame({sample: pdf[sample].iloc[0], "src": [ids[a] for _, a, _ in edges], "tgt": [ids[b] for _, _, b in edges], "distance": [d for d, _, _ in edges]})

    schema = f"{sample} {types[sample]}, src {types['node']}, tgt {types['node']}, distance double"
    wide = materialise(coords.groupBy(sample).count().where(F.col("count") > largest).select(sample), "wide")
    if not wide.take(1):
        return coords.groupBy(sample).applyInPandas(run, schema)
    small = coords.join(wide, sample, "left_anti").groupBy(sample).applyInPandas(run, schema)
    large = materialise(coords.join(wide, sample, "left_semi").select(F.col(sample).alias("sample"), "node", "x", "y"), "large")
    pairs = tiled_delaunay(large, tile)
    # nodes are distinct within a sample only, so trees grow on numbers
    numbered = materialise(number_rows(large, "sample", "node", name="at"), "numbered")
    end = lambda c: numbered.select("sample", F.col("node").alias(c), F.col("at").alias(f"{c}_at"), F.col("x").alias(f"{c}_x"), F.col("y").alias(f"{c}_y"))
    distance = F.sqrt(F.pow(F.col("src_x") - F.col("tgt_x"), 2) + F.pow(F.col("src_y") - F.col("tgt_y"), 2))
    found = materialise(pairs.join(end("src"), ["sample", "src"]).join(end("tgt"), ["sample", "tgt"]).withColumn("distance", distance), "pairs")
    if tree:
        grown = spanning_forest(found.select(F.col("src_at").alias("src"), F.col("tgt_at").alias("tgt"), F.col("distance").alias("weight")))
        found = found.join(grown.select(F.col("src").alias("src_at"), F.col("tgt").alias("tgt_at")), ["src_at", "tgt_at"], "left_semi")
    return small.unionByName(found.select(F.col("sample").alias(sample), "src", "tgt", "distance"))


def spanning_forest(edges: DataFrame, held: int = 200_000) -> DataFrame:
    """Minimum spanning forest of (src, tgt, weight) of any size by Boruvka rounds: each component takes its least edge.

    Ties go to the smaller (src, tgt). A round contracts the edges to its components, which at least halve, and keeps the least
    of parallel ones, so later rounds read less; up to `held` contracted edges are one task's. Components are followed along
    their least edges by doubling pointers. No table is broadcast, as each of these would pass through the driver.
    """
    edges = materialise(undirected(edges.select("src", "tgt", "weight")), "mst-edges")
    live, chosen = edges.select(F.col("src").alias("a"), F.col("tgt").alias("b"), F.struct("weight", "src", "tgt").alias("e")), []
    kind = edges.schema["src"].dataType.simpleString()

    def rest(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["known", "weight", "src", "tgt"])  # a null weight comes first, NaN last
        at, names = pd.factorize(np.concatenate([pdf["a"].to_numpy(), pdf["b"].to_numpy()]))
        n = len(pdf)
        kept = spanning_tree(len(names), list(zip(range(n), at[:n].tolist(), at[n:].tolist(), strict=True)))
        return pdf.iloc[kept][["src", "tgt"]]

    while live.limit(held + 1).count() > held:
        sides = live.select(F.col("a").alias("c"), "e", F.col("b").alias("up")).unionByName(live.select(F.col("b").alias("c"), "e", F.col("a").alias("up")))
        least = materialise(sides.groupBy("c").agg(F.min(F.struct("e", "up")).alias("m")).select("c", "m.up", F.col("m.e.src").alias("src"), F.col("m.e.tgt").alias("tgt")), "mst-least")
        chosen.append(least.select("src", "tgt"))
        above = lambda t: t.select(F.col("c").alias("up"), F.col("up").alias("top")).hint("merge")
        # two components that take one edge: the smaller stays
        roots = materialise(least.select("c", "up").join(above(least), "up").select("c", F.when((F.col("top") == F.col("c")) & (F.col("c") < F.col("up")), F.col("c")).otherwise(F.col("up")).alias("up")), "mst-roots")
        going = True
        while going:
            after = materialise(roots.join(above(roots), "up").select("c", F.col("top").alias("up"), (F.col("top") != F.col("up")).alias("moved")), "mst-roots")
            release(roots)
            roots, going = after.select("c", "up"), bool(after.where("moved").take(1))
        for end in ("a", "b"):
            live = live.join(roots.select(F.col("c").alias(end), F.col("up").alias(f"_{end}")).hint("merge"), end)
        pair = [F.least("_a", "_b").alias("a"), F.greatest("_a", "_b").alias("b")]
        live = materialise(live.where("_a <> _b").groupBy(*pair).agg(F.min("e").alias("e")), "mst-live")
    few = live.select("a", "b", "e.*").select(F.lit(0).alias("part"), "a", "b", "src", "tgt", F.col("weight").isNotNull().alias("known"), "weight")
    chosen.append(few.groupBy("part").applyInPandas(rest, f"src {kind}, tgt {kind}"))
    kept = reduce(DataFrame.unionByName, chosen).distinct()
    return materialise(edges.join(kept.hint("merge"), ["src", "tgt"]).select("src", "tgt", "weight"), "mst-chosen")


def edge_blocks(edges: DataFrame, block: int, hub: int = 1000, held: int = 200_000) -> DataFrame:
    """(part, src, tgt, weight): the edges dealt into blocks whose nodes' degrees sum to about `block`, neighbours together.

    Nodes of more than `hub` edges join no block of their own: each of their edges goes with its other end. The rest is
    contracted, tails into the heads they are linked with most, up to half a block, until `held` links are left; these are
    one task's, which grows regions in breadth.
    """
    degree = materialise(edges.select(F.explode(F.array("src", "tgt")).alias("node")).groupBy("node").agg((F.count("*") + 1).alias("size")), "degrees")
    low = degree.where(F.col("size") <= hub + 1)
    ends = edges.join(low.select(F.col("node").alias("src")), "src", "left_semi").join(low.select(F.col("node").alias("tgt")), "tgt", "left_semi")
    sizes, owner = low.withColumnRenamed("node", "c"), low.select("node", F.col("node").alias("c"))
    links = materialise(ends.groupBy(F.least("src", "tgt").alias("a"), F.greatest("src", "tgt").alias("b")).agg(F.count("*").alias("m")), "links")
    left, idle = links.count(), 0
    for it in range(40):
        if left <= held or idle == 3:
            break
        few = sizes.where(F.col("size") <= block / 2).withColumn("head", F.xxhash64("c", F.lit(it)) % 2 == 0)
        both = links.select("a", "b", "m").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"), "m"))
        met = both.join(few.where("NOT head").select(F.col("c").alias("a"), F.col("size").alias("own")), "a").join(few.where("head").select(F.col("c").alias("b"), "size"), "b")
        best = met.groupBy("a").agg(F.max(F.struct("m", F.xxhash64("b"), "b", "own", "size")).alias("to")).select("a", "to.b", "to.own", "to.size")
        so_far = F.sum("own").over(Window.partitionBy("b").orderBy("a"))  # at most the links of one head of half a block
        into = materialise(best.withColumn("total", so_far + F.col("size")).where(F.col("total") <= block).select(F.col("a").alias("c"), F.col("b").alias("to")), "into")
        moved = lambda df, c: df.join(into.select(F.col("c").alias(c), "to"), c, "left").withColumn(c, F.coalesce("to", c)).drop("to")
        new = moved(moved(links, "a"), "b").where("a <> b").groupBy(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).agg(F.sum("m").alias("m"))
        links, sizes, owner = materialise(new, "links"), materialise(moved(sizes, "c").groupBy("c").agg(F.sum("size").alias("size")), "sizes"), materialise(moved(owner, "c"), "owner")
        now = links.count()
        left, idle = now, idle + 1 if now == left else 0

    def regions(pdf: pd.DataFrame) -> pd.DataFrame:
        ids, at = np.unique(np.concatenate([pdf["a"], pdf["b"]]), return_inverse=True)
        a, b = at[: len(pdf)], at[len(pdf) :]
        size, of = np.zeros(len(ids), np.int64), np.full(len(ids), -1)
        size[a], size[b] = pdf["size_a"], pdf["size_b"]
        x, y = np.concatenate([a, b]), np.concatenate([b, a])
        y, first = y[np.argsort(x, kind="stable")], np.searchsorted(np.sort(x), np.arange(len(ids) + 1))
        for start in range(len(ids)):
            if of[start] >= 0:
                continue
            of[start], total, front = start, size[start], deque([start])
            while front:
                i = front.popleft()
                for j in y[first[i] : first[i + 1]]:
                    if of[j] < 0 and total + size[j] <= block:
                        of[j], total = start, total + size[j]
                        front.append(j)
        return pd.DataFrame({"c": ids, "to": ids[of]})

    if left <= held:
        asked = links.join(sizes.select(F.col("c").alias("a"), F.col("size").alias("size_a")), "a").join(sizes.select(F.col("c").alias("b"), F.col("size").alias("size_b")), "b")
        into = materialise(asked.withColumn("one", F.lit(0)).groupBy("one").applyInPandas(regions, "c long, to long"), "into")
        owner = owner.join(into, "c", "left").select("node", F.coalesce("to", "c").alias("c"))
    owner = materialise(owner, "owner")
    weighed = owner.join(low, "node").groupBy(F.col("c").alias("root")).agg(F.sum("size").alias("count"))
    part = materialise(owner.withColumnRenamed("c", "root").join(packed(weighed, block), "root").select("node", "part"), "parts")
    at = lambda e: part.select(F.col("node").alias(e), F.col("part").alias(f"p_{e}"))
    some = F.lit(max(1, (part.agg(F.max("part")).first()[0] or 0) + 1))
    own = F.coalesce("p_src", "p_tgt", F.pmod(F.xxhash64("src", "tgt"), some))
    return edges.join(at("src"), "src", "left").join(at("tgt"), "tgt", "left").select(own.alias("part"), "src", "tgt", "weight")
