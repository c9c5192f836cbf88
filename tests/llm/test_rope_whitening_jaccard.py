"""Fill-in-middle, whitening and the Jaccard join against brute force and on odd rows."""

from __future__ import annotations

import random
import re

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

pytest.importorskip("loomgraph.llm")
from oracle import compare

from loomgraph.llm import fim, jaccard, whitening
from loomgraph.llm.queries import ORACLE_SQL, QUERIES

# fill-in-middle

UNITS = re.compile(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+")


def plainly(text, key):
    u = UNITS.findall(text)
    h = fim.draws(key)
    if not text or any(s in text for s in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 50:
        return len(u), "plain", None, None, text
    a, b = sorted((h[0] % (len(u) + 1), h[1] % (len(u) + 1)))
    p, m, s = "".join(u[:a]), "".join(u[a:b]), "".join(u[b:])
    if h[3] % 100 < 80:
        return len(u), "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}"
    return len(u), "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}"


@settings(max_examples=400, deadline=None)
@given(st.lists(st.sampled_from(["a", "é😀", " ", "\n", "\x1c", "\xa0", "<", "<P", "S>", "M>", "word ", "  ", "x " * 70]), max_size=40).map("".join), st.integers(0, 10_000))
def test_fim_equals_list_slicing_and_inverts(text, key):
    made = fim.transform(text, key)
    assert made == plainly(text, key) and fim.inverted(made[4], made[1]) == text


def _sound(r):
    if r.left is None:
        return r.height == 0 and r.chars == len(r.text)
    return abs(r.left.height - r.right.height) <= 1 and r.height == 1 + max(r.left.height, r.right.height) and r.units == r.left.units + r.right.units and r.chars == r.left.chars + r.right.chars and _sound(r.left) and _sound(r.right)


def test_fim_ropes_stay_balanced_and_cut_one_leaf():
    text = " ".join(f"word{i}" for i in range(20_000)) + "  \n"
    rope = fim.build(text)
    units = UNITS.findall(text)
    assert rope.units == len(units) and _sound(rope) and rope.height <= 10
    rng = random.Random(2)
    for _ in range(50):
        k = rng.randrange(len(units) + 1)
        a, b = fim.split(rope, k)
        assert fim.written(a) == "".join(units[:k]) and a.units == k and _sound(a) and _sound(b) and fim.written(fim.join(b, a)) == fim.written(b) + fim.written(a)
        held = set(map(id, _leaves(rope)))
        assert sum(id(x) not in held for x in [*_leaves(a), *_leaves(b)]) <= 2
        c = rng.randrange(len(text) + 1)
        a, b = fim.split(rope, c, "chars")
        assert fim.written(a) == text[:c] and fim.written(b) == text[c:] and _sound(a) and _sound(b)


def _leaves(r):
    return [r] if r.left is None else _leaves(r.left) + _leaves(r.right)


def test_fim_query_equals_its_sql(spark, sf):
    assert compare(spark, sf, QUERIES["op12_fim"], ORACLE_SQL["op12_fim"]) == ""


def test_fim_odd_rows(spark):
    schema = "doc_id long, text string, n int, made string, OUTPUT int"
    rows = [(1, None, 1, "m", 2), (2, "", 1, "m", 2), (None, "no id " * 40, 1, "m", 2), (3, "x " * 300_000, 1, None, 2), (5, "same", 1, "m", 2), (5, "same", 1, "m", 2), (6, " \t", 1, "m", 2), (7, "has <P> in it", 1, "m", 2)]
    df = fim.transformed(spark.createDataFrame(rows, schema))
    assert df.columns == ["doc_id", "text", "made", "n", "form", "prefix_chars", "middle_chars", "output"]
    from pyspark.sql import functions as F

    got = df.withColumn("back", fim.restored(F.col("output"), F.col("form"))).collect()
    assert len(got) == 8
    for r in got:
        assert (r["n"], r["form"], r["prefix_chars"], r["middle_chars"], r["output"]) == plainly(r["text"] or "", "" if r["doc_id"] is None else r["doc_id"]) and r["back"] == (r["text"] or "")
    assert df.limit(0).count() == 0 and fim.transformed(spark.createDataFrame([], schema)).count() == 0


# whitening


def exactly(vectors):
    """n, deviations and eigenvalues of the integers' covariance, centred in whole numbers; whitened rows up to sign."""
    x = [[int(np.floor(64.0 * c)) + 1_000_000 for c in v] for v in vectors]
    n, sums = len(x), [sum(c) for c in zip(*x, strict=True)]
    c = [[n * a - s for a, s in zip(row, sums, strict=True)] for row in x]
    dev = [sum(a * a for a in row) for row in c]
    d = np.array(c, dtype=float) / n
    val, vec = np.linalg.eigh(d.T @ d / n)
    return n, dev, val[::-1], d, vec[:, ::-1]


@pytest.mark.parametrize(("parts", "fan_in"), [(1, 16), (7, 2), (5, 3)])
def test_whitening_against_exact_covariance(spark, parts, fan_in):
    rng = np.random.default_rng(3)
    vectors = (rng.normal(size=(400, 12)) * np.linspace(1, 9, 12) + rng.normal(size=12)).astype(np.float32)
    df = spark.createDataFrame([(i, [float(c) for c in v], "x") for i, v in enumerate(vectors)], "vec_id long, embedding array<float>, whitened string").repartition(parts)
    got = {r["vec_id"]: r for r in whitening.whiten(df, components=8, fan_in=fan_in).collect()}
    n, dev, val, d, vec = exactly(vectors)
    w = np.array([got[i]["whitened"] for i in range(n)])
    assert [int(got[i]["deviation"]) for i in range(n)] == dev and got[0]["n"] == n
    want = d @ vec[:, :8] / np.sqrt(val[:8])
    sign = np.sign((w * want).sum(0))
    assert np.abs(w - want * sign).max() < 1e-9
    assert np.allclose(got[0]["explained"], val[:8] / val.sum(), rtol=1e-9) and got[0]["identity_error"] < 1e-9
    assert np.abs(np.cov(w.T, bias=True) - np.eye(8)).max() < 1e-9


def test_whitening_query(spark, sf):
    rows = QUERIES["op11_whitening"](spark, sf).collect()
    source = {r["vec_id"]: r["embedding"] for r in spark.read.parquet(f"{sf}/embeddings.parquet").collect()}
    ids = sorted(source)
    n, dev, val, d, vec = exactly([source[i] for i in ids])
    assert len(rows) == 32 * n and {r["component"] for r in rows} == set(range(1, 33))
    want, at = d @ vec[:, :32] / np.sqrt(val[:32]), {k: i for i, k in enumerate(ids)}
    got = np.zeros((n, 32))
    for r in rows:
        got[at[r["vec_id"]], r["component"] - 1] = r["whitened"]
        assert r["deviation"] == dev[at[r["vec_id"]]] and r["n"] == n and r["identity_error"] <= 1e-4
        assert abs(r["explained"] - val[r["component"] - 1] / val.sum()) <= 1e-4 * r["explained"]
    assert np.abs(got - want * np.sign((got * want).sum(0))).max() < 1e-7


def test_whitening_odd_rows(spark):
    kind = "vec_id long, embedding array<double>, n string"
    nan, inf = float("nan"), float("inf")
    rows = [(1, [1.0, 2.0], "a"), (2, None, "a"), (3, [1.0, None], "a"), (4, [nan, 1.0], "a"), (5, [inf, 1.0], "a"), (None, [3.0, 1.0], None), (6, [5.0], "a"), (7, [], "a"), (1, [1.0, 2.0], "a"), (8, [1e300, 0.0], "a"), (9, [-2.0, 0.5], "a")]
    got = whitening.whiten(spark.createDataFrame(rows, kind)).collect()
    kept = [[1.0, 2.0], [3.0, 1.0], [5.0, 0.0], [0.0, 0.0], [1.0, 2.0], [-2.0, 0.5]]
    n, dev, *_ = exactly(kept)
    assert sorted(int(r["deviation"]) for r in got) == sorted(dev) and {r["n"] for r in got} == {n} and sorted(str(r["vec_id"]) for r in got) == ["1", "1", "6", "7", "9", "None"]
    assert all(r["identity_error"] < 1e-9 for r in got)
    assert whitening.whiten(spark.createDataFrame([], kind)).count() == 0 and whitening.whiten(spark.createDataFrame([(1, None, "a")], kind)).count() == 0
    one = whitening.long_form(whitening.whiten(spark.createDataFrame([(1, [1.0, 2.0], "a")], kind))).collect()
    assert [(r["component"], r["whitened"], r["deviation"], r["identity_error"]) for r in one] == [(1, 0.0, 0, 1.0), (2, 0.0, 0, 1.0)]
    flat = whitening.whiten(spark.createDataFrame([(1, [1.0, 2.0], "a"), (2, [3.0, 2.0], "a")], kind)).collect()
    assert sorted(round(r["whitened"][0], 9) for r in flat) == [-1.0, 1.0] and all(r["whitened"][1] == 0 for r in flat)


def test_whitening_in_whole_numbers_beyond_longs():
    x = np.array([[2**52, -(2**52)], [5, 7]], dtype=np.int64)
    sums = np.array([2**52 + 5, 7 - 2**52], dtype=object)
    c = whitening.centred(x, 10**6, sums)
    assert c.tolist() == [[int(a) * 10**6 - int(s) for a, s in zip(row, sums, strict=True)] for row in x]
    assert whitening.deviations(c) == [sum(int(v) ** 2 for v in row) for row in c]
    assert whitening.deviations(np.array([[2**40, 1]])) == [2**80 + 1]


# Jaccard join


def shingled(text, width=4):
    w = (text or "").encode().lower().split()
    return {b" ".join(w[i : i + width]) for i in range(max(1, len(w) - width + 1))} if w else set()


def brute_components(texts, alike=(85, 100)):
    sets, ids = {k: shingled(t) for k, t in texts.items()}, sorted(texts)
    root = {k: k for k in ids}

    def find(k):
        while root[k] != k:
            k = root[k]
        return k

    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            if sets[a] and sets[b] and alike[1] * len(sets[a] & sets[b]) >= alike[0] * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {k: (len(sets[k]), find(k)) for k in ids}


@settings(max_examples=60, deadline=None)
@given(st.integers(0, 10**6), st.integers(2, 120))
def test_jaccard_tree_finds_what_the_bound_allows(seed, n):
    rng = np.random.default_rng(seed)
    base = rng.integers(0, 6, (3, 8))
    counts = np.maximum(base[rng.integers(0, 3, n)] + rng.integers(-1, 2, (n, 8)), 0).astype(np.int32)
    sizes = counts.sum(1).astype(np.int64)
    tree = jaccard.CountTree(counts, sizes)
    gone = rng.choice(n, n // 3, replace=False)
    tree.reach(gone)
    for q in range(0, n, 5):
        bound = np.minimum(counts, counts[q]).sum(1)
        fits = (100 * sizes >= 85 * sizes[q]) & (100 * sizes[q] >= 85 * sizes) & (185 * bound >= 85 * (sizes + sizes[q]))
        fits[gone] = False
        assert sorted(tree.search(counts[q], int(sizes[q]))) == np.flatnonzero(fits).tolist()


def corpus(seed):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(400)]
    texts, k = {}, 0
    passage = [rng.choice(words) for _ in range(30)]
    for _ in range(25):
        base = [rng.choice(words) for _ in range(rng.choice([3, 4, 9, 10, 15, 40, 120]))]
        if rng.random() < 0.4:
            base = passage + base
        for _ in range(rng.choice([1, 1, 3, 8])):
            t = list(base)
            for _ in range(rng.choice([0, 0, 1, 1, 2, 4])):
                t[rng.randrange(len(t))] = rng.choice(words)
            if rng.random() < 0.3:
                t.append(rng.choice(words))
            texts[k] = " ".join(t).upper() if rng.random() < 0.2 else "  ".join(t)
            k += 1
    chain = [rng.choice(words) for _ in range(60)]  # links of links
    for _ in range(14):
        chain[rng.randrange(len(chain))] = rng.choice(words)
        texts[k] = " ".join(chain)
        k += 1
    return texts


@pytest.mark.parametrize("options", [{}, {"frequent": 3}, {"frequent": 2, "held": 2}, {"frequent": 5, "cluster_nodes": 3}, {"held": 4, "cluster_bytes": 2000}])
def test_jaccard_components_against_all_pairs(spark, options):
    texts = corpus(len(str(options)))
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(5)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard.similar(df, **options).collect()}
    assert got == brute_components(texts)


def test_jaccard_finds_pairs_of_every_length_at_the_limit(spark):
    """Pairs of 5 to 60 shingles of which the longer one has as many more as the limit allows, and one too many."""
    texts, want = {}, {}
    for n in range(5, 61):
        extra = n * 100 // 85 - n
        for k, more in enumerate((extra, extra + 1)):
            words = [f"a{n}x{k}y{i}" for i in range(n + 3 + more)]
            one, two = 1000 * n + 10 * k, 1000 * n + 10 * k + 1
            texts[one], texts[two] = " ".join(words[: n + 3]), " ".join(words)
            want[two] = one if k == 0 else two
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    got = {r["doc_id"]: r["component_id"] for r in jaccard.similar(df).collect()}
    assert all(got[k] == v for k, v in want.items())


def test_jaccard_a_family_costs_no_pairs(spark):
    """2,000 near copies of one text, joined by a search each: no more verifications than a few a member."""
    rng = random.Random(4)
    words = [f"w{i}" for i in range(3000)]
    base = [rng.choice(words) for _ in range(80)]
    sets = []
    for _ in range(2000):
        t = list(base)
        t[rng.randrange(80)] = rng.choice(words)
        sets.append(np.unique(np.array([hash(x) & (2**64 - 1) for x in zip(t, t[1:], t[2:], strict=False)], np.uint64)))
    seen = 0
    whole = jaccard.overlaps

    def counting(own, others):
        nonlocal seen
        seen += len(others)
        return whole(own, others)

    jaccard.overlaps = counting
    try:
        root = jaccard.connected(sets)
    finally:
        jaccard.overlaps = whole
    assert set(root) == {0} and seen <= 4 * len(sets)


def test_jaccard_query_equals_its_sql(spark, sf):
    assert compare(spark, sf, QUERIES["op13_jaccard"], ORACLE_SQL["op13_jaccard"]) == ""


def test_jaccard_odd_rows(spark):
    long = "wörter und andere " * 9000
    schema = "doc_id long, text string, node string, n int, ID int, key string"
    rows = [(1, None), (2, ""), (None, "no id here"), (3, long), (4, "Same text again here"), (4, "same text again here"), (9, "SAME text again here"), (5, " \t\n"), (6, "12 34"), (7, "12 34"), (None, "12 34"), (8, "same text"), (8, "other words here now")]
    got = jaccard.similar(spark.createDataFrame([(*r, "x", 1, 2, "k") for r in rows], schema)).collect()
    assert sorted((str(r["doc_id"]), r["n_shingles"], str(r["component_id"])) for r in got) == sorted(
        [("1", 0, "1"), ("2", 0, "2"), ("None", 1, "None"), ("3", 3, "3"), ("4", 1, "4"), ("4", 1, "4"), ("9", 1, "4"), ("5", 0, "5"), ("6", 1, "6"), ("7", 1, "6"), ("None", 1, "6"), ("8", 1, "8"), ("8", 1, "8")]
    )
    assert jaccard.similar(spark.createDataFrame([], schema)).count() == 0


def test_jaccard_of_long_sets_by_their_keys(spark, monkeypatch):
    """With sets of 30 shingles counted as long, every path still gives the components of all pairs."""
    monkeypatch.setattr(jaccard, "LONG", 30)
    for counted in (2, 64):
        monkeypatch.setattr(jaccard, "COUNTED", counted)
        texts = corpus(40 + counted)
        df = spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(3)
        assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard.similar(df, held=6).collect()} == brute_components(texts)


def test_jaccard_linked_sets_share_as_many_keys_as_counted():
    rng = np.random.default_rng(7)
    for _ in range(300):
        n = int(rng.integers(6, 900))
        drop = int(rng.integers(0, max(1, int(0.16 * n))))
        own = np.unique(rng.integers(0, 1 << 60, n).astype(np.uint64))
        other = np.unique(np.concatenate([own[rng.permutation(len(own))[drop:]], rng.integers(0, 1 << 60, int(rng.integers(0, 5))).astype(np.uint64)]))
        common = len(np.intersect1d(own, other))
        if 100 * common < 85 * (len(own) + len(other) - common):
            continue
        late = np.sort(rng.choice(np.union1d(own, other), n // 3, replace=False))
        a, b = jaccard.first_shingles(own, late), jaccard.first_shingles(other, late)
        if len(own) != len(other) or set(own) != set(other):
            assert len(np.intersect1d(a, b)) >= jaccard.in_common(min(len(own), len(other)))
