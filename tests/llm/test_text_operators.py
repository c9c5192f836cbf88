"""PII, SimHash, language, quality, packing and SentencePiece against brute force and on odd rows."""

from __future__ import annotations

import hashlib
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

pytest.importorskip("loomgraph.llm")
import public_tokenizers as P
import xxhash

from loomgraph.llm import langid, packing, pii, quality, simhash, spiece
from loomgraph.llm.queries import QUERIES

ODD = "doc_id long, text string, lang string, score double, spans string, found string, fingerprint int"


@pytest.fixture(scope="module")
def odd(spark):
    long = "wörter und andere " * 9000
    rows = [(1, None, "en", 1.0, "x", "y", 3), (2, "", "en", 1.0, "x", "y", 3), (None, "no id here", "en", 1.0, "x", "y", 3), (3, long, "de", None, None, None, None), (4, "same text again", None, 1.0, "x", "y", 3), (4, "same text again", None, 1.0, "x", "y", 3), (5, " \t\n", "en", 1.0, "x", "y", 3), (6, "12 34", "en", 1.0, "x", "y", 3)]
    return spark.createDataFrame(rows, ODD)


# PII


def base_by_regex(text: str):
    out = []
    for kind, p in enumerate((r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", r"[0-9]([\x20-]?[0-9])+", r"\+[0-9][\x20().0-9-]+[0-9]")):
        for m in re.finditer(p, text):
            d = re.sub("[^0-9]", "", m[0])
            if kind == 1 and any(int(x) > 255 for x in m[0].split(".")):
                continue
            if kind == 2 and not (12 <= len(d) <= 19 and sum(int(c) if i % 2 == 0 else sum(divmod(2 * int(c), 10)) for i, c in enumerate(d[::-1])) % 10 == 0):
                continue
            if kind == 3 and not 9 <= len(d) <= 15:
                continue
            out.append((m.start(), kind, m.end()))
    return sorted(out)


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet="a1 2.3@-+(0)4é", max_size=60))
def test_pii_base_is_the_patterns(text):
    assert pii.find(text) == base_by_regex(text)


def test_pii_query_counts_and_digest(spark, sf):
    got = {r["doc_id"]: r for r in QUERIES["op2_pii"](spark, sf).collect()}
    for r in spark.read.parquet(f"{sf}/documents.parquet").collect():
        base = base_by_regex(r["text"] or "")
        g = got[r["doc_id"]]
        assert [g[c] for c in ("n_email", "n_ip", "n_card", "n_phone")] == [sum(k == i for _, k, _ in base) for i in range(4)]
        assert g["base_sha256"] == hashlib.sha256(",".join(f"{pii.KINDS[k]}:{s}:{e}" for s, k, e in base).encode()).hexdigest()
        assert g["spans"] == pii.written(base) and g["n_added"] == 0  # no disguises in these documents


@pytest.mark.parametrize(
    ("text", "found"),
    [
        ("mail john [at] example [dot] com now", ["john [at] example [dot] com"]),
        ("write john dot doe at example dot com.", ["john dot doe at example dot com"]),
        ("call plus one five five five, one two three four five six seven", ["plus one five five five, one two three four five six seven"]),
        ("jоhn@exаmple.com", ["jоhn@exаmple.com"]),
        ("host one nine two dot one six eight dot 1 dot 12", ["one nine two dot one six eight dot 1 dot 12"]),
        ("４０８００３２８３７２３５８１９", ["４０８００３２８３７２３５８１９"]),
        ("jo\u200bhn@example.com", ["jo\u200bhn@example.com", "hn@example.com"]),
        ("4O8OO32837235819", ["4O8OO32837235819"]),
        ("on l92.l68.O.1 now", ["l92.l68.O.1"]),
        ("call +1 (5O5) 555-O123 now", ["+1 (5O5) 555-O123"]),
        ("plain words at the door, one two three, dot dot dot", []),
        ("a@b.cd and x [at] y [dot] zz", ["a@b.cd", "x [at] y [dot] zz"]),
    ],
)
def test_pii_disguises_map_back_to_the_source(text, found):
    base, spans = pii.detect(text)
    assert [text[s:e] for s, _, e in spans] == found
    assert set(base) <= set(spans)


@pytest.mark.parametrize(
    ("text", "found"),
    [
        ("call plus 49 170 1234567 today", ["plus 49 170 1234567"]),
        ("card 4111 1111 1111 111l ends", ["4111 1111 1111 111l"]),
        ("card 4II1 1111 1111 1111 ends", ["4II1 1111 1111 1111"]),
        ("host l92.168.1.10 up", ["l92.168.1.10", "92.168.1.10"]),
        ("host 192.168.1.two five up", ["192.168.1.two five"]),
        ("hans ät beispiel punkt de", ["hans ät beispiel punkt de"]),
        ("hans punkt maier at beispiel punkt de", ["hans punkt maier at beispiel punkt de"]),
        ("ana arroba ejemplo punto com", ["ana arroba ejemplo punto com"]),
        ("jean point petit arobase exemple point fr", ["jean point petit arobase exemple point fr"]),
        ("jean at exemple point fr", ["jean at exemple point fr"]),
        ("jean@exemple point fr", ["jean@exemple point fr"]),
        ("looked at this point in time, arrived at the point of no return", []),
        ("at this point bob at example dot com", ["bob at example dot com"]),
    ],
)
def test_pii_finds_each_disguise_alone(text, found):
    _, spans = pii.detect(text)
    assert sorted(text[s:e] for s, _, e in spans) == sorted(found)


@settings(max_examples=500, deadline=None)
@given(st.lists(st.sampled_from(["plus ", "one ", "two", "l", "O", "1", "41", ".", " dot ", " at ", " point ", "(at)", "[.]", "@", " ", "x", "com", "|", "-"]), max_size=14).map("".join))
def test_pii_gate_loses_nothing(text):
    if not pii.hinted(text):
        m = pii.Mapped(text)
        for p in (pii.DIGITS, pii.LETTER_DIGIT, pii.DIGIT_DOT, pii.PLUS, pii.BRACKET_AT, pii.BRACKET_DOT, pii.WORDED, pii.WORDED_POINT, pii.SPACED):
            assert not p.search(m.text)


def test_pii_long_runs_take_linear_time():
    for text in ("a" * 300_000, "1" * 300_000, "@" * 300_000, "1.1." * 60_000, "one " * 60_000, "x at " * 60_000, "a.b dot " * 20_000):
        pii.detect(text)


def test_pii_odd_rows(spark, odd):
    rows = pii.with_pii(odd).collect()
    assert len(rows) == 8 and all(r["spans"] == "" for r in rows)
    clean = pii.redacted(spark.createDataFrame([(1, "to a@b.cd", 9), (2, None, 0)], "doc_id long, text string, n_chars long")).collect()
    assert [tuple(r) for r in clean] == [(1, "to [EMAIL]", 10), (2, None, 0)]
    assert pii.with_pii(odd.limit(0)).count() == 0


# SimHash


def brute_fingerprint(text):
    w = (text or "").encode().lower().split()
    if not w:
        return 0
    h = [xxhash.xxh64_intdigest(b" ".join(w[i : i + 3]), 42) for i in range(max(1, len(w) - 2))]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_components(ids, fps):
    root = list(range(len(ids)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(ids)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= 3:
                root[find(i)] = find(j)
    least = {}
    for i, x in enumerate(ids):
        least[find(i)] = min(least.get(find(i), x), x)
    return {x: least[find(i)] for i, x in enumerate(ids)}


def test_pipeline_near_dedup_is_shingle_similarity(spark, sf):
    """The stage against brute force over five-word shingles, with near copies of 0.8 and more planted."""
    from corpus_pipeline import near_dedup

    rng = random.Random(5)
    texts = [r["text"] for r in spark.read.parquet(f"{sf}/documents.parquet").orderBy("doc_id").limit(60).collect()]
    for n, edits in [(60, 1), (200, 1), (200, 4), (600, 8), (600, 30)] * 6:
        words = [f"w{rng.randrange(5000)}" for _ in range(n)]
        near = words.copy()
        for i in rng.sample(range(n), edits):
            near[i] = "changed"
        texts += [" ".join(words), " ".join(near)]
    base = [f"v{i}" for i in range(300)]
    texts += [" ".join([*base[i * 12 :], *(f"z{j}" for j in range(i * 12))]) for i in range(12)]  # a chain of near copies

    def own(text):
        w = (text or "").encode().lower().split()
        return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()

    sets, root = [own(x) for x in texts], list(range(len(texts)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            if a == b or len(a & b) >= 0.8 * len(a | b):
                x, y = find(i), find(j)
                root[max(x, y)] = min(x, y)
    want = {i for i in range(len(texts)) if find(i) == i}
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert {r["doc_id"] for r in near_dedup(spark, docs, sf).collect()} == want
    assert len(want) <= len(texts) - 24 - 11


def test_simhash_query_against_brute_force(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").collect()
    fps = [brute_fingerprint(r["text"]) for r in docs]
    want = brute_components([r["doc_id"] for r in docs], fps)
    got = QUERIES["op3_simhash"](spark, sf).collect()
    assert len(got) == len(docs)
    assert {r["doc_id"]: r["component_id"] for r in got} == want
    assert {r["doc_id"]: r["fingerprint"] for r in got} == {r["doc_id"]: f"{f:016x}" for r, f in zip(docs, fps, strict=True)}


def by_links(nodes, edges):
    """The least node reachable from each node over the edges."""
    root = {x: x for x in nodes}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {x: find(x) for x in root}


@pytest.mark.parametrize("held", [20_000, 60, 9, 3])
def test_simhash_links_join_all_near_fingerprints(spark, held):
    rnd = random.Random(5)
    fps = [rnd.getrandbits(64) for _ in range(40)]
    for _ in range(160):  # chains and a dense group
        x = rnd.choice(fps)
        for b in rnd.sample(range(64), rnd.randint(1, 3)):
            x ^= 1 << b
        fps.append(x)
    centre = rnd.getrandbits(64)
    fps = sorted({*fps, *(centre ^ 1 << b for b in range(12))})
    signed = {x: int(np.uint64(x).view(np.int64)) for x in fps}
    found = simhash.links(spark.createDataFrame([(x,) for x in signed.values()], "fp long").cache(), held=held).collect()
    want = brute_components(fps, fps)
    groups = by_links(signed.values(), [(r["a"], r["b"]) for r in found])
    assert len({(want[x], groups[signed[x]]) for x in fps}) == len(set(want.values())) == len(set(groups.values()))


@pytest.mark.parametrize("tau", [0, 1, 6, 10])
def test_simhash_links_with_wide_thresholds(spark, tau):
    rng = np.random.default_rng(tau)
    bits = rng.random((30, 64)) < rng.random(64)  # unequal and, by copying, correlated bits
    bits[:, 40:] = bits[:, :24]
    bits = np.concatenate([bits, *[bits ^ (rng.random(bits.shape) < p) for p in (0.02, 0.06, 0.1)]])
    fps = np.unique(np.packbits(bits, axis=1).view(">u8").astype(np.uint64))
    near = [(int(a), int(b)) for i, a in enumerate(fps) for b in fps[:i] if int(a ^ b).bit_count() <= tau]
    found = simhash.links(spark.createDataFrame([(int(x.view(np.int64)),) for x in fps], "fp long").cache(), tau).collect()
    want = by_links(map(int, fps), near)
    got = by_links(fps.view(np.int64).tolist(), [(r["a"], r["b"]) for r in found])
    assert len({(want[int(x)], got[int(x.view(np.int64))]) for x in fps}) == len(set(want.values())) == len(set(got.values()))


def test_simhash_large_template_group_stays_linear(spark):
    """Tens of thousands of fingerprints within three bits of one template; the output has fewer rows than there are fingerprints."""
    import itertools
    import time

    rng, base = np.random.default_rng(0), 0x9E3779B97F4A7C15
    flips = [0, *(sum(1 << b for b in c) for e in (1, 2, 3) for c in itertools.combinations(range(64), e))][:43_000]
    seconds = []
    for fps in (np.array([base ^ f for f in flips], np.uint64), rng.integers(0, 1 << 63, 43_000, dtype=np.uint64)):
        df = spark.createDataFrame(__import__("pandas").DataFrame({"fp": fps.view(np.int64)})).cache()
        began = time.time()
        found = simhash.links(df).distinct().collect()
        seconds.append(time.time() - began)
    assert seconds[0] < 60 and len(found) < 10


def near_sets(text, width=5):
    w = (text or "").encode().lower().split()
    return {tuple(w[i : i + width]) for i in range(max(1, len(w) - width + 1))} if w else set()


@pytest.mark.parametrize("options", [{}, {"held": 5}, {"cluster_nodes": 7}, {"cluster_bytes": 3000}])
def test_near_copies_against_brute_force(spark, options):
    rng = random.Random(3)
    word = [f"w{i}" for i in range(4000)]
    texts = [None, "", " \t", "one", "one two", "ONE two"]
    for n in (8, 30, 100, 400):
        for _ in range(4):
            base = rng.choices(word, k=n)
            texts.append(" ".join(base))
            for edits in (1, 2, n // 50, n // 40, n // 20):
                near = base.copy()
                for i in rng.sample(range(n), min(edits, n)):
                    near[i] = rng.choice(word)
                texts.append(" ".join(near))
    template = rng.choices(word, k=120)
    for _ in range(60):  # a family whose members are not all alike
        near = template.copy()
        for i in rng.sample(range(120), rng.randint(0, 4)):
            near[i] = rng.choice(word)
        texts.append(" ".join(near))
    rows = [(i, x) for i, x in enumerate(texts)] + [(i + 1000, texts[i]) for i in range(0, len(texts), 9)] + [(5, texts[40]), (5, texts[40]), (None, texts[41])]
    sets = [near_sets(x) for _, x in rows]
    place = [i for i, (k, _) in enumerate(rows) if k is not None]
    edges = [(i, j) for i in place for j in place if j < i and (sets[i] == sets[j] or (sets[i] and sets[j] and len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j])))]
    root = by_links(place, edges)
    least = {}
    for i in place:
        least[root[i]] = min(least.get(root[i], 10**9), rows[i][0])
    docs = spark.createDataFrame([(*r, "x", 1) for r in rows], "doc_id long, text string, node string, root int")
    got = sorted(((r["doc_id"], r["component_id"]) for r in simhash.near_copies(docs, **options).collect()))
    assert got == sorted((rows[i][0], least[root[i]]) for i in place)
    kept = simhash.keep_one(docs, **options)
    assert kept.columns == docs.columns
    # one row for each group, and the row without an id
    left = [(r["doc_id"], r["text"]) for r in kept.collect()]
    assert sum(k is None for k, _ in left) == 1 and len(left) == len(set(root.values())) + 1
    assert sorted(k for k, _ in left if k is not None) == sorted(least.values())


def test_sketches_lose_no_pair():
    rng = np.random.default_rng(4)
    for n in (30, 300, 3000):
        a = np.unique(rng.integers(0, 1 << 63, n, dtype=np.uint64))
        sets = [a]
        for _ in range(60):
            k = n // 10  # 0.818 alike
            sets.append(np.unique(np.concatenate([rng.choice(a, len(a) - k, replace=False), rng.integers(0, 1 << 63, k, dtype=np.uint64)])))
        s = [simhash.sketch(x) for x in sets]
        assert min((s[0] == x).sum() for x in s[1:]) >= simhash.SKETCH_LEAST * simhash.SKETCH
        assert (simhash.grouped(sets) == 0).all()


def test_simhash_thresholds_follow_the_pigeonhole():
    rng = np.random.default_rng(0)
    for n in (1000, 10**9):
        bits = rng.random((500, 64)) < 0.5
        both = (bits.T.astype(float) @ bits) * n / 500
        parts, limits = simhash.allocate(n, both, 3)
        assert sum(limits) == 3 - len(parts) + 1 and sorted(b for p in parts for b in p) == list(range(64))


def test_simhash_odd_rows(odd, spark):
    rows = simhash.near_duplicates(odd).collect()
    assert len(rows) == 8
    by = {r["doc_id"]: r for r in rows}
    assert by[1]["component_id"] == by[2]["component_id"] == by[5]["component_id"] == 1 and by[1]["fingerprint"] == "0" * 16
    assert by[None]["component_id"] is None
    kept = simhash.keep_one(odd)
    assert kept.columns == odd.columns and sorted(r["doc_id"] for r in kept.where("doc_id is not null").collect()) == [1, 3, 4, 6]
    assert simhash.keep_one(odd.limit(0)).count() == 0 and simhash.near_copies(odd.limit(0)).count() == 0
    assert simhash.near_duplicates(odd.limit(0)).count() == 0


# language and quality


def test_language_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.01"
    got = QUERIES["op5_language"](spark, sf).join(spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "lang"), "doc_id").collect()
    held = [r for r in got if r["held_out"]]
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) for r in got)
    assert np.mean([r["lang_pred"] == r["lang"] for r in held]) > 0.98 and np.mean([r["rejected"] for r in got]) < 0.01


def test_language_features_by_hand():
    for text in ("Ab, cd!", "x", "  ", "", None, "ß" * 5, "a1b"):
        own = [x for b in langid.buckets(text, 1 << 12) for x in b]
        words = re.findall(r"[^\W\d_]+", (text or "").lower())
        grams = 0
        marked = "\0" + "\0".join(words) + "\0" if words else ""
        for n in (2, 3, 4):
            grams += sum("\0" not in marked[i : i + n][1:-1] for i in range(len(marked) - n + 1)) if n < 4 or len(marked) >= n else 0
        assert len(own) == grams + len(words)


@pytest.mark.parametrize("part", [1, 3, 7, 1 << 18])
@settings(max_examples=60, deadline=None)
@given(st.text(alphabet="ab éΣ,1", max_size=60))
def test_language_features_do_not_depend_on_the_parts(part, text):
    whole = langid.PART
    want = np.sort(np.concatenate([*langid.buckets(text, 1 << 12), np.zeros(0, np.uint32)]))
    langid.PART = part
    try:
        got = np.sort(np.concatenate([*langid.buckets(text, 1 << 12), np.zeros(0, np.uint32)]))
    finally:
        langid.PART = whole
    assert got.tolist() == want.tolist()


def test_language_of_very_long_texts(spark):
    texts = ["hello world, " * 80_000, "x" * 700_000 + " hello", "hello " + "y" * 262_143 + " world " * 50_000]
    for x in texts:
        whole, langid.PART = langid.PART, 1 << 30
        want = langid.features(x, 1 << 12)
        langid.PART = whole
        got = langid.features(x, 1 << 12)
        assert (got[0] == want[0]).all() and (got[1] == want[1]).all()
    model = langid.fit([(*langid.features(x, 1 << 12), "en") for x in ("hello world", "the world")], 1 << 12)
    rows = langid.with_language(spark.createDataFrame([(i, x, "kept") for i, x in enumerate(texts)], "doc_id long, text string, found string"), model).collect()
    assert {r["lang_pred"] for r in rows} == {"en"} and {r["found"] for r in rows} == {"kept"}


def test_language_rejects_an_unlearned_language(spark):
    """Texts of another alphabet and vocabulary are rejected, the learned languages' are not."""
    sf = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    model = langid.train(docs)
    rng = random.Random(1)
    syllables = ["qx", "zvu", "wkj", "yyq", "vvk", "xzo", "jjw", "kqa"]
    strange = [(10_000 + i, " ".join("".join(rng.choices(syllables, k=3)) for _ in range(80))) for i in range(30)] + [(20_000 + i, "".join(chr(rng.randrange(0x3041, 0x3090)) for _ in range(300))) for i in range(30)]
    out = langid.with_language(spark.createDataFrame(strange, "doc_id long, text string"), model).collect()
    assert np.mean([r["rejected"] for r in out]) >= 0.9
    assert langid.with_language(docs, model).where("rejected").count() <= 0.01 * docs.count()


def test_language_learns_every_value(spark):
    words = {f"l{k:02}": [f"{a}{k}{chr(97 + k % 26)}" for a in ("ba", "do", "ki", "mu", "re")] for k in range(70)}
    rows = [(100 * k + i, " ".join(w[(i + j) % 5] for j in range(12)), x) for k, (x, w) in enumerate(words.items()) for i in range(4 if k else 2)]
    model = langid.train(spark.createDataFrame(rows, "doc_id long, text string, lang string"), size=1 << 12, epochs=2)
    assert sorted(model.classes) == sorted(words)


def test_language_odd_rows(odd):
    model = langid.train(odd)
    rows = {(r["doc_id"], r["text"]): r for r in langid.with_language(odd, model).collect()}
    assert all(0 <= r["score"] <= 1 for r in rows.values())
    assert {k[0] for k, r in rows.items() if r["lang_pred"] == "und"} == {1, 2, 5, 6}
    assert langid.with_language(odd.limit(0), model).count() == 0
    nothing = langid.train(odd.limit(0))
    assert {r["lang_pred"] for r in langid.with_language(odd, nothing).collect()} == {"und"}


def test_quality_held_out(spark):
    sf = "/root/testdata/sf0.01"
    got = QUERIES["op6_quality"](spark, sf).join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").collect()
    held = [r for r in got if r["held_out"] and r["quality"] is not None]
    assert np.mean([r["predicted"] == r["quality"] for r in held]) > 0.95


def test_quality_density_difference_by_hand():
    rng = np.random.default_rng(0)
    x = np.vstack([rng.normal(0, 1, (80, 3)), rng.normal(1, 2, (90, 3))])
    y = np.repeat([0.0, 1.0], [80, 90])
    m = quality._gaussians(x, y, 0.1, 0.1)
    z = (x[:5] - m.mean) / m.scale
    want = []
    for c, f in zip(m.centres, m.factors, strict=True):
        cov = np.linalg.inv(f.T @ f)
        want.append([-0.5 * (v - c) @ np.linalg.inv(cov) @ (v - c) - 0.5 * np.log(np.linalg.det(cov)) for v in z])
    assert np.allclose(m.difference(x[:5]), np.array(want[1]) - np.array(want[0]))


def test_quality_odd_rows(spark, odd):
    labels = spark.createDataFrame([(1, 1), (2, 0), (3, None), (4, 1), (None, 0), (4, 0), (99, 1)], "doc_id long, quality int")
    model = quality.train(odd, labels)
    rows = quality.with_quality(odd, model).collect()
    assert len(rows) == 8 and all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.5) for r in rows)
    assert quality.with_quality(odd.limit(0), quality.train(odd.limit(0), labels.limit(0))).count() == 0


# packing


def test_packing_query_holds_every_document(spark, sf):
    from tokenizers import Tokenizer

    encode = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    got = QUERIES["op8_packing"](spark, sf).collect()
    by_doc, by_sequence = {}, {}
    for r in got:
        by_doc.setdefault(r["doc_id"], []).append(r)
        by_sequence.setdefault(r["sequence_id"], []).append(r)
    docs = spark.read.parquet(f"{sf}/documents.parquet").collect()
    assert set(by_doc) == {r["doc_id"] for r in docs}
    for d in docs:
        ids = np.array([*encode.encode(d["text"] or "", add_special_tokens=False).ids, 2], "<u4")
        at = 0
        for k, r in enumerate(sorted(by_doc[d["doc_id"]], key=lambda r: r["piece"])):
            assert (r["piece"], r["start"]) == (k, at) and (k == 0 or r["length"] == 1024)
            assert r["ids_crc32"] == zlib.crc32(ids[at : at + r["length"]].tobytes())
            at += r["length"]
        assert at == len(ids)
    total = 0
    for rows in by_sequence.values():
        at = 0
        for r in sorted(rows, key=lambda r: r["offset"]):
            assert r["offset"] == at
            at += r["length"]
        assert at <= 1024
        total += at
    assert len(by_sequence) <= 1.03 * packing.least_sequences(Counter(r["length"] for r in got), 1024)


@settings(max_examples=150, deadline=None)
@given(st.dictionaries(st.integers(1, 12), st.integers(1, 4), min_size=1, max_size=5))
def test_packing_solution_is_legal_and_close_to_best(histogram):
    runs, n = packing.solve(histogram, 12)
    fill, items = Counter(), Counter()
    for length, _, pieces, first, each, _ in runs:
        items[length] += pieces
        for i in range(0, pieces, each):
            fill[first + i // each] += each * length
    assert items == Counter(histogram) and len(fill) == n and max(fill.values()) <= 12
    assert packing.least_sequences(histogram, 12) <= n
    # first fit decreasing is an upper bound that the search must not exceed by more than one
    bins = []
    for x in sorted(Counter(histogram).elements(), reverse=True):
        i = next((i for i, b in enumerate(bins) if b + x <= 12), None)
        bins.append(x) if i is None else bins.__setitem__(i, bins[i] + x)
    assert n <= len(bins) + 1


def test_packing_fills_gaps_of_short_pieces():
    histogram = {150: 6000, 124: 1000}
    runs, n = packing.solve(histogram, 1024)
    assert n == 1000 == packing.least_sequences(histogram, 1024)
    assert Counter({x: sum(r[2] for r in runs if r[0] == x) for x in histogram}) == Counter(histogram)


@settings(max_examples=200, deadline=None)
@given(st.dictionaries(st.integers(1, 40), st.integers(1, 9), max_size=12), st.integers(1, 80))
def test_packing_fillings_are_maximal(histogram, room):
    counts = [histogram.get(x, 0) for x in range(81)]
    for way in packing.fillings(counts, room, 4):
        used = Counter(way)
        assert sum(way) <= room and all(used[x] <= counts[x] for x in used)
        assert not [x for x in range(1, 81) if counts[x] > used[x] and x <= room - sum(way)]
    path, n = packing.best_fit(histogram, 80)
    placed = Counter()
    for pattern, times in path:
        assert times > 0 and 0 < sum(pattern) <= 80
        placed.update({x: k * times for x, k in Counter(pattern).items()})
    assert placed == Counter(histogram) and n == sum(t for _, t in path)



def test_packing_odd_rows(odd):
    rows = packing.pack(odd, P.path("byte_bpe_50k.json")).collect()
    assert sum(r["doc_id"] == 4 for r in rows) == 2 and sum(r["doc_id"] is None for r in rows) == 1
    assert [r["length"] for r in rows if r["doc_id"] in (1, 2)] == [1, 1]
    assert packing.pack(odd.limit(0), P.path("byte_bpe_50k.json")).count() == 0


@settings(max_examples=200, deadline=None)
@given(st.text(max_size=80))
def test_packing_fast_and_plain_encoders_agree(text):
    from tokenizers import Tokenizer

    global _ENCODERS
    if "_ENCODERS" not in globals():
        _ENCODERS = packing.Encoder(P.path("byte_bpe_50k.json")), Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    assert _ENCODERS[0](text).tolist() == _ENCODERS[1].encode(text, add_special_tokens=False).ids


def test_packing_encoders_agree_on_every_block_and_over_the_million():
    """Each character that can be encoded, beside letters, digits, blanks and marks; and texts on both sides of the switch."""
    from tokenizers import Tokenizer

    own, plain = packing.Encoder(P.path("byte_bpe_50k.json")), Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    for at in range(0, 0x110000, 64):
        block = [chr(i) for i in range(at, at + 64) if not 0xD800 <= i < 0xE000]
        text = "".join(f"a{c}{c}1 {c}b\n{c}." for c in block)
        assert own(text).tolist() == plain.encode(text, add_special_tokens=False).ids, hex(at)
    words = "some wörds, 123 and  blanks\n"
    for n in (999_999, 1_000_000):
        text = (words * (n // len(words) + 1))[:n]
        assert own(text).tolist() == plain.encode(text, add_special_tokens=False).ids


# SentencePiece


@pytest.fixture(scope="module")
def pieces():
    import sentencepiece

    path = P.path("piece_bpe_32k.model")
    return spiece.Model.load(path), sentencepiece.SentencePieceProcessor(model_file=path)


@settings(max_examples=400, deadline=None)
@given(st.one_of(st.text(max_size=50), st.text(alphabet="aaabtheinr  \n▁é.,0", max_size=60)))
def test_sentencepiece_equals_the_library(pieces, text):
    m, library = pieces
    ids = m.encode([text])[0].tolist()
    assert ids == library.encode(text)
    assert m.decode(ids) == text.replace("▁", " ")


def test_sentencepiece_query_round_trips(spark, sf, pieces):
    got = {r["doc_id"]: r for r in QUERIES["op1_sentencepiece"](spark, sf).collect()}
    for d in spark.read.parquet(f"{sf}/documents.parquet").collect():
        ids = np.array(pieces[1].encode(d["text"] or ""), "<u4")
        r = got[d["doc_id"]]
        assert (r["n_ids"], r["ids_crc32"], r["round_trip"]) == (len(ids), zlib.crc32(ids.tobytes()), True)


def test_sentencepiece_unigram_takes_the_best_path():
    m = spiece.Model({"▁a": 0, "b": 1, "ab": 2, "▁ab": 3, "▁": 4, "a": 5}, {"▁a": -1.0, "b": -1.0, "ab": -1.5, "▁ab": -3.0, "▁": -0.2, "a": -2.0}, ["▁a", "b", "ab", "▁ab", "▁", "a"], {}, [], 9, False, True, 3)
    assert m.encode(["ab"])[0].tolist() == [4, 2] and m.encode(["abz"])[0].tolist() == [4, 2, 9]


def test_sentencepiece_odd_rows(odd):
    path = P.path("piece_bpe_32k.model")
    ids = spiece.encoded(odd, path)
    back = spiece.decoded(ids.drop("text"), path).collect()
    assert sorted((r["text"] or "") for r in back) == sorted((r["text"] or "") for r in odd.collect())
    assert spiece.encoded(odd.limit(0), path).count() == 0
    made = spiece.digests(odd, path)  # which has a column `found` of its own
    assert made.columns == [*odd.columns, "n_ids", "ids_crc32", "round_trip"]
    assert sorted(str(r["found"]) for r in made.collect()) == sorted(str(r["found"]) for r in odd.collect()) and all(r["round_trip"] for r in made.collect())


@pytest.mark.parametrize(("words", "edit"), [(8, "append"), (12, "append"), (14, "last"), (25, "append 4")])
def test_near_dedup_keeps_one_of_each_short_pair(spark, words, edit):
    """400 pairs of natural word frequencies at 0.8 or more: exactly one of each is left."""
    from corpus_pipeline import near_dedup

    rng = np.random.default_rng(words)
    draw = lambda n: [f"w{x}" for x in rng.zipf(1.3, n) % 50_000]
    texts = []
    while len(texts) < 800:
        base = [f"t{len(texts)}", *draw(words - 1)]  # a word of its own keeps pairs apart
        if edit.startswith("append"):
            near = base + draw(int(edit.split()[-1]) if " " in edit else 1)
        else:
            near = base[:-1] + ["changed"]
        a, b = near_sets(" ".join(base)), near_sets(" ".join(near))
        if a == b or len(a & b) < 0.8 * len(a | b):
            continue
        texts += [" ".join(base), " ".join(near)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    sets, edges = [near_sets(x) for x in texts], []
    by = {}
    for i, s in enumerate(sets):
        for x in s:
            by.setdefault(x, []).append(i)
    for i, j in {(i, j) for v in by.values() for i in v for j in v if j < i}:
        if len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]):
            edges.append((i, j))
    root = by_links(range(len(texts)), edges)
    assert near_dedup(spark, docs, "").count() == len(set(root.values())) <= 400


def fewest(pieces, capacity):
    """The least number of sequences, by placing the pieces one after the other in every way."""
    pieces = sorted(pieces, reverse=True)
    best = len(pieces)

    def place(i, rooms):
        nonlocal best
        if len(rooms) >= best:
            return
        if i == len(pieces):
            best = len(rooms)
            return
        for room in sorted({r for r in rooms if r >= pieces[i]}):
            left = list(rooms)
            left[left.index(room)] -= pieces[i]
            place(i + 1, left)
        place(i + 1, [*rooms, capacity - pieces[i]])

    place(0, [])
    return best


@settings(max_examples=80, deadline=None)
@given(st.lists(st.integers(3, 60), min_size=1, max_size=9))
def test_packing_without_an_end_is_the_optimum(pieces):
    runs, sequences = packing.solve(Counter(pieces), 60, nodes=None)
    assert sequences == fewest(pieces, 60)
    assert sum(n for _, _, n, *_ in runs) == len(pieces)
    path, most, proved = packing.exactly(Counter(pieces), 60, packing.best_fit(Counter(pieces), 60), 0)
    assert proved and most == sequences == sum(n for _, n in path)
    assert Counter(x for p, n in path for x in p * n) == Counter(pieces) and all(sum(p) <= 60 for p, _ in path)


@pytest.mark.parametrize(("n", "seed"), [(20, 1), (60, 2), (200, 2), (1000, 1)])
def test_packing_of_triplets_that_fill_every_sequence(n, seed):
    """Sets of three that fill 1024: the optimum with enough rounds of repair, one sequence more at most without."""
    rng = random.Random(seed)
    pieces = []
    for _ in range(n):
        a = rng.randint(256, 512)
        b = rng.randint(256, (1024 - a) * 2 // 3)
        pieces += [a, b, 1024 - a - b]
    assert packing.solve(Counter(pieces), 1024, rounds=400)[1] <= n + 1
    runs, sequences = packing.solve(Counter(pieces), 1024, rounds=3000)
    assert sequences == n
    held = [0] * n
    for length, _, count, first, each, _ in runs:
        for i in range(count):
            held[first + i // each] += length
    assert held == [1024] * n
