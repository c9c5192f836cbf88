"""Top-k, HMM, chat, media and the pipeline against brute force and on odd rows."""

from __future__ import annotations

import itertools
import math
import random
import zlib
from collections import Counter

import duckdb
import numpy as np
import pytest

pytest.importorskip("loomgraph.llm")
from loomgraph.llm import chat, hmm, media, topk
from loomgraph.llm.queries import ORACLE_SQL, QUERIES

# top-k


def test_topk_query_against_sql(spark, sf):
    con = duckdb.connect()
    con.sql(f"CREATE VIEW embeddings AS SELECT * FROM '{sf}/embeddings.parquet'")
    want = con.sql(ORACLE_SQL["op10_topk"]).fetchall()
    got = [tuple(r) for r in QUERIES["op10_topk"](spark, sf).select("query_id", "rank", "vec_id", "score").collect()]
    assert sorted(got) == sorted(want)


@pytest.mark.parametrize("block", [2048, 3])
def test_topk_ties_few_candidates_and_odd_vectors(spark, block):
    rows = [(i, [0.5, 0.25]) for i in range(0, 12)] + [(50, [1.0, 1.0]), (51, None), (52, [float("nan"), 1.0]), (53, [1.0, None]), (54, [float("inf"), 0.0]), (100, [-1.0, 0.001]), (None, [1.0, 1.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").selectExpr("*", "1 AS score", "2 AS rank")
    from pyspark.sql import functions as F

    got = topk.top_k(df, F.col("vec_id") % 50 == 0, block=block).collect()
    use = {i: np.floor(256 * np.array(v)).astype(int) for i, v in rows if i is not None and v is not None and None not in v and np.isfinite(v).all()}
    want = []
    for q in (0, 50, 100):
        best = sorted((-int(use[q] @ use[i]), i) for i in use if i != q)[:5]
        want += [(q, k + 1, i, -s) for k, (s, i) in enumerate(best)]
    assert sorted(tuple(r) for r in got) == sorted(want)
    small = topk.top_k(df.where("vec_id in (50, 1, 2)"), F.col("vec_id") == 50).collect()
    assert [r["vec_id"] for r in sorted(small, key=lambda r: r["rank"])] == [1, 2]
    assert topk.top_k(df.limit(0), F.col("vec_id") == 50).count() == 0
    assert topk.top_k(df.where("vec_id = 50"), F.col("vec_id") == 50).count() == 0


# HMM


def test_hmm_forward_and_counts_against_enumeration():
    rng = np.random.default_rng(3)
    k, v = 3, 4
    soft = lambda *s: (x := rng.random(s)) / x.sum(-1, keepdims=True)
    m = hmm.Hmm(soft(k), soft(k, k), soft(k, v).T.copy())
    texts = [np.array(x) for x in ([0, 1, 3], [2], [1, 1, 0, 2, 3], [3, 3])]
    start, move, emit = np.zeros(k), np.zeros((k, k)), np.zeros((v, k))
    total = m.expect(texts, start, move, emit)
    want = np.zeros(k), np.zeros((k, k)), np.zeros((v, k))
    logs = []
    for t in texts:
        paths = {}
        for p in itertools.product(range(k), repeat=len(t)):
            w = m.start[p[0]] * m.emit[t[0], p[0]]
            for i in range(1, len(t)):
                w *= m.move[p[i - 1], p[i]] * m.emit[t[i], p[i]]
            paths[p] = w
        z = sum(paths.values())
        logs.append(math.log10(z))
        for p, w in paths.items():
            want[0][p[0]] += w / z
            for i, s in enumerate(p):
                want[2][t[i], s] += w / z
                if i:
                    want[1][p[i - 1], s] += w / z
    assert np.allclose(m.log10(texts), logs) and math.isclose(total, sum(logs))
    assert all(np.allclose(a, b) for a, b in zip((start, move, emit), want, strict=True))


def test_hmm_query_base_scores_and_gain(spark, sf):
    got = {r["doc_id"]: r for r in QUERIES["op7_hmm"](spark, sf).collect()}
    docs = spark.read.parquet(f"{sf}/documents.parquet").collect()
    c = Counter()
    split = {r["doc_id"]: [*(r["text"] or "").encode().lower().split(), b""] for r in docs}
    for i, w in split.items():
        if zlib.crc32(str(i).encode()) % 7 != 2:
            c.update(w)
    n, v = sum(c.values()), len(c)
    assert len(got) == len(docs)
    for i, w in split.items():
        r = got[i]
        assert (r["n_tokens"], r["n_known"], r["train_tokens"]) == (len(w), sum(x in c for x in w), n)
        assert math.isclose(r["base_score"], sum(math.log10((c[x] + 1) / (n + v + 1)) for x in w), rel_tol=1e-9)
    held = [r for r in got.values() if r["held_out"]]
    assert sum(r["score"] for r in held) > sum(r["base_score"] for r in held)


def test_hmm_shapes_agree(spark):
    found = [b"a", b"abcde", b"abc.", "\u00e9\u00e9".encode(), b"x" * 40, "ab\u00df,".encode(), b"9", b"abcdefghijk"]
    want = [hmm.shape(w) for w in found]
    assert hmm.shapes(found).tolist() == want
    df = spark.createDataFrame([(i, bytearray(w)) for i, w in enumerate(found)], "i int, w binary")
    assert [r["s"] for r in df.select("i", hmm.shape_of(df["w"]).alias("s")).orderBy("i").collect()] == want


def test_hmm_is_a_distribution(spark):
    texts = ["a b", "a", "b b a", "", "a b a b", "cc"]
    df = spark.createDataFrame([(i, False, t) for i, t in enumerate(texts)], "doc_id long, held_out boolean, text string")
    counts = hmm.word_counts(df).cache()
    vocab = hmm.vocabulary(counts, 2)
    model = hmm.fit(df, vocab, states=2, warm_rounds=2)
    assert np.allclose(model.emit.sum(0), 1) and np.allclose(model.move.sum(1), 1) and np.isclose(model.start.sum(), 1)
    assert vocab.tokens == sum(len(t.split()) + 1 for t in texts) and vocab.types == 4
    rare = {r["shape"]: 0.0 for r in counts.collect()}
    for r in counts.collect():
        if r["word"] and bytes(r["word"]) not in vocab.ids:
            k = r["shape"]
            rare[k] += (r["c"] + 1) / (vocab.shape_tokens[k] + vocab.shape_types[k] + 1)
    assert all(x < 1 for x in rare.values())  # the rest is for the words unseen


def test_hmm_odd_rows(spark):
    rows = [(1, False, None), (None, False, "x y"), (2, True, "é " * 30_000), (2, True, "é é"), (3, None and False, "")]
    df = spark.createDataFrame([(a, bool(b), c, 1.0) for a, b, c in rows], "doc_id long, held_out boolean, text string, score double")
    got = hmm.language_model(df, states=2, warm_rounds=1).collect()
    assert len(got) == 5 and {r["doc_id"] for r in got} == {1, 2, 3, None}
    assert all(math.isfinite(r["score"]) and math.isfinite(r["base_score"]) for r in got)
    assert hmm.language_model(df.limit(0)).count() == 0
    assert hmm.language_model(df.where("held_out")).count() == 2  # nothing to learn from


# chat


def legal(roles):
    state = chat.START
    for r in roles:
        if r not in chat.NEXT[state]:
            return False
        state = r
    return state == 2


def brute_cost(roles):
    """Least cost over all ways: every turn's role, merge or not, inserted turns."""
    best = {chat.START: 0}
    for r in roles:
        new = {}
        for state, c in best.items():
            grown = {state: c}
            for _ in range(4):  # insert empty turns
                for s, x in list(grown.items()):
                    for t in chat.NEXT[s]:
                        grown[t] = min(grown.get(t, 10**9), x + chat.INSERT)
            for s, x in grown.items():
                for t in range(3):
                    label = 0 if t == r else chat.RELABEL
                    if t in chat.NEXT[s]:
                        new[t] = min(new.get(t, 10**9), x + label)
                    if s == t == state and x == c:
                        new[t] = min(new.get(t, 10**9), x + label + chat.MERGE)
        best = new
    return min(c + chat.INSERT * len(chat.CLOSING[s]) for s, c in best.items())


def test_chat_repair_is_cheapest_and_legal():
    for n in range(1, 5):
        for roles in itertools.product(range(4), repeat=n):
            steps = chat.repair(list(roles))
            out, cost = [], 0
            for r, (state, action, added) in zip(roles, steps, strict=True):
                out += added
                cost += chat.INSERT * len(added) + (chat.RELABEL if state != r else 0)
                if action.endswith("merge"):
                    cost += chat.MERGE
                    assert out[-1] == state
                else:
                    out.append(state)
            out += chat.CLOSING[steps[-1][0]]
            cost += chat.INSERT * len(chat.CLOSING[steps[-1][0]])
            assert legal(out) and cost == brute_cost(roles), (roles, steps)


def test_chat_over_partitions_equals_one_partition(spark):
    rnd = random.Random(2)
    rows = [(c, t, rnd.choice(["user", "assistant", "system", None, "Tool"]), f"t{t}") for c, n in ((7, 60), (8, 3), (9, 25), (10, 1)) for t in range(n)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")

    def rendered(per):
        out = {}
        for r in sorted(chat.formatted(df, per_partition=per).collect(), key=lambda r: (r["conv_id"], r["position"], r["part"])):
            out.setdefault(r["conv_id"], []).append(r)
        return out

    one, many = rendered(10**6), rendered(9)
    assert set(one) == set(many)
    for c in one:
        a, b = ("".join(r["rendered"] for r in x[c]) for x in (one, many))
        roles = [part.split("\n")[0] for part in b.split("<|im_start|>")[1:]]
        assert legal([chat.ROLES.index(r) for r in roles]) and b.count("<|im_end|>") == len(roles) and b.endswith("<|im_end|>\n")

        def cost(x):
            return sum({"keep": 0, "insert": chat.INSERT, "merge": chat.MERGE, "relabel": chat.RELABEL, "relabel+merge": chat.RELABEL + chat.MERGE}[r["action"]] for r in x[c])

        assert cost(one) == cost(many)
        assert a.count("<|im_start|>") == b.count("<|im_start|>")


def markup(turns):
    """The chat markup of one conversation's ordered (role, text), by the cheapest way that repair() finds (checked above)."""
    steps = chat.repair([chat.code(r) for r, _ in turns])
    out = []
    for (state, action, added), (_, text) in zip(steps, turns, strict=True):
        out += [[r, ""] for r in added]
        if action.endswith("merge"):
            out[-1][1] += "\n\n" + text
        else:
            out.append([state, text])
    out += [[r, ""] for r in chat.CLOSING[steps[-1][0]]]
    return "".join(f"<|im_start|>{chat.ROLES[r]}\n{x}<|im_end|>\n" for r, x in out)


def joined(rows):
    out = {}
    for r in sorted(rows, key=lambda r: (r["conv_id"], r["position"], r["part"])):
        out[r["conv_id"]] = out.get(r["conv_id"], "") + r["rendered"]
    return out


def test_chat_query_gives_the_whole_markup(spark, sf):
    turns = {}
    for r in spark.read.parquet(f"{sf}/conversations.parquet").where("conv_id is not null").selectExpr("*", "xxhash64(coalesce(text, '')) AS h").collect():
        turns.setdefault(r["conv_id"], []).append(((r["turn"] is None, r["turn"] or 0), (r["role"] is not None, r["role"] or ""), r["h"], r["text"] or ""))
    want = {c: markup([(role[1] or None, text) for _, role, _, text in sorted(x)]) for c, x in turns.items()}
    assert joined(QUERIES["op9_chat"](spark, sf).collect()) == want


def test_chat_order_of_tied_turns_does_not_depend_on_blocks(spark):
    rnd = random.Random(4)
    rows = [(c, rnd.choice([0, 0, 1, None]), rnd.choice(["user", "assistant", None]), f"text {rnd.randrange(9)}") for c in (1, 2, 3) for _ in range(30)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    one = joined(chat.formatted(df, per_partition=10**6).collect())
    for per in (4, 8, 25):
        many = joined(chat.formatted(df.repartition(5), per_partition=per).collect())
        strip = lambda x: [t.split("\n", 1)[1] for t in x.replace("<|im_end|>\n", "").split("<|im_start|>")[1:]]
        assert {c: "".join(strip(x)).replace("\n", "") for c, x in many.items()} == {c: "".join(strip(x)).replace("\n", "") for c, x in one.items()}


def test_chat_odd_rows(spark):
    rows = [(1, None, "user", "late"), (1, 0, None, None), (1, 0, None, None), (None, 0, "user", "lost"), (2, 0, "assistant", "x" * 100_000)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").selectExpr("*", "1 AS position", "'a' AS action")
    got = chat.formatted(df).collect()
    assert {r["conv_id"] for r in got} == {1, 2} and sum(len(r["text"]) for r in got) == 100_004
    assert chat.formatted(df.limit(0)).count() == 0


# media


def test_media_query_finds_every_edited_copy(spark):
    """The query's edits are crops to 60 %, turns of 15, 90 and 180 degrees, scales from 0.75 to 1.414 and several at once."""
    got = QUERIES["op4_media"](spark, "/root/testdata/sf0.1").collect()
    ids = {r["id"]: r["class"] for r in got if r["kind"] == "image"}
    asked = {r["id"]: r["query_class"] for r in got if r["kind"] == "query"}
    pairs = {(r["query_class"], r["class"]) for r in got if r["kind"] == "pair"}
    assert len(ids) == 2000 and set(asked) == {i for i in ids if i % 50 == 0}
    hits = {(q, ids[i]) for i, q in asked.items()} & pairs
    assert len(hits) >= 0.95 * len(asked) and len(pairs) == len(hits)


@pytest.mark.parametrize("edit", media.EDITS)
def test_media_recall_by_edit(edit):
    """Comparing all corners of 20 edited pictures with all corners of 60 pictures; the similarity found is the edit."""
    rng = np.random.default_rng(7)
    pictures = [media.draw(rng.normal(size=64)) for _ in range(60)]
    known = [media.corners(media.encode(p)) for p in pictures]
    turn, scale, crop = edit
    found, wrong = 0, 0
    for k in range(20):
        p = pictures[k]
        q = media.corners(media.encode(0.9 * media.warped(p, turn, scale, crop) + 6 + rng.normal(0, 1.5, media.warped(p, turn, scale, crop).shape)))
        for i, own in enumerate(known):
            if m := media.compared(q, own):
                found += i == k
                wrong += i != k
                if i == k:
                    assert abs((m[1] - turn + 180) % 360 - 180) < 3 and abs(m[2] / scale - 1) < 0.08
    assert found >= 18 and wrong == 0


def test_media_pairs_equal_comparing_all_corners(spark):
    """copies() through its tables gives what a comparison of every corner with every other gives, for near copies' classes too."""
    rng = np.random.default_rng(1)
    vectors = [rng.normal(size=64) for _ in range(12)]
    pictures = [media.draw(v) for v in vectors]
    pictures += [np.clip(pictures[3] + rng.normal(0, 2, pictures[3].shape), 0, 255) for _ in range(6)]  # near copies of number 3
    data = [media.encode(p) for p in pictures] + [media.encode(pictures[5])]
    images = spark.createDataFrame([(i, bytearray(p), 1, "x") for i, p in enumerate(data)], "id long, image binary, class int, corners string")
    asked = [media.encode(media.warped(pictures[i], *e)) for i, e in ((2, (15, 1, 1)), (3, (0, 1, 0.85)), (5, (90, 1, 1)), (7, (0, 1.414, 1)))]
    strange = media.encode(media.draw(rng.normal(size=64)))
    queries = spark.createDataFrame([(100 + i, bytearray(p), 2, "y") for i, p in enumerate([*asked, strange])], "id long, image binary, class int, corners string")
    got = media.copies(images, queries).collect()
    of = {r["id"]: r["class"] for r in got if r["kind"] == "image"}
    assert {of[i] for i in (3, *range(12, 18))} == {3} and of[18] == 5 and len(set(of.values())) == 12
    want = {}
    for i, p in enumerate([*asked, strange]):
        q = media.corners(p)
        for k in sorted(set(of.values())):
            own = media.corners(data[k])
            if m := media.compared(q, own):
                want[100 + i, k] = m[0]
    assert {(r["query_class"], r["class"]): r["inliers"] for r in got if r["kind"] == "pair"} == want
    assert set(want) == {(100, 2), (101, 3), (102, 5), (103, 7)}


def test_media_windows_are_bits():
    d = np.random.default_rng(0).integers(0, 1 << 63, (5, 2), dtype=np.uint64)
    for x, keys in zip(d, media.windows(d), strict=True):
        whole = int(x[0]) | int(x[1]) << 64
        whole |= whole << 128
        assert keys.tolist() == [whole >> at & (1 << media.WINDOW) - 1 | k << media.WINDOW for k, at in enumerate(range(0, 128, media.STEP))]


def test_media_odd_rows(spark):
    flat = media.encode(np.full((40, 40), 7.0))
    rows = [(1, None), (2, bytearray(b"")), (3, bytearray(b"P5 9 9 255\nxx")), (4, bytearray(flat)), (5, bytearray(flat)), (None, bytearray(flat)), (6, bytearray(b"P5 1 1 255\nx"))]
    df = spark.createDataFrame(rows, "id long, image binary").selectExpr("*", "1 AS cls", "2 AS h")
    got = media.copies(df.select("id", "image"), df.select("id", "image")).collect()
    assert {r["class"] for r in got if r["kind"] == "image" and r["id"] in (4, 5)} == {4} and not any(r["kind"] == "pair" for r in got)
    assert media.copies(df.select("id", "image").limit(0), df.select("id", "image").limit(0)).count() == 0


# pipeline


def test_pipeline_stages_take_effect(spark, sf, tmp_path):
    import corpus_pipeline

    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns, sizes = docs.columns, [docs.count()]
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, sf).write.parquet(f"{tmp_path}/{k}")
        docs = spark.read.parquet(f"{tmp_path}/{k}")
        sizes.append(docs.count())
        if k < 4:
            assert docs.columns == columns
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    kept = {r["doc_id"] for r in spark.read.parquet(f"{tmp_path}/0").collect()}
    everything = {r["doc_id"] for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id").collect()}
    known = everything & set(labels)
    assert sum((i in kept) == (labels[i] == 1) for i in known) > 0.95 * len(known)
    assert sizes[1] < sizes[0] and sizes[3] < sizes[2] and sizes[2] >= 0.99 * sizes[1]
    from loomgraph.llm import pii

    assert not any(pii.find(r["text"]) for r in spark.read.parquet(f"{tmp_path}/3").select("text").collect())
    assert {r["doc_id"] for r in docs.select("doc_id").collect()} == {r["doc_id"] for r in spark.read.parquet(f"{tmp_path}/3").select("doc_id").collect()}
    assert corpus_pipeline.run(spark, sf).count() == sizes[-1]


def test_pipeline_keeps_the_users_columns(spark, sf):
    """Columns named like what the stages compute pass unchanged, odd rows and repeated ids pass all stages."""
    import corpus_pipeline

    docs = spark.read.parquet(f"{sf}/documents.parquet").where("doc_id < 150")
    own = {"score": "-7.0D", "predicted": "9", "rejected": "true", "lang_pred": "'zz'", "_text": "'mine'", "found": "'f'", "judged": "'j'", "fp": "5", "node": "6", "root": "7", "spans": "'s'", "component_id": "8"}
    docs = docs.selectExpr("*", *(f"{v} AS {k}" for k, v in own.items()))
    values = docs.select(*own).first()
    good = [r["text"] for r in spark.read.parquet(f"{sf}/documents.parquet").join(spark.read.parquet(f"{sf}/labels.parquet").where("quality = 1"), "doc_id").orderBy("doc_id").limit(4).collect()]
    odd = [(None, good[0], "en"), (7001, None, "en"), (7002, "", None), (7003, good[1] * 1200, "en"), (7004, good[2], "en"), (7004, good[3], "en"), (7004, good[3], "en"), (7005, "hello world, " * 30_000, "en")]
    extra = spark.createDataFrame([(i, x, lang, "made", len(x or "")) for i, x, lang in odd], docs.select("doc_id", "text", "lang", "source", "n_chars").schema)
    docs = docs.unionByName(extra.selectExpr("*", *(f"{v} AS {k}" for k, v in own.items())))
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before = docs.count()
        docs = corpus_pipeline.materialise(stage(spark, docs, sf), "test-" + name)
        assert 0 < docs.count() <= before
        assert docs.select(*own).distinct().collect() == [values], name
    assert corpus_pipeline.STAGES[-1][1](spark, docs, sf).select("doc_id").distinct().count() == docs.select("doc_id").distinct().count()
    empty = docs.limit(0)
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty, sf).count() == 0, name


def patched(rng, base, share, size=72):
    """A picture of which the upper `share` is that of the base, the rest its own."""
    own = media.draw(rng.normal(size=size))
    own[: int(len(own) * share)] = base[: int(len(base) * share)]
    return own


def test_media_loses_no_pair_to_a_representative(spark):
    """Templates that share 20 to 80 % of a picture: every pair of a query and an image, representatives or not, that a comparison
    of all their corners finds is a pair row, or the row of its class with enough of the corners that the image shares."""
    rng = np.random.default_rng(3)
    pictures = []
    for share in (0.2, 0.4, 0.5, 0.6, 0.8):
        base = media.draw(rng.normal(size=72))
        pictures += [base, *(patched(rng, base, share) for _ in range(3))]
    crops = []
    for k, p in enumerate(pictures):
        h = len(p)
        crops += [p[h // 2 :], p[: h // 2]] if k % 4 else [p[h // 2 :]]
    data = [media.encode(p) for p in pictures]
    images = spark.createDataFrame([(i, bytearray(x)) for i, x in enumerate(data)], "id long, image binary")
    queries = spark.createDataFrame([(1000 + i, bytearray(media.encode(x))) for i, x in enumerate(crops)], "id long, image binary")
    got = media.copies(images, queries).collect()
    of = {r["id"]: (r["class"], set(r["agree"] or [])) for r in got if r["kind"] == "image"}
    asked = {r["id"]: r["query_class"] for r in got if r["kind"] == "query"}
    pairs = {(r["query_class"], r["class"]): set(r["agree"]) for r in got if r["kind"] == "pair"}
    assert any(k != c for k, (c, _) in of.items())  # some are represented
    known = [media.corners(x) for x in data]
    total = lost = 0
    for i, x in enumerate(crops):
        q = media.corners(media.encode(x))
        for k, own in enumerate(known):
            if m := media.compared(q, own):
                total += 1
                root, shared = of[k]
                at = asked[1000 + i]
                direct = (at, k) in pairs
                through = (at, root) in pairs and (k == root or len(pairs[at, root] & shared) >= 0.5 * m[0])
                lost += not (direct or through)
    assert total > len(crops) and lost <= 0.02 * total
    for alone in (False, True):  # the lower half of an image whose upper half an earlier one has, with and without that one
        base = media.draw(np.random.default_rng(9).normal(size=72))
        second = patched(np.random.default_rng(10), base, 0.5)
        table = [(2, second)] if alone else [(1, base), (2, second)]
        found = media.copies(spark.createDataFrame([(i, bytearray(media.encode(p))) for i, p in table], "id long, image binary"), spark.createDataFrame([(7, bytearray(media.encode(second[len(second) // 2 :])))], "id long, image binary")).collect()
        assert (7, 2) in {(r["query_class"], r["class"]) for r in found if r["kind"] == "pair"}
