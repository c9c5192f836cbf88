"""Copies among images by local descriptors: multiscale corners, orientation-normalised binary tests, Hamming tables, geometric consensus.

Images are binary columns in the PGM format (P5, 8 bits). Images of the same bytes are described once, and images whose
corners agree in good part in place and descriptor with those of an earlier one are represented by it as far as these
corners go, so that neither copies nor near copies among the images multiply the work; other corners stay their own. Two
corners are candidates if their descriptors agree on one of four 32-bit windows (the tables, joined on window and value). A query image and a representative that share candidates are
compared in full: corners within a Hamming distance vote for a turn, a scale and a shift, a similarity is fitted to the
votes that agree, and the corners that it maps onto each other are counted.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import matching, materialise

#: Tests lie within RADIUS of a corner; corners lie at least BORDER inside, tests beyond the edge read the edge.
ANGLES, TESTS, RADIUS, BORDER, MARGIN = 60, 128, 14.0, 8, 3.0
SCALES = tuple(2 ** (-k / 4) for k in range(5))
#: Bits of a table's key, and how far the windows that the tables are keyed by lie apart.
WINDOW, STEP = 32, 32
#: Candidate corners with one turn and step in scale that a pair of images needs to be compared in full, and their Hamming distance.
VOTES, VOTE_WITHIN = 2, 12
#: How far votes may differ in turn (radians) and in the logarithm of the scale, and how far a corner may lie from its image (pixels).
SPREAD, STRETCH, NEAR = np.radians(20), 0.36, 3.0
#: Share of an image's corners that agree in place and descriptor with those of the image that represents it.
SAME = 0.3
DISC_RADIUS = 9
#: Images described at a time.
BATCH = 32


def _tests() -> np.ndarray:
    """ANGLES x TESTS x 2 x 2 offsets (y, x): point pairs around a corner, turned by each angle."""
    rng = np.random.default_rng(1)
    r, t = RADIUS * np.sqrt(rng.random((TESTS, 2))), 2 * np.pi * rng.random((TESTS, 2))
    y, x = (r * np.sin(t))[None], (r * np.cos(t))[None]
    turn = 2 * np.pi * np.arange(ANGLES) / ANGLES
    c, s = np.cos(turn)[:, None, None], np.sin(turn)[:, None, None]
    return np.rint(np.stack([c * y + s * x, c * x - s * y], axis=-1)).astype(np.int64)


OFFSETS = _tests()
DISC = np.array([(y, x) for y in range(-DISC_RADIUS, DISC_RADIUS + 1) for x in range(-DISC_RADIUS, DISC_RADIUS + 1) if y * y + x * x <= DISC_RADIUS**2])


def decode(data: bytes) -> np.ndarray | None:
    """Grey values of a PGM image; None for anything else."""
    head = (data or b"").split(None, 4)
    if len(head) < 4 or head[0] != b"P5" or not all(x.isdigit() for x in head[1:4]):
        return None
    w, h = int(head[1]), int(head[2])
    at = 0
    for part in head[:4]:
        at = data.index(part, at) + len(part)
    body = data[at + 1 : at + 1 + w * h]
    return np.frombuffer(body, np.uint8).reshape(h, w) if len(body) == w * h and w and h else None


def encode(image: np.ndarray) -> bytes:
    return b"P5 %d %d 255\n" % image.shape[::-1] + np.clip(np.rint(image), 0, 255).astype(np.uint8).tobytes()


def _padded(a: np.ndarray, by: int) -> np.ndarray:
    return np.pad(a, ((0, 0), (by, by), (by, by)), mode="edge")


def _smooth(a: np.ndarray) -> np.ndarray:
    p, part = _padded(a, 2), np.float32(1 / 16)
    p = (6 * p[:, 2:-2] + 4 * (p[:, 1:-3] + p[:, 3:-1]) + p[:, :-4] + p[:, 4:]) * part
    return (6 * p[:, :, 2:-2] + 4 * (p[:, :, 1:-3] + p[:, :, 3:-1]) + p[:, :, :-4] + p[:, :, 4:]) * part


def _resized(a: np.ndarray, scale: float) -> np.ndarray:
    for axis in (1, 2):
        at = (np.arange(round(a.shape[axis] * scale)) + 0.5) / scale - 0.5
        low = np.clip(np.floor(at).astype(int), 0, a.shape[axis] - 1)
        part = np.clip(at - low, 0, 1).astype(np.float32).reshape([-1 if i == axis else 1 for i in range(3)])
        a = np.take(a, low, axis=axis) * (1 - part) + np.take(a, np.minimum(low + 1, a.shape[axis] - 1), axis=axis) * part
    return a


def describe(stack: np.ndarray, share: float = 0.01) -> tuple[np.ndarray, ...]:
    """Of images of one size: image, y, x (in source pixels), level, turn (radians) and 16 descriptor bytes of every corner.

    A corner is a local maximum of Harris' measure of at least `share` of its image's greatest, away from the border.
    """
    outs, base = [], stack.astype(np.float32)
    for level, scale in enumerate(SCALES):
        a = base if scale == 1 else _resized(_smooth(base), scale)
        h, w = a.shape[1:]
        if min(h, w) <= 2 * BORDER:
            continue
        a = _smooth(a)
        p = _padded(a, 1)
        gy, gx = (p[:, 2:, 1:-1] - p[:, :-2, 1:-1]) / 2, (p[:, 1:-1, 2:] - p[:, 1:-1, :-2]) / 2
        yy, xx, xy = _smooth(gy * gy), _smooth(gx * gx), _smooth(gx * gy)
        r = yy * xx - xy * xy - 0.05 * (yy + xx) ** 2
        p = _padded(r, 2)
        top = np.maximum.reduce([p[:, i : i + h] for i in range(5)])
        top = np.maximum.reduce([top[:, :, i : i + w] for i in range(5)])
        peak = (r == top) & (r >= np.maximum(share * r.max(axis=(1, 2), keepdims=True), 1.0))
        peak[:, :BORDER] = peak[:, -BORDER:] = False
        peak[:, :, :BORDER] = peak[:, :, -BORDER:] = False
        n, y, x = np.nonzero(peak)
        if not len(n):
            continue
        disc = a[n[:, None], np.clip(y[:, None] + DISC[:, 0], 0, h - 1), np.clip(x[:, None] + DISC[:, 1], 0, w - 1)]
        turn = np.arctan2(disc @ DISC[:, 0].astype(np.float32), disc @ DISC[:, 1].astype(np.float32))
        at = OFFSETS[np.rint(turn * ANGLES / (2 * np.pi)).astype(int) % ANGLES]
        v = a[n[:, None, None], np.clip(y[:, None, None] + at[..., 0], 0, h - 1), np.clip(x[:, None, None] + at[..., 1], 0, w - 1)]
        bits = np.packbits(v[..., 0] + MARGIN < v[..., 1], axis=1)
        outs.append((n, (y + 0.5) / scale - 0.5, (x + 0.5) / scale - 0.5, np.full(len(n), level), turn.astype(float), bits))
    if not outs:
        return np.zeros(0, int), np.zeros(0), np.zeros(0), np.zeros(0, int), np.zeros(0), np.zeros((0, 16), np.uint8)
    return tuple(np.concatenate(x) for x in zip(*outs, strict=True))


#: A corner: place, y and x in pixels; its level and turn; its descriptor.
CORNER = np.dtype([("y", "<f4"), ("x", "<f4"), ("level", "<i2"), ("turn", "<f4"), ("d", "<u8", 2)])


def corners(data: bytes) -> np.ndarray:
    """The corners of one image; none if it cannot be read."""
    return _corners([data])[0]


def _corners(images: list[bytes]) -> list[np.ndarray]:
    out = [np.zeros(0, CORNER) for _ in images]
    sizes: dict[tuple[int, int], list[tuple[int, np.ndarray]]] = {}
    for i, data in enumerate(images):
        if (image := decode(data)) is not None:
            sizes.setdefault(image.shape, []).append((i, image))
    for own in sizes.values():
        n, y, x, level, turn, bits = describe(np.stack([image for _, image in own]))
        found = np.zeros(len(n), CORNER)
        found["y"], found["x"], found["level"], found["turn"] = y, x, level, turn
        found["d"] = np.ascontiguousarray(bits).view("<u8").reshape(-1, 2)
        order = np.argsort(n, kind="stable")
        for (i, _), part in zip(own, np.split(found[order], np.searchsorted(n[order], np.arange(1, len(own)))), strict=True):
            out[i] = part
    return out


def windows(d: np.ndarray) -> np.ndarray:
    """The tables' keys of descriptors (n x 2): a row for each, a column for each window, the window's number in the high bits."""
    low, high = d[:, 0], d[:, 1]
    out = []
    for k, at in enumerate(range(0, 128, STEP)):
        x, y, by = (low, high, at) if at < 64 else (high, low, at - 64)
        v = x >> np.uint64(by)
        if by + WINDOW > 64:
            v = v | y << np.uint64(64 - by)
        out.append((v & np.uint64((1 << WINDOW) - 1)).astype(np.int64) | k << WINDOW)
    return np.stack(out, axis=1)


def agreed(a: np.ndarray, b: np.ndarray, within: int) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of corners of a and b at the same place and level, within a Hamming distance."""
    out = [(np.zeros(0, int), np.zeros(0, int))]
    step = max(1, (1 << 18) // max(len(b), 1))
    for at in range(0, len(a), step):
        x = a[at : at + step, None]
        same = (np.abs(x["y"] - b["y"]) <= 1.5) & (np.abs(x["x"] - b["x"]) <= 1.5) & (x["level"] == b["level"])
        i, j = np.nonzero(same)
        ok = np.bitwise_count(a["d"][at + i] ^ b["d"][j]).sum(1) <= within
        out.append((at + i[ok], j[ok]))
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))


def agreeing(a: np.ndarray, b: np.ndarray, within: int) -> float:
    """Share of a's corners that have one of b at the same place and level, within a Hamming distance."""
    return len(np.unique(agreed(a, b, within)[0])) / len(a) if len(a) else 0.0


def matched(q: np.ndarray, known: np.ndarray, within: int) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of corners within a Hamming distance, of all pairs."""
    out = [(np.zeros(0, int), np.zeros(0, int))]
    step = max(1, (1 << 17) // max(len(known), 1))
    for at in range(0, len(q), step):
        i, j = np.nonzero(np.bitwise_count(q["d"][at : at + step, None] ^ known["d"][None]).sum(2) <= within)
        out.append((i + at, j))
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))


def consensus(q: np.ndarray, known: np.ndarray) -> tuple[int, float, float, float, float, np.ndarray] | None:
    """Of matched corners (row by row): how many the best similarity maps onto each other, its turn (degrees), scale, dx and dy, and which rows.

    Each match votes for a similarity about its own corner; the matches that agree with the votes most agreed with fit one
    by least squares, which is fitted again to the matches that it maps well. Corners at one place count once. None: no fit.
    """
    z, u = q["x"] + 1j * q["y"].astype(float), known["x"] + 1j * known["y"].astype(float)
    level = np.array(SCALES)
    m = level[known["level"]] / level[q["level"]] * np.exp(1j * (q["turn"].astype(float) - known["turn"]))
    log, best = np.log(m), None
    votes, near = np.zeros(len(z), int), []

    def alike(own: np.ndarray, other: np.ndarray) -> np.ndarray:
        d = other - own
        return (np.abs(np.angle(np.exp(1j * d.imag))) <= SPREAD) & (np.abs(d.real) <= STRETCH)

    step = max(1, (1 << 16) // max(len(z), 1))
    for at in range(0, len(z), step):
        h = slice(at, at + step)
        off = u[None] - u[h, None]
        ok = alike(log[h, None], log[None]) & (np.abs(z[None] - z[h, None] - m[h, None] * off) <= 2 + 0.2 * np.abs(m[h, None] * off))
        votes[h] = ok.sum(1)
        near += [(at + int(i), ok[i]) for i in np.argsort(-votes[h], kind="stable")[:8]]
    near.sort(key=lambda x: (-votes[x[0]], x[0]))
    for _, k in near[:8]:
        for _ in range(3):
            if k.sum() < 3:
                break
            uc, zc = u[k].mean(), z[k].mean()
            spread = (np.abs(u[k] - uc) ** 2).sum()
            if spread < 1:
                break
            fit = (np.conj(u[k] - uc) * (z[k] - zc)).sum() / spread
            if abs(fit) < 1e-3:
                break
            shift = zc - fit * uc
            k = (np.abs(z - fit * u - shift) <= NEAR) & alike(np.log(fit), log)
        else:
            count = min(len(np.unique(np.rint(z[k] / 4))), len(np.unique(np.rint(u[k] / 4))))
            if count and (best is None or count > best[0]):
                best = (count, float(np.degrees(np.angle(fit)) % 360), float(abs(fit)), float(shift.real), float(shift.imag), np.flatnonzero(k))
    return best


def compared(q: np.ndarray, known: np.ndarray, within: int = 20, inliers: int = 5, share: float = 0.1) -> tuple[int, float, float, float, float, np.ndarray] | None:
    """consensus() of all corners of q and known, and the corners of known that agree, if at least `inliers` corners and that share of q's do."""
    i, j = matched(q, known, within)
    found = consensus(q[i], known[j]) if len(i) >= inliers else None
    return (*found[:5], np.unique(j[found[5]])) if found and found[0] >= max(inliers, share * len(q)) else None


def classes(images: DataFrame, tag: str) -> tuple[DataFrame, DataFrame]:
    """(id, exact) of each row of (id, image), and (exact, corners) of each class: the rows of the same bytes, named by their least id."""
    named = images.where("image is not null and id is not null").withColumn("h", F.sha2("image", 256))
    one = materialise(named.groupBy("h").agg(F.min("id").alias("exact"), F.first("image").alias("image")), f"media-{tag}")

    @F.pandas_udf("binary")
    def described(images_: pd.Series) -> pd.Series:
        out = []
        for at in range(0, len(images_), BATCH):
            out += [x.tobytes() for x in _corners(images_.iloc[at : at + BATCH].tolist())]
        return pd.Series(out, dtype=object)

    return named.select("id", "h").join(one.select("h", "exact"), "h").select("id", "exact"), one.select("exact", described("image").alias("corners"))


def tabled(df: DataFrame, name: str, placed: bool = False) -> DataFrame:
    """(name, key, corner, pose, d0, d1) of the corners of (name, corners): a row for each value of each window in an image, with
    the first corner that has it (pose: its level, and its turn in 256ths); or with `placed` a row for each corner of the first level, keyed by one window's value and the place."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for at in range(0, len(pdf), BATCH):
                part = pdf.iloc[at : at + BATCH]
                out = []
                for who, raw in zip(part[name], part["corners"], strict=True):
                    own = np.frombuffer(raw, CORNER)
                    if placed:
                        own = own[own["level"] == 0]
                        cell = (np.floor(own["y"] / 4).astype(np.int64) & 0x3FFF) << 14 | np.floor(own["x"] / 4).astype(np.int64) & 0x3FFF
                        k = windows(own["d"])[:, :1] | cell[:, None] << WINDOW
                    else:
                        k = windows(own["d"])
                    keys, first = np.unique(k.ravel(), return_index=True)
                    first = first // k.shape[1]
                    d, pose = own["d"][first].view(np.int64), (own["level"].astype(np.int32) << 8) | (np.floor(own["turn"] * (128 / np.pi)).astype(np.int32) & 255)
                    out.append(pd.DataFrame({name: who, "key": keys, "corner": first.astype(np.int32), "pose": pose[first], "d0": d[:, 0], "d1": d[:, 1]}))
                yield pd.concat(out)

    return df.select(name, "corners").mapInPandas(run, f"{name} {df.schema[name].dataType.simpleString()}, key long, corner int, pose int, d0 long, d1 long")


def represented(known: DataFrame, within: int, same: float = SAME, rounds: int = 3) -> DataFrame:
    """(exact, class): the image that represents each of (exact, corners).

    In each key of window value and place the least image is a candidate for the others; the one met most often represents
    an image if `same` of its corners agree. Images whose candidate is itself represented try again among the rest, for
    `rounds` rounds; those still open then represent themselves, which costs work but loses nothing.
    """
    keys = materialise(tabled(known, "exact", True).select("exact", "key"), "media-places")

    @F.pandas_udf("double")
    def share(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([agreeing(np.frombuffer(x, CORNER), np.frombuffer(y, CORNER), within) for x, y in zip(a, b, strict=True)], dtype=float)

    open_, roots, done = keys, None, None
    for _ in range(rounds):
        first = open_.groupBy("key").agg(F.min("exact").alias("first"), F.count("*").alias("n")).where("n > 1").select("key", "first")
        votes = open_.join(first, "key").where("exact <> first").groupBy("exact", "first").count().where(F.col("count") > VOTES)
        most = votes.groupBy("exact").agg(F.max(F.struct("count", -F.col("first"), "first")).alias("m")).select("exact", F.col("m.first").alias("class"))
        mine, other = known.select("exact", F.col("corners").alias("a")), known.select(F.col("exact").alias("class"), F.col("corners").alias("b"))
        if roots is not None:
            most = most.join(roots, "exact", "left_anti")  # roots stay
        linked = materialise(most.join(mine, "exact").join(other, "class").where(share("a", "b") >= same).select("exact", "class"), "media-linked")
        taken = linked.select(F.col("exact").alias("class"))
        sure, unsure = linked.join(taken, "class", "left_anti"), linked.join(taken, "class", "left_semi").select("exact")
        done = sure if done is None else done.unionByName(sure)
        unsure = materialise(unsure, "media-open")
        if not unsure.take(1):
            break
        # those that represent others, or that nothing was found for, stay as candidates
        roots = materialise(known.select("exact").join(done.select("exact"), "exact", "left_anti").join(unsure, "exact", "left_anti"), "media-roots")
        open_ = keys.join(done.select("exact"), "exact", "left_anti")
    return known.select("exact").join(done, "exact", "left").select("exact", F.coalesce("class", "exact").alias("class"))


def copies(images: DataFrame, queries: DataFrame, within: int = 20, inliers: int = 5, share: float = 0.1, same: float = SAME) -> DataFrame:
    """Which images each query image is a copy of. Both tables: (id, image); further columns take no part.

    Rows of kind `pair`: query_class, class, and the corners that agree (inliers), with the turn (degrees), scale, dx
    and dy of the similarity that maps the image onto the query, and which corners of the image they are (agree). Rows of
    kind `image` and `query`: the class of each row of either table, so neither copies nor near copies are expanded into
    pairs: a query's class holds its rows of the same bytes, an image's class the images that one of them represents (see
    represented()); agree then lists the corners of the representative that the image shares. A query that is a copy of a
    representative is one of those members of its class that share enough of the corners of the pair. A member has corners of
    its own as well, through which any query meets it that no copy of its representative is: such a pair names the member
    itself as class. Null ids and null images take no part; images that cannot be read or have no corners are in a class but
    in no pair. Of repeated ids each row has its class. Pairs of equal id are reported like any other. Ties go to the smaller
    id. Images of any size are described whole, one batch of equal sizes at a time. No rows: no rows.
    """
    image_ids, known = classes(images, "images")
    query_ids, asked = classes(queries, "queries")
    known, asked = materialise(known, "media-known"), materialise(asked, "media-asked")
    of = materialise(represented(known, within, same), "media-classes")
    held = known.join(of.where(F.col("exact") == F.col("class")), "exact").select("class", "corners", F.col("class").alias("root"))
    held = materialise(held, "media-held")

    @F.pandas_udf("rest binary, agree array<int>")
    def parted(a: pd.Series, b: pd.Series) -> pd.DataFrame:
        """The corners of an image that its representative lacks, and the corners of the representative that it shares."""
        out = []
        for x, y in zip(a, b, strict=True):
            own = np.frombuffer(x, CORNER)
            i, j = agreed(own, np.frombuffer(y, CORNER), within)
            out.append((np.delete(own, np.unique(i)).tobytes(), np.unique(j).astype(np.int32)))
        return pd.DataFrame(out, columns=["rest", "agree"])

    members = known.join(of.where(F.col("exact") != F.col("class")).withColumnRenamed("class", "root"), "exact").join(held.select("root", F.col("corners").alias("b")), "root")
    members = materialise(members.select(F.col("exact").alias("class"), "root", "corners", parted("corners", "b").alias("p")).select("class", "root", "corners", "p.*"), "media-members")

    asked = asked.withColumnRenamed("exact", "query_class")
    table = materialise(tabled(asked, "query_class").withColumnsRenamed({"d0": "q0", "d1": "q1", "pose": "q_pose"}), "media-table")
    distance = F.bit_count(F.col("q0").bitwiseXOR(F.col("d0"))) + F.bit_count(F.col("q1").bitwiseXOR(F.col("d1")))
    keys = table.select("key").distinct()

    def candidates(index: DataFrame, done: DataFrame | None = None, near: DataFrame | None = None) -> DataFrame:
        """(query_class, class) with votes for a turn (in bins of 45 degrees that overlap by half) and a step in scale.

        done: (query_class, roots) of pairs left out; near: (query_class, root) of pairs whose members need one vote of their own only.
        """
        own = matching(tabled(index, "class").drop("corner"), keys, "key", "left_semi")  # only corners whose key some query has are shuffled
        if done is None:
            met = own.join(table, "key").where(distance <= VOTE_WITHIN)
        else:
            own = own.join(index.select("class", "root"), "class")
            asks = table.join(done, "query_class", "left").withColumn("roots", F.coalesce("roots", F.array().cast(f"array<{kind}>"))).withColumnRenamed("key", "asked_key")
            met = own.join(asks, (F.col("key") == F.col("asked_key")) & ~F.array_contains("roots", F.col("root"))).where(distance <= VOTE_WITHIN)
        turn = (F.col("q_pose") - F.col("pose")).bitwiseAND(255)
        bins = F.array(F.shiftright(turn, 5), F.shiftright(turn + 16, 5).bitwiseAND(7) + 8)
        root = [] if done is None else ["root"]
        met = met.select("query_class", "class", *root, "corner", (F.shiftright("q_pose", 8) - F.shiftright("pose", 8)).alias("step"), F.explode(bins).alias("bin"))
        met = met.groupBy("query_class", "class", *root, "step", "bin").agg(F.countDistinct("corner").alias("votes"))
        if near is not None:
            met = met.join(near.withColumn("near", F.lit(1)), ["query_class", "root"], "left")
            met = met.withColumn("votes", F.col("votes") + F.coalesce("near", F.lit(0)) * (VOTES - 1))
        met = met.where(F.col("votes") >= VOTES)
        return materialise(met.select("query_class", "class").distinct(), "media-met")

    @F.pandas_udf("inliers int, turn double, scale double, dx double, dy double, agree array<int>")
    def fitted(a: pd.Series, b: pd.Series) -> pd.DataFrame:
        out = []
        for x, y in zip(a, b, strict=True):
            found = compared(np.frombuffer(x, CORNER), np.frombuffer(y, CORNER), within, inliers, share)
            out.append((*found[:5], found[5].astype(np.int32)) if found else (0, 0.0, 1.0, 0.0, 0.0, np.zeros(0, np.int32)))
        return pd.DataFrame(out, columns=["inliers", "turn", "scale", "dx", "dy", "agree"]).astype({"inliers": "int32"})

    def verified(met: DataFrame, index: DataFrame) -> DataFrame:
        both = met.join(asked.withColumnRenamed("corners", "a"), "query_class").join(index.select("class", "root", F.col("corners").alias("b")), "class")
        return materialise(both.select("query_class", "class", "root", fitted("a", "b").alias("m")).where(F.col("m.inliers") > 0), "media-pairs")

    kind = images.schema["id"].dataType.simpleString()
    first = candidates(held)
    best = verified(first, held)
    if members.take(1):
        done = best.groupBy("query_class").agg(F.collect_set("root").alias("roots"))
        rest = members.select("class", "root", F.col("rest").alias("corners"))
        # what a representative shows in part may be whole in a member that has the other part
        near = first.join(best.select("query_class", "class"), ["query_class", "class"], "left_anti").withColumnRenamed("class", "root")
        best = best.unionByName(verified(candidates(rest, done, near), members))
    pairs = best.select(F.lit("pair").alias("kind"), F.lit(None).cast(kind).alias("id"), "query_class", "class", "m.inliers", F.round("m.turn", 3).alias("turn"), F.round("m.scale", 4).alias("scale"), F.round("m.dx", 3).alias("dx"), F.round("m.dy", 3).alias("dy"), "m.agree")
    shared = members.select(F.col("class").alias("exact"), "agree")
    rows = image_ids.join(of, "exact").join(shared, "exact", "left").select(F.lit("image").alias("kind"), "id", F.lit(None).cast(kind).alias("query_class"), "class", "agree")
    rows = rows.unionByName(query_ids.select(F.lit("query").alias("kind"), "id", F.col("exact").alias("query_class"), F.lit(None).cast(kind).alias("class")), allowMissingColumns=True)
    return pairs.unionByName(rows, allowMissingColumns=True)


def draw(vector, block: int = 9) -> np.ndarray:
    """A picture of a vector: a square grid of blocks, one for each component, grey by its rank among them."""
    v = np.asarray(vector, dtype=np.float64)
    side = max(1, int(np.ceil(np.sqrt(max(len(v), 1)))))
    grey = np.full(side * side, 128.0)
    if len(v):
        grey[: len(v)] = 20 + 215 * np.argsort(np.argsort(v, kind="stable")) / max(len(v) - 1, 1)
    return np.kron(grey.reshape(side, side), np.ones((block, block)))


def drawn(vector: Column) -> Column:
    @F.pandas_udf("binary")
    def run(vectors: pd.Series) -> pd.Series:
        return pd.Series([None if v is None else encode(draw(v)) for v in vectors], dtype=object)

    return run(vector)


def warped(image: np.ndarray, turn: float = 0.0, scale: float = 1.0, crop: float = 1.0, down: float = 0.0, right: float = 0.0) -> np.ndarray:
    """The picture turned (degrees) and scaled, seen through a window of `crop` of its sides whose middle is shifted; grey beyond its edges."""
    h, w = image.shape
    y, x = np.mgrid[0 : max(1, round(h * scale * crop)), 0 : max(1, round(w * scale * crop))].astype(float)
    y, x = (y - (y.shape[0] - 1) / 2) / scale + down, (x - (x.shape[1] - 1) / 2) / scale + right
    c, s = np.cos(np.radians(turn)), np.sin(np.radians(turn))
    y, x = c * y - s * x + (h - 1) / 2, s * y + c * x + (w - 1) / 2
    inside = (y >= -0.5) & (y <= h - 0.5) & (x >= -0.5) & (x <= w - 0.5)
    y, x = np.clip(y, 0, h - 1), np.clip(x, 0, w - 1)
    y0, x0 = np.floor(y).astype(int), np.floor(x).astype(int)
    y1, x1, fy, fx = np.minimum(y0 + 1, h - 1), np.minimum(x0 + 1, w - 1), y - y0, x - x0
    grey = image[y0, x0] * (1 - fy) * (1 - fx) + image[y1, x0] * fy * (1 - fx) + image[y0, x1] * (1 - fy) * fx + image[y1, x1] * fy * fx
    return np.where(inside, grey, 128.0)


#: The edits that edit() deals out: turn, scale, crop.
EDITS = ((0, 1, 0.85), (15, 1, 1), (90, 1, 1), (0, 0.75, 1), (0, 1.414, 1), (0, 1, 0.6), (25, 1.2, 0.75), (180, 0.85, 0.9))


def edit(data: bytes) -> bytes | None:
    """A turned, scaled or cropped copy with other brightness and noise, all given by the picture's bytes."""
    image = decode(data)
    if image is None or min(image.shape) < 16:
        return data
    seed = zlib.crc32(data)
    rng = np.random.default_rng(seed)
    turn, scale, crop = EDITS[seed % len(EDITS)]
    room = (1 - crop) / 2 * min(image.shape)
    image = warped(image.astype(float), turn, scale, crop, *(rng.uniform(-0.5, 0.5, 2) * room))
    return encode(image * (0.85 + (seed >> 16 & 15) / 100) + (seed >> 20 & 15) + rng.normal(0, 1.5, image.shape))


def edited(image: Column) -> Column:
    @F.pandas_udf("binary")
    def run(images: pd.Series) -> pd.Series:
        return pd.Series([None if x is None else edit(x) for x in images], dtype=object)

    return run(image)
