"""Best-fit packing by bin completion branch-and-bound over the histogram of piece lengths.

The search needs only how many pieces have each length (at most `capacity` numbers), so the driver's work does not
grow with the documents. It takes the largest length left, enumerates undominated fillings of the room beside it, and
applies a filling as often as the counts allow; waste bounds prune, the best solution so far is the incumbent. What
is above the lower bound at the end of the search is repaired sequence by sequence, or, if asked for, searched to the end. The
result is a list of runs (length, first rank) -> (sequence, offset); pieces find theirs by their rank in their length.
"""

from __future__ import annotations

import os
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import materialise

Run = tuple[int, int, int, int, int, int]  # length, first rank, pieces, first sequence, pieces in each sequence, offset


def fullest(counts: list[int], used: list[int], room: int) -> list[int]:
    """The pieces of counts[length] less `used` with the greatest sum up to room, larger ones first: nothing left fits beside them."""
    taken: dict[int, int] = {}
    for x in used:
        taken[x] = taken.get(x, 0) + 1
    reach, steps = 1, []  # bit s: the pieces so far can have the sum s
    every = (1 << (room + 1)) - 1
    for x in range(1, min(room, len(counts) - 1) + 1):
        free, k = min(counts[x] - taken.get(x, 0), room // x) if counts[x] else 0, 1
        while free > 0:
            k = min(k, free)
            steps.append((x, k, reach))
            reach |= (reach << (x * k)) & every
            free, k = free - k, 2 * k
    out, left = [], reach.bit_length() - 1
    for x, k, before in reversed(steps):
        if left >= x * k and before >> (left - x * k) & 1:
            out += [x] * k
            left -= x * k
    return out


def fillings(counts: list[int], room: int, most: int) -> list[list[int]]:
    """Undominated ways to fill room from counts[length], least waste first; [] only if nothing fits.

    Head pieces and up to three more, the gap filled with what fits best; then, if all these waste, the fullest way.
    """
    tried = _tried(counts, room, most)
    found = []
    for x in tried:
        way = sorted(x + fullest(counts, x, room - sum(x)), reverse=True)
        if way not in found:
            found.append(way)
    if min(room - sum(x) for x in found) > 0:
        way = fullest(counts, [], room)
        if sum(way) > max(map(sum, found)):
            found.append(way)
    return sorted(found, key=sum, reverse=True)[:most]


def _tried(counts: list[int], room: int, most: int) -> list[list[int]]:
    if room > 0 and counts[room] > 0:
        return [[room]]  # one piece that fills the room dominates every other filling
    head: list[int] = []
    have = [x for x in range(min(room, len(counts) - 1), 0, -1) if counts[x]]
    if not have:
        return [[]]
    left = dict.fromkeys(have, 0)
    for x in have:  # far more room than any piece has: the largest pieces go in first
        while room > 4 * have[0] and left[x] < counts[x] and x <= room:
            k = max(1, min(counts[x] - left[x], (room - 4 * have[0]) // x))
            head += [x] * k
            left[x] += k
            room -= x * k
    free = lambda x, used: counts[x] - left.get(x, 0) - used > 0 if x < len(counts) else False
    found: list[list[int]] = []
    budget = 4000
    for waste in range(room):
        want = room - waste
        if free(want, 0):
            found.append([want])
            break  # what follows wastes more than this single piece
        for a in have:
            if a >= want or not free(a, 0):
                continue
            b = want - a
            budget -= 1
            if b <= a and free(b, a == b):
                found.append([a, b])
            if len(found) >= most or budget < 0:
                break
        for a in have if len(found) < most and budget >= 0 else []:
            if a >= want or not free(a, 0):
                continue
            for b in have:
                budget -= 1
                c = want - a - b
                if b > a or c <= 0 or budget < 0:
                    continue
                if c > b:
                    break
                if free(b, a == b) and free(c, (a == c) + (b == c)):
                    found.append([a, b, c])
                    if len(found) >= most:
                        break
            if len(found) >= most or budget < 0:
                break
        if found or budget < 0:
            break
    if not found:  # largest first
        rest, room_left = [], room
        for x in have:
            k = min(counts[x] - left[x], room_left // x)
            rest += [x] * k
            room_left -= k * x
        found = [rest]
    return [head + x for x in found[:most]]


def least_sequences(histogram: dict[int, int], capacity: int) -> int:
    """Martello and Toth's second lower bound; at least the sum of lengths over the capacity."""
    n, size = np.zeros(capacity + 2, np.int64), np.arange(capacity + 2)
    for k, v in histogram.items():
        n[k] += v
    above, weight = np.cumsum(n[::-1])[::-1], np.cumsum((n * size)[::-1])[::-1]  # of the pieces of at least that length
    half, best = capacity // 2 + 1, -(-int(weight[0]) // capacity)
    for a in range(1, capacity // 2 + 1):
        alone, wide = int(above[capacity - a + 1]), int(above[half] - above[capacity - a + 1])
        spare = wide * capacity - int(weight[half] - weight[capacity - a + 1])
        best = max(best, alone + wide + max(0, -(-(int(weight[a] - weight[half]) - spare) // capacity)))
    return best


def best_fit(histogram: dict[int, int], capacity: int) -> tuple[list[tuple[list[int], int]], int]:
    """Best-fit decreasing as (pattern, times), and the number of sequences; equal pieces are placed together."""
    open_: dict[int, list[tuple[list[int], int]]] = {}  # room left: patterns

    def put(pattern: list[int], times: int, room: int) -> None:
        if times:
            open_.setdefault(room, []).append((pattern, times))

    for x in sorted((k for k, v in histogram.items() if k and v), reverse=True):
        left = histogram[x]
        while left:
            room = min((r for r in open_ if r >= x), default=capacity)
            if room == capacity and capacity not in open_:
                pattern, times = [], -(-left * x // (capacity // x * x))
            else:
                pattern, times = open_[room].pop()
                if not open_[room]:
                    del open_[room]
            each = room // x
            full = min(times, left // each)
            put(pattern + [x] * each, full, room - each * x)
            left -= full * each
            if full < times:
                if left:
                    put(pattern + [x] * left, 1, room - left * x)
                if pattern:
                    put(pattern, times - full - (left > 0), room)
                left = 0
    path = [y for x in open_.values() for y in x]
    return path, sum(times for _, times in path)


def _maximal(have: list[int], counts: list[int], room: int, slack: int) -> Iterator[list[int]]:
    """Every way to fill room from the lengths `have` (falling) that leaves no room for a further piece and wastes at most slack."""

    def go(i: int, room: int, way: list[int], passed: int) -> Iterator[list[int]]:
        # passed: the least length of which pieces were left although they may fit
        while i < len(have) and have[i] > room:
            i += 1
        if i == len(have):
            if room <= slack and (not passed or passed > room):
                yield list(way)
            return
        x = have[i]
        most = min(counts[x], room // x)
        for k in range(most, -1, -1):
            yield from go(i + 1, room - k * x, way + [x] * k, x if k < counts[x] else passed)

    yield from go(0, room, [], 0)


def exactly(histogram: dict[int, int], capacity: int, best: tuple[list[tuple[list[int], int]], int], bound: int, nodes: int | None = None) -> tuple[list[tuple[list[int], int]], int, bool]:
    """The best solution and whether it is proved: every maximal filling around the largest piece, one sequence at a time.

    Branches end where the waste so far, or the lower bound of what is left, allows no better solution, and where the same
    pieces were left before with no more sequences used. nodes: an end to the search; None: none.
    """
    total, (path, most) = sum(k * v for k, v in histogram.items()), best
    start = [0] * (capacity + 1)
    for k, v in histogram.items():
        start[k] += v
    seen: dict[tuple[int, ...], int] = {}
    done = 0
    stack: list[tuple[tuple[int, ...], int, int, tuple]] = [(tuple(start), 0, 0, ())]
    while stack and most > bound:
        counts, used, waste, so_far = stack.pop()
        if used + least_sequences({x: n for x, n in enumerate(counts) if n}, capacity) >= most or seen.get(counts, most) <= used:
            if any(counts) or used >= most:
                continue
        if not any(counts):
            path, most = [(list(x), 1) for x in so_far], used
            continue
        done += 1
        if nodes is not None and done > nodes:
            return path, most, False
        seen[counts] = used
        slack = (most - 1) * capacity - total - waste
        own = list(counts)
        have = [x for x in range(capacity, 0, -1) if own[x]]
        largest = have[0]
        own[largest] -= 1
        ways = sorted(_maximal([x for x in have if own[x]], own, capacity - largest, slack), key=sum)
        for way in ways:  # the fullest comes last, so it is taken first
            left = list(own)
            for x in way:
                left[x] -= 1
            stack.append((tuple(left), used + 1, waste + capacity - largest - sum(way), (*so_far, (largest, *way))))
    return path, most, True


def _recreated(histogram: dict[int, int], capacity: int, rng: np.random.Generator) -> list[tuple[int, ...]]:
    """Sequences around the largest piece left, each filled by a random exact pair or triple, else as full as can be."""
    counts = [0] * (capacity + 1)
    for k, v in histogram.items():
        counts[k] += v
    out = []
    for largest in range(capacity, 0, -1):
        while counts[largest]:
            counts[largest] -= 1
            room = capacity - largest
            have = np.flatnonzero(counts[: room + 1])
            pairs = [(int(b), room - int(b)) for b in have if 2 * b >= room and counts[room - b] > (2 * b == room)] + [(room, 0)] * bool(room and counts[room])
            way = [x for x in pairs[rng.integers(len(pairs))] if x] if pairs else fullest(counts, [], room) if room else []
            for x in way:
                counts[x] -= 1
            out.append((largest, *way))
    return out


def repaired(path: list[tuple[list[int], int]], capacity: int, bound: int, rounds: int, seed: int = 42) -> tuple[list[tuple[list[int], int]], int]:
    """A solution of no more sequences: the least full ones and some at random are emptied and filled again, round by round.

    A round counts if it takes fewer sequences, or as many with the waste in fewer of them.
    """
    rng, held = np.random.default_rng(seed), {}
    for pattern, times in path:
        key = tuple(sorted(pattern, reverse=True))
        held[key] = held.get(key, 0) + times
    size = sum(held.values())
    weight = lambda bins: sum(n * (capacity - sum(x)) ** 2 for x, n in bins.items())
    for _ in range(rounds):
        if size <= bound:
            break
        open_ = sorted((x for x in held if sum(x) < capacity), key=sum)[: int(rng.integers(2, 24))]
        taken = {x: min(held[x], 2) for x in open_}
        names = list(held)
        for i in rng.integers(len(names), size=int(rng.integers(4, 40))):
            if taken.get(names[i], 0) < held[names[i]]:
                taken[names[i]] = taken.get(names[i], 0) + 1
        pieces: dict[int, int] = {}
        for x, n in taken.items():
            for y in x:
                pieces[y] = pieces.get(y, 0) + n
        new: dict[tuple[int, ...], int] = {}
        for x in _recreated(pieces, capacity, rng):
            new[x] = new.get(x, 0) + 1
        before, after = sum(taken.values()), sum(new.values())
        if after < before or after == before and weight(new) >= weight(taken):
            for x, n in taken.items():
                held[x] -= n
                if not held[x]:
                    del held[x]
            for x, n in new.items():
                key = tuple(sorted(x, reverse=True))
                held[key] = held.get(key, 0) + n
            size += after - before
    return [(list(x), n) for x, n in held.items()], size


def solve(histogram: dict[int, int], capacity: int, nodes: int | None = 6000, branch: int = 4, rounds: int = 1000) -> tuple[list[Run], int]:
    """Runs that place every piece, and the number of sequences.

    The incumbent is best-fit decreasing. The search ends at the lower bound or, once one branch is complete, after
    `nodes` nodes of at most `branch` fillings each; what is above the bound then is repaired for `rounds` rounds (see
    repaired()). nodes None: the search goes on over all fillings without an end until the solution is proved to be the
    best (see exactly()), which takes exponential time in the worst case.
    """
    total = sum(k * v for k, v in histogram.items())
    bound = least_sequences(histogram, capacity)
    best: list = list(best_fit(histogram, capacity))
    expanded, complete = 0, False

    def unrolled(path: tuple | None) -> list[tuple[list[int], int]]:
        """The steps (pattern, times) of a chain of branches."""
        out = []
        while path:
            path, pattern, times = path
            out.append((pattern, times))
        return out[::-1]

    def descend(start: list[int]) -> None:
        """Depth first; the first filling of each node is followed in this loop, the others wait on the stack as chains of steps."""
        nonlocal expanded, complete
        stack: list[tuple | None] = [None]
        while stack:
            path = stack.pop()
            counts, used, filled = start.copy(), 0, 0
            for pattern, times in unrolled(path):
                for x in pattern:
                    counts[x] -= times
                used, filled = used + times, filled + times * sum(pattern)
            largest = capacity
            while True:
                while largest and not counts[largest]:
                    largest -= 1
                if not largest:
                    complete = True
                    if used < best[1]:
                        best[:] = [unrolled(path), used]
                    break
                if used + -(-(total - filled) // capacity) >= best[1]:
                    complete = True
                    break  # the waste so far leaves no better solution
                expanded += 1
                if expanded > (6000 if nodes is None else nodes) and complete:
                    return
                counts[largest] -= 1
                ways = fillings(counts, capacity - largest, branch)
                counts[largest] += 1
                moves = []
                for way in ways:
                    pattern = [largest, *way]
                    times = min(counts[x] // pattern.count(x) for x in set(pattern))
                    moves.append((pattern, times))
                stack += [(path, pattern, times) for pattern, times in reversed(moves[1:])]
                pattern, times = moves[0]
                for x in pattern:
                    counts[x] -= times
                used, filled, path = used + times, filled + times * sum(pattern), (path, pattern, times)
            if best[1] == bound:
                return

    start = [0] * (capacity + 1)
    for k, v in histogram.items():
        start[k] += v
    if best[1] > bound:
        descend(start)
    if best[1] > bound and rounds:
        best = list(repaired(best[0], capacity, bound, rounds))
    if best[1] > bound and nodes is None:
        best = list(exactly(histogram, capacity, (best[0], best[1]), bound)[:2])
    runs: list[Run] = []
    at, sequence = [0] * (capacity + 1), 0
    for pattern, times in best[0] or []:
        offset = 0
        for x in dict.fromkeys(pattern):
            each = pattern.count(x)
            runs.append((x, at[x], each * times, sequence, each, offset))
            at[x] += each * times
            offset += each * x
        sequence += times
    return runs, sequence


class Encoder:
    """ids of a text as `tokenizers` gives them; where a rank file of the same vocabulary lies beside it, the faster library makes them."""

    SPECIAL = "<|endoftext|>"

    def __init__(self, path: str):
        self.path, self._slow, self._fast = path, None, None
        ranks = path.removesuffix(".json") + ".tiktoken"
        if os.path.exists(ranks):
            import base64

            import public_tokenizers
            import tiktoken

            with open(ranks, "rb") as f:
                own = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
            self._fast = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=own, special_tokens={})

    def __call__(self, text: str) -> np.ndarray:
        if self._fast and len(text) < 1_000_000 and self.SPECIAL not in text:
            return np.array(self._fast.encode_ordinary(text), dtype="<u4")
        if self._slow is None:
            from tokenizers import Tokenizer

            self._slow = Tokenizer.from_file(self.path)
        return np.array(self._slow.encode(text, add_special_tokens=False).ids, dtype="<u4")


def pieces(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", capacity: int = 1024, end_id: int = 2, keep_ids: bool = False) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32, salt[, ids]): a row for each piece; only the first may be shorter than capacity.

    tokenizer: path of a `tokenizers` file, there on every executor. Null text: empty, so the end id alone. salt
    spreads equal rows.
    """
    id_type = docs.schema[id_col].dataType.simpleString()

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encode, n, task = Encoder(tokenizer), 0, TaskContext.get().partitionId()
        for pdf in batches:
            rows = []
            for key, text in zip(pdf["id"], pdf["text"], strict=True):
                ids = np.append(encode(text or ""), np.uint32(end_id)).astype("<u4")
                first = (len(ids) - 1) % capacity + 1
                at = 0
                for k in range(-(-len(ids) // capacity)):
                    part = ids[at : first + k * capacity].tobytes()
                    rows.append((key, k, at, len(part) // 4, zlib.crc32(part), (task * 7919 + n) % 1_000_003, part if keep_ids else b""))
                    at = first + k * capacity
                    n += 1
            yield pd.DataFrame(rows, columns=["doc_id", "piece", "start", "length", "ids_crc32", "salt", "ids"])

    # ids travel as strings: pandas would turn longs into doubles where some are null
    out = docs.select(F.col(id_col).cast("string").alias("id"), F.col(text_col).alias("text")).mapInPandas(cut, "doc_id string, piece int, start long, length long, ids_crc32 long, salt int, ids binary")
    out = out.withColumn("doc_id", F.col("doc_id").cast(id_type))
    return out if keep_ids else out.drop("ids")


def place(cut: DataFrame, capacity: int = 1024, per_bucket: int = 100_000) -> DataFrame:
    """cut (from pieces(), written) with sequence_id and offset."""
    histogram = {r["length"]: r["count"] for r in cut.groupBy("length").count().collect()}
    runs, _ = solve(histogram, capacity)
    buckets = -(-max(histogram.values(), default=1) // per_bucket)
    at = ["length", "bucket"]
    cut = cut.withColumn("bucket", F.pmod(F.xxhash64("doc_id", "piece", "salt"), F.lit(buckets)).cast("int"))
    sizes = cut.groupBy(*at).agg(F.count("*").alias("n"))
    before = sizes.withColumn("before", F.coalesce(F.sum("n").over(Window.partitionBy("length").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).select(*at, "before")
    order = [F.col(c) for c in ("doc_id", "piece", "start", "ids_crc32", "salt")]
    ranked = cut.join(before, at).withColumn("rank", F.col("before") + F.row_number().over(Window.partitionBy(*at).orderBy(*order)) - 1)
    table = np.array(sorted(runs), dtype=np.int64).reshape(-1, 6)
    first = (table[:, 0] << 48) + table[:, 1]

    @F.pandas_udf("sequence_id long, offset long")
    def placed(length: pd.Series, rank: pd.Series) -> pd.DataFrame:
        length, rank = length.to_numpy(np.int64), rank.to_numpy(np.int64)
        x = table[np.searchsorted(first, (length << 48) + rank, side="right") - 1]
        nth = rank - x[:, 1]
        return pd.DataFrame({"sequence_id": x[:, 3] + nth // x[:, 4], "offset": x[:, 5] + nth % x[:, 4] * length})

    return ranked.withColumn("at", placed("length", "rank")).select(*[c for c in cut.columns if c not in ("salt", "bucket")], "at.sequence_id", "at.offset")


def pack(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", capacity: int = 1024, end_id: int = 2, keep_ids: bool = False) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32[, ids], sequence_id, offset): every piece of every document in its place.

    Null or empty text: one piece with the end id alone. Repeated rows are packed each on its own; a null id is kept.
    No rows: no rows. Sequences hold at most capacity ids and are gapless from offset 0.
    """
    return place(materialise(pieces(docs, tokenizer, id_col, text_col, capacity, end_id, keep_ids), "pieces"), capacity)
