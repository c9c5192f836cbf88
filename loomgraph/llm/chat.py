"""Chat formatting by minimum-cost role repair.

A legal conversation is: an optional system turn, then user and assistant turns in alternation, user first, assistant
last. A dynamic programme over this automaton repairs what is not legal: each turn keeps its role, is relabelled or is
merged into the turn before it, and empty turns are inserted, at the least total cost (then with the fewest turns).

Conversations of any length are spread by range over partitions. A partition sums up each of its pieces of a
conversation as a (min, +) matrix from the state before the piece to the state after it; only the matrices of pieces
that cross a partition's border are combined, and each piece is then repaired on its own from the states given to it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import BROADCAST_ROWS, materialise

ROLES = ("system", "user", "assistant")
START = 3  # the state before any turn; states 0..2: the role of the last turn
#: Legal next roles by state.
NEXT = {START: (0, 1), 0: (1,), 1: (2,), 2: (1,)}
MERGE, INSERT, RELABEL = 1, 3, 4  # costs; keeping a role costs nothing
#: Cost in the high bits, emitted turns in the low ones: the cheapest way, then the shortest.
UNIT = 1 << 32
NEVER = 1 << 60
BLOCK_BYTES = 1 << 25


def _paths() -> dict[tuple[int, int], tuple[int, ...]]:
    """The empty turns to insert between a state and a role that opens a new turn; the fewest, the first in order of roles."""
    out = {}
    for state in (START, 0, 1, 2):
        seen, front = {}, [(state, ())]
        while front:
            later = []
            for s, way in front:
                for r in NEXT[s]:
                    if r not in seen:
                        seen[r] = way
                        later.append((r, (*way, r)))
            front = later
        out |= {(state, r): way for r, way in seen.items()}
    return out


PATHS = _paths()


def _moves(role: int) -> list[tuple[int, int, int, str, tuple[int, ...]]]:
    """(state, new state, cost and emitted turns, action, inserted roles) for a turn of that role; role 3: unknown."""
    out = []
    for state in (0, 1, 2, START):
        for to in range(3):
            label = 0 if to == role else RELABEL
            if (state, to) in PATHS:
                way = PATHS[state, to]
                out.append((state, to, (label + INSERT * len(way)) * UNIT + 1 + len(way), "keep" if to == role else "relabel", way))
            if state == to:
                out.append((state, to, (label + MERGE) * UNIT, "merge" if to == role else "relabel+merge", ()))
    return out


MOVES = [_moves(r) for r in range(4)]
#: Cost and emitted turns of the empty turns that close a conversation in each state.
CLOSING = {s: () if s == 2 else (*PATHS[s, 2], 2) for s in (0, 1, 2, START)}


def code(role: str | None) -> int:
    return ROLES.index(role.strip().lower()) if role and role.strip().lower() in ROLES else 3


def matrix(roles: list[int]) -> np.ndarray:
    """(min, +) matrix of a piece: least cost and turns from each state (rows) to each state."""
    m = np.full((4, 4), NEVER, np.int64)
    np.fill_diagonal(m, 0)
    for r in roles:
        new = np.full((4, 4), NEVER, np.int64)
        for s, to, cost, _, _ in MOVES[r]:
            np.minimum(new[:, to], m[:, s] + cost, out=new[:, to])
        m = np.minimum(new, NEVER)
    return m


def combine(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.minimum((a[:, :, None] + b[None, :, :]).min(1), NEVER)


def closing() -> np.ndarray:
    return np.array([(INSERT * UNIT + 1) * len(CLOSING[s]) for s in range(4)], np.int64)


def repair(roles: list[int], start: int = START, end: int | None = None) -> list[tuple[int, str, tuple[int, ...]]]:
    """(state after, action, inserted roles) of each turn on the best way; end: the state to end in, else the best with closing turns."""
    cost = [NEVER] * 4
    cost[start] = 0
    back: list[list] = []
    for r in roles:
        new, best = [NEVER] * 4, [None] * 4
        for move in MOVES[r]:
            if cost[move[0]] + move[2] < new[move[1]]:
                new[move[1]], best[move[1]] = cost[move[0]] + move[2], move
        cost = new
        back.append(best)
    if end is None:
        end = min(range(4), key=lambda s: (cost[s] + int(closing()[s]), s))
    out, state = [], end
    for best in reversed(back):
        move = best[state]
        out.append((state, move[3], move[4]))
        state = move[0]
    return out[::-1]


def _render(role: int, text: str, opened: bool) -> str:
    return f"{'' if opened else '<|im_end|>' + chr(10)}<|im_start|>{ROLES[role]}\n{text}"


def formatted(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", per_partition: int = 20_000) -> DataFrame:
    """(conv_id, position, part, role, action, text, rendered): the repaired turns of each conversation.

    Turns are taken in the order of turn (null last), role (null first), a hash of the text, then the text, however the rows
    are dealt; position counts repaired turns from 0, part counts up over
    the source turns merged into one (with a gap where a conversation crosses partitions). action: keep, relabel, merge, relabel+merge, insert. `rendered` of a conversation,
    joined in the order of position and part, is its chat markup. Null or unknown roles are relabelled, null texts are
    empty, repeated rows are turns of their own, rows without a conversation id are left out, further columns take no part.
    A block holds about per_partition turns and, on average, at most BLOCK_BYTES of text. No rows: no rows.
    """
    conv_type = turns.schema[conv_col].dataType.simpleString()
    rows = turns.where(F.col(conv_col).isNotNull()).select(F.col(conv_col).alias("conv"), F.coalesce(F.col(turn_col).cast("long"), F.lit(2**63 - 1)).alias("turn"), F.col(role_col).cast("string").alias("role"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    rows = rows.withColumns({"salt": F.monotonically_increasing_id(), "hash": F.xxhash64("text")})
    order = ["conv", "turn", "role", "hash", "salt"]
    size = rows.agg(F.count("*").alias("n"), F.sum(F.octet_length("text")).alias("bytes")).first()
    parts = max(1, -(-size["n"] // per_partition), -(-(size["bytes"] or 0) // BLOCK_BYTES))
    held = rows.repartitionByRange(parts, *order).withColumn("block", F.spark_partition_id())
    held = materialise(held.withColumn("conv", F.col("conv").cast("string")), "chat-turns")
    sort = ["conv_order", "turn", "role", "hash", "text", "salt"]
    held = held.withColumn("conv_order", F.col("conv").cast(conv_type))

    def pieces(pdf: pd.DataFrame) -> Iterator[tuple[str, pd.DataFrame]]:
        pdf = pdf.sort_values(sort, kind="stable", na_position="first")
        return ((c, g) for c, g in pdf.groupby("conv", sort=False))

    def summed(pdf: pd.DataFrame) -> pd.DataFrame:
        """The first and the last conversation of a block: only they can go on in another one."""
        found = list(pieces(pdf))
        ends = found[:1] + found[-1:] if len(found) > 1 else found
        return pd.DataFrame([(int(pdf["block"].iloc[0]), c, matrix([code(r) for r in g["role"]]).tobytes()) for c, g in ends], columns=["block", "conv", "m"])

    # two rows of 128 bytes for each block
    crossing = held.select("block", "conv", "conv_order", "turn", "role", "hash", "salt", F.lit("").alias("text")).groupBy("block").applyInPandas(summed, "block int, conv string, m binary").orderBy("block").collect() if parts > 1 else []
    by_conv: dict[str, list[tuple[int, np.ndarray]]] = {}
    for r in crossing:
        by_conv.setdefault(r["conv"], []).append((r["block"], np.frombuffer(r["m"], np.int64).reshape(4, 4)))
    given: list[tuple] = []  # block, conv, state before and after, position of the first new turn, number of the piece, whether it is the last
    for conv, own in by_conv.items():
        if len(own) < 2:
            continue
        ways = [np.full(4, NEVER, np.int64)]
        ways[0][START] = 0
        for _, m in own:
            ways.append(np.minimum((ways[-1][:, None] + m).min(0), NEVER))
        state = int(np.argmin(ways[-1] + closing()))
        states = [state]
        for (_, m), before in zip(reversed(own), reversed(ways[:-1]), strict=True):
            states.append(int(np.argmin(before + m[:, states[-1]])))
        states.reverse()
        position = 0
        for i, (block, m) in enumerate(own):
            given.append((block, conv, states[i], states[i + 1], position, i, i + 1 == len(own)))
            position += int(m[states[i], states[i + 1]] % UNIT)

    def fixed(pdf: pd.DataFrame) -> pd.DataFrame:
        out = []
        for conv, g in pieces(pdf):
            roles = [code(r) for r in g["role"]]
            own = g.iloc[0]
            start, end, position, piece, last = (START, None, 0, 0, True) if pd.isna(own["before"]) else (int(own["before"]), int(own["after"]), int(own["first"]), int(own["piece"]), bool(own["last"]))
            steps, part = repair(roles, start, end), piece << 32
            position -= 1
            opened = start == START
            for (state, action, added), text in zip(steps, g["text"], strict=True):
                for r in added:
                    position, part = position + 1, 0
                    out.append((conv, position, 0, ROLES[r], "insert", "", _render(r, "", opened)))
                    opened = False
                if action.endswith("merge"):
                    part += 1
                    out.append((conv, position, part, ROLES[state], action, text, "\n\n" + text))
                else:
                    position, part = position + 1, 0
                    out.append((conv, position, 0, ROLES[state], action, text, _render(state, text, opened)))
                opened = False
            if last:
                for r in CLOSING[steps[-1][0]]:
                    position += 1
                    out.append((conv, position, 0, ROLES[r], "insert", "", _render(r, "", False)))
                out[-1] = (*out[-1][:6], out[-1][6] + "<|im_end|>\n")
        return pd.DataFrame(out, columns=["conv", "position", "part", "role", "action", "text", "rendered"])

    spark = turns.sparkSession
    known = spark.createDataFrame(given, "block int, conv string, before int, after int, first long, piece long, last boolean")
    held = held.join(F.broadcast(known) if len(given) <= BROADCAST_ROWS else known, ["block", "conv"], "left")
    done = held.groupBy("block").applyInPandas(fixed, "conv string, position long, part long, role string, action string, text string, rendered string")
    return done.select(F.col("conv").cast(conv_type).alias("conv_id"), "position", "part", "role", "action", "text", "rendered")
