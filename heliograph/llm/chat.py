"""Chat formatting: role repair of least cost, then rendering.

A legal conversation is an optional system turn followed by one or more pairs of a user and an assistant turn. Each
given turn may keep its role, be relabelled, or be merged into the turn before it (joined by a newline), and
empty turns may be inserted anywhere, also at the end. Dynamic programming over the legal-turn automaton finds
the repair of least cost; ties go to the earlier state in the order system, user, assistant.

The program is a product of small min-plus matrices, one per turn, so it splits anywhere. Turns are dealt by ranges of
(conversation, turn) and sorted; a conversation of any length spreads over partitions. One pass gives the
matrix of each partition's first and last conversation (two rows of 16 numbers per partition); the rows of each
conversation that lies in several partitions meet in a group and fix its states at their borders; a second pass traces every
conversation back and renders it.

Order is by turn, then role, then text (its first 64 characters, then its hash); rows without turn come last, rows without conversation form one of their own. A null or
unknown role costs a relabelling; null texts are empty. Repeated rows are turns of their own. Empty tables give empty
results. Other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from heliograph.session import ensure_checkpoint_dir, ship_package

START, SYSTEM, USER, ASSISTANT = range(4)
ROLES = ("", "system", "user", "assistant")
#: Costs of the repairs.
RELABEL, INSERT, MERGE = 3, 2, 1
#: Other names of the roles.
ALIASES = {"system": SYSTEM, "developer": SYSTEM, "user": USER, "human": USER, "assistant": ASSISTANT, "gpt": ASSISTANT, "bot": ASSISTANT, "model": ASSISTANT}
PARTITION_BYTES = 16 << 20
FEW = 100_000  #: so many border states may be broadcast; more are joined by a shuffle
FAR = np.int64(1 << 40)
#: Empty turns needed between two states, for a turn that starts as the second one; None where it is illegal.
BETWEEN = {
    (START, SYSTEM): (), (START, USER): (), (START, ASSISTANT): (USER,), (SYSTEM, USER): (), (SYSTEM, ASSISTANT): (USER,),
    (USER, ASSISTANT): (), (USER, USER): (ASSISTANT,), (ASSISTANT, USER): (), (ASSISTANT, ASSISTANT): (USER,),
}
#: Empty turns that end a conversation legally from each state.
CLOSING = {START: (USER, ASSISTANT), SYSTEM: (USER, ASSISTANT), USER: (ASSISTANT,), ASSISTANT: ()}


def _steps() -> tuple[np.ndarray, np.ndarray]:
    """(cost, merged): for each given role (0 unknown), state before and state after."""
    cost = np.full((4, 4, 4), FAR, dtype=np.int64)
    merged = np.zeros((4, 4, 4), dtype=bool)
    for role in range(4):
        for a in range(4):
            for b in range(1, 4):
                name = 0 if role == b else RELABEL
                if (a, b) in BETWEEN:
                    cost[role, a, b] = name + INSERT * len(BETWEEN[a, b])
                if a == b and name + MERGE < cost[role, a, b]:
                    cost[role, a, b], merged[role, a, b] = name + MERGE, True
    return cost, merged


COST, MERGED = _steps()
CLOSE = np.array([INSERT * len(CLOSING[s]) for s in range(4)], dtype=np.int64)


def role_code(role: str | None) -> int:
    return ALIASES.get((role or "").strip().lower(), 0)


def forward(roles: list[int], best: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
    """Least costs of the states after the roles, from those before, and each step's best state before."""
    back = []
    for r in roles:
        m = best[:, None] + COST[r]
        back.append(m.argmin(axis=0))
        best = np.minimum(m.min(axis=0), FAR)
    return best, back


def transfer(roles: list[int]) -> np.ndarray:
    """The least cost from each state to each state over the roles."""
    out = np.full((4, 4), FAR, dtype=np.int64)
    for s in range(4):
        one = np.full(4, FAR, dtype=np.int64)
        one[s] = 0
        out[s] = forward(roles, one)[0]
    return out


def trace(roles: list[int], before: int, after: int) -> list[int]:
    """The states of each turn on a cheapest way from the state before to the state after."""
    start = np.full(4, FAR, dtype=np.int64)
    start[before] = 0
    back, states, s = forward(roles, start)[1], [], after
    for b in reversed(back):
        states.append(s)
        s = int(b[s])
    return states[::-1]


def repair(roles: list[int]) -> list[int]:
    """The states of a whole conversation's turns."""
    start = np.full(4, FAR, dtype=np.int64)
    start[START] = 0
    end = int((forward(roles, start)[0] + CLOSE).argmin())
    return trace(roles, START, end)


def _segments(conv: list) -> list[tuple[int, int]]:
    edge = [i for i in range(1, len(conv)) if conv[i] != conv[i - 1]]
    return list(zip([0, *edge], [*edge, len(conv)], strict=True)) if conv else []


def format_chats(conversations: DataFrame, partitions: int | None = None) -> DataFrame:
    """A row per given turn of conversations(conv_id, turn, role, text): conv_id, turn, role, new_role, merged, inserted_before, inserted_after, rendered.

    The rendered pieces of a conversation, joined in order, are its repaired sequence:
    ``<|role|>`` and a newline before each turn's text, ``<|end|>`` and a newline after it. The order is that of ``place``, a
    number that grows within a conversation.
    """
    spark = conversations.sparkSession
    ship_package(spark)
    ensure_checkpoint_dir(spark)
    turns = conversations.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), "role", F.coalesce("text", F.lit("")).alias("text"))
    keys = [F.col("conv_id").asc_nulls_last(), F.col("turn").asc_nulls_last(), F.col("role").asc_nulls_last(), F.substring("text", 1, 64), F.xxhash64("text")]
    n = partitions or 1 + int((turns.agg(F.sum(F.octet_length("text") + 40)).first()[0] or 0) // PARTITION_BYTES)
    dealt = turns.repartitionByRange(n, *keys).sortWithinPartitions(*keys)
    dealt = dealt.withColumn("part", F.spark_partition_id().cast("long")).withColumn("own", F.coalesce("conv_id", F.lit(0).cast("long"))).withColumn("none", F.col("conv_id").isNull()).checkpoint()

    def borders(batches):
        part, conv, roles = 0, [], []
        for batch in batches:
            conv += batch.column("conv_id").to_pylist()
            roles += map(role_code, batch.column("role").to_pylist())
            part = batch.column("part")[0].as_py() if len(batch) else part
        seg = _segments(conv)
        rows = [(part, conv[lo], transfer(roles[lo:hi]).reshape(-1).tolist()) for k, (lo, hi) in enumerate(seg) if k in (0, len(seg) - 1)]
        cols = list(zip(*rows, strict=True)) or [[]] * 3
        kinds = [pa.int64(), pa.int64(), pa.list_(pa.int64())]
        yield pa.RecordBatch.from_arrays([pa.array(c, type=t) for c, t in zip(cols, kinds, strict=True)], names=["part", "conv_id", "matrix"])

    def across(key, table):
        """The states before and after each piece of a conversation that lies in several partitions."""
        rows = sorted(zip(table.column("part").to_pylist(), table.column("matrix").to_pylist(), strict=True))
        best, back = np.array([0, FAR, FAR, FAR]), []
        for _, matrix in rows:
            m = best[:, None] + np.array(matrix).reshape(4, 4)
            back.append(m.argmin(axis=0))
            best = np.minimum(m.min(axis=0), FAR)
        s, out = int((best + CLOSE).argmin()), []
        for k in range(len(rows) - 1, -1, -1):
            before = int(back[k][s])
            out.append((rows[k][0], key[0].as_py(), key[1].as_py(), before, s, k == len(rows) - 1))
            s = before
        cols = list(zip(*out, strict=True))
        return pa.table({n: pa.array(c, type=t) for n, c, t in zip(("part", "own", "none", "before", "after", "final"), cols, (pa.int64(), pa.int64(), pa.bool_(), pa.int64(), pa.int64(), pa.bool_()), strict=True)})

    ends = dealt.select("conv_id", "role", "part").mapInArrow(borders, "part long, conv_id long, matrix array<long>")
    ends = ends.withColumn("own", F.coalesce("conv_id", F.lit(0).cast("long"))).withColumn("none", F.col("conv_id").isNull()).checkpoint()
    several = ends.groupBy("own", "none").agg(F.count("*").alias("pieces")).where("pieces > 1").select("own", "none")
    states = ends.join(several, ["own", "none"]).groupBy("own", "none").applyInArrow(across, "part long, own long, none boolean, before long, after long, final boolean").checkpoint()
    few = states.count()
    if few <= FEW:  # a join that leaves the rows where they are
        dealt = dealt.join(F.broadcast(states), ["part", "own", "none"], "left")
    else:
        dealt = dealt.join(states, ["part", "own", "none"], "left").repartition(n, "part").sortWithinPartitions("part", *keys)
    names = ["conv_id", "turn", "role", "new_role", "merged", "inserted_before", "inserted_after", "place", "rendered"]

    def render(batches):
        whole = list(batches)
        read = lambda c: [x for b in whole for x in b.column(c).to_pylist()]
        home, entry, leave, ends_here = (read(c) for c in ("part", "before", "after", "final"))
        conv = list(zip(home, read("conv_id"), strict=True))
        roles = [role_code(x) for x in read("role")]
        state, prev, last, places = [], [], [False] * len(conv), []
        for lo, hi in _segments(conv):
            if leave[lo] is not None:
                first, final, s = entry[lo], ends_here[lo], trace(roles[lo:hi], entry[lo], leave[lo])
            else:
                first, final, s = START, True, repair(roles[lo:hi])
            state += s
            prev += [first, *s[:-1]]
            last[hi - 1] = final
        for i, p in enumerate(home):
            places.append(places[-1] + 1 if i and home[i - 1] == p else p << 33)
        at = 0
        for b in whole:
            rows = []
            for text, conv_id, turn, role in zip(*(b.column(c).to_pylist() for c in ("text", "conv_id", "turn", "role")), strict=True):
                a, s = prev[at], state[at]
                joined = bool(MERGED[roles[at], a, s])
                before = () if joined else BETWEEN[a, s]
                after = CLOSING[s] if last[at] else ()
                parts = ["\n"] if joined else ["<|end|>\n"] if a != START else []
                parts += [f"<|{ROLES[x]}|>\n<|end|>\n" for x in before]
                parts += [text] if joined else [f"<|{ROLES[s]}|>\n", text]
                parts += ["<|end|>\n", *(f"<|{ROLES[x]}|>\n<|end|>\n" for x in after)] if last[at] else []
                rows.append((conv_id, turn, role, ROLES[s], joined, len(before), len(after), places[at], "".join(parts)))
                at += 1
            cols = list(zip(*rows, strict=True)) or [[]] * 9
            kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.bool_(), pa.int64(), pa.int64(), pa.int64(), pa.string()]
            yield pa.RecordBatch.from_arrays([pa.array(c, type=t) for c, t in zip(cols, kinds, strict=True)], names=names)

    return dealt.select("conv_id", "turn", "role", "text", "part", "before", "after", "final").mapInArrow(render, "conv_id long, turn long, role string, new_role string, merged boolean, inserted_before long, inserted_after long, place long, rendered string")
