"""Repair of conversations by the cheapest edits, found by an auction for shortest paths.

A legal conversation is empty, or an optional system turn and then pairs of a user and an assistant turn (told by the initials of their roles).
Each given row is kept, gets the role that is due, or is deleted; empty rows may be inserted anywhere. Its first fault counts: blank, duplicate
(role and text seen earlier in the conversation) or truncated (no end of a sentence). The edits are the arcs of a lattice of (rows read, state) with whole
costs; a repair is a shortest path through it.

The auction keeps a price for each node, which never exceeds an arc's cost plus the price of its end, and a path whose arcs are tight. The path's
last node either raises its price to the least of its arcs, and the path contracts, or the path extends along the best arc. When it
arrives, the prices along it are the costs that remain. Those prices are duals: of all cheapest repairs the one whose initials are
the least text follows the first tight arc at each node, after the price of the arc's end has been brought up to its true value.
Prices start from what each row costs at least, so few raises are needed; lattices are cut into blocks of BLOCK rows, from the last
one to the first, whose exits are priced by the block behind them, so the work grows with the rows. Equal blocks are solved once in a process.

Turns are dealt by ranges of (conversation, turn) and sorted. A conversation within one partition is repaired there. One that spreads over
several gives a matrix of 4 by 4 prices for each piece; the matrices of a conversation meet in a group and fix the prices at the borders, the pieces
then say which state follows from which, and a last pass traces them. Its repaired rows are hashed in order by one task, as
SHA-256 cannot be split; that task streams them and holds one audit, not the texts.

Order is by turn (nulls first), then role, text (its first 64 characters, then its hash). Null roles and texts are one space. Repeated rows are
duplicates. Rows without conversation form one of their own. Roles of other initials are illegal until they get another role. Empty tables
give empty results; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache
from itertools import groupby

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from heliograph.session import ensure_checkpoint_dir, ship_package

START, SYSTEM, USER, ASSISTANT = range(4)
ROLES = ("", "system", "user", "assistant")
#: Costs of the edits, and of a truncated row that stays.
RELABEL, INSERT, DELETE, TRUNCATED = 3, 3, 4, 3
#: The state after a row that is inserted or relabelled, from each state; that after a kept row, by its initial; the inserts that end each state legally.
DUE = (USER, USER, ASSISTANT, USER)
KEPT = {(START, 1): SYSTEM, (START, 2): USER, (SYSTEM, 2): USER, (USER, 3): ASSISTANT, (ASSISTANT, 2): USER}
CLOSING = ("", "II", "I", "")
CLOSE = tuple(INSERT * len(x) for x in CLOSING)
#: Codes of rows: 0 to 3 other initial, s, u, a; 4 more if truncated; 8 to be deleted.
INITIALS = {"s": 1, "u": 2, "a": 3}
GONE = 8
#: The prices of two states at one place differ by 10 at most: what one state does, another one can do after at most an insert, a deletion and an insert.
APART = 10
BLOCK = 32  #: rows of a lattice that is solved at once
PARTITION_BYTES = 16 << 20
FEW = 100_000  #: so many conversations that spread over partitions may be broadcast; more are joined by a shuffle
FLUSH = 10_000  #: rows of a batch of output


class Lattice:
    """The arcs and prices of up to BLOCK rows, given the prices at its exits."""

    def __init__(self, codes: bytes, exits: tuple[int, ...]):
        self.codes, self.rows = codes, len(codes)
        least, self.price = min(exits), list(exits)
        for code in reversed(codes):  # a price that no arc undercuts: each row costs at least this much
            least += DELETE if code == GONE else TRUNCATED if code & 4 else 0
            self.price[:0] = [least] * 4
        self.exact = set(range(4 * self.rows, 4 * self.rows + 4))
        self.traced: dict[int, tuple[str, int]] = {}

    def arcs(self, node: int) -> list[tuple[str, int, int]]:
        """(initial, cost, end) of a node's arcs, by initial."""
        row, state = divmod(node, 4)
        code, after = self.codes[row], 4 * (row + 1)
        out = [("D", DELETE, after + state), ("I", INSERT, 4 * row + DUE[state])]
        if code != GONE:
            more = TRUNCATED if code & 4 else 0
            if (state, code & 3) in KEPT:
                out.append(("K", more, after + KEPT[state, code & 3]))
            out.append(("R", RELABEL + more, after + DUE[state]))
        return out

    def converge(self, origin: int) -> int:
        """The auction from a node: its price afterwards is the cost of the cheapest way out."""
        price, path = self.price, [origin]
        while path[-1] not in self.exact:
            node = path[-1]
            best, end = min(((cost + price[y], k, y) for k, (_, cost, y) in enumerate(self.arcs(node))))[::2]
            if price[node] < best:
                price[node] = best
                if len(path) > 1:
                    path.pop()
            else:
                path.append(end)
        self.exact.update(path)  # a tight path to an exit
        return price[origin]

    def trace(self, state: int) -> tuple[str, int]:
        """The initials of the edits from the state at the first row, the least text of all cheapest ones, and the state behind the last row."""
        if state not in self.traced:
            node, out = state, []
            self.converge(node)
            while node < 4 * self.rows:
                for letter, cost, y in self.arcs(node):
                    if cost + self.price[y] == self.price[node] and cost + self.converge(y) == self.price[node]:
                        out.append(letter)
                        node = y
                        break
            self.traced[state] = "".join(out), node % 4
        return self.traced[state]


@lru_cache(maxsize=1 << 14)
def lattice(codes: bytes, exits: tuple[int, ...]) -> Lattice:
    return Lattice(codes, exits)


def _blocks(codes: bytes, exits: tuple[int, ...]) -> list[tuple[Lattice, int]]:
    """The blocks from the last to the first, each with the price that its own prices are relative to."""
    out = []
    for lo in range((len(codes) - 1) // BLOCK * BLOCK, -1, -BLOCK):
        if out:
            exits = tuple(out[-1][1] + out[-1][0].converge(s) for s in range(4))
        least = min(exits)
        out.append((lattice(codes[lo : lo + BLOCK], tuple(x - least for x in exits)), least))
    return out


def prices(codes: bytes, exits: tuple[int, ...]) -> tuple[int, ...]:
    """The cost that remains in each state before the rows, given those behind them."""
    if not codes:
        return tuple(exits)
    block, least = _blocks(codes, exits)[-1]
    return tuple(least + block.converge(s) for s in range(4))


def trace(codes: bytes, exits: tuple[int, ...], state: int) -> tuple[str, int]:
    """The edits of the rows from a state on, and the state behind them."""
    out = []
    for block, _ in reversed(_blocks(codes, exits)):
        letters, state = block.trace(state)
        out.append(letters)
    return "".join(out), state


def apart(codes: bytes) -> list[int]:
    """For each state behind the rows, the prices of the four states before them if each other one behind costs APART more."""
    return [x for after in range(4) for x in prices(codes, tuple(0 if s == after else APART for s in range(4)))]


def _table(rows: list[tuple], names: list[str], kinds: list[pa.DataType]) -> pa.Table:
    cols = list(zip(*rows, strict=True)) or [[]] * len(names)
    return pa.table({n: pa.array(c, type=t) for n, c, t in zip(names, cols, kinds, strict=True)})


def _rows(batches, *names: str) -> Iterator[tuple]:
    for b in batches:
        yield from zip(*(b.column(n).to_pylist() for n in names), strict=True)


def _flush(rows: Iterator[tuple], names: list[str], kinds: list[pa.DataType], most: int = FLUSH) -> Iterator[pa.RecordBatch]:
    held: list[tuple] = []
    for r in rows:
        held.append(r)
        if len(held) >= most:
            yield from _table(held, names, kinds).to_batches()
            held = []
    if held:
        yield from _table(held, names, kinds).to_batches()


#: A repaired row: conversation, its place there, edit and fault, and, as given, turn and role, and as repaired (null: deleted) role and text.
EDITS = "own long, none boolean, place long, edit string, fault string, turn long, role string, new_role string, text string"
EDIT_NAMES = [c.split(" ")[0] for c in EDITS.split(", ")]
EDIT_KINDS = [pa.int64(), pa.bool_(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.string()]
FAULTS = ("", "truncated", "blank", "duplicate")


def _edited(letters: str, state: int, rows: Iterator[tuple]) -> Iterator[tuple]:
    """(edit, fault, turn, role, new_role, text) of each edit, from a state on; rows are (turn, role, text, fault)."""
    for x in letters:
        if x == "I":
            state = DUE[state]
            yield x, "", None, None, ROLES[state], ""
            continue
        turn, role, text, fault = next(rows)
        if x == "D":
            yield x, fault, turn, role, None, None
        elif x == "R":
            state = DUE[state]
            yield x, fault, turn, role, ROLES[state], text
        else:
            state = KEPT[state, INITIALS.get(role[:1], 0)]
            yield x, fault, turn, role, role, text


def _code(role: str, fault: str) -> int:
    return GONE if fault in ("blank", "duplicate") else INITIALS.get(role[:1], 0) + 4 * (fault == "truncated")


def _repair_whole(batches) -> Iterator[pa.RecordBatch]:
    """The edits of conversations that lie within this partition, in order."""

    def edits():
        at = None
        for (own, none), rows in groupby(_rows(batches, "own", "none", "part", "turn", "role", "text", "blank", "cut"), key=lambda r: r[:2]):
            seen, given = set(), []
            for _, _, part, turn, role, text, blank, cut in rows:
                at = part << 33 if at is None else at
                fault = "blank" if blank else "duplicate" if (role, text) in seen else "truncated" if cut else ""
                seen.add((role, text))
                given.append((turn, role, text, fault))
            letters, state = trace(bytes(_code(role, fault) for _, role, _, fault in given), CLOSE, START)
            for e in _edited(letters + CLOSING[state], START, iter(given)):
                yield own, none, at, *e
                at += 1

    return _flush(edits(), EDIT_NAMES, EDIT_KINDS)


def _repair_spread(many: DataFrame, n: int) -> DataFrame:
    """The edits of conversations that spread over partitions: many(part, place, own, none, turn, role, text, blank, cut)."""
    long, flag, longs = pa.int64(), pa.bool_(), pa.list_(pa.int64())
    first = many.groupBy("own", "none", "role", F.sha2("text", 256).alias("digest")).agg(F.min("place").alias("place")).select("place", F.lit(True).alias("first"))
    fault = F.when(F.col("blank"), "blank").when(F.col("first").isNull(), "duplicate").when(F.col("cut"), "truncated").otherwise("")
    coded = many.select("part", "place", "own", "none", F.substring("role", 1, 1).alias("initial"), "blank", "cut").join(first, "place", "left")
    coded = coded.select("part", "place", "own", "none", "initial", fault.alias("fault")).repartition(n, "part").sortWithinPartitions("part", "place").checkpoint()

    def pieces(batches, *more):
        for key, rows in groupby(_rows(batches, "part", "own", "none", "initial", "fault", *more), key=lambda r: r[:3]):
            rows = list(rows)
            yield key, bytes(_code(r[3], r[4]) for r in rows), rows

    def matrices(batches):
        return _flush(((*key, apart(codes)) for key, codes, _ in pieces(batches)), ["part", "own", "none", "matrix"], [long, long, flag, longs])

    def borders(key, table):
        """The prices behind each piece."""
        rows = sorted(zip(table.column("part").to_pylist(), table.column("matrix").to_pylist(), strict=True), reverse=True)
        out, exits = [], list(CLOSE)
        for part, m in rows:
            out.append((part, key[0].as_py(), key[1].as_py(), exits))
            exits = [min(m[4 * after + s] + exits[after] for after in range(4)) for s in range(4)]
        return _table(out, ["part", "own", "none", "exits"], [long, long, flag, longs])

    def ways(batches):
        rows = ((*key, [trace(codes, tuple(got[0][5]), s)[1] for s in range(4)]) for key, codes, got in pieces(batches, "exits"))
        return _flush(rows, ["part", "own", "none", "way"], [long, long, flag, longs])

    def entries(key, table):
        """The state before each piece, and whether it is the last one."""
        rows = sorted(zip(table.column("part").to_pylist(), table.column("way").to_pylist(), strict=True))
        out, state = [], START
        for k, (part, way) in enumerate(rows):
            out.append((part, key[0].as_py(), key[1].as_py(), state, k == len(rows) - 1))
            state = way[state]
        return _table(out, ["part", "own", "none", "state", "final"], [long, long, flag, long, flag])

    def letters(batches):
        """The edits of each row: those that insert before it and its own one (and, at the end, those behind it), with the state before."""

        def rows():
            for _, codes, got in pieces(batches, "exits", "state", "final", "place"):
                exits, state, final = got[0][5:8]
                text, last = trace(codes, tuple(exits), state)
                ends = [k for k, x in enumerate(text) if x != "I"]
                for i, (r, lo, hi) in enumerate(zip(got, [0, *(k + 1 for k in ends)], ends, strict=False)):
                    mine = text[lo : hi + 1]
                    yield r[8], state, mine + (CLOSING[last] if final and i == len(ends) - 1 else "")
                    for x in mine:
                        state = DUE[state] if x in "IR" else KEPT[state, INITIALS.get(r[3], 0)] if x == "K" else state

        return _flush(rows(), ["place", "state", "letters"], [long, long, pa.string()])

    def render(batches):
        def rows():
            for own, none, place, turn, role, text, fault, state, mine in _rows(batches, "own", "none", "place", "turn", "role", "text", "fault", "state", "letters"):
                for e in _edited(mine, state, iter([(turn, role, text, fault)])):
                    yield own, none, place, *e

        return _flush(rows(), EDIT_NAMES, EDIT_KINDS)

    keys = ["part", "own", "none"]
    exits = coded.mapInArrow(matrices, "part long, own long, none boolean, matrix array<long>").groupBy("own", "none").applyInArrow(borders, "part long, own long, none boolean, exits array<long>").checkpoint()
    priced = coded.join(exits, keys).repartition(n, "part").sortWithinPartitions("part", "place")
    states = priced.mapInArrow(ways, "part long, own long, none boolean, way array<long>").groupBy("own", "none").applyInArrow(entries, "part long, own long, none boolean, state long, final boolean").checkpoint()
    known = priced.join(states, keys).repartition(n, "part").sortWithinPartitions("part", "place")
    edits = known.mapInArrow(letters, "place long, state long, letters string")
    texts = many.join(coded.select("place", "fault"), "place").join(edits, "place")
    # a conversation's rows meet in order: their texts are one digest, which only one task can make
    texts = texts.repartition(n, "own", "none").sortWithinPartitions("own", "none", "place")
    return texts.mapInArrow(render, EDITS)


def repair_edits(conversations: DataFrame, partitions: int | None = None) -> list[DataFrame]:
    """The edits (see EDITS) of conversations(conv_id, turn, role, text): of those within one partition and, if there are any, of those that spread.

    ``own`` is the conversation, or 0 with ``none`` where it has no id. In each table the rows of a conversation stand together and in order.
    """
    spark = conversations.sparkSession
    ship_package(spark)
    ensure_checkpoint_dir(spark)
    c = conversations.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.coalesce("role", F.lit(" ")).alias("role"), F.coalesce("text", F.lit(" ")).alias("text"))
    keys = [F.col("conv_id").asc_nulls_last(), F.col("turn").asc_nulls_first(), F.col("role"), F.substring("text", 1, 64), F.xxhash64("text")]
    n = partitions or 1 + int((c.agg(F.sum(F.octet_length("text") + 40)).first()[0] or 0) // PARTITION_BYTES)
    dealt = c.repartitionByRange(n, *keys).sortWithinPartitions(*keys)
    dealt = dealt.select(
        F.spark_partition_id().cast("long").alias("part"), F.monotonically_increasing_id().alias("place"), F.coalesce("conv_id", F.lit(0).cast("long")).alias("own"), F.col("conv_id").isNull().alias("none"), "turn", "role", "text",
        (~F.col("text").rlike(r"[^\x20\x09-\x0D]")).alias("blank"), (~F.col("text").rlike(r"[.!?][\x20\x09-\x0D]*\z")).alias("cut"),
    ).checkpoint()
    key = F.struct("none", "own")
    ends = dealt.groupBy("part").agg(F.array_distinct(F.array(F.min(key), F.max(key))).alias("k")).select(F.explode("k").alias("k"))
    spread = ends.groupBy("k.own", "k.none").agg(F.count("*").alias("n")).where("n > 1").select("own", "none").checkpoint()
    few = spread.count()
    side = F.broadcast(spread) if few <= FEW else spread
    if not few:
        return [dealt.mapInArrow(_repair_whole, EDITS)]
    whole = dealt.join(side, ["own", "none"], "left_anti")
    if few > FEW:
        whole = whole.repartition(n, "part").sortWithinPartitions("part", "place")
    return [whole.mapInArrow(_repair_whole, EDITS), _repair_spread(dealt.join(side, ["own", "none"], "left_semi"), partitions or n)]


def _audit(batches) -> Iterator[pa.RecordBatch]:
    """A row per conversation whose edits stand together; texts go through the digest one by one."""

    def rows():
        for (own, none), edits in groupby(_rows(batches, *EDIT_NAMES), key=lambda r: r[:2]):
            digest, some, audit, cost, illegal, count = hashlib.sha256(), False, [], 0, 0, dict.fromkeys(FAULTS, 0)
            low = high = before = None
            turns = 0
            for _, _, _, edit, fault, turn, role, new, text in edits:
                audit.append(edit)
                cost += {"D": DELETE, "I": INSERT, "R": RELABEL, "K": 0}[edit] + (TRUNCATED if edit != "D" and fault == "truncated" else 0)
                if new is not None:
                    digest.update(("\n" if some else "").encode() + f"{new}:{text}".encode())
                    some = True
                if edit == "I":
                    continue
                count[fault] += 1
                illegal += before is not None and before + role[:1] not in ("su", "ua", "au")
                before = role[:1]
                if turn is not None:
                    turns += turn != high
                    low, high = turn if low is None else low, turn
            gaps = high - low + 1 - turns if turns else 0
            yield own, none, gaps, count["blank"], count["duplicate"], count["truncated"], illegal, cost, "".join(audit), digest.hexdigest()

    long = pa.int64()
    names = ["own", "none", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]
    return _flush(rows(), names, [long, pa.bool_(), *[long] * 6, pa.string(), pa.string()])


def audit_conversations(conversations: DataFrame, partitions: int | None = None) -> DataFrame:
    """A row per conversation of conversations(conv_id, turn, role, text): gaps in its turns, faults, illegal neighbours, cost and initials of its repair, and the repaired sequence's digest."""
    schema = "own long, none boolean, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"
    out = [e.mapInArrow(_audit, schema) for e in repair_edits(conversations, partitions)]
    whole = out[0] if len(out) == 1 else out[0].unionByName(out[1])
    return whole.select(F.when(~F.col("none"), F.col("own")).alias("conv_id"), *[c.strip().split(" ")[0] for c in schema.split(",")[2:]])


def damage(conversations: DataFrame) -> DataFrame:
    """The rows after the damage that the checksum of ``conv_id:turn`` chooses for each: none is like another table's, all are repeatable."""
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    d = conversations.select("conv_id", "turn", text("role").alias("role"), text("text").alias("text"), (F.crc32(F.concat(text("conv_id"), F.lit(":"), text("turn"))) % 20).alias("d")).where("d != 0")
    new = F.when(F.col("d") == 1, "").when(F.col("d") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    role = F.when(F.col("d") == 4, "user").otherwise(F.col("role"))
    return d.select("conv_id", "turn", role.alias("role"), new.alias("text"), F.explode(F.when(F.col("d") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))).alias("copy")).drop("copy")


def audit_damaged(conversations: DataFrame, partitions: int | None = None) -> DataFrame:
    """The audit of every conversation after damage, also of those that have lost all rows."""
    ids = conversations.select(F.col("conv_id").cast("long").alias("__id")).distinct()
    a = audit_conversations(damage(conversations), partitions)
    j = ids.join(a, F.col("__id").eqNullSafe(F.col("conv_id")), "left")
    zero = [F.coalesce(c, F.lit(0).cast("long")).alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    return j.select(F.col("__id").alias("conv_id"), *zero, F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.sha2(F.lit(""), 256)).alias("repaired_sha256"))


#: The same for DuckDB: each conversation's rows are folded; a state holds the cheapest (cost, audit, repaired text) so far.
REPAIR_SQL = r"""
WITH bytes AS (SELECT coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ') AS k, conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text FROM conversations),
summed AS (SELECT *, xor(4294967295::UBIGINT, list_reduce(list_transform(range(1, length(k) + 1), lambda i: ascii(substr(k, i, 1))::UBIGINT), lambda crc, b:
  list_reduce(range(8)::UBIGINT[], lambda c, j: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384::UBIGINT) ELSE c >> 1 END, xor(crc, b)), 4294967295::UBIGINT)) % 20 AS d FROM bytes),
damaged AS (SELECT conv_id, turn, CASE WHEN d = 4 THEN 'user' ELSE role END AS role, CASE d WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text
  FROM summed, unnest(range(CASE WHEN d = 3 THEN 2 ELSE 1 END)) WHERE d <> 0),
ordered AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS i FROM damaged),
judged AS (SELECT *, left(role, 1) AS ini, lag(left(role, 1)) OVER (PARTITION BY conv_id ORDER BY i) AS before, CASE WHEN NOT regexp_matches(text, '[^\x20\x09-\x0D]') THEN 'blank'
  WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 THEN 'duplicate' WHEN NOT regexp_matches(text, '[.!?][\x20\x09-\x0D]*$') THEN 'truncated' ELSE '' END AS fault FROM ordered),
folded AS (SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 'blank') AS blank, count(*) FILTER (fault = 'duplicate') AS duplicate,
  count(*) FILTER (fault = 'truncated') AS truncated, count(*) FILTER (before IS NOT NULL AND before || ini NOT IN ('su', 'ua', 'au')) AS illegal,
  list_reduce(list({'role': role, 'text': text, 'ini': ini, 'gone': fault IN ('blank', 'duplicate'), 'cut': CASE WHEN fault = 'truncated' THEN 3 ELSE 0 END} ORDER BY i), lambda w, x:
    list_transform([list_transform([w], lambda v: {'z': v.z, 's': v.s, 'u': list_min([v.u, {'c': v.z.c + 3, 'a': v.z.a || 'I', 'r': v.z.r || chr(10) || 'user:'}, {'c': v.s.c + 3, 'a': v.s.a || 'I', 'r': v.s.r || chr(10) || 'user:'},
        {'c': v.a.c + 3, 'a': v.a.a || 'I', 'r': v.a.r || chr(10) || 'user:'}]),
      'a': list_min([v.a, {'c': v.u.c + 3, 'a': v.u.a || 'I', 'r': v.u.r || chr(10) || 'assistant:'}, {'c': v.z.c + 6, 'a': v.z.a || 'II', 'r': v.z.r || chr(10) || 'user:' || chr(10) || 'assistant:'},
        {'c': v.s.c + 6, 'a': v.s.a || 'II', 'r': v.s.r || chr(10) || 'user:' || chr(10) || 'assistant:'}])})[1]], lambda v: {
      'z': {'c': v.z.c + 4, 'a': v.z.a || 'D', 'r': v.z.r},
      's': list_min([{'c': v.s.c + 4, 'a': v.s.a || 'D', 'r': v.s.r}, {'c': v.z.c + x.cut + CASE WHEN x.gone OR x.ini <> 's' THEN 1000000000 ELSE 0 END, 'a': v.z.a || 'K', 'r': v.z.r || chr(10) || x.role || ':' || x.text}]),
      'u': list_min(list_concat([{'c': v.u.c + 4, 'a': v.u.a || 'D', 'r': v.u.r}], list_transform([v.z, v.s, v.a], lambda o: {'c': o.c + x.cut + CASE WHEN x.gone THEN 1000000000 WHEN x.ini = 'u' THEN 0 ELSE 3 END,
        'a': o.a || CASE WHEN x.ini = 'u' THEN 'K' ELSE 'R' END, 'r': o.r || chr(10) || CASE WHEN x.ini = 'u' THEN x.role ELSE 'user' END || ':' || x.text}))),
      'a': list_min([{'c': v.a.c + 4, 'a': v.a.a || 'D', 'r': v.a.r}, {'c': v.u.c + x.cut + CASE WHEN x.gone THEN 1000000000 WHEN x.ini = 'a' THEN 0 ELSE 3 END,
        'a': v.u.a || CASE WHEN x.ini = 'a' THEN 'K' ELSE 'R' END, 'r': v.u.r || chr(10) || CASE WHEN x.ini = 'a' THEN x.role ELSE 'assistant' END || ':' || x.text}])})[1],
    {'z': {'c': 0::BIGINT, 'a': '', 'r': ''}, 's': {'c': 1000000000::BIGINT, 'a': '', 'r': ''}, 'u': {'c': 1000000000::BIGINT, 'a': '', 'r': ''}, 'a': {'c': 1000000000::BIGINT, 'a': '', 'r': ''}}) AS v
  FROM judged GROUP BY conv_id),
ended AS (SELECT *, list_min([v.z, v.a, {'c': v.u.c + 3, 'a': v.u.a || 'I', 'r': v.u.r || chr(10) || 'assistant:'}, {'c': v.s.c + 6, 'a': v.s.a || 'II', 'r': v.s.r || chr(10) || 'user:' || chr(10) || 'assistant:'}]) AS e FROM folded),
ids AS (SELECT DISTINCT conv_id FROM conversations)
SELECT i.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal, coalesce(e.c, 0) AS cost,
  coalesce(e.a, '') AS audit, sha256(coalesce(e.r[2:], '')) AS repaired_sha256
FROM ids i LEFT JOIN ended ON i.conv_id IS NOT DISTINCT FROM ended.conv_id
"""
