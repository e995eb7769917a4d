"""Repairs against a plain search over all edits, and conversations cut over partitions against whole ones."""

import hashlib
import random
import zlib
from functools import lru_cache

import pytest

from heliograph.llm import conversation_repair as C

NEXT = {"": "u", "s": "u", "u": "a", "a": "u"}
NAME = {"u": "user", "a": "assistant"}


def faults(rows):
    seen, out = set(), []
    for _, role, text in rows:
        t = text.strip(" \t\n\x0b\x0c\r")
        out.append("blank" if not t else "duplicate" if (role, text) in seen else "" if t[-1] in ".!?" else "truncated")
        seen.add((role, text))
    return out


def cheapest(rows):
    """(cost, audit, repaired rows) by recursion over all edits, two inserts at one place at most."""
    why = faults(rows)

    @lru_cache(maxsize=None)
    def best(i, state, inserts):
        ways = []
        if i == len(rows) and state in ("", "a"):
            ways.append((0, "", ()))
        if inserts < 2:
            c, a, r = best(i, NEXT[state], inserts + 1)
            ways.append((c + 3, "I" + a, ((NAME[NEXT[state]], ""), *r)))
        if i < len(rows):
            _, role, text = rows[i]
            c, a, r = best(i + 1, state, 0)
            ways.append((c + 4, "D" + a, r))
            if why[i] not in ("blank", "duplicate"):
                more = 3 if why[i] == "truncated" else 0
                c, a, r = best(i + 1, NEXT[state], 0)
                ways.append((c + 3 + more, "R" + a, ((NAME[NEXT[state]], text), *r)))
                ini = role[:1]
                if ini and (ini == NEXT[state] or (ini == "s" and state == "")):
                    c, a, r = best(i + 1, ini, 0)
                    ways.append((c + more, "K" + a, ((role, text), *r)))
        return min(ways, default=(10**9, "", ()))

    return best(0, "", 0)


def brute(rows):
    """The columns of the query for rows (turn, role, text) in order."""
    if not rows:
        return (0,) * 6 + ("", hashlib.sha256(b"").hexdigest())
    cost, audit, repaired = cheapest(tuple(rows))
    turns = [t for t, _, _ in rows if t is not None]
    why = faults(rows)
    pairs = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(rows, rows[1:], strict=False))
    return (max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0, *(why.count(f) for f in ("blank", "duplicate", "truncated")), pairs, cost, audit, hashlib.sha256("\n".join(f"{a}:{b}" for a, b in repaired).encode()).hexdigest())


def damaged(rows):
    """rows (conv_id, turn, role, text) after damage, in order, by conversation."""
    out = {}
    for conv, turn, role, text in rows:
        role, text = " " if role is None else role, " " if text is None else text
        d = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        own = out.setdefault(conv, [])
        text = "" if d == 1 else "".join(c for c in text if c not in ".!?") if d == 2 else text
        own += [(turn, "user" if d == 4 else role, text)] * (0 if d == 0 else 2 if d == 3 else 1)
    for own in out.values():
        own.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2]))
    return out


def random_rows(rnd, convs, most, roles=("user", "assistant", "system", "tool", "", None, "usher")):
    texts = ["Yes.", "No!", "Why?", "open end", "", " \t", None, "so ", "A long answer. ", "x", "!"]
    return [(c, rnd.choice([t, t, t, t + 1, None]), rnd.choice(roles), rnd.choice(texts)) for c in convs for t in range(rnd.randrange(most))]


def check(spark, rows, partitions=None):
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = {r[0]: tuple(r)[1:] for r in C.audit_damaged(df, partitions).collect()}
    want = {c: brute(r) for c, r in damaged(rows).items()}
    assert got == want


def test_lattices():
    rnd = random.Random(3)
    texts = {0: "x.", 4: "x"}
    for _ in range(1500):
        codes = bytes(rnd.choice([0, 1, 2, 2, 2, 3, 3, 3, 5, 6, 7, 8]) for _ in range(rnd.randrange(12)))
        rows = tuple((i, "tsua"[c % 4] if c < 8 else "u", str(i) + texts[c & 4] if c < 8 else " ") for i, c in enumerate(codes))
        letters, state = C.trace(codes, C.CLOSE, C.START)
        cost, audit, _ = cheapest(rows)
        assert letters + C.CLOSING[state] == audit
        assert C.prices(codes, C.CLOSE)[C.START] == cost


@pytest.mark.parametrize("block", [1, 2, 5])
def test_blocks_change_nothing(monkeypatch, block):
    rnd = random.Random(block)
    for _ in range(200):
        codes = bytes(rnd.choice([0, 1, 2, 2, 3, 3, 5, 6, 7, 8]) for _ in range(rnd.randrange(70)))
        monkeypatch.setattr(C, "BLOCK", 1000)
        want = C.trace(codes, C.CLOSE, C.START), C.prices(codes, C.CLOSE)
        monkeypatch.setattr(C, "BLOCK", block)
        assert (C.trace(codes, C.CLOSE, C.START), C.prices(codes, C.CLOSE)) == want


def test_states_are_no_further_apart():
    rnd = random.Random(9)
    for _ in range(500):
        p = C.prices(bytes(rnd.choice([0, 1, 2, 3, 5, 6, 7, 8]) for _ in range(rnd.randrange(1, 60))), C.CLOSE)
        assert max(p) - min(p) <= C.APART


def test_long_conversations_take_linear_time():
    rnd = random.Random(1)
    codes = bytes(rnd.choice([2, 3, 2, 3, 6, 7, 8, 1, 0]) for _ in range(20_000))
    assert len(C.trace(codes, C.CLOSE, C.START)[0]) >= 20_000


def test_random_conversations(spark):
    check(spark, random_rows(random.Random(11), [*range(150), None], 9))


@pytest.mark.parametrize("partitions", [2, 7])
def test_conversations_spread_over_partitions(spark, partitions):
    rnd = random.Random(partitions)
    rows = random_rows(rnd, range(6), 4) + random_rows(rnd, [7], 60, ("user", "assistant")) + random_rows(rnd, [8, None], 40) + [(9, t, "user", "Same.") for t in range(50)]
    rnd.shuffle(rows)
    check(spark, rows, partitions)


def test_all_rows_in_one_hot_conversation(spark, monkeypatch):
    rows = [(5, t, ("user", "assistant")[t % 2], f"Part {t % 40}" + "." * (t % 5 > 0)) for t in range(300)]
    check(spark, rows, 6)
    monkeypatch.setattr(C, "FEW", 0)
    check(spark, rows + [(6, 0, "user", "Hi."), (6, 1, "assistant", "Ho.")], 6)


def test_odd_tables(spark):
    df = spark.createDataFrame([(0, None, None, None, "x"), (0, None, None, None, "x"), (1, 4, "user", "q" * 3_000_000 + ".", None)], "conv_id long, turn long, role string, text string, own string")
    got = C.audit_conversations(df).collect()
    assert sorted(r.audit for r in got) == ["DD", "KI"]
    assert C.audit_damaged(df.limit(0)).count() == 0


def test_conversation_without_rows_after_damage(spark):
    conv = next(c for c in range(1000) if zlib.crc32(f"{c}:0".encode()) % 20 == 0)
    check(spark, [(conv, 0, "user", "Hi."), (conv + 1, 0, "user", "Hi.")])


def test_query_against_sql(spark):
    import duckdb

    from heliograph.llm.queries import op12_conversation_repair, oracle_sql

    for sf in ("/root/testdata/sf0.001", "/root/testdata/sf0.01"):
        df = op12_conversation_repair(spark, sf)
        con = duckdb.connect()
        con.execute(f"create view conversations as select * from '{sf}/conversations.parquet'")
        sql = con.execute(oracle_sql()["op12_conversation_repair"])
        names = [d[0] for d in sql.description]
        assert sorted(tuple(r[c] for c in names) for r in df.collect()) == sorted(sql.fetchall())
