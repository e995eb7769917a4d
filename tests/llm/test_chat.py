import itertools
import random
from collections import defaultdict

import pytest

from heliograph.llm.chat import ASSISTANT, BETWEEN, CLOSING, COST, INSERT, MERGE, RELABEL, START, format_chats, repair, role_code, trace, transfer

SCHEMA = "conv_id long, turn long, role string, text string, rendered int"


def cost_of(roles, states):
    total, a = 0, START
    for r, s in zip(roles, states, strict=True):
        total += int(COST[r, a, s])
        a = s
    return total + INSERT * len(CLOSING[a])


def parse(text):
    out = []
    for piece in text.split("<|end|>\n")[:-1]:
        role, _, body = piece.partition("|>\n")
        out.append((role.removeprefix("<|"), body))
    return out


def legal(roles):
    r = roles[1:] if roles[:1] == ["system"] else roles
    return len(r) >= 2 and r == ["user", "assistant"] * (len(r) // 2)


def test_repair_is_cheapest_by_enumeration():
    for n in range(1, 5):
        for roles in itertools.product(range(4), repeat=n):
            best = min(cost_of(roles, s) for s in itertools.product((1, 2, 3), repeat=n))
            assert cost_of(roles, repair(list(roles))) == best
            assert min(transfer(list(roles))[START] + [INSERT * len(CLOSING[s]) for s in range(4)]) == best


def test_costs():
    assert (RELABEL, INSERT, MERGE) == (3, 2, 1) and BETWEEN[ASSISTANT, ASSISTANT] == (2,)
    assert trace([2, 3], START, ASSISTANT) == [2, 3] and role_code(" Human ") == 2 and role_code(None) == 0


@pytest.mark.parametrize("partitions,few", [(1, 100_000), (7, 100_000), (7, 0)])
def test_legal_and_whole(spark, monkeypatch, partitions, few):
    from heliograph.llm import chat

    monkeypatch.setattr(chat, "FEW", few)
    r = random.Random(3)
    roles = ["user", "assistant", "system", "User", "tool", None]
    rows = [(c, t, r.choice(roles[:2] if r.random() < 0.7 else roles), f"t{c}.{t}\n", None) for c in range(30) for t in range(r.randrange(1, 9))]
    rows += [(500, t, r.choice(roles), f"long{t}", None) for t in range(700)]  # one that spans partitions
    rows += [(600, 0, "user", "very long " * 200000, None)]
    rows += [(None, 0, "user", "no conversation", 1), (77, None, "user", None, 1), (77, None, "user", None, 1), (78, 0, "assistant", "", 1)]
    got = format_chats(spark.createDataFrame(rows, SCHEMA).repartition(5), partitions).collect()
    assert len(got) == len(rows)
    by, given = defaultdict(list), defaultdict(list)
    for x in sorted(got, key=lambda x: x.place):
        by[x.conv_id].append(x)
    for x in sorted(rows, key=lambda x: (x[1] is None, x[1] or 0)):
        given[x[0]].append(x)
    for c, pieces in by.items():
        turns = parse("".join(x.rendered for x in pieces))
        assert legal([t[0] for t in turns]), c
        assert "".join(t[1] for t in turns).replace("\n", "") == "".join((x[3] or "") for x in given[c]).replace("\n", "")
        codes = [role_code(x.role) for x in pieces]
        names = ["", "system", "user", "assistant"]
        assert cost_of(codes, [names.index(x.new_role) for x in pieces]) == cost_of(codes, repair(codes))
        assert sum(x.inserted_before + x.inserted_after for x in pieces) + sum(not x.merged for x in pieces) == len(turns)


def test_empty(spark):
    assert format_chats(spark.createDataFrame([], SCHEMA)).collect() == []
