import random
import re

import numpy as np
import pytest

from heliograph.llm.near_dedup import components, near_duplicates, signatures

SCHEMA = "doc_id long, text string, n long, rep string"


def sets_of(rows):
    out = []
    for row in rows:
        w = re.findall(r"[^\x20\x09-\x0d]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in row[1] or ""))
        out.append({tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set())
    return out


def brute(rows):
    """By all pairs; rows without id stand alone."""
    sets, at = sets_of(rows), {}
    least = {r[0]: r[0] for r in rows if r[0] is not None}

    def top(x):
        while least[x] != x:
            x = least[x]
        return x

    for i, r in enumerate(rows):
        for j in range(i):
            if r[0] is not None and rows[j][0] is not None and sets[i] and sets[j]:
                both = len(sets[i] & sets[j])
                if 100 * both >= 85 * (len(sets[i]) + len(sets[j]) - both):
                    a, b = sorted((top(r[0]), top(rows[j][0])))
                    least[b] = a
    return sorted(((r[0], len(s), None if r[0] is None else top(r[0]), r[0] is None or top(r[0]) == r[0]) for r, s in zip(rows, sets, strict=True)), key=str), at


def made(seed=3):
    r = random.Random(seed)
    word = lambda: "w%d" % r.randrange(500)
    rows, passage = [], [word() for _ in range(60)]
    for g in range(12):
        base = [word() for _ in range(r.randrange(60, 200))]
        for _ in range(r.choice([1, 2, 3, 12])):
            w = list(base)
            for _ in range(r.randrange(0, 4)):
                w[r.randrange(len(w))] = word()
            rows.append(w)
    base = [word() for _ in range(150)]
    for _ in range(12):  # a chain: each a small change of the one before
        base = list(base)
        base[r.randrange(len(base))] = word()
        base.append(word())
        rows.append(base)
    for _ in range(25):  # much in common, but too little
        rows.append(passage + [word() for _ in range(14)])
    rows = [(i * 3 + 1, " ".join(w), i, "x") for i, w in enumerate(r.sample(rows, len(rows)))]
    rows += [(900, None, 1, None), (901, "", 1, None), (902, "A b", 1, None), (903, "a B", 1, None), (904, " \n", 1, None)]
    rows += [(None, rows[0][1], 1, None), (2, rows[5][1].upper(), 0, None), (2, rows[5][1], 0, None)]
    return rows


@pytest.mark.parametrize("seed", [3, 4])
def test_against_brute_force(spark, seed):
    rows = made(seed)
    got = near_duplicates(spark.createDataFrame(rows, SCHEMA)).collect()
    assert sorted(map(tuple, got), key=str) == brute(rows)[0]


def star(n, seed=5):
    """A hub of the largest id and n copies alike to it alone: Jaccard 0.86 to the hub, less than 0.8 to each other."""
    r, hub = random.Random(seed), ["h%d" % i for i in range(100)]
    rows = [(9000, " ".join(hub), 0, None)]
    for i in range(n):
        w = list(hub)
        for at in (r.randrange(10, 90), *r.choice([(0, 1), (98, 99), (0, 99)])):
            w[at] = "c%d_%d" % (i, at)
        rows.append((i, " ".join(w), 0, None))
    return rows


def test_star_around_a_hub_that_does_not_lead(spark):
    got = near_duplicates(spark.createDataFrame(star(1000), SCHEMA)).collect()
    assert len(got) == 1001 and {r.component_id for r in got} == {0}


def trees():
    """Random trees of copies, each with a few changed words of 200 against its parent, and two over structured words."""
    rows, i = [], 0
    for changed in (2, 3, 4):
        for seed in range(10):
            r, new = random.Random(100 * changed + seed), iter(range(10**6))
            word = lambda t=f"{changed}_{seed}_", new=new: t + str(next(new))
            tree = [[word() for _ in range(200)]]
            for _ in range(149):
                w = list(r.choice(tree))
                for at in r.sample(range(200), changed):
                    w[at] = word()
                tree.append(w)
            rows += [" ".join(w) for w in tree]
    for n in (1024, 2048):  # texts that differ in one structured word of few
        a, b = ("".join("ab"[(j.bit_count() + flip) & 1] for j in range(n)) for flip in (0, 1))
        rows += [f"p{n} q r s {a}", f"p{n} q r s {b}"]
    random.Random(9).shuffle(rows)
    return [(i, t, 0, None) for i, t in enumerate(rows)]


def test_random_trees_lose_no_link(spark):
    rows, by = trees(), {}
    for row in rows:  # trees share no word
        by.setdefault(re.match(r"\d+_\d+_|p\d+", row[1])[0], []).append(row)
    want = sorted(x for part in by.values() for x in brute(part)[0])
    got = sorted(map(tuple, near_duplicates(spark.createDataFrame(rows, SCHEMA)).collect()))
    assert got == want


def test_empty(spark):
    assert near_duplicates(spark.createDataFrame([], SCHEMA)).collect() == []
    assert [tuple(x) for x in near_duplicates(spark.createDataFrame([(1, None, 0, "")], SCHEMA)).collect()] == [(1, 0, 1, True)]


def test_components(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 7), (200, 201), (201, 200), (300, 300)]
    got = {r.node: r.component for r in components(_checkpointed(spark, edges)).collect()}
    assert got == {**{i: 0 for i in [*range(1, 41), 100]}, 201: 200}


def _checkpointed(spark, edges):
    from heliograph.session import ensure_checkpoint_dir

    ensure_checkpoint_dir(spark)
    return spark.createDataFrame(edges, "a long, b long")


def test_signatures_estimate_jaccard():
    r = np.random.RandomState(1)
    a = r.randint(0, 2**62, 900).astype(np.uint64)
    b = np.concatenate([a[:700], r.randint(0, 2**62, 200).astype(np.uint64)])
    doc = np.repeat([0, 1], 900)
    s = signatures(doc, np.concatenate([a, b]), 2, 512)
    assert abs((s[0] == s[1]).mean() - 700 / 1100) < 0.08
