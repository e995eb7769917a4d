import re
from collections import defaultdict

import pytest

from heliograph.llm.mixing import emit_copies, mix_sources

SCHEMA = "doc_id long, text string, source string, copies string"


def brute(sizes):
    """Targets by repeated resharing, for sizes {source: words}."""
    names = sorted([s for s in sizes if s is not None]) + ([None] if None in sizes else [])
    w = {s: (1, 2, 3)[i % 3] for i, s in enumerate(names)}
    total, free, target = sum(sizes.values()), set(names), {}
    while free:
        left = total - sum(target.values())
        share = {s: left * w[s] / sum(w[x] for x in free) for s in free}
        over = [s for s in free if share[s] > 3 * sizes[s]]
        if not over:
            target.update(share)
            break
        for s in over:
            target[s] = 3 * sizes[s]
            free.discard(s)
    return target


def made():
    rows = []
    for i in range(400):
        source = "big" if i % 3 == 0 else [None, "a", "b", "ä", "zz", ""][i % 6]
        rows.append((i, " ".join(["w"] * (i % 37)), source, None))
    return rows + [(400, None, "none", None), (401, "x y", "tiny", None), (401, "x y", "tiny", None), (None, "q", "a", None)]


def test_against_resharing(spark):
    rows = made()
    got = mix_sources(spark.createDataFrame(rows, SCHEMA)).collect()
    sizes = defaultdict(int)
    for _, t, s, _ in rows:
        sizes[s] += len(re.findall(r"[^\x20\x09-\x0d]+", t or ""))
    want, taken = brute(dict(sizes)), defaultdict(int)
    assert len(got) == len(rows)
    for r in got:
        assert r.source_size == sizes[r.source] and r.target == pytest.approx(want[r.source])
        assert 0 <= r.copies <= 3
        taken[r.source] += r.copies * r.size
    assert sum(want.values()) == pytest.approx(sum(sizes.values()))
    for s in want:
        assert taken[s] == pytest.approx(want[s], rel=0.35, abs=20), s
    again = mix_sources(spark.createDataFrame(rows, SCHEMA).repartition(5)).collect()
    assert sorted(map(str, again)) == sorted(map(str, got))


def test_copies_match_and_empty(spark):
    df = spark.createDataFrame(made(), SCHEMA)
    n = sum(r.copies for r in mix_sources(df).collect())
    out = emit_copies(df)
    assert out.columns == [*df.columns, "copy"] and out.count() == n
    odd = df.withColumns({c: df["doc_id"] for c in ("copy", "__of", "__rate", "rate", "size", "target")})
    got = emit_copies(odd)
    assert got.columns == [*odd.columns, "copy_"] and got.count() == n and got.where("not copy <=> doc_id or not __of <=> doc_id").count() == 0
    assert mix_sources(df.where("false")).collect() == [] and emit_copies(df.where("false")).collect() == []
