import hashlib
import random
import re

import pytest

from heliograph.llm import substring_dedup
from heliograph.llm.substring_dedup import dedup_substrings

SCHEMA = "doc_id long, text string, lang string"


def brute(rows, k):
    words = [(d, re.findall(r"[^\x20\x09-\x0d]+", t or "")) for d, t, _ in rows]
    least = {}
    for d, w in words:
        for i in range(len(w) - k + 1):
            key = tuple(w[i : i + k])
            if d is not None:
                least[key] = min(least.get(key, d), d)
    out = []
    for d, w in words:
        gone = set()
        for i in range(len(w) - k + 1):
            m = least.get(tuple(w[i : i + k]))
            if m is not None and (d is None or m < d):
                gone.update(range(i, i + k))
        kept = " ".join(x for i, x in enumerate(w) if i not in gone)
        out.append((d, len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return sorted(out, key=str)


def made(seed=5):
    r = random.Random(seed)
    word = lambda: r.choice("ab cé d e f g hh ii jj".split(" ")) + str(r.randrange(40))
    passage = [word() for _ in range(80)]
    rows = []
    for d in range(60):
        w = [word() for _ in range(r.randrange(0, 90))]
        if d % 3 == 0:
            a = r.randrange(0, 20)
            w[len(w) // 2 : len(w) // 2] = passage[a : a + r.randrange(8, 60)]
        if d % 7 == 0:
            w += ["x"] * 30
        rows.append((d * 10, "\n".join(" ".join(w[i : i + 9]) for i in range(0, len(w), 9)), "en"))
    rows += [(5, rows[3][1], None), (5, rows[3][1], None), (None, rows[6][1], "en"), (7, None, None), (9, "", None), (11, " \t\n ", None), (13, "one", None)]
    return rows


@pytest.mark.parametrize(("block_bytes", "window"), [(1 << 20, 8), (900, 12), (5000, 50)])
def test_against_brute_force(spark, block_bytes, window):
    rows = made()
    got = dedup_substrings(spark.createDataFrame(rows, SCHEMA), window=window, block_bytes=block_bytes).collect()
    assert sorted([(r.doc_id, r.n_words, r.n_removed, hashlib.sha256(r.kept_text.encode()).hexdigest()) for r in got], key=str) == brute(rows, window)


def test_empty_and_long(spark):
    assert dedup_substrings(spark.createDataFrame([], SCHEMA)).collect() == []
    rows = [(1, "w" * 300000 + " b" * 200000, "en"), (2, "b " * 120, "en")]
    got = {r.doc_id: (r.n_words, r.n_removed) for r in dedup_substrings(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got == {1: (200001, 0), 2: (120, 120)}


def test_packing():
    import numpy as np

    for n in (0, 5, 9000):
        cells = np.sort(np.random.RandomState(n).randint(0, 1 << 28, n).astype(np.uint64))
        assert (substring_dedup._unpack(substring_dedup._pack(cells)) == cells).all()
