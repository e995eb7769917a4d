import hashlib
import random
import re

import pytest

from heliograph.llm.fingerprints import fingerprint_edits, fingerprints, merge_fingerprints

SCHEMA = "doc_id long, text string, fingerprint int"


def made(seed=4):
    r = random.Random(seed)
    word = lambda: r.choice("né bb 😀c dd e".split()) + str(r.randrange(90))
    rows = [(i * 7 % 1000, " ".join(word() for _ in range(r.randrange(0, 300))), None) for i in range(150)]
    return rows + [(2001, None, 1), (2002, "", 1), (2003, "one", 1), (2004, rows[0][1], 1), (-5, rows[0][1], 1)]


def in_order(rows):
    rows = sorted(((d, t or "") for d, t, _ in rows), key=lambda x: (x[0] is None, -(x[0] or 0), x[1].encode()))
    return [(d, t, rows[(i + 1) % len(rows)][1]) for i, (d, t) in enumerate(rows)]


def grams(t):
    w = re.findall(r"[^\x20\x09-\x0d]+", t)
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()


@pytest.mark.parametrize("range_bytes", [16 << 20, 5000])
def test_edits_and_likeness(spark, range_bytes):
    rows = made() + [(None, "no id here", 1), (None, "also none", 1)]
    got = {(r.doc_id, r.n_chars): r for r in fingerprint_edits(spark.createDataFrame(rows, SCHEMA).repartition(4), range_bytes=range_bytes, scale=1).collect()}
    assert len(got) == len(rows)
    for d, t, x in in_order(rows):
        half, r = len(t) // 2, got[d, len(t)]
        edited = t[: len(t) - half] + x[:half]
        assert r.edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        for value, other in ((r.near_edited, edited), (r.near_next, x)):  # scale 1 keeps all, so containment is exact
            a, b = grams(t), grams(other)
            assert value == pytest.approx(len(a & b) / min(len(a), len(b)) if a and b else float(not a and not b))


def test_query_sees_half_edited_short_texts(spark, tmp_path):
    from heliograph.llm.queries import op7_fingerprints

    r = random.Random(8)
    rows = [(i, " ".join("w%d" % r.randrange(10**6) for _ in range(r.randrange(14, 44))), None) for i in range(200)]
    spark.createDataFrame(rows, SCHEMA).write.parquet(f"{tmp_path}/documents.parquet")
    got = op7_fingerprints(spark, str(tmp_path)).collect()
    assert len(got) == 200 and min(x.near_edited for x in got) > 0


@pytest.mark.parametrize("scale,least", [(16, 1), (16, 40), (4, 256), (1, 1)])
def test_sparse_fingerprints_by_brute_force(spark, scale, least):
    """The hashes below the threshold and the least ones, and containment where both are complete."""
    from heliograph.llm import _words

    rows = made() + [(3000, "long " + " ".join("l%d" % i for i in range(60000)), 1)]
    got = {(r.doc_id, r.n_chars): r for r in fingerprint_edits(spark.createDataFrame(rows, SCHEMA).repartition(3), range_bytes=4000, scale=scale, least=least).collect()}

    def kept(t):
        _, h = _words.shingles(_words.scan([t.encode()]))
        every = sorted(h.tolist())
        return [x for i, x in enumerate(every) if i < least or x < 2**64 // scale], 2**64 if len(every) < least else max(every[least - 1], 2**64 // scale - 1)

    for d, t, x in in_order(rows):
        r, half = got[d, len(t)], len(t) // 2
        mine = kept(t)
        assert r.fingerprint == "".join(f"{h:016x}" for h in mine[0])
        for value, other in ((r.near_edited, kept(t[: len(t) - half] + x[:half])), (r.near_next, kept(x))):
            bound = min(mine[1], other[1])
            a, b = ({h for h in s[0] if h <= bound} for s in (mine, other))
            assert value == pytest.approx(len(a & b) / min(len(a), len(b)) if a and b else float(not mine[0] and not other[0]))


def test_error_by_length(spark):
    """By the query's own parameters: none up to 256 shingles, small beyond."""
    r = random.Random(2)
    rows = [(i, " ".join("w%d" % r.randrange(10**6) for _ in range(n)), None) for i, n in enumerate([120] * 100 + [900] * 100 + [6000] * 30)]
    got = {x.doc_id: x for x in fingerprint_edits(spark.createDataFrame(rows, SCHEMA)).collect()}
    worst = {}
    for d, t, x in in_order(rows):
        a, b = grams(t), grams(t[: len(t) - len(t) // 2] + x[: len(t) // 2])
        n = len(t.split())
        worst[n] = max(worst.get(n, 0), abs(got[d].near_edited - len(a & b) / min(len(a), len(b))))
    assert worst[120] == 0 and worst[900] < 0.13 and worst[6000] < 0.06
    size = {n: sum(len(got[d].fingerprint) for d, t, _ in rows if len(t.split()) == n) / sum(len(t) for _, t, _ in rows if len(t.split()) == n) for n in (120, 900, 6000)}
    assert size[6000] < 0.65 and size[6000] < size[900] < size[120]  # fingerprint bytes per byte of text


def test_equal_texts_and_scale(spark):
    got = {r.doc_id: r.fingerprint for r in fingerprints(spark.createDataFrame(made(), SCHEMA)).collect()}
    assert got[0] == got[2004] == got[-5] and got[2001] == got[2002] == "" and len(got[2003]) == 16
    again = {r.doc_id: r.fingerprint for r in fingerprint_edits(spark.createDataFrame(made(), SCHEMA)).collect()}
    assert again == got


@pytest.mark.parametrize("how", [{}, {"scale": 1}, {"scale": 8, "least": 20}])
def test_merge(spark, how):
    words = ["w%d" % i for i in range(1500)]
    text = lambda a, b: " ".join(words[a:b])
    df = spark.createDataFrame([(1, text(0, 900), 0), (2, text(896, 1500), 0), (3, text(0, 1500), 0), (4, "a b c d e f g h", 0), (5, "d e f g h i j k", 0), (6, "a b c d e f g h i j k", 0)], SCHEMA)
    x = {r.doc_id: r.fingerprint for r in fingerprints(df, **how).collect()}
    assert merge_fingerprints(x[1], x[2], **how) == x[3] and merge_fingerprints(x[4], x[5], **how) == x[6] and merge_fingerprints(x[1], x[1], **how) == x[1]


def test_repeated_ids_single_and_empty(spark):
    rows = [(5, "b b", 0), (5, "a", 0), (5, "a", 0), (1, "z z z z", 0)]
    got = sorted((r.doc_id, r.n_chars, r.edited_sha256) for r in fingerprint_edits(spark.createDataFrame(rows, SCHEMA)).collect())
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    assert got == sorted([(5, 1, sha("a")), (5, 1, sha("a")), (5, 3, sha("b z")), (1, 7, sha("z z a"))])
    assert [r.near_next for r in fingerprint_edits(spark.createDataFrame([(1, "x y", 0)], SCHEMA)).collect()] == [1.0]
    assert fingerprint_edits(spark.createDataFrame([], SCHEMA)).collect() == []
