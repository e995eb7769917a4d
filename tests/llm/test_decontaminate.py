import random

import numpy as np
import pytest

from heliograph.llm import _words
from heliograph.llm.decontaminate import Part, drop_contaminated, edit_distance, find_leaks

DOCS, ITEMS = "doc_id long, text string, item_id string", "item_id long, text string, lang string"


def distance(a, b):
    """Least edits between a and any stretch of b, by the plain recurrence."""
    row = [0] * (len(b) + 1)
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j - 1] + (x != y), row[j] + 1, new[-1] + 1))
        row = new
    return min(row)


def made(seed=1):
    r = random.Random(seed)
    word = lambda: "v%d" % r.randrange(3000)
    items = [(i, " ".join(word() for _ in range(r.randrange(8, 60))), "en") for i in range(30)]
    docs = []
    for d in range(240):
        w = [word() for _ in range(r.randrange(0, 120))]
        if d % 3 == 0:
            x = r.choice(items)[1].split()
            for _ in range(r.randrange(0, max(1, len(x) // 7))):
                at, how = r.randrange(len(x)), r.randrange(3)
                x[at : at + (how != 1)] = [word()] if how else []
            at = r.randrange(len(w) + 1)
            w[at:at] = x
        docs.append((d, " ".join(w).upper() if d % 5 == 0 else "  ".join(w), None))
    return docs + [(None, items[0][1], None), (900, None, None), (901, " ", None), (902, items[1][1], None), (902, items[1][1], None)], items + [(77, None, None), (78, "", None), (None, "alone here again", None)]


def test_edit_distance_by_brute_force():
    r = np.random.RandomState(0)
    for _ in range(200):
        a, b = r.randint(0, 4, r.randint(1, 9)).astype(np.uint64), r.randint(0, 4, r.randint(0, 14)).astype(np.uint64)
        d, s, e = edit_distance(a, b)
        assert d == distance(a.tolist(), b.tolist()) and 0 <= s <= e <= len(b)


def test_recall_and_precision(spark):
    docs, items = made()
    got = find_leaks(spark.createDataFrame(docs, DOCS), spark.createDataFrame(items, ITEMS)).collect()
    found = {(r.doc_id, r.item_id): r.edits for r in got}
    want = {}
    for d, t, _ in docs:
        for i, x, _ in items:
            a, b = (x or "").split(), (t or "").lower().split()
            if a and len(a) <= len(b) * 1.3:
                n = distance(a, b)
                if n <= int(0.2 * len(a) + 1e-9):
                    want[d, i] = n
    assert len(want) > 60 and found.keys() <= want.keys()
    assert len(found) >= 0.98 * len(want), sorted(want.keys() - found.keys(), key=str)
    assert all(found[k] >= want[k] for k in found) and sum(found[k] == want[k] for k in found) >= 0.95 * len(found)


@pytest.mark.parametrize("how", ["drop", "replace", "any"])
@pytest.mark.parametrize("size", [10, 15, 31, 60, 120, 250])
def test_recall_of_the_lsh_alone_at_the_limit(size, how):
    """Of items with one word in five edited, those whose right window is a candidate."""
    r, hits, n = random.Random(size), 0, 100
    word = lambda: "v%d" % r.randrange(5000)
    items = [(i, " ".join(word() for _ in range(size))) for i in range(n)]
    texts = []
    for _, t in items:
        x = t.split()
        for at in sorted(r.sample(range(size), size // 5), reverse=True):
            kind = r.randrange(3) if how == "any" else 0 if how == "drop" else 2
            x[at : at + (kind != 1)] = [word()] if kind else []
        texts.append(" ".join([word() for _ in range(r.randrange(40))] + x + [word() for _ in range(r.randrange(40))]).encode())
    part = Part(items, 0.8, 32, 3)
    found = {(d, i) for d, i, _ in part.candidates(_words.scan(texts, lower=True)).tolist()}
    hits = sum((i, i) in found for i in range(n))
    assert hits >= 0.97 * n
    leaks = part.leaks(texts)
    assert sum(d == i for d, i, *_ in leaks) >= 0.97 * n


def test_slices_and_long_texts_do_not_matter():
    docs, items = made(3)
    part = Part([x[:2] for x in items], 0.8, 32, 3)
    raw = [(t or "").encode() for _, t, _ in docs]
    whole = part.leaks([*raw, b" ".join(raw)])
    alone = [(i, *rest) for i, t in enumerate([*raw, b" ".join(raw)]) for _, *rest in part.leaks([t])]
    assert whole == alone and {i for d, i, *_ in whole if d == len(raw)} >= {i for d, i, *_ in whole if d < len(raw)}


def test_parts_and_filter_and_empty(spark):
    docs, items = made(2)
    d, b = spark.createDataFrame(docs, DOCS), spark.createDataFrame(items, ITEMS)
    whole = {(r.doc_id, r.item_id) for r in find_leaks(d, b).collect()}
    assert {(r.doc_id, r.item_id) for r in find_leaks(d, b, part_bytes=3000).collect()} == whole
    clean = drop_contaminated(d, b, part_bytes=3000)
    assert clean.columns == d.columns
    assert sorted([r.doc_id for r in clean.collect()]) == sorted([x[0] for x in docs if x[0] is not None and x[0] not in {p for p, _ in whole}])
    assert find_leaks(d.where("false"), b).collect() == [] and find_leaks(d, b.where("false")).collect() == []


def test_words_are_what_is_compared():
    assert _words.scan([b"A b"], lower=True).hash.tolist() == _words.scan([b"a\tB"], lower=True).hash.tolist()


def _template(n, opening=12, own=10, seed=4):
    rnd = random.Random(seed)
    head = " ".join(f"open{i}" for i in range(opening))
    return head, [(i, head + " " + " ".join(f"w{rnd.randrange(50_000)}" for _ in range(own))) for i in range(n)]


def test_items_with_a_common_opening_cost_no_product():
    import time

    from heliograph.llm.decontaminate import Part

    head, items = _template(3000)
    part = Part(items, 0.8, 32, 3)
    text = " ".join([head] * 65)
    leak = f"{text} before {items[17][1]} after {text} {items[2999][1].replace('open3', 'x')}"
    start = time.time()
    assert part.leaks([text.encode()]) == []
    assert {(d, part.ids[i]) for d, i, *_ in part.leaks([leak.encode(), text.encode()])} == {(0, 17), (0, 2999)}
    assert time.time() - start < 6  # some 2 s on a quiet machine; all pairs took 69


def test_hot_windows_lose_no_pair(monkeypatch):
    from heliograph.llm import decontaminate as D

    rnd = random.Random(3)
    _, items = _template(150, 14, 8)
    texts = []
    for k in range(60):
        words = items[rnd.randrange(150)][1].split()
        for _ in range(rnd.randrange(4)):
            words[rnd.randrange(len(words))] = "edit"
        texts.append(" ".join(["lead"] * rnd.randrange(9) + words + items[k][1].split()[:13] * 3).encode())
    found = []
    for hot in (0, 64, 10**9):
        monkeypatch.setattr(D, "HOT", hot)
        found.append(sorted(D.Part(items, 0.8, 32, 3).leaks(texts)))
    assert found[0] == found[1] == found[2] and len(found[0]) >= 50
