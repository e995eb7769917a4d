import random
import re

import numpy as np
import pytest

from heliograph.llm import _words


def texts(seed):
    r = random.Random(seed)
    bits = ["a", "bé", "\u00a0x", " ", "  ", "\n", "\t", "\x0b", "😀", "word", "Zz", "\x1f"]
    return ["".join(r.choice(bits) for _ in range(r.randrange(0, 200))).encode() for _ in range(40)] + [b"", b" ", b"q " * 70]


@pytest.mark.parametrize("size", [16, 100, 1 << 20])
def test_words_do_not_depend_on_slices(monkeypatch, size):
    raw = texts(1)
    whole = _words.scan(raw)
    wide = [_words.windows(whole, k) for k in (1, 5, 12, 50)]
    monkeypatch.setattr(_words, "SLICE", size)
    w = _words.scan(raw)
    assert [w.buf[a:b].tobytes() for a, b in zip(w.start, w.end, strict=True)] == [x for t in raw for x in re.findall(rb"[^\x20\x09-\x0d]+", t)]
    assert (w.hash == whole.hash).all() and (w.first == whole.first).all()
    for k, (at, h) in zip((1, 5, 12, 50), wide, strict=True):
        got = _words.windows(w, k)
        assert (got[0] == at).all() and (got[1] == h).all()


@pytest.mark.parametrize("k", [1, 5, 12])
def test_equal_windows_have_equal_hashes_only(k):
    raw = [b" ".join(random.Random(i % 7).choices([b"x", b"y", b"z"], k=60)) for i in range(14)]
    w = _words.scan(raw)
    at, h = _words.windows(w, k)
    words = [x for t in raw for x in t.split()]
    by = {}
    for i, x in zip(at.tolist(), h.tolist(), strict=True):
        by.setdefault(tuple(words[i : i + k]), set()).add(x)
    assert all(len(x) == 1 for x in by.values()) and len({next(iter(x)) for x in by.values()}) == len(by)


def test_shingles_of_short_texts():
    doc, h = _words.shingles(_words.scan([b"a b", b"", b"a b", b"a b c d e f", b"b a", b"a b a b a b a b"]))
    got = {d: h[doc == d].tolist() for d in range(6)}
    assert got[0] == got[2] != got[4] and got[1] == [] and len(got[3]) == 2 and len(got[5]) == 2
    assert all((np.diff(h[doc == d].astype(object)) > 0).all() for d in range(6))


def test_structured_words_do_not_collide():
    def thue_morse(n, a, b):
        return bytes(b if i.bit_count() & 1 else a for i in range(n))

    words = [thue_morse(n, *ab) for n in (8, 16, 128, 256, 257, 1024, 2048, 4096) for ab in ((97, 98), (98, 97))]
    words += [b"a" * n for n in (1, 7, 8, 9, 15, 16, 17, 255, 256, 257)]
    for seed in (0, 1):
        w = _words.scan([b" ".join(words)])
        assert len(set(_words.hash_words(w.buf, w.start, w.end, seed).tolist())) == len(words)
    assert not set(w.hash.tolist()) & set(_words.hash_words(w.buf, w.start, w.end, 1).tolist())
