"""Words, shingles and windows of many texts at once, as numpy arrays.

A word is a maximal run of bytes other than 0x20 and 0x09-0x0D. UTF-8 never uses those bytes inside
a longer character, so working on bytes gives the same words as working on characters. Hashes are
64-bit: a word's bytes are folded in eight at a time, with a non-linear mix after each step (words over 256 bytes by
BLAKE2b), and other seeds give independent hashes; a shingle's or window's hash is a polynomial over the hashes of its words,
mixed. Memory is bounded by slices of 1 MB, cut at separators, plus a few numbers per word.
"""

from __future__ import annotations

import hashlib
from typing import NamedTuple

import numpy as np

U = np.uint64
SLICE = 1 << 20
_SEP = np.zeros(256, dtype=bool)
_SEP[[0x20, *range(0x09, 0x0E)]] = True
_BASE = U(0x9E3779B97F4A7C15)
LONG = 256  #: bytes from which a word is hashed alone
LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
_powers: dict = {}


def _power(base, n: int) -> np.ndarray:
    """base**0 .. base**(n-1), wrapping at 2**64; kept per process."""
    have = _powers.get(int(base))
    if have is None or len(have) < n:
        x = np.full(max(n, 1), base, dtype=U)
        x[0] = 1
        _powers[int(base)] = have = np.multiply.accumulate(x)
    return have[:n]


def mix(x: np.ndarray, seed: int = 0) -> np.ndarray:
    """A bijection on 64-bit integers that spreads every input bit."""
    x = x + U((0x632BE59BD9B4E019 * (seed + 1)) % (1 << 64))
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def hash_words(buf: np.ndarray, start: np.ndarray, end: np.ndarray, seed: int = 0) -> np.ndarray:
    """The hash of each word buf[start:end]; seeds are independent of each other. buf ends with 8 bytes that no word has."""
    size = end - start
    eight = np.ndarray((len(buf) - 7,), dtype="<u8", buffer=buf, strides=(1,))  # the 8 bytes from each place on
    h = mix(size.astype(U), 101 + seed)
    live, at, left = slice(None), start, size
    while len(at):
        part = eight[at] & _LOW_BYTES[np.minimum(left, 8)]
        h[live] = mix(h[live] ^ part * _BASE, 201 + seed)
        more = np.flatnonzero((left > 8) & (left <= LONG))
        live = more if isinstance(live, slice) else live[more]
        at, left = at[more] + 8, left[more] - 8
    for i in np.flatnonzero(size > LONG).tolist():
        h[i] = int.from_bytes(hashlib.blake2b(buf[start[i] : end[i]].tobytes(), digest_size=8, salt=str(seed).encode()).digest(), "big")
    return h


_LOW_BYTES = np.array([(1 << 8 * n) - 1 for n in range(9)], dtype=U)


class Words(NamedTuple):
    buf: np.ndarray  #: the bytes of all texts, a newline before, between and after them, then 8 more
    start: np.ndarray  #: of each word in buf
    end: np.ndarray
    doc: np.ndarray  #: position of the word's text in the list
    hash: np.ndarray
    first: np.ndarray  #: for each text, and once more at the end: the index of its first word
    at: np.ndarray  #: where each text starts in buf


def scan(texts: list[bytes], lower: bool = False, hashes: bool = True) -> Words:
    """All words of the texts. lower: A-Z count as a-z."""
    raw = b"\n" + b"\n".join(texts) + b"\n" * 9
    if lower:
        raw = raw.translate(LOWER)
    buf = np.frombuffer(raw, dtype=np.uint8)
    size = np.fromiter((len(t) for t in texts), dtype=np.int64, count=len(texts))
    at = np.concatenate([[0], np.cumsum(size + 1)])[: len(texts)] + 1
    starts, ends, hashed, lo, n = [], [], [], 0, len(buf) - 8
    while lo < n - 1:
        hi = min(lo + SLICE, n)
        if hi < n:  # the slice ends with a separator
            cut = np.flatnonzero(_SEP[buf[lo + 1 : hi]])
            if len(cut):
                hi = lo + 2 + int(cut[-1])
            else:
                while not _SEP[buf[hi - 1]]:
                    step = np.flatnonzero(_SEP[buf[hi : hi + SLICE]])
                    hi = hi + 1 + int(step[0]) if len(step) else min(hi + SLICE, n)
        edge = np.flatnonzero(np.diff(_SEP[buf[lo:hi]].view(np.int8))) + 1 + lo
        s, e = edge[0::2], edge[1::2]
        if hashes and len(s):
            hashed.append(hash_words(buf, s, e))
        starts.append(s)
        ends.append(e)
        lo = hi - 1
    cat = lambda xs, kind: np.concatenate(xs) if xs else np.zeros(0, dtype=kind)
    start, end = cat(starts, np.int64), cat(ends, np.int64)
    first = np.concatenate([np.searchsorted(start, at), [len(start)]])
    doc = np.repeat(np.arange(len(texts)), np.diff(first))
    return Words(buf, start, end, doc, cat(hashed, U), first, at)


def windows(w: Words, k: int, seed: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """(word index, hash) of each k consecutive words within one text."""
    n = len(w.hash)
    if n < k:
        return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=U)
    ok = np.flatnonzero(w.doc[: n - k + 1] == w.doc[k - 1 :])
    g = hash_words(w.buf, w.start, w.end, seed) if seed else w.hash
    base = U((0xD6E8FEB86659FD93 + 2 * seed * 0x1000193) % (1 << 64) | 1)
    if k <= 8:
        h = np.zeros(n - k + 1, dtype=U)
        for j in range(k):
            h = h * base + g[j : n - k + 1 + j]
        return ok, mix(h[ok], seed)
    inv, out = U(pow(int(base), -1, 1 << 64)), np.empty(n - k + 1, dtype=U)
    for lo in range(0, n - k + 1, SLICE):
        m = min(SLICE, n - k + 1 - lo)
        c = np.concatenate([np.zeros(1, dtype=U), g[lo : lo + m + k - 1] * _power(base, m + k - 1)])
        np.cumsum(c, out=c)
        out[lo : lo + m] = (c[k : k + m] - c[:m]) * _power(inv, m)
    return ok, mix(out[ok], seed)


def shingles(w: Words, k: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """(text, hash) of the distinct k-word shingles of each text, ordered by text and hash.

    A text of fewer words, but at least one, has its whole sequence as its one shingle.
    """
    at, h = windows(w, k)
    doc = w.doc[at]
    count = np.diff(w.first)
    short = np.flatnonzero((count > 0) & (count < k))
    if len(short):
        whole = np.zeros(len(short), dtype=U)
        for j in range(k - 1):
            has = count[short] > j
            idx = np.minimum(w.first[short] + j, len(w.hash) - 1)
            whole = np.where(has, mix(whole * _BASE + w.hash[idx], 7), whole)
        doc, h = np.concatenate([doc, short]), np.concatenate([h, whole])
    order = np.lexsort((h, doc)) if len(short) else _by_doc(doc, h)
    doc, h = doc[order], h[order]
    if len(h) > 1:
        new = np.concatenate([[True], (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])])
        doc, h = doc[new], h[new]
    return doc, h


def _by_doc(doc: np.ndarray, h: np.ndarray) -> np.ndarray:
    order = np.argsort(h, kind="stable")
    return order[np.argsort(doc[order], kind="stable")]


def rows_of(batch, column: str) -> list[bytes]:
    """The texts of an Arrow batch as bytes; a null is an empty text."""
    import pyarrow as pa

    return [x or b"" for x in batch.column(column).cast(pa.large_binary()).to_pylist()]


def slices(sizes, limit: int = 1 << 20):
    """Ranges of rows of about ``limit`` bytes together; a longer row stands alone."""
    lo, total = 0, 0
    for i, n in enumerate(sizes):
        if i > lo and total + n > limit:
            yield lo, i
            lo, total = i, 0
        total += n
    if lo < len(sizes):
        yield lo, len(sizes)
