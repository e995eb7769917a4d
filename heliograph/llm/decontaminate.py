"""Benchmark decontamination: CGK embeddings, bit-sampling LSH, exact edit verification.

Texts are sequences of lower-cased words, and edits are insertions, deletions and substitutions of words. An
item of N words leaks into a document if some stretch of its words is within
``floor((1 - similarity) * N)`` edits of the item. Three steps find such pairs:

1. *CGK.* A walk reads a window of N words from its start: at each step it writes the current word and the one after it, then stays or
   moves on by a random bit of (walk, step, word). Few edits so become few differing steps: two walks that have parted at an edit
   meet again with good chance, as equal words give equal bits. Items of ``c`` to ``2c - 1`` words (c a power of 2) are a class; their walks take
   ``c`` steps, so all windows of a class share one walk, whatever their size.
2. *Bit-sampling LSH.* In each of ``repeats`` walks ``places`` steps are sampled, one of them early. A window whose sampled writings all
   equal those of an item's window in any walk makes a candidate. On the text's side windows start at every ``c / 4``-th word of every
   document; on the items' side at every word that leaves half of c, so alignment loses nothing and each leak has several
   chances. A window whose early writing no item has is given up there, as it can't agree.
3. *Exact.* Candidates are verified by the edit distance between the item and the best stretch of the
   words around the window.

Recall of steps 1 and 2 with 32 walks of 3 places, measured at the limit (one word in five edited, 10 to 250 words; deletions alone,
substitutions alone, and mixed): 0.99 or more (``tests/llm/test_decontaminate.py``). Items under 8 words write single words.

Items with a common opening (a question set's preamble) share windows. Where a window's writings belong to more than HOT places of items, the text's
windows and those places are not all paired: first each of those items is asked, once a text, whether enough of its words occur in the text at all, which
any match needs; only those that pass meet the windows. So the opening alone costs a text one look at each item, however often it repeats it, and no pair is lost.

The benchmark is the stated query set: it is collected in parts of at most ``part_bytes`` of text, and each
part is broadcast and held against all documents in one pass without a shuffle. So a benchmark of 1 GB is 500 passes; what grows with it is time, not memory.
Of equally good stretches of a pair the first one found is reported.

Nulls: a null or wordless text or item matches nothing; rows without id are reported with a null id.
Repeated rows and items are each reported. Empty tables give empty results. Other columns are ignored by
``find_leaks`` and passed on by ``drop_contaminated``.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from heliograph.llm import _words
from heliograph.session import ship_package

U = np.uint64
HOT = 64  #: so many places of items may agree with a window before the items are asked first


class Walks:
    """CGK walks of one class of items, from given starts in a sequence of words with a zero after each text."""

    def __init__(self, c: int, repeats: int, places: int, seed: int = 17):
        r = np.random.RandomState((seed + 7919 * c) % (1 << 31))
        early = r.randint(0, max(1, c // 8), (repeats, 1))
        self.places = np.sort(np.concatenate([early, r.randint(0, c, (repeats, places - 1))], axis=1), axis=1)
        self.odd = r.randint(0, 2**62, (repeats, c), dtype=np.int64).astype(U) * U(4) + U(0x9E3779B97F4A7C15)
        self.pairs = c >= 8

    def letters(self, words: np.ndarray) -> np.ndarray:
        """What a walk writes at each word."""
        if not self.pairs:
            return words
        return _words.mix(words * _words._BASE + np.append(words[1:], U(0)), 31)

    def codes(self, words: np.ndarray, letters: np.ndarray, starts: np.ndarray, walk: int, seen: np.ndarray | None = None):
        """(which starts, hash of the sampled writings); those whose early writing is not marked in seen are left out."""
        pos, code, which = starts.copy(), np.zeros(len(starts), dtype=U), np.arange(len(starts))
        step = 0
        for k, place in enumerate(self.places[walk].tolist()):
            while step < place:
                pos += ((words[pos] * self.odd[walk, step]) >> U(63)).view(np.int64)  # stay or move on; a zero stays
                step += 1
            wrote = letters[pos]
            if k == 0 and seen is not None:
                may = np.flatnonzero(seen[(wrote >> U(44)).astype(np.int64)])
                pos, code, which, wrote = pos[may], code[may], which[may], wrote[may]
            code = _words.mix(code * _words._BASE + wrote, 33)
        return which, code

    def early(self, words: np.ndarray, letters: np.ndarray, starts: np.ndarray, walk: int) -> np.ndarray:
        """Marks of the writings at the first sampled step."""
        pos = starts.copy()
        for step in range(int(self.places[walk, 0])):
            pos += ((words[pos] * self.odd[walk, step]) >> U(63)).view(np.int64)
        seen = np.zeros(1 << 20, dtype=bool)
        seen[(letters[pos] >> U(44)).astype(np.int64)] = True
        return seen


def separated(words: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The words with a zero after each text (and one more), and where each text starts among them."""
    doc = np.repeat(np.arange(len(first) - 1), np.diff(first))
    out = np.zeros(len(words) + len(first), dtype=U)
    out[np.arange(len(words)) + doc] = words
    return out, first[:-1] + np.arange(len(first) - 1)


def edit_distance(item: np.ndarray, text: np.ndarray) -> tuple[int, int, int]:
    """Least edits between item and any stretch of text, and that stretch's start and end."""
    m = len(text)
    row = np.zeros(m + 1, dtype=np.int64)
    start = np.arange(m + 1)
    steps = np.arange(m + 1)
    for i, w in enumerate(item, 1):
        sub = row[:-1] + (text != w)
        drop = row[1:] + 1
        best = np.concatenate([[i], np.minimum(sub, drop)])
        origin = np.concatenate([[0], np.where(sub <= drop, start[:-1], start[1:])])
        # insertions: a running minimum of best - place
        key = best - steps
        low = np.minimum.accumulate(key)
        idx = np.maximum.accumulate(np.where(key == low, steps, 0))
        row, start = low + steps, origin[idx]
    end = int(np.argmin(row))
    return int(row[end]), int(start[end]), end


class Part:
    """A part of the benchmark, ready for slices of texts."""

    def __init__(self, items: list[tuple], similarity: float, repeats: int, places: int):
        w = _words.scan([(t or "").encode() for _, t in items], lower=True)
        self.ids = [i for i, _ in items]
        size = np.diff(w.first)
        self.words = [w.hash[a:b] for a, b in zip(w.first[:-1], w.first[1:], strict=True)]
        self.edits = [int((1 - similarity) * n + 1e-9) for n in size.tolist()]
        self.flat, self.first = w.hash, w.first
        words, begin = separated(w.hash, w.first)
        self.classes = []
        for c in sorted({1 << n.bit_length() - 1 for n in size.tolist() if n}):
            own = np.flatnonzero((size >= c) & (size < 2 * c))
            many = size[own] - (c + 1) // 2 + 1
            item = np.repeat(own, many)
            offset = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
            walks, starts, tables = Walks(c, repeats, places), begin[item] + offset, []
            letters = walks.letters(words)
            for r in range(repeats):
                _, code = walks.codes(words, letters, starts, r)
                order = np.argsort(code, kind="stable")
                tables.append((code[order], order, walks.early(words, letters, starts, r)))
            self.classes.append((max(1, c // 4), walks, item, offset, tables))

    def _enough(self, items: np.ndarray, text: np.ndarray) -> np.ndarray:
        """For each item, whether as many of its words as a match needs occur in the text's (sorted, distinct) words."""
        size = self.first[items + 1] - self.first[items]
        at = np.repeat(self.first[items] - (np.cumsum(size) - size), size) + np.arange(size.sum())
        words = self.flat[at]
        place = np.minimum(np.searchsorted(text, words), len(text) - 1)
        there = np.add.reduceat((text[place] == words).astype(np.int64), np.cumsum(size) - size)
        return there >= size - np.array([self.edits[i] for i in items.tolist()])

    def _hot(self, w: _words.Words, text: np.ndarray, lo: np.ndarray, hi: np.ndarray, item: np.ndarray, order: np.ndarray, asked: dict) -> tuple[np.ndarray, np.ndarray]:
        """(windows, places of items) that go together, of windows at the given words whose writings many places of items share: order[lo:hi]."""
        doc, out = w.doc[text], [(np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64))]
        by = np.lexsort((lo, doc))
        cut = np.flatnonzero(np.diff(doc[by]) | np.diff(lo[by])) + 1
        for windows in np.split(by, cut):
            d, a, b = int(doc[windows[0]]), int(lo[windows[0]]), int(hi[windows[0]])
            if d not in asked:
                asked[d] = (np.unique(w.hash[w.first[d] : w.first[d + 1]]), np.full(len(self.ids), -1, dtype=np.int8))
            known, state = asked[d]
            new = np.unique(item[order[a:b]])
            new = new[state[new] < 0]
            if len(new):
                state[new] = self._enough(new, known)
            places = order[a:b][state[item[order[a:b]]] == 1]
            out.append((np.repeat(text[windows], len(places)), np.tile(places, len(windows))))
        return tuple(np.concatenate(x) for x in zip(*out, strict=True))

    def candidates(self, w: _words.Words) -> np.ndarray:
        """Rows (text, item, the window's first word) of all windows that agree with an item's in some walk."""
        words, begin = separated(w.hash, w.first)
        place = np.arange(len(w.hash)) - w.first[w.doc]
        found, asked = [], {}
        for stride, walks, item, offset, tables in self.classes:
            at = np.flatnonzero(place % stride == 0)
            starts, letters = at + w.doc[at], walks.letters(words)
            for r, (codes, order, seen) in enumerate(tables):
                which, code = walks.codes(words, letters, starts, r, seen)
                lo, hi = np.searchsorted(codes, code), np.searchsorted(codes, code, "right")
                n = hi - lo
                hot = n > HOT
                if hot.any():
                    hot_text, hot_hit = self._hot(w, at[which[hot]], lo[hot], hi[hot], item, order, asked)
                    n = np.where(hot, 0, n)
                hit = order[np.repeat(lo, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)]
                text = np.repeat(at[which], n)
                if hot.any():
                    hit, text = np.concatenate([hit, hot_hit]), np.concatenate([text, hot_text])
                found.append(np.unique(np.stack([w.doc[text], item[hit], text - offset[hit]], axis=1), axis=0))
        return np.unique(np.concatenate(found), axis=0) if found else np.zeros((0, 3), dtype=np.int64)

    def leaks(self, raw: list[bytes]) -> list[tuple[int, int, int, int, int]]:
        """(text, item, edits, first word, word after the last) of the best stretch of each pair."""
        w = _words.scan(raw, lower=True)
        found: dict = {}
        for doc, i, start in self.candidates(w).tolist():
            k, n, words = self.edits[i], len(self.words[i]), self.words[i]
            best = found.get((doc, i))
            if best and (best[0] == 0 or best[1] <= start and start + n <= best[2]):
                continue
            lo, hi = max(int(w.first[doc]), start - k), min(int(w.first[doc + 1]), start + n + k)
            if lo <= start and start + n <= hi and (w.hash[start : start + n] == words).all():
                found[doc, i] = (0, start, start + n)
                continue
            text = w.hash[lo:hi]
            if hi - lo < n - k or np.isin(words, text).sum() < n - k:  # too many of its words are not there
                continue
            d, s, e = edit_distance(words, text)
            if d <= k and (best is None or d < best[0]):
                found[doc, i] = (d, lo + s, lo + e)
        return [(doc, i, d, s - int(w.first[doc]), e - int(w.first[doc])) for (doc, i), (d, s, e) in sorted(found.items())]


def _parts(benchmark: DataFrame, part_bytes: int, **how):
    """The benchmark in parts of bounded size, one at a time on the driver, each as a broadcast variable."""
    sc = benchmark.sparkSession.sparkContext
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), "text")
    total = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = 1 + int(total // part_bytes)
    for p in range(n):
        rows = items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(n)) == p).collect()
        yield sc.broadcast(([tuple(r) for r in rows], how))


def _load(shared) -> Part:
    items, how = shared.value
    return Part(items, **how)


def find_leaks(documents: DataFrame, benchmark: DataFrame, similarity: float = 0.8, repeats: int = 32, places: int = 3, part_bytes: int = 2 << 20) -> DataFrame:
    """doc_id, item_id, edits, similarity, start_word, end_word for each document(doc_id, text) that holds an item of benchmark(item_id, text)."""
    ship_package(documents.sparkSession)
    docs = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    out = None
    for shared in _parts(benchmark, part_bytes, similarity=similarity, repeats=repeats, places=places):

        def run(batches, shared=shared):
            part = _load(shared)
            for batch in batches:
                ids, raw, rows = batch.column("doc_id").to_pylist(), _words.rows_of(batch, "text"), []
                for lo, hi in _words.slices([len(x) for x in raw]):
                    for doc, i, d, s, e in part.leaks(raw[lo:hi]):
                        rows.append((ids[lo + doc], part.ids[i], d, 1 - d / len(part.words[i]), s, e))
                cols = list(zip(*rows, strict=True)) or [[]] * 6
                kinds = [pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.int64(), pa.int64()]
                yield pa.RecordBatch.from_arrays([pa.array(c, type=t) for c, t in zip(cols, kinds, strict=True)], names=["doc_id", "item_id", "edits", "similarity", "start_word", "end_word"])

        got = docs.mapInArrow(run, "doc_id long, item_id long, edits long, similarity double, start_word long, end_word long")
        out = got if out is None else out.unionByName(got)
    return out


def drop_contaminated(documents: DataFrame, benchmark: DataFrame, similarity: float = 0.8, repeats: int = 32, places: int = 3, part_bytes: int = 2 << 20) -> DataFrame:
    """The rows of documents that hold no item of the benchmark, with all their columns."""
    ship_package(documents.sparkSession)
    out = documents
    for shared in _parts(benchmark, part_bytes, similarity=similarity, repeats=repeats, places=places):

        def run(batches, shared=shared):
            part = _load(shared)
            for batch in batches:
                raw = _words.rows_of(batch, "text")
                clean = np.ones(len(raw), dtype=bool)
                for lo, hi in _words.slices([len(x) for x in raw]):
                    for doc, *_ in part.leaks(raw[lo:hi]):
                        clean[lo + doc] = False
                yield batch.filter(pa.array(clean))

        out = out.mapInArrow(run, documents.schema)
    return out
