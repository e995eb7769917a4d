"""Substring dedup: a sharded count-min prefilter, then exact grouping of what it lets through.

``dedup_substrings`` removes each word covered by a window of ``window`` consecutive words whose
word sequence also starts in a document with a smaller id. The work is dealt to *blocks* of
documents (by a hash of id and text, about ``block_bytes`` of text each) and to *shards* of the window
hash space, both in proportion to the input:

1. each block makes its partition's sketch: for every shard the cells that its windows fall into,
   with counts that stop at 2;
2. each shard merges the sketches; a merged count never lies under the true one, so a window in
   a cell of count 1 occurs once in all documents and is settled;
3. each block sends one entry per window that is left, with its least document, to the shard;
   the shard groups them exactly (by 64 further hash bits besides the cell) and sends back those
   that start in a smaller document of another block;
4. each block applies these and its own repeats, and joins the words that stay.

Nothing is broadcast or collected, and a window that half of all documents share is one entry
per block. The sketch has one row of 2**28 cells per shard (some 70 for each window of the shard), kept sparse: the cells of
a partition's windows. Such sketches merge by adding counts cell by cell. A dense table would be 2**28 cells a block for windows that fill
one cell in a thousand of it. With one row a single window passes for a repeated one with probability
1.4 %; a second row would cut that to 0.02 %, and double a traffic of some 2.5 bytes a window (0.6 of the input's size on the
check's tables) to save entries of 20 bytes for 1.4 % of the windows (0.3 bytes a window). So it would cost more than it saves.

A block sends a message to each shard that it has windows for, so there are blocks times shards of them, but never more than
windows: at n bytes of text a message holds some 5 * block_bytes / n of a block's windows, and from about 14 TB at 4 MB blocks on one window, when
a row's overhead (some 40 bytes) sets the traffic. Then larger blocks help, as far as memory allows.

Nulls: a null text has no words; a null id counts as larger than all others, so such a document keeps
no word that one with an id has, and removes none. Rows of equal id don't remove each other's words.
Empty tables give empty results. Other columns of the input are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from heliograph.llm import _words
from heliograph.session import ship_package

U = np.uint64
LAST = np.iinfo(np.int64).max
CELL_BITS = 28
_LOW = U((1 << CELL_BITS) - 1)


def _pack(sorted_cells: np.ndarray) -> bytes:
    """Sorted cells: long lists as 16 low bits each and a count per value of the high bits."""
    if len(sorted_cells) < 8192:
        return b"r" + sorted_cells.astype(np.uint32).tobytes()
    bins = np.bincount((sorted_cells >> U(16)).astype(np.int64), minlength=1 << (CELL_BITS - 16)).astype(np.uint32)
    return b"p" + bins.tobytes() + (sorted_cells & U(0xFFFF)).astype(np.uint16).tobytes()


def _unpack(data: bytes) -> np.ndarray:
    if data[:1] == b"r":
        return np.frombuffer(data, dtype=np.uint32, offset=1)
    n = 1 << (CELL_BITS - 16)
    bins = np.frombuffer(data, dtype=np.uint32, count=n, offset=1)
    return np.repeat(np.arange(n, dtype=np.uint32) << np.uint32(16), bins) | np.frombuffer(data, dtype=np.uint16, offset=1 + 4 * n)


class _Block:
    """A block's documents in the order of (id, text), which any rerun finds again."""

    def __init__(self, table: pa.Table, window: int, shards: int, hashes: bool = True):
        ids, raw = table.column("doc_id").to_pylist(), _words.rows_of(table, "text")
        order = sorted(range(len(raw)), key=lambda i: (LAST if ids[i] is None else ids[i], raw[i]))
        self.raw_ids = [ids[i] for i in order]
        self.ids = np.array([LAST if x is None else x for x in self.raw_ids], dtype=np.int64)
        self.words = _words.scan([raw[i] for i in order])
        self.at, self.h = _words.windows(self.words, window)
        self.cell = self.h & _LOW
        self.shard = ((self.h >> U(CELL_BITS)) % U(shards)).astype(np.int64)

    def exact(self, window: int, keep: np.ndarray | None = None):
        """Windows (of keep) sorted by (hash, second hash, place): indices, second hashes, and which start a new group."""
        h2 = _words.windows(self.words, window, seed=1)[1]
        idx = np.arange(len(self.h)) if keep is None else np.flatnonzero(keep)
        h, h2 = self.h[idx], h2[idx]
        order = np.argsort(h2, kind="stable")
        if keep is not None:
            order = order[np.argsort(h[order], kind="stable")]
        idx, h, h2 = idx[order], h[order], h2[order]
        new = np.ones(len(idx), dtype=bool)
        new[1:] = (h[1:] != h[:-1]) | (h2[1:] != h2[:-1])
        return idx, h2, new


def _table(schema: list[tuple[str, pa.DataType]], rows: list[tuple]) -> pa.Table:
    cols = list(zip(*rows, strict=True)) or [[] for _ in schema]
    return pa.table({n: pa.array(c, type=t) for (n, t), c in zip(schema, cols, strict=True)})


_MSG = [("shard", pa.int32()), ("block", pa.int64()), ("cells", pa.binary()), ("keys", pa.binary()), ("docs", pa.binary())]
_MSG_DDL = "shard int, block long, cells binary, keys binary, docs binary"
_OUT = [("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_removed", pa.int64()), ("kept_text", pa.string())]


def _parts(shard: np.ndarray):
    """Ranges of equal values of a sorted array."""
    edge = np.flatnonzero(np.diff(shard)) + 1
    return zip(np.concatenate([[0], edge]), np.concatenate([edge, [len(shard)]]), strict=True) if len(shard) else ()


def dedup_substrings(documents: DataFrame, window: int = 50, block_bytes: int = 4 << 20) -> DataFrame:
    """doc_id, n_words, n_removed and kept_text of every row of documents(doc_id, text)."""
    spark = documents.sparkSession
    ship_package(spark)
    size = documents.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = 1 + size // block_bytes
    shards = 1 + size // (5 * block_bytes)  # some 4 million windows each
    docs = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.pmod(F.xxhash64("doc_id", "text"), F.lit(blocks)).alias("block"))

    def sketch(key, table):
        b = _Block(table, window, shards)
        combined = np.sort((b.shard.astype(U) << U(CELL_BITS)) | b.cell)
        if len(combined) > 2:  # a cell counts twice at most
            combined = combined[np.concatenate([[True, True], combined[2:] != combined[:-2]])]
        shard = (combined >> U(CELL_BITS)).astype(np.int64)
        return _table(_MSG, [(int(shard[lo]), key[0].as_py(), _pack(combined[lo:hi] & _LOW), None, None) for lo, hi in _parts(shard)])

    def merge(key, table):
        lists = [_unpack(x) for x in table.column("cells").to_pylist()]
        every = np.sort(np.concatenate(lists))
        repeated = np.unique(every[1:][every[1:] == every[:-1]])
        rows = []
        for block, cells in zip(table.column("block").to_pylist(), lists, strict=True):
            mine = np.unique(cells)
            if len(repeated):
                mine = mine[repeated[np.minimum(np.searchsorted(repeated, mine), len(repeated) - 1)] == mine]
                if len(mine):
                    rows.append((key[0].as_py(), block, _pack(mine.astype(U)), None, None))
        return _table(_MSG, rows)

    def entries(key, table, replies):
        if not len(table) or not len(replies):
            return _table(_MSG, [])
        b = _Block(table, window, shards)
        got = [(s << CELL_BITS) | _unpack(c).astype(np.int64) for s, c in zip(replies.column("shard").to_pylist(), replies.column("cells").to_pylist(), strict=True)]
        known = np.sort(np.concatenate(got))
        mine = (b.shard << CELL_BITS) | b.cell.astype(np.int64)
        keep = known[np.minimum(np.searchsorted(known, mine), len(known) - 1)] == mine
        idx, h2, new = b.exact(window, keep)
        idx, h2 = idx[new], h2[new]
        order = np.argsort(b.shard[idx], kind="stable")
        idx, h2 = idx[order], h2[order]
        cell, doc = b.cell[idx].astype(np.uint32), b.ids[b.words.doc[b.at[idx]]]
        return _table(_MSG, [(int(b.shard[idx[lo]]), key[0].as_py(), cell[lo:hi].tobytes(), h2[lo:hi].tobytes(), doc[lo:hi].tobytes()) for lo, hi in _parts(b.shard[idx])])

    def settle(key, table):
        blocks_of = table.column("block").to_pylist()
        read = lambda name, kind: [np.frombuffer(x, dtype=kind) for x in table.column(name).to_pylist()]
        cells, keys, docs_of = read("cells", np.uint32), read("keys", U), read("docs", np.int64)
        cell, h2, doc = np.concatenate(cells), np.concatenate(keys), np.concatenate(docs_of)
        order = np.lexsort((doc, h2, cell))
        new = np.ones(len(order), dtype=bool)
        c, k = cell[order], h2[order]
        new[1:] = (c[1:] != c[:-1]) | (k[1:] != k[:-1])
        least = np.empty(len(order), dtype=np.int64)
        least[order] = doc[order][np.flatnonzero(new)[np.cumsum(new) - 1]]
        gone, rows, lo = doc > least, [], 0
        for i, block in enumerate(blocks_of):
            hi = lo + len(cells[i])
            hit = gone[lo:hi]
            if hit.any():
                rows.append((key[0].as_py(), block, cells[i][hit].tobytes(), keys[i][hit].tobytes(), None))
            lo = hi
        return _table(_MSG, rows)

    def remove(key, table, replies):
        if not len(table):
            return _table(_OUT, [])
        b = _Block(table, window, shards)
        w, idx, h2, new = b.words, *b.exact(window)
        doc = w.doc[b.at[idx]]
        first = np.flatnonzero(new)[np.cumsum(new) - 1] if len(idx) else idx
        gone = b.ids[doc] > b.ids[doc[first]]
        if len(replies):
            keys = np.concatenate([np.frombuffer(x, dtype=U) for x in replies.column("keys").to_pylist()])
            cells = np.concatenate([np.frombuffer(x, dtype=np.uint32) for x in replies.column("cells").to_pylist()])
            order = np.argsort(keys)
            keys, cells = keys[order], cells[order]
            at = np.minimum(np.searchsorted(keys, h2), len(keys) - 1)
            gone |= (keys[at] == h2) & (cells[at] == b.cell[idx])
        cover = np.zeros(len(w.start) + 1, dtype=np.int32)
        starts = b.at[idx[gone]]
        np.add.at(cover, starts, 1)
        np.add.at(cover, starts + window, -1)
        stay = np.cumsum(cover[:-1]) == 0
        # the bytes of each word that stays and of the separator after it
        edge = np.zeros(len(w.buf) + 1, dtype=np.int8)
        edge[w.start[stay]] += 1
        edge[w.end[stay] + 1] -= 1
        mask = np.cumsum(edge[:-1], dtype=np.int8).view(bool)
        out = np.where(_words._SEP[w.buf], np.uint8(0x20), w.buf)[mask].tobytes()
        ends = np.concatenate([[0], np.cumsum(np.where(stay, w.end - w.start + 1, 0))])
        kept = np.concatenate([[0], np.cumsum(stay)])
        rows = []
        for i, doc_id in enumerate(b.raw_ids):
            lo, hi = w.first[i], w.first[i + 1]
            n = int(hi - lo)
            rows.append((doc_id, n, n - int(kept[hi] - kept[lo]), out[ends[lo] : max(ends[lo], ends[hi] - 1)].decode("utf-8", "replace")))
        return _table(_OUT, rows)

    cells = docs.groupBy("block").applyInArrow(sketch, _MSG_DDL)
    repeated = cells.groupBy("shard").applyInArrow(merge, _MSG_DDL)
    left = docs.groupBy("block").cogroup(repeated.groupBy("block")).applyInArrow(entries, _MSG_DDL)
    settled = left.groupBy("shard").applyInArrow(settle, _MSG_DDL)
    return docs.groupBy("block").cogroup(settled.groupBy("block")).applyInArrow(remove, "doc_id long, n_words long, n_removed long, kept_text string")
