"""Byte-pair encoding and decoding of whole texts by a vocabulary with word ends.

A text is cut at special tokens; the rest is composed (NFC), its white space becomes single spaces, it is lower-cased character by
character and split into words. A word's UTF-8 bytes are its first symbols, the last one marked as the end of a word.

Symbols form a doubly linked list. A priority queue holds the merges that are possible, by rank, then by place; an entry is stale when its
left symbol is gone or the pair at its place would now give another symbol, and is then skipped. So a word of n bytes takes O(n log n), also
where a word has a million letters. Decoding concatenates the vocabulary's strings, with a space between them.

The vocabulary is a file of the driver, read there once and broadcast as it is (at most MOST_BYTES, or the call raises); tasks keep its tables
while their process lives. No row meets another one: there is no shuffle, and a lost task is just run again.

Null and empty texts give no ids and decode to the empty text. Repeated rows, null ids and ties are rows like others; empty tables give
empty results; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import heapq
import json
import re
import struct
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from heliograph.session import ship_package

MOST_BYTES = 64 << 20  #: so large may a vocabulary file be
KEPT_WORDS, KEPT_LENGTH = 1 << 18, 48  #: a task remembers the ids of up to twice so many words of up to so many characters; those met of late stay
FLUSH = 4 << 20  #: bytes of output from which a batch is handed on
#: How the one kind of vocabulary read here prepares its text.
NORMALIZERS = [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
#: The white space that the vocabulary's patterns mean (Unicode's White_Space).
SPACE = re.compile("[\t-\r \x85\xa0  -     　]+")


def byte_letters() -> list[str]:
    """The letter that stands for each byte: itself where it is printed, else the next one from U+0100 on."""
    printed = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = iter(range(0x100, 0x200))
    return [chr(b) if b in printed else chr(next(others)) for b in range(256)]


_assigned: set[str] = set()


def _odd(text: str) -> bool:
    """Whether a character has no category here: other versions of Unicode may know it, so the libraries in use may differ on it."""
    new = set(text) - _assigned
    good = {c for c in new if unicodedata.category(c) != "Cn"}
    _assigned.update(good)
    return len(good) < len(new)


class Vocabulary:
    """The tables of a vocabulary file, and the words met so far."""

    def __init__(self, raw: bytes):
        spec = json.loads(raw)
        model, pre, norm = spec["model"], spec["pre_tokenizer"] or {}, spec["normalizer"] or {}
        split, level = ([*pre.get("pretokenizers", []), {}, {}])[:2]
        plain = not any(model.get(k) for k in ("dropout", "unk_token", "continuing_subword_prefix", "fuse_unk", "byte_fallback", "ignore_merges"))
        known = (
            model.get("type") == "BPE" and plain and norm.get("normalizers") == NORMALIZERS and not spec.get("post_processor") and not spec.get("decoder")
            and split.get("pattern") == {"Regex": SPLIT} and split.get("behavior") == "Removed" and split.get("invert")
            and level.get("type") == "ByteLevel" and not level.get("add_prefix_space") and not level.get("use_regex")
            and not any(t[k] for t in spec["added_tokens"] for k in ("single_word", "lstrip", "rstrip", "normalized"))
        )
        if not known:
            raise ValueError("not a vocabulary of the kind that is encoded here: BPE with word ends over lower-case words of bytes")
        vocab, end = model["vocab"], model.get("end_of_word_suffix") or ""
        self.raw, self.end = raw, end
        self.inner = [vocab[x] for x in byte_letters()]
        self.last = [vocab[x + end] for x in byte_letters()]
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.strings = {i: t for t, i in vocab.items()} | {i: t for t, i in self.special.items()}
        pairs = (m.split(" ") if isinstance(m, str) else m for m in model["merges"])
        pairs = [(vocab[a], vocab[b], vocab[a + b]) for a, b in pairs]
        self.ranks = {(a, b): rank for rank, (a, b, _) in enumerate(pairs)}
        self.made = [new for _, _, new in pairs]  # by rank
        self.cut = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        self.words = regex.compile(SPLIT)
        self.known: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}

    @property
    @lru_cache(maxsize=1)
    def library(self):
        """The public library's own steps before the merges, for texts with characters on which versions of Unicode differ."""
        from tokenizers import Tokenizer

        return Tokenizer.from_buffer(self.raw)

    def merge(self, ids: list[int]) -> list[int]:
        """The symbols after all merges, the one of least rank first, of equal ones the first in place."""
        n, ranks, made = len(ids), self.ranks, self.made
        before, after = list(range(-1, n - 1)), [*range(1, n), -1]
        queue = [m * n + i for i, m in enumerate(map(ranks.get, zip(ids, ids[1:], strict=False))) if m is not None]  # rank and place in one number
        heapq.heapify(queue)
        while queue:
            m, i = divmod(heapq.heappop(queue), n)
            new, j = made[m], after[i]
            if ids[i] < 0 or j < 0:
                continue  # stale
            now = ranks.get((ids[i], ids[j]))
            if now != m and (now is None or made[now] != new):
                continue  # stale
            ids[i], ids[j] = new, -1
            k = after[i] = after[j]
            if k >= 0:
                before[k] = i
                m = ranks.get((new, ids[k]))
                if m is not None:
                    heapq.heappush(queue, m * n + i)
            h = before[i]
            if h >= 0:
                m = ranks.get((ids[h], new))
                if m is not None:
                    heapq.heappush(queue, m * n + h)
        return [x for x in ids if x >= 0]

    def word(self, word: str) -> bytes:
        """The ids of a word, as little-endian unsigned 32-bit integers."""
        out = self.older.get(word)
        if out is None:
            raw = word.encode()
            ids = self.merge([*map(self.inner.__getitem__, raw[:-1]), self.last[raw[-1]]])
            out = struct.pack(f"<{len(ids)}I", *ids)
        if len(word) <= KEPT_LENGTH:
            if len(self.known) >= KEPT_WORDS:
                self.known, self.older = {}, self.known
            self.known[word] = out
        return out

    def pieces(self, text: str) -> list[str]:
        """The words of a text without special tokens."""
        if not text.isascii() and _odd(text):
            text = self.library.normalizer.normalize_str(text)
            return [text[a:b] for _, (a, b) in self.library.pre_tokenizer.pre_tokenize_str(text)]
        text = SPACE.sub(" ", unicodedata.normalize("NFC", text)).replace("Σ", "σ").lower()  # the one letter that lower() writes by context
        return self.words.findall(text)

    def encode(self, text: str | None) -> bytes:
        """The ids of a text, as little-endian unsigned 32-bit integers."""
        out, word = [], self.word
        for k, part in enumerate(self.cut.split(text or "") if self.cut else [text or ""]):
            if k % 2:
                out.append(np.array([self.special[part]], dtype="<u4").tobytes())
            else:
                known = self.known  # may be set aside meanwhile, which costs a second look
                out += [known.get(w) or word(w) for w in self.pieces(part)]
        return b"".join(out)

    def decode(self, ids: bytes | None) -> str:
        """The vocabulary's strings of the ids, a space between them."""
        return " ".join(map(self.strings.__getitem__, np.frombuffer(ids or b"", dtype="<u4").tolist()))


@lru_cache(maxsize=2)
def vocabulary(raw: bytes) -> Vocabulary:
    return Vocabulary(raw)


def _each(df: DataFrame, path: str, key: str, source: str, schema: str, row, kinds) -> DataFrame:
    """key and row(vocabulary, value of source) of every row."""
    ship_package(df.sparkSession)
    with open(path, "rb") as f:
        raw = f.read(MOST_BYTES + 1)
    if len(raw) > MOST_BYTES:
        raise ValueError(f"a vocabulary file of more than {MOST_BYTES} bytes is not broadcast")
    Vocabulary(raw)  # a file of another kind fails here, not in the tasks
    shared = df.sparkSession.sparkContext.broadcast(raw)
    names = [c.strip().split(" ")[0] for c in schema.split(",")]

    def run(batches) -> Iterator[pa.RecordBatch]:
        v = vocabulary(shared.value)

        def batch(keys, rows):
            cols = [pa.array(c, type=t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)]
            return pa.RecordBatch.from_arrays([pa.array(keys, type=pa.int64()), *cols], names=["__key", *names])

        for b in batches:
            keys, rows, size = [], [], 0
            for k, x in zip(b.column("__key"), b.column("__from"), strict=True):  # value by value: a batch of long texts is not held twice
                keys.append(k.as_py())
                rows.append(row(v, x.as_py()))
                size += sum(len(c) for c in rows[-1] if not isinstance(c, int))
                if size > FLUSH:
                    yield batch(keys, rows)
                    keys, rows, size = [], [], 0
            if rows:
                yield batch(keys, rows)

    out = df.selectExpr(f"CAST(`{key}` AS BIGINT) AS __key", f"`{source}` AS __from").mapInArrow(run, "__key long, " + schema)
    return out.withColumnRenamed("__key", key)


def encode_texts(docs: DataFrame, path: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, n_tokens, ids (binary, little-endian unsigned 32-bit integers) of docs(key, text) by the vocabulary file."""

    def row(v: Vocabulary, x):
        ids = v.encode(x)
        return len(ids) // 4, ids

    return _each(docs, path, key, text, "n_tokens long, ids binary", row, [pa.int64(), pa.binary()])


def decode_ids(encoded: DataFrame, path: str, key: str = "doc_id", ids: str = "ids") -> DataFrame:
    """key, n_tokens, ids, decoded of encoded(key, ids). An id that the vocabulary lacks raises."""

    def row(v: Vocabulary, x):
        return len(x or b"") // 4, x or b"", v.decode(x)

    return _each(encoded, path, key, ids, "n_tokens long, ids binary, decoded string", row, [pa.int64(), pa.binary(), pa.string()])
