"""Document fingerprints: a threshold-scaled sketch of shingle hashes.

A text's fingerprint has every hash of its distinct 5-word shingles that lies below 2**64 / scale, and its ``least`` least hashes, so
that short texts keep all. Both rules hold under union, so fingerprints of parts merge (``merge_fingerprints``). A fingerprint is complete up to a bound that
it shows itself: the greater one of the threshold and its hash number ``least`` (all, if it has fewer). Up to the lesser bound of two fingerprints both are
complete, and the share of the smaller one's hashes there that the other one has, their likeness, estimates containment, also between texts of very unequal length.

At SCALE 4 and LEAST 256, texts of up to 256 shingles, and pairs of them, have no error. Longer texts keep a quarter, 256 hashes at least: the standard error of a likeness p is
sqrt(p (1 - p) / hashes), 0.03 at most, and 0.007 for 20,000 words; a short text of n shingles against a long one is judged by some n / 4 of them (0, if none is below the bound).

``fingerprint_edits`` also compares each text with an edited one, whose last half comes from the next document by
descending id. The documents are dealt once, to ranges of ids of equal row counts (cuts in two levels, so that their number may grow
with the input: finding a row's range looks at some 2 * sqrt(ranges) cuts); each range also gets a copy of the
next range's first row, and is then read in order with one row of look-ahead. At ``scale=1`` every hash is kept.

Nulls: a null text is empty. Texts without words have the empty fingerprint; two of them have likeness 1,
one of them and another text 0. Rows without id come last in the order; rows of equal id are ordered by text. A single
document is its own next one. Empty tables give empty results. Other columns are ignored.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from heliograph.llm import _words
from heliograph.session import ensure_checkpoint_dir, ship_package

U = np.uint64
SCALE, LEAST = 4, 256  #: a quarter of all hashes, and the 256 least ones in any case; one place for all defaults, so that fingerprints merge by the rule that made them
FEW = 100_000  #: so many ranges' heads may be broadcast; more are joined by a shuffle


def sketch(raw: list[bytes], scale: int, shingle: int, least: int) -> tuple[np.ndarray, np.ndarray]:
    """(text, hash) of all texts' fingerprints, ordered."""
    doc, h = _words.shingles(_words.scan(raw), shingle)
    place = np.arange(len(doc)) - np.searchsorted(doc, doc)
    keep = (h <= U((1 << 64) // scale - 1)) | (place < least)
    return doc[keep], h[keep]


def bounds(a: tuple, n: int, scale: int, least: int) -> np.ndarray:
    """Up to which hash each of n fingerprints is complete."""
    first = np.searchsorted(a[0], np.arange(n + 1))
    out = np.full(n, (1 << 64) - 1, dtype=U)
    full = np.flatnonzero(np.diff(first) >= least)
    out[full] = np.maximum(a[1][first[full] + least - 1], U((1 << 64) // scale - 1))
    return out


def as_text(doc: np.ndarray, h: np.ndarray, n: int) -> list[str]:
    """Each text's hashes as 16 hexadecimal digits, ascending."""
    digits, end = h.astype(">u8").tobytes().hex(), 16 * np.searchsorted(doc, np.arange(n + 1))
    return [digits[a:b] for a, b in zip(end[:-1].tolist(), end[1:].tolist(), strict=True)]


def likeness(a: tuple, b: tuple, n: int, scale: int, least: int) -> np.ndarray:
    """Of the i-th fingerprint of a and the i-th of b, i below n."""
    empty = [np.bincount(x[0], minlength=n)[:n] == 0 for x in (a, b)]
    bound = np.minimum(bounds(a, n, scale, least), bounds(b, n, scale, least))
    a, b = ((x[0][k], x[1][k]) for x in (a, b) for k in [x[1] <= bound[x[0]]])
    sizes = [np.bincount(x[0], minlength=n)[:n] for x in (a, b)]
    doc, h = np.concatenate([a[0], b[0]]), np.concatenate([a[1], b[1]])
    order = np.lexsort((h, doc))
    doc, h = doc[order], h[order]
    same = (doc[1:] == doc[:-1]) & (h[1:] == h[:-1])
    both = np.bincount(doc[1:][same], minlength=n)[:n]
    fewer = np.minimum(*sizes)
    return np.where(fewer > 0, both / np.maximum(fewer, 1), (empty[0] & empty[1]).astype(float))


def merge_fingerprints(a: str, b: str, scale: int = SCALE, least: int = LEAST) -> str:
    """The fingerprint of both texts' shingles together."""
    every = sorted({x[i : i + 16] for x in (a, b) for i in range(0, len(x), 16)})
    return "".join(x for i, x in enumerate(every) if i < least or int(x, 16) < (1 << 64) // scale)


def fingerprints(documents: DataFrame, scale: int = SCALE, shingle: int = 5, least: int = LEAST) -> DataFrame:
    """doc_id and fingerprint of each row of documents(doc_id, text)."""
    ship_package(documents.sparkSession)

    def run(batches):
        for batch in batches:
            raw, out = _words.rows_of(batch, "text"), []
            for lo, hi in _words.slices([len(x) for x in raw]):
                out += as_text(*sketch(raw[lo:hi], scale, shingle, least), hi - lo)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(out, type=pa.string())], names=["doc_id", "fingerprint"])

    return documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, fingerprint string")


def with_next(documents: DataFrame, range_bytes: int = 16 << 20) -> DataFrame:
    """doc_id, text, range, extra: each range of ids in descending order, followed by the row that comes next.

    Partitioned by range and sorted; extra marks the row that stands only for what comes next.
    """
    spark = documents.sparkSession
    docs = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    ranges = 1 + int(size // range_bytes)
    docs, ranges = _ranged(docs, ranges)
    heads = docs.groupBy("range").agg(F.max("doc_id").alias("head")).checkpoint()  # a row a range
    few = heads.count()
    order = Window.orderBy("range")
    after = F.coalesce(F.lead(F.struct("head")).over(order), F.first(F.struct("head")).over(order))["head"]
    heads = heads.select(after.alias("head"), F.col("range").alias("before"))
    heads = F.broadcast(heads) if few <= FEW else heads
    docs = docs.join(heads, docs["doc_id"].eqNullSafe(heads["head"]), "left")
    own = F.struct(F.col("range"), F.lit(False).alias("extra"))
    more = F.struct(F.col("before").alias("range"), F.lit(True).alias("extra"))
    docs = docs.select("doc_id", "text", F.explode(F.when(F.col("before").isNull(), F.array(own)).otherwise(F.array(own, more))).alias("p"))
    docs = docs.select("doc_id", "text", F.col("p.range").alias("range"), F.col("p.extra").alias("extra"))
    return docs.repartitionByRange(few, "range").sortWithinPartitions("range", "extra", F.col("doc_id").desc_nulls_last(), "text")


def _ranged(docs: DataFrame, ranges: int) -> tuple[DataFrame, int]:
    """docs with the range of its id: descending, null ids in one of their own after all others."""
    wide = max(1, math.isqrt(ranges))
    fine = -(-ranges // wide)

    def cuts(n):  # n ranges' inner edges
        return F.percentile_approx("doc_id", [i / n for i in range(1, n)] or [0.5], 100_000)

    above = lambda c: F.size(F.filter(c, lambda x: x >= F.col("doc_id")))
    known = docs.select("doc_id").where("doc_id is not null")
    outer = sorted(set(known.agg(cuts(wide)).first()[0] or [])) if wide > 1 else []  # sqrt(ranges) numbers
    coarse = above(F.array(*[F.lit(int(c)).cast("long") for c in outer])) if outer else F.lit(0)
    docs = docs.withColumn("coarse", F.when(F.col("doc_id").isNull(), F.lit(wide)).otherwise(coarse))
    if fine == 1:
        return docs.withColumnRenamed("coarse", "range"), ranges
    inner = known.withColumn("coarse", coarse).groupBy("coarse").agg(F.array_distinct(cuts(fine)).alias("cuts"))
    docs = docs.join(F.broadcast(inner.checkpoint()), "coarse", "left")  # sqrt(ranges) rows of as many numbers
    place = F.col("coarse").cast("long") * fine + F.coalesce(F.when(F.col("doc_id").isNotNull(), above(F.col("cuts"))), F.lit(0))
    return docs.select("doc_id", "text", place.alias("range")), ranges


def fingerprint_edits(documents: DataFrame, scale: int = SCALE, shingle: int = 5, range_bytes: int = 16 << 20, least: int = LEAST) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next of each row.

    The edited text is the text with its last floor(n/2) code points replaced by the first as many (or
    all) of the next document's.
    """
    ship_package(documents.sparkSession)
    ensure_checkpoint_dir(documents.sparkSession)
    names = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]

    def compared(ids, texts, last_next):
        """Rows of ids[i], whose text is texts[i] and whose next text is texts[i + 1], or last_next for the last."""
        nexts = [*texts[1:], last_next]
        edited = [t[: len(t) - len(t) // 2] + x[: len(t) // 2] for t, x in zip(texts, nexts, strict=True)]
        raw, n = [e.encode() for e in edited], len(texts)
        doc, h = sketch([t.encode() for t in [*texts, last_next]], scale, shingle, least)
        own, after = doc < n, doc > 0
        changed = sketch(raw, scale, shingle, least)
        mine = (doc[own], h[own])
        cols = [
            pa.array(ids, type=pa.int64()),
            pa.array([len(t) for t in texts], type=pa.int64()),
            pa.array([hashlib.sha256(x).hexdigest() for x in raw]),
            pa.array(as_text(*mine, n), type=pa.string()),
            pa.array(as_text(*changed, n), type=pa.string()),
            pa.array(likeness(mine, changed, n, scale, least)),
            pa.array(likeness(mine, (doc[after] - 1, h[after]), n, scale, least)),
        ]
        return pa.RecordBatch.from_arrays(cols, names=names)

    def run(batches):
        ids, texts, size, place, done = [], [], 0, None, False
        for batch in batches:
            for doc_id, text, rng, extra in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "text", "range", "extra")), strict=True):
                if rng != place:
                    place, done = rng, False
                if done:
                    continue  # further rows of the next range's first id
                if texts and (extra or size > 2 << 20):
                    yield compared(ids, texts, text)
                    ids, texts, size = [], [], 0
                if extra:
                    done = True
                else:
                    ids.append(doc_id)
                    texts.append(text)
                    size += len(text)

    if documents.isEmpty():
        return documents.sparkSession.createDataFrame([], ", ".join(f"{n} {t}" for n, t in zip(names, ["long", "long", "string", "string", "string", "double", "double"], strict=True)))
    ordered = with_next(documents, range_bytes)
    return ordered.mapInArrow(run, "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")
