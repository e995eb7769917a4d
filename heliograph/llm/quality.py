"""Quality classifier: an interpolated modified Kneser-Ney n-gram model of trusted text, scored by sharded count joins.

Trusted documents are those whose labels all say quality 1 and none says toxic (null as 0). Half of them (by a hash of the id) are
for training, whole, so the counts grow with the input; the other half, whole, sets the thresholds.

The work is dealt to *blocks* of documents (about ``block_bytes`` of text each) and to *shards* of the n-gram hash space, both in
proportion to the text. A block sends each shard one message a level: the sorted hashes of its distinct n-grams there, with
counts. So a frequent n-gram is one entry per block however often it stands, and there is no hot key.

1. *Counts.* From the highest order down, a shard adds up the blocks' counts of each n-gram and makes the first block that has it
   its owner. Owners tell the next lower level what they own: one kind more for the n-gram's last words (the continuation
   counts of Kneser-Ney), and its adjusted count for its context. So each n-gram's shard ends up with its adjusted count and,
   of the n-grams that continue it, the sum of counts and how many have count 1, 2 and 3 or more. Counts of counts
   (a row a level) give Chen and Goodman's three discounts per order.
2. *Scores.* Blocks of all documents ask the shards for what they know of their n-grams: words and pairs first, then longer ones
   where both shorter ones in it are known (no other can be). The replies give every word's probability. The blocks take
   turns, a ``TURNS``-th of them each, and a turn's shuffles are removed when its scores stand: the texts, questions and
   replies of all blocks at once would take three times the input on disk. Each turn reads the documents and the model again.

No model is collected or broadcast. On the driver there are only six sums per level. Messages are packed (sorted hashes as
compressed differences); there are at most as many as there are distinct n-grams in the blocks, so they grow with the text.

A document's score is its mean negative log-likelihood per word (natural log), drawn towards its language's mean by
``prior_words`` words so that short texts are not judged by a few; perplexity is its exponential. The threshold is the
``quantile`` of the held-out trusted documents' scores in the same language (``percentile_approx`` with accuracy 100000), over all
languages where a language has none. A document above it is rejected. Words and n-grams are known by 64-bit hashes; a score depends
on its document alone, not on the block that it is in.

Nulls: a null or wordless text has score null and is kept; null languages are a language of their own; unlabelled documents
are scored like others, rows without id too. Without trusted text nothing is rejected. Repeated labels of one id must agree on 1.
Empty tables give empty results. Other columns are ignored by ``score_documents`` and passed on by ``keep_quality``.
"""

from __future__ import annotations

import struct

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from heliograph.llm import _words
from heliograph.session import ensure_checkpoint_dir, ship_package, shuffles_removed, unused

U = np.uint64
CELL_BITS = 40  #: of an n-gram's hash, within its shard
TURNS = 4  #: in which all blocks are scored, one after the other
FEW_IDS = 1_000_000  #: so many ids (some 20 MB) may be broadcast; more are joined by a shuffle
WORD = r"[^\x20\x09-\x0D]+"
_MSG = [("n", pa.int32()), ("shard", pa.int64()), ("block", pa.int64()), ("cells", pa.binary()), ("vals", pa.binary()), ("sums", pa.list_(pa.int64()))]
_MSG_DDL = "n int, shard long, block long, cells binary, vals binary, sums array<long>"
FIELDS = 5  #: of a known n-gram: adjusted count; as a context: sum of counts, n-grams of count 1, 2, 3 or more


def put(numbers: np.ndarray) -> bytes:
    """Whole numbers as compressed planes of bytes: zeros and small numbers take almost no room."""
    planes = np.ascontiguousarray(numbers, dtype="<u8").reshape(-1).view(np.uint8).reshape(-1, 8).T.tobytes()
    return struct.pack("<q", len(planes)) + pa.compress(planes, codec="zstd", asbytes=True)


def get(data: bytes) -> np.ndarray:
    (n,) = struct.unpack_from("<q", data)
    planes = pa.decompress(memoryview(data)[8:], n, codec="zstd", asbytes=True)
    return np.frombuffer(planes, dtype=np.uint8).reshape(8, -1).T.copy().view("<u8").reshape(-1)


def put_sorted(cells: np.ndarray) -> bytes:
    return put(np.diff(cells, prepend=U(0)))


def get_sorted(data: bytes) -> np.ndarray:
    return np.cumsum(get(data), dtype=U)


def _rows(rows: list[tuple]) -> pa.Table:
    cols = list(zip(*rows, strict=True)) or [[] for _ in _MSG]
    return pa.table({n: pa.array(c, type=t) for (n, t), c in zip(_MSG, cols, strict=True)})


def _share(column: str, salt: str):
    """A number in [0, 1) of the column by hash."""
    return F.pmod(F.xxhash64(F.col(column), F.lit(salt)), F.lit(1 << 30)) / F.lit(float(1 << 30))


def trusted_ids(labels: DataFrame) -> DataFrame:
    """doc_id, held_out of the trusted documents of labels(doc_id, quality, toxic)."""
    said = lambda c: F.coalesce(c, F.lit(0))
    good = labels.where("doc_id is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.min(said("quality")).alias("q"), F.max(said("toxic")).alias("t")).where("q = 1 and t = 0")
    return good.select("doc_id", (_share("doc_id", "fold") < 0.5).alias("held_out"))


def _few(ids: DataFrame) -> DataFrame:
    """ids, marked for broadcast if a count finds them few."""
    ids = ids.checkpoint()
    return F.broadcast(ids) if ids.count() <= FEW_IDS else ids


class Grams:
    """The n-grams of a block's texts, by level: where each starts, and its shard and cell as one number."""

    def __init__(self, raw: list[bytes], order: int, shards: int):
        words = _words.scan(raw, lower=True)
        self.first, self.at, self.code = words.first, [], []
        for n in range(1, order + 1):
            at, h = _words.windows(words, n)
            self.at.append(at.astype(np.int32))
            self.code.append(((h >> U(CELL_BITS)) % U(shards)) << U(CELL_BITS) | h & U((1 << CELL_BITS) - 1))

    def of(self, n: int, starts: np.ndarray) -> np.ndarray:
        """Positions, among the n-grams, of those that start at the given words."""
        return np.searchsorted(self.at[n - 1], starts)


def _by_shard(n: int, block: int, codes: np.ndarray, values: np.ndarray | None = None) -> list[tuple]:
    """Messages of sorted distinct codes to their shards; values has a row a field."""
    shard = (codes >> U(CELL_BITS)).astype(np.int64)
    edge = np.concatenate([[0], np.flatnonzero(np.diff(shard)) + 1, [len(shard)]]) if len(shard) else [0]
    low = codes & U((1 << CELL_BITS) - 1)
    return [(n, int(shard[a]), block, put_sorted(low[a:b]), None if values is None else put(values[:, a:b]), None) for a, b in zip(edge[:-1], edge[1:], strict=True)]


def _in_order(replies: pa.Table, n: int) -> list[dict]:
    """A level's replies by shard: the order in which a block's codes were sent."""
    return sorted((r for r in replies.to_pylist() if r["n"] == n), key=lambda r: r["shard"])


def model_rows(texts: DataFrame, order: int, shards: int, blocks: int) -> DataFrame:
    """n, shard, cells, vals (FIELDS rows), sums (n-grams, their counts' sum, counts of counts 1 to 4) of texts(doc_id, text)."""
    docs = texts.select("text", F.pmod(F.xxhash64("doc_id", "text"), F.lit(blocks)).alias("block"))

    def highest(key, table):
        g = Grams(_words.rows_of(table, "text"), order, shards)
        codes, count = np.unique(g.code[-1], return_counts=True)
        values = np.zeros((FIELDS, len(codes)), dtype=U)
        values[0] = count
        return _rows(_by_shard(order, key[0].as_py(), codes, values))

    def lower(n):
        def run(key, table, replies):
            if not len(table):
                return _rows([])
            g = Grams(_words.rows_of(table, "text"), n + 1, shards)
            _, first = np.unique(g.code[n], return_index=True)
            parts = [get(r["vals"]) for r in _in_order(replies, n + 1)]
            a = np.concatenate([np.zeros(0, dtype=U), *parts]).astype(np.int64)  # what the block owns, 0 elsewhere
            start, a = g.at[n][first[a > 0]], a[a > 0]
            codes, inverse = np.unique(g.code[n - 1], return_inverse=True)
            context, suffix = inverse[g.of(n, start)], inverse[g.of(n, start + 1)]
            count = lambda of, w=None: np.bincount(of, weights=w, minlength=len(codes)).astype(U)
            values = np.stack([count(suffix), count(context, a), count(context[a == 1]), count(context[a == 2]), count(context[a > 2])])
            return _rows(_by_shard(n, key[0].as_py(), codes, values))

        return run

    def merge(key, table):
        rows = sorted(table.to_pylist(), key=lambda r: r["block"])
        lists = [get_sorted(r["cells"]) for r in rows]
        cells, values = np.concatenate(lists), np.concatenate([get(r["vals"]).reshape(FIELDS, -1) for r in rows], axis=1)
        by = np.argsort(cells, kind="stable")  # equal cells by block: the first one owns
        new = np.flatnonzero(np.concatenate([[True], np.diff(cells[by]) > 0]))
        values = np.add.reduceat(values[:, by], new, axis=1)
        values[0] = a = np.maximum(values[0], U(1))
        owned, at, out = np.zeros(len(cells), dtype=U), 0, []
        owned[by[new]] = a
        n, shard = key[0].as_py(), key[1].as_py()
        for r, x in zip(rows, lists, strict=True):
            out.append((n, shard, r["block"], None, put(owned[at : at + len(x)]), None))
            at += len(x)
        sums = [len(a), int(a.sum()), *(int((a == k).sum()) for k in (1, 2, 3, 4))]
        return _rows([*out, (n, shard, None, put_sorted(cells[by[new]]), put(values), sums)])

    sent, levels = docs.groupBy("block").applyInArrow(highest, _MSG_DDL), []
    for n in range(order, 0, -1):
        merged = sent.groupBy("n", "shard").applyInArrow(merge, _MSG_DDL)
        levels.append(merged.where("block is null"))
        if n > 1:
            replies = merged.where("block is not null").select("n", "shard", "block", "vals")
            sent = docs.groupBy("block").cogroup(replies.groupBy("block")).applyInArrow(lower(n - 1), _MSG_DDL)
    out = levels[0]
    for x in levels[1:]:
        out = out.unionByName(x)
    return out.select("n", "shard", "cells", "vals", "sums")


class Rates:
    """Discounts of each order, and the floor under single words, from the levels' sums."""

    def __init__(self, sums: dict[int, list[int]], order: int):
        self.discount = np.zeros((order + 1, 4))
        for n in range(1, order + 1):
            t1, t2, t3, t4 = (max(1, x) for x in sums[n][2:])
            y = t1 / (t1 + 2 * t2)
            self.discount[n, 1:] = [min(max(x, 0.05), k) for k, x in enumerate((1 - 2 * y * t2 / t1, 2 - 3 * y * t3 / t2, 3 - 4 * y * t4 / t3), 1)]
        kinds, total, t1, t2 = sums[1][:4]
        self.words = np.array([[0], [total], [t1], [t2], [kinds - t1 - t2]], dtype=float)  # all words, as the empty context
        self.unseen = 1 / (1 + kinds)

    def rest(self, n: int, known: np.ndarray) -> np.ndarray:
        """What each known n-gram, as a context, leaves to the lower order; 1 for unknown ones. n is the order of what follows."""
        held = (self.discount[n, 1:, None] * known[2:]).sum(axis=0)
        return np.where(known[1] > 0, held / np.maximum(known[1], 1), 1.0)

    def own(self, n: int, known: np.ndarray) -> np.ndarray:
        """Each known n-gram's count less its discount."""
        return np.maximum(known[0] - self.discount[n][np.minimum(known[0], 3).astype(np.int64)], 0.0)


def _known(g: Grams, replies: pa.Table, upto: int):
    """Of each level up to upto: (codes asked, for each n-gram its place in what is known, FIELDS rows of that).

    The first place stands for all that is unknown. The last level's replies need not be there yet.
    """
    out, seen = [], None
    for n in range(1, upto + 1):
        code = g.code[n - 1]
        may = np.ones(len(code), dtype=bool)
        if n > 2:
            start = g.at[n - 1]
            may = seen[g.of(n - 1, start)] & seen[g.of(n - 1, start + 1)]
        codes, inverse = np.unique(code[may], return_inverse=True)
        place, parts, lo, have = np.zeros(len(codes), dtype=np.int32), [np.zeros((FIELDS, 1))], 0, 1
        for r in _in_order(replies, n) if replies is not None else ():
            size = r["sums"][0]
            hit = lo + np.flatnonzero(np.unpackbits(np.frombuffer(r["cells"], dtype=np.uint8), count=size))
            place[hit] = np.arange(have, have + len(hit))
            parts.append(get(r["vals"]).reshape(FIELDS, -1).astype(float))
            lo, have = lo + size, have + len(hit)
        where = np.zeros(len(code), dtype=np.int32)
        where[may] = place[inverse]
        seen = where > 0
        out.append((codes, where, np.concatenate(parts, axis=1)))
    return out


def _answer(key, asked, model):
    """What a shard knows of each block's n-grams: a bit for each, and FIELDS rows of those known."""
    if not len(asked) or not len(model):
        n, shard = key[0].as_py(), key[1].as_py()
        empty = [(r["block"], len(get(r["cells"]))) for r in asked.to_pylist()]
        return _rows([(n, shard, b, np.packbits(np.zeros(m, dtype=bool)).tobytes(), put(np.zeros(0)), [m]) for b, m in empty])
    (m,) = model.to_pylist()
    cells, vals = get_sorted(m["cells"]), get(m["vals"]).reshape(FIELDS, -1)
    out = []
    for block, data in zip(asked.column("block").to_pylist(), asked.column("cells"), strict=True):
        q = get_sorted(data.as_py())
        at = np.minimum(np.searchsorted(cells, q), len(cells) - 1)
        hit = cells[at] == q
        out.append((m["n"], m["shard"], block, np.packbits(hit).tobytes(), put(vals[:, at[hit]]), [len(q)]))
    return _rows(out)


def scored_by(documents: DataFrame, model: DataFrame, rates: Rates, order: int, shards: int, blocks: int, turn: int, turns: int) -> DataFrame:
    """doc_id, lang, mark, nll (a sum), n_words of the rows of documents(doc_id, text, lang) whose turn it is, by joins with model_rows."""
    docs = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("lang").cast("string").alias("lang"), "text", mark(documents).alias("mark"), F.pmod(F.xxhash64("doc_id", "text"), F.lit(blocks)).alias("block"))
    docs = docs.where(F.col("block") % turns == turn)

    def ask(n):
        def run(key, table, replies=None):
            if not len(table):
                return _rows([])
            g = Grams(_words.rows_of(table, "text"), n, shards)
            levels = _known(g, replies, n)
            return _rows([r for k in ((1, 2) if n == 2 else (n,)) for r in _by_shard(k, key[0].as_py(), levels[k - 1][0])])

        return run

    def score(key, table, replies):
        raw = _words.rows_of(table, "text")
        if not raw:
            nll, words = np.zeros(0), np.zeros(0, dtype=np.int64)
        else:
            g = Grams(raw, order, shards)
            words, p, before = np.diff(g.first), np.zeros(0), None
            for n, (_, where, known) in enumerate(_known(g, replies, order), 1):
                own = rates.own(n, known)[where]
                if n == 1:
                    p = own / max(1.0, rates.words[1, 0]) + rates.rest(1, rates.words) * rates.unseen
                else:  # the n-gram at a word ends n - 1 words later
                    start = g.at[n - 1]
                    context, end = before[0][g.of(n - 1, start)], start + (n - 1)
                    p[end] = own / np.maximum(before[1], 1)[context] + before[2][context] * p[end]
                before = where, known[1], rates.rest(n + 1, known) if n < order else None
            nll = np.zeros(len(raw))
            full = np.flatnonzero(words)
            if len(full):
                nll[full] = np.add.reduceat(-np.log(np.maximum(p, 1e-12)), g.first[full])
        return pa.table({"doc_id": table.column("doc_id"), "lang": table.column("lang"), "mark": table.column("mark"), "nll": pa.array(nll), "n_words": pa.array(words)})

    of = lambda asked: asked.groupBy("n", "shard").cogroup(model.groupBy("n", "shard")).applyInArrow(_answer, _MSG_DDL)
    replies = of(docs.groupBy("block").applyInArrow(lambda key, table: ask(2)(key, table), _MSG_DDL))
    for n in range(3, order + 1):
        replies = replies.unionByName(of(docs.groupBy("block").cogroup(replies.groupBy("block")).applyInArrow(ask(n), _MSG_DDL)))
    return docs.groupBy("block").cogroup(replies.groupBy("block")).applyInArrow(score, "doc_id long, lang string, mark long, nll double, n_words long")


def mark(documents: DataFrame):
    """A hash of a row's text, which tells rows of one id apart."""
    return F.xxhash64(documents["text"], F.length(documents["text"]))


def scores(documents: DataFrame, labels: DataFrame, order: int, block_bytes: int) -> DataFrame | None:
    """scored_by a model of the trusted training documents; None without trusted text."""
    if order < 2:
        raise ValueError("the order of the model is 2 at least")
    ids = _few(trusted_ids(labels).where("not held_out").select("doc_id"))
    texts = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(ids, "doc_id", "left_semi")
    size = texts.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    shards, blocks = 1 + int(size // block_bytes), 1 + int(size // block_bytes)
    model = model_rows(texts, order, shards, blocks).checkpoint()
    sums = {r["n"]: [int(x) for x in r[1:]] for r in model.groupBy("n").agg(*[F.sum(F.element_at("sums", k)) for k in range(1, 7)]).collect()}  # a row a level
    if not sums:
        return None
    for n in range(1, order + 1):
        sums.setdefault(n, [0] * 6)
    every = documents.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks, out = 1 + int(every // block_bytes), None
    turns = min(TURNS, blocks)
    for turn in range(turns):
        part = scored_by(documents, model.select("n", "shard", "cells", "vals"), Rates(sums, order), order, shards, blocks, turn, turns).checkpoint()
        out = part if out is None else out.unionByName(part)
    return out


def _mean(mu, prior_words: float):
    return (F.col("nll") + F.lit(prior_words) * mu) / (F.col("n_words") + F.lit(prior_words))


def thresholds(scored: DataFrame, labels: DataFrame, quantile: float, prior_words: float) -> DataFrame:
    """lang, mu, threshold from the held-out trusted rows of scored; a last row, with every true, for all languages."""
    held = scored.where("n_words > 0").join(_few(trusted_ids(labels).where("held_out").select("doc_id")), "doc_id", "left_semi")
    held = held.select("lang", "nll", "n_words").checkpoint()
    mu = held.groupBy("lang").agg((F.sum("nll") / F.sum("n_words")).alias("mu"))
    rows = held.withColumnRenamed("lang", "l").join(mu, F.col("l").eqNullSafe(F.col("lang")))
    rows = rows.select("lang", "mu", _mean(F.col("mu"), prior_words).alias("score"))
    cut = F.percentile_approx("score", quantile, 100_000).alias("threshold")
    own = rows.groupBy("lang").agg(F.first("mu").alias("mu"), cut).withColumn("every", F.lit(False))
    return own.unionByName(rows.agg(F.lit(None).cast("string").alias("lang"), F.avg("mu").alias("mu"), cut).withColumn("every", F.lit(True)))


def _judged(scored: DataFrame, cuts: DataFrame, prior_words: float) -> DataFrame:
    """scored with perplexity, threshold and keep. cuts: a row per language with trusted text, checkpointed, counted before a broadcast."""
    every = cuts.where("every").first()  # one row
    mu0, t0 = (F.lit(every[k]).cast("double") for k in ("mu", "threshold"))
    own = cuts.where("not every").select(F.col("lang").alias("of"), "mu", "threshold")
    with shuffles_removed(scored.sparkSession):
        few = own.count() <= 100_000
    own = F.broadcast(own) if few else own
    out = scored.join(own, scored["lang"].eqNullSafe(own["of"]), "left")
    score = F.when(F.col("n_words") > 0, _mean(F.coalesce("mu", mu0), prior_words))
    top = F.coalesce("threshold", t0)
    return out.select(*scored.columns, F.exp(score).alias("perplexity"), F.exp(top).alias("threshold"), F.coalesce(score <= top, F.lit(True)).alias("keep"))


def _verdicts(documents: DataFrame, labels: DataFrame, order: int, quantile: float, prior_words: float, block_bytes: int) -> DataFrame | None:
    ship_package(documents.sparkSession)
    ensure_checkpoint_dir(documents.sparkSession)
    with shuffles_removed(documents.sparkSession):
        scored = scores(documents, labels, order, block_bytes)
        cuts = None if scored is None else thresholds(scored, labels, quantile, prior_words).checkpoint()
    return None if scored is None else _judged(scored, cuts, prior_words)


def score_documents(documents: DataFrame, labels: DataFrame, order: int = 3, quantile: float = 0.995, prior_words: float = 40.0, block_bytes: int = 6 << 20) -> DataFrame:
    """doc_id, lang, n_words, perplexity, threshold, keep of each row of documents(doc_id, text, lang)."""
    out = _verdicts(documents, labels, order, quantile, prior_words, block_bytes)
    if out is None:
        none = F.lit(None).cast("double")
        words = F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long")
        return documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("lang").cast("string").alias("lang"), words.alias("n_words"), none.alias("perplexity"), none.alias("threshold"), F.lit(True).alias("keep"))
    return out.select("doc_id", "lang", "n_words", "perplexity", "threshold", "keep")


def keep_quality(documents: DataFrame, labels: DataFrame, order: int = 3, quantile: float = 0.995, prior_words: float = 40.0, block_bytes: int = 6 << 20) -> DataFrame:
    """The rows of documents that the classifier keeps, with all their columns."""
    out = _verdicts(documents, labels, order, quantile, prior_words, block_bytes)
    if out is None:
        return documents
    names = [unused(documents, x) for x in ("__id", "__lang", "__mark")]
    with shuffles_removed(documents.sparkSession):
        gone = _few(out.where("not keep").select(*[F.col(c).alias(n) for c, n in zip(("doc_id", "lang", "mark"), names, strict=True)]).distinct())
    same = documents["doc_id"].cast("long").eqNullSafe(F.col(names[0])) & documents["lang"].cast("string").eqNullSafe(F.col(names[1])) & (mark(documents) == F.col(names[2]))
    return documents.join(gone, same, "left_anti")
