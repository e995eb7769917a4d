"""MinHash near-dedup with circulant permutations, banding and exact Jaccard verification.

Each text's set of distinct shingles (5 lower-cased words; a shorter text is one shingle) goes through
one initial permutation of a universe of 2**32 and a second one that is shifted circularly, by one place
for each coordinate, so two permutations give all ``bands * rows`` coordinates. Texts of equal sets are
one *representative* before banding. Members of a band's bucket are candidates; a pair counts only after its full sets
have been compared. Three kinds of rounds follow:

1. each document with the least of its buckets' leaders (a leader is a bucket's least id);
2. in buckets that still hold several components: each document with all of its leaders and with its neighbours, where
   a bucket is put in the order of the coordinates that follow its band;
3. last, exactly: in buckets that still hold several components, each member outside the bucket's most common component
   with all the others, block against block by long signatures (``LONG`` coordinates of 4 bits, made for these documents alone),
   each pair in the first bucket that it shares. Of the pairs that the signatures let through a document's ``k``
   likeliest are compared in full; links shrink what is left, and ``k`` grows until no pair was left out.

So every pair that meets in a bucket has been compared, or its two documents are in one component already, or the
signatures exclude it; and a group of n copies costs n pairs a round, however large, once it is linked. With 24 bands of 5
rows a pair of Jaccard 0.85 meets in at least one bucket with probability 1 - 8e-7, one of 0.9 with 1 - 3e-10. A
pair goes to the exact comparison unless its coordinates agree five standard deviations too
rarely (under about 0.69 of them for 0.85, under 0.80 of the long ones).

Each round is checkpointed and its shuffle files are removed: with the small files of tens of shuffles a run on many partitions would
take more disk than its data.

Nulls: a null or wordless text has an empty set and no links; a row without id takes no part in linking,
has component_id null and kept true. Rows of equal id count as one document when links are followed, each
with the n_shingles of its own text. Empty tables give empty results; other columns are ignored.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from heliograph.llm import _words
from heliograph.session import ensure_checkpoint_dir, ship_package, shuffles_removed

U, U32 = np.uint64, np.uint32
CHUNK = 1 << 15
LONG = 1024  #: coordinates of a long signature
BLOCK = 1024  #: members of a bucket on each side of a block of the exact pass
FEW = 1_000_000  #: so many ids or pairs (8 or 16 MB) may be broadcast; more are joined by a shuffle
ROWS = 50_000  #: of a narrow checkpointed frame in a partition


def _permute32(x: np.ndarray) -> np.ndarray:
    """A fixed permutation of the integers below 2**32, in place."""
    x ^= x >> U32(16)
    x *= U32(0x7FEB352D)
    x ^= x >> U32(15)
    x *= U32(0x846CA68B)
    x ^= x >> U32(16)
    return x


def signatures(doc: np.ndarray, h: np.ndarray, n_docs: int, size: int) -> np.ndarray:
    """The circulant MinHash of each text: n_docs x size. doc is sorted; texts without shingles get the maximum."""
    sig = np.full((n_docs, size), np.iinfo(U32).max, dtype=U32)
    place = (_words.mix(h, 11) >> U(32)).astype(U32)  # the initial permutation
    for lo in range(0, len(h), CHUNK):
        p, d = place[lo : lo + CHUNK], doc[lo : lo + CHUNK]
        edge = np.concatenate([[0], np.flatnonzero(np.diff(d)) + 1])
        rows = d[edge]
        for k in range(size):  # the second one, shifted by k
            sig[rows, k] = np.minimum(sig[rows, k], np.minimum.reduceat(_permute32(p + U32(k)), edge))
    return sig


def _bucket_keys(sig: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """Each text's bucket in each band."""
    keys = np.zeros((len(sig), bands), dtype=U)
    for r in range(rows):
        keys = _words.mix(keys * _words._BASE + sig[:, r : bands * rows : rows].astype(U), 3)
    return _words.mix(keys + np.arange(bands, dtype=U), 5)


def _long_batches(bands: int, rows: int, k: int):
    """rep, sig: a long signature, two coordinates a byte; marks: 32 bits of each of the text's buckets."""

    def run(batches):
        for batch in batches:
            ids, raw = batch.column("doc_id"), _words.rows_of(batch, "text")
            for lo, hi in _words.slices([len(x) for x in raw]):
                doc, h = _words.shingles(_words.scan(raw[lo:hi], lower=True), k)
                sig = signatures(doc, h, hi - lo, LONG)
                marks = _bucket_keys(sig, bands, rows).astype(U32)
                pairs = ((sig[:, 0::2] & U32(15)) << U32(4) | sig[:, 1::2] & U32(15)).astype(np.uint8)
                cols = [ids.slice(lo, hi - lo), *(pa.array([x.tobytes() for x in a], type=pa.binary()) for a in (pairs, marks))]
                yield pa.RecordBatch.from_arrays(cols, names=["rep", "sig", "marks"])

    return run


def _sketch_batches(bands: int, rows: int, k: int):
    def run(batches):
        for batch in batches:
            ids, raw = batch.column("doc_id"), _words.rows_of(batch, "text")
            for lo, hi in _words.slices([len(x) for x in raw]):
                doc, h = _words.shingles(_words.scan(raw[lo:hi], lower=True), k)
                n = np.bincount(doc, minlength=hi - lo)
                sig = signatures(doc, h, hi - lo, bands * rows)
                keys = _bucket_keys(sig, bands, rows)
                sums = [np.zeros(hi - lo, dtype=U) for _ in range(2)]
                full = n > 0
                if len(h):
                    at = np.concatenate([[0], np.cumsum(n[full])[:-1]])
                    for s, x in enumerate(sums):
                        x[full] = np.add.reduceat(_words.mix(h, 21 + s), at)
                flat = pa.array(keys.reshape(-1).view(np.int64))
                yield pa.RecordBatch.from_arrays(
                    [
                        ids.slice(lo, hi - lo),
                        pa.array(n, type=pa.int64()),
                        pa.array(sums[0].view(np.int64)),
                        pa.array(sums[1].view(np.int64)),
                        pa.array([x.tobytes() for x in sig.astype(np.uint8)], type=pa.binary()),
                        pa.ListArray.from_arrays(pa.array(np.arange(hi - lo + 1, dtype=np.int32) * bands), flat),
                    ],
                    names=["doc_id", "n", "d1", "d2", "sig", "bands"],
                )

    return run


def _set_batches(k: int):
    def run(batches):
        for batch in batches:
            ids, raw = batch.column("doc_id"), _words.rows_of(batch, "text")
            for lo, hi in _words.slices([len(x) for x in raw]):
                doc, h = _words.shingles(_words.scan(raw[lo:hi], lower=True), k)
                end = np.cumsum(np.bincount(doc, minlength=hi - lo))
                sets = [h[a:b].tobytes() for a, b in zip(np.concatenate([[0], end[:-1]]), end, strict=True)]
                yield pa.RecordBatch.from_arrays([ids.slice(lo, hi - lo), pa.array(sets, type=pa.large_binary()).cast(pa.binary())], names=["doc_id", "grams"])

    return run


def _alike_batches(least: float):
    """Keeps pairs whose signatures (a byte each coordinate) agree often enough to be compared in full."""

    def run(batches):
        for batch in batches:
            if not len(batch):
                continue
            read = lambda c, b=batch: np.frombuffer(b"".join(b.column(c).to_pylist()), dtype=np.uint8).reshape(len(b), -1)
            yield batch.filter(pa.array((read("sig_a") == read("sig_b")).mean(axis=1) >= least)).select(["a", "b"])

    return run


def _confirm_batches(percent: int):
    """Keeps pairs with 100 * intersection >= percent * union of their full sets."""

    def run(batches):
        for batch in batches:
            ok = []
            for x, y in zip(batch.column("set_a"), batch.column("set_b"), strict=True):
                a, b = (np.frombuffer(v.as_buffer(), dtype=U) for v in (x, y))
                both = len(np.intersect1d(a, b, assume_unique=True))
                ok.append(100 * both >= percent * (len(a) + len(b) - both))
            yield batch.filter(pa.array(ok, type=pa.bool_())).select(["a", "b"])

    return run


def _kept(df: DataFrame) -> tuple[DataFrame, int]:
    """df checkpointed, in a number of partitions that suits its rows, and its count."""
    df = df.checkpoint()
    n = df.count()
    return df.coalesce(1 + n // ROWS), n


def _small(df: DataFrame, n: int) -> DataFrame:
    """df of n rows, marked for broadcast if they are few."""
    return F.broadcast(df) if n <= FEW else df


def components(edges: DataFrame) -> DataFrame:
    """node, component (its least reachable node) of the nodes in edges(a, b), by alternating star contraction.

    Each step is a grouped minimum and a join, twice; a checkpoint after it keeps the lineage short. It ends when the edges
    are stars around the least nodes, after a number of steps that grows with the logarithm of the longest chain.
    """
    e, n = _kept(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct())
    while True:
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.where("v > u").join(_small(least, 2 * n), "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(_small(least, n), "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        e, n = _kept(small.unionByName(least.select("u", F.col("m").alias("v"))).distinct())
        # stars: no node has two others above it, and none that stands above another has one above itself
        ends = e.select(F.col("u").alias("node"), F.lit(1).alias("below"), F.lit(0).alias("above")).unionByName(e.select(F.col("v").alias("node"), F.lit(0).alias("below"), F.lit(1).alias("above")))
        if ends.groupBy("node").agg(F.sum("below").alias("below"), F.max("above").alias("above")).where("below + above > 1").isEmpty():
            return e.select(F.col("u").alias("node"), F.col("v").alias("component"))


def joined_components(comp: DataFrame, links: DataFrame) -> DataFrame:
    """The components of comp(node, component) after new links(a, b): only the components' least nodes are linked anew."""
    of = lambda name: comp.select(F.col("node").alias(name), F.col("component").alias("c" + name))
    between = links.join(of("a"), "a", "left").join(of("b"), "b", "left").select(F.coalesce("ca", "a").alias("a"), F.coalesce("cb", "b").alias("b"))
    new = components(between)
    moved = comp.join(new.select(F.col("node").alias("component"), F.col("component").alias("to")), "component", "left").select("node", F.coalesce("to", "component").alias("component"))
    return _kept(moved.unionByName(new.join(comp, "node", "left_anti").select("node", "component")))[0]


def _adjacent_batches(percent: int):
    """Pairs of consecutive rows of one bucket, of alike size and different components."""

    def run(batches):
        last = None
        for batch in batches:
            if not len(batch):
                continue
            key, rep, n, c = (batch.column(x).to_numpy() for x in ("key", "rep", "n", "comp"))
            if last is not None:
                key, rep, n, c = (np.concatenate([[x], y]) for x, y in zip(last, (key, rep, n, c), strict=True))
            last = key[-1], rep[-1], n[-1], c[-1]
            ok = (key[1:] == key[:-1]) & (c[1:] != c[:-1]) & (100 * np.minimum(n[1:], n[:-1]) >= percent * np.maximum(n[1:], n[:-1]))
            a, b = rep[:-1][ok], rep[1:][ok]
            yield pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))], names=["a", "b"])

    return run


def _with_component(left: DataFrame, comp: DataFrame | None) -> DataFrame:
    """rep, n, band, key, comp: the members of buckets with their components so far."""
    rest = left.select("rep", "n", "band", "key")
    if comp is None:
        return rest.withColumn("comp", F.col("rep"))
    return rest.join(comp.select(F.col("node").alias("rep"), "component"), "rep", "left").select("rep", "n", "band", "key", F.coalesce("component", "rep").alias("comp"))


def _block_batches(percent: int, least: float, k: int):
    """row, a, b, agree, cut: of each outsider its k likeliest partners in its block, if of another component, alike in size and
    signature, and in no earlier bucket together.

    Reads the outsiders of a block first (every false), then the members that they are held against.
    """

    def run(batches):
        place, own, fresh = None, [], True
        for batch in batches:
            if not len(batch):
                continue
            key, i, j, every, band, rep, n, c = (batch.column(x).to_numpy(zero_copy_only=False) for x in ("key", "i", "j", "every", "band", "rep", "n", "comp"))
            sig, marks = (np.frombuffer(b"".join(batch.column(x).to_pylist()), dtype=t).reshape(len(batch), -1) for x, t in (("sig", np.uint8), ("marks", U32)))
            edge = np.flatnonzero((key[1:] != key[:-1]) | (i[1:] != i[:-1]) | (j[1:] != j[:-1]) | (every[1:] != every[:-1])) + 1
            out = []
            for lo, hi in zip([0, *edge.tolist()], [*edge.tolist(), len(batch)], strict=True):
                now = key[lo], i[lo], j[lo]
                if now != place:
                    place, own, fresh = now, [], True
                part = rep[lo:hi], n[lo:hi], c[lo:hi], sig[lo:hi], marks[lo:hi]
                if not every[lo]:
                    own.append(part)
                    continue
                if not own:
                    continue
                if fresh:
                    own, fresh = [tuple(np.concatenate(x) for x in zip(*own, strict=True))], False
                r, m, d, s, f = own[0]
                for at in range(0, len(r), 256):
                    to = slice(at, at + 256)
                    ok = (d[to, None] != part[2]) & (100 * np.minimum(m[to, None], part[1]) >= percent * np.maximum(m[to, None], part[1]))
                    x, y = np.nonzero(ok)
                    agree = np.zeros(ok.shape, dtype=np.int32)
                    for q in range(0, len(x), 1 << 14):
                        xq, yq = x[q : q + (1 << 14)], y[q : q + (1 << 14)]
                        first = (f[at + xq] == part[4][yq]).argmax(axis=1) == band[lo]
                        xq, yq = xq[first], yq[first]
                        differ = s[at + xq] ^ part[3][yq]
                        agree[xq, yq] = (differ & 15 == 0).sum(axis=1) + (differ < 16).sum(axis=1)
                    agree[agree < least * 2 * s.shape[1]] = 0
                    for u in np.flatnonzero(agree.any(axis=1)).tolist():
                        v = np.flatnonzero(agree[u])
                        cut = len(v) > k
                        if cut:
                            v = v[np.argsort(-agree[u, v], kind="stable")[:k]]
                        out.append((np.full(len(v), r[at + u]), part[0][v], agree[u, v], np.full(len(v), cut)))
            if out:
                row, other, agree, cut = (np.concatenate(x) for x in zip(*out, strict=True))
                cols = [row, np.minimum(row, other), np.maximum(row, other), agree.astype(np.int32), cut]
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in cols], names=["row", "a", "b", "agree", "cut"])

    return run


def _untied(left: DataFrame, long: DataFrame, comp: DataFrame | None, percent: int, k: int) -> DataFrame:
    """row, a, b, cut: the k likeliest partners of each document in another component of one of its buckets; cut where it has more.

    Of two members of different components one at least is outside the bucket's most common component, so only outsiders
    are held against all members. Both sides are dealt into blocks, so that a large bucket spreads over tasks. A
    bucket of two needs no look: its leader's round has had the pair.
    """
    same = percent / 100 + (1 - percent / 100) / 16  # 4 bits agree by chance too
    least = same - 5 * math.sqrt(same * (1 - same) / LONG)
    rest = _with_component(left, comp)
    kinds = rest.groupBy("key", "comp").agg(F.count("*").alias("m")).groupBy("key")
    kinds = kinds.agg(F.sum("m").alias("size"), F.max(F.struct("m", "comp")).alias("top"), F.count("*").alias("kinds")).where("kinds > 1 and size > 2")
    blocks = lambda rows: F.ceil(rows / F.lit(BLOCK)).cast("int")
    kinds = kinds.select("key", F.col("top.comp").alias("most"), blocks(F.col("size")).alias("nj"), blocks(F.col("size") - F.col("top.m")).alias("ni"))
    rest = rest.join(kinds, "key").join(long, "rep")
    deal = lambda n: F.pmod(F.xxhash64("rep"), F.col(n)).cast("int")
    upto = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    cols = ["key", "i", "j", "every", "band", "rep", "n", "comp", "sig", "marks"]
    own = rest.where("comp <> most").withColumn("i", deal("ni")).withColumn("j", upto("nj")).withColumn("every", F.lit(False)).select(cols)
    every = rest.withColumn("j", deal("nj")).withColumn("i", upto("ni")).withColumn("every", F.lit(True)).select(cols)
    dealt = own.unionByName(every).repartition("key", "i", "j").sortWithinPartitions("key", "i", "j", "every")
    found = dealt.mapInArrow(_block_batches(percent, least, k), "row long, a long, b long, agree int, cut boolean")
    found = found.groupBy("row", "a", "b").agg(F.max("agree").alias("agree"), F.max("cut").alias("cut"))
    w = Window.partitionBy("row").orderBy(F.desc("agree"), "a", "b")
    found = found.withColumn("place", F.row_number().over(w)).where(F.col("place") <= k + 1)
    return found.select("row", "a", "b", (F.col("cut") | (F.col("place") > k)).alias("cut"))


def _leaders_and_neighbours(left: DataFrame, sig: DataFrame, comp: DataFrame | None, percent: int, size: int, rows: int) -> tuple[DataFrame, DataFrame]:
    """(members of buckets that hold several components, pairs there of each with its leader and its neighbours).

    A bucket is ordered by the coordinates that follow its band, so neighbours agree longest. The order is
    global and dealt by range: a large bucket spreads over tasks.
    """
    rest = _with_component(left, comp)
    mixed = rest.groupBy("key").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi"), F.min(F.struct("rep", "n", "comp")).alias("lead")).where("lo < hi").select("key", "lead")
    rest, _ = _kept(rest.join(mixed, "key"))
    lead = rest.where("comp <> lead.comp").where(100 * F.least("n", "lead.n") >= percent * F.greatest("n", "lead.n")).select(F.col("lead.rep").alias("a"), F.col("rep").alias("b"))
    at = F.pmod((F.col("band") + 1) * rows, F.lit(size))
    turned = F.concat(F.substring("sig", at + 1, F.lit(24)), F.substring("sig", F.lit(1), F.lit(24)))
    ordered = rest.join(sig, "rep").select("key", F.substring(turned, 1, 24).alias("order"), "rep", "n", "comp")
    pairs = ordered.repartitionByRange("key", "order").sortWithinPartitions("key", "order", "rep").mapInArrow(_adjacent_batches(percent), "a long, b long")
    return rest.select("rep", "n", "band", "key"), pairs.unionByName(lead).distinct()


def _mixed(left: DataFrame, comp: DataFrame | None) -> DataFrame:
    """The members of buckets of three or more that hold several components."""
    keys = _with_component(left, comp).groupBy("key").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi"), F.count("*").alias("size")).where("lo < hi and size > 2")
    return _kept(left.join(keys.select("key"), "key").select("rep", "n", "band", "key"))[0]


def _linked(pairs: DataFrame, many: int, docs: DataFrame, sig: DataFrame, least: float, percent: int, shingle: int) -> DataFrame | None:
    """Those of pairs(a, b), of which there are so many, whose full sets are alike enough; None without any."""
    if not many:
        return None
    of = lambda name: sig.select(F.col("rep").alias(name), F.col("sig").alias("sig_" + name))
    near, many = _kept(of("b").join(_small(of("a").join(_small(pairs, many), "a"), 40 * many), "b").mapInArrow(_alike_batches(least), "a long, b long").distinct())
    if not many:
        return None
    ids, few = _kept(near.select(F.explode(F.array("a", "b")).alias("doc_id")).distinct())
    sets = docs.join(_small(ids, few), "doc_id", "left_semi").mapInArrow(_set_batches(shingle), "doc_id long, grams binary").dropDuplicates(["doc_id", "grams"]).checkpoint()
    of = lambda name: sets.select(F.col("doc_id").alias(name), F.col("grams").alias("set_" + name))
    found, many = _kept(of("b").join(_small(near, many), "b").join(of("a"), "a").mapInArrow(_confirm_batches(percent), "a long, b long").distinct())
    return found if many else None


def _linked_classes(docs: DataFrame, percent: int, bands: int, rows: int, shingle: int) -> tuple[DataFrame, DataFrame, DataFrame | None]:
    """The sketches of docs(doc_id, text), the classes of equal sets, and the components of the classes that have links."""
    least = percent / 100 - 5 * math.sqrt(percent / 100 * (1 - percent / 100) / (bands * rows))
    sketch = docs.mapInArrow(_sketch_batches(bands, rows, shingle), "doc_id long, n long, d1 long, d2 long, sig binary, bands array<long>").checkpoint()
    classes = sketch.where("doc_id is not null and n > 0").groupBy("d1", "d2").agg(F.min("doc_id").alias("rep"), F.first("n").alias("n"), F.first("sig").alias("sig"), F.first("bands").alias("bands")).checkpoint()
    sig = classes.select("rep", "sig")
    members = classes.select("rep", "n", F.posexplode("bands").alias("band", "key"))
    lead = members.groupBy("key").agg(F.count("*").alias("size"), F.min(F.struct("rep", "n")).alias("lead")).where("size > 1").select("key", "lead")
    left, _ = _kept(members.join(lead, "key"))
    pairs = left.where("rep > lead.rep").where(100 * F.least("n", "lead.n") >= percent * F.greatest("n", "lead.n"))
    tested, many = _kept(pairs.groupBy(F.col("rep").alias("b")).agg(F.min("lead.rep").alias("a")).select("a", "b"))
    links = _linked(tested, many, docs, sig, least, percent, shingle)
    # so far each has one link at most, to a leader of less id: that serves as its component in the second round
    left, pairs = _leaders_and_neighbours(left, sig, None if links is None else links.select(F.col("b").alias("node"), F.col("a").alias("component")), percent, bands * rows, rows)
    pairs, many = _kept(pairs.join(_small(tested, many), ["a", "b"], "left_anti"))
    tested = tested.unionByName(pairs)
    more = _linked(pairs, many, docs, sig, least, percent, shingle)
    links = links if more is None else more if links is None else links.unionByName(more)
    comp = None if links is None else components(links)
    left, k, cut = _mixed(left, comp), 512, True
    ids, few = _kept(left.select(F.col("rep").alias("doc_id")).distinct())
    long = docs.join(_small(ids, few), "doc_id", "left_semi").mapInArrow(_long_batches(bands, rows, shingle), "rep long, sig binary, marks binary").dropDuplicates(["rep", "sig"]).checkpoint()
    while cut and few:
        some, _ = _kept(_untied(left, long, comp, percent, k))
        cut = bool(some.agg(F.max("cut")).first()[0])
        pairs, many = _kept(some.select("a", "b").distinct().join(tested, ["a", "b"], "left_anti"))
        more = _linked(pairs, many, docs, sig, least, percent, shingle)
        if more is None:
            k *= 8
        else:
            comp = components(more) if comp is None else joined_components(comp, more)
        tested = tested.unionByName(pairs)
    return sketch, classes, comp  # every pair of different components that meets in a bucket has been compared


def near_duplicates(documents: DataFrame, percent: int = 85, bands: int = 24, rows: int = 5, shingle: int = 5) -> DataFrame:
    """doc_id, n_shingles, component_id, kept of each row of documents(doc_id, text).

    Links join documents with 100 * |intersection| >= percent * |union| of their shingle sets.
    """
    spark = documents.sparkSession
    ship_package(spark)
    ensure_checkpoint_dir(spark)
    docs = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    with shuffles_removed(spark):
        sketch, classes, comp = _linked_classes(docs, percent, bands, rows, shingle)
    out = sketch.select("doc_id", F.col("n").alias("n_shingles"), "d1", "d2")
    out = out.join(classes.select("d1", "d2", "rep", F.lit(True).alias("linked")), ["d1", "d2"], "left")
    if comp is None:
        out = out.withColumn("component", F.lit(None).cast("long"))
    else:
        out = out.join(comp.select(F.col("node").alias("rep"), "component"), "rep", "left")
    part = F.col("doc_id").isNotNull() & (F.col("n_shingles") > 0)
    component = F.when(part, F.coalesce("component", "rep")).otherwise(F.col("doc_id"))
    return out.select("doc_id", "n_shingles", component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"))
