"""A Merkle manifest of a dataset: a digest per row, per group and for the whole, and a proof per row.

Rows are leaves; within a group (``lang``) they stand by id, and every FAN consecutive nodes of a level become one of the next, until one is left, the
group's subroot. The subroots, by group, are the leaves of a last tree, whose top is the root.

Checkpoint and recompute: a level is persisted (by ``checkpoint``, in the cluster's shared folder) only every LEVELS levels, so FAN ** LEVELS leaves of an aligned
subtree make one stored node. Proofs are extracted from the top down: a task takes one aligned subtree's stored nodes, regenerates the levels between
them and the next stored one, gives each node its siblings and, behind them, the proof of the subtree itself, and forgets the levels. It never holds more than one such subtree.

Texts are hashed where they are read and never move; what is shuffled are ids and digests. Places in a group come from a range sort, so a group
with most rows spreads over all tasks. Any lost task recomputes from the last stored level.

Rows of null id stand first in their group; equal ids stand by leaf, so repeated rows are neighbours and any order of them gives the same digests. Null groups
are one group, the first. An empty table has no root and gives no rows. Other columns are ignored unless they are named in ``carry``.
"""

from __future__ import annotations

import hashlib

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StringType

from heliograph.operators.edits import ranked
from heliograph.session import ensure_checkpoint_dir, ship_package

FAN = 8  #: nodes that become one
LEVELS = 3  #: levels between two that are persisted
FEW = 100_000  #: so many groups may be broadcast; more are joined by a shuffle
C = F.col
NODES = "key string, idx long, total long, digest string"


def leaf(*columns: Column) -> Column:
    """The digest of a row: each value as its UTF-8 bytes' number, ``:`` and itself, or ``-`` where it is null."""
    one = lambda c: F.coalesce(F.concat(F.octet_length(c.cast("string")).cast("string"), F.lit(":"), c.cast("string")), F.lit("-"))
    return F.sha2(F.concat(*map(one, columns)), 256)


def group_key(group: Column) -> Column:
    """A key that orders groups with null first and is never null."""
    return F.coalesce(F.concat(F.lit("="), group.cast("string")), F.lit(""))


def digest(parts: list[str]) -> str:
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def levels(nodes: list[str], whole: bool, most: int = LEVELS) -> list[list[str]]:
    """The nodes and the levels above them up to the next stored one; the top, if these are all nodes of their tree, ends it."""
    out = [nodes]
    for _ in range(most):
        if whole and len(out[-1]) == 1:
            break
        out.append([digest(out[-1][i : i + FAN]) for i in range(0, len(out[-1]), FAN)])
    return out


def siblings(above: list[list[str]], i: int) -> list[str]:
    """``left:right`` of node i's run at each level, itself left out."""
    out = []
    for level in above[:-1]:
        lo = i // FAN * FAN
        out.append("".join(level[lo:i]) + ":" + "".join(level[i + 1 : lo + FAN]))
        i //= FAN
    return out


def fold(node: str, proof: str) -> str:
    """The root that a leaf and its proof lead to."""
    for pair in filter(None, proof.split(",")):
        left, right = pair.split(":")
        node = digest([left, node, right])
    return node


def _place(rows: DataFrame, *order: Column) -> DataFrame:
    """rows(key, ...) with idx, from 0 on within the key, and total, the number of the key's rows."""
    r = ranked(rows, C("key"), *order)
    keys = r.groupBy("key").agg(F.min("rank").alias("__from"), F.count("*").alias("total")).checkpoint()
    few = keys.count() <= FEW
    return r.join(F.broadcast(keys) if few else keys, "key").withColumn("idx", C("rank") - C("__from")).drop("rank", "__from")


def _block(most: int) -> Column:
    return F.expr(f"idx div {FAN**most}").alias("block")


def _grow(most: int):
    def run(key, table):
        """One stored node of an aligned subtree."""
        total = table.column("total")[0].as_py()
        nodes = [d for _, d in sorted(zip(table.column("idx").to_pylist(), table.column("digest").to_pylist(), strict=True))]
        top = levels(nodes, total <= FAN**most, most)[-1][0]
        return pa.table({"key": [key[0].as_py()], "idx": [key[1].as_py()], "total": [-(-total // FAN**most)], "digest": [top]})

    return run


def _strata(nodes: DataFrame, most: int) -> tuple[list[DataFrame], DataFrame]:
    """The stored levels of each key's tree, the given one first, and the top of each: key, digest."""
    strata, tops = [nodes], None
    while True:
        up = strata[-1].groupBy("key", _block(most)).applyInArrow(_grow(most), NODES).checkpoint()
        done = up.where("total = 1").select("key", "digest")
        tops = done if tops is None else tops.unionByName(done)
        more = up.where("total > 1")
        if more.isEmpty():
            return strata, tops
        strata.append(more)


def _prove(keep: list[str], schema: pa.Schema, most: int):
    def run(key, nodes, above):
        """Siblings of each node of an aligned subtree, up to the root."""
        if not nodes.num_rows:
            return schema.empty_table()
        order = sorted(range(nodes.num_rows), key=nodes.column("idx").to_pylist().__getitem__)
        nodes = nodes.take(order)
        tree = levels(nodes.column("digest").to_pylist(), nodes.column("total")[0].as_py() <= FAN**most, most)
        one = above.to_pylist()[0]
        rest = [one["proof"]] if one["proof"] else []
        cols = {c: nodes.column(c) for c in keep}
        n = nodes.num_rows
        cols |= {"proof": [",".join(siblings(tree, i) + rest) for i in range(n)], "subroot": [one["subroot"]] * n, "root": [one["root"]] * n}
        return pa.table(cols).cast(schema)

    return run


def _proofs(strata: list[DataFrame], tops: DataFrame, carry: list[str], most: int) -> DataFrame:
    """key, idx, digest, carried columns, proof, subroot, root of the nodes of the first level; tops(key, proof, subroot, root) are those of whole trees."""
    above = None
    for k in range(len(strata) - 1, -1, -1):
        nodes, names = strata[k], ["key", "idx", "digest", *(carry if k == 0 else [])]
        ends = nodes.where(f"total <= {FAN**most} AND idx = 0").select("key", F.lit(0).cast("long").alias("block")).join(tops, "key")
        above = ends if above is None else ends.unionByName(above.select("key", C("idx").alias("block"), "proof", "subroot", "root"))
        kept = nodes.select(*names).schema
        ddl = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept) + ", proof string, subroot string, root string"
        out = to_arrow_schema(kept.add("proof", "string").add("subroot", "string").add("root", "string"))
        above = above.select(C("key").alias("of"), C("block").alias("at"), "proof", "subroot", "root")  # columns of their own, as both sides come from one table
        above = nodes.withColumn("block", _block(most)).groupBy("key", "block").cogroup(above.groupBy("of", "at")).applyInArrow(_prove(names, out, most), ddl)
        if k:
            above = above.checkpoint()
    return above


def manifest(leaves: DataFrame, carry: tuple[str, ...] = (), most: int = LEVELS) -> DataFrame:
    """doc_id, group key, leaf, proof, subroot, root and carried columns of leaves(doc_id, key, leaf): see ``leaf`` and ``group_key``.

    A proof is, level by level, the digests left of the node, ``:`` and those right of it, in its run; levels are joined by commas.
    ``most``: levels between two that are persisted.
    """
    ship_package(leaves.sparkSession)
    ensure_checkpoint_dir(leaves.sparkSession)
    rows = leaves.select("doc_id", "key", C("leaf").alias("digest"), *carry)
    strata, tops = _strata(_place(rows, C("doc_id").asc_nulls_first(), C("digest")), most)
    groups = _place(tops.select(F.lit("").alias("key"), C("key").alias("group"), "digest"), C("group"))
    upper, root = _strata(groups, most)
    named = _proofs(upper, root.select("key", F.lit("").alias("proof"), C("digest").alias("subroot"), C("digest").alias("root")), ["group"], most)
    tops = named.select(C("group").alias("key"), "proof", C("digest").alias("subroot"), "root").checkpoint()
    out = _proofs(strata, tops, ["doc_id", *carry], most)
    return out.select("doc_id", "key", C("digest").alias("leaf"), "proof", "subroot", "root", *carry)


@F.pandas_udf(StringType())
def folded(node: pd.Series, proof: pd.Series) -> pd.Series:
    """The root that each leaf and proof lead to."""
    return pd.Series(list(map(fold, node, proof)), dtype=object)


def proof_digest(proof: Column) -> Column:
    return F.sha2(F.translate(proof, ":,", ""), 256)


def prove_documents(docs: DataFrame, most: int = LEVELS) -> DataFrame:
    """Leaf, roots and proof of docs(doc_id, source, lang, n_chars, text), and whether each row still leads to the root after some were tampered with.

    Where 3 divides the checksum of the id, the tampered row's text has its A-Z in lower case. A row without id isn't tampered with.
    """
    own = lambda text: leaf(C("doc_id"), C("source"), C("lang"), C("n_chars"), text)
    lower = F.translate("text", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    hit = (F.crc32(C("doc_id").cast("string")) % 3 == 0) & (lower != C("text"))
    rows = docs.select(C("doc_id").cast("long").alias("doc_id"), group_key(C("lang")).alias("key"), own(C("text")).alias("leaf"), F.when(hit, own(lower)).alias("claim"))
    m = manifest(rows, ("claim",), most).withColumn("folded_root", folded(F.coalesce("claim", "leaf"), "proof"))
    return m.select("doc_id", "leaf", "subroot", "root", proof_digest(C("proof")).alias("proof_sha256"), "folded_root", (C("folded_root") == C("root")).alias("verified"))


def _tree_sql(name: str, nodes: str, depth: int) -> str:
    """Levels of DuckDB views over nodes(k, i, h): name0 .. name<depth>, and name<l>_runs with the digests of each run."""
    out = [f"{name}0 AS ({nodes})"]
    for level in range(depth):
        t = f"{name}{level}"
        out.append(f"{t}_runs AS (SELECT k, i // {FAN} AS i, list(h ORDER BY i) AS run, sum(count(*)) OVER (PARTITION BY k) AS total FROM {t} GROUP BY k, i // {FAN})")
        out.append(f"{name}{level + 1} AS (SELECT k, i, CASE WHEN total = 1 THEN run[1] ELSE sha256(array_to_string(run, '')) END AS h FROM {t}_runs)")
    return ",\n".join(out)


def _walk_sql(tree: str, rows: str, depth: int) -> tuple[list[str], str]:
    """Steps that add each level's siblings to proof and fold them into h and f, for rows(k, i, h, f, proof, ...)."""
    out, at = [], rows
    for level in range(depth):
        at, before = f"{rows}_{level}", at
        left, right = f"array_to_string(run[1:s.i % {FAN}], '')", f"array_to_string(run[s.i % {FAN} + 2:], '')"
        step = lambda h: f"CASE WHEN total = 1 THEN {h} ELSE sha256({left} || {h} || {right}) END AS {h}"  # noqa: B023, E731
        out.append(f"{at} AS (SELECT s.* EXCLUDE (i, h, f, proof), s.i // {FAN} AS i, {step('h')}, {step('f')}, proof || CASE WHEN total = 1 THEN '' ELSE {left} || {right} END AS proof"
                   f" FROM {before} s JOIN {tree}{level}_runs r ON r.k = s.k AND r.i = s.i // {FAN})")  # fmt: skip
    return out, at


def manifest_sql(depth: int = 9, groups_depth: int = 4) -> str:
    """The same for DuckDB, for groups of up to 8 ** depth rows."""
    one = lambda c: f"coalesce(octet_length(encode({c}::VARCHAR)) || ':' || {c}::VARCHAR, '-')"
    leaf_of = lambda text: f"sha256({' || '.join(map(one, ('doc_id', 'source', 'lang', 'n_chars')))} || {one(text)})"
    crc = """xor(4294967295::UBIGINT, list_reduce(list_transform(range(1, length(doc_id::VARCHAR) + 1), lambda j: ascii(substr(doc_id::VARCHAR, j, 1))::UBIGINT), lambda c, b:
      list_reduce(range(8)::UBIGINT[], lambda d, j: CASE WHEN d & 1 = 1 THEN xor(d >> 1, 3988292384::UBIGINT) ELSE d >> 1 END, xor(c, b)), 4294967295::UBIGINT))"""
    lower = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    up, a = _walk_sql("t", "docs", depth)
    over, b = _walk_sql("g", "groups", groups_depth)
    parts = [
        f"leaves AS (SELECT doc_id, coalesce('=' || lang, '') AS k, {leaf_of('text')} AS leaf, CASE WHEN {crc} % 3 = 0 THEN {leaf_of(lower)} ELSE {leaf_of('text')} END AS claim FROM documents)",
        "placed AS (SELECT *, row_number() OVER (PARTITION BY k ORDER BY doc_id NULLS FIRST, leaf) - 1 AS i FROM leaves)",
        _tree_sql("t", "SELECT k, i, leaf AS h FROM placed", depth),
        f"subroots AS (SELECT k, h, row_number() OVER (ORDER BY k) - 1 AS i FROM t{depth})",
        _tree_sql("g", "SELECT 0 AS k, i, h FROM subroots", groups_depth),
        "docs AS (SELECT doc_id, leaf, k, i, leaf AS h, claim AS f, '' AS proof FROM placed)",
        *up,
        f"groups AS (SELECT doc_id, leaf, d.h AS subroot, 0 AS k, s.i, d.h, d.f, proof FROM {a} d JOIN subroots s ON s.k = d.k)",
        *over,
    ]
    return "WITH " + ",\n".join(parts) + f"\nSELECT doc_id, leaf, subroot, h AS root, sha256(proof) AS proof_sha256, f AS folded_root, f = h AS verified FROM {b}"
