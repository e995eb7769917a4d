"""Manifests against a plain recursive one."""

import hashlib
import random
import zlib

import pytest

from heliograph.llm import merkle as M


def H(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf(row):
    return H(*("-" if v is None else f"{len(str(v).encode())}:{v}" for v in row))


def tree(nodes):
    """(top, for each node its levels' (left, right) siblings)."""
    proofs, owner = [[] for _ in nodes], [[i] for i in range(len(nodes))]
    while len(nodes) > 1:
        up, own = [], []
        for lo in range(0, len(nodes), 8):
            run = nodes[lo : lo + 8]
            for j, members in enumerate(owner[lo : lo + 8]):
                for i in members:
                    proofs[i].append((run[:j], run[j + 1 :]))
            up.append(H(*run))
            own.append([i for members in owner[lo : lo + 8] for i in members])
        nodes, owner = up, own
    return nodes[0], proofs


def brute(rows):
    """The query's rows for rows (doc_id, text, lang, source, n_chars)."""
    by = {}
    for doc_id, text, lang, source, n in rows:
        by.setdefault(lang, []).append((doc_id is not None, doc_id or 0, leaf((doc_id, source, lang, n, text)), (doc_id, source, lang, n, text)))
    langs = sorted(by, key=lambda x: (x is not None, (x or "").encode()))
    trees = {}
    for x in langs:
        by[x].sort(key=lambda r: r[:3])
        trees[x] = tree([r[2] for r in by[x]])
    root, above = tree([trees[x][0] for x in langs])
    out = []
    for x, over in zip(langs, above, strict=True):
        for (_, _, own, row), proof in zip(by[x], trees[x][1], strict=True):
            path = proof + over
            text = row[4]
            if row[0] is not None and zlib.crc32(str(row[0]).encode()) % 3 == 0 and text is not None:
                text = "".join(c.lower() if "A" <= c <= "Z" else c for c in text)
            node = leaf((*row[:4], text))
            for left, right in path:
                node = H(*left, node, *right)
            out.append((row[0], own, trees[x][0], root, H(*(d for pair in path for side in pair for d in side)), node, node == root))
    return sorted(out, key=str)


def check(spark, rows, most=M.LEVELS):
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    got = sorted(map(tuple, M.prove_documents(df, most).collect()), key=str)
    assert got == brute(rows)


def some(rnd, n, langs):
    return [(rnd.choice([i, i, i, 7, None]), rnd.choice(["Text One", "text", "", None, f"No. {i}"]), rnd.choice(langs), rnd.choice(["web", "", None, "wiki:x"]), rnd.choice([i, None])) for i in range(n)]


@pytest.mark.parametrize("n", [1, 2, 8, 9, 64, 65])
def test_small(spark, n):
    check(spark, some(random.Random(n), n, ["en"]))


@pytest.mark.parametrize("most", [1, 2])
def test_stored_levels_change_nothing(spark, most):
    """Many stored levels, groups of unlike heights, null and empty groups, more groups than a run holds."""
    rnd = random.Random(most)
    check(spark, some(rnd, 700, ["en"]) + some(rnd, 90, ["de", None, ""]) + some(rnd, 20, [f"l{i}" for i in range(15)] + ["é", "z"]), most)


def test_hot_group(spark):
    check(spark, some(random.Random(2), 2500, ["en", "en", "en", "en", "en", "fr"]))


def test_repeated_rows_and_many_groups(spark, monkeypatch):
    monkeypatch.setattr(M, "FEW", 0)
    check(spark, [(3, "Same", "en", "web", 4)] * 30 + [(i, "x", f"g{i}", "s", 1) for i in range(100)])


def test_proofs_lead_to_the_root(spark):
    rows = [(i, f"g{i % 3}", f"{i:064x}") for i in range(600)]
    m = M.manifest(spark.createDataFrame(rows, "doc_id long, key string, leaf string")).collect()
    assert len({r.root for r in m}) == 1 and len({r.subroot for r in m}) == 3
    assert all(M.fold(r.leaf, r.proof) == r.root for r in m)
    assert not any(M.fold(r.leaf[::-1], r.proof) == r.root for r in m if r.leaf != r.leaf[::-1])


def test_odd_tables(spark):
    df = spark.createDataFrame([(1, "q" * 3_000_000, "en", None, None, "x", "y")], "doc_id int, text string, lang string, source string, n_chars int, leaf string, key string")
    row = M.prove_documents(df).collect()[0]
    assert row.leaf == row.subroot == row.root == row.folded_root == leaf((1, None, "en", None, "q" * 3_000_000)) and row.proof_sha256 == H("")
    assert M.prove_documents(df.limit(0)).count() == 0


def test_query_against_sql(spark):
    import duckdb

    from heliograph.llm.queries import op13_merkle_manifest, oracle_sql

    for sf in ("/root/testdata/sf0.001", "/root/testdata/sf0.01"):
        con = duckdb.connect()
        con.execute(f"create view documents as select * from '{sf}/documents.parquet'")
        sql = con.execute(oracle_sql()["op13_merkle_manifest"])
        names = [d[0] for d in sql.description]
        got = sorted(tuple(r[c] for c in names) for r in op13_merkle_manifest(spark, sf).collect())
        assert got == sorted(sql.fetchall())
        assert 0 < sum(not r[-1] for r in got) < len(got)
