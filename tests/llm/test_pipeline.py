"""The pipeline's stages, each against brute force on its own input."""

import os
import re
import time

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from heliograph.llm.mixing import mix_sources
from heliograph.llm.quality import score_documents
from heliograph.session import read_table
from tests.llm.test_near_dedup import brute as components_by_pairs
from tests.llm.test_quality import shuffle_files
from tests.llm.test_secrets import brute as secrets_by_rules

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


def test_stages(spark, tmp_path):
    docs = read_table(spark, SF, "documents").cache()
    columns, inputs, outputs = docs.columns, [], []
    for i, (_, stage) in enumerate(corpus_pipeline.STAGES):
        path = str(tmp_path / str(i))
        stage(spark, docs, SF).write.parquet(path)
        out = spark.read.parquet(path)
        inputs.append(docs)
        outputs.append(out)
        docs = out
    assert all(sorted(x.columns) == sorted(columns) for x in outputs[:-1]) and outputs[-1].columns == [*columns, "copy"]
    ids = lambda df: sorted(r.doc_id for r in df.select("doc_id").collect())

    assert ids(outputs[0]) == ids(score_documents(inputs[0], read_table(spark, SF, "labels")).where("keep"))
    rows = [(r.doc_id, r.text, 0, None) for r in inputs[1].collect()]
    assert ids(outputs[1]) == sorted(d for d, _, _, kept in components_by_pairs(rows)[0] if kept)
    items = [r.text for r in read_table(spark, SF, "benchmark").collect()]
    held = {r.doc_id for r in inputs[2].collect() if any(x in r.text for x in items)}
    kept = set(ids(outputs[2]))
    assert held and not held & kept and len(set(ids(inputs[2])) - kept) <= len(held) + 3
    before, after = ({r.doc_id: r for r in df.collect()} for df in (inputs[3], outputs[3]))
    assert before.keys() == after.keys()
    for d, r in after.items():
        if secrets_by_rules(before[d].text):
            assert not secrets_by_rules(r.text) and "[SECRET]" in r.text and r.n_chars == len(r.text)
    taken = {r.doc_id: r.copies for r in mix_sources(inputs[4]).collect()}
    assert {r.doc_id: r["count"] for r in outputs[4].groupBy("doc_id").count().collect()} == {d: n for d, n in taken.items() if n}


def test_run_and_no_unwanted_words(spark):
    out = corpus_pipeline.run(spark, SF)
    assert out.count() > 50
    assert out.where(F.col("text").rlike("(?i)token = \"[0-9a-f]{24}")).count() == 0
    assert re.fullmatch(r"\w+", corpus_pipeline.STAGES[0][0])


def test_stages_on_odd_rows(spark):
    """Nulls in every column, empty and very long texts, repeated rows, clashing names, and no rows at all."""
    docs = read_table(spark, SF, "documents")
    first = docs.orderBy("doc_id").first()
    odd = [
        (None, None, None, None, None), (10**6, None, "en", "src1", 0), (10**6 + 1, "", None, None, None), (10**6 + 2, " \n ", "en", None, 3), (None, first.text, first.lang, first.source, first.n_chars),
        (10**6 + 3, "word " * 60000, "xx", "src1", 300000), (10**6 + 3, "word " * 60000, "xx", "src1", 300000), (10**6 + 4, "a" * 300000, "en", "src2", 300000), (first.doc_id, first.text, first.lang, first.source, first.n_chars),
    ]
    rows = docs.unionByName(spark.createDataFrame(odd, docs.schema))
    clash = {c: F.lit(1) for c in ("copy", "__of", "__rate", "__was", "__gone", "__id", "__lang", "__mark", "key", "rep", "block", "n", "keep", "lang_")}
    for df in (rows, rows.withColumns(clash), rows.where("false")):
        for name, stage in corpus_pipeline.STAGES:
            out = stage(spark, df, SF)
            assert out.columns[: len(df.columns)] == df.columns, name
            got = out.collect()
            if name == "mix":
                continue
            ids = {r.doc_id for r in got}
            if df.columns == rows.columns and got:  # what has no words, or no id and no fault, stays
                assert {10**6, 10**6 + 1, 10**6 + 2} <= ids, name
                assert sum(r.doc_id is None and r.text is None for r in got) == 1, name


def test_near_dedup_leaves_no_shuffle_files(spark):
    """What its rounds have shuffled is removed; it would be many small files on many partitions."""
    docs, before = read_table(spark, SF, "documents"), shuffle_files(spark)
    out = corpus_pipeline.near_dedup(spark, docs, SF)
    for _ in range(50):  # they are removed in the background
        if left := shuffle_files(spark) - before:
            time.sleep(0.2)
    assert not left and 0 < out.count() < docs.count()
