import math
import random
import time
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql.classic.dataframe import DataFrame

from heliograph.llm.quality import get, get_sorted, keep_quality, put, put_sorted, score_documents, scores, trusted_ids
from heliograph.session import ensure_checkpoint_dir

DOCS, LABELS = "doc_id long, text string, lang string, quality string", "doc_id long, quality int, toxic int, lang int"


def made(seed=6, n=600):
    r = random.Random(seed)
    words = {lang: [lang + str(i) for i in range(150)] for lang in ("en", "de")}
    docs, labels = [], []
    for d in range(n):
        lang = "en" if d % 3 else "de"
        if d % 10 == 9:
            text = " ".join(["zz%d" % r.randrange(10**6) for _ in range(60)] if d % 20 == 9 else ["!!" + r.choice(words[lang]) for _ in range(60)])
        else:
            text = " ".join(words[lang][min(149, int(r.expovariate(0.06)))] for _ in range(r.randrange(20, 150)))
        docs.append((d, text, lang, None))
        if d % 2 == 0 or d % 10 == 9:
            labels.append((d, int(d % 10 != 9), 0, None))
    docs += [(9000, None, "en", None), (9001, "", None, None), (9002, "en1 en2 en3", None, None), (None, "en1 en2", "xx", None)]
    return docs, labels + [(7, 1, 0, None), (7, 0, 0, None), (None, 1, None, None), (8, None, 0, None)]


def model_by_hand(texts, order):
    """Interpolated modified Kneser-Ney by dictionaries."""
    grams = [Counter() for _ in range(order + 1)]
    for t in texts:
        w = t.lower().split()
        for n in range(1, order + 1):
            grams[n].update(tuple(w[i : i + n]) for i in range(len(w) - n + 1))
    adj = [None] * (order + 1)
    for n in range(1, order + 1):
        adj[n] = dict(grams[n])
        if n < order:
            kinds = Counter(g[1:] for g in grams[n + 1])
            adj[n] = {g: kinds.get(g, 1) for g in grams[n]}
    disc, ctx = [None] * (order + 1), [None] * (order + 1)
    for n in range(1, order + 1):
        t = [max(1, sum(c == k for c in adj[n].values())) for k in (1, 2, 3, 4)]
        y = t[0] / (t[0] + 2 * t[1])
        disc[n] = [min(max(x, 0.05), k) for k, x in enumerate((1 - 2 * y * t[1] / t[0], 2 - 3 * y * t[2] / t[1], 3 - 4 * y * t[3] / t[2]), 1)]
        ctx[n] = defaultdict(lambda: [0, 0.0])
        for g, c in adj[n].items():
            ctx[n][g[:-1]][0] += c
            ctx[n][g[:-1]][1] += disc[n][min(c, 3) - 1]

    def p(g):
        n = len(g)
        low = p(g[1:]) if n > 1 else 1 / (1 + len(adj[1]))
        total, held = ctx[n].get(g[:-1], (0, 0.0))
        if not total:
            return low
        c = adj[n].get(g, 0)
        return ((c - disc[n][min(c, 3) - 1]) if c else 0) / total + held / total * low

    return lambda w: sum(-math.log(p(tuple(w[max(0, i - order + 1) : i + 1]))) for i in range(len(w)))


@pytest.mark.parametrize("block_bytes,order", [(8 << 20, 3), (1500, 3), (700, 4), (3000, 2)])
def test_scores_equal_dictionaries_however_dealt(spark, block_bytes, order):
    ensure_checkpoint_dir(spark)
    texts = [t for _, t, lang, _ in made()[0][:120] if lang == "de"] + ["de1 de2 never seen de3", "unseen", "de1 de1", "De1\tDE2\nde3 " * 400]
    df = spark.createDataFrame([(i, t, "de", None) for i, t in enumerate(texts)], DOCS)
    labels = spark.createDataFrame([(i, 1, 0, None) for i in range(len(texts) - 4)], LABELS)
    used = {r.doc_id for r in trusted_ids(labels).where("not held_out").collect()}
    hand = model_by_hand([t for i, t in enumerate(texts) if i in used], order)
    got = {r.doc_id: (r.nll, r.n_words) for r in scores(df, labels, order, block_bytes).collect()}
    assert [got[i][1] for i in range(len(texts))] == [len(t.split()) for t in texts]
    assert [got[i][0] for i in range(len(texts))] == pytest.approx([hand(t.lower().split()) for t in texts], rel=1e-9)
    again = {r.doc_id: (r.nll, r.n_words) for r in scores(df.repartition(3), labels, order, 2 * block_bytes).collect()}
    assert again == got  # to the last bit


def shuffle_files(spark):
    """Names of the shuffle files of this machine."""
    files = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
    return {x for i in range(files.size()) if (x := files.apply(i).getName()).startswith("shuffle_")}


def test_shuffles_are_small_and_removed(spark, monkeypatch):
    """No step shuffles most of what all of them do, and files of steps that have ended don't stay."""
    ensure_checkpoint_dir(spark)
    store, steps, real = spark.sparkContext._jsc.sc().statusStore(), [], DataFrame.checkpoint
    written = lambda: store.executorSummary("driver").totalShuffleWrite()

    def counted(self, *args):
        spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(30_000)
        before, out = written(), real(self, *args)
        spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(30_000)
        steps.append(written() - before)
        return out

    r = random.Random(5)
    texts = [" ".join(r.choice("abcdefghij") * r.randrange(1, 9) + str(r.randrange(900)) for _ in range(300)) for _ in range(400)]
    df = spark.createDataFrame([(i, t, "de", None) for i, t in enumerate(texts)], DOCS).repartition(4).checkpoint()
    labels = spark.createDataFrame([(i, 1, 0, None) for i in range(200)], LABELS)
    monkeypatch.setattr(DataFrame, "checkpoint", counted)
    before = shuffle_files(spark)
    out = score_documents(df, labels, block_bytes=1 << 16)
    assert sum(steps) > 0 and max(steps) < 0.4 * sum(steps)
    for _ in range(50):  # they are removed in the background
        if left := shuffle_files(spark) - before:
            time.sleep(0.2)
    assert not left
    assert out.collect() == out.collect() and out.count() == 400


def test_packed_numbers():
    for x in ([], [0], [5, 5, 2**40 - 1], list(range(0, 10**6, 997))):
        a = np.array(x, dtype=np.uint64)
        assert (get(put(a)) == a).all() and (get_sorted(put_sorted(a)) == a).all()


def test_probabilities_sum_to_one():
    hand = model_by_hand(["a b a c b a", "b a d a b"], 2)
    assert sum(math.exp(-(hand(["a", w]) - hand(["a"]))) for w in "abcd") < 1.0


def test_rejects_junk_and_keeps_clean(spark):
    docs, labels = made()
    d, lab = spark.createDataFrame(docs, DOCS), spark.createDataFrame(labels, LABELS)
    got = {r.doc_id: r for r in score_documents(d, lab).collect()}
    junk = [i for i in range(600) if i % 10 == 9]
    assert len(got) == len(docs) and sum(got[i].keep for i in junk) == 0
    assert sum(got[i].keep for i in range(600) if i % 10 != 9) > 0.97 * 540
    assert got[9000].keep and got[9001].keep and got[9000].perplexity is None and got[9002].threshold is not None
    kept = keep_quality(d, lab)
    assert kept.columns == d.columns and sorted(map(str, (r.doc_id for r in kept.collect()))) == sorted(str(i) for i, r in got.items() if r.keep)


def test_toxic_is_not_trusted(spark):
    labels = [(1, 1, 0, None), (2, 1, 1, None), (3, 1, None, None), (4, 1, 0, None), (4, 1, 1, None), (5, 0, 0, None), (6, None, None, None)]
    assert sorted(r.doc_id for r in trusted_ids(spark.createDataFrame(labels, LABELS)).collect()) == [1, 3]


def test_thresholds_and_keep_by_hand(spark):
    """The verdict of each document from its scores: quantiles per language of held-out trusted documents."""
    docs, labels = made()
    docs += [(9100, docs[9][1], "en", None), (9100, docs[0][1], "de", None), (None, docs[9][1], "de", "x"), (9101, "en1 " * 30000, "fr", None)]
    d, lab = spark.createDataFrame(docs, DOCS), spark.createDataFrame(labels, LABELS)
    rows = scores(d, lab, 3, 1 << 20).collect()
    held = {r.doc_id for r in trusted_ids(lab).where("held_out").collect()}
    mu, score, all_scores = {}, defaultdict(list), []
    for lang in {r.lang for r in rows}:
        own = [r for r in rows if r.lang == lang and r.doc_id in held and r.n_words]
        if own:
            mu[lang] = sum(r.nll for r in own) / sum(r.n_words for r in own)
            score[lang] = sorted((r.nll + 40 * mu[lang]) / (r.n_words + 40) for r in own)
            all_scores += score[lang]
    mu0 = sum(mu[k] * len(v) for k, v in score.items()) / len(all_scores)
    top = lambda s: sorted(s)[math.ceil(0.995 * len(s)) - 1]
    want = Counter()
    for r in rows:
        m, t = (mu[r.lang], top(score[r.lang])) if r.lang in mu else (mu0, top(all_scores))
        want[r.doc_id, r.lang, r.n_words, not r.n_words or (r.nll + 40 * m) / (r.n_words + 40) <= t + 1e-12] += 1
    assert Counter((r.doc_id, r.lang, r.n_words, r.keep) for r in score_documents(d, lab).collect()) == want
    kept = Counter((r.doc_id, r.lang) for r in keep_quality(d, lab).collect())
    assert kept == Counter({(i, lang): sum(n for (j, la, _, keep), n in want.items() if keep and (j, la) == (i, lang)) for i, lang in {(j, la) for j, la, _, keep in want if keep}})


def test_without_trust_and_empty(spark):
    docs, labels = made(n=20)
    d, lab = spark.createDataFrame(docs, DOCS), spark.createDataFrame(labels, LABELS)
    assert keep_quality(d, lab.where("quality = 0")).count() == len(docs)
    assert {r.keep for r in score_documents(d, lab.where("false")).collect()} == {True}
    assert score_documents(d.where("false"), lab).collect() == [] and keep_quality(d.where("false"), lab).collect() == []
