"""Encoding and decoding against the public library itself."""

import hashlib
import random

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from heliograph.llm import bpe

PATH = public_tokenizers.path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def both():
    with open(PATH, "rb") as f:
        return bpe.Vocabulary(f.read()), Tokenizer.from_file(PATH)


def same(both, text):
    own, lib = both
    ids = own.encode(text)
    want = lib.encode(text, add_special_tokens=False).ids
    assert np.frombuffer(ids, dtype="<u4").tolist() == want, text[:80]
    assert own.decode(ids) == lib.decode(want, skip_special_tokens=False)


@pytest.mark.parametrize("text", ["", " ", "Hello,  World's\tend", "ΑΣ ΣΑΣ İstanbul ǅ ﬁ", "étude É", "a<|endoftext|>b<|startoftext|><|endoftext|>", "<|EndOfText|> <|endoftext", "١٢٣ 4567 ⅷ", "it'S we'LL 'd'", "\x00\x1c\x85 x", "日本語 🎉👩‍👩‍👧", "x\U0001d6a6y ՘z \U000323b0", "퟿￿"])
def test_kinds_of_text(both, text):
    same(both, text)


def test_every_character(both):
    for lo in range(0, 0x110000, 0x400):
        same(both, " ".join(f"a{chr(c)}b" for c in range(lo, lo + 0x400) if not 0xD800 <= c < 0xE000))


def test_random_texts(both):
    rnd = random.Random(5)
    alphabet = "abcdefghijklmnopqrstuvwxyz" * 3 + "ABCXYZ'  .,!?0123456789éüßñçΣσ\n\t-_/́<|>"
    for _ in range(2000):
        same(both, "".join(rnd.choice(alphabet) for _ in range(rnd.randrange(200))))


def test_long_words_take_no_quadratic_time(both):
    same(both, "ab" * 100_000 + " " + "the" * 50_000)


def test_cache_may_be_cleared(both, monkeypatch):
    monkeypatch.setattr(bpe, "KEPT_WORDS", 3)
    same(both, " ".join(f"word{i % 7}x" for i in range(100)))


def test_tables(spark, both):
    rows = [(1, "One two", "x"), (1, "One two", "x"), (None, None, None), (3, "", "y"), (4, "q" * 300_000, "z")]
    df = spark.createDataFrame(rows, "doc_id int, text string, ids string")
    out = bpe.decode_ids(bpe.encode_texts(df, PATH), PATH)
    assert dict(out.dtypes) == {"doc_id": "bigint", "n_tokens": "bigint", "ids": "binary", "decoded": "string"}
    got = sorted(((r.doc_id or 0, r.n_tokens, bytes(r.ids), r.decoded) for r in out.collect()), key=str)
    own = both[0]
    assert got == sorted(((k or 0, len(own.encode(t)) // 4, own.encode(t), own.decode(own.encode(t))) for k, t, _ in rows), key=str)
    assert bpe.encode_texts(df.limit(0), PATH).count() == 0


def test_unknown_kind_of_vocabulary(spark):
    with pytest.raises(ValueError):
        bpe.encode_texts(spark.createDataFrame([(1, "a")], "doc_id long, text string"), public_tokenizers.path("byte_bpe_50k.json"))


def test_query(spark):
    from heliograph.llm.queries import op11_bpe

    sf = "/root/testdata/sf0.001"
    lib = Tokenizer.from_file(PATH)
    want = []
    for r in spark.read.parquet(f"{sf}/documents.parquet").collect():
        ids = lib.encode(r.text or "", add_special_tokens=False).ids
        text = lib.decode(ids, skip_special_tokens=False)
        want.append((r.doc_id, len(ids), hashlib.sha256(np.array(ids, dtype="<u4").tobytes()).hexdigest(), hashlib.sha256(text.encode()).hexdigest()))
    assert sorted(map(tuple, op11_bpe(spark, sf).collect())) == sorted(want)
