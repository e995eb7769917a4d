import random
import re

import pytest

from heliograph.llm.secrets import BASE_RULES, RULES, Scanner, find_secrets, redact_secrets, trigram_query

SCHEMA = "doc_id long, text string, n_chars long"


def brute(text):
    """The contract's words, rule by rule."""
    out = []
    for n, (kind, rx, group, least) in enumerate(
        [
            ("assign", r"""((?i:p)(?i:assword)|(?i:passwd)|(?i:secret)|(?i:token)|(?i:api_?key))["']? *[:=] *["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
            ("access", r"AKIA[A-Z0-9]+", 0, 20),
            ("hex", r"[0-9a-f]+", 0, 24),
        ]
    ):
        for m in re.finditer(rx, text or "", re.ASCII):
            if len(m.group(group)) >= least:
                out.append((m.start(), n, kind, m.end()))
    return [(k, s, e) for s, _, k, e in sorted(out)]


def made():
    r = random.Random(2)
    bits = ["token = \"", "Api_Key:", "pass", "passwd='", "ſecret=abcdefg", "AKIA", "A" * 16, "0123456789abcdef" * 2, "f" * 23, "abcdef", " é", "\n", "word ", "secret=x", "toKen=abcdefgh", "-----BEGIN RSA PRIVATE KEY-----", "ghp_" + "a1" * 18, "https://u:pw@h", "😀", "==", "SECRET  :  'q.w-e/r+t"]
    texts = ["".join(r.choice(bits) for _ in range(r.randrange(0, 14))) for _ in range(300)] + [None, "", "x" * 400000, "0" * 300000, "password" + " " * 50000]
    return [(i, t, None) for i, t in enumerate(texts)] + [(None, "token=abcdefgh", 1)] * 2


def test_base_spans_by_brute_force(spark):
    rows = made()
    got = find_secrets(spark.createDataFrame(rows, SCHEMA).repartition(3)).collect()
    base = {r.kind for r in BASE_RULES}
    assert sorted([(r.doc_id, [tuple(s) for s in r.spans if s.kind in base]) for r in got], key=str) == sorted([(d, brute(t)) for d, t, _ in rows], key=str)


def test_index_loses_no_match():
    texts = [(t or "").encode() for _, t, _ in made()]
    for raw, spans in zip(texts, Scanner().spans(texts), strict=True):
        text = raw.decode()
        want = sorted((m.start(), n, m.end()) for n, r in enumerate(RULES) for m in re.finditer(r.pattern, text) if m.end(r.group) - m.start(r.group) >= r.least)
        assert spans == [(RULES[n].kind, s, e) for s, n, e in want]


def test_queries():
    assert trigram_query("AKIA[A-Z0-9]+") == ("and", b"aki", b"kia")
    assert trigram_query("[0-9a-f]{24,}") is True
    assert trigram_query("(?:abcd|xyz)+q?") == ("or", ("and", b"abc", b"bcd"), b"xyz")
    assert trigram_query("ab|cdef") is True
    assert trigram_query("a[bc]de") == ("or", ("and", b"abd", b"bde"), ("and", b"acd", b"cde"))


def test_redaction_and_empty(spark):
    df = spark.createDataFrame([(1, "a token=abcdefgh b", 5), (2, None, 6), (3, "clean", None)], SCHEMA)
    assert sorted(map(tuple, redact_secrets(df).collect())) == [(1, "a [SECRET] b", 5), (2, None, 6), (3, "clean", None)]
    assert find_secrets(df.where("false")).collect() == []


@pytest.mark.parametrize("bad", ["a" * 10])
def test_plain_text_has_no_spans(bad):
    assert Scanner().spans([bad.encode()]) == [[]]


def test_patterns_that_fold_beyond_ascii_are_refused():
    import pytest

    from heliograph.llm.secrets import Rule, Scanner

    with pytest.raises(ValueError):
        Scanner((Rule(*["x", "(?i)secret", *BASE_RULES[0][2:]]),))
