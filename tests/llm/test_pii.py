import random
import re

from heliograph.llm.pii import em, find_pii, fit

SCHEMA = "doc_id long, text string, spans string"


def check_card(s):
    d = [int(c) for c in s if c.isdigit()]
    return 13 <= len(d) <= 19 and sum(sum(divmod(x * (1 + i % 2), 10)) for i, x in enumerate(reversed(d))) % 10 == 0


RULES = [
    ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda s: True),
    ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda s: all(int(x) <= 255 for x in s.split("."))),
    ("card", r"[0-9]([\x20-]?[0-9])+", check_card),
    ("phone", r"\+[0-9][\x20().0-9-]+[0-9]", lambda s: 9 <= sum(c.isdigit() for c in s) <= 15),
]


def brute(text):
    return [(k, m.start(), m.end()) for k, rx, ok in RULES for m in re.finditer(rx, text or "") if ok(m[0])]


def long(n):
    """Texts that cost careless patterns quadratic time or deep recursion."""
    return ["a" * n, "1" * n, "1." * n, "+" * n, "a@" * n, "1 " * n, "a.@" * n, "a@b" + ".c" * n, "+1" + "(" * n]


def made():
    r = random.Random(9)
    bits = ["a.b@c.de", "x@y", "@", ".", "q@w..e", "a@b@c.d", "_u%+v@h-i.j.k-", "1.2.3.4", "256.1.1.1", "0001.02.3.255", "1.2.3.4.5.6.7.8.9", "4111 1111 1111 1111", "4111-1111-1111-1112", "0" * 13, "7" * 25, "12 34", "1", " ", "-", "+1 (017) 555-7713", "+49.30-1234567", "+1 2", "+", "é", "😀", "\n", "Dr. Anna Smith", "123-45-6789", "(415) 555-2671", "bob (at) site (dot) com", "٣", "card: "]
    texts = ["".join(r.choice(bits) for _ in range(r.randrange(0, 16))) for _ in range(400)]
    texts += [None, "", *long(2000), "x@y.z " * 400]
    return [(i, t, None) for i, t in enumerate(texts)] + [(None, "q@r.st", None)] * 2


def test_base_spans_by_brute_force(spark):
    rows = made()
    got = find_pii(spark.createDataFrame(rows, SCHEMA).repartition(4)).collect()
    assert sorted([(r.doc_id, [(s.kind, s.start, s.end) for s in r.spans if s.base]) for r in got], key=str) == sorted([(d, brute(t)) for d, t, _ in rows], key=str)


def test_very_long_texts(spark):
    got = {r.doc_id: len(r.spans) for r in find_pii(spark.createDataFrame([(i, t, None) for i, t in enumerate(long(60000))], SCHEMA)).collect()}
    assert got == {0: 0, 1: 0, 2: 15000, 3: 0, 4: 0, 5: 0, 6: 0, 7: 1, 8: 0}


def account(r, country):
    """An account number with right check digits."""
    body = "".join(r.choice("0123456789") for _ in range(16))
    check = 98 - int(body + "".join(str(ord(c) - 55) for c in country) + "00") % 97
    raw = f"{country}{check:02d}{body}"
    return " ".join(raw[i : i + 4] for i in range(0, 20, 4))


def test_check_digits_of_accounts(spark):
    from pyspark.sql import functions as F

    from heliograph.llm.pii import mod97

    r = random.Random(1)
    rows = [("DE89 3704 0044 0532 0130 00", True), ("DE00 3704 0044 0532 0130 00", False), ("GB82 WEST 1234 5698 7654 32", True), ("GB82 WEST 1234 5698 7654 33", False)]
    rows += [(a, True) for a in (account(r, c) for c in ["DE", "FR", "ES"] * 20)]
    assert all(x.m == x.ok for x in spark.createDataFrame(rows, "a string, ok boolean").select(mod97(F.col("a")).alias("m"), "ok").collect())


def labelled(seed=12):
    """Texts with (kind, span, true?) of what isn't a base kind: personal data in their usual surroundings, and look-alikes."""
    r = random.Random(seed)
    digits = lambda n: "".join(r.choice("0123456789") for _ in range(n))
    filler = lambda: " ".join(r.choice("the of and a in report value table north tower light river".split()) for _ in range(r.randrange(4, 12)))
    good = {
        "phone_local": lambda: r.choice(["call ", "phone ", "tel "]) + f"*({r.randrange(200, 999)}) {r.randrange(200, 999)}-{digits(4)}*",
        "email_at": lambda: r.choice(["write to ", "mail "]) + f"*{r.choice(['bob', 'eva.m', 'info'])} (at) site{digits(2)} (dot) {r.choice(['com', 'de', 'org'])}*",
        "id_number": lambda: r.choice(["ssn ", "social security number "]) + f"*{r.randrange(100, 600)}-{r.randrange(10, 99)}-{r.randrange(1000, 9999)}*",
        "iban": lambda: r.choice(["iban ", "account "]) + f"*{account(r, r.choice(['DE', 'FR', 'ES']))}*",
        "person": lambda: r.choice(["dear ", "signed by "]) + "*" + r.choice(["Dr. Anna Smith", "Mrs Laura Weber", "Mr. Peter Jones", "Frau Sabine Kern"]) + "*",
    }
    bad = {
        "phone_local": lambda: r.choice(["order ", "version "]) + f"*{r.randrange(100, 199)}.{r.randrange(100, 199)}.{digits(4)}*",
        "email_at": lambda: "ref " + f"*x (at) y{digits(2)} (dot) zzq*",
        "id_number": lambda: r.choice(["invoice ", "isbn "]) + f"*{r.choice(['000', '666', '912'])}-{r.randrange(10, 99)}-{r.randrange(1000, 9999)}*",
        "iban": lambda: r.choice(["token ", "commit "]) + f"*{r.choice(['ZZ', 'DE'])}00 {digits(4)} {digits(4)} {digits(4)}*",
    }
    texts, marks = [], []
    for i in range(900):
        text, own = "", []
        for kinds, true in ((good, True), (bad, False)):
            if r.random() < 0.6:
                kind = r.choice(sorted(kinds))
                before, span, _ = (filler() + " " + kinds[kind]()).split("*")
                start = len(text) + len(before)
                own.append((kind, start, start + len(span), true))
                text += before + span + " "
        texts.append((i, text + filler(), None))
        marks.append(own)
    return texts, marks


def test_added_spans_are_precise_and_whole(spark):
    texts, marks = labelled()
    got = {r.doc_id: {(s.kind, s.start, s.end) for s in r.spans if not s.base} for r in find_pii(spark.createDataFrame(texts, SCHEMA)).collect()}
    for kind in ("phone_local", "email_at", "id_number", "iban", "person"):
        true = {(i, *m[:3]) for i, own in enumerate(marks) for m in own if m[0] == kind and m[3]}
        found = {(i, *s) for i, spans in got.items() for s in spans if s[0] == kind}
        assert len(true) > 50 and len(true & found) >= 0.9 * len(true), (kind, "recall")
        assert len(true & found) >= 0.9 * len(found), (kind, "precision")


def test_em_finds_the_reliable_labeler():
    r, counts = random.Random(0), {}
    for _ in range(6000):
        y = r.random() < 0.5
        v = tuple((1 if y else -1) * (1 if r.random() < p else -1) for p in (0.95, 0.9, 0.55))
        counts[v] = counts.get(v, 0) + 1
    chance = em([("email", v, float(n)) for v, n in counts.items()])
    assert chance["email", (1, 1, -1)] > 0.9 and chance["email", (-1, -1, 1)] < 0.1
    w = fit([("email", v, 0, float(n)) for v, n in counts.items()], chance)
    assert w["v1=1"] > 0.5 > -0.5 > w["v1=-1"]


def test_native_and_empty(spark):
    df = spark.createDataFrame(made()[:30], SCHEMA)
    plan = find_pii(df)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan
    assert find_pii(df.where("false")).collect() == []
    assert [r.spans for r in find_pii(spark.createDataFrame([(1, "clean words only", None)], SCHEMA)).collect()] == [[]]
