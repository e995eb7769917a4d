"""PII by weak supervision, in DataFrame functions only.

Patterns propose candidate spans: four base kinds with their checks, and broader shapes. Three labelers vote on each (for,
against or no vote): the strict format of the kind, a gazetteer (domain endings, card and area prefixes, given names, country codes), and
cue words before the span. The votes are counted per pattern of votes, a table whose size depends on the labelers
alone; expectation-maximisation over it estimates each labeler's reliability per kind and the chance that a candidate
is personal data. A logistic classifier over votes, kind and length is fitted to those chances, on the same bounded
table, and its weights go back into the query as literals. A candidate is a span if it passes a base kind's check, or if
the classifier gives it at least ``sure`` and it overlaps no base span, but for shorter ones that lie inside it (a card number in an IBAN).

Texts are read once; candidates are checkpointed. Everything that sees a text is a built-in function, and every
pattern is possessive or anchored so that long runs cost linear time and no recursion. Offsets are code points, ends
exclusive; matches are leftmost and non-overlapping per kind.

Nulls: a null text is empty and has no spans. Repeated rows each get their own result; rows without id are
kept. Empty tables give empty results. Other columns are ignored.
"""

from __future__ import annotations

import math
from functools import partial, reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from heliograph.session import ensure_checkpoint_dir

BASE = ("email", "ip", "card", "phone")
MORE = ("card_like", "email_at", "phone_local", "id_number", "iban", "person")
KINDS = BASE + MORE
LOCAL = r"[A-Za-z0-9._%+-]"
#: Gazetteers (endings of domains, given names, countries that have IBANs) and cue words.
DOMAINS = (
    "com org net edu gov mil int info biz name io dev app ai co me tv cc xyz online shop site blog cloud"
    " de fr es uk eu ch at it nl be lu pt pl cz sk hu ro bg gr dk se no fi ie is ee lv lt si hr rs tr ru ua us ca mx br ar cl pe ve au nz jp cn kr in sg hk tw za ng ke eg il ae example"
).split()
NAMES = (
    "james mary robert patricia john jennifer michael linda david elizabeth william barbara richard susan joseph jessica thomas sarah charles karen christopher lisa daniel nancy matthew betty anthony sandra mark margaret"
    " donald ashley steven emily paul kimberly andrew anna joshua michelle kenneth carol kevin amanda brian melissa george deborah peter hans klaus juergen wolfgang stefan andreas petra sabine monika ursula heike"
    " martin jan lukas felix leon emma mia hannah sofia lena laura julia jean pierre michel philippe alain nicolas julien marie isabelle nathalie sophie camille chloe antoine louis jose antonio manuel francisco juan"
    " carlos luis javier miguel pedro maria carmen ana isabel dolores pilar teresa lucia paula marta giovanni marco francesca giulia"
).split()
COUNTRIES = "AD AE AL AT AZ BA BE BG BH BR BY CH CR CY CZ DE DK DO EE EG ES FI FO FR GB GE GI GL GR GT HR HU IE IL IQ IS IT JO KW KZ LB LC LI LT LU LV MC MD ME MK MR MT MU NL NO PK PL PS PT QA RO RS SA SC SE SI SK SM ST SV TL TN TR UA VA VG XK".split()
TITLES = "(?:Mrs?|Ms|Dr|Prof|Herr|Frau|Mme|Sra?)"
GIVEN = "|".join(x.capitalize() for x in NAMES)
#: Per kind: a cheap test that every matching text passes, and the pattern.
PATTERNS = {
    "email": (lambda t: F.contains(t, F.lit("@")), rf"(?:\G|(?<!{LOCAL})){LOCAL}++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"),
    "ip": (lambda t: t.rlike(r"[0-9]\.[0-9]"), r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}"),
    "card": (lambda t: t.rlike(r"[0-9][\x20-]?[0-9][\x20-]?[0-9][\x20-]?[0-9][\x20-]?[0-9]"), r"[0-9](?:[\x20-]?[0-9]){12,}+"),
    "phone": (lambda t: F.contains(t, F.lit("+")), r"\+[0-9][\x20().0-9-]+[0-9]"),
    "email_at": (lambda t: F.contains(t, F.lit("at")) & t.rlike(r"[(\[]at[)\]]"), r"(?<![A-Za-z0-9._-])[A-Za-z0-9._-]{1,64}+\x20?[(\[]at[)\]]\x20?[A-Za-z0-9-]{1,63}+(?:\x20?(?:\.|[(\[]dot[)\]])\x20?[A-Za-z0-9-]{1,63}+){1,8}+"),
    "phone_local": (lambda t: t.rlike(r"[0-9]{3}\)?[ .-][0-9]{3}[.-][0-9]{4}"), r"(?<![0-9+.(-])(?:\([0-9]{3}\)\x20?|[0-9]{3}[\x20.-])[0-9]{3}[.-][0-9]{4}(?![0-9])"),
    "id_number": (lambda t: t.rlike(r"[0-9]-[0-9]{2}-[0-9]"), r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])"),
    "iban": (lambda t: t.rlike(r"[A-Z]{2}[0-9]{2}[ A-Z0-9]{11}"), r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){2,7}+(?:\x20?[A-Z0-9]{1,3})?+(?![A-Za-z0-9])"),
    "person": (lambda t: t.rlike(r"[A-Z][a-z]{1,30}\.?\x20[A-Z][a-z]"), rf"(?=[A-Z][a-z]{{1,30}}+\.?\x20[A-Z][a-z])\b(?:{TITLES}\b\.?\x20[A-Z][a-z]{{1,30}}+(?:\x20[A-Z][a-z]{{1,30}}+)?+|(?:{GIVEN})\x20[A-Z][a-z]{{2,30}}+)\b"),
}
CUES = {
    "email": "mail contact write kontakt courriel correo", "ip": "ip host server address client", "card": "card visa credit karte carte tarjeta", "phone": "phone call tel mobile fax telefon appel",
    "id_number": "ssn social security number", "iban": "iban account bank konto compte cuenta", "person": "dear name contact signed patient client by from",
}
COUNTER_CUES = "version isbn order invoice commit token sha hash ref page chapter figure"
ALIKE = {"card_like": "card", "email_at": "email", "phone_local": "phone"}


def _digits(c: Column) -> Column:
    return F.regexp_replace(c, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    """Whether a string of digits passes the Luhn check."""
    turned = F.reverse(digits)

    def one(i):
        d = F.substring(turned, i, F.lit(1)).cast("int")
        twice = d * 2
        return F.when(i % 2 == 1, d).when(twice > 9, twice - 9).otherwise(twice)

    return F.aggregate(F.transform(F.sequence(F.lit(1), F.length(digits)), one), F.lit(0), lambda a, x: a + x) % 10 == 0


def mod97(account: Column) -> Column:
    """Whether an account number's check digits are right: its first four characters go to the end, letters count from 10 on, and the number leaves 1 when divided by 97."""
    plain = F.regexp_replace(account, "[^A-Z0-9]", "")
    turned = F.split(F.concat(F.substring(plain, 5, 64), F.substring(plain, 1, 4)), "")

    def step(acc, x):
        value = F.when(x < ":", F.ascii(x) - 48).otherwise(F.ascii(x) - 55)
        return (acc * F.when(value > 9, 100).otherwise(10) + value) % 97

    return F.aggregate(F.filter(turned, lambda x: x != ""), F.lit(0), step) == 1


def _passes(kind: str, m: Column) -> Column:
    """The base kinds' checks."""
    if kind == "ip":
        return F.forall(F.split(m, r"\."), lambda p: (F.length(F.regexp_replace(p, "^0+", "")) <= 3) & (F.coalesce(F.substring(F.regexp_replace(p, "^0+", ""), 1, 3).try_cast("int"), F.lit(0)) <= 255))
    if kind == "card":
        n = F.length(_digits(m))
        return F.when(n.between(13, 19), luhn(_digits(m))).otherwise(F.lit(False))
    if kind == "phone":
        return F.length(_digits(m)).between(9, 15)
    return F.lit(True)


def _strict(kind: str, m: Column) -> Column:
    """The first labeler: 1 for, -1 against."""
    d = _digits(m)
    ok = {
        "email": F.substring_index(m, ".", -1).rlike("^[A-Za-z]{2,63}$"),
        "ip": ~m.rlike(r"(?:^|\.)0[0-9]"),
        "card": F.length(d).isin(13, 14, 15, 16, 19),
        "phone": F.length(d).between(10, 14),
        "card_like": F.lit(False),
        "email_at": m.rlike(r"[A-Za-z]{2}$"),
        "phone_local": d.rlike("^[2-9][0-9]{2}[2-9]"),
        "id_number": ~m.rlike("^(?:000|666|9)|-00-|-0000$"),
        "iban": F.length(F.regexp_replace(m, r"\x20", "")).between(15, 34) & mod97(m),
        "person": m.rlike("^" + TITLES + r"\b"),
    }[kind]
    return F.when(ok, 1).otherwise(0 if kind == "person" else -1)


def _gazetteer(kind: str, m: Column) -> Column:
    """The second labeler: 1 for, -1 against, 0 no vote."""
    if kind in ("email", "email_at"):
        return F.when(F.substring_index(F.translate(F.lower(m), " ([", "..."), ".", -1).isin(DOMAINS), 1).otherwise(-1)
    if kind in ("card", "card_like"):
        return F.when(_digits(m).rlike("^[3-6]"), 1).otherwise(-1)
    if kind == "ip":
        return F.when(m.rlike(r"^(?:0|127|255)\."), -1).otherwise(1)
    if kind in ("phone", "phone_local"):
        return F.when(_digits(m).rlike("^(?:1|2[0-9]|3[0-9]|4[0-9]|5[0-9]|6[0-9]|7|8[0-9]|9[0-9])[0-9]"), 1).otherwise(0)
    if kind == "iban":
        return F.when(F.substring(m, 1, 2).isin(COUNTRIES), 1).otherwise(-1)
    if kind == "person":
        return F.when(F.exists(F.split(F.lower(m), r"\x20"), lambda x: x.isin(NAMES)), 1).otherwise(0)
    return F.lit(0)


def _context(kind: str, ctx: Column) -> Column:
    """The third labeler: cue words in the 30 code points before the span."""
    words = lambda s: r"(?i)\b(?:" + "|".join(s.split()) + ")"
    return F.when(ctx.rlike(words(COUNTER_CUES)), -1).when(ctx.rlike(words(CUES[ALIKE.get(kind, kind)])), 1).otherwise(0)


CHUNK = 256


def _chunk_starts(sizes: Column) -> Column:
    """The sum of all sizes before each chunk of CHUNK of them."""
    sums = F.transform(F.sequence(F.lit(0), F.floor((F.size(sizes) - 1) / CHUNK).cast("int")), lambda c: F.aggregate(F.slice(sizes, c * CHUNK + 1, F.lit(CHUNK)), F.lit(0), lambda a, x: a + x))
    none = F.struct(F.lit(0).alias("pos"), F.array().cast("array<int>").alias("out"))
    return F.aggregate(sums, none, lambda acc, x: F.struct((acc["pos"] + x).alias("pos"), F.concat(acc["out"], F.array(acc["pos"])).alias("out")), lambda acc: acc["out"])


def _located(pairs: Column, sizes: Column, starts: Column) -> Column:
    """Matches with offsets and the end of the text before each. pairs: each match m with the piece p of text before it;
    sizes: code points of both; starts: of each chunk of them. So a match costs at most CHUNK additions, however many there are."""

    def one(x, i):
        chunk = F.floor(i / CHUNK).cast("int")
        at = F.element_at(starts, chunk + 1) + F.aggregate(F.slice(sizes, chunk * CHUNK + 1, F.pmod(i, F.lit(CHUNK))), F.lit(0), lambda a, y: a + y) + F.length(x["p"])
        return F.struct(at.alias("start"), (at + F.length(x["m"])).alias("end"), x["m"].alias("m"), F.right(x["p"], F.lit(30)).alias("ctx"))

    return F.transform(pairs, one)


def candidates(documents: DataFrame) -> DataFrame:
    """doc_id and cands: array of (kind, start, end, base, v1, v2, v3, size) of each row."""
    df = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    none = F.array().cast("array<string>")
    df = df.withColumns({f"m_{k}": F.when(test(F.col("text")), F.regexp_extract_all("text", F.lit(rx), F.lit(0))).otherwise(none) for k, (test, rx) in PATTERNS.items()})
    df = df.withColumns({f"p_{k}": F.when(F.size(f"m_{k}") > 0, F.split("text", rx, -1)).otherwise(none) for k, (_, rx) in PATTERNS.items()})
    pairs = lambda k: F.slice(F.arrays_zip(F.col(f"p_{k}").alias("p"), F.col(f"m_{k}").alias("m")), F.lit(1), F.size(f"m_{k}"))
    df = df.select("doc_id", *[pairs(k).alias(f"z_{k}") for k in PATTERNS])
    df = df.withColumns({f"l_{k}": F.transform(f"z_{k}", lambda x: F.length(x["p"]) + F.length(x["m"])) for k in PATTERNS})
    df = df.withColumns({f"c_{k}": F.when(F.size(f"l_{k}") > 0, _chunk_starts(F.col(f"l_{k}"))).otherwise(F.array().cast("array<int>")) for k in PATTERNS})
    df = df.select("doc_id", *[_located(F.col(f"z_{k}"), F.col(f"l_{k}"), F.col(f"c_{k}")).alias(f"s_{k}") for k in PATTERNS])

    def judged(kind, s):
        size = F.when(F.length(s["m"]) < 12, 0).when(F.length(s["m"]) < 20, 1).otherwise(2)
        return F.struct(F.lit(kind).alias("kind"), s["start"].alias("start"), s["end"].alias("end"), F.lit(kind in BASE).alias("base"), _strict(kind, s["m"]).alias("v1"), _gazetteer(kind, s["m"]).alias("v2"), _context(kind, s["ctx"]).alias("v3"), size.alias("size"))

    def of(kind, source, test):
        own = F.col(f"s_{source}")
        own = F.filter(own, lambda x: test(x["m"])) if test else own
        return F.transform(own, lambda x: judged(kind, x))

    groups = [of(k, k, partial(_passes, k) if k in BASE else None) for k in PATTERNS]
    groups.append(of("card_like", "card", lambda m: F.length(_digits(m)).between(13, 19) & ~_passes("card", m)))
    return df.select("doc_id", F.concat(*groups).alias("cands"))


def em(patterns: list[tuple[str, tuple[int, ...], float]], rounds: int = 50) -> dict:
    """The chance per (kind, votes) of being personal data, by expectation-maximisation over counted vote patterns.

    Each labeler has, per kind, a chance of each vote given either answer; votes are independent given the answer. Starts
    from the share of votes for; counts are smoothed by one.
    """
    chance = {(k, v): (1 + 2 * sum(x > 0 for x in v)) / (2 + 2 * sum(x != 0 for x in v)) for k, v, _ in patterns}
    for _ in range(rounds):
        prior, of = {}, {}
        for k, v, n in patterns:
            for y, w in ((1, n * chance[k, v]), (0, n * (1 - chance[k, v]))):
                prior[k, y] = prior.get((k, y), 1.0) + w
                for j, x in enumerate(v):
                    of[k, y, j, x] = of.get((k, y, j, x), 0.0) + w
        new = {}
        for k, v, _ in patterns:
            logs = [math.log(prior[k, y]) + sum(math.log((of.get((k, y, j, x), 0.0) + 1) / (prior[k, y] + 2)) for j, x in enumerate(v)) for y in (1, 0)]
            new[k, v] = 1 / (1 + math.exp(max(-500, min(500, logs[1] - logs[0]))))
        chance = new
    return chance


def features(kind: str, votes: tuple[int, ...], size: int) -> list[str]:
    """Names of the features that are on."""
    return ["bias", f"kind={kind}", f"size={size}", *[f"v{j}={x}" for j, x in enumerate(votes, 1) if x]]


def fit(rows: list[tuple[str, tuple[int, ...], int, float]], chance: dict, rounds: int = 300, decay: float = 0.02) -> dict[str, float]:
    """Logistic weights of the features, fitted to the chances by gradient steps; rows are (kind, votes, size, count)."""
    w: dict[str, float] = {}
    total = sum(n for *_, n in rows) or 1.0
    for _ in range(rounds):
        grad: dict[str, float] = {}
        for k, v, s, n in rows:
            on = features(k, v, s)
            p = 1 / (1 + math.exp(-max(-30.0, min(30.0, sum(w.get(f, 0.0) for f in on)))))
            for f in on:
                grad[f] = grad.get(f, 0.0) + n / total * (chance[k, v] - p)
        w = {f: w.get(f, 0.0) + 2.0 * (g - decay * w.get(f, 0.0) / 20) for f, g in grad.items()}
    return w


def _score(w: dict[str, float], c: Column) -> Column:
    """The classifier's logit of a candidate, as an expression."""
    terms = [F.lit(w.get("bias", 0.0))]
    for name, value in sorted(w.items()):
        if name != "bias":
            field, x = name.split("=")
            terms.append(F.when(c[field] == (x if field == "kind" else int(x)), F.lit(value)).otherwise(F.lit(0.0)))
    return reduce(lambda a, b: a + b, terms)


def find_pii(documents: DataFrame, sure: float = 0.9) -> DataFrame:
    """doc_id and spans array<struct<kind, start, end, base>> of each row of documents(doc_id, text), by kind and start."""
    ensure_checkpoint_dir(documents.sparkSession)
    found = candidates(documents).checkpoint()
    counted = found.where(F.size("cands") > 0).select(F.explode("cands").alias("c")).groupBy("c.kind", "c.v1", "c.v2", "c.v3", "c.size").count().collect()  # 810 rows at most
    rows = [(r["kind"], (r["v1"], r["v2"], r["v3"]), r["size"], float(r["count"])) for r in counted]
    merged: dict = {}
    for k, v, _, n in rows:
        merged[k, v] = merged.get((k, v), 0.0) + n
    w = fit(rows, em([(k, v, n) for (k, v), n in merged.items()]))
    base = F.filter("cands", lambda c: c["base"])
    logit = math.log(sure / (1 - sure))
    inside = lambda b, c: (c["start"] <= b["start"]) & (b["end"] <= c["end"]) & (b["end"] - b["start"] < c["end"] - c["start"])
    clear = lambda c: ~F.exists(base, lambda b: (b["start"] < c["end"]) & (c["start"] < b["end"]) & ~inside(b, c))
    more = F.filter("cands", lambda c: ~c["base"] & (_score(w, c) >= logit) & clear(c))
    place = F.create_map(*[F.lit(x) for i, k in enumerate(KINDS) for x in (k, i)])
    keyed = F.transform(F.concat(base, more), lambda c: F.struct(place[c["kind"]].alias("i"), c["start"].alias("start"), c["end"].alias("end"), c["kind"].alias("kind"), c["base"].alias("base")))
    spans = F.transform(F.array_sort(keyed), lambda c: F.struct(c["kind"].alias("kind"), c["start"].cast("long").alias("start"), c["end"].cast("long").alias("end"), c["base"].alias("base")))
    return found.select("doc_id", spans.alias("spans"))
