"""Text functions of the library, as column expressions; Arrow only where Spark has no expression."""

from __future__ import annotations

import unicodedata

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, DoubleType, StringType


@F.pandas_udf(StringType())
def nfc(s: pd.Series) -> pd.Series:
    """Canonical composition; Spark has no expression for it."""
    return s.map(lambda x: None if x is None else unicodedata.normalize("NFC", x))


def match_key(s: Column) -> Column:
    """Lower case, then canonical composition."""
    return nfc(F.lower(s))


@F.pandas_udf(StringType())
def nfd(s: pd.Series) -> pd.Series:
    """Canonical decomposition."""
    return s.map(lambda x: None if x is None else unicodedata.normalize("NFD", x))


#: Words that stay in lower case inside a title.
SMALL_WORDS = "a an and as at but by en for if in of on or the to v v. via vs vs.".split()


def collation_key(s: Column) -> Column:
    """A text whose order is that of names: lower case, without the marks of letters. For sorting, grouping and joining, ``collated`` needs no Python."""
    return nfc(F.regexp_replace(nfd(F.lower(s)), r"\p{Mn}+", ""))


def collated(s: Column) -> Column:
    """The text under Unicode's collation without case and accents: it sorts, groups and joins like its collation key, on the JVM."""
    return F.collate(s, "UNICODE_CI_AI")


def titlecase(segment: Column) -> Column:
    """Words joined by one space: a word with a capital after its first letter stays; small words inside are in lower case; others get a capital."""
    words = F.filter(F.split(segment, r"\s+"), lambda x: x != "")

    def one(w, i):
        rest = F.substring(w, 2, 1 << 30)
        inside = (i > 0) & (i < F.size(words) - 1)
        return F.when(rest.rlike(r"\p{Lu}"), w).when(inside & F.lower(w).isin(SMALL_WORDS), F.lower(w)).otherwise(F.concat(F.upper(F.substring(w, 1, 1)), rest))

    return F.array_join(F.transform(words, one), " ")


@F.pandas_udf(ArrayType(StringType()))
def nfc_all(xs: pd.Series) -> pd.Series:
    """Canonical composition of each text of a list."""
    return xs.map(lambda x: None if x is None else [None if t is None else unicodedata.normalize("NFC", t) for t in x])


def _normal(composed: Column) -> Column:
    segments = F.transform(F.filter(F.transform(F.split(composed, "/"), lambda x: F.trim(F.regexp_replace(x, r"^\s+|\s+$", ""))), lambda x: x != ""), titlecase)
    return F.when((F.size(segments) > 0) & ~composed.rlike(r"\p{Cntrl}") & (segments[0] != "People"), F.array_join(segments, "/"))


def normalize_tag(tag: Column) -> Column:
    """Composed, each segment trimmed and in title case, empty ones dropped; null if nothing is left, for control characters or under People."""
    return _normal(nfc(tag))


def normalize_tags(tags: Column) -> Column:
    """Each tag normalised, distinct, in order; null if one is refused. Composition comes first: an Arrow function can't stand inside a lambda."""
    out = F.transform(nfc_all(tags), _normal)
    return F.when(~F.exists(out, lambda x: x.isNull()), F.array_sort(F.array_distinct(out)))


def decoded(raw: Column) -> Column:
    """The text of bytes: UTF-8 if they are, else UTF-16 in the order that their mark names, or most significant byte first without one; null for an odd number of bytes and for halves of surrogate pairs."""
    start, plain = F.hex(F.substring(raw, 1, 2)), F.try_validate_utf8(raw.cast("string"))
    body = F.when(start.isin("FFFE", "FEFF"), F.substring(raw, 3, 1 << 30)).otherwise(raw)
    even, digits = F.octet_length(raw) % 2 == 0, F.hex(body)
    big = digits.rlike("^(?:(?!D[89A-F])[0-9A-F]{4}|D[89AB][0-9A-F]{2}D[C-F][0-9A-F]{2})*+$")
    little = digits.rlike("^(?:[0-9A-F]{2}(?!D[89A-F])[0-9A-F]{2}|[0-9A-F]{2}D[89AB][0-9A-F]{2}D[C-F])*+$")
    return F.when(plain.isNotNull(), plain).when(even & (start == "FFFE"), F.when(little, F.decode(body, "UTF-16LE"))).when(even & (start != "FFFE"), F.when(big, F.decode(body, "UTF-16BE")))


def filled(x: Column) -> Column:
    """The trimmed value, null if empty."""
    return F.nullif(F.trim(x), F.lit(""))


def places_path(*levels: Column) -> Column:
    """Places/ and the levels that are not empty; null without any."""
    kept = F.filter(F.array(*map(filled, levels)), lambda x: x.isNotNull())
    return F.when(F.size(kept) > 0, F.concat(F.lit("Places/"), F.array_join(kept, "/")))


def trip_title(place: Column, people: Column) -> Column:
    return F.when(place.isNotNull() & people.isNotNull(), F.concat(place, F.lit(" with "), people)).when(place.isNotNull(), F.concat(F.lit("A trip to "), place)).when(people.isNotNull(), F.concat(F.lit("A trip with "), people)).otherwise("A trip")


def short_names(names: Column) -> Column:
    """First names; where several share one and all their last initials differ, each with its initial."""
    tokens = F.transform(names, lambda x: F.filter(F.split(F.trim(x), " "), lambda t: t != ""))
    part = F.transform(tokens, lambda t: F.struct(F.coalesce(F.get(t, F.lit(0)), F.lit("")).alias("first"), F.when(F.size(t) >= 2, F.upper(F.substring(F.element_at(t, -1), 1, 1))).alias("initial")))

    def one(x):
        same = F.filter(part, lambda y: F.lower(y["first"]) == F.lower(x["first"]))
        initials = F.array_distinct(F.filter(F.transform(same, lambda y: y["initial"]), lambda i: i.isNotNull()))
        return F.when((F.size(same) > 1) & (F.size(initials) == F.size(same)), F.concat(x["first"], F.lit(" "), x["initial"], F.lit("."))).otherwise(x["first"])

    return F.transform(part, one)


def file_url(path: Column) -> Column:
    """file:// and the path, with bytes outside the path's allowed characters percent-encoded."""
    coded = F.replace(F.url_encode(path), F.lit("+"), F.lit("%20"))
    for x in "~!$&'()*+,;=:@/":
        coded = F.replace(coded, F.lit(f"%{ord(x):02X}"), F.lit(x))
    return F.concat(F.lit("file://"), F.when(F.startswith(path, F.lit("/")), "").otherwise("/"), coded)


def person(name: Column) -> Column:
    """White space collapsed; null if a name is empty or holds a separator or control character."""
    n = F.trim(F.regexp_replace(name, r"\s+", " "))
    return F.when((n != "") & ~n.rlike(r"[/|\p{Cntrl}]"), n)


def join_names(names: Column) -> Column:
    """A, B & C."""
    n = F.size(names)
    return F.when(n == 0, "").when(n == 1, F.element_at(names, 1)).otherwise(F.concat_ws(" & ", F.array_join(F.slice(names, F.lit(1), F.greatest(n - 1, F.lit(0))), ", "), F.element_at(names, -1)))


def cluster_key(memory_id: Column) -> Column:
    """The trip that a part of a trip belongs to; other ids as they are."""
    p = F.split(memory_id, "-")
    return F.when((F.element_at(p, 1) == "subtrip") & (F.size(p) >= 4), F.concat(F.lit("trip-"), F.array_join(F.slice(p, 2, 3), "-"))).otherwise(memory_id)


@F.pandas_udf(BinaryType())
def float_bytes(v: pd.Series) -> pd.Series:
    """A vector as little-endian 32-bit floats."""
    return v.map(lambda x: None if x is None else np.asarray(x, dtype="<f4").tobytes())


FNV_START, FNV_PRIME = 0xCBF29CE484222325, 0x100000001B3  #: fixed values of FNV-1a
GAMMA, MIX_A, MIX_B = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)  #: fixed values of SplitMix64


def splitmix(state: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(next states, draws) of many generators."""
    with np.errstate(over="ignore"):
        state = state + GAMMA
        z = (state ^ (state >> np.uint64(30))) * MIX_A
        z = (z ^ (z >> np.uint64(27))) * MIX_B
    return state, z ^ (z >> np.uint64(31))


def draws(seed: Column, n: int, width: float) -> Column:
    """The first n numbers in [0, width) of the generator that the text seeds: FNV-1a, then SplitMix64's low 53 bits."""

    @F.pandas_udf(ArrayType(DoubleType()))
    def run(hashes: pd.Series) -> pd.Series:
        state = np.array([int(x, 16) or 0xDEADBEEF for x in hashes], dtype=np.uint64)
        out = np.empty((len(state), n))
        for k in range(n):
            state, z = splitmix(state)
            out[:, k] = width * ((z & np.uint64((1 << 53) - 1)).astype(float) * 2.0**-53)
        return pd.Series(list(out))

    return run(fnv1a(seed))


def seed_state(seed: str) -> int:
    """The generator's state after seeding with one text."""
    s = FNV_START
    for b in seed.encode():
        s = (s ^ b) * FNV_PRIME % (1 << 64)
    return s or 0xDEADBEEF


def nth_draw(seed: str, place: Column, width: float) -> Column:
    """The draw at a place (from 0) of the generator that one text seeds: its states are evenly spaced, so any draw is reached at once."""
    first = np.uint64(seed_state(seed))

    @F.pandas_udf(DoubleType())
    def run(at: pd.Series) -> pd.Series:
        with np.errstate(over="ignore"):
            _, z = splitmix(first + GAMMA * at.to_numpy().astype(np.uint64))
        return pd.Series(width * ((z & np.uint64((1 << 53) - 1)).astype(float) * 2.0**-53))

    return run(place.cast("long"))


def permutation(n: int, seed: int) -> list[int]:
    """A fixed shuffle of 0 .. n - 1: from the last place down, each swapped with one drawn among those up to it."""
    order, state = list(range(n)), np.array([seed], dtype=np.uint64)
    for i in range(n - 1, 0, -1):
        state, z = splitmix(state)
        j = int(z[0]) % (i + 1)
        order[i], order[j] = order[j], order[i]
    return order


@F.pandas_udf(StringType())
def fnv1a(s: pd.Series) -> pd.Series:
    """64-bit FNV-1a of the UTF-8 bytes: byte by byte over all rows of a batch that still have one."""
    raw = [(x or "").encode() for x in s]
    h = np.full(len(raw), FNV_START, dtype=np.uint64)
    on, j = np.flatnonzero([len(x) > 0 for x in raw]), 0
    while len(on):
        byte = np.fromiter((raw[i][j] for i in on), dtype=np.uint64, count=len(on))
        h[on] = (h[on] ^ byte) * np.uint64(FNV_PRIME)
        j += 1
        on = on[[len(raw[i]) > j for i in on]]
    return pd.Series([f"{x:016x}" for x in h.tolist()])
