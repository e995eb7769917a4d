"""Secret scans by a trigram index: postings narrow the texts that each rule is run on.

Each rule's regular expression is parsed into a Boolean query over trigrams (AND of ORs) that every
matching text satisfies, letter case folded. Each slice of texts gets postings (trigram to texts) for
the trigrams that some rule asks for; a rule's postings are intersected and united by its query, and
the rule runs on the texts that are left. A rule without mandatory trigrams scans all texts; where
it is one class of ASCII characters repeated n times or more, that scan looks for such runs over
the bytes and runs the rule on texts that have one. The index is sharded by document, as each
slice's postings stay with its texts, so nothing is shuffled and no row is held back.

Matches are leftmost and non-overlapping per rule, and one that is too short is dropped. Offsets are code
points, ends exclusive. Nulls: a null text is empty and has no spans; other columns may be null. Empty
tables give empty results. Repeated rows each get their own result.
"""

from __future__ import annotations

import re
from re import _constants as sre
from re import _parser as sre_parser
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from heliograph.llm import _words
from heliograph.session import ship_package


class Rule(NamedTuple):
    kind: str
    pattern: str
    group: int = 0  #: whose length counts
    least: int = 0  #: code points of that group


#: The kinds of the contract.
BASE_RULES = (
    Rule("assign", r"(?ai)(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", 2, 6),
    Rule("access", r"AKIA[A-Z0-9]+", 0, 20),
    Rule("hex", r"[0-9a-f]{24,}", 0, 24),
)
#: Well-known shapes of other credentials.
MORE_RULES = (
    Rule("private_key", r"-----BEGIN [A-Z ]{0,40}PRIVATE KEY-----"),
    Rule("github", r"(?:ghp|gho|ghu|ghs|ghr)_[A-Za-z0-9]{36,}"),
    Rule("slack", r"xox[baprs]-[A-Za-z0-9-]{10,}"),
    Rule("google", r"AIza[A-Za-z0-9_-]{35,}"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{10,}\.eyJ[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{5,}"),
    Rule("url_login", r"://[^\s:/@]{1,200}:[^\s:/@]{1,200}@"),
)
RULES = BASE_RULES + MORE_RULES
MOST_STRINGS = 64


def _and(parts: list):
    parts = [p for p in parts if p is not True]
    return True if not parts else parts[0] if len(parts) == 1 else ("and", *parts)


def _or(parts: list):
    parts = list(dict.fromkeys(parts))
    return True if not parts or True in parts else parts[0] if len(parts) == 1 else ("or", *parts)


def _strings_query(strings: set[str]):
    """What a text with one of the strings has: its trigrams, folded, as bytes."""
    raw = [s.lower().encode() if s.isascii() else s.encode() for s in sorted(strings)]
    return _or([_and([x[i : i + 3] for i in range(len(x) - 2)]) for x in raw])


def _exact(node) -> set[str] | None:
    """The strings that an item of a parsed expression matches, if they are few; None if not."""
    op, arg = node
    if op is sre.LITERAL:
        return {chr(arg)}
    if op is sre.IN:
        out = set()
        for kind, x in arg:
            if kind is sre.LITERAL:
                out.add(chr(x))
            elif kind is sre.RANGE and x[1] - x[0] < 8:
                out.update(map(chr, range(x[0], x[1] + 1)))
            else:
                return None
        return out if len(out) <= 8 else None
    if op is sre.SUBPATTERN:
        return _exact_all(arg[-1])
    if op is sre.BRANCH:
        every = [_exact_all(x) for x in arg[1]]
        return None if None in every else set().union(*every)
    if op in (sre.MAX_REPEAT, sre.MIN_REPEAT) and arg[1] <= 4:
        inner, out = _exact_all(arg[2]), set()
        if inner is None:
            return None
        run = {""}
        for n in range(arg[1] + 1):
            out |= run if n >= arg[0] else set()
            run = {a + b for a in run for b in inner}
            if len(run) > MOST_STRINGS:
                return None
        return out
    if op is sre.AT:
        return {""}
    return None


def _exact_all(items) -> set[str] | None:
    out = {""}
    for x in items:
        e = _exact(x)
        if e is None or len(out) * len(e) > MOST_STRINGS:
            return None
        out = {a + b for a in out for b in e}
    return out


def _query_all(items):
    """A query that each text matching the sequence satisfies; True if there is none."""
    parts, run = [], {""}
    for x in items:
        e = _exact(x)
        if e is not None and len(run) * len(e) <= MOST_STRINGS:
            run = {a + b for a in run for b in e}
            continue
        parts.append(_strings_query(run))
        run = e if e is not None and len(e) <= MOST_STRINGS else {""}
        if e is None:
            op, arg = x
            if op is sre.SUBPATTERN:
                parts.append(_query_all(arg[-1]))
            elif op is sre.BRANCH:
                parts.append(_or([_query_all(b) for b in arg[1]]))
            elif op in (sre.MAX_REPEAT, sre.MIN_REPEAT) and arg[0] >= 1:
                parts.append(_query_all(arg[2]))
    parts.append(_strings_query(run))
    return _and(parts)


def trigram_query(pattern: str):
    """True, a trigram (bytes), or ("and" | "or", ...) of such."""
    return _query_all(sre_parser.parse(pattern))


def class_run(pattern: str) -> tuple[np.ndarray, int] | None:
    """(ASCII members, least length) of a pattern that is one class of ASCII characters repeated."""
    items = list(sre_parser.parse(pattern))
    if len(items) != 1 or items[0][0] is not sre.MAX_REPEAT or items[0][1][0] < 1:
        return None
    low, _, inner = items[0][1]
    if len(inner) != 1 or inner[0][0] is not sre.IN:
        return None
    member = np.zeros(256, dtype=bool)
    for kind, x in inner[0][1]:
        if kind is sre.LITERAL and x < 128:
            member[x] = True
        elif kind is sre.RANGE and x[1] < 128:
            member[x[0] : x[1] + 1] = True
        else:
            return None
    return (member, low) if not member[10] else None


def _leaves(q) -> set[bytes]:
    return set() if q is True else {q} if isinstance(q, bytes) else set().union(*map(_leaves, q[1:]))


def _lookup(q, postings: dict) -> np.ndarray:
    if isinstance(q, bytes):
        return postings.get(q, np.zeros(0, dtype=np.int64))
    lists = [_lookup(x, postings) for x in q[1:]]
    out = lists[0]
    for x in lists[1:]:
        out = np.intersect1d(out, x, assume_unique=True) if q[0] == "and" else np.union1d(out, x)
    return out


class Scanner:
    """The rules with their queries, ready for slices of texts."""

    def __init__(self, rules=RULES):
        for r in rules:
            flags = re.compile(r.pattern).flags
            if flags & re.IGNORECASE and not flags & re.ASCII:  # some other letters fold to ASCII ones, which bytes of trigrams miss
                raise ValueError(f"{r.kind}: a pattern that ignores case needs (?a)")
        self.rules = [(r, re.compile(r.pattern), trigram_query(r.pattern), class_run(r.pattern)) for r in rules]
        self.grams = sorted(set().union(*(_leaves(q) for _, _, q, _ in self.rules)))
        self.table = np.zeros(1 << 24, dtype=np.uint16)
        for i, g in enumerate(self.grams):
            self.table[int.from_bytes(g, "big")] = i + 1

    def postings(self, buf: np.ndarray, at: np.ndarray) -> dict:
        code = buf[:-2].astype(np.uint32)
        code <<= np.uint32(8)
        code |= buf[1:-1]
        code <<= np.uint32(8)
        code |= buf[2:]
        found = self.table[code]
        hit = np.flatnonzero(found)
        gram, doc = found[hit].astype(np.int64), np.searchsorted(at, hit, "right") - 1
        pairs = np.unique(gram * (len(at) + 1) + np.maximum(doc, 0))
        gram, doc = pairs // (len(at) + 1), pairs % (len(at) + 1)
        edge = np.searchsorted(gram, np.arange(1, len(self.grams) + 2))
        return {g: doc[edge[i] : edge[i + 1]] for i, g in enumerate(self.grams)}

    def spans(self, raw: list[bytes]) -> list[list[tuple[str, int, int]]]:
        """Per text (kind, start, end), by start and then the rules' order."""
        joined = b"\n" + b"\n".join(raw) + b"\n\n"
        buf = np.frombuffer(joined.translate(_words.LOWER), dtype=np.uint8)
        plain = np.frombuffer(joined, dtype=np.uint8)
        at = np.concatenate([[0], np.cumsum([len(x) + 1 for x in raw])])[: len(raw)] + 1
        postings, found, texts = self.postings(buf, at), {}, {}
        for n, (rule, rx, query, run) in enumerate(self.rules):
            if query is not True:
                docs = _lookup(query, postings)
            elif run is not None:
                edge = np.flatnonzero(np.diff(run[0][plain].view(np.int8))) + 1
                docs = np.unique(np.searchsorted(at, edge[0::2][edge[1::2] - edge[0::2] >= run[1]], "right") - 1)
            else:
                docs = np.arange(len(raw))
            for d in docs.tolist():
                if d not in texts:
                    texts[d] = raw[d].decode("utf-8", "replace")
                for m in rx.finditer(texts[d]):
                    if m.end(rule.group) - m.start(rule.group) >= rule.least:
                        found.setdefault(d, []).append((m.start(), n, m.end()))
        return [[(self.rules[n][0].kind, s, e) for s, n, e in sorted(found.get(d, ()))] for d in range(len(raw))]


_SPANS = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))


def find_secrets(documents: DataFrame, rules=RULES) -> DataFrame:
    """doc_id and spans array<struct<kind, start, end>> of each row of documents(doc_id, text)."""
    ship_package(documents.sparkSession)

    def run(batches):
        scanner = Scanner(rules)
        for batch in batches:
            raw, spans = _words.rows_of(batch, "text"), []
            for lo, hi in _words.slices([len(x) for x in raw]):
                spans += scanner.spans(raw[lo:hi])
            spans = [[{"kind": k, "start": s, "end": e} for k, s, e in x] for x in spans]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(spans, type=_SPANS)], names=["doc_id", "spans"])

    return documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, spans array<struct<kind:string,start:long,end:long>>")


def redact_secrets(documents: DataFrame, mask: str = "[SECRET]", rules=RULES) -> DataFrame:
    """documents with each stretch of overlapping spans in text replaced by the mask; other columns as they are."""
    ship_package(documents.sparkSession)

    def run(batches):
        scanner = Scanner(rules)
        for batch in batches:
            raw, out = _words.rows_of(batch, "text"), batch.column("text").to_pylist()
            at = 0
            for lo, hi in _words.slices([len(x) for x in raw]):
                for i, spans in enumerate(scanner.spans(raw[lo:hi]), lo):
                    if spans:
                        parts, at = [], 0
                        for _, s, e in spans:
                            if s >= at:
                                parts += [out[i][at:s], mask]
                            at = max(at, e)
                        out[i] = "".join([*parts, out[i][at:]])
            k = batch.schema.get_field_index("text")
            yield batch.set_column(k, batch.schema.field(k), pa.array(out, type=batch.schema.field(k).type))

    return documents.mapInArrow(run, documents.schema)


def spans_text(spans: Column) -> Column:
    """kind:start:end, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
