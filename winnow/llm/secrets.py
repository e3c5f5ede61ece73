"""Secret scanning with a trigram inverted index.

From each rule's parsed pattern a Boolean query of trigrams follows that any matching text must satisfy. Each
block of texts is indexed: postings of those trigrams that some rule asks for. A rule's query is evaluated by
intersecting and uniting postings, and its pattern is run over the candidates alone. Rules from whose pattern no
mandatory trigram follows are run over every text. The index lives as long as its block: nothing is shuffled.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from functools import lru_cache
from re import _constants as C
from re import _parser as P

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from winnow.llm.shared import map_batches
from winnow.llm.textscan import LOWER, blocks, utf8

#: Strings that a piece of a pattern is followed as exactly.
MAX_EXACT = 64


def _either_case(word: str) -> str:
    return "".join(f"[{c}{c.upper()}]" if c.isalpha() else c for c in word)


@dataclass(frozen=True)
class Rule:
    kind: str
    pattern: str
    #: The group whose length must reach ``least`` code points; matches that fail are dropped.
    group: int = 0
    least: int = 0


_NAMES = "|".join(map(_either_case, ("password", "passwd", "secret", "token"))) + f"|{_either_case('api')}_?{_either_case('key')}"
BASE = (
    Rule("assign", rf"""({_NAMES})["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 12),
    Rule("access", r"AKIA[A-Z0-9]+", 0, 18),
    # A maximal run of 16 or more is the same as a match of [0-9a-f]+ that has 16 or more.
    Rule("hex", r"[0-9a-f]{16,}"),
)
MORE = (
    Rule("github", r"gh[oprsu]_[A-Za-z0-9]{36,}"),
    Rule("google", r"AIza[A-Za-z0-9_-]{35}"),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    # Where no token stands at the first eyJ of a run, none stands further on in it: the second branch, which has no
    # group and is dropped, passes the run, so that many eyJ in one run cost no more than one.
    Rule("jwt", r"(eyJ[A-Za-z0-9_-]{10,}+\.[A-Za-z0-9_-]{10,}+\.[A-Za-z0-9_-]{10,}+)|eyJ[A-Za-z0-9_-]*+", 1, 1),
    Rule("pem", r"-----BEGIN [A-Z ]*PRIVATE KEY-----"),
)
RULES = BASE + MORE

#: A query is None (no demand), a trigram, or ("and" | "or", queries).
Query = None | bytes | tuple


def _both(kind: str, parts: Iterable[Query]) -> Query:
    parts = list(dict.fromkeys(parts))
    if kind == "or" and (None in parts or not parts):
        return None
    parts = [p for p in parts if p is not None]
    return parts[0] if len(parts) == 1 else (kind, tuple(parts)) if parts else None


def _of_strings(strings: set[str]) -> Query:
    def one(s: str) -> Query:
        b = s.encode()
        return _both("and", [b[i : i + 3] for i in range(len(b) - 2)])

    return _both("or", sorted((one(s) for s in strings), key=repr))


def _fold(c: str) -> str:
    return c.lower() if c.isascii() else c


def _walk(items) -> tuple[set[str] | None, Query]:
    """Of a sequence: all the folded strings it can match, if few, and else a query that its matches satisfy."""
    run: set[str] = {""}
    exact, queries = True, []
    for op, arg in items:
        strings, query = _node(op, arg)
        if strings is not None and len(run) * len(strings) <= MAX_EXACT:
            run = {a + b for a in run for b in strings}
            continue
        queries += [_of_strings(run), query]
        exact, run = False, {""}
        if strings is not None:
            run = strings
    return (run, None) if exact else (None, _both("and", [*queries, _of_strings(run)]))


def _node(op, arg) -> tuple[set[str] | None, Query]:
    if op is C.LITERAL:
        return {_fold(chr(arg))}, None
    if op is C.AT:
        return {""}, None
    if op is C.IN:
        chars: set[str] = set()
        for kind, x in arg:
            if kind is C.LITERAL:
                chars.add(_fold(chr(x)))
            elif kind is C.RANGE and x[1] - x[0] < 8:
                chars |= {_fold(chr(c)) for c in range(x[0], x[1] + 1)}
            else:
                return None, None
        return (chars, None) if len(chars) <= 8 else (None, None)
    if op is C.SUBPATTERN:
        return _walk(arg[3])
    if op is C.BRANCH:
        each = [_walk(branch) for branch in arg[1]]
        union = set().union(*(s or () for s, _ in each))
        if all(s is not None for s, _ in each) and len(union) <= MAX_EXACT:
            return union, None
        return None, _both("or", [_of_strings(s) if s is not None else q for s, q in each])
    if op in (C.MAX_REPEAT, C.MIN_REPEAT, C.POSSESSIVE_REPEAT):
        low, high, body = arg
        strings, query = _walk(body)
        if strings is not None and high == 1:
            return strings | {""}, None
        if strings is not None and low == high and len(strings) ** low <= MAX_EXACT:
            return _walk(list(body) * low)
        return None, (_of_strings(strings) if strings is not None else query) if low else None
    return None, None


def trigram_query(pattern: str) -> Query:
    """What trigrams (of text with A-Z folded, in UTF-8) a match of ``pattern`` must hold; None if none follow."""
    strings, query = _walk(P.parse(pattern))
    return _of_strings(strings) if strings is not None else query


def _trigrams(query: Query) -> set[bytes]:
    return {query} if isinstance(query, bytes) else set().union(*map(_trigrams, query[1])) if query else set()


class TrigramIndex:
    """Postings, by row of a block, of the trigrams that ``wanted`` names."""

    def __init__(self, column: pa.Array, wanted: dict[bytes, int], slots: np.ndarray):
        data, at = utf8(column)
        b = LOWER[data].astype(np.uint32)
        code = (b[:-2] << 16) | (b[1:-1] << 8) | b[2:]
        place = np.flatnonzero(slots[code]) if len(b) > 2 else np.zeros(0, np.int64)
        doc = np.searchsorted(at, place, "right") - 1
        own = place + 2 < at[doc + 1]  # not across the end of a text
        doc, slot = doc[own], slots[code[place[own]]].astype(np.int64)
        pairs = np.unique(slot * len(at) + doc)
        self.n, self._slot, self._doc, self.wanted = len(at) - 1, pairs // len(at), pairs % len(at), wanted

    def postings(self, trigram: bytes) -> np.ndarray:
        low, high = np.searchsorted(self._slot, [self.wanted[trigram], self.wanted[trigram] + 1])
        return self._doc[low:high]

    def candidates(self, query: Query) -> np.ndarray:
        if query is None:
            return np.arange(self.n)
        if isinstance(query, bytes):
            return self.postings(query)
        found = self.candidates(query[1][0])
        for part in query[1][1:]:
            if query[0] == "and" and not len(found):
                break
            found = (np.intersect1d if query[0] == "and" else np.union1d)(found, self.candidates(part))
        return found


@lru_cache(maxsize=4)
def _plan(rules: tuple[Rule, ...]):
    queries = [trigram_query(r.pattern) for r in rules]
    wanted = {t: i + 1 for i, t in enumerate(sorted(set().union(*map(_trigrams, queries))))}
    slots = np.zeros(1 << 24, dtype=np.uint16)
    for t, i in wanted.items():
        slots[int.from_bytes(t, "big")] = i
    return queries, wanted, slots, [re.compile(r.pattern) for r in rules]


def find(column: pa.Array, rules: tuple[Rule, ...] = RULES) -> list[list[tuple[int, int, int]]]:
    """For each text the (start, rule number, end) of each match, sorted; offsets count code points."""
    queries, wanted, slots, patterns = _plan(rules)
    index = TrigramIndex(column, wanted, slots)
    texts = column.to_pylist()
    found: list[list[tuple[int, int, int]]] = [[] for _ in texts]
    for k, (rule, query, pattern) in enumerate(zip(rules, queries, patterns, strict=True)):
        for i in index.candidates(query):
            for m in pattern.finditer(texts[i] or ""):
                if m.end(rule.group) - m.start(rule.group) >= rule.least:
                    found[i].append((m.start(), k, m.end()))
    return [sorted(x) for x in found]


SPANS = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))


def scan(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """(doc_id, spans) of each row: every match of every rule, by start and then by the order of the rules.

    A null or empty text has no spans; repeated rows are scanned as often as they come.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in blocks(batch):
                spans = [[{"kind": rules[k].kind, "start": a, "end": b} for a, k, b in row] for row in find(part.column(1), rules)]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(spans, SPANS)], names=["doc_id", "spans"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return map_batches(docs.select("doc_id", "text"), run, f"doc_id {kind}, spans array<struct<kind:string,start:bigint,end:bigint>>")


def mask(docs: DataFrame, rules: tuple[Rule, ...] = RULES, shown: str = "[SECRET]") -> DataFrame:
    """``docs`` with each matched span of ``text`` replaced by ``shown``; spans that overlap are replaced as one.

    A null text stays null and an empty one empty; all other columns and repeated rows stay as they are, and no rows
    give none.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = batch.schema.get_field_index("text")
            for part in blocks(batch):
                texts = part.column(at).to_pylist()
                for i, spans in enumerate(find(part.column(at), rules)):
                    done, end = [], 0
                    for a, _, b in spans:
                        if a >= end:
                            done += [texts[i][end:a], shown]
                        end = max(end, b)
                    if spans:
                        texts[i] = "".join([*done, texts[i][end:]])
                yield part.set_column(at, part.schema.field(at), pa.array(texts, part.schema.field(at).type))

    return map_batches(docs, run, docs.schema)


def report(docs: DataFrame) -> DataFrame:
    """(doc_id, n_assign, n_access, n_hex, base_sha256, spans) of each row."""
    base = [r.kind for r in BASE]
    line = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    of = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return scan(docs).select("doc_id", *map(of, base), F.sha2(line(F.filter("spans", lambda s: s["kind"].isin(base))), 256).alias("base_sha256"), line(F.col("spans")).alias("spans"))
