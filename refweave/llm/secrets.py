"""Secrets in texts: all rules compiled to one automaton that reads each text's bytes once.

Where the automaton says that a rule's mark or least match ends, the mark's length or a second automaton that reads
backward gives the start, and a third reads on from there for the end. Base rules give the contract's spans; further rules, for tokens with a form of their own, add
spans and take none away.

Defined results: a null text is empty; repeated rows are scanned as often as they occur; ties at one start go to the
kind listed first; an empty table gives an empty result; further columns pass through `with_spans` unless they bear the
name of the column that it adds, which then replaces them. Positions are code points, ends exclusive. A very long text is
scanned whole, in time linear in its length (`Scanner.onward` says why); a worker holds one Arrow batch.
"""

from __future__ import annotations

from array import array
from collections.abc import Callable, Iterator
from functools import cache
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .automaton import compile_rules
from .common import private, runs, text_of


class Rule(NamedTuple):
    """kind; pattern of the whole match; whether a match counts; a beginning of fixed length, if all matches have one."""

    kind: str
    pattern: str
    holds: Callable[[bytes], bool]
    mark: str = ""
    mark_bytes: int = 0


NAME = r"(password|passwd|secret|token|api_?key)"
BODY = "[A-Za-z0-9+/_.=-]"


def long_value(match: bytes) -> bool:
    """Whether what follows the first : or = of an assignment, without blanks and an opening quote, has 12 bytes."""
    at = min(i for i in (match.find(b":"), match.find(b"=")) if i >= 0)
    value = match[at + 1 :].lstrip(b" ")
    return len(value) - value.startswith((b'"', b"'")) >= 12


#: The base (fixed values of the contract).
BASE = (
    Rule("assign", rf"(?i){NAME}[\"']?\x20*[:=]\x20*[\"']?{BODY}+", long_value),
    Rule("access", "AKIA[A-Z0-9]+", lambda m: len(m) >= 18, "AKIA", 4),
    Rule("hex", "[0-9a-f]+", lambda m: len(m) >= 16),
)
#: Tokens that carry their own mark; their spans come on top.
MORE = (
    Rule("github", "gh[pousr]_[A-Za-z0-9]{36,}", bool, "gh[pousr]_", 4),
    Rule("slack", "xox[abprs]-[A-Za-z0-9-]{10,}", bool, "xox[abprs]-", 5),
    Rule("google", "AIza[A-Za-z0-9_-]{35}", bool, "AIza", 4),
    Rule("stripe", "[sr]k_(live|test)_[A-Za-z0-9]{16,}", bool, "[sr]k_(live|test)_", 8),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{10,}\.eyJ[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}", bool, "eyJ", 3),
    Rule("private_key", "-----BEGIN [A-Z ]*PRIVATE KEY-----", bool, "-----BEGIN ", 11),
)
RULES = BASE + MORE
#: What the one pass looks for, where not the rule's mark or whole pattern: short hex runs are too common to stop at.
SCAN = {"hex": "[0-9a-f]{16}"}


class Scanner:
    """The automata, with transitions as rows of rows: a state is the list of the states that each byte leads to."""

    def __init__(self, rules: tuple[Rule, ...] = RULES):
        self.rules = rules
        self.all = compile_rules([SCAN.get(r.kind) or r.mark or r.pattern for r in rules], anywhere=True)
        self.forward = [compile_rules([r.pattern], anywhere=False) for r in rules]
        self.backward = [compile_rules([r.pattern], anywhere=False, backward=True) for r in rules]
        n = len(self.all.accepts)
        hits = self.all.accepts
        self.rows: list[list] = [[None] * 256 for _ in range(n)]
        self.number = {id(row): i for i, row in enumerate(self.rows)}
        for row, to in zip(self.rows, self.all.next.tolist(), strict=True):
            row[:] = [None if hits[t] else self.rows[t] for t in to]
        self.next, self.hits = self.all.next.tolist(), hits.tolist()
        self.ahead = [(d.next.tolist(), d.accepts.tolist(), d.start, d.dead) for d in self.forward]
        self.back = [(d.next.tolist(), d.accepts.tolist(), d.start, d.dead) for d in self.backward]

    def onward(self, k: int, data: bytes, start: int, failed: list[tuple[int, array]]) -> int | None:
        """How many bytes from `start` rule k's longest match takes.

        Scans that found none leave their states in `failed`; a later one that comes into the same state at the same place
        can find none either. So a place is passed once a state at most, and the time is linear in the text.
        """
        table, accepts, state, dead = self.ahead[k]
        failed[:] = [f for f in failed if f[0] + len(f[1]) > start]
        best, path = None, array("H")
        for i in range(start, len(data)):
            state = table[state][data[i]]
            if state == dead:
                break
            if accepts[state]:
                best = i + 1 - start
            elif best is None:
                if any(0 <= i - first < len(states) and states[i - first] == state for first, states in failed):
                    break
                path.append(state)
        if best is None and path:
            failed.append((start, path))
        return best

    @staticmethod
    def reach(machine: tuple, data: bytes, positions: range) -> int | None:
        """How many bytes of `positions` the longest match takes."""
        table, accepts, state, dead = machine
        best = None
        for n, i in enumerate(positions, 1):
            state = table[state][data[i]]
            if state == dead:
                break
            if accepts[state]:
                best = n
        return best

    def spans(self, data: bytes) -> list[tuple[int, int, int]]:
        """(start, rule, end) in bytes, by start, then rule. Each rule's matches don't overlap; failing ones are dropped."""
        found: list[tuple[int, int, int]] = []
        upto, failed = [0] * len(self.rules), [[] for _ in self.rules]
        state, at, n = self.all.start, 0, len(data)
        hits, table = self.hits, self.next
        while at < n:
            if not hits[state]:
                at, state = self.run(data, at, state)
                if at >= n and not hits[state]:
                    break
            else:
                state = table[state][data[at]]
                at += 1
            mask = hits[state]
            while mask:
                k = (mask & -mask).bit_length() - 1
                mask &= mask - 1
                if at > upto[k]:
                    self.take(data, at, k, upto, found, failed[k])
        return sorted(found)

    def run(self, data: bytes, at: int, state: int) -> tuple[int, int]:
        """Read on from `at` to just after the first byte that leads to a state where a rule ends, or to the end."""
        row, before = self.rows[state], self.rows[state]
        left = memoryview(data)[at:] if at else data
        k = -1
        for k, b in enumerate(left):  # noqa: B007
            before = row
            row = row[b]
            if row is None:
                return at + k + 1, self.next[self.number[id(before)]][b]
        return len(data), self.number[id(row)]

    def take(self, data: bytes, at: int, k: int, upto: list[int], found: list, failed: list) -> None:
        back = self.rules[k].mark_bytes or self.reach(self.back[k], data, range(at - 1, upto[k] - 1, -1))
        if back is None or at - back < upto[k]:
            return
        start = at - back
        length = self.onward(k, data, start, failed)
        if length is None:
            return
        end = start + length
        upto[k] = end
        if self.rules[k].holds(data[start:end]):
            found.append((start, k, end))


@cache
def scanner() -> Scanner:
    return Scanner()


def in_code_points(data: bytes, spans: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    if data.isascii() or not spans:
        return spans
    place, last, seen = {}, 0, 0
    for p in sorted({x for s, _, e in spans for x in (s, e)}):
        seen += len(data[last:p].decode())
        last, place[p] = p, seen
    return [(place[s], k, place[e]) for s, k, e in spans]


def find(text: str | None) -> list[tuple[int, int, int]]:
    """(start, rule, end) in code points."""
    data = (text or "").encode()
    return in_code_points(data, scanner().spans(data))


def with_spans(docs: DataFrame, text: str = "text") -> DataFrame:
    """`docs` with secret_spans, an array of (start, kind, end)."""
    docs = docs.drop("secret_spans")
    t = private(docs, "_t")
    docs = docs.withColumn(t, text_of(text))
    kind = T.ArrayType(T.StructType([T.StructField("start", T.IntegerType()), T.StructField("kind", T.StringType()), T.StructField("end", T.IntegerType())]))
    schema = T.StructType([f for f in docs.schema.fields if f.name != t] + [T.StructField("secret_spans", kind)])

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rest = [name for name in batch.schema.names if name != t]
            for a, b in runs(batch.column(t)):
                spans = [[{"start": s, "kind": RULES[k].kind, "end": e} for s, k, e in find(x)] for x in batch.column(t).slice(a, b - a).to_pylist()]
                made = pa.array(spans, pa.list_(pa.struct([("start", pa.int32()), ("kind", pa.string()), ("end", pa.int32())])))
                yield pa.RecordBatch.from_arrays([*[batch.column(c).slice(a, b - a) for c in rest], made], [*rest, "secret_spans"])

    return docs.mapInArrow(scan, schema)


def digest(docs: DataFrame) -> DataFrame:
    kinds = [r.kind for r in BASE]
    found = with_spans(docs.select("doc_id", "text")).drop("text")
    of = F.array(*[F.lit(r.kind) for r in RULES])
    line = lambda spans: F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")
    base = F.filter("secret_spans", lambda x: F.array_position(of, x["kind"]) <= len(BASE))
    count = lambda k: F.size(F.filter("secret_spans", lambda x: x["kind"] == k)).cast("long").alias(f"n_{k}")
    return found.select("doc_id", *[count(k) for k in kinds], F.sha2(line(base), 256).alias("base_sha256"), line(F.col("secret_spans")).alias("spans"))
