"""Regular expressions over bytes, compiled to one minimised deterministic automaton.

The syntax is what the rules need: literals, classes `[...]` with ranges, groups, `|`, `?`, `*`, `+`, `{m}`, `{m,}`, and
`(?i)` at the start for letters in either case.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np

ANY = frozenset(range(256))


@dataclass
class Nfa:
    """edges[s]: (bytes, target) pairs; free[s]: targets that take no byte."""

    edges: list[list[tuple[frozenset[int], int]]] = field(default_factory=list)
    free: list[list[int]] = field(default_factory=list)

    def new(self) -> int:
        self.edges.append([])
        self.free.append([])
        return len(self.edges) - 1


class Parser:
    """Recursive descent: pattern text to syntax tree of tuples."""

    def __init__(self, pattern: str):
        self.either = pattern.startswith("(?i)")
        self.text, self.at = pattern.removeprefix("(?i)"), 0

    def peek(self) -> str:
        return self.text[self.at : self.at + 1]

    def take(self) -> str:
        self.at += 1
        return self.text[self.at - 1]

    def whole(self) -> tuple:
        tree = self.choice()
        if self.at != len(self.text):
            raise ValueError(f"cannot read {self.text!r} from {self.at}")
        return tree

    def choice(self) -> tuple:
        parts = [self.chain()]
        while self.peek() == "|":
            self.take()
            parts.append(self.chain())
        return parts[0] if len(parts) == 1 else ("or", parts)

    def chain(self) -> tuple:
        parts = []
        while self.peek() not in ("", "|", ")"):
            parts.append(self.repeated())
        return ("then", parts)

    def repeated(self) -> tuple:
        one = self.atom()
        while self.peek() and self.peek() in "?*+{":
            c = self.take()
            if c == "{":
                end = self.text.index("}", self.at)
                low, comma, high = self.text[self.at : end].partition(",")
                self.at = end + 1
                one = ("times", one, int(low), (int(high) if high else None) if comma else int(low))
            else:
                one = ("times", one, int(c == "+"), 1 if c == "?" else None)
        return one

    def byte(self, c: str) -> frozenset[int]:
        if c == "\\":
            c = self.take()
            if c == "x":
                c = chr(int(self.take() + self.take(), 16))
        return frozenset({ord(c)} | ({ord(c.lower()), ord(c.upper())} if self.either and c.isalpha() else set()))

    def atom(self) -> tuple:
        c = self.take()
        if c == "(":
            tree = self.choice()
            self.take()
            return tree
        if c == ".":
            return ("set", ANY)
        if c != "[":
            return ("set", self.byte(c))
        found: set[int] = set()
        negated = self.peek() == "^"
        self.at += negated
        while self.peek() != "]":
            low = self.byte(self.take())
            if self.peek() == "-" and self.text[self.at + 1] != "]":
                self.take()
                high = self.byte(self.take())
                span = range(min(low) if len(low) == 1 else max(low), max(high) + 1)
                found |= set(span) | ({ord(chr(b).swapcase()) for b in span if chr(b).isalpha() and b < 128} if self.either else set())
            else:
                found |= low
        self.take()
        return ("set", ANY - found if negated else frozenset(found))


def build(nfa: Nfa, tree: tuple, start: int, backward: bool = False) -> int:
    """Add the tree to the automaton from state `start`; the state where it ends. backward: for texts read from the end."""
    if tree[0] == "set":
        end = nfa.new()
        nfa.edges[start].append((tree[1], end))
        return end
    if tree[0] == "then":
        for part in reversed(tree[1]) if backward else tree[1]:
            start = build(nfa, part, start, backward)
        return start
    if tree[0] == "or":
        end = nfa.new()
        for part in tree[1]:
            own = nfa.new()
            nfa.free[start].append(own)
            nfa.free[build(nfa, part, own, backward)].append(end)
        return end
    _, one, low, high = tree
    for _ in range(low):
        start = build(nfa, one, start, backward)
    if high is None:
        loop = nfa.new()
        nfa.free[start].append(loop)
        nfa.free[build(nfa, one, loop, backward)].append(loop)
        return loop
    ends = [start]
    for _ in range(high - low):
        start = build(nfa, one, start, backward)
        ends.append(start)
    end = nfa.new()
    for s in ends:
        nfa.free[s].append(end)
    return end


@dataclass
class Dfa:
    """next: transitions by state and byte; accepts: bit set of the rules that end there; dead: no rule can follow."""

    next: np.ndarray
    accepts: np.ndarray
    start: int
    dead: int | None


def compile_rules(patterns: list[str], anywhere: bool, backward: bool = False) -> Dfa:
    """Subset construction over all rules at once, then minimisation. anywhere: matches may start at each byte."""
    nfa = Nfa()
    root = nfa.new()
    final: dict[int, int] = {}
    for k, pattern in enumerate(patterns):
        own = nfa.new()
        nfa.free[root].append(own)
        end = build(nfa, Parser(pattern).whole(), own, backward)
        final[end] = final.get(end, 0) | 1 << k
    # Bytes that no rule tells apart share a class.
    sets = list({bytes_ for edges in nfa.edges for bytes_, _ in edges})
    kinds: dict[tuple[bool, ...], int] = {}
    of_byte = np.array([kinds.setdefault(tuple(b in s for s in sets), len(kinds)) for b in range(256)])
    some = [int(np.argmax(of_byte == c)) for c in range(len(kinds))]

    def closed(states: set[int]) -> frozenset[int]:
        todo, seen = list(states), set(states)
        while todo:
            for t in nfa.free[todo.pop()]:
                if t not in seen:
                    seen.add(t)
                    todo.append(t)
        return frozenset(s for s in seen if nfa.edges[s] or s in final)

    base = closed({root})
    known, order, rows = {base: 0}, [base], []
    for states in order:  # grows meanwhile
        row = []
        for b in some:
            after = {t for s in states for bytes_, t in nfa.edges[s] if b in bytes_}
            target = closed(after | ({root} if anywhere else set()))
            if target not in known:
                known[target] = len(order)
                order.append(target)
            row.append(known[target])
        rows.append(row)
    table = np.array(rows)
    accepts = np.zeros(len(order), dtype=object)
    for i, states in enumerate(order):
        for s in states:
            accepts[i] |= final.get(s, 0)
    accepts = accepts.astype(np.int64)
    table, accepts, start = minimised(table, accepts)
    alive = accepts != 0
    while True:  # states from which a rule can still end
        more = alive | alive[table].any(axis=1)
        if (more == alive).all():
            break
        alive = more
    dead = np.flatnonzero(~alive)
    return Dfa(table[:, of_byte], accepts, start, int(dead[0]) if len(dead) else None)


def minimised(table: np.ndarray, accepts: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """Merge states that no text tells apart: blocks are split until none differs in the blocks that its bytes lead to."""
    block = np.unique(accepts, return_inverse=True)[1]
    while True:
        again = np.unique(np.column_stack([block, block[table]]), axis=0, return_inverse=True)[1].ravel()
        if again.max() == block.max():
            break
        block = again
    some = np.unique(block, return_index=True)[1]
    return block[table[some]], accepts[some], int(block[0])
