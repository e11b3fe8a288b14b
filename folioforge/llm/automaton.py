"""Regular expressions over bytes to one minimal deterministic automaton.

The rules' expressions are parsed to one nondeterministic automaton, made deterministic by subset construction over
classes of bytes that no rule tells apart, and minimised by partition refinement. The result is a transition array.
Supported: literals, escapes, ``.``, classes, groups, ``|``, ``* + ?`` and ``{m}``, ``{m,}``, ``{m,n}``.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np

from folioforge.llm.textblock import mix

ALL = frozenset(range(256))
_SETS = {"d": frozenset(b"0123456789"), "w": frozenset(b"abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789_"), "s": frozenset(b" \t\n\r\f\v")}
_CTRL = {"n": 10, "t": 9, "r": 13}


class _Parser:
    def __init__(self, text: str):
        self.s, self.i = text, 0

    def peek(self) -> str:
        return self.s[self.i] if self.i < len(self.s) else ""

    def take(self) -> str:
        c = self.peek()
        self.i += 1
        return c

    def alternatives(self):
        parts = [self.sequence()]
        while self.peek() == "|":
            self.take()
            parts.append(self.sequence())
        return ("alt", parts)

    def sequence(self):
        out = []
        while self.peek() not in ("", "|", ")"):
            out.append(self.repeated())
        return ("seq", out)

    def repeated(self):
        item = self.atom()
        while self.peek() in ("*", "+", "?", "{") and self.peek():
            c = self.take()
            low, high = {"*": (0, None), "+": (1, None), "?": (0, 1)}.get(c, (0, 0))
            if c == "{":
                to = self.s.index("}", self.i)
                a, comma, b = self.s[self.i : to].partition(",")
                low, high = int(a), (int(b) if b else None) if comma else int(a)
                self.i = to + 1
            item = ("rep", item, low, high)
        return item

    def escape(self) -> frozenset[int]:
        c = self.take()
        if c.lower() in _SETS:
            return ALL - _SETS[c.lower()] if c.isupper() else _SETS[c]
        return frozenset([_CTRL.get(c, ord(c))])

    def atom(self):
        c = self.take()
        if c == "(":
            if self.s[self.i : self.i + 2] == "?:":
                self.i += 2
            item = self.alternatives()
            self.take()
            return item
        if c == "[":
            return ("set", self.klass())
        if c == ".":
            return ("set", ALL - {10})
        if c == "\\":
            return ("set", self.escape())
        return ("seq", [("set", frozenset([b])) for b in c.encode()])

    def klass(self) -> frozenset[int]:
        negated = self.peek() == "^" and bool(self.take())
        out: set[int] = set()
        while self.peek() != "]":
            c = self.take()
            if c == "\\":
                out |= self.escape()
            elif self.peek() == "-" and self.s[self.i + 1] != "]":
                self.take()
                out |= set(range(ord(c), ord(self.take()) + 1))
            else:
                out.add(ord(c))
        self.take()
        return ALL - out if negated else frozenset(out)


def parse(pattern: str):
    return _Parser(pattern).alternatives()


@dataclass
class Nfa:
    moves: list[list[tuple[frozenset[int], int]]] = field(default_factory=list)
    free: list[list[int]] = field(default_factory=list)
    accepts: dict[int, int] = field(default_factory=dict)

    def state(self) -> int:
        self.moves.append([])
        self.free.append([])
        return len(self.moves) - 1

    def add(self, tree, at: int) -> int:
        """The state after ``tree`` from ``at``."""
        kind = tree[0]
        if kind == "set":
            to = self.state()
            self.moves[at].append((tree[1], to))
            return to
        if kind == "seq":
            for x in tree[1]:
                at = self.add(x, at)
            return at
        if kind == "alt":
            to = self.state()
            for x in tree[1]:
                start = self.state()
                self.free[at].append(start)
                self.free[self.add(x, start)].append(to)
            return to
        _, item, low, high = tree
        for _ in range(low):
            at = self.add(item, at)
        if high is None:
            loop = self.state()
            self.free[at].append(loop)
            self.free[self.add(item, loop)].append(loop)
            to = self.state()
            self.free[loop].append(to)
            return to
        to = self.state()
        self.free[at].append(to)
        for _ in range(high - low):
            at = self.add(item, at)
            self.free[at].append(to)
        return to


@dataclass
class Dfa:
    """``table[state * n_classes + klass[byte]]``; states from ``accepting`` on accept the rules in ``rules[state - accepting]``."""

    klass: np.ndarray
    n_classes: int
    table: np.ndarray
    start: int
    accepting: int
    rules: list[tuple[int, ...]]
    dead: int


def compile_rules(trees: list, boundary: frozenset[int] | None) -> Dfa:
    """Rule i is ``trees[i]``. With ``boundary`` a match may start at the text's start or after any byte of that set;
    with None it starts at the text's start only. States accept where a match ends."""
    nfa = Nfa()
    root = nfa.state()
    if boundary is not None:
        other = nfa.state()
        nfa.moves[root] += [(boundary, root), (ALL - boundary, other)]
        nfa.moves[other] += [(boundary, root), (ALL - boundary, other)]
    for i, tree in enumerate(trees):
        start = nfa.state()
        nfa.free[root].append(start)
        nfa.accepts[nfa.add(tree, start)] = i

    marks = np.zeros((256, 0), bool)
    sets = {s for m in nfa.moves for s, _ in m}
    marks = np.array([[b in s for s in sets] for b in range(256)], bool).reshape(256, -1)
    _, first, klass = np.unique(marks, axis=0, return_index=True, return_inverse=True)
    klass = klass.reshape(-1).astype(np.int64)
    samples = first.tolist()

    def closure(states) -> frozenset[int]:
        todo, seen = list(states), set(states)
        while todo:
            for y in nfa.free[todo.pop()]:
                if y not in seen:
                    seen.add(y)
                    todo.append(y)
        return frozenset(x for x in seen if nfa.moves[x] or x in nfa.accepts)

    ahead = [[frozenset() if not (y := [y for k, y in moves if b in k]) else closure(y) for b in samples] for moves in nfa.moves]
    begin = closure([root])
    number, rows, order = {begin: 0}, [], [begin]
    for now in order:  # subset construction; ``order`` grows
        row = []
        for sets in zip(*[ahead[x] for x in now]) if now else [()] * len(samples):
            to = frozenset().union(*sets)
            if to not in number:
                number[to] = len(order)
                order.append(to)
            row.append(number[to])
        rows.append(row)
    t = np.array(rows, np.int64)
    found = [tuple(sorted({nfa.accepts[x] for x in s if x in nfa.accepts})) for s in order]
    kinds = {k: i for i, k in enumerate(sorted(set(found)))}
    part = np.array([kinds[k] for k in found])
    factors = np.random.default_rng(1).integers(0, 2**63, (len(samples) + 1, 2), np.uint64) * np.uint64(2) + np.uint64(1)
    while True:  # refine: states of one part go to the same parts; 128-bit sums stand for the rows
        x = mix(np.column_stack([part, part[t]]).astype(np.uint64) + np.uint64(1))
        sums = np.ascontiguousarray(np.stack([(x * factors[:, i]).sum(1, dtype=np.uint64) for i in (0, 1)], 1)).view("u8,u8").ravel()
        _, new = np.unique(sums, return_inverse=True)
        if new.max() == part.max():
            break
        part = new
    n = int(part.max()) + 1
    one = np.zeros(n, np.int64)
    one[part] = np.arange(len(part))
    by = sorted(range(n), key=lambda p: (bool(found[one[p]]), p))
    place = np.zeros(n, np.int64)
    place[by] = np.arange(n)
    table = place[part[t[one[by]]]]
    rules = [found[one[p]] for p in by]
    accepting = sum(not r for r in rules)
    stuck = [s for s in range(accepting) if (table[s] == s).all()]
    return Dfa(klass, len(samples), table.astype(np.int32).ravel(), int(place[part[0]]), accepting, rules[accepting:], stuck[0] if stuck else -1)


def scan(dfa: Dfa, data: np.ndarray, offsets: np.ndarray, lanes: int = 48, ends: bool = True) -> list[tuple[int, int, int]]:
    """``(document, end byte in it, state)`` wherever an accepting state is reached, in one pass over each document's bytes;
    without ``ends`` each state once a document, with 0 for the byte.

    Documents step side by side, the longest first, so that those still running are a prefix; when fewer than ``lanes``
    run, each is finished by itself.
    """
    length = np.diff(offsets)
    order = np.argsort(-length, kind="stable")
    begin, size = offsets[:-1][order], length[order]
    klass, table, width, accepting = dfa.klass[data], dfa.table, dfa.n_classes, dfa.accepting
    state = np.full(len(order), dfa.start, np.int64)
    out, at = {}, 0
    running = int((size > 0).sum())
    while running >= lanes:
        now = table[state[:running] * width + klass[begin[:running] + at]]
        state[:running] = now
        if now.max() >= accepting:
            for x in np.flatnonzero(now >= accepting):
                out[int(order[x]), (at + 1) * ends, int(now[x])] = None
        at += 1
        running = int(np.searchsorted(-size[:running], -at, "left"))
    if running:
        flat = table.tolist()
        for x in range(running):
            s, doc = int(state[x]), int(order[x])
            for low in range(at, int(size[x]), 1 << 20):  # a slice at a time: a list takes much more memory than an array
                for j, c in enumerate(klass[begin[x] + low : begin[x] + min(low + (1 << 20), int(size[x]))].tolist(), low + 1):
                    s = flat[s * width + c]
                    if s >= accepting:
                        out[doc, j * ends, s] = None
    return list(out)
