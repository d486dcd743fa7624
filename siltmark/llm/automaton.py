"""Rule expressions over bytes, compiled to one minimal automaton.

The expressions know literals, escapes, classes, groups, alternation and ? * + {n}; (?i) at the front lets
ASCII letters outside classes match in either case. Nothing else is needed by the rules.
"""

from __future__ import annotations

import numpy as np

EITHER = "(?i)"


def parse(rule: str):
    """A tree of ('set', frozenset of bytes), ('cat', parts), ('or', parts), ('rep', part, least, most or None)."""
    fold = rule.startswith(EITHER)
    text, at = rule.removeprefix(EITHER), 0

    def one(c: str) -> int:
        if ord(c) > 127:
            raise ValueError(f"rules are ASCII: {rule!r}")
        return ord(c)

    def literal(c: str):
        return "set", frozenset({one(c), one(c.lower()), one(c.upper())} if fold else {one(c)})

    def klass():
        nonlocal at
        found: set[int] = set()
        end = text.index("]", at + 1)
        body, at, k = text[at:end], end + 1, 0
        while k < len(body):
            if body[k] == "\\":
                k += 1
            if k + 2 < len(body) and body[k + 1] == "-":
                found.update(range(one(body[k]), one(body[k + 2]) + 1))
                k += 3
            else:
                found.add(one(body[k]))
                k += 1
        return "set", frozenset(found)

    def atom():
        nonlocal at
        c = text[at]
        at += 1
        if c == "(":
            inner = either()
            at += 1
            return inner
        if c == "[":
            return klass()
        if c == "\\":
            at += 1
            return literal(text[at - 1])
        return literal(c)

    def chain():
        nonlocal at
        parts = []
        while at < len(text) and text[at] not in "|)":
            part = atom()
            while at < len(text) and text[at] in "?*+{":
                c = text[at]
                at += 1
                if c == "{":
                    end = text.index("}", at)
                    least, _, most = text[at:end].partition(",")
                    at = end + 1
                    part = ("rep", part, int(least), int(most or least))
                else:
                    part = ("rep", part, int(c == "+"), 1 if c == "?" else None)
            parts.append(part)
        return "cat", parts

    def either():
        nonlocal at
        parts = [chain()]
        while at < len(text) and text[at] == "|":
            at += 1
            parts.append(chain())
        return ("or", parts) if len(parts) > 1 else parts[0]

    tree = either()
    if at != len(text):
        raise ValueError(f"can't read {rule!r} from {at}")
    return tree


class Nfa:
    def __init__(self):
        self.moves: list[list[tuple[frozenset, int]]] = []
        self.free: list[list[int]] = []
        self.accepts: dict[int, int] = {}

    def state(self) -> int:
        self.moves.append([])
        self.free.append([])
        return len(self.moves) - 1

    def add(self, tree, start: int, backward: bool) -> int:
        kind = tree[0]
        if kind == "set":
            end = self.state()
            self.moves[start].append((tree[1], end))
            return end
        if kind == "cat":
            for part in reversed(tree[1]) if backward else tree[1]:
                start = self.add(part, start, backward)
            return start
        if kind == "or":
            end = self.state()
            for part in tree[1]:
                own = self.state()
                self.free[start].append(own)
                self.free[self.add(part, own, backward)].append(end)
            return end
        _, part, least, most = tree
        for _ in range(least):
            start = self.add(part, start, backward)
        if most is None:
            loop = self.state()
            self.free[start].append(loop)
            self.free[self.add(part, loop, backward)].append(loop)
            return loop
        end = self.state()
        self.free[start].append(end)
        for _ in range(most - least):
            start = self.add(part, start, backward)
            self.free[start].append(end)
        return end

    def closure(self, states) -> frozenset:
        seen, todo = set(states), list(states)
        while todo:
            for x in self.free[todo.pop()]:
                if x not in seen:
                    seen.add(x)
                    todo.append(x)
        return frozenset(seen)


class Automaton:
    """next: state by byte class; klass: class of each byte; accepts: bit mask of rules by state; start."""

    def __init__(self, rules: list[str], anywhere: bool, backward: bool = False):
        nfa = Nfa()
        first = nfa.state()
        for k, rule in enumerate(rules):
            own = nfa.state()
            nfa.free[first].append(own)
            nfa.accepts[nfa.add(parse(rule), own, backward)] = 1 << k
        sets = {s for moves in nfa.moves for s, _ in moves}
        by_sign: dict[tuple, int] = {}
        order = sorted(sets, key=sorted)
        self.klass = np.array([by_sign.setdefault(tuple(b in s for s in order), len(by_sign)) for b in range(256)], np.int32)
        of = [int(np.flatnonzero(self.klass == c)[0]) for c in range(len(by_sign))]
        begin = nfa.closure([first])
        number, todo, rows = {begin: 0}, [begin], []
        step: dict[tuple[int, int], tuple[int, ...]] = {}
        for q, moves in enumerate(nfa.moves):
            for c, b in enumerate(of):
                if to := tuple(t for s, t in moves if b in s):
                    step[q, c] = to
        for states in todo:
            row = []
            for c in range(len(of)):
                to = nfa.closure([t for q in states for t in step.get((q, c), ())])
                if anywhere:
                    to |= begin
                if to not in number:
                    number[to] = len(todo)
                    todo.append(to)
                row.append(number[to])
            rows.append(row)
        marks = np.array([sum({nfa.accepts[q] for q in s if q in nfa.accepts}) for s in todo], np.int64)
        self._minimise(np.array(rows, np.int64), marks)

    def _minimise(self, table: np.ndarray, marks: np.ndarray) -> None:
        """Partition refinement: states stay together while their marks and their successors' blocks agree."""
        block = np.unique(marks, return_inverse=True)[1].ravel()
        n = 0
        while True:
            block = np.unique(np.column_stack([block, block[table]]), axis=0, return_inverse=True)[1].ravel()
            if block.max() + 1 == n:
                break
            n = int(block.max()) + 1
        chosen = np.unique(block, return_index=True)[1]
        self.next, self.accepts, self.start = block[table[chosen]].astype(np.int32), marks[chosen], int(block[0])

    def rows(self) -> tuple[list, list]:
        """Rows that hold the next rows themselves, by byte, and at 256 the state's mask; and the starting row."""
        rows: list[list] = [[] for _ in range(len(self.next))]
        for row, to, mark in zip(rows, self.next[:, self.klass].tolist(), self.accepts.tolist()):
            row.extend(rows[x] for x in to)
            row.append(mark)
        return rows, rows[self.start]
