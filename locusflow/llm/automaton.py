"""Byte automata from regular expressions: subset construction and minimisation.

Patterns use literals, classes, groups, alternatives, greedy repeats and (?i:...); letters in either
case are ASCII letters. States are transition arrays over byte classes.
"""

from __future__ import annotations

import re
from re import _constants as c
from re import _parser as parser

import numpy as np


class _Nfa:
    """backward: patterns are read from their ends, for scans from the end of a text to its start."""

    def __init__(self, backward: bool = False) -> None:
        self.backward = backward
        self.moves: list[list[tuple[frozenset[int], int]]] = []
        self.free: list[list[int]] = []

    def state(self) -> int:
        self.moves.append([])
        self.free.append([])
        return len(self.moves) - 1

    def add(self, tree, at: int, fold: bool) -> int:
        """Extends the automaton by a parsed pattern from a state; the state at its end."""
        for kind, value in reversed(tree) if self.backward else tree:
            if kind is c.LITERAL or kind is c.IN:
                end = self.state()
                self.moves[at].append((_bytes(kind, value, fold), end))
                at = end
            elif kind is c.BRANCH:
                end = self.state()
                for branch in value[1]:
                    self.free[self.add(branch, at, fold)].append(end)
                at = end
            elif kind is c.SUBPATTERN:
                _, on, off, inner = value
                at = self.add(inner, at, (fold or bool(on & re.IGNORECASE)) and not off & re.IGNORECASE)
            elif kind is c.MAX_REPEAT:
                least, most, inner = value
                for _ in range(least):
                    at = self.add(inner, at, fold)
                if most is c.MAXREPEAT:
                    loop = self.state()
                    self.free[at].append(loop)
                    self.free[self.add(inner, loop, fold)].append(loop)
                    at = loop
                else:
                    end = self.state()
                    for _ in range(most - least):
                        self.free[at].append(end)
                        at = self.add(inner, at, fold)
                    self.free[at].append(end)
                    at = end
            else:
                raise ValueError(f"not supported in a rule: {kind}")
        return at

    def closure(self, states) -> frozenset[int]:
        seen, left = set(states), list(states)
        while left:
            for nxt in self.free[left.pop()]:
                if nxt not in seen:
                    seen.add(nxt)
                    left.append(nxt)
        return frozenset(seen)


def _bytes(kind, value, fold: bool) -> frozenset[int]:
    found: set[int] = set()
    for k, v in [(kind, value)] if kind is c.LITERAL else value:
        if k is c.LITERAL:
            found.add(v)
        elif k is c.RANGE:
            found.update(range(v[0], v[1] + 1))
        else:
            raise ValueError(f"not supported in a class: {k}")
    if max(found) > 127:
        raise ValueError("rules are over ASCII")
    if fold:
        found |= {ord(chr(x).swapcase()) for x in found if chr(x).isalpha()}
    return frozenset(found)


class Automaton:
    """classes[byte] names a byte's class, moves[state, class] the next state, accepts[state] a bit for
    each pattern that ends there. State 0 is dead (without search), ``start`` is where runs begin."""

    def __init__(self, patterns: list[str], search: bool = False, backward: bool = False) -> None:
        """search: patterns may begin at any byte. backward: for bytes from the last to the first."""
        nfa = _Nfa(backward)
        first = nfa.state()
        ends = {nfa.add(parser.parse(p), first, False): 1 << k for k, p in enumerate(patterns)}
        sets = sorted({s for moves in nfa.moves for s, _ in moves}, key=sorted)
        marks = np.zeros((256, len(sets)), bool)
        for k, s in enumerate(sets):
            marks[list(s), k] = True
        kinds, classes = np.unique(marks, axis=0, return_inverse=True)
        self.classes = classes.reshape(-1).astype(np.uint8)
        of = [[k for k, s in enumerate(sets) if kinds[j, k]] for j in range(len(kinds))]
        place = {s: k for k, s in enumerate(sets)}
        steps = [[(place[s], t) for s, t in moves] for moves in nfa.moves]

        begin = nfa.closure([first])
        known: dict[frozenset[int], int] = {frozenset(): 0, begin: 1}
        if search:
            known = {begin: 0}
        table: list[list[int]] = []
        queue = list(known)
        for now in queue:
            row = []
            for inside in of:
                into = {t for s in now for k, t in steps[s] if k in inside}
                target = nfa.closure(into | ({first} if search else set()))
                if target not in known:
                    known[target] = len(known)
                    queue.append(target)
                row.append(known[target])
            table.append(row)
        accepts = np.array([sum(bit for s, bit in ends.items() if s in now) for now in queue])
        self.made = len(queue)
        self._minimise(np.array(table), accepts, 0 if search else 1)

    def _minimise(self, table: np.ndarray, accepts: np.ndarray, start: int) -> None:
        """Moore's refinement: states are split until equal classes have equal moves."""
        group = np.unique(accepts, return_inverse=True)[1]
        while True:
            _, index, finer = np.unique(
                np.column_stack([group, group[table]]), axis=0, return_index=True, return_inverse=True
            )
            finer = finer.reshape(-1)
            if finer.max() == group.max():
                break
            group = finer
        order = np.full(len(index), -1)
        rank = np.concatenate([[finer[0]], np.delete(np.arange(len(index)), finer[0])])
        order[rank] = np.arange(len(index))  # the class of state 0 stays 0
        self.moves = order[finer[table[index[rank]]]].astype(np.int32)
        self.accepts = accepts[index[rank]]
        self.start = int(order[finer[start]])

    def rows(self, stop: bool = False) -> list[list]:
        """For each state a list of 256 next states, which are such lists themselves; item 256 has the
        accept bits, item 257 the state's number. A step of a scan is one indexing. stop: an accepting state
        is never left."""
        rows: list[list] = [[] for _ in self.moves]
        for k, (row, moves, bits) in enumerate(zip(rows, self.moves[:, self.classes].tolist(), self.accepts.tolist())):
            row.extend([row] * 256 if stop and bits else [rows[t] for t in moves])
            row += [bits, k]
        return rows
