"""Probabilistic automata inferred from example strings by state merging.

A prefix tree counts the examples; states whose continuations are statistically
compatible are merged in order of their counts, so runs of one kind of character become
loops. Compatible means: every next symbol's and the end's frequency agree within
Hoeffding's bound, in the states and in what follows them while counts suffice, and
the lengths of what follows, pooled over all continuations, agree within the bound of
Dvoretzky, Kiefer and Wolfowitz. A prefix tree of random strings soon branches into
single examples, whose symbols say nothing; their lengths still do.
"""

from __future__ import annotations

import math
from collections import Counter

import numpy as np

from spindex.llm.textvec import row_sums

#: Symbols: digits, a-f, other lower-case letters, A-F, other upper-case letters, and the marks one by one.
_GROUPS = ["0123456789", "abcdef", "ghijklmnopqrstuvwxyz", "ABCDEF", "GHIJKLMNOPQRSTUVWXYZ", *"+/_.=-"]
SYMBOL = np.full(256, 255, np.uint8)
for _k, _g in enumerate(_GROUPS):
    for _c in _g:
        SYMBOL[ord(_c)] = _k
SIZES = np.array([len(g) for g in _GROUPS], float)
N_SYMBOLS = len(_GROUPS)


class Automaton:
    """Transitions and log-probabilities of a merged prefix tree."""

    def __init__(self, strings: list[bytes], alpha: float = 0.01):
        self.next: list[dict[int, int]] = [{}]
        self.count: list[int] = [0]
        self.end: list[int] = [0]
        self.flow: list[Counter] = [Counter()]
        for s in sorted(strings):
            at = 0
            self.count[0] += 1
            for c in SYMBOL[np.frombuffer(s, np.uint8)].tolist():
                self.flow[at][c] += 1
                to = self.next[at].get(c)
                if to is None:
                    to = len(self.next)
                    self.next[at][c] = to
                    self.next.append({}), self.count.append(0), self.end.append(0), self.flow.append(Counter())
                at = to
                self.count[at] += 1
            self.end[at] += 1
        self.bound = math.sqrt(0.5 * math.log(2 / alpha))
        self.rest = self._lengths()
        self._infer()
        self._finish()

    def _lengths(self) -> list[Counter]:
        """For each state of the tree, how many examples have how many symbols left."""
        rest = [Counter() for _ in self.next]
        for state in range(len(self.next) - 1, -1, -1):  # children have larger numbers
            if self.end[state]:
                rest[state][0] += self.end[state]
            for child in self.next[state].values():
                for n, k in rest[child].items():
                    rest[state][n + 1] += k
        return rest

    def _lengths_differ(self, x: int, y: int) -> bool:
        p, q = self.rest[x], self.rest[y]
        n, m = p.total(), q.total()
        most, a, b = self.bound * (1 / math.sqrt(n) + 1 / math.sqrt(m)), 0, 0
        for length in sorted(p.keys() | q.keys()):
            a, b = a + p[length], b + q[length]
            if abs(a / n - b / m) > most:
                return True
        return False

    def _differ(self, f: int, n: int, g: int, m: int) -> bool:
        return abs(f / n - g / m) > self.bound * (1 / math.sqrt(n) + 1 / math.sqrt(m))

    def _compatible(self, a: int, b: int) -> bool:
        todo = [(a, b)]
        while todo:
            x, y = todo.pop()
            n, m = self.count[x], self.count[y]
            if x == y or not n or not m:
                continue
            if self._differ(self.end[x], n, self.end[y], m) or self._lengths_differ(x, y):
                return False
            for c in self.flow[x].keys() | self.flow[y].keys():
                if self._differ(self.flow[x][c], n, self.flow[y][c], m):
                    return False
            # deep in a tree counts are too small to tell anything apart
            if min(n, m) >= 4:
                todo += [(self.next[x][c], self.next[y][c]) for c in self.next[x].keys() & self.next[y].keys()]
        return True

    def _fold(self, red: int, blue: int) -> None:
        todo = [(red, blue)]
        while todo:
            x, y = todo.pop()
            if x == y:
                continue
            self.count[x] += self.count[y]
            self.end[x] += self.end[y]
            self.flow[x].update(self.flow[y])
            self.rest[x].update(self.rest[y])
            for c, to in self.next[y].items():
                if c in self.next[x]:
                    todo.append((self.next[x][c], to))
                else:
                    self.next[x][c] = to

    def _infer(self) -> None:
        """Red states are final, blue ones their other successors; blue states join a compatible red one or turn red."""
        red = [0]
        is_red = {0}
        while True:
            blue = {(to, at, c) for at in red for c, to in self.next[at].items() if to not in is_red}
            if not blue:
                break
            state, parent, symbol = max(blue, key=lambda b: (self.count[b[0]], -b[0]))
            for r in red:
                if self._compatible(r, state):
                    self.next[parent][symbol] = r
                    self._fold(r, state)
                    break
            else:
                red.append(state)
                is_red.add(state)
        self.states = red

    def _finish(self) -> None:
        number = {s: k for k, s in enumerate(self.states)}
        n = len(self.states)
        floor = math.log(1e-4)
        self.to = np.zeros((n, N_SYMBOLS), np.int32)
        self.logp = np.full((n, N_SYMBOLS), floor)
        self.stop = np.full(n, floor)
        for s, k in number.items():
            total = self.count[s] + 1e-9
            for c, to in self.next[s].items():
                if to in number:
                    self.to[k, c] = number[to]
                    self.logp[k, c] = max(floor, math.log(max(self.flow[s][c], 1e-9) / total))
            self.stop[k] = max(floor, math.log(max(self.end[s], 1e-9) / total))
        self.logp -= np.log(SIZES)

    def scores(self, symbols: np.ndarray, first: np.ndarray) -> np.ndarray:
        """Log-likelihood of strings (symbols of all of them, each one's first index, n + 1) for each character, the end included; all advance together."""
        size = np.diff(first)
        by = np.argsort(-size, kind="stable")
        begin, left = first[:-1][by], size[by]
        at, total = np.zeros(len(by), np.int64), np.zeros(len(by))
        for t in range(int(left[0]) if len(left) else 0):
            m = int(np.searchsorted(-left, -t, side="left"))  # those longer than t
            c = symbols[begin[:m] + t]
            total[:m] += self.logp[at[:m], c]
            at[:m] = self.to[at[:m], c]
        out = np.empty(len(by))
        out[by] = (total + self.stop[at]) / (left + 1)
        return out

    def score(self, string: bytes) -> float:
        """As ``scores``, of one string."""
        return float(self.scores(*encoded([string]))[0])


def encoded(strings: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """The symbols of all strings and each one's first index."""
    return SYMBOL[np.frombuffer(b"".join(strings), np.uint8)].astype(np.int64), np.concatenate([[0], np.cumsum([len(s) for s in strings])]).astype(np.int64)


class Background:
    """Symbol bigrams of ordinary long tokens."""

    def __init__(self, strings: list[bytes]):
        seen = np.full((N_SYMBOLS + 1, N_SYMBOLS), 0.1)
        for s in strings:
            c = SYMBOL[np.frombuffer(s, np.uint8)].astype(int)
            np.add.at(seen, (np.concatenate([[N_SYMBOLS], c[:-1]]), c), 1)
        self.logp = np.log(seen / seen.sum(axis=1, keepdims=True)) - np.log(SIZES)

    def scores(self, symbols: np.ndarray, first: np.ndarray) -> np.ndarray:
        before = np.concatenate([[N_SYMBOLS], symbols[:-1]]) if len(symbols) else symbols
        before[first[:-1][first[1:] > first[:-1]]] = N_SYMBOLS
        return row_sums(self.logp[before, symbols], first) / (np.diff(first) + 1)
