"""A lexicon trie intersected with Levenshtein automata, determinised on demand and run over many words at once.

A state is a set of (trie node, edits used); a word within its term's allowed edits leads to a state that holds the term's
node. The union over the whole lexicon is one automaton, whose transitions are worked out when a text first needs them, so
each word costs table look-ups until it can't become a term any more - two or three for most.
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np


#: States kept between batches: a few hundred bytes each, and a row of the table.
MOST_STATES = 50_000


class Term(NamedTuple):
    """A lexicon entry. stem: words that go on after it count too. edits: inserted, dropped or changed letters allowed."""

    text: str
    weight: float = 1.0
    stem: bool = False
    edits: int = 0


class Lexicon:
    DEAD, START = 0, 1

    def __init__(self, terms: list[Term]):
        self.terms = terms
        self.children: list[dict[str, int]] = [{}]
        self.ends: list[list[int]] = [[]]
        self.room = [0]  # the most edits that any term at or below a node allows
        for k, term in enumerate(terms):
            node = 0
            self.room[0] = max(self.room[0], term.edits)
            for c in term.text:
                if c not in self.children[node]:
                    self.children[node][c] = len(self.children)
                    self.children.append({})
                    self.ends.append([])
                    self.room.append(0)
                node = self.children[node][c]
                self.room[node] = max(self.room[node], term.edits)
            self.ends[node].append(k)
        letters = sorted({c for t in terms for c in t.text})
        self.letters = ["", *letters]  # class 0: any other character
        self.classes = np.zeros(0x110000, np.uint16)
        for k, c in enumerate(letters, 1):
            self.classes[ord(c)] = k
        self.table = np.full((1024, len(self.letters)), -1, np.int32)
        self.table[self.DEAD] = 0
        self.sets: list[dict[int, int]] = [{}, self._closed({0: 0})]
        self.numbers = {frozenset(): 0, frozenset(self.sets[1].items()): 1}
        self.whole, self.part = np.full((1024, 2), -1, np.int32), np.full((1024, 2), -1, np.int32)
        self._accepts(1)

    def _closed(self, state: dict[int, int]) -> dict[int, int]:
        """Adds what letters missing from the word lead to; keeps the fewest edits of a node, and nodes that can still end."""
        out, todo = {}, list(state.items())
        while todo:
            node, e = todo.pop()
            if e > self.room[node] or out.get(node, 99) <= e:
                continue
            out[node] = e
            todo += [(child, e + 1) for child in self.children[node].values()]
        return out

    def _accepts(self, s: int) -> None:
        for table, stems in ((self.whole, False), (self.part, True)):
            found = [(e - self.terms[k].weight * 1e-6, e, k) for node, e in self.sets[s].items() for k in self.ends[node] if e <= self.terms[k].edits and self.terms[k].stem in (stems, True)]
            if found:
                _, e, k = min(found)
                table[s] = (k, e)

    def _step(self, s: int, letter: int) -> int:
        c, moved = self.letters[letter], {}

        def put(node: int, e: int) -> None:
            if e < moved.get(node, 99):
                moved[node] = e

        for node, e in self.sets[s].items():
            for label, child in self.children[node].items():
                put(child, e + (label != c))
            put(node, e + 1)
        moved = self._closed(moved)
        key = frozenset(moved.items())
        if key not in self.numbers:
            n = self.numbers[key] = len(self.sets)
            self.sets.append(moved)
            if n == len(self.table):
                grow = lambda t: np.concatenate([t, np.full_like(t, -1)])
                self.table, self.whole, self.part = grow(self.table), grow(self.whole), grow(self.part)
            self._accepts(n)
        return self.numbers[key]

    def _forget(self) -> None:
        """Drops the states worked out so far once they are many; texts work them out again."""
        if len(self.sets) > MOST_STATES:
            self.__init__(self.terms)

    def match(self, points: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(word, term, edits) of the words points[start:end] that are a term, or begin with a stem, within its edits."""
        self._forget()
        n = len(start)
        best = np.full((n, 2), -1, np.int32)
        word, state, at = np.arange(n), np.full(n, self.START, np.int32), start.copy()
        while len(word):
            over = at >= end[word]
            if over.any():
                w, hit = word[over], self.whole[state[over]]
                better = (hit[:, 0] >= 0) & ((best[w, 0] < 0) | (hit[:, 1] < best[w, 1]))
                best[w[better]] = hit[better]
                word, state, at = word[~over], state[~over], at[~over]
                if not len(word):
                    break
            letter = self.classes[points[at]]
            to = self.table[state, letter]
            if (new := to < 0).any():
                width = self.table.shape[1]
                for x in np.unique(state[new].astype(np.int64) * width + letter[new]):
                    s, c = divmod(int(x), width)
                    n_to = self._step(s, c)
                    self.table[s, c] = n_to
                to = self.table[state, letter]
            live = to != self.DEAD
            word, state, at = word[live], to[live], at[live] + 1
            hit = self.part[state]
            better = (hit[:, 0] >= 0) & ((best[word, 0] < 0) | (hit[:, 1] < best[word, 1]))
            if better.any():
                best[word[better]] = hit[better]
        found = np.flatnonzero(best[:, 0] >= 0)
        return found, best[found, 0], best[found, 1]
