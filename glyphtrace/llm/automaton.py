"""Suffix automata over sequences of integers."""

from __future__ import annotations


class SuffixAutomaton:
    """The smallest automaton that accepts every substring of the sequences added."""

    def __init__(self):
        self.next, self.link, self.length = [{}], [-1], [0]
        self.last = 0

    def add(self, sequence) -> None:
        """Adds a sequence; substrings do not run across sequences."""
        nexts, link, length = self.next, self.link, self.length
        last = 0
        for c in sequence:
            found = nexts[last].get(c)
            if found is not None and length[found] == length[last] + 1:
                last = found
                continue
            if found is not None:  # a substring of an earlier sequence: split its state off
                last = self._split(last, found, c)
                continue
            state = len(nexts)
            nexts.append({})
            link.append(0)
            length.append(length[last] + 1)
            p = last
            while p >= 0 and c not in nexts[p]:
                nexts[p][c] = state
                p = link[p]
            if p >= 0:
                q = nexts[p][c]
                link[state] = q if length[q] == length[p] + 1 else self._split(p, q, c)
            last = state

    def _split(self, p: int, q: int, c: int) -> int:
        nexts, link, length = self.next, self.link, self.length
        clone = len(nexts)
        nexts.append(nexts[q].copy())
        link.append(link[q])
        length.append(length[p] + 1)
        link[q] = clone
        while p >= 0 and nexts[p].get(c) == q:
            nexts[p][c] = clone
            p = link[p]
        return clone

    def spans(self, sequence, least: int) -> list[tuple[int, int]]:
        """Maximal spans covered by substrings of at least `least` elements that the automaton accepts.

        The matching statistic of each position, the longest accepted suffix there, is kept along the walk.
        """
        nexts, link, length = self.next, self.link, self.length
        out: list[tuple[int, int]] = []
        state = matched = 0
        for i, c in enumerate(sequence):
            while state and c not in nexts[state]:
                state = link[state]
                matched = length[state]
            to = nexts[state].get(c)
            if to is None:
                state = matched = 0
                continue
            state, matched = to, matched + 1
            if matched >= least:
                a, b = i + 1 - matched, i + 1
                if out and a <= out[-1][1]:
                    out[-1] = (min(a, out[-1][0]), b)
                else:
                    out.append((a, b))
        return out
