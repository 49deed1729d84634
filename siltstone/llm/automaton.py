"""Suffix automata of sets of strings."""

from __future__ import annotations

from collections.abc import Iterable


class SuffixAutomaton:
    """Grown string by string. Of each state: the edges, the suffix link, the length of its longest string, and the place
    where the first of its strings' occurrences ends."""

    def __init__(self):
        self.edges: list[dict] = [{}]
        self.link, self.length, self.first = [-1], [0], [-1]

    def add(self, string: Iterable, start: int = 0) -> int:
        """The state of the whole string, until later growth splits it. `start`: number of the string's first place."""
        edges, link, length, first = self.edges, self.link, self.length, self.first
        last = 0
        for place, c in enumerate(string, start):
            known = edges[last].get(c)
            if known is not None:
                last = known if length[known] == length[last] + 1 else self._split(last, c, known)
                continue
            new = len(edges)
            edges.append({})
            link.append(0)
            length.append(length[last] + 1)
            first.append(place)
            at = last
            while at >= 0 and c not in edges[at]:
                edges[at][c] = new
                at = link[at]
            if at >= 0:
                to = edges[at][c]
                link[new] = to if length[to] == length[at] + 1 else self._split(at, c, to)
            last = new
        return last

    def _split(self, at: int, c, to: int) -> int:
        edges, link, length = self.edges, self.link, self.length
        copy = len(edges)
        edges.append(dict(edges[to]))
        link.append(link[to])
        length.append(length[at] + 1)
        self.first.append(self.first[to])
        link[to] = copy
        while at >= 0 and edges[at].get(c) == to:
            edges[at][c] = copy
            at = link[at]
        return copy
