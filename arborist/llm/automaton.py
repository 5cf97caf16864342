"""Generalised suffix automaton of token sequences, and matching statistics of a stream of tokens."""

from __future__ import annotations


class SuffixAutomaton:
    """Automaton of all runs of tokens of the items; items are parted by tokens that no stream contains.

    length[v], link[v] and next[v] are the longest run, the suffix link and the transitions of state v; ends[v] are
    the (item, position) pairs at which the longest run of v was first seen to end as a prefix.
    """

    def __init__(self, items: list[list[int]]) -> None:
        self.length, self.link, self.next = [0], [-1], [{}]
        self.ends: list[list[tuple[int, int]]] = [[]]
        last = 0
        for k, item in enumerate(items):
            for at, token in enumerate(item):
                last = self._extend(last, token)
                self.ends[last].append((k, at))
            last = self._extend(last, -2 - k)

    def _state(self, length: int, link: int, nxt: dict[int, int]) -> int:
        self.length.append(length)
        self.link.append(link)
        self.next.append(nxt)
        self.ends.append([])
        return len(self.length) - 1

    def _extend(self, last: int, token: int) -> int:
        new, p = self._state(self.length[last] + 1, 0, {}), last
        while p >= 0 and token not in self.next[p]:
            self.next[p][token] = new
            p = self.link[p]
        if p >= 0:
            q = self.next[p][token]
            if self.length[p] + 1 == self.length[q]:
                self.link[new] = q
            else:
                twin = self._state(self.length[p] + 1, self.link[q], dict(self.next[q]))
                while p >= 0 and self.next[p].get(token) == q:
                    self.next[p][token] = twin
                    p = self.link[p]
                self.link[q] = self.link[new] = twin
        return new

    def states_by_length(self) -> list[int]:
        """All states but the root, longest first."""
        return sorted(range(1, len(self.length)), key=self.length.__getitem__, reverse=True)

    def walk(self, item: list[int]) -> int:
        """The state of a run that is known to occur."""
        v = 0
        for token in item:
            v = self.next[v][token]
        return v

    def statistics(self, tokens: list[int]):
        """(state, length) of the longest run ending at each token."""
        nxt, link, length = self.next, self.link, self.length
        v = n = 0
        for token in tokens:
            w = nxt[v].get(token)
            while w is None and v:
                v = link[v]
                n = length[v]
                w = nxt[v].get(token)
            if w is None:
                v = n = 0
            else:
                v = w
                n += 1
            yield v, n
