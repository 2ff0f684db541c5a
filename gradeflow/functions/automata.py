"""Automata over a set of names: which names a text holds, and what it has in common with each."""

from __future__ import annotations

from collections.abc import Iterable, Iterator


class NameFinder:
    """Aho–Corasick automaton: the longest name that a text holds, in one walk over the text."""

    def __init__(self, names: Iterable[str]) -> None:
        self.next: list[dict[str, int]] = [{}]
        self.longest: list[str | None] = [None]  # the longest name that ends in a state
        self.fail = [0]
        for name in names:
            state = 0
            for c in name:
                if c not in self.next[state]:
                    self.next[state][c] = len(self.next)
                    self.next.append({})
                    self.longest.append(None)
                    self.fail.append(0)
                state = self.next[state][c]
            if state:
                self.longest[state] = name
        # by breadth, so that a state's failure link is known before those of its children
        level = list(self.next[0].values())
        while level:
            below = []
            for state in level:
                for c, child in self.next[state].items():
                    back = self.fail[state]
                    while back and c not in self.next[back]:
                        back = self.fail[back]
                    self.fail[child] = self.next[back].get(c, 0)
                    if self.longest[child] is None:
                        self.longest[child] = self.longest[self.fail[child]]
                    below.append(child)
            level = below

    def find(self, text: str) -> str | None:
        """The longest name within the text, the first by its characters of equally long ones."""
        state, best = 0, None
        for c in text:
            while state and c not in self.next[state]:
                state = self.fail[state]
            state = self.next[state].get(c, 0)
            name = self.longest[state]
            if name is not None and (best is None or (-len(name), name) < (-len(best), best)):
                best = name
        return best


class SuffixAutomaton:
    """Generalised suffix automaton of names: a state is a set of substrings that end at the same places, and knows which names
    have them, as bits."""

    def __init__(self, names: list[str]) -> None:
        self.next: list[dict[str, int]] = [{}]
        self.link, self.length, self.names = [-1], [0], [0]
        for bit, name in enumerate(names):
            last = 0
            for c in name:
                last = self._extend(last, c)
                self.names[last] |= 1 << bit
        for state in sorted(range(1, len(self.link)), key=self.length.__getitem__, reverse=True):
            self.names[self.link[state]] |= self.names[state]

    def _state(self, length: int, following: dict[str, int], link: int) -> int:
        self.next.append(following)
        self.length.append(length)
        self.link.append(link)
        self.names.append(0)
        return len(self.link) - 1

    def _split(self, state: int, c: str) -> int:
        """The state that c leads to, for substrings of exactly one more character than ``state`` has."""
        far = self.next[state][c]
        if self.length[far] == self.length[state] + 1:
            return far
        near = self._state(self.length[state] + 1, dict(self.next[far]), self.link[far])
        self.link[far] = near
        while state >= 0 and self.next[state].get(c) == far:
            self.next[state][c] = near
            state = self.link[state]
        return near

    def _extend(self, last: int, c: str) -> int:
        if c in self.next[last]:  # an earlier name has it
            return self._split(last, c)
        new = self._state(self.length[last] + 1, {}, 0)
        state = last
        while state >= 0 and c not in self.next[state]:
            self.next[state][c] = new
            state = self.link[state]
        if state >= 0:
            self.link[new] = self._split(state, c)
        return new

    def common(self, text: str, wanted: int, least: float = 0.0) -> Iterator[tuple[int, int]]:
        """(name, length of the longest common substring) of the wanted names, largest lengths first, as long as the length is at
        least the share ``least`` of the text's; names without a common character are left out."""
        state = matched = 0
        longest: dict[int, int] = {}
        for c in text:
            while state and c not in self.next[state]:
                state = self.link[state]
                matched = self.length[state]
            if c in self.next[state]:
                state, matched = self.next[state][c], matched + 1
            if matched > longest.get(state, 0):
                longest[state] = matched
        for at in list(longest):
            at = self.link[at]
            while at > 0 and longest.get(at, 0) < self.length[at]:
                longest[at] = self.length[at]
                at = self.link[at]
        for at, size in sorted(longest.items(), key=lambda x: -x[1]):
            if not wanted or size < least * len(text):
                return
            found = self.names[at] & wanted
            wanted ^= found
            while found:
                low = found & -found
                yield low.bit_length() - 1, size
                found ^= low
