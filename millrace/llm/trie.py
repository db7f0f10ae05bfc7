"""A trie of reference entries and a Levenshtein automaton that walks it.

The automaton is the bit-parallel simulation of the nondeterministic
Levenshtein automaton of the query: bit i of ``rows[d]`` says that the first i
letters of the query can be read along the trie path with at most d edits.
A swap of neighbouring letters counts as one edit.
"""

from __future__ import annotations

from collections.abc import Iterable


class Trie:
    """Maps paths (entries and their aliases) to payloads."""

    def __init__(self, entries: Iterable[tuple[str, object]] = ()):
        self.root: dict = {}
        self.longest = 0
        for path, payload in entries:
            self.add(path, payload)

    def add(self, path: str, payload: object) -> None:
        """Add one path; equal paths keep all their payloads."""
        node = self.root
        for letter in path:
            node = node.setdefault(letter, {})
        node.setdefault("", []).append((path, payload))
        self.longest = max(self.longest, len(path))

    def search(self, query: str, most: int) -> list[tuple[int, str, object]]:
        """All (distance, path, payload) whose path is within ``most`` edits of ``query``, nearest first."""
        n = len(query)
        if n > self.longest + most:
            return []
        masks: dict[str, int] = {}
        for i, letter in enumerate(query):
            masks[letter] = masks.get(letter, 0) | 2 << i
        accept = 1 << n
        full = (accept << 1) - 1
        start = tuple(((1 << (d + 1)) - 1) & full for d in range(most + 1))
        found: list[tuple[int, str, object]] = []
        stack = [(self.root, start, None, 0)]
        while stack:
            node, rows, before, last = stack.pop()
            for letter, child in node.items():
                if letter == "":
                    for d, row in enumerate(rows):
                        if row & accept:
                            found.extend((d, path, payload) for path, payload in child)
                            break
                    continue
                mask = masks.get(letter, 0)
                nxt = [rows[0] << 1 & mask]
                for d in range(1, most + 1):
                    under = rows[d - 1]
                    row = (rows[d] << 1 & mask) | under | (under << 1) | (nxt[d - 1] << 1)
                    if before is not None:
                        row |= before[d - 1] << 2 & last & (mask << 1)
                    nxt.append(row & full)
                if nxt[most]:
                    stack.append((child, tuple(nxt), rows, mask))
        return sorted(found, key=lambda f: (f[0], f[1]))
