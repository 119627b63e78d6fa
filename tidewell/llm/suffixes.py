"""Deep-shallow string sorting with longest common prefixes.

Multikey quicksort orders strings down to a shallow depth; groups that still
agree there are ordered by a blind trie, which keeps only branching depths and
bytes and compares each new string with one stored string.
"""

from __future__ import annotations

import numpy as np

SHALLOW = 16


def common_prefix(x: bytes, y: bytes) -> int:
    n = min(len(x), len(y))
    d = int.from_bytes(x[:n], "big") ^ int.from_bytes(y[:n], "big")
    return n - (d.bit_length() + 7) // 8


class BlindTrie:
    """A trie of strings by their branching bytes; -1 stands for a string's end."""

    def __init__(self, strings: list[bytes]):
        self.strings = strings
        self.root = None

    def add(self, i: int) -> None:
        s = self.strings[i]
        if self.root is None:
            self.root = [i]
            return
        node = self.root
        while len(node) == 2:  # down, blindly, to some string
            depth, kids = node
            node = kids.get(s[depth] if depth < len(s) else -1) or next(iter(kids.values()))
        other = self.strings[node[0]]
        lcp = common_prefix(s, other)
        if lcp == len(s) == len(other):
            node.insert(0, i) if len(node) != 1 else node.extend([i, None])
            return
        node, up, by = self.root, None, None
        while len(node) == 2 and node[0] < lcp:
            up, by = node, s[node[0]] if node[0] < len(s) else -1
            node = node[1][by]
        mine = s[lcp] if lcp < len(s) else -1
        if len(node) == 2 and node[0] == lcp:
            node[1][mine] = [i]
            return
        new = [lcp, {mine: [i], other[lcp] if lcp < len(other) else -1: node}]
        if up is None:
            self.root = new
        else:
            up[1][by] = new

    def walk(self, order: list[int], lcps: list[int], depth: int) -> None:
        """Append strings in order; lcps gets, for each, what it shares with the one before."""
        todo = [(self.root, depth)]
        while todo:
            node, shared = todo.pop()
            if len(node) == 2:
                d, kids = node
                ks = sorted(kids)
                todo += [(kids[k], d) for k in reversed(ks[1:])] + [(kids[ks[0]], shared)]
            else:
                same = [x for x in node if x is not None]
                for n, i in enumerate(same):
                    order.append(i)
                    lcps.append(shared if n == 0 else len(self.strings[i]))


def deep_shallow_sort(strings: list[bytes], start: int = 0, shallow: int = SHALLOW) -> tuple[np.ndarray, np.ndarray]:
    """(order, lcp): lcp[k] is what string order[k] shares with order[k - 1].

    All strings are known to agree in their first ``start`` bytes.
    """
    order: list[int] = []
    lcps: list[int] = []
    todo = [(list(range(len(strings))), start, start)]
    while todo:
        group, depth, shared = todo.pop()
        if not group:
            continue
        if len(group) == 1:
            order.append(group[0])
            lcps.append(shared)
            continue
        if depth >= start + shallow:
            trie = BlindTrie(strings)
            for i in group:
                trie.add(i)
            trie.walk(order, lcps, shared)
            continue
        at = [strings[i][depth] if depth < len(strings[i]) else -1 for i in group]
        pivot = at[len(at) // 2]
        less = [i for i, c in zip(group, at) if c < pivot]
        same = [i for i, c in zip(group, at) if c == pivot]
        more = [i for i, c in zip(group, at) if c > pivot]
        parts = [(less, depth)]
        if pivot < 0:  # ended strings are equal
            parts += [([i], len(strings[i])) for i in same]
        else:
            parts.append((same, depth + 1))
        parts = [p for p in [*parts, (more, depth)] if p[0]]
        # the first string of each part but the first shares `depth` bytes with its predecessor
        first = [shared] + [depth] * (len(parts) - 1)
        if pivot < 0:
            seen = bool(less)
            for k, (p, _) in enumerate(parts):
                if p and p[0] in same and (seen or k):
                    first[k] = depth
        todo += [(g, d, f) for (g, d), f in zip(reversed(parts), reversed(first))]
    lcp = np.asarray(lcps, np.int64)
    if len(lcp):
        lcp[0] = 0
    return np.asarray(order, np.int64), lcp
