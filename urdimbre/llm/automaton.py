"""Levenshtein automata of many words at once, intersected with a trie of a vocabulary.

The trie is flat: its nodes are numbered level by level, so the children of a node are a range, and what a node
holds are arrays. The automaton of a word is simulated by sets of positions, one set for each number of edits,
held as bits of an integer: reading a trie character shifts the positions whose character matches, and an
insertion, deletion or substitution moves positions to the set of one edit more. Besides these, a pair of
characters that is drawn like a single one (``PAIRS``) may be read for it at the cost of one edit. All words of
a block walk down the trie together; branches in which no position is left, or whose words are all too long or
too short, are left out. Every vocabulary word within ``most`` edits is found.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

#: Single characters and the pairs that are drawn like them.
PAIRS = (("m", "rn"), ("d", "cl"), ("d", "el"), ("w", "vv"), ("n", "ri"), ("u", "ll"), ("v", "\\/"), ("ﬁ", "fi"), ("ﬂ", "fl"), ("k", "lc"), ("h", "li"), ("b", "lo"))
#: Words that walk the trie together, and the most characters that machine integers have bits for.
TOGETHER, BITS = 256, 60


class Trie:
    """Flat trie of distinct words."""

    def __init__(self, words: list[str]):
        self.words = sorted(set(words))
        lengths = np.fromiter(map(len, self.words), np.int64, len(self.words))
        codes = np.frombuffer("".join(self.words).encode("utf-32-le", "surrogatepass"), np.uint32)
        starts = np.cumsum(lengths) - lengths
        levels = int(lengths.max(initial=0))
        char, first, last, word, short, long = [], [], [], [], [], []
        at, parents, base = np.arange(len(self.words)), np.zeros(len(self.words), np.int64), 1
        self.top = 0
        for level in range(levels):
            keep = lengths[at] > level
            at, parents = at[keep], parents[keep]
            own = codes[starts[at] + level]
            new = np.append(True, (own[1:] != own[:-1]) | (parents[1:] != parents[:-1]))
            node = np.cumsum(new) - 1
            begins = np.flatnonzero(new)
            above = parents[begins]
            if level:
                low, high = np.searchsorted(above, np.arange(count)), np.searchsorted(above, np.arange(count), side="right")
                first.append(low + base)
                last.append(high + base)
            else:
                self.top = len(begins)
            count = len(begins)
            char.append(own[begins])
            ends = np.full(count, -1)
            over = lengths[at] == level + 1
            ends[node[over]] = at[over]
            word.append(ends)
            short.append(np.minimum.reduceat(lengths[at], begins))
            long.append(np.maximum.reduceat(lengths[at], begins))
            parents, base = node, base + count
        if levels:
            first.append(np.zeros(count, np.int64))
            last.append(np.zeros(count, np.int64))
        join = lambda xs, t: np.concatenate([np.zeros(1, t), *xs]).astype(t)
        self.char, self.word = join(char, np.uint32), join(word, np.int64)
        self.first, self.last = join(first, np.int64), join(last, np.int64)
        self.short, self.long = join(short, np.int32), join(long, np.int32)
        self.word[0], self.first[0], self.last[0] = -1, 1, 1 + self.top

    def within(self, wanted: list[str], most: int = 2) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """Places in ``wanted``, places in ``words`` and least edits of all pairs at most ``most`` edits apart, in parts."""
        by = sorted(range(len(wanted)), key=lambda i: (len(wanted[i]) > BITS, wanted[i]))  # neighbours walk alike
        cut = sum(len(w) <= BITS for w in wanted)
        for part, kind in ((by[:cut], np.uint64), (by[cut:], object)):
            for i in range(0, len(part), TOGETHER):
                at = np.array(part[i : i + TOGETHER])
                q, w, edits = self._walk([wanted[k] for k in at], most, kind)
                yield at[q], w, edits

    def _walk(self, wanted: list[str], most: int, kind: type) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        one = np.ones(1, kind)[0]
        lengths = np.array([len(w) for w in wanted])
        letters = sorted(set("".join(wanted)))
        column = np.zeros(max(int(self.char.max(initial=0)), max(map(ord, letters), default=0)) + 1, np.int32)
        for i, c in enumerate(letters, 1):
            column[ord(c)] = i
        match = np.zeros((len(wanted), len(letters) + 1), kind)
        pair = np.zeros((len(wanted), len(PAIRS)), kind)
        for k, w in enumerate(wanted):
            for i, c in enumerate(w):
                match[k, column[ord(c)]] |= one << kind(i) if kind is np.uint64 else 1 << i
            for j, (_, two) in enumerate(PAIRS):
                i = w.find(two)
                while i >= 0:
                    pair[k, j] |= one << kind(i) if kind is np.uint64 else 1 << i
                    i = w.find(two, i + 1)
        full = np.array([(1 << len(w) + 1) - 1 for w in wanted], kind)
        goal = np.array([1 << len(w) for w in wanted], kind)
        singles, twos = np.array([ord(a) for a, _ in PAIRS]), {tuple(map(ord, b)): ord(a) for a, b in PAIRS}
        has_pair = np.flatnonzero((pair != 0).any(0))
        q = np.arange(len(wanted))
        node = np.zeros(len(wanted), np.int64)
        now = [np.ones(len(wanted), kind)]
        for _ in range(most):
            now.append((now[-1] | now[-1] << one) & full)
        before, before_char = None, None
        found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        while len(q):
            many = self.last[node] - self.first[node]
            of = np.repeat(np.arange(len(q)), many)
            child = np.arange(len(of)) - np.repeat(np.cumsum(many) - many, many) + self.first[node[of]]
            word = q[of]
            fits = (self.short[child] <= lengths[word] + most) & (self.long[child] >= lengths[word] - most)
            of, child, word = of[fits], child[fits], word[fits]
            char = self.char[child]
            same = match[word, column[char]]
            old = [r[of] for r in now]
            new = [(old[0] & same) << one]
            for e in range(1, most + 1):
                new.append((old[e] & same) << one | old[e - 1] | old[e - 1] << one)
            for j in has_pair:  # one character of the vocabulary read as two
                at = np.flatnonzero(char == singles[j])
                for e in range(1, most + 1 if len(at) else 0):
                    new[e][at] |= (old[e - 1][at] & pair[word[at], j]) << one << one
            for (a, b), c in twos.items() if before is not None else ():  # two read as one
                at = np.flatnonzero((char == b) & (before_char[of] == a)) if c < len(column) and column[c] else ()
                for e in range(1, most + 1 if len(at) else 0):
                    new[e][at] |= (before[e - 1][of[at]] & match[word[at], column[c]]) << one
            for e in range(1, most + 1):
                new[e] = new[e] | new[e - 1] | new[e - 1] << one
            limit = full[word]
            new = [r & limit for r in new]
            left = np.flatnonzero(new[most] != 0)
            ends = left[self.word[child[left]] >= 0]
            ends = ends[(new[most][ends] & goal[word[ends]]) != 0]
            if len(ends):
                edits = sum(((r[ends] & goal[word[ends]]) == 0).astype(np.int64) for r in new)
                found.append((word[ends], self.word[child[ends]], edits))
            before, before_char = [r[of[left]] for r in now], char[left]
            q, node, now = word[left], child[left], [r[left] for r in new]
        if not found:
            return (np.zeros(0, np.int64),) * 3
        return tuple(np.concatenate(x) for x in zip(*found))


def scripts(right: str, read: str, most: int) -> list[tuple[str, ...]]:
    """The shortest ways to read ``right`` as ``read`` in at most ``most`` edits, each edit as ``right part>read part``."""
    for k in range(most + 1):
        if found := sorted(set(_scripts(right, read, k))):
            return found
    return []


def _scripts(right: str, read: str, edits: int) -> Iterator[tuple[str, ...]]:
    n = min(len(right), len(read))
    same = next((i for i in range(n) if right[i] != read[i]), n)
    right, read = right[same:], read[same:]
    if not edits:
        if right == read:
            yield ()
        return
    if abs(len(right) - len(read)) > edits:
        return
    ways = [(1, 1), (1, 0), (0, 1), *((len(x), len(y)) for s, t in PAIRS for x, y in ((s, t), (t, s)) if right.startswith(x) and read.startswith(y))]
    for i, j in ways:
        if i <= len(right) and j <= len(read):
            for rest in _scripts(right[i:], read[j:], edits - 1):
                yield (f"{right[:i]}>{read[:j]}", *rest)
