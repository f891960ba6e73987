"""Variable-length grams of words, and which edits can affect them.

The dictionary holds every gram of ``shortest`` characters, and longer ones as far as their
beginnings are frequent: a gram is prolonged by one character while it is in ``frequent``.
A word, between a begin and an end mark, is decomposed into the longest gram at each
position, without those that lie inside an earlier one.

One inserted, deleted or replaced character affects the grams it lies in.  A gram before it
stays: the gram at an earlier position reads the same characters, and one that is prolonged
over the edit covered it before.  A gram behind it can only go if a gram over the edit now
reaches its end; the characters from the edit to that end, without the last, must then be
the end of a frequent gram.  So each gram has a range of edits that can affect it, and of
two grams with separate ranges one stays whatever the edit is: the words near a word are in
the merged lists of such a pair.  Grams have at most half the characters of the marked word,
so the first and the last one always are such a pair; the cheapest pair is taken.
"""

from __future__ import annotations

from dataclasses import dataclass, field

BEGIN, END = "\x02", "\x03"


@dataclass(frozen=True)
class GramDictionary:
    """``frequent``: grams of ``shortest`` to ``longest - 1`` characters that are prolonged, with
    their numbers of occurrences; every beginning of such a gram must be among them."""
    shortest: int
    longest: int
    frequent: dict[str, int]
    tails: frozenset[str] = field(init=False, repr=False)

    def __post_init__(self):
        if not 2 <= self.shortest <= 3 or self.longest < self.shortest:
            raise ValueError("the shortest grams have two or three characters, the longest no fewer")
        object.__setattr__(self, "tails", frozenset(
            g[i:] for g in self.frequent for i in range(1, len(g) - self.shortest + 2)))

    def limit(self, size: int) -> int:
        """Most characters of a gram where the shorter of two words has ``size``."""
        return max(self.shortest, min(self.longest, (size + 2) // 2))

    def grams(self, word: str, size: int) -> list[tuple[int, str]]:
        """(position, gram) of the marked word, compared with words of ``size`` characters or more."""
        s, limit = BEGIN + word + END, self.limit(size)
        out, covered = [], 0
        for p in range(len(s) - self.shortest + 1):
            end = p + self.shortest
            while end - p < limit and end < len(s) and s[p:end] in self.frequent:
                end += 1
            if end > covered:
                out.append((p, s[p:end]))
                covered = end
        return out

    def affected_by(self, s: str, p: int, gram: str, limit: int) -> tuple[int, int]:
        """First and last edit that can affect the gram at ``p`` of the marked word ``s``.

        Edits are numbered from left to right: 2 * i for character i replaced or deleted,
        2 * i - 1 for one inserted before it."""
        q = p + len(gram) - 1
        first = 2 * p if p else 1
        for i in range(max(1, q - limit + 2), p + 1):  # characters i to q stand behind the edit
            if any(s[i:e] in self.tails for e in range(q, min(i + limit - 2, len(s) - 1) + 1)):
                first = min(first, 2 * i - 2 if i > 1 else 1)
        return first, 2 * q

    def cheapest_pair(self, word: str) -> list[tuple[int, str]]:
        """Two grams of the word of which any one edit leaves one as it is, with the least
        sum of occurrences."""
        s, limit = BEGIN + word + END, self.limit(len(word))
        found = []
        for p, g in self.grams(word, len(word)):
            first, last = self.affected_by(s, p, g, limit)
            found.append((last, first, self.frequent.get(g, 0), (p, g)))
        best, left, ended = None, None, 0
        # from left to right, ``left`` is the cheapest gram whose edits end before the next begins
        ends = sorted(found, key=lambda f: f[0])
        for last, first, cost, gram in sorted(found, key=lambda f: f[1]):
            while ended < len(ends) and ends[ended][0] < first:
                if left is None or ends[ended][2] < left[0]:
                    left = (ends[ended][2], ends[ended][3])
                ended += 1
            if left and (best is None or left[0] + cost < best[0]):
                best = (left[0] + cost, [left[1], gram])
        if best is None:
            raise AssertionError(f"no two grams of {word!r} with separate edits")
        return best[1]


def letters(word: str) -> int:
    """A bit for each character that occurs; one edit changes two of them at most."""
    bits = 0
    for c in word:
        bits |= 1 << ord(c) % 61
    return bits
