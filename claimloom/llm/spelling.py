"""Bounded edit distance look-ups: a symmetric-delete dictionary, ranked by weighted Damerau-Levenshtein."""

from __future__ import annotations

from collections import defaultdict

_VOWELS = frozenset("aeiouy")


def distance(a: str, b: str, most: float = 9.0) -> float:
    """Weighted Damerau-Levenshtein (optimal alignment): swaps, doubled letters and vowel for vowel cost less than 1.

    Exact up to ``most``, and something above it beyond: a letter too much or too few costs
    0.7 at least, so only a band along the diagonal can matter.
    """
    n, reach, far = len(b), int(most / 0.7), most + 1
    if abs(len(a) - n) > reach:
        return far
    before2: list[float] = []
    before = [float(j) if j <= reach else far for j in range(n + 1)]
    low = 0.0
    for i, x in enumerate(a, 1):
        start, stop = max(1, i - reach), min(n, i + reach)
        row = [far] * (n + 1)
        if i <= reach:
            row[0] = float(i)
        for j in range(start, stop + 1):
            y = b[j - 1]
            if x == y:
                c = before[j - 1]
            else:
                c = before[j - 1] + (0.8 if x in _VOWELS and y in _VOWELS else 1.0)
            c = min(c, before[j] + (0.7 if i > 1 and a[i - 2] == x else 1.0), row[j - 1] + (0.7 if j > 1 and b[j - 2] == y else 1.0))
            if i > 1 and j > 1 and x == b[j - 2] and a[i - 2] == y and x != y:
                c = min(c, before2[j - 2] + 0.8)
            row[j] = c
        if (least := min(row)) > most and low + 0.8 > most:
            return far  # every alignment goes through this row, or by a swap through the one before
        before2, before, low = before, row, least
    return min(before[-1], far)


def deletes(word: str, most: int) -> set[str]:
    """The word and what is left when up to ``most`` letters are taken away."""
    level = out = {word}
    for _ in range(most):
        level = {w[:i] + w[i + 1 :] for w in level for i in range(len(w))}
        out = out | level
    return out


#: Longer words are looked up by pieces: their deletions would grow with the square of the length.
LONG = 14


def piece_keys(word: str, length: int, shifts: range) -> set[str]:
    """Pieces of ``word`` at the places, moved by ``shifts``, of the five pieces of a word of ``length`` letters.

    Two edits, swaps included, touch four pieces at most, so one of the five stays, moved by two places at most.
    """
    cuts = [length * k // 5 for k in range(6)]
    return {f"{length} {k} {word[a + s : b + s]}" for k, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False)) for s in shifts if a + s >= 0 and b + s <= len(word)}


def edits_allowed(word: str) -> int:
    return 0 if len(word) < 4 else 1 if len(word) < 6 else 2


def entries(word: str) -> int:
    """Index entries of a reference word, at most."""
    n = len(word)
    return 5 if n > LONG else (1, 1 + n, 1 + n + n * (n - 1) // 2)[edits_allowed(word)]


class Dictionary:
    """Reference words with frequencies, found within a bounded edit distance."""

    def __init__(self, words: dict[str, float]):
        self.words = words
        self.lengths = {len(w) for w in words}
        self.index: dict[str, list[str]] = defaultdict(list)
        for w in words:
            for d in piece_keys(w, len(w), range(1)) if len(w) > LONG else deletes(w, edits_allowed(w)):
                self.index[d].append(w)
        self.memo: dict[tuple[str, int], list[tuple[float, float, str]]] = {}

    def lookup(self, word: str, most: int = 2) -> list[tuple[float, float, str]]:
        """(distance, -frequency, reference word), best first, at most ``most`` edits off.

        A reference word allows as many edits as its length does; a word of
        five letters may still be two cheap edits off.
        """
        if word in self.words:
            return [(0.0, -self.words[word], word)]
        if self.lengths.isdisjoint(range(len(word) - most, len(word) + most + 1)):
            return []
        got = self.memo.get((word, most))
        if got is None:
            if len(self.memo) > 300_000:
                self.memo.clear()
            got = self.memo[word, most] = self._lookup(word, most)
        return got

    def _lookup(self, word: str, most: int) -> list[tuple[float, float, str]]:
        own = 2 if len(word) == 5 else edits_allowed(word)
        far = min(1.8 if len(word) == 5 else float(own), float(most))
        most = min(own, most)
        if not most:
            return []
        n = len(word)
        near_lengths = [m for m in range(n - most, n + most + 1) if m in self.lengths]
        keys = deletes(word, most) if any(m <= LONG for m in near_lengths) else set()
        for m in near_lengths:
            if m > LONG:
                keys |= piece_keys(word, m, range(-2, 3))
        near = {w for d in keys for w in self.index.get(d, ()) if abs(len(w) - n) <= most}
        got = ((distance(word, w, far), -self.words[w], w) for w in near)
        return sorted(x for x in got if x[0] <= min(far, edits_allowed(x[2])))
