"""Characters that look the same: tables, compatibility folding, and the lattice search over readings."""

from __future__ import annotations

import math
import re
import unicodedata
from collections import defaultdict

# Characters without any width or ink.
IGNORABLE = "­͏؜ᅟᅠ឴឵᠋᠌᠍᠎​‌‍‎‏‪‫‬‭‮⁠⁡⁢⁣⁤⁦⁧⁨⁩﻿︀︁︎️"
# Spaces of any width.
SPACES = "               　"
# Hyphens drawn like the ASCII one.
HYPHENS = "‐‑⁃﹣－"
# Letters of other scripts and the Latin letters they look like.
CYRILLIC = dict(zip("аеіјорсѕухһԁԛԝӏАВЕЅІЈКМНОРСТХУԚԜӀ", "aeijopcsyxhdqwlABESIJKMHOPCTXYQWI", strict=True))
GREEK = dict(zip("οναιρυκΑΒΕΖΗΙΚΜΝΟΡΤΥΧ", "ovaipukABEZHIKMNOPTYX", strict=True))
ARMENIAN = dict(zip("օոսհցՕՍԼ", "onuhgOUL", strict=True))
LATIN = dict(zip("ıɡɑᴏѵꞓ", "igaovc", strict=True))

TO_LATIN = CYRILLIC | GREEK | ARMENIAN | LATIN
OTHERS = r"Ͱ-ϿЀ-ԯ԰-֏"
#: Compatibility forms that look different from what they stand for stay as they are.
_KEPT = ("<super>", "<sub>", "<fraction>", "<circle>", "<square>")


def _fold_char(c: str) -> str:
    if c in IGNORABLE:
        return ""
    if c in SPACES:
        return " "
    if c in HYPHENS:
        return "-"
    d = unicodedata.decomposition(c)
    if d.startswith("<") and not d.startswith(_KEPT):
        return unicodedata.normalize("NFKC", c)
    return c


_NOT_ASCII = re.compile(r"[^\x00-\x7f]+")


class _Runs(dict):
    """Folded forms of runs of non-ASCII characters, filled as runs are met."""

    def __init__(self, make):
        super().__init__()
        self.make = make

    def __missing__(self, run: str) -> str:
        if len(self) > 100_000:
            self.clear()
        self[run] = got = self.make(run)
        return got

    def __call__(self, text: str) -> str:
        text = _NOT_ASCII.sub(lambda m: self[m.group()], text)
        return text if unicodedata.is_normalized("NFC", text) else unicodedata.normalize("NFC", text)


_folded = _Runs(lambda run: "".join(map(_fold_char, run)))
_TOKEN = re.compile(r"[^\W_]+(?:[̀-ͯ]+[^\W_]*)*")
_OTHER = re.compile(f"[{OTHERS}ıɡɑᴏꞓ]")


def fold(text: str) -> str:
    """Compatibility normalization, spaces and hyphens of one form, ignorable characters gone, accents composed."""
    return text if text.isascii() else _folded(text)


def _script(c: str) -> str:
    o = ord(c)
    return "G" if 0x370 <= o < 0x400 else "C" if 0x400 <= o < 0x530 else "A" if 0x530 <= o < 0x590 else "L"


_READINGS: dict[str, list[tuple[str, str]]] = defaultdict(list)
for _c, _l in TO_LATIN.items():
    if (_l, "L") not in _READINGS[_l]:
        _READINGS[_l].append((_l, "L"))
    if _c not in LATIN:
        _READINGS[_l].append((_c, _script(_c)))


class Lattice:
    """Viterbi search over the readings of a token.

    A token's lattice holds, at each place, every letter that looks like the
    one written, so equal-looking tokens have the same lattice and come out
    equal.  A path's score is that of character bigrams within a script, with a
    price for each change of script and a prior from the letters of the whole
    text that exist in one script only.
    """

    SWITCH = -12.0

    def __init__(self, bigrams: dict[str, int]):
        self.logp: dict[str, float] = {}
        first: dict[str, int] = defaultdict(int)
        for ab, n in bigrams.items():
            first[ab[0]] += n
        for ab, n in bigrams.items():
            self.logp[ab] = math.log((n + 0.5) / (first[ab[0]] + 32))
        self.unseen = {a: math.log(0.5 / (n + 32)) for a, n in first.items()}
        self.memo: dict[tuple[str, str], str] = {}

    def step(self, a: str, b: str) -> float:
        ab = (a + b).lower()
        got = self.logp.get(ab)
        return self.unseen.get(ab[0], -4.0) if got is None else got

    @staticmethod
    def places(token: str, scripts: str) -> list[list[tuple[str, str, str]]]:
        """(letter as read, its script, the letter without marks) for each reading of each place."""
        out = []
        for c in token:
            parts = unicodedata.normalize("NFD", c)
            base, marks = parts[0], parts[1:]
            reads = _READINGS.get(TO_LATIN.get(base, base))
            here = [(unicodedata.normalize("NFC", r + marks), s, r) for r, s in reads if s in scripts] if reads else []
            out.append(here or [(c, _script(base), base)])
        return out

    def read(self, token: str, prior: dict[str, float]) -> str:
        places = self.places(token, "".join(prior))
        best = [prior.get(s, -20.0) for _, s, _ in places[0]]
        back: list[list[int]] = []
        for before, here in zip(places, places[1:], strict=False):
            now, links = [], []
            for _, s, c in here:
                score, link = max((best[i] + self.step(p, c) + (0.0 if ps == s or not (p.isalpha() and c.isalpha()) else self.SWITCH), -i) for i, (_, ps, p) in enumerate(before))
                now.append(score)
                links.append(-link)
            best, back = now, [*back, links]
        i = max(range(len(best)), key=lambda k: (best[k], -k))
        chars = [places[-1][i][0]]
        for links, here in zip(reversed(back), reversed(places[:-1]), strict=True):
            i = links[i]
            chars.append(here[i][0])
        return "".join(reversed(chars))

    def canonical(self, text: str) -> str:
        """One form for all texts that look like ``text``."""
        if text.isascii():
            return text  # its readings in other scripts have a prior of nothing
        text = fold(text)
        if not _OTHER.search(text):
            return text
        # Letters that exist in one script only say which scripts the text is in.
        own = dict.fromkeys("LCGA", 0)
        for c in set(text):
            base = unicodedata.normalize("NFD", c)[0]
            if base.isalpha() and TO_LATIN.get(base, base) not in _READINGS:
                own[_script(base)] += text.count(c)
        total = sum(own.values())
        prior = {s: math.log((n + 0.5) / (total + 0.5)) for s, n in own.items() if n or s == "L"}
        alone = len(prior) == 1

        def word(m: re.Match) -> str:
            t = m.group()
            if not alone:
                return self.read(t, prior)
            if t.isascii():
                return t
            if t not in self.memo:
                if len(self.memo) > 200_000:
                    self.memo.clear()
                self.memo[t] = self.read(t, prior)
            return self.memo[t]

        # A combining mark left by itself would make equal letters differ.
        return unicodedata.normalize("NFC", _TOKEN.sub(word, unicodedata.normalize("NFC", text)))


_SKELETON = str.maketrans(TO_LATIN)
_latin = _Runs(lambda run: unicodedata.normalize("NFD", "".join(map(_fold_char, run))).translate(_SKELETON))


def skeleton(text: str) -> str:
    """The all-Latin reading: enough where both sides are known to be Latin text."""
    return text if text.isascii() else _latin(text)
