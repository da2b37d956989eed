"""Problem 5: noise in text from scanned pages.

Lines are labelled by a hidden Markov model over layout features (body, running
head, page number, section heading, other, blank) with Viterbi decoding.  The
model is fitted by expectation maximisation on all lines of papers, for which
the verdict of an earlier run is a second, unreliable observation.  Words
cut at line ends are joined over whatever page furniture stands in between, and
misread words are those that scanning confusions turn into much more frequent
words of the corpus, the likelier confusion first.  Paragraphs are put together
again from the body lines.
"""

from __future__ import annotations

import re
from collections import Counter, defaultdict
from collections.abc import Callable, Container, Iterable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from claimloom.llm.lookalike import skeleton
from claimloom.scratch import Scratch

#: A word belongs to the vocabulary if it is at least this share of all words, so the vocabulary has at most 1/share words.
WORD_SHARE = 1e-6
WORD_LEAST = 3
#: A reading must be this many times as frequent as the word as written.
RATIO = 30
#: A line is a known running head if this share of all documents repeat it: at most 1/share of them, times the heads of a document.
HEAD_SHARE = 1e-4
HEAD_LEAST = 2
#: The model of lines is fitted in so many rounds on all lines, cut in windows of so many.
FIT_WINDOW, FIT_ROUNDS = 100, 6
#: Lines of one paper are labelled in chunks of so many, with so many lines of context on either side.
CHUNK, CONTEXT = 2000, 200

# What scanning writes, and what stood there.
CONFUSIONS = (("c", "e"), ("f", "t"), ("5", "s"), ("0", "o"), ("1", "l"), ("1", "i"), ("9", "g"), ("ii", "u"), ("cl", "d"), ("li", "h"), ("m", "in"), ("rn", "m"), ("6", "b"), ("8", "b"), ("2", "z"), ("vv", "w"))
_CUTS = "-‐¬­"
_WORD = re.compile(r"[^\W_]+")
_HYPHEN = re.compile(rf"([^\W\d_][^\W_]*)[{_CUTS}]$")
_CUT_ENDS = tuple(_CUTS)
_STARTS = re.compile(r"[^\W_]+")
_DIGITS = str.maketrans("lIiOoSsg", "11100559")
_NUMBER = re.compile(r"^\s*(page|p\.|pp\.|[-–—]|\[|\()?\s*([0-9lIiOoSsg]{1,5}|[ivxlcdm]{1,7})\s*([-–—\]).]|(?:of|/)\s*[0-9lIiOoSsg]{1,5})?\s*$", re.IGNORECASE)
_ROMAN = {"i": 1, "v": 5, "x": 10, "l": 50, "c": 100, "d": 500, "m": 1000}
_EDGE_NUMBER = re.compile(r"^\s*\W*[0-9lIOo]{1,5}\W*\s+(?=\S)|(?<=\S)\s+\W*[0-9lIOo]{1,5}\W*\s*$")
_NOT_TITLE = re.compile(r"[^\w\s]|[\d_]")
_SOFT_END = re.compile(r"\u00ad(?=[ \t]*(?:\n|$))")
_CUT_LINE = re.compile(rf"[^\W\d_][{_CUTS}][ \t]*\n")
_NOT_PROSE = re.compile(r"[^\w\s]|[\d_]")
_TABLE = re.compile(r"^\s*\||\t|\S   +\S|; ")


def vocabulary_counts(texts: DataFrame) -> DataFrame:
    """``(word, n)``: lower-case words of all texts; each task adds up its own before anything is shuffled."""

    def words(pieces: Counter) -> pd.DataFrame:
        seen: Counter = Counter()
        for piece, n in pieces.items():
            for w in _WORD.findall(piece):
                seen[w] += n
        return pd.DataFrame({"word": list(seen), "n": list(seen.values())}, columns=["word", "n"]).astype({"word": "str", "n": "int64"})

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        # no word goes over a blank, so what stands between blanks is counted, and taken apart once
        pieces: Counter = Counter()
        size = 0
        for b in batches:
            for t in b["text"]:
                pieces.update(t.lower().split())
                size += len(t)
                if len(pieces) > 300_000 or size > 50_000_000:  # letters without blanks may go on and on
                    yield words(pieces)
                    pieces, size = Counter(), 0
        yield words(pieces)

    return texts.select("text").where("text <> ''").mapInPandas(count, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


def once(word: str) -> Iterator[tuple[str, tuple[str, str]]]:
    """Readings of a word one confusion away."""
    for c in CONFUSIONS:
        wrong, right = c
        at = word.find(wrong)
        while at >= 0:
            yield word[:at] + right + word[at + len(wrong) :], c
            at = word.find(wrong, at + 1)


def explained(words: Iterable[str], frequent: Container[str]) -> Counter:
    """How many of the words each confusion takes for one of the frequent ones."""
    seen: Counter = Counter()
    for w in words:
        seen.update({c for v, c in once(w) if v in frequent})
    return seen


def frequent_words(texts: DataFrame) -> tuple[dict[str, int], Counter]:
    """(words that are at least WORD_SHARE of all words, never more than 1/WORD_SHARE of them; how many of all rarer ones each confusion explains)."""
    spark = texts.sparkSession
    scratch = Scratch(spark, "words")
    counts = scratch.cut(vocabulary_counts(texts), "counts", n=F.sum("n"))
    least = max(WORD_LEAST, (scratch.seen["n"] or 0) * WORD_SHARE)
    words = {r["word"]: r["n"] for r in counts.where(F.col("n") >= least).collect()}
    shared = spark.sparkContext.broadcast(frozenset(w for w, n in words.items() if n >= RATIO))

    def explain(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seen: Counter = Counter()
        for b in batches:
            seen.update(explained(b["word"], shared.value))
        yield pd.DataFrame({"c": [CONFUSIONS.index(c) for c in seen], "n": list(seen.values())}, dtype="int64")

    rare = counts.where(F.col("n") < least).select("word").mapInPandas(explain, "c long, n long").groupBy("c").agg(F.sum("n").alias("n")).collect()
    shared.unpersist()
    return words, Counter({CONFUSIONS[r["c"]]: r["n"] for r in rare})


class Reader:
    """Finds the word that a misread word stood for: a noisy channel of scanning confusions before the corpus's words."""

    def __init__(self, vocabulary: dict[str, int], rare: Iterable[str] = (), counted: Counter | None = None):
        """``counted`` is what :func:`explained` says of the rare words, where that was counted elsewhere."""
        self.vocabulary = vocabulary
        self.memo: dict[str, str] = {}
        self.right: set[str] = set()
        # how often each confusion explains a rare word, added to one
        seen = Counter({c: 1 for c in CONFUSIONS})
        seen.update(explained(rare, {w for w, n in vocabulary.items() if n >= RATIO}) if counted is None else counted)
        self.weight = {c: n / seen.total() for c, n in seen.items()}

    def correct(self, word: str) -> str:
        """The word as it stood in print; '' if it was read rightly, or nobody can tell."""
        got = self.memo.get(word)
        if got is None:
            if len(self.memo) > 500_000:
                self.memo.clear()
            got = self.memo[word] = self._correct(word)
        return got

    def misread(self, text: str) -> bool:
        """Whether any word of a lower-case text was misread; what stood between blanks before costs one set difference."""
        new = set(text.split()) - self.right
        if not new:
            return False
        wrong = {p for p in new if any(map(self.correct, _WORD.findall(p)))}
        if len(self.right) > 500_000:
            self.right.clear()
        self.right.update(p for p in new - wrong if len(p) <= 40)
        return bool(wrong)

    def _correct(self, word: str) -> str:
        if len(word) < 3 or not any(c.isalpha() for c in word):
            return ""
        if word[-1].isdigit() and sum(word[:-1] + d in self.vocabulary for d in "123456789") >= 4:
            return ""  # a numbered name, such as wave5
        have = self.vocabulary.get(word, 0)
        level, best = {word: 1.0}, ""
        for _ in range(2):
            nxt: dict[str, float] = {}
            for w, p in level.items():
                for v, c in once(w):
                    nxt[v] = max(nxt.get(v, 0.0), p * self.weight[c])
            known = [(p * self.vocabulary[v], v) for v, p in nxt.items() if v in self.vocabulary and v.isalpha() and self.vocabulary[v] >= RATIO * max(1, have)]
            if known:
                best = max(known)[1]
                break
            if have:
                break  # two confusions at once only where the word itself is unknown
            level = nxt
        return best


def page_value(text: str) -> tuple[str, int] | None:
    """(style, number) of a line that holds nothing but a page number; look-alike digits are read as digits."""
    m = _NUMBER.match(text)
    if not m:
        return None
    before, body, after = (m.group(1) or "").lower(), m.group(2), m.group(3) or ""
    of = after[:1] in ("o", "O", "/")
    style = before + "#" + ("of" if of else after)
    if not any(c.isdigit() for c in body):
        low = body.lower()
        if style == "#" and low in ("i", "mm", "mi", "dim", "mix", "mild", "mid", "civil", "livid", "vivid", "mimic", "d", "c", "m"):
            return None
        if all(c in _ROMAN for c in low) and body in (low, body.upper()):
            v = [_ROMAN[c] for c in low]
            return "roman" + style, sum(-a if a < b else a for a, b in zip(v, [*v[1:], 0], strict=True))
    body = body.translate(_DIGITS)
    return (style, int(body)) if body.isdigit() else None


def head_key(text: str) -> str:
    """Letters of a possible running head, without page number, spacing, case and scanning confusions; '' for other lines."""
    t = text.strip()
    if not t or not (t[0].isupper() or t[0].isdigit() or t[0] in "li") or t[-1] in ".,;:?!" or t.count(" ") < 2:
        return ""
    core = _EDGE_NUMBER.sub("", t)
    if len(core.split()) < 3 or len(_NOT_TITLE.findall(core)) > 0.15 * len(core):
        return ""
    if core.upper() != core and sum(w[0].isupper() or w[0].isdigit() for w in core.split()) < 2:
        return ""
    k = "".join(c for c in core.lower() if c.isalnum())
    for a, b in (("rn", "m"), ("in", "m"), ("ii", "u"), ("cl", "d"), ("li", "h"), ("c", "e"), ("f", "t"), ("5", "s"), ("0", "o"), ("1", "l"), ("9", "g")):
        k = k.replace(a, b)
    return k


# The hidden Markov model: states (body text, running head, page number, section heading, other, blank), what a line
# looks like, and what an earlier run may have called it.
STATES = "THNSOB"
LOOKS = ("blank", "styled number", "number at an edge", "number", "odd number", "head at an edge", "head", "marked heading", "title", "table", "short", "long")
LABELS = ("", "running_head", "page_number", "heading", "table_row", "blank", "unknown")
# What the fit begins with: log-odds of one state following another, and of a state given a look.  Fitting replaces them.
_STEP = {("T", "T"): 0.4, ("T", "S"): -0.2, ("S", "S"): -1.5, ("S", "T"): 0.3, ("N", "N"): -2.0, ("H", "H"): -2.0, ("N", "H"): 0.6, ("H", "N"): 0.6, ("T", "N"): -0.1, ("T", "H"): -0.1, ("B", "T"): 0.2, ("T", "B"): 0.1, ("B", "S"): 0.3, ("O", "O"): 0.5}
_LOOK = {
    "blank": {"B": 5.0},
    "styled number": {"T": -1.0, "S": -1.5, "O": -5.0, "N": 5.0},
    "number at an edge": {"T": -1.0, "S": -1.5, "O": -4.0, "N": 5.0},
    "number": {"T": -1.0, "S": -1.5, "O": 0.5, "N": 4.0},
    "odd number": {"T": -1.0, "S": -1.5, "O": 1.5, "N": -4.0},
    "head at an edge": {"T": -1.0, "S": -1.5, "O": -1.0, "H": 5.0},
    "head": {"T": -1.0, "S": -1.5, "O": -1.0, "H": 4.0},
    "marked heading": {"T": 1.0, "S": 5.0, "O": -1.0},
    "title": {"T": 1.0, "S": 1.6, "O": -1.0},
    "table": {"T": -0.5, "S": -1.5, "O": 2.0},
    "short": {"T": 1.0, "S": -1.5, "O": -1.0},
    "long": {"T": 1.0, "S": -4.0, "O": -3.5},
}


class LineModel:
    """Log-probabilities of steps between states, and of states given a look; states that a look all but rules out are left away."""

    def __init__(self, step: dict[tuple[str, str], float], look: dict[str, dict[str, float]]):
        self.step, self.look = step, look


def looks(lines: list[str], numbers: dict[int, str], heads: list[bool], edge: list[bool]) -> list[str]:
    """What each line looks like, from its layout; ``numbers`` are the number lines with how far they agree with the others."""
    out = []
    for i, t in enumerate(lines):
        s = t.strip()
        if not s:
            out.append("blank")
        elif i in numbers:
            out.append("number at an edge" if numbers[i] == "number" and edge[i] else numbers[i])
        elif heads[i]:
            out.append("head at an edge" if edge[i] else "head")
        elif s[0] == "#":
            out.append("marked heading")
        elif len(s) < 40 and s[0].isupper() and s[-1].isalnum() and s.count(" ") <= 1 and len(s.split()) <= 2:
            out.append("title")
        elif ("|" in t or "\t" in t or "   " in t or "; " in t) and _TABLE.search(t) or len(_NOT_PROSE.findall(s)) > 0.45 * len(s):
            out.append("table")
        else:
            out.append("long" if len(s) >= 60 else "short")
    return out


#: Probabilities of a model in the making: of looks and of labels given a state, of steps, and of the first state.
Guess = tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]
#: One letter each, so that windows are two strings.
_LOOK_LETTER = {x: chr(97 + i) for i, x in enumerate(LOOKS)}
_LABEL_LETTER = {x: chr(97 + i) for i, x in enumerate(LABELS)}


def expect(windows: list[tuple[str, str]], guess: Guess) -> np.ndarray:
    """Expected numbers of steps, looks and labels of each state (one row per state, side by side) in windows of (looks, labels) in letters."""
    emit, wrong, walk, first = guess
    k, m = len(STATES), len(LOOKS)
    out = np.zeros((k, k + m + len(LABELS)))
    windows = sorted(windows, key=lambda w: len(w[0]))  # little is padded
    for lo in range(0, len(windows), 500):
        part = windows[lo : lo + 500]
        n, t = len(part), len(part[-1][0])
        at, label, mask = np.zeros((n, t), int), np.zeros((n, t), int), np.zeros((n, t), bool)
        for i, (x, y) in enumerate(part):
            at[i, : len(x)] = np.frombuffer(x.encode(), np.uint8) - 97
            label[i, : len(y)] = np.frombuffer(y.encode(), np.uint8) - 97
            mask[i, : len(x)] = True
        b = emit.T[at] * wrong.T[label]
        b[~mask] = 1.0
        fwd, bwd = np.zeros((n, t, k)), np.ones((n, t, k))
        fwd[:, 0] = first * b[:, 0]
        fwd[:, 0] /= fwd[:, 0].sum(axis=1, keepdims=True) + 1e-300
        for i in range(1, t):
            fwd[:, i] = (fwd[:, i - 1] @ walk) * b[:, i]
            fwd[:, i] /= fwd[:, i].sum(axis=1, keepdims=True) + 1e-300
        for i in range(t - 2, -1, -1):
            bwd[:, i] = (bwd[:, i + 1] * b[:, i + 1]) @ walk.T
            bwd[:, i] /= bwd[:, i].sum(axis=1, keepdims=True) + 1e-300
        post = fwd * bwd
        post = post[mask] / (post[mask].sum(axis=1, keepdims=True) + 1e-300)
        ahead = mask[:, 1:]
        here, there = fwd[:, :-1][ahead], (bwd[:, 1:] * b[:, 1:])[ahead]
        here /= ((here @ walk) * there).sum(axis=1, keepdims=True) + 1e-300
        out[:, :k] += walk * (here.T @ there)
        for s in range(k):
            out[s, k : k + m] += np.bincount(at[mask], post[:, s], m)
            out[s, k + m :] += np.bincount(label[mask], post[:, s], len(LABELS))
    return out


def fit_model(share: np.ndarray, counts: Callable[[Guess], np.ndarray]) -> LineModel:
    """The model fitted by expectation maximisation to lines of which ``share`` have each look.

    ``counts`` is :func:`expect` over all windows.  A label is an observation of
    its own, with its own error rates, which are fitted too; the starting values
    count like three hundred lines of each state.
    """
    k, m = len(STATES), len(LOOKS)
    start = np.array([[_LOOK[x].get(s, -9.0) for x in LOOKS] for s in STATES])
    step = np.array([[_STEP.get((a, b), 0.0) for b in STATES] for a in STATES])
    share = share + 1.0
    emit = np.exp(start) * share / share.sum()
    mass = emit.sum(axis=1)
    emit /= mass[:, None]
    walk = np.exp(step) * mass
    walk /= walk.sum(axis=1, keepdims=True)
    unknown = LABELS.index("unknown")
    wrong = np.full((k, len(LABELS)), 0.2 / (len(LABELS) - 1))
    wrong[np.arange(k), np.arange(k)] = 0.8
    wrong[:, unknown] = 1.0
    prior_e, prior_w, first = emit * 300, walk * 300, mass / mass.sum()
    for _ in range(FIT_ROUNDS):
        got = counts((emit, wrong, walk, first))
        walk = prior_w + got[:, :k]
        walk /= walk.sum(axis=1, keepdims=True)
        first = got[:, k : k + m].sum(axis=1) + 1.0
        first /= first.sum()
        emit = prior_e + got[:, k : k + m]
        emit /= emit.sum(axis=1, keepdims=True)
        seen = 0.5 + got[:, k + m :]
        seen[:, unknown] = 0.0
        wrong = seen / seen.sum(axis=1, keepdims=True)
        wrong[:, unknown] = 1.0
    log = np.log(emit + 1e-300)
    keep = emit * first[:, None] >= 1e-6 * (emit * first[:, None]).max(axis=0)
    keep[STATES.index("B")] = [x == "blank" for x in LOOKS]
    keep[:, LOOKS.index("blank")] = [s == "B" for s in STATES]
    return LineModel({(a, b): float(np.log(walk[i, j])) for i, a in enumerate(STATES) for j, b in enumerate(STATES)}, {x: {s: float(log[i, j]) for i, s in enumerate(STATES) if keep[i, j]} for j, x in enumerate(LOOKS)})


def fit_lines(windows: list[tuple[list[str], list[str]]]) -> LineModel:
    """The model fitted to windows of (looks, labels); without windows the starting values stay."""
    if not windows:
        return LineModel(dict(_STEP), {x: dict(e) for x, e in _LOOK.items()})
    letters = [("".join(_LOOK_LETTER[v] for v in x), "".join(_LABEL_LETTER[v] for v in y)) for x, y in windows]
    share = Counter(v for x, _ in windows for v in x)
    return fit_model(np.array([share[x] for x in LOOKS], float), lambda guess: expect(letters, guess))


def line_windows(lines: DataFrame, known_heads: frozenset[str]) -> DataFrame:
    """``(looks, labels)``: windows of FIT_WINDOW lines in letters, of all lines of ``(line_id, doc_id, page, line_no, text, kept, drop_reason)``.

    The lines are read in the chunks in which :func:`line_repair` reads them; a line counts in its own chunk.
    """
    # other reasons tell of a line's characters, not of its place on the page
    said = F.when(F.col("kept"), "").when(~F.col("kept") & F.col("drop_reason").isin(*LABELS[1:]), F.col("drop_reason")).otherwise("unknown")
    rows = chunked(lines.withColumn("said", said), "said")

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for groups in grouped(batches, ["page", "text", "own", "said"]):
            out = []
            for (_, chunk), group in groups:
                pages, texts, own, labels = zip(*group, strict=True)
                texts = _read_lines("\n".join(t.replace("\n", " ") for t in texts))
                seen = _looks(texts, list(pages), known_heads, [head_key(t) for t in texts])
                mine = [i for i, c in enumerate(own) if c == chunk]
                out += [("".join(_LOOK_LETTER[seen[i]] for i in w), "".join(_LABEL_LETTER[labels[i]] for i in w)) for w in (mine[at : at + FIT_WINDOW] for at in range(0, len(mine), FIT_WINDOW))]
            yield pd.DataFrame(out, columns=["looks", "labels"], dtype="str")

    return rows.mapInPandas(read, "looks string, labels string")


def line_model(lines: DataFrame, known_heads: frozenset[str]) -> LineModel:
    """The model fitted on all lines of ``(line_id, doc_id, page, line_no, text, kept, drop_reason)``; each round adds up what tasks expect of their windows."""
    if "drop_reason" not in lines.columns:
        return fit_lines([])
    scratch = Scratch(lines.sparkSession, "looks")
    windows = scratch.cut(line_windows(lines, known_heads), "windows", **{c: F.sum(F.length("looks") - F.length(F.translate("looks", c, ""))) for c in _LOOK_LETTER.values()})
    share = np.array([scratch.seen[c] or 0 for c in _LOOK_LETTER.values()], float)
    if not share.sum():
        return fit_lines([])
    shape = (len(STATES), len(STATES) + len(LOOKS) + len(LABELS))

    def counts(guess: Guess) -> np.ndarray:
        def add(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            total = np.zeros(shape)
            for b in batches:
                total += expect(list(zip(b["looks"], b["labels"], strict=True)), guess)
            yield pd.DataFrame({"x": [total.ravel().tolist()]})

        # one row of numbers a task, added in their order, so runs agree
        return np.sum([r["x"] for r in windows.mapInPandas(add, "x array<double>").collect()], axis=0).reshape(shape)

    model = fit_model(share, counts)
    scratch.drop(windows)
    return model


def viterbi(seen: list[str], model: LineModel) -> str:
    """Likeliest states of lines with these looks."""
    if not seen:
        return ""
    odds = [model.look[x] for x in seen]
    step = model.step
    best, back = dict(odds[0]), []
    for e in odds[1:]:
        now, link = {}, {}
        for s, o in e.items():
            score, p = -1e9, ""
            for q, b in best.items():
                x = b + step.get((q, s), 0.0)
                if x > score:
                    score, p = x, q
            now[s], link[s] = score + o, p
        best = now
        back.append(link)
    s = max(best, key=lambda k: (best[k], k))
    out = [s]
    for link in reversed(back):
        s = link[s]
        out.append(s)
    return "".join(reversed(out))


def _looks(lines: list[str], pages: list[int] | None, known_heads: frozenset[str] | set[str], keys: list[str]) -> list[str]:
    """Looks of the lines; ``pages`` are page numbers in the file, where they are known."""
    numbers = {i: v for i, t in enumerate(lines) if _NUMBER.match(t) and (v := page_value(t)) is not None}
    filled = [i for i, t in enumerate(lines) if t.strip()]
    edge = [False] * len(lines)
    if pages:
        for a, i in enumerate(filled):
            near = [filled[b] for b in (a - 2, a - 1, a + 1, a + 2) if 0 <= b < len(filled)]
            edge[i] = a < 2 or a > len(filled) - 3 or any(pages[j] != pages[i] for j in near)
    counts = Counter(k for k in keys if k)
    many = [bool(k) and (k in known_heads or counts[k] >= 2 and (not pages or edge[i])) for i, k in enumerate(keys)]
    # The style and offset on which most number lines agree.
    groups: dict[tuple[str, int], list[int]] = defaultdict(list)
    if pages:
        for i, (style, v) in numbers.items():
            groups[style, v - pages[i]].append(i)
    else:
        chains: dict[str, list[tuple[int, int, list[int]]]] = defaultdict(list)
        for i, (style, v) in numbers.items():
            grown = max((c for c in chains[style] if 1 <= v - c[1] <= 2), key=lambda c: len(c[2]), default=None)
            if grown:
                chains[style].remove(grown)
                chains[style].append((grown[0], v, [*grown[2], i]))
            else:
                chains[style].append((v, v, [i]))
        for style, cs in chains.items():
            for n, (_, _, at) in enumerate(cs):
                groups[style, n] = at
    agree = dict.fromkeys(numbers, "odd number")
    if groups:
        furniture = [i for i in filled if many[i]]

        def worth(item: tuple[tuple[str, int], list[int]]) -> float:
            (style, _), at = item
            near = sum(any(abs(i - h) <= 2 for h in furniture) or edge[i] for i in at)
            return len({pages[i] for i in at} if pages else at) + 0.5 * near / len(at) + (0.7 if style != "#" else 0.0)

        (style, _), at = max(groups.items(), key=worth)
        alone = len(at) == 1
        for i in at:
            if style != "#":
                agree[i] = "styled number"
            elif not alone or edge[i] or any(abs(i - h) <= 2 for h in furniture):
                agree[i] = "number"
    # without pages nobody knows the edges: what repeats and agrees is taken to stand there
    return looks(lines, agree, many, edge if pages else [True] * len(lines))


def _read_lines(whole: str) -> list[str]:
    """Lines in Latin letters, soft hyphens at their ends as hyphens, without blanks at the end."""
    if not whole.isascii():
        whole = skeleton(_SOFT_END.sub("-", whole))
    return [t.rstrip() for t in whole.split("\n")]


def inspect(lines: list[str], pages: list[int] | None, known_heads: frozenset[str] | set[str], reader: Reader, model: LineModel, repair: bool = False) -> tuple[str, dict[int, set[str]], dict[int, str]]:
    """(states, kinds found by line, body lines with their words repaired and cut words moved up).

    Most texts show at a glance that there is nothing to find: no line that
    could be page furniture, no cut and no misread word.  They have no states,
    unless ``repair`` asks for the paragraphs of clean lines, too.
    """
    lines = _read_lines("\n".join(lines))
    whole = "\n".join(lines)
    keys = [head_key(t) for t in lines]
    titled = set(filter(None, keys))
    wrong = reader.misread(whole.lower())
    cut = any(c + "\n" in whole for c in "-‐¬") and _CUT_LINE.search(whole)
    numbered = any(t and _NUMBER.match(t) for t in lines)
    if not repair and not wrong and not cut and not numbered and known_heads.isdisjoint(titled) and (len(titled) == len(keys) - keys.count("")):
        return "", {}, {}
    states = viterbi(_looks(lines, pages, known_heads, keys), model)
    found: dict[int, set[str]] = defaultdict(set)
    fixed: dict[int, str] = {}
    body = [i for i, s in enumerate(states) if s == "T"]
    head_cut: dict[int, int] = {}  # line -> length of the piece that belongs to the line before
    for n, i in enumerate(body):
        t = lines[i]
        skip_end = None
        m = _HYPHEN.search(t) if t.endswith(_CUT_ENDS) else None
        if m and n + 1 < len(body) and "S" not in states[i : body[n + 1]]:
            j = body[n + 1]
            rest = _STARTS.match(lines[j].lstrip())
            if rest and rest.group()[0].islower() | rest.group()[0].isdigit() and any(c.isalpha() for c in rest.group()):
                found[i].add("hyphen_break")
                joined = (m.group(1) + rest.group()).lower()
                right = reader.correct(joined)
                if right:
                    at = next((k for k, (a, b) in enumerate(zip(joined, right, strict=False)) if a != b), len(right))
                    found[i if at < len(m.group(1)) else j].add("misread")
                skip_end = m.start()
                fixed[i] = (right if right and m.group(1).islower() else m.group(1) + rest.group())
                head_cut[j] = len(lines[j]) - len(lines[j].lstrip()) + rest.end()
        start = head_cut.get(i, 0)
        text = t[start:skip_end] if skip_end is not None else t[start:]

        def word(m: re.Match, i=i) -> str:
            right = reader.correct(m.group().lower())
            if not right:
                return m.group()
            found[i].add("misread")
            return right.capitalize() if m.group()[0].isupper() else right

        fixed[i] = (_WORD.sub(word, text) if wrong and reader.misread(text.lower()) else text).lstrip() + fixed.get(i, "")
    return states, found, fixed


def pieces(lines: list[str], states: str, fixed: dict[int, str]) -> list[tuple[int, str, bool]]:
    """(line, its repaired text, whether it begins a paragraph) of all lines that aren't page furniture.

    Body lines go on the paragraph before them; headings and other lines stand by themselves.
    """
    width = sorted(len(lines[i]) for i in fixed)
    wide = width[len(width) * 3 // 4] if width else 0
    out: list[tuple[int, str, bool]] = []
    open_at = False
    for i, s in enumerate(states):
        if s in "HN":
            continue
        if s == "T":
            if open_at and out and out[-1][1]:
                if fixed[i]:
                    out.append((i, fixed[i], False))
            else:
                out.append((i, fixed[i], True))
            # a line much shorter than the column ends its paragraph
            open_at = len(lines[i]) >= 0.6 * wide and wide <= 130 or lines[i].endswith(_CUT_ENDS) and bool(_HYPHEN.search(lines[i]))
            continue
        nxt = next((states[j] for j in range(i + 1, len(states)) if states[j] not in "HNB"), "")
        before = next((j for j in range(i - 1, -1, -1) if states[j] not in "HNB"), -1)
        if s == "B" and nxt == "T" and before >= 0 and states[before] == "T" and "H" in states[before:i] + states[i:][: states[i:].find("T")] + " ":
            continue  # a blank beside page furniture isn't the end of a paragraph
        open_at = False
        out.append((i, "" if s == "B" else lines[i], True))
    return out


def paragraphs(lines: list[str], states: str, fixed: dict[int, str]) -> str:
    """A text put together again from its pieces."""
    out: list[str] = []
    for _, piece, opens in pieces(lines, states, fixed):
        if opens:
            out.append(piece)
        else:
            out[-1] += " " + piece
    return re.sub(r"\n{3,}", "\n\n", "\n".join(out)).strip("\n")


def split_pages(text: str) -> tuple[list[str], list[int] | None]:
    """Lines of a document, and their pages where form feeds mark them."""
    if "\f" not in text:
        return text.split("\n"), None
    lines, pages = [], []
    for p, page in enumerate(text.split("\f")):
        part = page.split("\n")
        if part and not part[-1] and len(part) > 1:
            part.pop()
        lines += part
        pages += [p] * len(part)
    return lines, pages


def repeated_heads(texts: DataFrame) -> set[str]:
    """Keys of title lines that at least HEAD_SHARE of the documents repeat within themselves."""

    def find(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seen: Counter = Counter()
        n = 0
        for b in batches:
            n += len(b)
            for t in b["text"]:
                keys = Counter(map(head_key, t.replace("\f", "\n").split("\n")))
                seen.update(k for k, c in keys.items() if k and c >= 2)
        yield pd.DataFrame({"k": [*seen, ""], "n": [*seen.values(), n]})

    got = texts.where("text <> ''").select("text").mapInPandas(find, "k string, n long").groupBy("k").agg(F.sum("n").alias("n"))
    got = Scratch(texts.sparkSession, "heads").cut(got, "heads")
    docs = got.where("k = ''").agg(F.sum("n").alias("n")).first()["n"] or 0
    return {r["k"] for r in got.where("k <> ''").where(F.col("n") >= max(HEAD_LEAST, docs * HEAD_SHARE)).collect()}


def _models(spark: SparkSession, docs: DataFrame, lines: DataFrame):
    """Broadcast (reader, known heads, model of lines): at most 1/WORD_SHARE words, 1/HEAD_SHARE heads times the heads of a document."""
    words, counted = frequent_words(docs.select("text").unionByName(lines.select("text")))
    known = frozenset(repeated_heads(docs))
    return spark.sparkContext.broadcast((Reader(words, counted=counted), known, line_model(lines, known)))


def document_noise(docs: DataFrame, shared) -> DataFrame:
    """``(doc_id, kinds, clean)``: the kinds of noise in each document of ``(doc_id, text)`` and its repaired text.

    NULL and empty texts have no noise and stay empty.
    """

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        reader, known, model = shared.value
        for b in batches:
            kinds, clean = [], []
            for t in b["text"]:
                lines, pages = split_pages(t or "")
                states, found, fixed = inspect(lines, pages, known, reader, model)
                got = set().union(*found.values()) if found else set()
                got |= {"running_head"} if "H" in states else set()
                got |= {"page_number"} if "N" in states else set()
                kinds.append(sorted(got))
                clean.append(paragraphs(lines, states, fixed) if got else (t or ""))
            yield pd.DataFrame({"doc_id": b["doc_id"], "kinds": kinds, "clean": clean})

    return docs.select("doc_id", "text").mapInPandas(read, "doc_id long, kinds array<string>, clean string")


def chunked(lines: DataFrame, *more: str) -> DataFrame:
    """``(line_id, line_no, doc_id, page, text, own, chunk, *more)``: lines in the chunks that read them, each chunk's in their order.

    A paper is read in chunks of CHUNK lines with CONTEXT lines of its
    neighbourhood, so no task holds more than that of any paper.  NULL texts are
    blank lines; ties of ``line_no`` go by ``line_id``; lines without a paper or
    number are taken in the order of their ids.
    """
    at = F.coalesce("line_no", "line_id")
    rows = lines.select("line_id", F.coalesce("doc_id", F.lit("")).alias("doc_id"), F.coalesce("page", F.lit(0)).alias("page"), at.cast("long").alias("line_no"), F.coalesce("text", F.lit("")).alias("text"), *more)
    own = F.floor(F.col("line_no") / CHUNK)
    place = F.pmod("line_no", F.lit(CHUNK))
    chunks = F.array_compact(F.array(own, F.when((place < CONTEXT) & (own > 0), own - 1), F.when(place >= CHUNK - CONTEXT, own + 1)))
    rows = rows.select("*", own.alias("own"), F.explode(chunks).alias("chunk"))
    # repartition by what the groups are made of; each group's lines then follow one another
    rows = rows.repartition("doc_id", "chunk").sortWithinPartitions("doc_id", "chunk", "line_no", "line_id")
    return rows.select("line_id", "line_no", "doc_id", "page", "text", "own", "chunk", *more)


def grouped(batches: Iterator[pd.DataFrame], columns: list[str]) -> Iterator[list[tuple[tuple[str, int], list[tuple]]]]:
    """Groups ((doc_id, chunk), rows of these columns) of :func:`chunked`, those that end in a batch together."""
    group: list[tuple] = []
    last = None
    for b in batches:
        out = []
        for doc, chunk, *row in zip(b["doc_id"], b["chunk"], *(b[c] for c in columns), strict=True):
            if (doc, chunk) != last:
                if group:
                    out.append((last, group))
                group, last = [], (doc, chunk)
            group.append(row)
        yield out
    if group:
        yield [(last, group)]


def line_repair(lines: DataFrame, shared) -> DataFrame:
    """``(line_id, doc_id, chunk, line_no, kinds, piece, para)`` for lines of ``(line_id, doc_id, page, line_no, text)``.

    ``kinds`` are the kinds of noise in the line, ``piece`` what it adds to its
    paragraph (NULL for page furniture), ``para`` the line that begins the
    paragraph, NULL where that lies before the chunk's context (:func:`chunked`).
    """
    rows = chunked(lines)
    columns = ["line_id", "doc_id", "chunk", "line_no", "kinds", "piece", "para"]

    def read_group(doc: str, chunk: int, group: list[tuple], shared: tuple) -> list[tuple]:
        reader, known, model = shared
        ids, numbers, pages, texts, own = zip(*group, strict=True)
        mine = [c == chunk for c in own]
        texts = [t.replace("\n", " ") for t in texts]
        states, found, fixed = inspect(texts, list(pages), known, reader, model, repair=True)
        piece, para, at = {}, {}, None
        for n, (i, text, opens) in enumerate(pieces(texts, states, fixed)):
            # whether the first line of the context begins a paragraph can't be seen here
            at = ids[i] if opens and (n or mine[0]) else at
            piece[i], para[i] = text, at
        furniture = {"H": ["running_head"], "N": ["page_number"]}
        return [(ids[i], doc, chunk, numbers[i], sorted(found.get(i, ())) + furniture.get(states[i], []), piece.get(i), para.get(i)) for i in range(len(ids)) if mine[i]]

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for groups in grouped(batches, ["line_id", "line_no", "page", "text", "own"]):
            out = [row for key, group in groups for row in read_group(*key, group, shared.value)]
            yield pd.DataFrame(out, columns=columns).astype({"para": "Int64"})

    return rows.mapInPandas(read, "line_id long, doc_id string, chunk long, line_no long, kinds array<string>, piece string, para long")


def line_noise(lines: DataFrame, shared) -> DataFrame:
    """``(line_id, kind)``: one row per line and kind of noise."""
    return line_repair(lines, shared).select("line_id", F.explode("kinds").alias("kind"))


def line_paragraphs(lines: DataFrame, shared) -> DataFrame:
    """``(doc_id, line_id, text)``: the lines' papers as continuous paragraphs, each named by its first line."""
    rows = Scratch(lines.sparkSession, "repair").cut(line_repair(lines, shared).where("piece is not null").drop("kinds"), "pieces")
    # a paragraph that began before a chunk's context: the last one begun in the chunks before
    last = rows.groupBy("doc_id", "chunk").agg(F.max_by("para", F.when(F.col("para").isNotNull(), F.struct("line_no", "line_id"))).alias("begun"))
    before = Window.partitionBy("doc_id").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    last = last.select("doc_id", "chunk", F.last("begun", ignorenulls=True).over(before).alias("open"))
    rows = rows.join(last, ["doc_id", "chunk"]).withColumn("para", F.coalesce("para", "open", "line_id"))
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line_no", "line_id", "piece"))), lambda x: x["piece"]), " ")
    return rows.groupBy("doc_id", F.col("para").alias("line_id")).agg(text.alias("text")).where("text <> ''")


def _tables(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text")
    lines = spark.read.parquet(f"{sf}/line_rows.parquet").select("line_id", "doc_id", "page", "line_no", "text", "kept", "drop_reason")
    return docs, lines


def p5_found(spark: SparkSession, sf: str) -> DataFrame:
    docs, lines = _tables(spark, sf)
    shared = _models(spark, docs, lines)
    of_docs = document_noise(docs, shared).select(F.lit("documents").alias("tbl"), F.col("doc_id").alias("id"), F.explode("kinds").alias("kind"))
    return of_docs.unionByName(line_noise(lines, shared).select(F.lit("line_rows").alias("tbl"), F.col("line_id").alias("id"), "kind"))


def p5_repaired(spark: SparkSession, sf: str) -> DataFrame:
    """Documents with scan noise, repaired into continuous paragraphs."""
    docs, lines = _tables(spark, sf)
    return document_noise(docs, _models(spark, docs, lines)).where("size(kinds) > 0").select("doc_id", "clean")


def p5_paragraphs(spark: SparkSession, sf: str) -> DataFrame:
    """The papers of ``line_rows`` as continuous paragraphs without page furniture."""
    docs, lines = _tables(spark, sf)
    return line_paragraphs(lines, _models(spark, docs, lines))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {"p5_found": p5_found, "p5_repaired": p5_repaired, "p5_paragraphs": p5_paragraphs}
SQL: dict[str, str] = {}
