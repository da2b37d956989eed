"""Problem 2: free spans mapped to the thesaurus entry they name; misses are reported.

The labels make a symmetric-delete dictionary of words and of joined labels,
which is broadcast after its entries were counted.  Spans are brought to words,
and each distinct word list is looked up once, by one task; hot spans get their
entry by a broadcast of at most HOT_SHARE rows, the others by a join.  A span
names a label if all of the label's words are found in it within a bounded
edit distance and what is left only frames the phrase.  Labels that fit are
ranked by weighted Damerau-Levenshtein distance, then by reference frequency.
"""

from __future__ import annotations

import re
from collections import Counter, defaultdict
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from claimloom.llm.hot import hot_keys, hot_threshold, spread
from claimloom.llm.lookalike import skeleton
from claimloom.llm.spelling import Dictionary, edits_allowed, entries
from claimloom.scratch import Scratch

#: The dictionary is broadcast (some 100 bytes an entry); a thesaurus that would need more entries is refused.
MOST_ENTRIES = 3_000_000

# Words that extend a phrase without changing what it names.
FRAMES = frozenset(
    "a an the of in at on to by with for from and or due among amongst between within across during over under per as is are was that this "
    "more less most higher lower greater lesser increased decreased levels level degree degrees sense feelings feeling amount amounts extent forms form kind kinds type types "
    "perceived self reported long short term daily life later early everyday baseline follow up time wave score scores scale index measure measures measured rating ratings overall general samples sample showing group".split()
)
#: What follows one of these names the people or the place, not the concept.
_WHO = frozenset("among amongst in of for by".split())
_MARKER = re.compile(r"\[(?:cls|sep|pad|unk|mask)\]", re.IGNORECASE)
_PIECE = re.compile(r"\s*##(?=\w)")
_CAMEL = re.compile(r"(?<=[a-z])(?=[A-Z][a-z])")
_TOKEN = re.compile(r"[^\W_]+")
_LINK = frozenset("of the a an".split())


def tokens(span: str) -> list[str]:
    """Lower-case words of a span, decoder marks removed and word pieces joined."""
    return _TOKEN.findall(_CAMEL.sub(" ", _PIECE.sub("", _MARKER.sub(" ", skeleton(span)))).lower())


def label_words(label: str) -> tuple[str, ...]:
    return tuple(w for w in tokens(label or "") if w not in _LINK)


def joined_ways(label: str) -> set[str]:
    """A label written as one word, in its order or the other way round."""
    words = label_words(label)
    return {"".join(words), "".join(reversed(words)), "".join(tokens(label))}


class Thesaurus:
    def __init__(self, rows: list[tuple[str, list[str]]]):
        self.labels: list[tuple[str, tuple[str, ...]]] = []
        freq: Counter = Counter()
        joined: dict[str, list[int]] = defaultdict(list)
        self.compounds: dict[str, tuple[str, ...]] = {}
        exact: set[tuple[str, tuple[str, ...]]] = set()
        for concept, labels in rows:
            for label in labels:
                words = label_words(label)
                if not words or (concept, words) in exact:
                    continue
                exact.add((concept, words))
                k = len(self.labels)
                self.labels.append((concept, words))
                freq.update(words)
                for part in label.lower().split():
                    if len(parts := label_words(part)) > 1:
                        self.compounds["".join(parts)] = parts
                for way in joined_ways(label):
                    joined[way].append(k)
        self.of_word: dict[str, list[int]] = defaultdict(list)
        for k, (_, words) in enumerate(self.labels):
            for w in set(words):
                self.of_word[w].append(k)
        self.freq = freq
        self.words = Dictionary({w: float(n) for w, n in freq.items()})
        self.joined = Dictionary({w: float(len(v)) for w, v in joined.items()})
        self.of_joined = dict(joined)
        self.compound = Dictionary({w: 1.0 for w in self.compounds})
        self.together: dict[str, list[tuple[float, str]]] = {}

    def name(self, words: str) -> str:
        """Id of the entry that a span of these words (parted by spaces) names; '' if there is none."""
        return self._name(words.split())

    def _rest_frames(self, toks: list[str], used: set[int]) -> bool:
        """Whether the tokens that aren't used only frame the phrase."""
        free = [i for i in range(len(toks)) if i not in used and toks[i] not in FRAMES and not toks[i].isdigit() and len(toks[i]) > 1]
        if not free:
            return True
        # at most one noun (two words) of people or place, after its preposition, before or behind the phrase
        return len(free) <= 2 and free[0] > 0 and (toks[free[0] - 1] in _WHO or toks[free[0] - 1] in ("the", "a") and free[0] > 1 and toks[free[0] - 2] in _WHO) and free == list(range(free[0], free[0] + len(free)))

    def _written_together(self, t: str) -> list[tuple[float, str]]:
        got = self.together.get(t)
        if got is None:
            if len(self.together) > 200_000:
                self.together.clear()
            got = self.together[t] = self._parts(t)
        return got

    def _parts(self, t: str, depth: int = 0) -> list[tuple[float, str]]:
        """Label words of a token in which words (and framing words) were joined; at most one of them misspelt."""
        for cut in range(len(t) - 3, 2, -1):
            left, right = t[:cut], t[cut:]
            known = left in self.words.words
            if not known and left not in FRAMES:
                continue
            own = [(0.0, left)] if known else []
            if right in self.words.words:
                return [*own, (0.0, right)]
            if right in FRAMES and own:
                return own
            if depth < 3 and len(right) >= 6 and (deep := self._parts(right, depth + 1)):
                return own + deep
            if near := self.words.lookup(right):
                return own + [(d, w) for d, _, w in near[:2]]
        for cut in range(3, len(t) - 2):
            if t[cut:] in self.words.words and (near := self.words.lookup(t[:cut])):
                return [(0.0, t[cut:]), *((d, w) for d, _, w in near[:2])]
        return []

    def _name(self, toks: list[str]) -> str:
        if not toks:
            return ""
        found: dict[str, list[tuple[float, tuple[int, ...]]]] = defaultdict(list)
        hits: list[tuple[float, float, str]] = []
        for i, t in enumerate(toks):
            if t in FRAMES and t not in self.words.words:
                continue
            for d, _, w in self.words.lookup(t):
                found[w].append((d, (i,)))
            if i + 1 < len(toks):
                two = t + toks[i + 1]
                if len(two) > 3 and two not in self.words.words or two in self.words.words and toks[i + 1] not in FRAMES:
                    for d, _, w in self.words.lookup(two, 1) if edits_allowed(two) else ():
                        if d == 0 or len(w) >= 6 and d < 1:
                            found[w].append((d + 0.5, (i, i + 1)))
            for near, at in ((t, (i,)), (t + toks[i + 1], (i, i + 1))) if i + 1 < len(toks) else ((t, (i,)),):
                for d, _, w in self.compound.lookup(near):
                    for part in self.compounds[w]:
                        found[part].append((d + 0.2, at))
            if len(t) >= 7 and t not in self.words.words:
                for d, f, w in self.joined.lookup(t):
                    if self._rest_frames(toks, {i}):
                        hits += [(d + 0.2, f, self.labels[k][0]) for k in self.of_joined[w]]
                for d, w in self._written_together(t):
                    found[w].append((d + 0.2, (i,)))
        core = [t for i, t in enumerate(toks) if t not in FRAMES and not t.isdigit() and not (i and toks[i - 1] in ("among", "amongst"))]
        whole = "".join(core)
        # words that are all spelt as in some label weren't parted or joined wrongly
        if len(whole) >= 10 and 1 < len(core) <= 6 and not all(t in self.words.words for t in core):
            for d, f, w in self.joined.lookup(whole):
                if d <= 1.8:
                    hits += [(d + 0.4, f, self.labels[k][0]) for k in self.of_joined[w]]
        for k in {k for w in found for k in self.of_word[w]}:
            concept, words = self.labels[k]
            total, used = 0.0, set()
            for w in words:
                if w not in found:
                    break
                d, at = min(found[w])
                total += d
                used |= set(at)
            else:
                if self._rest_frames(toks, used):
                    hits.append((total + 0.01 * (len(toks) - len(used)), -float(sum(self.freq[w] for w in words)), concept))
        return min(hits)[2] if hits else ""


def _dictionary_entries(label: str) -> int:
    return sum(entries(w) for w in (*label_words(label), *joined_ways(label)))


def _thesaurus(concepts: DataFrame) -> Thesaurus:
    """The dictionary of a thesaurus, built on the driver once its entries are known to be few enough."""

    @F.pandas_udf("long")
    def count(labels: pd.Series) -> pd.Series:
        return pd.Series([sum(map(_dictionary_entries, filter(None, x))) for x in labels], dtype="int64")

    rows = concepts.select("id", F.concat(F.array("leaf"), F.coalesce("alt", F.array().cast("array<string>"))).alias("labels"))
    n = rows.agg(F.sum(count("labels"))).first()[0] or 0
    if n > MOST_ENTRIES:
        raise ValueError(f"a dictionary of {n} entries is too large for a broadcast")
    return Thesaurus([(r["id"], r["labels"]) for r in rows.orderBy("id").collect()])


def map_spans(rows: DataFrame, concepts: DataFrame) -> DataFrame:
    """``(row_id, side, concept_id)`` for ``(row_id, cause, effect)``: one row per side with a letter or digit.

    ``concept_id`` is '' where the span names no entry.  NULL spans give no
    row; repeated row ids are mapped each for itself.  Ties between entries go
    to the more frequent label words, then to the least id.
    """
    spark = rows.sparkSession
    scratch = Scratch(spark, "concepts")
    shared = spark.sparkContext.broadcast(_thesaurus(concepts))

    def spell(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield b.assign(words=[" ".join(tokens(s)) for s in b["span"]])

    def look_up(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        name = shared.value.name
        for b in batches:
            yield b.assign(concept_id=[name(w) for w in b["words"]])

    sides = rows.select("row_id", F.explode(F.array(*(F.struct(F.lit(s).alias("side"), F.col(s).alias("span")) for s in ("cause", "effect")))).alias("x")).select("row_id", "x.side", "x.span")
    sides = sides.where(F.col("span").rlike(r"[\p{L}\p{N}]"))
    counts = sides.groupBy("span").agg(F.count("*").alias("n"))
    spans = scratch.cut(counts.mapInPandas(spell, "span string, n long, words string"), "spans", n=F.coalesce(F.sum("n"), F.lit(0)))
    total = scratch.seen["n"]
    names = spread(spans.select("words").distinct()).mapInPandas(look_up, "words string, concept_id string")
    named = scratch.cut(spans.join(names, "words").select("span", "n", "concept_id"), "named")
    scratch.drop(spans)
    hot = F.broadcast(hot_keys(named, "n", total).select("span", "concept_id"))
    cold = named.where(F.col("n") < hot_threshold(total)).select("span", "concept_id")
    # rows of hot spans leave before the shuffle, so no task gets all rows of one span
    flagged = sides.join(hot.withColumnRenamed("concept_id", "_hot"), "span", "left")
    of_hot = flagged.where("_hot is not null").select("row_id", "side", F.col("_hot").alias("concept_id"))
    return of_hot.unionByName(flagged.where("_hot is null").join(cold, "span").select("row_id", "side", "concept_id"))


def _tables(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    return spark.read.parquet(f"{sf}/relations.parquet").select("row_id", "cause", "effect"), spark.read.parquet(f"{sf}/concepts.parquet").select("id", "leaf", "alt")


def p2_found(spark: SparkSession, sf: str) -> DataFrame:
    return map_spans(*_tables(spark, sf))


def p2_report(spark: SparkSession, sf: str) -> DataFrame:
    """How many spans name each entry, by side; the row with '' reports the misses."""
    return p2_found(spark, sf).groupBy("concept_id", "side").agg(F.count("*").alias("n_spans"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {"p2_found": p2_found, "p2_report": p2_report}
SQL: dict[str, str] = {}
