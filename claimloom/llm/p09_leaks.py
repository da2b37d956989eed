"""Problem 9: evaluation passages that stand, wholly or partly, in corpus documents.

Items are partitioned by size.  In a partition every run that matters has at
least w consecutive shingles, so the MinHash of each window of w shingles is
the same in the item and in any document that holds such a run: windows are
compared by MinHash, and candidates are verified by exact containment of
consecutive shingles.  No document that qualifies can be missed.

Items of up to MOST_WORDS words are one broadcast index, searched in one pass.
More items stay a table: their minima set the bits of a filter of fixed size,
each document sends the minima that pass it, and a join finds the candidates;
that is one pass over the corpus, too, however many items there are.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from claimloom.llm.lookalike import SPACES, TO_LATIN, skeleton
from claimloom.scratch import Scratch

SHINGLE = 5
#: Items of more words than this together (an index of some 300 MB) aren't broadcast but joined.
MOST_WORDS = 1_000_000
#: Bits of the filter of item minima: 16 MB, whatever the items.
FILTER_BITS = 1 << 27
_WORD = re.compile(r"[^\W_]+")
_CUT = re.compile(r"(?<=[^\W\d_])[-¬]\s*\n\s*(?=[^\W\d_])")
_GROUPED = re.compile(r"(?<=\d)[,.'](?=\d)|(?<=\d) (?=\d{3}(?!\d))")
_NONE = np.uint64(0xFFFFFFFFFFFFFFFF)


def words(text: str) -> list[str]:
    """Words without regard to case, punctuation, white space, look-alike characters, cuts at line ends and marks between digit groups."""
    t = skeleton(text)
    if "-\n" in t or "¬" in t:
        t = _CUT.sub("", t)
    return _WORD.findall(_GROUPED.sub("", t).casefold())


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingle_hashes(ids: np.ndarray, k: int) -> np.ndarray:
    """Hash of each run of k word ids; runs with an unknown word (0) get the largest value."""
    if len(ids) < k:
        return np.empty(0, "uint64")
    n = len(ids) - k + 1
    h, bad = np.zeros(n, "uint64"), np.zeros(n, bool)
    for j in range(k):
        part = ids[j : j + n]
        h = _mix(h + part * np.uint64(0x9E3779B97F4A7C15) + np.uint64(j + 1))
        bad |= part == 0
    h[bad] = _NONE
    return h


def window_minima(h: np.ndarray, w: int) -> np.ndarray:
    """Least value in each window of w, by doubling."""
    if len(h) < w:
        return np.empty(0, "uint64")
    m, size = h, 1
    while size * 2 <= w:
        m = np.minimum(m[:-size], m[size:])
        size *= 2
    return np.minimum(m[: len(h) - w + 1], m[w - size : w - size + len(h) - w + 1])


def size_class(n: int) -> tuple[int, int, int]:
    """(partition, words in a shingle, shingles in a window) of an item of n words.

    Sizes of a partition differ by less than half; its windows are those of its shortest item.
    """
    need = -(-n // 2)
    half = need.bit_length()
    upper = int(half > 1 and need >> (half - 2) & 1)
    least = (1 << (half - 1)) + (upper << (half - 2) if half > 1 else 0)
    k = min(SHINGLE, least)
    return 2 * half + upper, k, least - k + 1


def longest_run(a: list, b: list) -> int:
    """Words of the longest unbroken run that two word lists share, from positions with an equal word."""
    at: dict = defaultdict(list)
    for j, w in enumerate(a):
        at[w].append(j)
    best, before = 0, {}
    for w in b:
        here = {}
        for j in at.get(w, ()):
            here[j] = before.get(j - 1, 0) + 1
            if here[j] > best:
                best = here[j]
        before = here
    return best


class ItemIndex:
    """MinHash index of evaluation items, partitioned by size."""

    def __init__(self, items: list[tuple[int, str]]):
        self.vocabulary: dict[str, int] = {}
        self.words: list[list[int]] = []
        self.ids = []
        for item_id, passage in items:
            w = words(passage or "")
            if w:
                self.ids.append(item_id)
                self.words.append([self.vocabulary.setdefault(x, len(self.vocabulary) + 1) for x in w])
        sizes = defaultdict(list)
        for i, w in enumerate(self.words):
            sizes[size_class(len(w))].append(i)
        self.partitions = []
        for (_, k, w), members in sizes.items():
            index: dict[int, set[int]] = defaultdict(set)
            for i in members:
                for m in np.unique(window_minima(shingle_hashes(np.array(self.words[i], "uint64"), k), w)).tolist():
                    index[m].add(i)
            self.partitions.append((k, w, np.array(sorted(index), "uint64"), dict(index)))

    def search(self, docs: list[str]) -> list[tuple[int, int]]:
        """(position of the document, item id) for each document that holds at least half of an item."""
        get = self.vocabulary.get
        ids = [np.array([get(w, 0) for w in words(t)] + [0] * SHINGLE, "uint64") for t in docs]
        start = np.cumsum([0] + [len(x) for x in ids])
        flat = np.concatenate(ids) if ids else np.empty(0, "uint64")
        candidates: set[tuple[int, int]] = set()
        for k, w, keys, index in self.partitions:
            if not len(keys):
                continue
            minima = window_minima(shingle_hashes(flat, k), w)
            slot = np.minimum(np.searchsorted(keys, minima), len(keys) - 1)
            for p in np.flatnonzero((keys[slot] == minima) & (minima != _NONE)).tolist():
                # a window lies in one document, or in a run of short ones; its least shingle does too
                for d in range(int(np.searchsorted(start, p, side="right")) - 1, int(np.searchsorted(start, p + w - 1, side="right"))):
                    candidates |= {(d, i) for i in index[int(minima[p])] if d < len(ids)}
        return [(d, self.ids[i]) for d, i in sorted(candidates) if 2 * longest_run(self.words[i], ids[d].tolist()) >= len(self.words[i])]


def _word_ids(text: str) -> np.ndarray:
    """64-bit hashes of a text's words, none of them 0."""
    return np.fromiter((xxhash.xxh64_intdigest(w) or 1 for w in words(text)), "uint64")


def _minima(text: str, classes: list[tuple[int, int, int]]) -> set[tuple[int, int]]:
    """(partition, window minimum) of a text for each partition that holds items."""
    ids = _word_ids(text)
    return {(c, m) for c, k, w in classes for m in np.unique(window_minima(shingle_hashes(ids, k), w)).astype("int64").tolist()}


def _bit(part: str, key: str):
    return F.pmod(F.xxhash64(part, key), F.lit(FILTER_BITS))


def joined_leaks(docs: DataFrame, items: DataFrame) -> DataFrame:
    """:func:`leaks` with the items as a table, for more of them than a broadcast may hold."""
    scratch = Scratch(docs.sparkSession, "leaks")

    def item_minima(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            got = [(i, *x, *size_class(len(words(t)))) for i, t in zip(b["item_id"], b["passage"], strict=True) if words(t) for x in _minima(t, [size_class(len(words(t)))])]
            yield pd.DataFrame(got, columns=["item_id", "part", "key", "c", "k", "w"]).astype("int64")

    of_items = scratch.cut(items.mapInPandas(item_minima, "item_id long, part long, key long, c long, k long, w long").distinct(), "items")
    # sizes double from one pair of partitions to the next, so there are some dozens at most
    classes = [(r["c"], r["k"], r["w"]) for r in of_items.select("c", "k", "w").distinct().collect()]
    bits = of_items.select(_bit("part", "key").alias("bit")).distinct()
    words_of_bits = bits.groupBy(F.floor(F.col("bit") / 64).alias("at")).agg(F.expr("bit_or(shiftleft(1L, cast(pmod(bit, 64) as int)))").alias("word"))
    passes = np.zeros(FILTER_BITS // 64, "int64")
    for r in words_of_bits.toLocalIterator():  # FILTER_BITS / 64 rows at most
        passes[r["at"]] = r["word"]
    shared = docs.sparkSession.sparkContext.broadcast(passes)

    def doc_minima(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for at in range(0, len(b), 50):
                rows = b.iloc[at : at + 50]
                got = [(d, *x) for d, t in zip(rows["doc_id"], rows["text"], strict=True) for x in _minima(t, classes)]
                yield pd.DataFrame(got, columns=["doc_id", "part", "key"]).astype("int64")

    @F.pandas_udf("boolean")
    def may_pass(bit: pd.Series) -> pd.Series:
        b = bit.to_numpy()
        return pd.Series((shared.value[b >> 6] >> (b & 63)) & 1 == 1)

    texts = docs.select("doc_id", "text").where("text <> ''")
    sent = texts.mapInPandas(doc_minima, "doc_id long, part long, key long").where(may_pass(_bit("part", "key")))
    pairs = scratch.cut(sent.join(of_items.select("part", "key", "item_id"), ["part", "key"]).select("doc_id", "item_id").distinct(), "pairs")
    # only texts with a candidate travel; verification is exact
    both = texts.join(pairs, "doc_id").join(items, "item_id")

    def verify(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            keep = []
            for t, p in zip(b["text"], b["passage"], strict=True):
                w = words(p)
                keep.append(2 * longest_run(w, words(t)) >= len(w))
            yield b[keep][["doc_id", "item_id"]]

    return both.mapInPandas(verify, "doc_id long, item_id long").distinct()


def leaks(docs: DataFrame, items: DataFrame, most_words: int = MOST_WORDS) -> DataFrame:
    """``(doc_id, item_id)``: at least half of the item's words stand in the document as one unbroken run.

    ``docs`` is (doc_id, text), ``items`` (item_id, passage); other columns are
    ignored, NULL and empty texts and passages match nothing, repeated ids give
    one row.  Whole texts are searched.
    """
    items = items.select("item_id", "passage").where("passage <> ''")
    # a word has at least one letter and, but for the last, a space: so this counts no word too few
    size = items.agg(F.coalesce(F.sum(F.size(F.split("passage", r"[^\p{L}\p{N}]+"))), F.lit(0))).first()[0]
    if size > most_words:
        return joined_leaks(docs, items)
    shared = docs.sparkSession.sparkContext.broadcast(ItemIndex([tuple(r) for r in items.collect()]))

    def find(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            ids = rows["doc_id"].to_numpy()
            got = shared.value.search(rows["text"].tolist())
            yield pd.DataFrame({"doc_id": [ids[d] for d, _ in got], "item_id": [i for _, i in got]}, dtype="int64")

    return docs.select("doc_id", "text").where("text <> ''").mapInPandas(find, "doc_id long, item_id long").distinct()


def p9_found(spark: SparkSession, sf: str) -> DataFrame:
    return leaks(spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/eval_items.parquet"))


def p9_by_item(spark: SparkSession, sf: str) -> DataFrame:
    """How often each leaked item leaked."""
    return p9_found(spark, sf).groupBy("item_id").agg(F.count("*").alias("n_docs"), F.min("doc_id").alias("first_doc"))


def _sql_words(text: str) -> str:
    """Words of a text in SQL: look-alike letters in Latin, words cut at line ends joined, digit groups joined."""
    wide, narrow = "".join(map(chr, range(0xFF10, 0xFF5B))), "".join(map(chr, range(0x30, 0x7B)))
    t = f"translate(translate({text}, '{SPACES}', '{' ' * len(SPACES)}'), '{''.join(TO_LATIN)}{wide}', '{''.join(TO_LATIN.values())}{narrow}')"
    for ligature, letters in (("ﬃ", "ffi"), ("ﬄ", "ffl"), ("ﬀ", "ff"), ("ﬁ", "fi"), ("ﬂ", "fl")):
        t = f"replace({t}, '{ligature}', '{letters}')"
    t = f"regexp_replace({t}, '[\\x{{00ad}}\\x{{200b}}-\\x{{200f}}\\x{{2060}}\\x{{feff}}]', '', 'g')"
    t = f"regexp_replace({t}, '(\\p{{L}})[-¬]\\s*\\n\\s*(\\p{{L}})', '\\1\\2', 'g')"
    t = f"regexp_replace({t}, '(\\d)[,.'' ](\\d\\d\\d)\\b', '\\1\\2', 'g')"
    return f"list_filter(regexp_split_to_array(lower(strip_accents({t})), '[^a-z0-9\\p{{L}}\\p{{N}}]+'), lambda w: w <> '')"


_FOUND = f"""
WITH i AS (SELECT item_id, {_sql_words('passage')} AS ws FROM eval_items WHERE passage <> ''),
d AS (SELECT doc_id, {_sql_words('text')} AS ws FROM documents WHERE text <> ''),
iw AS (SELECT item_id, len(ws) AS n, unnest(ws) AS w, generate_subscripts(ws, 1) AS p FROM i),
dw AS (SELECT doc_id, unnest(ws) AS w, generate_subscripts(ws, 1) AS p FROM d),
-- equal words on one diagonal, one after another, are a run
hit AS (SELECT doc_id, item_id, n, dw.p - iw.p AS diagonal, dw.p - row_number() OVER (PARTITION BY doc_id, item_id, dw.p - iw.p ORDER BY dw.p) AS run FROM dw JOIN iw USING (w)),
f AS (SELECT DISTINCT doc_id, item_id FROM (SELECT doc_id, item_id, any_value(n) AS n, count(*) AS held FROM hit GROUP BY doc_id, item_id, diagonal, run) WHERE 2 * held >= n)
"""

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {"p9_found": p9_found, "p9_by_item": p9_by_item}
SQL: dict[str, str] = {
    "p9_found": _FOUND + "SELECT doc_id, item_id FROM f",
    "p9_by_item": _FOUND + "SELECT item_id, count(*) AS n_docs, min(doc_id) AS first_doc FROM f GROUP BY item_id",
}
