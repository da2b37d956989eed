"""Problem 8: texts packed into training sequences of one fixed capacity.

Lengths are tokens of a public tokenizer.  Only the histogram of lengths, which
has at most ``capacity`` entries whatever the corpus holds, is solved on the
driver: exact complements of one, two or three lengths are taken under
availability counts, the rest goes best-fit.  The plan, a list of patterns with
multiplicities, is then dealt to the items by their rank within their length.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark import SparkFiles
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from claimloom.scratch import Scratch

CAPACITY = 2048
#: The plan is made on the driver from at most `capacity` lengths, in time that grows with its square (2,048: under a second).
MOST_CAPACITY = 32_768
VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: Ranks are taken inside (chunk, length); a chunk holds about this many items.
CHUNK_ROWS = 20_000
#: the pre-tokenization pattern that belongs to the vocabulary (fixed value)
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

_encoders: dict = {}


def _encoder(vocabulary: str):
    """One encoder per worker process."""
    if vocabulary not in _encoders:
        import base64

        import tiktoken

        with open(vocabulary, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        _encoders[vocabulary] = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
    return _encoders[vocabulary]


def token_counts(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", vocabulary: str = VOCABULARY) -> DataFrame:
    """``(doc_id, n_tokens)``; NULL or empty texts have 0 tokens.  Whole texts are tokenized.

    ``vocabulary`` need exist on the driver only: it is sent to the executors.
    """
    docs.sparkSession.sparkContext.addFile(vocabulary)
    name = vocabulary.rstrip("/").rsplit("/", 1)[-1]

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encode = _encoder(SparkFiles.get(name)).encode_ordinary
        for b in batches:
            yield pd.DataFrame({"doc_id": b["doc_id"], "n_tokens": np.fromiter((len(encode(t)) if t else 0 for t in b["text"]), "int64", len(b))})

    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text")).mapInPandas(count, "doc_id long, n_tokens long")


def plan_patterns(histogram: dict[int, int], capacity: int) -> list[tuple[tuple[int, ...], int]]:
    """Patterns (lengths of one container, multiplicity) that use up a histogram of lengths <= capacity.

    Exact complements first, longest item first: an item leaves a gap, and the
    gap is looked up among the single, pair and triple sums that are still
    available.  A found combination is taken as often as the counts allow, so
    each step uses up a length and there are few steps.  What has no exact
    complement is placed best-fit, longest first.
    """
    have = {n: c for n, c in histogram.items() if c > 0}
    if any(not 0 < n <= capacity for n in have):
        raise ValueError("a length outside 1..capacity")
    out: list[tuple[tuple[int, ...], int]] = []
    if capacity in have:
        out.append(((capacity,), have.pop(capacity)))
    present = sorted(have)
    bits = sum(1 << n for n in present)

    def pair_bits() -> int:
        sums = 0
        for n in present:
            sums |= bits << n
        return sums & ((1 << (capacity + 1)) - 1)

    def usable(combo: tuple[int, ...]) -> int:
        return min(have.get(n, 0) // k for n, k in Counter(combo).items())

    pairs = pair_bits()
    leftover: dict[int, int] = {}
    while present:
        long = present[-1]
        gap = capacity - long
        found: tuple[int, ...] = ()
        if usable((long, gap)):
            found = (long, gap)
        if not found and pairs >> gap & 1:
            for a in reversed(present[: bisect_left(present, gap)]):
                if 2 * a < gap:
                    break
                if bits >> (gap - a) & 1 and usable((long, a, gap - a)):
                    found = (long, a, gap - a)
                    break
        if not found:
            for a in reversed(present[: bisect_left(present, gap)]):
                if 3 * a < gap:
                    break
                if not pairs >> (gap - a) & 1:
                    continue
                rest = gap - a
                for b in reversed(present[: bisect_left(present, min(rest, a + 1))]):
                    if 2 * b < rest:
                        break
                    if bits >> (rest - b) & 1 and usable((long, a, b, rest - b)):
                        found = (long, a, b, rest - b)
                        break
                if found:
                    break
        if found:
            times = usable(found)
            out.append((found, times))
            for n in found:
                have[n] -= times
        else:
            leftover[long] = have[long]
            have[long] = 0
        gone = [n for n in {*found, long} if not have.get(n, 0)]
        for n in gone:
            present.remove(n)
            bits &= ~(1 << n)
        if gone:
            pairs = pair_bits()
    # Best-fit over containers grouped by room: room -> {pattern: how many}.
    rooms: dict[int, Counter] = {}
    order: list[int] = []
    for n in sorted(leftover, reverse=True):
        left = leftover[n]
        while left:
            at = bisect_left(order, n)
            if at < len(order):
                room = order[at]
                pattern, count = rooms[room].popitem()
                take = min(left, count)
                if count > take:
                    rooms[room][pattern] = count - take
                if not rooms[room]:
                    del rooms[room], order[at]
            else:
                room, pattern, take = capacity, (), max(1, left // max(1, capacity // n))
            new = room - n
            if new not in rooms:
                rooms[new] = Counter()
                insort(order, new)
            rooms[new][(*pattern, n)] += take
            left -= take
    out += [(p, c) for room in order for p, c in sorted(rooms[room].items())]
    return out


def _slots(patterns: list[tuple[tuple[int, ...], int]]) -> pd.DataFrame:
    """For every slot of every pattern: which ranks of its length it takes and where they go."""
    rows, used, base = [], Counter(), 0
    for lengths, times in patterns:
        at = 0
        for n in lengths:
            rows.append((n, used[n], base, at))
            used[n] += times
            at += n
        base += times
    return pd.DataFrame(rows, columns=["n_tokens", "first", "base", "at"], dtype="int64").sort_values(["n_tokens", "first"], ignore_index=True)


def pack(lengths: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Containers for ``(doc_id, n_tokens)``: ``(container, at, doc_id, piece, first_token, n_tokens)``.

    A text longer than ``capacity`` is cut into full pieces and a rest; no other
    text is split.  Texts without tokens need no room and give no row; a NULL
    length counts as none.  Repeated ids are repeated items.  Every other text
    is placed exactly once.
    """
    if not 1 <= capacity <= MOST_CAPACITY:
        raise ValueError(f"capacity must be between 1 and {MOST_CAPACITY}")
    spark = lengths.sparkSession
    scratch = Scratch(spark, "packing")
    n, cap = F.col("n_tokens"), F.lit(capacity).cast("long")
    items = lengths.where("n_tokens > 0").select("doc_id", F.posexplode(F.transform(F.sequence(F.lit(0).cast("long"), F.floor((n - 1) / cap)), lambda k: F.least(cap, n - k * cap))).alias("piece", "n_tokens"))
    items = scratch.cut(items.withColumn("piece", F.col("piece").cast("long")), "items")
    sizes = items.groupBy("n_tokens").agg(F.count("*").alias("c")).collect()  # at most `capacity` rows
    total = sum(r["c"] for r in sizes)
    chunks = max(1, -(-total // CHUNK_ROWS))
    slots = _slots(plan_patterns({r["n_tokens"]: r["c"] for r in sizes}, capacity))
    chunked = items.withColumn("chunk", F.pmod(F.xxhash64("doc_id", "piece"), F.lit(chunks)))
    per = chunked.groupBy("n_tokens", "chunk").agg(F.count("*").alias("c"))
    before = per.select("n_tokens", "chunk", (F.sum("c").over(Window.partitionBy("n_tokens").orderBy("chunk")) - F.col("c")).alias("before"))
    ranked = chunked.withColumn("r", F.row_number().over(Window.partitionBy("n_tokens", "chunk").orderBy("doc_id", "piece")) - 1)
    ranked = ranked.join(before, ["n_tokens", "chunk"]).select("doc_id", "piece", "n_tokens", (F.col("r") + F.col("before")).alias("rank"))
    # Slots are ordered by (length, first rank), so one sorted key finds an item's slot.
    key = slots["n_tokens"].to_numpy() * np.int64(1 << 44) + slots["first"].to_numpy()
    shared = spark.sparkContext.broadcast((key, slots["first"].to_numpy(), slots["base"].to_numpy(), slots["at"].to_numpy()))

    def deal(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, first, base, at = shared.value
        for b in batches:
            length, rank = b["n_tokens"].to_numpy(), b["rank"].to_numpy()
            s = np.searchsorted(key, length * np.int64(1 << 44) + rank, side="right") - 1
            yield pd.DataFrame({"container": base[s] + rank - first[s], "at": at[s], "doc_id": b["doc_id"], "piece": b["piece"], "first_token": b["piece"].to_numpy() * capacity, "n_tokens": length})

    return ranked.mapInPandas(deal, "container long, at long, doc_id long, piece long, first_token long, n_tokens long")


def p8_pack(spark: SparkSession, sf: str) -> DataFrame:
    return pack(token_counts(spark.read.parquet(f"{sf}/documents.parquet")))


def p8_totals(spark: SparkSession, sf: str) -> DataFrame:
    """What the packing must keep, counted over all documents and containers: one row."""
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    lengths = Scratch(spark, "lengths").cut(token_counts(docs).where("n_tokens > 0"), "lengths")
    packed = Scratch(spark, "packed").cut(pack(lengths), "packed")
    of = packed.groupBy("doc_id").agg(F.sum("n_tokens").alias("held"), F.count("*").alias("pieces"))
    of = lengths.join(of, "doc_id", "full").agg(
        F.count("n_tokens").alias("n_texts"),
        F.count_if(F.col("n_tokens") == F.col("held")).alias("n_whole"),
        F.count_if((F.col("pieces") > 1) & (F.col("n_tokens") <= CAPACITY)).alias("n_split_short"),
    )
    full = packed.groupBy("container").agg(F.sum("n_tokens").alias("held"), F.max(F.col("at") + F.col("n_tokens")).alias("end"))
    full = full.agg(F.count_if((F.col("held") > CAPACITY) | (F.col("held") != F.col("end"))).alias("n_overfull_or_gaps"))
    return of.join(full, F.lit(True))


def p8_fill(spark: SparkSession, sf: str) -> DataFrame:
    """How full the containers are: their number by tokens held."""
    held = p8_pack(spark, sf).groupBy("container").agg(F.sum("n_tokens").alias("held"), F.count("*").alias("pieces"))
    return held.groupBy("held").agg(F.count("*").alias("containers"), F.sum("pieces").alias("pieces")).withColumn("capacity", F.lit(CAPACITY))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {"p8_pack": p8_pack, "p8_fill": p8_fill, "p8_totals": p8_totals}
# SQL has no tokenizer, but it knows how many texts there are, and that nothing may be lost, split or overfull.
SQL: dict[str, str] = {"p8_totals": "SELECT count(*) AS n_texts, count(*) AS n_whole, 0::BIGINT AS n_split_short, 0::BIGINT AS n_overfull_or_gaps FROM documents WHERE text <> ''"}
