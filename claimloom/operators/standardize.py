"""Spans and groups of spans to the closest entries of a thesaurus, through an encoder that any callable can be."""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from claimloom.functions import text as T
from claimloom.operators.vectors import top_matches
from claimloom.scratch import Scratch, shared_dir

#: Texts to rows of numbers.
Encoder = Callable[[list[str]], np.ndarray]
NAME_RULES = ("mean_sim", "centroid", "medoid")
#: Entries are matched in blocks of so many; a block of 64 numbers an entry is 5 MB, of 768 numbers 60 MB.
ENTRY_BLOCK = 20_000


def hashed_ngrams(texts: list[str], size: int = 256) -> np.ndarray:
    """Stand-in for a trained encoder: counts of hashed letter trigrams, scaled to unit length."""
    out = np.zeros((len(texts), size), "float32")
    for k, t in enumerate(texts):
        t = f"  {t} "
        for i in range(len(t) - 2):
            out[k, zlib.crc32(t[i : i + 3].encode()) % size] += 1
    return out / np.maximum(1e-9, np.linalg.norm(out, axis=1, keepdims=True))


def embed(rows: DataFrame, text: str, encoder: Encoder = hashed_ngrams, batch_size: int = 256) -> DataFrame:
    """Adds ``embedding``, the unit vector of column ``text``; each distinct text is encoded once, a NULL as ''."""
    key = F.coalesce(F.col(text), F.lit(""))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for i in range(0, len(b), batch_size):
                part = b.iloc[i : i + batch_size]
                v = np.asarray(encoder(part["_text"].tolist()), "float64")
                v /= np.maximum(1e-12, np.linalg.norm(v, axis=1, keepdims=True))
                yield part.assign(embedding=list(v.astype("float32")))

    encoded = rows.select(key.alias("_text")).distinct().mapInPandas(run, "_text string, embedding array<float>")
    return rows.withColumn("_text", key).join(encoded, "_text").drop("_text")


def taxonomy_vectors(spark: SparkSession, entries: DataFrame, name: str, strategy: str = "enriched", encoder: Encoder = hashed_ngrams, encoder_name: str = "hashed", leaves_only: bool = True, cache: str | None = None) -> DataFrame:
    """``(ord, id, leaf, path, embedding)`` of a thesaurus's entries, kept as a table under its settings.

    A cached table with another number of entries is made anew; a folder that can't be written is no error,
    and then the vectors are only cut for this session.
    """
    source = entries.select("ord", "id", "leaf", "path", T.strategy_text(strategy).alias("_entry"))
    made = embed(source, "_entry", encoder).drop("_entry")
    folder = f"{cache or shared_dir(spark)}/{name}_{strategy}_{encoder_name}_{'leaves' if leaves_only else 'all'}"
    try:
        kept = spark.read.parquet(folder)
        if kept.count() == entries.count():
            return kept
    except Exception as e:  # no such table yet
        if "PATH_NOT_FOUND" not in str(e) and "UNABLE_TO_INFER_SCHEMA" not in str(e):
            raise
    try:
        made.write.mode("overwrite").parquet(folder)
        return spark.read.parquet(folder)
    except Exception as e:
        print(f"no cache in {folder}: {type(e).__name__}")
        return Scratch(spark, "taxonomy").cut(made, "vectors")


def match_vectors(queries: DataFrame, entries: DataFrame, top: int = 5, threshold: float | None = None) -> DataFrame:
    """``(query, rank, id, leaf, path, score)``: the ``top`` best concepts of each ``(query, embedding)``.

    ``entries`` are ``(ord, id, leaf, path, embedding)``; a concept with several entries counts with its best.
    Entries are sent to the queries block by block, so what is broadcast is bounded; each block leaves
    ``top`` concepts a query.  Ties go to the lower ``ord``; a NULL vector matches nothing.
    """
    spark = queries.sparkSession
    q = queries.select("query", "embedding").where("embedding is not null")
    entries = entries.where("embedding is not null")
    span = entries.agg(F.min("ord"), F.max("ord")).first()
    out = None
    for start in range(span[0] or 0, (span[1] if span[1] is not None else -1) + 1, ENTRY_BLOCK):
        block = entries.where(F.col("ord").between(start, start + ENTRY_BLOCK - 1)).orderBy("ord").toPandas()
        if block.empty:
            continue
        codes, ids = pd.factorize(block["id"])
        shared = spark.sparkContext.broadcast((np.stack(block["embedding"]).astype("float64"), block["ord"].to_numpy(), codes, len(ids)))

        def run(batches: Iterator[pd.DataFrame], shared=shared) -> Iterator[pd.DataFrame]:
            vectors, ords, codes, n = shared.value
            for b in batches:
                for i in range(0, len(b), 500):
                    part = b.iloc[i : i + 500]
                    s = np.round(np.stack(part["embedding"]).astype("float64") @ vectors.T, 12)
                    # best entry of each concept first, then the best concepts
                    order = np.lexsort((np.broadcast_to(ords, s.shape), -s), axis=1)
                    for row, best in enumerate(order):
                        first = best[np.sort(np.unique(codes[best], return_index=True)[1])[:top]]
                        yield pd.DataFrame({"query": part["query"].iloc[row], "ord": ords[first], "score": s[row, first]})

        kind = dict(queries.dtypes)["query"]
        got = q.mapInPandas(run, f"query {kind}, ord long, score double")
        out = got if out is None else out.unionByName(got)
    if out is None:
        out = spark.createDataFrame([], f"query {dict(queries.dtypes)['query']}, ord long, score double")
    scores = out.join(entries.select("ord", "id", "leaf", "path"), "ord")
    ranked = top_matches(scores, top, -2.0 if threshold is None else threshold)
    return ranked.join(entries.select("ord", "leaf", "path"), "ord").select("query", "rank", "id", "leaf", "path", "score")


def standardize_spans(spans: DataFrame, entries: DataFrame, encoder: Encoder = hashed_ngrams, top: int = 5, threshold: float | None = None) -> DataFrame:
    """Matches of each ``span``, compared tidied and in lower case; a span without a match gives no row."""
    q = spans.select(F.col("span").alias("query")).distinct().withColumn("_q", F.lower(T.tidy_span(F.col("query"))))
    return match_vectors(embed(q, "_q", encoder), entries, top, threshold)


def group_vectors(vectors: DataFrame, name_by: str = "mean_sim") -> DataFrame:
    """``(query, embedding)``: one vector for each group of ``(key, ord, embedding, is_central)``.

    The mean similarity to an entry is the similarity of the members' mean; a centroid is that mean at unit
    length; a medoid group speaks through its central member alone (of several, the first).
    Sums are kept by place, so a group of any size is added up by partial sums.
    """
    if name_by not in NAME_RULES:
        raise ValueError(f"{name_by!r} is no rule for naming groups; there are {NAME_RULES}")
    v = vectors.where("embedding is not null")
    if name_by == "medoid":
        return v.where("is_central").groupBy(F.col("key").alias("query")).agg(F.min_by("embedding", "ord").alias("embedding"))
    mean = v.select("key", F.posexplode("embedding").alias("pos", "x")).groupBy("key", "pos").agg(F.avg(F.col("x").cast("double")).alias("x"))
    whole = mean.groupBy(F.col("key").alias("query")).agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "x"))), lambda p: p["x"]).alias("embedding"))
    if name_by == "mean_sim":
        return whole
    norm = F.sqrt(F.aggregate("embedding", F.lit(0.0), lambda s, x: s + x * x))
    return whole.withColumn("embedding", F.transform("embedding", lambda x: x / norm))


def standardize_groups(groups: DataFrame, entries: DataFrame, encoder: Encoder = hashed_ngrams, name_by: str = "mean_sim", top: int = 5, threshold: float | None = None) -> DataFrame:
    """Matches of each group of ``(key, ord, span, central)``; ``key`` as given by :func:`claimloom.operators.labels.group_key`."""
    q = groups.withColumn("_q", F.lower(T.tidy_span(F.coalesce("span", F.lit("")))))
    v = embed(q, "_q", encoder).select("key", "ord", "embedding", (F.col("span") == F.col("central")).alias("is_central"))
    return match_vectors(group_vectors(v, name_by), entries, top, threshold)


def match_summary(matches: DataFrame, queries: DataFrame) -> DataFrame:
    """One row: how many queries there are and lack a match, and the middle, least and largest best score."""
    best = queries.select("query").distinct().join(matches.where("rank = 1").select("query", "score"), "query", "left")
    return best.agg(F.count("*").alias("n_queries"), F.count_if(F.col("score").isNull()).alias("n_unmatched"), F.round(F.median("score"), 4).alias("median"), F.min("score").alias("least"), F.max("score").alias("most"))
