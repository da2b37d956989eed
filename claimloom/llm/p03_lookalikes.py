"""Problem 3: visually identical text with different characters, brought to one form.

Compatibility normalization and deletion of ignorable characters come first;
what look-alike letters remain are read by a Viterbi search over each token's
lattice of readings, under character bigrams counted over the whole corpus.
ASCII text is its own canonical form and never leaves the JVM.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from claimloom.llm.hot import BLOCK
from claimloom.llm.lookalike import OTHERS, Lattice, fold
from claimloom.scratch import Scratch

_NOT_ASCII = r"[^\x00-\x7f]"


def bigrams(texts: DataFrame) -> DataFrame:
    """``(ab, n)``: counts of lower-case letter pairs within one script, over all texts.

    Pairs of ASCII letters and pairs of Greek, Cyrillic or Armenian letters are
    counted; each task adds up its own before anything is shuffled.
    """
    other = re.compile(f"[{OTHERS}]{{2,}}")

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        latin = np.zeros(128 * 128, "int64")
        rest: Counter = Counter()
        for b in batches:
            whole = "\n".join(b["text"])
            raw = np.frombuffer(whole.encode("utf-8"), "uint8")
            code = raw[:-1].astype("uint16")
            code <<= 7
            code += raw[1:]
            code[(raw[:-1] > 127) | (raw[1:] > 127)] = 0
            latin += np.bincount(code, minlength=128 * 128)[: 128 * 128]
            if not whole.isascii():
                for run in other.findall(fold(whole).lower()):
                    rest.update(map("".join, zip(run, run[1:], strict=False)))
        for k in np.flatnonzero(latin):
            a, c = chr(k >> 7).lower(), chr(k & 127).lower()
            if a.isalpha() and c.isalpha():
                rest[a + c] += int(latin[k])
        yield pd.DataFrame({"ab": list(rest), "n": list(rest.values())}, columns=["ab", "n"]).astype({"ab": "str", "n": "int64"})

    return texts.select("text").mapInPandas(count, "ab string, n long").groupBy("ab").agg(F.sum("n").alias("n"))


def canonical_texts(texts: DataFrame) -> DataFrame:
    """Adds ``clean`` to the non-ASCII rows of ``(tbl, id, text)``: the one form of all texts that look like ``text``.

    Case, wording, visible punctuation, the number of spaces and line breaks
    stay.  NULL texts are left out, empty ones are themselves.
    """
    spark = texts.sparkSession
    # at most a few thousand pairs: the square of the alphabets of four scripts
    model = Lattice({r["ab"]: r["n"] for r in bigrams(texts.where("text is not null")).collect()})
    shared = spark.sparkContext.broadcast(model)

    def clean(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        read = shared.value.canonical
        for b in batches:
            yield b.assign(clean=[read(t) for t in b["text"]])

    return texts.where(F.col("text").rlike(_NOT_ASCII)).select("tbl", "id", "text").mapInPandas(clean, "tbl string, id long, text string, clean string")


def canonical_keys(texts: DataFrame) -> DataFrame:
    """``(tbl, id, key, raw)``: digests of the canonical and of the written form of every text."""
    plain = texts.where(~F.col("text").rlike(_NOT_ASCII)).select("tbl", "id", F.md5("text").alias("key")).withColumn("raw", F.col("key"))
    other = canonical_texts(texts).select("tbl", "id", F.md5("clean").alias("key"), F.md5("text").alias("raw"))
    return plain.unionByName(other)


def mixed_rows(keys: DataFrame) -> DataFrame:
    """Rows of ``(tbl, id, key, raw)`` whose key has more than one written form.

    The keys are written once: texts are read and brought to their form one time, and digests are all that is shuffled.
    """
    scratch = Scratch(keys.sparkSession, "lookalikes")
    keys = scratch.cut(keys, "keys")
    mixed = keys.groupBy("tbl", "key").agg(F.min("raw").alias("least"), F.max("raw").alias("most")).where("least <> most").select("tbl", "key")
    rows = scratch.cut(keys.join(mixed, ["tbl", "key"], "left_semi"), "mixed")
    scratch.drop(keys)
    return rows


def lookalike_pairs(keys: DataFrame) -> DataFrame:
    """Pairs of rows of ``(tbl, id, key, raw)`` with one key but different written forms: ``(tbl, id_a, id_b)``.

    Written forms are paired first, rows after that, so copies of one string
    are never compared with each other and only true pairs are made.  The rows
    of a form with many copies are dealt to parts, each of which meets the
    other form's parts by itself.
    """
    rows = mixed_rows(keys)
    forms = rows.groupBy("tbl", "key", "raw").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("parts"))
    rows = rows.join(forms, ["tbl", "key", "raw"]).select("tbl", "key", "raw", "id", F.pmod(F.xxhash64("id"), "parts").cast("int").alias("part"))
    parts = forms.select("tbl", "key", "raw", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"))
    other = parts.select("tbl", "key", F.col("raw").alias("raw_b"), F.col("part").alias("part_b"))
    pairs = parts.join(other, ["tbl", "key"]).where("raw < raw_b")
    ends = pairs.join(rows.withColumnRenamed("id", "x"), ["tbl", "key", "raw", "part"]).join(rows.select("tbl", "key", F.col("raw").alias("raw_b"), F.col("part").alias("part_b"), F.col("id").alias("y")), ["tbl", "key", "raw_b", "part_b"])
    return ends.select("tbl", F.least("x", "y").alias("id_a"), F.greatest("x", "y").alias("id_b"))


def lookalike_classes(keys: DataFrame) -> DataFrame:
    """``(tbl, id, class_id, n_links)``: rows that look like rows of another written form, without all pairs.

    ``class_id`` is the least id that looks the same, ``n_links`` the number of rows of other forms.
    """
    rows = mixed_rows(keys)
    forms = rows.groupBy("tbl", "key", "raw").agg(F.count("*").alias("own"), F.min("id").alias("least"))
    whole = forms.groupBy("tbl", "key").agg(F.sum("own").alias("n"), F.min("least").alias("class_id"))
    of = forms.join(whole, ["tbl", "key"]).select("tbl", "key", "raw", "class_id", (F.col("n") - F.col("own")).alias("n_links"))
    return rows.join(of, ["tbl", "key", "raw"]).select("tbl", "id", "class_id", "n_links")


def _texts(spark: SparkSession, sf: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf}/documents.parquet").select(F.lit("documents").alias("tbl"), F.col("doc_id").alias("id"), "text")
    sents = spark.read.parquet(f"{sf}/sentences.parquet").select(F.lit("sentences").alias("tbl"), F.col("row_id").alias("id"), F.col("clean").alias("text"))
    return docs.unionByName(sents)


def p3_found(spark: SparkSession, sf: str) -> DataFrame:
    return lookalike_pairs(canonical_keys(_texts(spark, sf).where("text <> ''")))


def p3_classes(spark: SparkSession, sf: str) -> DataFrame:
    return lookalike_classes(canonical_keys(_texts(spark, sf).where("text <> ''")))


def p3_canonical(spark: SparkSession, sf: str) -> DataFrame:
    """The canonical text of every text that isn't ASCII already."""
    return canonical_texts(_texts(spark, sf)).select("tbl", "id", "clean")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {"p3_found": p3_found, "p3_classes": p3_classes, "p3_canonical": p3_canonical}
SQL: dict[str, str] = {}
