"""Problem 4: records that differ only in formatting, collapsed with the number of their copies.

Exact per-key counts (partial counts first) tell the hot canonical keys.  Their
rows go through a two-level, salted aggregation; all other rows through one
shuffle (besides that of the counts).  The representative is the least identifier.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from claimloom.llm.hot import hot_keys, salted
from claimloom.scratch import Scratch

FIELDS = ("cause", "effect", "doi")
_SEP = r"(?:\|\||\||;;|;|,|\t|\n)"


def canonical(c: Column) -> Column:
    """Letters and digits in their order, case ignored; NULL as ''."""
    return F.regexp_replace(F.lower(F.coalesce(c, F.lit(""))), r"[^\p{L}\p{N}]+", "")


def parse_payload(payload: Column) -> dict[str, Column]:
    """The named fields of a raw record: a JSON object, or ``name=value`` pairs in any order and with any separator.

    A value may itself hold separators: it ends only where a separator is
    followed by a known field name, or at the end.
    """
    js = F.from_json(payload, "cause string, effect string, doi string")
    names = "|".join(FIELDS)

    def plain(name: str) -> Column:
        got = F.regexp_extract(payload, rf"(?is)(?:^|{_SEP})\s*{name}\s*=(.*?)(?=\s*{_SEP}\s*(?:{names})\s*=|$)", 1)
        return F.when(F.ltrim(payload).startswith("{"), js[name]).otherwise(got)

    return {n: F.coalesce(plain(n), F.lit("")) for n in FIELDS}


def records(spark: SparkSession, sf: str) -> DataFrame:
    """``(tbl, id, key)`` of both tables; records in which a field has no letter or digit are left out."""
    rel = spark.read.parquet(f"{sf}/relations.parquet").select(F.lit("relations").alias("tbl"), F.col("row_id").alias("id"), *FIELDS)
    feed = spark.read.parquet(f"{sf}/relation_feed.parquet")
    got = parse_payload(F.col("payload"))
    feed = feed.select(F.lit("relation_feed").alias("tbl"), F.col("feed_id").alias("id"), *(got[n].alias(n) for n in FIELDS))
    rows = rel.unionByName(feed).select("tbl", "id", *(canonical(F.col(n)).alias(n) for n in FIELDS))
    return rows.where("cause <> '' and effect <> '' and doi <> ''").select("id", F.concat_ws("\u0001", "tbl", *FIELDS).alias("key"))


def _kept(rows: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(rows of hot keys, hot key -> least id and count, rows of the other keys)."""
    scratch = Scratch(rows.sparkSession, "copies")
    rows = scratch.cut(rows.select("id", "key"), "rows", n=F.count("*"))
    total = scratch.seen["n"]
    counts = rows.groupBy("key").agg(F.count("*").alias("n"))
    hot = scratch.cut(hot_keys(counts, "n", total).select("key"), "hot")
    of_hot = rows.join(F.broadcast(hot), "key", "left_semi")
    salt = of_hot.withColumn("salt", salted("id")).groupBy("key", "salt").agg(F.min("id").alias("keep_id"), F.count("*").alias("n"))
    kept = salt.groupBy("key").agg(F.min("keep_id").alias("keep_id"), F.sum("n").alias("n_copies"))
    return of_hot, kept, rows.join(F.broadcast(hot), "key", "left_anti")


def copies(rows: DataFrame) -> DataFrame:
    """``(key, keep_id, copy_id)`` for every row of ``(id, key)`` but the first of its key.

    NULL keys are left out; identifiers must be unique; an empty table gives no rows.
    """
    of_hot, kept, cold = _kept(rows.where("key is not null"))
    hot_rows = of_hot.join(F.broadcast(kept), "key").select("key", "keep_id", F.col("id").alias("copy_id"))
    cold_rows = cold.select("key", F.min("id").over(Window.partitionBy("key")).alias("keep_id"), F.col("id").alias("copy_id"))
    return hot_rows.unionByName(cold_rows).where("copy_id <> keep_id")


def collapsed(rows: DataFrame) -> DataFrame:
    """``(key, keep_id, n_copies)``: one row per key with the number of rows it stands for."""
    _, kept, cold = _kept(rows.where("key is not null"))
    return kept.select("key", "keep_id", "n_copies").unionByName(cold.groupBy("key").agg(F.min("id").alias("keep_id"), F.count("*").alias("n_copies")))


def _tbl() -> Column:
    return F.substring_index("key", "\u0001", 1).alias("tbl")


def p4_found(spark: SparkSession, sf: str) -> DataFrame:
    return copies(records(spark, sf)).select(_tbl(), "keep_id", "copy_id")


def p4_collapsed(spark: SparkSession, sf: str) -> DataFrame:
    return collapsed(records(spark, sf)).select(_tbl(), "keep_id", "n_copies")


def _sql_plain(name: str) -> str:
    return f"regexp_extract(payload, '(?is)(?:^|\\|\\||\\||;;|;|,|\\t|\\n)\\s*{name}\\s*=(.*)$', 1)"


def _sql_value(name: str) -> str:
    # no look-ahead here: cut the rest of the payload at the next known field
    return f"CASE WHEN ltrim(payload) LIKE '{{%' THEN json_extract_string(payload, '$.{name}') ELSE regexp_replace({_sql_plain(name)}, '(?is)\\s*(?:\\|\\||\\||;;|;|,|\\t|\\n)\\s*(?:cause|effect|doi)\\s*=.*$', '') END"


_RECORDS = f"""
WITH raw AS (
  SELECT 'relations' AS tbl, row_id AS id, cause, effect, doi FROM relations
  UNION ALL SELECT 'relation_feed', feed_id, {', '.join(_sql_value(n) for n in FIELDS)} FROM relation_feed),
c AS (SELECT tbl, id, {', '.join(f"regexp_replace(lower(coalesce({n}, '')), '[^\\p{{L}}\\p{{N}}]+', '', 'g') AS {n}" for n in FIELDS)} FROM raw),
k AS (SELECT tbl, id, min(id) OVER w AS keep_id, count(*) OVER w AS n FROM c
  WHERE cause <> '' AND effect <> '' AND doi <> '' WINDOW w AS (PARTITION BY tbl, cause, effect, doi))
"""

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {"p4_found": p4_found, "p4_collapsed": p4_collapsed}
SQL = {
    "p4_found": _RECORDS + "SELECT tbl, keep_id, id AS copy_id FROM k WHERE id <> keep_id",
    "p4_collapsed": _RECORDS + "SELECT tbl, keep_id, n AS n_copies FROM k WHERE id = keep_id",
}
