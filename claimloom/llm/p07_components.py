"""Problem 7: pairwise matches consolidated into groups by hash-to-min.

A cluster is held as rows (v, u), "u is in the cluster of v", never as a
collected set, so a component of any size stays spread over the tasks.  In each
round v sends its cluster to the cluster's minimum and that minimum to all
members; rounds go on until the rows no longer change.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from claimloom.llm.hot import hot_keys, hot_threshold
from claimloom.scratch import Scratch


def _state() -> dict:
    """Order-free fingerprint of a set of rows, taken while they are written."""
    h = F.xxhash64("v", "u")
    return {"n": F.count("*"), "x": F.bit_xor(h), "s": F.sum(h.cast("decimal(38,0)"))}


def _round(scratch: Scratch, rows: DataFrame, total: int) -> tuple[DataFrame, DataFrame]:
    """(rows after a round, table of minima they are read with)."""
    least = scratch.cut(rows.groupBy("v").agg(F.min("u").alias("m"), F.count("*").alias("n")), "least", most=F.max("n"))
    if (scratch.seen["most"] or 0) < hot_threshold(total):
        both = rows.join(least.select("v", "m"), "v")
    else:
        # Rows of hot vertices meet their minimum by a broadcast of at most HOT_SHARE rows,
        # the others by an ordinary join on v.
        hot = F.broadcast(hot_keys(least, "n", total).select("v", "m"))
        cold = rows.join(hot.select("v"), "v", "left_anti").join(least.select("v", "m"), "v")
        both = rows.join(hot, "v").unionByName(cold)
    sent = both.select(F.explode(F.array(F.struct(F.col("m").alias("v"), F.col("u")), F.struct(F.col("u").alias("v"), F.col("m").alias("u")))).alias("e"))
    return sent.select("e.v", "e.u").distinct(), least


def hash_to_min(pairs: DataFrame, a: str = "a", b: str = "b", max_rounds: int = 60) -> DataFrame:
    """Group identifier of every vertex: ``(v, group_id)``, group_id the least linked vertex.

    Pairs with a NULL end are ignored; a self pair makes its vertex a group of
    its own; repeated and reversed pairs change nothing; other columns are
    dropped; no pairs give no rows.  Raises if ``max_rounds`` rounds (doubling
    distances, so far beyond any real diameter) don't suffice, rather than
    returning an unfinished grouping.
    """
    spark = pairs.sparkSession
    scratch = Scratch(spark, "hash-to-min")
    e = pairs.select(F.col(a).alias("v"), F.col(b).alias("u")).where("v is not null and u is not null").distinct()
    start = e.select(F.explode(F.array(F.struct("v", "u"), F.struct(F.col("u").alias("v"), F.col("v").alias("u")), F.struct("v", F.col("v").alias("u")), F.struct(F.col("u").alias("v"), "u"))).alias("e"))
    rows = scratch.cut(start.select("e.v", "e.u").distinct(), "c", **_state())
    state = scratch.seen
    for _ in range(max_rounds):
        after, least = _round(scratch, rows, state["n"])
        after = scratch.cut(after, "c", **_state())
        scratch.drop(rows, least)
        rows, done, state = after, scratch.seen == state, scratch.seen
        if done:
            return rows.groupBy("v").agg(F.min("u").alias("group_id"))
    raise RuntimeError(f"hash-to-min did not settle in {max_rounds} rounds")


def p7_found(spark: SparkSession, sf: str) -> DataFrame:
    pairs = spark.read.parquet(f"{sf}/span_pairs.parquet").select("span_a", "span_b")
    return hash_to_min(pairs, "span_a", "span_b").select(F.col("v").alias("span_id"), "group_id")


def p7_groups(spark: SparkSession, sf: str) -> DataFrame:
    """One row per group: its size, and the member linked by most pairs as its central span (ties to the least id)."""
    pairs = spark.read.parquet(f"{sf}/span_pairs.parquet").select("span_a", "span_b").where("span_a is not null and span_b is not null")
    ends = pairs.select(F.explode(F.array("span_a", "span_b")).alias("v")).groupBy("v").agg(F.count("*").alias("n"))
    of = hash_to_min(pairs, "span_a", "span_b").join(ends, "v")
    return of.groupBy("group_id").agg(F.count("*").alias("n_spans"), F.max(F.struct(F.col("n"), (-F.col("v")).alias("neg"))).alias("top")).select("group_id", "n_spans", (-F.col("top.neg")).alias("central_id"))


_COMPONENTS = """
WITH RECURSIVE e AS (
  SELECT span_a AS v, span_b AS u FROM span_pairs WHERE span_a IS NOT NULL AND span_b IS NOT NULL
  UNION SELECT span_b, span_a FROM span_pairs WHERE span_a IS NOT NULL AND span_b IS NOT NULL),
r AS (SELECT v, v AS u FROM e UNION SELECT r.v, e.u FROM r JOIN e ON r.u = e.v),
g AS (SELECT v AS span_id, min(u) AS group_id FROM r GROUP BY v)
"""

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {"p7_found": p7_found, "p7_groups": p7_groups}
SQL = {
    "p7_found": _COMPONENTS + "SELECT span_id, group_id FROM g",
    "p7_groups": _COMPONENTS
    + """, n AS (SELECT v, count(*) AS n FROM (
      SELECT span_a AS v FROM span_pairs WHERE span_a IS NOT NULL AND span_b IS NOT NULL
      UNION ALL SELECT span_b FROM span_pairs WHERE span_a IS NOT NULL AND span_b IS NOT NULL) GROUP BY v),
    k AS (SELECT g.group_id, g.span_id, count(*) OVER (PARTITION BY g.group_id) AS n_spans,
      row_number() OVER (PARTITION BY g.group_id ORDER BY n.n DESC, g.span_id) AS rk FROM g JOIN n ON n.v = g.span_id)
    SELECT group_id, n_spans, span_id AS central_id FROM k WHERE rk = 1""",
}
