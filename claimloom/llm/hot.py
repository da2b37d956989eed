"""Hot keys: those that hold so many rows that one task must not get all of them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: A key is hot when it holds at least 1/HOT_SHARE of all rows (and HOT_LEAST rows),
#: so there are never more than HOT_SHARE hot keys: the bound of what is broadcast.
HOT_SHARE = 400
HOT_LEAST = 2000
#: Rows of a group that one task sets against its partners in :func:`pairs_within`.
BLOCK = 500


def hot_threshold(total_rows: int) -> int:
    return max(HOT_LEAST, -(-total_rows // HOT_SHARE))


def salted(by: str, salts: int = 64):
    """A salt that depends on the row, not on the key."""
    return F.pmod(F.xxhash64(F.col(by), F.lit(7)), F.lit(salts))


def hot_keys(counts: DataFrame, n: str, total_rows: int) -> DataFrame:
    """Rows of a key -> count table that are hot; at most HOT_SHARE of them."""
    return counts.where(F.col(n) >= hot_threshold(total_rows))


def spread(df: DataFrame) -> DataFrame:
    """The rows dealt to all tasks: few bytes may be much work in Python, which adaptive coalescing can't know."""
    spark = df.sparkSession
    return df.repartition(max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions"))))


def pairs_within(rows: DataFrame, key: str, id: str) -> DataFrame:
    """``(id_a, id_b)``, id_a < id_b, of rows ``(key, id)`` with one key, where the pairs themselves are the result.

    A large group's left side is dealt to blocks, so that no task makes all pairs of it.
    """
    n = rows.groupBy(key).agg(F.count("*").alias("_n")).where("_n > 1")
    rows = rows.select(key, id).join(n, key).withColumn("_blocks", F.ceil(F.col("_n") / BLOCK).cast("int"))
    left = rows.select(key, F.col(id).alias("id_a"), F.pmod(F.xxhash64(id), "_blocks").cast("int").alias("_block"))
    right = rows.select(key, F.col(id).alias("id_b"), F.explode(F.sequence(F.lit(0), F.col("_blocks") - 1)).alias("_block"))
    return left.join(right, [key, "_block"]).where("id_a < id_b").select("id_a", "id_b")
