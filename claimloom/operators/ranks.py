"""Global ranks without a one-task window."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from claimloom.scratch import Scratch


def global_rank(df: DataFrame, by: str, name: str, first: int = 1) -> DataFrame:
    """Adds the rank of unique ``by``: ranges are ranked side by side, and the counts of the ranges before are added."""
    scratch = Scratch(df.sparkSession, "rank")
    df = scratch.cut(df, "rows")  # ranges are found by a sample, which would run the plan twice
    cut = scratch.cut(df.repartitionByRange(by).sortWithinPartitions(by).withColumn("_p", F.spark_partition_id()).withColumn("_i", F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))))
    before, rows = 0, []
    for r in cut.groupBy("_p").agg(F.count("*").alias("n")).orderBy("_p").collect():  # one row per partition
        rows.append((r["_p"], before))
        before += r["n"]
    offsets = df.sparkSession.createDataFrame(rows or [(0, 0)], "_p int, _before long")
    return cut.join(F.broadcast(offsets), "_p").withColumn(name, F.col("_i") + F.col("_before") + F.lit(first)).drop("_p", "_i", "_before")
