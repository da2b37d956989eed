"""Names for groups of spans: class-based TF-IDF keywords, the medoid, or both."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from claimloom.functions import text as T

RULES = ("medoid", "keywords", "both")


def group_key(groups: DataFrame) -> DataFrame:
    """Adds ``key``: the group's number, or for noise the span itself."""
    return groups.withColumn("key", F.when(F.col("group") == -1, F.concat(F.lit("s:"), F.coalesce("span", F.lit("")))).otherwise(F.concat(F.lit("g:"), F.col("group").cast("string"))))


def word_scores(groups: DataFrame) -> DataFrame:
    """``(key, word, n, score, first)``: frequency in the group times rarity among groups, all groups counted."""
    g = group_key(groups)
    w = g.select("key", "ord", F.posexplode(T.content_words(F.coalesce("span", F.lit("")))).alias("pos", "word"))
    tf = w.groupBy("key", "word").agg(F.count("*").alias("n"), F.min(F.struct("ord", "pos")).alias("first"))
    size = tf.groupBy("key").agg(F.sum("n").alias("n_words"))
    spread = tf.groupBy("word").agg(F.count("*").alias("n_groups_with"))
    total = g.agg(F.count_distinct("key").alias("n_groups"))
    j = tf.join(size, "key").join(spread, "word").join(F.broadcast(total), F.lit(True))
    return j.select("key", "word", "n", (F.col("n") / F.col("n_words") * F.log1p(F.col("n_groups") / F.col("n_groups_with"))).alias("score"), "first")


def keywords(groups: DataFrame, top: int = 5) -> DataFrame:
    """``(key, rank, word, score)``: the best words of each group; ties go to the word seen first."""
    best = Window.partitionBy("key").orderBy(F.desc(F.round("score", 12)), "first.ord", "first.pos")
    return word_scores(groups).withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= top).select("key", "rank", "word", F.round("score", 3).alias("score"))


def label_groups(groups: DataFrame, by: str = "both", top: int = 5) -> DataFrame:
    """``(key, central, size, name)`` of every group; a group of one is named by its span."""
    if by not in RULES:
        raise ValueError(f"unknown rule {by!r}; choose one of {RULES}")
    g = group_key(groups)
    first = g.groupBy("key").agg(F.count("*").alias("size"), F.min(F.struct("ord", "span", "central")).alias("m"))
    line = keywords(groups, top).groupBy("key").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", "word"))), lambda x: x["word"]), " ").alias("line"))
    central, line_c = F.coalesce("m.central", F.lit("")), F.coalesce("line", F.lit(""))
    name = {"medoid": central, "keywords": line_c, "both": F.concat(central, F.lit(" | "), line_c)}[by]
    return first.join(line, "key", "left").select("key", central.alias("central"), "size", F.when(F.col("size") == 1, F.coalesce("m.span", F.lit(""))).otherwise(name).alias("name"))
