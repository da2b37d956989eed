"""Problem 10: per-document text statistics, and the documents they show to be no natural prose.

Each statistic gets a mergeable quantile sketch per language.  Values are turned
into robust z-scores, and documents in the far tails are flagged and named by the
tails they lie in.  Middle and scale are read off the side of a statistic on which
no lists, tables or junk lie, so that many of them don't hide one another.
"""

from __future__ import annotations

import functools
import operator
import string
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from claimloom.llm.lookalike import IGNORABLE, TO_LATIN
from claimloom.scratch import Scratch

#: Languages with fewer documents than this share are measured against all documents, so there are at most 1/share + 1 sketches.
LANGUAGE_SHARE = 0.002
#: Common words learned of a language that has no list.
LEARNED = 60
#: 1/error of the quantile sketches.
ACCURACY = 2000

# Words that are common in prose of each language.
COMMON = {
    "en": "the of and to in a is that for with on as was by were are from at not we our this it than more had how which be an but or their has have when been who what so both its these those such no into there they may yet",
    "de": "der die das und in den von zu mit war für bei im als über nach auf ist eine ein einer dem des nicht auch sich wurde sind aus an",
    "fr": "le la les de des du et à dans pour une un est sur a été pas que qui en par après avec près n l d au aux ce cette",
    "es": "el la los las de en y que con del una un por se su según más para al después durante también lo no es fue",
}
# The controls of a web page.
CONTROLS = "log in|log out|sign in|sign up|register|home|menu|search|share|cite|next page|previous page|back to top|accept all|reject all|download pdf|download|print|contact|about|about us|help|settings|cookies|cookie settings|privacy policy|terms of use|subscribe|follow us|read more|skip to content|view more|load more|close|next|previous"

#: Least scale of each statistic, so that a corpus of much the same texts doesn't make every other text extreme.
LEAST_SCALE = {"mean_word": 0.2, "symbol_ratio": 0.005, "line_end_share": 0.02, "common_share": 0.01, "digit_ratio": 0.005, "vowel_ratio": 0.01, "variety": 0.3, "entry_share": 0.02, "column_share": 0.02}
#: The side of each statistic that is prose: above its middle, below it, or whichever is narrower (non-prose lies on both sides).
PROSE_SIDE = {"mean_word": "narrow", "symbol_ratio": "below", "line_end_share": "above", "common_share": "above", "digit_ratio": "below", "vowel_ratio": "above", "variety": "narrow", "entry_share": "below", "column_share": "below"}
STATS = ("mean_word", "symbol_ratio", "line_end_share", "common_share", "digit_ratio", "vowel_ratio", "variety", "entry_share", "column_share")


#: How list entries begin (or a line of contents or of a bibliography reads), and what parts the cells of a row.
ENTRY = r"^(?:[-–•·◦→*▪]|\(?(?:\d{1,3}|[a-z]|[ivx]{1,4})[.)])\s"
CONTENTS = r"\.{4,}\s*\d"
BOOK = r"^\D{2,60}\((?:1[89]|20)\d\d[a-z]?\)\. .*\d\.?$"
CELLS = r"[\t|]|[;,] | {3,}"
#: How a line ends that ends a sentence, and what may follow.
ENDS, CLOSING = ".!?…:", "\"'”’»)] "
BLANKS = " \n\t\f\r\u00a0"
#: Look-alikes that are no further apart are searched as one range; from 27 on, these would hold quotation marks and dashes, which most texts have.
GAP = 16
VOWELS = "aeiouyáéíóúàèìòùâêîôûäëïöüœæ"


def _plain(text: Column) -> Column:
    """Letters of one script, full-width forms narrowed, nothing invisible: all by one character table."""
    wide = "".join(map(chr, range(0xFF01, 0xFF5F)))
    narrow = "".join(map(chr, range(0x21, 0x7F)))
    a = "".join(TO_LATIN) + wide + IGNORABLE
    b = "".join(TO_LATIN.values()) + narrow
    # a search for any of these characters is far quicker than the translation, which most texts don't need; plain characters are passed by a single comparison
    lowest = min(map(ord, a))
    wanted = (F.octet_length(text) > F.length(text)) & text.rlike(f"(?=[^\\x00-\\x{{{lowest - 1:x}}}])" + _spans(a))
    return F.when(wanted, F.translate(text, a, b)).otherwise(text)


def _spans(characters: str) -> str:
    """A class of a few ranges that hold these characters, and others between them."""
    spans: list[list[int]] = []
    for c in sorted(map(ord, characters)):
        if spans and c - spans[-1][1] <= GAP:
            spans[-1][1] = c
        else:
            spans.append([c, c])
    return "[" + "".join(f"\\x{{{x:x}}}-\\x{{{y:x}}}" for x, y in spans) + "]"


def _without(text: Column, characters: str) -> Column:
    """The text without runs of characters of a class; runs are cut out more quickly than characters are translated."""
    return F.regexp_replace(text, f"[{characters}]+", "")


def _count(text: Column, c: str) -> Column:
    """How often a text has a character; found by its bytes, with no pattern."""
    return F.when(F.contains(text, F.lit(c)), F.length(text) - F.length(F.replace(text, F.lit(c), F.lit("")))).otherwise(0)


def _any(tests: list[Column]) -> Column:
    return functools.reduce(operator.or_, tests)


def _share(part: Column, whole: Column) -> Column:
    # nullif would have the whole computed in a projection of its own, and the arrays copied for it
    return F.when(whole != 0, part / whole).otherwise(0.0).cast("double")


def _language(lang: str = "lang") -> Column:
    return F.lower(F.trim(F.coalesce(lang, F.lit(""))))


def learned_common(docs: DataFrame) -> dict[str, str]:
    """Common words of the languages that COMMON doesn't know: those that most of a language's documents hold, LEARNED of them.

    Counted over all documents of such languages; only frequent languages are learned, so there are few.
    """
    other = docs.where((_language() != "") & ~_language().isin(*COMMON)).select(_language().alias("lang"), "text")
    total, counts = docs.count(), other.groupBy("lang").agg(F.count("*").alias("n"))
    frequent = [r["lang"] for r in counts.where(F.col("n") >= max(30, LANGUAGE_SHARE * total)).collect()]  # at most 1/LANGUAGE_SHARE
    if not frequent:
        return {}
    words = F.array_distinct(F.filter(F.split(F.lower(_plain(F.coalesce("text", F.lit("")))), r"[^\p{L}]+"), lambda w: w != ""))
    held = other.where(F.col("lang").isin(*frequent)).select("lang", F.explode(words).alias("w")).groupBy("lang", "w").agg(F.count("*").alias("n"))
    best = held.withColumn("k", F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "w"))).where(F.col("k") <= LEARNED)
    return {r["lang"]: r["words"] for r in best.groupBy("lang").agg(F.array_join(F.array_sort(F.collect_list("w")), " ").alias("words")).collect()}


def text_statistics(docs: DataFrame, learned: dict[str, str] | None = None) -> DataFrame:
    """Statistics of ``(doc_id, text, lang)``: one row per row, computed in the JVM over the whole text.

    ``learned`` are common words of further languages, of which a document counts those of its own.

    NULL texts count as empty; an empty text has 0 words and zeros everywhere.
    Language codes are compared without case; a missing one becomes that of COMMON
    whose words the text has most of, or '' if it has none.
    """
    common = sorted({w for words in COMMON.values() for w in words.split()})
    controls = CONTROLS.split("|")
    longest = max(map(len, controls))  # lower case is never shorter
    t = docs.select("doc_id", _language().alias("lang"), _plain(F.coalesce("text", F.lit(""))).alias("t"))
    # a split at one character needs no pattern; empty lines are left out either way
    broken = F.when(F.contains("t", F.lit("\f")) | F.contains("t", F.lit("\r")), F.split("t", r"[\n\f\r]+")).otherwise(F.split("t", "\n"))
    t = t.select("doc_id", "lang", "t", F.filter(F.split(F.lower("t"), r"[^\p{L}\p{N}]+"), lambda w: w != "").alias("w"), F.filter(F.transform(broken, lambda x: F.trim(x)), lambda x: x != "").alias("lines"))
    solid = functools.reduce(operator.sub, (_count(F.col("t"), c) for c in BLANKS), F.length("t"))
    t = t.select("doc_id", "lang", "w", "lines", F.array_join("w", "").alias("joined"), solid.alias("solid"))
    w, lines, solid = F.col("w"), F.col("lines"), F.col("solid")
    n_words, n_lines, alnum = F.size(w), F.size(lines), F.length("joined")

    def ends(x: Column) -> Column:
        # nearly all lines are told by their last character
        return _any([x.endswith(c) for c in ENDS]) | (_any([x.endswith(c) for c in CLOSING]) & F.right(F.rtrim(x, F.lit(CLOSING)), F.lit(1)).isin(*ENDS))

    def entry(x: Column) -> Column:
        return x.rlike(ENTRY) | (F.contains(x, F.lit("....")) & x.rlike(CONTENTS)) | (F.contains(x, F.lit("(")) & x.rlike(BOOK)) | (~ends(x) & (F.length(x) - F.length(F.replace(x, F.lit(" "), F.lit(""))) <= 5))

    def columns(x: Column) -> Column:
        # counted, for a split compiles its pattern anew for every line; last, for prose has commas, but few such characters
        return (F.length(_without(x, string.ascii_letters + " ")) >= 0.4 * F.length(F.replace(x, F.lit(" "), F.lit("")))) & (F.regexp_count(x, F.lit(CELLS)) >= 2)

    def among(words: list[str]) -> Column:
        return F.size(F.filter(w, lambda x: x.isin(*words)))

    n_common = among(common)
    for lang, held in (learned or {}).items():
        n_common = F.when(F.col("lang") == lang, among(held.split())).otherwise(n_common)
    most = F.array_max(F.array(*(F.struct(among(words.split()).alias("n"), F.lit(lang).alias("lang")) for lang, words in COMMON.items())))
    return t.select(
        "doc_id",
        F.when(F.col("lang") != "", F.col("lang")).otherwise(F.when(most["n"] > 0, most["lang"]).otherwise("")).alias("lang"),
        n_words.alias("n_words"),
        n_lines.alias("n_lines"),
        _share(alnum, n_words).alias("mean_word"),
        _share(solid - alnum, solid).alias("symbol_ratio"),
        _share(F.size(F.filter(lines, ends)), n_lines).alias("line_end_share"),
        _share(n_common, n_words).alias("common_share"),
        _share(F.length(_without(F.col("joined"), "^0-9")), alnum).alias("digit_ratio"),
        _share(alnum - F.length(_without(F.col("joined"), VOWELS)), alnum).alias("vowel_ratio"),
        _share(F.size(F.array_distinct(w)).cast("double"), F.sqrt(n_words)).alias("variety"),
        _share(F.size(F.filter(lines, entry)), n_lines).alias("entry_share"),
        _share(F.size(F.filter(lines, columns)), n_lines).alias("column_share"),
        _share(F.size(F.array_distinct(lines)), n_lines).alias("line_variety"),
        _share(F.size(F.filter(lines, lambda x: (F.length(x) >= 30) & ~x.contains(" "))), n_lines).alias("unbroken_share"),
        _share(F.size(F.filter(lines, lambda x: (F.length(x) <= longest) & F.lower(x).isin(*controls))), n_lines).alias("control_share"),
    )


def _fit(q: Column, side: str, least: float) -> Column:
    """Middle and scale of a normal distribution through two quantiles of one side.

    ``q`` holds the quantiles 0.1, 0.25, 0.75 and 0.9.  With the two on the prose
    side, up to about two thirds of the documents may lie in the other tail.
    """
    if side == "narrow":
        above, below = _fit(q, "above", least), _fit(q, "below", least)
        return F.when(above["scale"] <= below["scale"], above).otherwise(below)
    near, far, sign = (q[2], q[3], -1) if side == "above" else (q[1], q[0], 1)
    scale = F.abs(far - near) / (1.2816 - 0.6745)
    return F.struct((near + sign * 0.6745 * scale).alias("middle"), F.greatest(scale, F.lit(least)).alias("scale"))


def language_sketches(stats: DataFrame) -> DataFrame:
    """Middle and scale of every statistic per frequent language, and for all documents as language ``*``.

    Documents of no known language have no sketch of their own.  Nor has one of COMMON whose
    documents as a whole lie far below all others in common words: they are mostly no prose.
    """
    total = stats.count()
    counts = stats.where("lang <> ''").groupBy("lang").agg(F.count("*").alias("n"))
    frequent = [r["lang"] for r in counts.where(F.col("n") >= max(30, LANGUAGE_SHARE * total)).collect()]
    groups = stats.where("n_words > 0").withColumn("sketch", F.explode(F.array_compact(F.array(F.lit("*"), F.when(F.col("lang").isin(*frequent, "\u0000"), F.col("lang"))))))
    got = groups.groupBy("sketch").agg(*(F.percentile_approx(s, [0.1, 0.25, 0.75, 0.9], ACCURACY).alias(s) for s in STATS))
    got = got.select("sketch", *(_fit(F.col(s), PROSE_SIDE[s], LEAST_SCALE[s]).alias(f"q_{s}") for s in STATS))
    every = got.where("sketch = '*'").select(F.col("q_common_share").alias("a"))
    lost = F.substring("sketch", 1, 2).isin(*COMMON) & ((F.col("q_common_share")["middle"] - F.col("a")["middle"]) / F.col("a")["scale"] < -3.0)
    return got.crossJoin(F.broadcast(every)).where(~lost).drop("a")


def z_scores(stats: DataFrame, sketches: DataFrame) -> DataFrame:
    """Adds ``z_<statistic>``: robust z-scores against the document's language, or all documents where it has no sketch."""
    own = F.broadcast(sketches.withColumnRenamed("sketch", "lang"))
    every = F.broadcast(sketches.where("sketch = '*'").select(*(F.col(f"q_{s}").alias(f"a_{s}") for s in STATS)))
    j = stats.join(own, "lang", "left").join(every, F.lit(True), "left")
    q = {s: F.coalesce(F.col(f"q_{s}"), F.col(f"a_{s}")) for s in STATS}
    return j.select(*stats.columns, *(((F.col(s) - q[s]["middle"]) / q[s]["scale"]).alias(f"z_{s}") for s in STATS))


def classify(z: DataFrame) -> DataFrame:
    """Adds ``doc_class``: ``list``, ``table``, ``junk``, or ``prose`` for documents that aren't in the tails.  An empty document is in no class but prose."""
    c = F.col
    # 3 units of the quartile range, in which the non-prose of sf0.1 has a part, are 3.6 of the prose side
    far = c("z_common_share") < -3.6
    junk = (
        (c("n_words") == 0) & (c("n_lines") > 0)
        | (c("z_vowel_ratio") < -8) & (c("digit_ratio") < 0.15) & far
        | (c("z_mean_word") < -4) & (c("digit_ratio") < 0.15) & (c("mean_word") < 2)
        | (c("mean_word") > 25)
        | (c("unbroken_share") >= 0.5) & far
        | (c("z_symbol_ratio") > 8) & (c("symbol_ratio") > 0.6)
        | (c("n_words") >= 12) & (c("z_variety") < -1.5) & (c("variety") < 0.9)
        | (c("control_share") >= 0.5) & (c("n_lines") >= 3)
        | (c("n_lines") >= 12) & (c("line_variety") < 0.4) & (c("z_line_end_share") < -0.5) & far
    )
    table = far & (c("column_share") >= 0.6) & (c("z_digit_ratio") > 2) & (c("n_lines") >= 3)
    listed = far & ((c("entry_share") >= 0.9) | (c("entry_share") >= 0.7) & (c("line_end_share") <= 0.05)) & (c("n_lines") >= 4)
    return z.withColumn("doc_class", F.when(c("n_lines") == 0, "prose").when(table, "table").when(junk, "junk").when(listed, "list").otherwise("prose"))


def document_quality(docs: DataFrame) -> DataFrame:
    """All statistics, z-scores and the class of each document of ``(doc_id, text, lang)``."""
    stats = Scratch(docs.sparkSession, "quality").cut(text_statistics(docs, learned_common(docs)), "stats")
    return classify(z_scores(stats, language_sketches(stats)))


def _documents(spark: SparkSession, sf: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text", "lang")


def p10_found(spark: SparkSession, sf: str) -> DataFrame:
    return document_quality(_documents(spark, sf)).where("doc_class <> 'prose'").select("doc_id", "doc_class")


def p10_statistics(spark: SparkSession, sf: str) -> DataFrame:
    """Statistics, z-scores and class of every document."""
    return document_quality(_documents(spark, sf))


COUNTS = ("n_words", "n_lines", "mean_word", "symbol_ratio", "line_end_share", "common_share", "digit_ratio", "vowel_ratio", "variety", "entry_share", "column_share", "line_variety")


def p10_counts(spark: SparkSession, sf: str) -> DataFrame:
    """The statistics of every document by themselves, before they are set against others; shares to nine places."""
    docs = _documents(spark, sf)
    stats = text_statistics(docs, learned_common(docs))
    return stats.select("doc_id", "n_words", "n_lines", *(F.round(c, 9).alias(c) for c in COUNTS[2:]))


def _sql_counts() -> str:
    wide, narrow = "".join(map(chr, range(0xFF01, 0xFF5F))), "".join(map(chr, range(0x21, 0x7F))).replace("'", "''")
    a, b = "".join(TO_LATIN), "".join(TO_LATIN.values())
    common = ", ".join(f"'{w}'" for w in sorted({w for words in COMMON.values() for w in words.split()}))
    q = f"{ENTRY}|{CONTENTS}|{BOOK}"
    ends = "right(rtrim({x}, '\"''”’»)] '), 1) IN ('.', '!', '?', '…', ':')"
    share = lambda part, whole: f"round(coalesce({part} / nullif({whole}, 0), 0.0)::DOUBLE, 9)"
    held = lambda keep: f"len(list_filter(lines, lambda x: {keep}))"
    cells = f"len(string_split_regex(x, '{CELLS}')) >= 3 AND length(translate(lower(x), 'abcdefghijklmnopqrstuvwxyz ', '')) >= 0.4 * length(replace(x, ' ', ''))"
    return f"""
WITH t AS (SELECT doc_id, translate(coalesce(text, ''), '{a}{wide}{IGNORABLE}', '{b}{narrow}') AS t FROM documents),
w AS (SELECT doc_id, list_filter(string_split_regex(lower(t), '[^\\p{{L}}\\p{{N}}]+'), lambda x: x <> '') AS w, list_filter(list_transform(string_split_regex(t, '[\\n\\f\\r]+'), lambda x: trim(x)), lambda x: x <> '') AS lines, length(translate(t, ' \n\t\f\r\u00a0', '')) AS solid FROM t),
j AS (SELECT *, array_to_string(w, '') AS j, length(array_to_string(w, '')) AS alnum FROM w)
SELECT doc_id, len(w)::INT AS n_words, len(lines)::INT AS n_lines, {share('alnum', 'len(w)')} AS mean_word, {share('(solid - alnum)', 'solid')} AS symbol_ratio,
  {share(held(ends.format(x='x')), 'len(lines)')} AS line_end_share, {share(f'len(list_filter(w, lambda x: x IN ({common})))', 'len(w)')} AS common_share,
  {share("(alnum - length(translate(j, '0123456789', '')))", 'alnum')} AS digit_ratio, {share(f"(alnum - length(translate(j, '{VOWELS}', '')))", 'alnum')} AS vowel_ratio,
  {share('len(list_distinct(w))', 'sqrt(len(w))')} AS variety,
  {share(held(f"regexp_matches(x, '{q}') OR (NOT ({ends.format(x='x')}) AND len(string_split(x, ' ')) <= 6)"), 'len(lines)')} AS entry_share,
  {share(held(cells), 'len(lines)')} AS column_share, {share('len(list_distinct(lines))', 'len(lines)')} AS line_variety FROM j"""


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {"p10_found": p10_found, "p10_statistics": p10_statistics, "p10_counts": p10_counts}
SQL: dict[str, str] = {"p10_counts": _sql_counts()}
