"""Lines to paragraphs to sentences.  No row is deleted: ``kept`` turns false and ``drop_reason`` says why."""

from __future__ import annotations

import re
from collections.abc import Callable
from functools import reduce

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from claimloom.functions import text as T
from claimloom.operators.ranks import global_rank

Step = Callable[[DataFrame], DataFrame]
PARAGRAPH = ("doc_id", "para", "page", "section", "text")

# Line patterns.
REFERENCES = r"(?i)^#{1,6}\s*(references|bibliography|notes?|acknowledge?ments?)\s*$"
CHAPTER = r"^\s*(CHAPTER|PART)\s*$"
BACK_MATTER = r"(?i)^\s*(index|contents|appendix)\s*$"
HEADING = r"^#{1,6}\s"
PAGE_NUMBER = r"(?i)^\s*[ivxlcdm\d]{1,6}\s*$"
DOI_LINE = r"(?i)^\s*(\[?https?://|10\.\d{4,}/|doi:)"
ONE_TOKEN = r"^\s*[\w./:%-]+\s*$"
ABBREVIATIONS = "e.g i.e cf al vs viz etc resp approx fig figs tab eq ch chap sec no vol pp p ed eds trans repr rev suppl dr prof mr mrs ms st jr sr univ dept inc ltd u.s u.k a.m p.m n.b ibid op.cit et".split()


def raw_lines(pages: DataFrame) -> DataFrame:
    """Page text ``(doc_id, page, markdown)`` to line rows in reading order; a blank page is one dropped row."""
    rows = pages.select("doc_id", "page", F.posexplode(F.split(F.coalesce("markdown", F.lit("")), "\n")).alias("pos", "text"), (F.trim(F.coalesce("markdown", F.lit(""))) == "").alias("empty"))
    rows = rows.where("not empty or pos = 0")
    line_no = F.col("page").cast("long") * F.lit(1_000_000) + F.col("pos")
    return rows.select("doc_id", "page", line_no.alias("line_no"), F.lit("").alias("section"), F.when(F.col("empty"), "").otherwise(F.col("text")).alias("text"), (~F.col("empty")).alias("kept"), F.when(F.col("empty"), "empty_page").otherwise("").alias("drop_reason"), F.lit("").alias("flag"))


def fix_unicode(rows: DataFrame) -> DataFrame:
    return rows.withColumn("text", T.fix_unicode(F.col("text")))


def strip_markdown(rows: DataFrame) -> DataFrame:
    return rows.withColumn("text", T.strip_markdown(F.col("text")))


def drop_running_heads(rows: DataFrame) -> DataFrame:
    """Lines of up to 90 characters that a document holds three times or more.

    Counted by a partial aggregate and joined back, so a document of any size
    is spread over the tasks.
    """
    line = F.trim("text")
    heads = rows.select("doc_id", line.alias("_line")).where("length(_line) between 1 and 90").groupBy("doc_id", "_line").agg(F.count("*").alias("_n")).where("_n >= 3")
    j = rows.withColumn("_line", line).join(heads, ["doc_id", "_line"], "left")
    hit = F.col("kept") & F.col("_n").isNotNull()
    return j.withColumn("drop_reason", F.when(hit, "running_head").otherwise(F.col("drop_reason"))).withColumn("kept", F.col("kept") & ~hit).select(*rows.columns)


def drop_junk_lines(rows: DataFrame) -> DataFrame:
    """Structural junk lines; a heading names the section of the lines after it, a reference section lasts to the next chapter mark."""
    order = Window.partitionBy("doc_id").orderBy("line_no")
    upto = order.rowsBetween(Window.unboundedPreceding, 0)
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    line = F.trim("text")
    mark = F.when(F.col("kept") & line.rlike(CHAPTER), 0).when(F.col("kept") & line.rlike(REFERENCES), 1)
    j = rows.withColumn("_refs", F.coalesce(F.last(mark, ignorenulls=True).over(upto), F.lit(0)) == 1)
    heading = F.when(F.col("kept") & ~F.col("_refs") & line.rlike(HEADING), F.regexp_replace(line, r"^#+\s*", ""))
    j = j.withColumn("_section", F.coalesce(F.last(heading, ignorenulls=True).over(before), F.lit("")))
    reason = (
        F.when(F.col("_refs"), "reference_section")
        .when(line == "", "blank")
        .when(line.rlike(CHAPTER), "chapter_marker")
        .when(line.rlike(BACK_MATTER), "front_back_matter")
        .when(line.startswith("|"), "table_row")
        .when(line.rlike(HEADING), "heading")
        .when(line.rlike(PAGE_NUMBER), "page_number")
        .when(line.rlike(DOI_LINE), "doi_url")
        .when(line.rlike(ONE_TOKEN) & line.rlike(r"\d"), "ref_fragment")
        .when(T.alpha_ratio(line) < 0.55, "low_alpha")
    )
    j = j.withColumn("_reason", F.when(F.col("kept"), reason))
    j = j.withColumn("section", F.when(F.col("kept") & ~F.col("_refs"), F.col("_section")).otherwise(F.col("section")))
    return j.withColumn("drop_reason", F.coalesce("_reason", "drop_reason")).withColumn("kept", F.col("kept") & F.col("_reason").isNull()).select(*rows.columns)


def join_paragraphs(rows: DataFrame) -> DataFrame:
    """Kept lines to paragraphs, numbered by ``para`` from 0 within a document; dropped lines go along with no ``para``.

    A dropped line closes a paragraph; a word cut by a hyphen is joined; a
    paragraph without final punctuation merges with a next one that starts
    in lower case.  Both rules look at neighbours only, so they are windows.
    """
    order = Window.partitionBy("doc_id").orderBy("line_no")
    line = F.trim("text")
    k = rows.select("doc_id", "line_no", "page", "section", line.alias("text"), "kept", F.lag("kept", 1, False).over(order).alias("_open"))
    k = k.withColumn("_block", F.sum(F.when(F.col("kept") & ~F.col("_open"), 1).otherwise(0)).over(order)).where("kept")
    inside = Window.partitionBy("doc_id", "_block").orderBy("line_no")
    glued = (F.lag("text").over(inside).endswith("-")) & F.col("text").rlike(r"^\p{Ll}")
    k = k.withColumn("_glued", F.coalesce(glued, F.lit(False)))
    k = k.withColumn("_next", F.coalesce(F.lead("_glued").over(inside), F.lit(False)))
    piece = F.concat(F.when(F.col("_glued") | (F.row_number().over(inside) == 1), "").otherwise(" "), F.when(F.col("_next"), F.expr("substring(text, 1, length(text) - 1)")).otherwise(F.col("text")))
    b = k.withColumn("_piece", piece).groupBy("doc_id", "_block").agg(F.min_by("page", "line_no").alias("page"), F.min_by("section", "line_no").alias("section"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line_no", "_piece"))), lambda x: x["_piece"]), "").alias("text"))
    b = b.withColumn("text", F.regexp_replace(F.trim(F.regexp_replace("text", r"(?U)\s+", " ")), r"(?U)(\w)- ([a-z])", "$1$2"))
    blocks = Window.partitionBy("doc_id").orderBy("_block")
    joins = ~F.lag("text").over(blocks).rlike(T.TERMINAL) & F.col("text").rlike(r"^\p{Ll}")
    b = b.withColumn("para", F.sum(F.when(F.coalesce(joins, F.lit(False)), 0).otherwise(1)).over(blocks) - 1)
    b = b.groupBy("doc_id", "para").agg(F.min_by("page", "_block").alias("page"), F.min_by("section", "_block").alias("section"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_block", "text"))), lambda x: x["text"]), " ").alias("text"))
    b = b.select(*PARAGRAPH, F.lit(None).cast("long").alias("line_no"), F.lit(True).alias("kept"), F.lit("").alias("drop_reason"), F.lit("").alias("flag"))
    return b.unionByName(rows.where("not kept").select("doc_id", F.lit(None).cast("long").alias("para"), "page", "section", "text", F.col("line_no").cast("long").alias("line_no"), "kept", "drop_reason", "flag"))


_ENDS = re.compile(r"""[.!?]+["')\]]*(?=\s+|$)""")
_NUMERIC = re.compile(r"-?[.,]?\d[\d,.-]*")
_SHORT = frozenset(ABBREVIATIONS)


def _goes_on(word: str, stop: str, after: str) -> bool:
    """Whether a sentence goes on behind ``word`` and its ``stop``, by the published rules without any trained counts."""
    if stop[0] != "." or not after:
        return False
    if stop.startswith("..") or word in _SHORT or word.rsplit("-", 1)[-1] in _SHORT:
        return True  # an ellipsis or abbreviation; nothing tells that the next word opens a sentence
    if len(word) == 1 and word.isalpha():
        return True  # an initial
    return bool(_NUMERIC.fullmatch(word)) and (after.islower() or not after.isalnum())


def sentences_of(text: str) -> list[str]:
    """Sentences of a paragraph; closing quotes and brackets belong to the sentence before them."""
    out, start = [], 0
    for m in _ENDS.finditer(text):
        word = text[start : m.start()].rsplit(None, 1)[-1:] or [""]
        stop = m.group().rstrip("\"')]")
        if _goes_on(word[0].lstrip("([\"'").lower(), stop, text[m.end() :].lstrip()[:1]):
            continue
        out.append(text[start : m.end()].strip())
        start = m.end()
    rest = text[start:].strip()
    return [s for s in (*out, rest) if s]


def split_sentences(paragraphs: DataFrame) -> DataFrame:
    """Paragraphs to sentences with ids ``p0000s000``; dropped rows go along without an id."""

    @F.pandas_udf("array<string>")
    def split(s: pd.Series) -> pd.Series:
        return s.map(lambda t: sentences_of(t or ""))

    cut = F.when(F.col("kept"), split("text")).otherwise(F.array("text"))
    e = paragraphs.select("doc_id", "para", "page", "section", "line_no", "kept", "drop_reason", "flag", F.posexplode(cut).alias("_s", "raw"))
    return e.select("doc_id", "page", F.when(F.col("kept"), F.format_string("p%04ds%03d", "para", "_s")).alias("sent_id"), "section", "raw", F.col("raw").alias("text"), "kept", "drop_reason", "flag", "line_no")


def number_documents(rows: DataFrame) -> DataFrame:
    """``(doc_id, doc_no)``: ``d000`` and so on, in the order of the names."""
    docs = global_rank(rows.select("doc_id").distinct(), "doc_id", "_n", first=0)
    return docs.select("doc_id", F.format_string("d%03d", "_n").alias("doc_no"))


def prefix_ids(rows: DataFrame) -> DataFrame:
    """Puts the document's number before the sentence ids, so that they are unique across documents."""
    return rows.join(number_documents(rows), "doc_id").withColumn("sent_id", F.concat("doc_no", "sent_id")).select(*rows.columns)


def kept_sentences(rows: DataFrame) -> DataFrame:
    """The sentences of a harvest: kept rows that were split into sentences."""
    return rows.where("kept and sent_id is not null").select("doc_id", "page", "sent_id", "section", "raw", F.col("text").alias("clean"), "flag")


def drop_log(rows: DataFrame) -> DataFrame:
    """What a harvest dropped, and why; blank lines are no loss and are left out."""
    return rows.where("not kept and drop_reason <> 'blank'").select("doc_id", "page", "section", "drop_reason", "text")


def harvest_summary(rows: DataFrame) -> DataFrame:
    """Drop reasons, most frequent first."""
    return rows.where("not kept").groupBy("drop_reason").agg(F.count("*").alias("n_rows")).orderBy(F.desc("n_rows"), "drop_reason")


def strip_citations(rows: DataFrame) -> DataFrame:
    return rows.withColumn("text", F.when(F.col("kept"), T.strip_groups(F.col("text"), T.is_citation)).otherwise(F.col("text")))


def strip_stats(rows: DataFrame) -> DataFrame:
    return rows.withColumn("text", F.when(F.col("kept"), T.strip_groups(F.col("text"), T.is_statistic)).otherwise(F.col("text")))


def junk_reason(t) -> F.Column:
    """Reason to drop a sentence, or NULL."""
    digits = F.length(F.regexp_replace(t, r"\D", "")) / F.greatest(F.length(t), F.lit(1))
    return (
        F.when(t.rlike(T.LICENCE), "licence_text")
        .when(t.rlike(T.LABEL), "caption_or_keywords")
        .when(t.rlike(r"(?i)^\s*See also\b") | (F.regexp_count(t, F.lit(r"\d+[-]\d+")) >= 3), "index_entry")
        .when(T.broken_word_ratio(t) > 0.25, "spaced_letters")
        .when(~t.rlike(r"\p{Ll}"), "no_lowercase")
        .when(T.alpha_ratio(t) < 0.50, "low_alpha")
        .when(digits > 0.20, "digit_heavy")
    )


def drop_junk_sentences(rows: DataFrame) -> DataFrame:
    """Structural junk sentences are dropped, doubtful ones flagged."""
    t = F.col("text")
    flag = F.when(t.rlike(T.FRONT_MATTER), "front_matter").when(~F.trim(t).rlike(T.TERMINAL), "fragment").when(F.size(T.words(t)) > 80, "long")
    j = rows.withColumn("_reason", F.when(F.col("kept"), junk_reason(t)))
    j = j.withColumn("flag", F.when(F.col("kept") & F.col("_reason").isNull(), F.coalesce(flag, F.col("flag"))).otherwise(F.col("flag")))
    return j.withColumn("drop_reason", F.coalesce("_reason", "drop_reason")).withColumn("kept", F.col("kept") & F.col("_reason").isNull()).select(*rows.columns)


def filter_length(rows: DataFrame, min_words: int = 4, max_words: int = 80) -> DataFrame:
    n = F.size(T.words(F.col("text")))
    j = rows.withColumn("_reason", F.when(F.col("kept"), F.when(n < min_words, "too_short").when(n > max_words, "too_long")))
    return j.withColumn("drop_reason", F.coalesce("_reason", "drop_reason")).withColumn("kept", F.col("kept") & F.col("_reason").isNull()).select(*rows.columns)


STEPS: dict[str, Step] = {
    "fix_unicode": fix_unicode,
    "strip_markdown": strip_markdown,
    "drop_running_heads": drop_running_heads,
    "drop_junk_lines": drop_junk_lines,
    "join_paragraphs": join_paragraphs,
    "split_sentences": split_sentences,
    "strip_citations": strip_citations,
    "strip_stats": strip_stats,
    "drop_junk_sentences": drop_junk_sentences,
    "filter_length": filter_length,
}
DEFAULT_STEPS = list(STEPS)


def page_set(spec) -> list[int] | None:
    """Pages named by 12, "12-540", "3,7,9-12" or a list; None for all."""
    if spec is None:
        return None
    if isinstance(spec, int):
        return [spec]
    if isinstance(spec, str):
        out: list[int] = []
        for part in spec.split(","):
            a, _, b = part.strip().partition("-")
            out += range(int(a), int(b or a) + 1)
        return sorted(set(out))
    return sorted({int(p) for p in spec})


def harvest(pages: DataFrame, steps: list[str | Step] | None = None, min_words: int = 4, max_words: int = 80, only=None, skip=None) -> DataFrame:
    """Pages through the steps, named or callables; settings are checked before any plan is built.

    No row is lost: :func:`kept_sentences` and :func:`drop_log` tell the rows apart.
    """
    if min_words < 1 or max_words < min_words:
        raise ValueError(f"min_words and max_words must be 1 <= min <= max; got {min_words} and {max_words}")
    chosen: list[Step] = []
    for s in DEFAULT_STEPS if steps is None else steps:
        if isinstance(s, str) and s not in STEPS:
            raise ValueError(f"unknown step {s!r}; choose from {DEFAULT_STEPS}")
        f = STEPS[s] if isinstance(s, str) else s
        chosen.append((lambda df: filter_length(df, min_words, max_words)) if s == "filter_length" else f)
    if (keep := page_set(only)) is not None:
        pages = pages.where(F.col("page").isin(keep))
    if (cut := page_set(skip)) is not None:
        pages = pages.where(~F.col("page").isin(cut))
    return reduce(lambda df, f: f(df), chosen, raw_lines(pages))
