"""Queries over the library's own operators, and their SQL where SQL can say the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from claimloom.functions import text as T
from claimloom.operators import causal_map as M
from claimloom.operators import dois as D
from claimloom.operators import extract as X
from claimloom.operators import harvest as H
from claimloom.operators import labels as L
from claimloom.operators import standardize as S
from claimloom.operators import vectors as V
from claimloom.operators.ranks import global_rank
from claimloom.scratch import Scratch

FLAGSHIP = "causal_map_edges"
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[f.__name__] = f
    return f


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def _lines(spark: SparkSession, sf: str) -> DataFrame:
    """Lines as read, before any earlier run's verdict."""
    return table(spark, sf, "line_rows").select("line_id", "doc_id", "page", "line_no", F.lit("").alias("section"), F.coalesce("text", F.lit("")).alias("text"), F.lit(True).alias("kept"), F.lit("").alias("drop_reason"), F.lit("").alias("flag"))


# --- lines ------------------------------------------------------------------


@query
def lines_running_heads(spark, sf):
    return H.drop_running_heads(_lines(spark, sf)).select("line_id", "kept", "drop_reason")


@query
def lines_junk(spark, sf):
    return H.drop_junk_lines(H.drop_running_heads(_lines(spark, sf))).select("line_id", "section", "kept", "drop_reason")


@query
def lines_paragraphs(spark, sf):
    return H.join_paragraphs(H.drop_junk_lines(H.drop_running_heads(_lines(spark, sf)))).where("kept").select(*H.PARAGRAPH)


@query
def harvest_drop_log(spark, sf):
    """Every dropped line with its reason, as it comes out behind the paragraphs."""
    return H.drop_log(H.join_paragraphs(H.drop_junk_lines(H.drop_running_heads(_lines(spark, sf)))))


@query
def document_numbers(spark, sf):
    """The numbers that make sentence ids unique across papers."""
    return H.number_documents(table(spark, sf, "line_rows"))


@query
def lines_drop_summary(spark, sf):
    return H.drop_junk_lines(H.drop_running_heads(_lines(spark, sf))).groupBy("drop_reason").agg(F.count("*").alias("n_lines"))


def _pages(spark: SparkSession, sf: str) -> DataFrame:
    """Pages put together from the lines."""
    lines = table(spark, sf, "line_rows").select("doc_id", "page", "line_no", F.coalesce("text", F.lit("")).alias("text"))
    return lines.groupBy("doc_id", "page").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line_no", "text"))), lambda x: x["text"]), "\n").alias("markdown"))


@query
def harvest_sentences(spark, sf):
    """The whole pipeline; sentence ids with the number of their paper."""
    return H.kept_sentences(H.prefix_ids(Scratch(spark, "harvest").cut(H.harvest(_pages(spark, sf)), "rows")))


_LINES = """
WITH l0 AS (SELECT line_id, doc_id, page, line_no, trim(coalesce(text, '')) AS t FROM line_rows),
heads AS (SELECT doc_id, t FROM l0 WHERE length(t) BETWEEN 1 AND 90 GROUP BY doc_id, t HAVING count(*) >= 3),
l1 AS (SELECT l0.*, heads.t IS NULL AS k1 FROM l0 LEFT JOIN heads ON heads.doc_id = l0.doc_id AND heads.t = l0.t)
"""
_JUNK = (
    _LINES
    + r""",
l2 AS (SELECT *, coalesce(last_value(CASE WHEN k1 AND regexp_matches(t, '^\s*(CHAPTER|PART)\s*$') THEN 0
   WHEN k1 AND regexp_matches(t, '(?i)^#{1,6}\s*(references|bibliography|notes?|acknowledge?ments?)\s*$') THEN 1 END IGNORE NULLS)
   OVER (PARTITION BY doc_id ORDER BY line_no ROWS UNBOUNDED PRECEDING), 0) = 1 AS refs FROM l1),
l3 AS (SELECT *, coalesce(last_value(CASE WHEN k1 AND NOT refs AND regexp_matches(t, '^#{1,6}\s') THEN regexp_replace(t, '^#+\s*', '') END IGNORE NULLS)
   OVER (PARTITION BY doc_id ORDER BY line_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), '') AS sec FROM l2),
l4 AS (SELECT *, CASE WHEN NOT k1 THEN 'running_head' WHEN refs THEN 'reference_section' WHEN t = '' THEN 'blank'
   WHEN regexp_matches(t, '^\s*(CHAPTER|PART)\s*$') THEN 'chapter_marker' WHEN regexp_matches(t, '(?i)^\s*(index|contents|appendix)\s*$') THEN 'front_back_matter'
   WHEN t LIKE '|%' THEN 'table_row' WHEN regexp_matches(t, '^#{1,6}\s') THEN 'heading' WHEN regexp_matches(t, '(?i)^\s*[ivxlcdm\d]{1,6}\s*$') THEN 'page_number'
   WHEN regexp_matches(t, '(?i)^\s*(\[?https?://|10\.\d{4,}/|doi:)') THEN 'doi_url' WHEN regexp_matches(t, '^\s*[\w./:%-]+\s*$') AND regexp_matches(t, '\d') THEN 'ref_fragment'
   WHEN length(regexp_replace(t, '[^\p{L}\s]', '', 'g')) / length(t) < 0.55 THEN 'low_alpha' ELSE '' END AS reason FROM l3)
"""
)
SQL["lines_running_heads"] = _LINES + "SELECT line_id, k1 AS kept, CASE WHEN k1 THEN '' ELSE 'running_head' END AS drop_reason FROM l1"
SQL["lines_junk"] = _JUNK + "SELECT line_id, CASE WHEN k1 AND NOT refs THEN sec ELSE '' END AS section, reason = '' AS kept, reason AS drop_reason FROM l4"
SQL["harvest_drop_log"] = _JUNK + """SELECT doc_id, page, CASE WHEN k1 AND NOT refs THEN sec ELSE '' END AS section, reason AS drop_reason, coalesce(text, '') AS text
  FROM l4 JOIN (SELECT line_id, text FROM line_rows) USING (line_id) WHERE reason NOT IN ('', 'blank')"""
SQL["document_numbers"] = "SELECT doc_id, 'd' || lpad(CAST(rk AS VARCHAR), greatest(3, length(CAST(rk AS VARCHAR)))::INT, '0') AS doc_no FROM (SELECT doc_id, row_number() OVER (ORDER BY doc_id) - 1 AS rk FROM (SELECT DISTINCT doc_id FROM line_rows))"
SQL["lines_drop_summary"] = _JUNK + "SELECT reason AS drop_reason, count(*) AS n_lines FROM l4 GROUP BY reason"
SQL["lines_paragraphs"] = (
    _JUNK
    + r""",
k0 AS (SELECT *, reason = '' AS kept, coalesce(lag(reason = '') OVER (PARTITION BY doc_id ORDER BY line_no), false) AS open FROM l4),
k1 AS (SELECT *, sum(CASE WHEN kept AND NOT open THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY line_no ROWS UNBOUNDED PRECEDING) AS block FROM k0),
k2 AS (SELECT doc_id, line_no, page, sec, t, block, coalesce(lag(t) OVER b LIKE '%-' AND regexp_matches(t, '^\p{Ll}'), false) AS glued, row_number() OVER b AS rn FROM k1 WHERE kept WINDOW b AS (PARTITION BY doc_id, block ORDER BY line_no)),
k3 AS (SELECT *, coalesce(lead(glued) OVER (PARTITION BY doc_id, block ORDER BY line_no), false) AS nxt FROM k2),
b0 AS (SELECT doc_id, block, arg_min(page, line_no) AS page, arg_min(sec, line_no) AS section,
   string_agg((CASE WHEN glued OR rn = 1 THEN '' ELSE ' ' END) || (CASE WHEN nxt THEN t[:-2] ELSE t END), '' ORDER BY line_no) AS text FROM k3 GROUP BY doc_id, block),
b1 AS (SELECT doc_id, block, page, section, regexp_replace(trim(regexp_replace(text, '\s+', ' ', 'g')), '([\p{L}\p{N}_])- ([a-z])', '\1\2', 'g') AS text FROM b0),
b2 AS (SELECT *, sum(CASE WHEN coalesce(NOT prev_ends AND regexp_matches(text, '^\p{Ll}'), false) THEN 0 ELSE 1 END) OVER (PARTITION BY doc_id ORDER BY block ROWS UNBOUNDED PRECEDING) - 1 AS para
   FROM (SELECT *, lag(regexp_matches(text, '[.!?]["'')\]]?$')) OVER (PARTITION BY doc_id ORDER BY block) AS prev_ends FROM b1))
SELECT doc_id, CAST(para AS BIGINT) AS para, arg_min(page, block) AS page, arg_min(section, block) AS section, string_agg(text, ' ' ORDER BY block) AS text FROM b2 GROUP BY doc_id, para"""
)


# --- sentences --------------------------------------------------------------


def _sentences(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "sentences").select("row_id", F.coalesce("clean", F.lit("")).alias("text"), F.lit(True).alias("kept"), F.lit("").alias("drop_reason"), F.lit("").alias("flag"))


@query
def sentences_junk(spark, sf):
    return H.filter_length(H.drop_junk_sentences(_sentences(spark, sf))).select("row_id", "kept", "drop_reason", "flag")


@query
def sentences_stripped(spark, sf):
    """Unicode in one form, then markdown, citations and statistics taken out."""
    return H.strip_stats(H.strip_citations(H.strip_markdown(H.fix_unicode(_sentences(spark, sf))))).select("row_id", "text")


_WORDS = r"list_filter(string_split_regex({t}, '\s+'), lambda w: w <> '')"


def _sql_count(t: str, pattern: str) -> str:
    return f"len(regexp_extract_all({t}, '{pattern}'))"


def _q(pattern: str) -> str:
    """A pattern as SQL text."""
    return pattern.replace("(?U)", "").replace("'", "''")


def _sql_without(t: str, opening: str, closing: str, group: str, noise: str) -> str:
    """Text without the groups in a bracket that are noise: ``noise`` is a condition on ``g``."""
    groups = f"list_filter(regexp_extract_all({t}, '{group}', 1), lambda g: {noise})"
    return f"list_reduce({groups}, lambda acc, g: replace(acc, '{opening}' || g || '{closing}', ''), {t})"


_YEARS = _sql_count("g", _q(T.YEAR))
_CITES = f"({_YEARS} > 0 AND ({_YEARS} >= 2 AND (contains(g, ';') OR contains(g, 'et al')) OR {_sql_count('g', '[A-Za-z]+')} <= 12 AND (regexp_matches(g, '[A-Z][a-z]+|et al\\.?|&|;') OR regexp_matches(trim(g), '^\\d+$'))))"
_REPORTS = f"(regexp_matches(g, '{_q(T.STATISTIC)}') AND length(regexp_replace(g, '[\\p{{L}}\\s]', '', 'g')) > 0.15 * length(g) AND {_sql_count('g', '[A-Za-z]{4,}')} <= 4)"
_ROUND, _SQUARE = r"\(([^()]{0,300}?)\)", r"\[([^\[\]]{0,300}?)\]"


def _sql_strip(source: str, noise: str) -> str:
    """A step that strips noise in round, then in square brackets, and tidies."""
    tidy = "t"
    for p, by in T.TIDY_GROUPS:
        tidy = f"regexp_replace({tidy}, '{_q(p)}', '{by.replace('$', chr(92))}', 'g')"
    return f"SELECT row_id, trim({tidy}) AS t FROM (SELECT row_id, {_sql_without('t', '[', ']', _SQUARE, noise)} AS t FROM (SELECT row_id, {_sql_without('t', '(', ')', _ROUND, noise)} AS t FROM {source}))"


def _sql_unicode(t: str) -> str:
    """Compatibility forms that the tables hold, then the table of quotes, dashes and spaces."""
    wide, narrow = "".join(map(chr, range(0xFF01, 0xFF5F))), "".join(map(chr, range(0x21, 0x7F))).replace("'", "''")
    for ligature, letters in (("ﬃ", "ffi"), ("ﬄ", "ffl"), ("ﬀ", "ff"), ("ﬁ", "fi"), ("ﬂ", "fl"), ("…", "..."), ("″", "′′"), ("\u202f", " "), ("\u205f", " ")):
        t = f"replace({t}, '{ligature}', '{letters}')"
    t = f"translate(nfc_normalize({t}), '{wide}', '{narrow}')"
    old = T.SINGLE_QUOTES + T.DOUBLE_QUOTES + T.DASHES + T.ODD_SPACES
    new = "''" * len(T.SINGLE_QUOTES) + '"' * len(T.DOUBLE_QUOTES) + "-" * len(T.DASHES) + " " * len(T.ODD_SPACES)
    return f"translate({t}, '{old}{T.INVISIBLE}', '{new}')"


SQL["sentences_stripped"] = rf"""
WITH s0 AS (SELECT row_id, {_sql_unicode("coalesce(clean, '')")} AS t FROM sentences),
s1 AS (SELECT row_id, regexp_replace(t, '\[([^\]]*)\]\((?:[^)]*)\)', '', 'g') AS t FROM s0),
-- no back-references here: one marker after the other, the longest first
s2 AS (SELECT row_id, regexp_replace(regexp_replace(t, '\*\*(\S|\S[^*]*?\S)\*\*', '', 'g'), '(\*|_)(\S|\S[^*_]*?\S)(\*|_)', '', 'g') AS t FROM s1),
s3 AS ({_sql_strip('s2', _CITES)}), s4 AS ({_sql_strip('s3', _REPORTS)})
SELECT row_id, t AS text FROM s4"""
_SHORTS = ", ".join(f"'{w}'" for w in T.SHORT_WORDS)
SQL["sentences_junk"] = rf"""
WITH s AS (SELECT row_id, coalesce(clean, '') AS t FROM sentences),
w AS (SELECT *, {_WORDS.format(t='t')} AS ws FROM s),
b AS (SELECT *, len(list_filter(list_transform(ws, lambda x: lower(regexp_replace(x, '[^A-Za-z]', '', 'g'))), lambda x: length(x) BETWEEN 1 AND 2 AND x NOT IN ({_SHORTS}))) AS bad FROM w),
j AS (SELECT *, CASE WHEN regexp_matches(t, '{_q(T.LICENCE)}') THEN 'licence_text' WHEN regexp_matches(t, '{_q(T.LABEL)}') THEN 'caption_or_keywords'
  WHEN regexp_matches(t, '(?i)^\s*See also') OR {_sql_count('t', r'\d+[-]\d+')} >= 3 THEN 'index_entry'
  WHEN bad >= 3 AND bad / len(ws) > 0.25 THEN 'spaced_letters' WHEN NOT regexp_matches(t, '\p{{Ll}}') THEN 'no_lowercase'
  WHEN length(regexp_replace(t, '[^\p{{L}}\s]', '', 'g')) < 0.50 * length(t) OR t = '' THEN 'low_alpha'
  WHEN length(regexp_replace(t, '[^0-9]', '', 'g')) / greatest(length(t), 1) > 0.20 THEN 'digit_heavy' END AS junk FROM b),
f AS (SELECT *, CASE WHEN junk IS NOT NULL THEN '' WHEN regexp_matches(t, '{_q(T.FRONT_MATTER)}') THEN 'front_matter'
  WHEN NOT regexp_matches(trim(t), '{_q(T.TERMINAL)}') THEN 'fragment' WHEN len(ws) > 80 THEN 'long' ELSE '' END AS flag FROM j)
SELECT row_id, coalesce(junk, CASE WHEN len(ws) < 4 THEN 'too_short' WHEN len(ws) > 80 THEN 'too_long' ELSE '' END) = '' AS kept,
  coalesce(junk, CASE WHEN len(ws) < 4 THEN 'too_short' WHEN len(ws) > 80 THEN 'too_long' ELSE '' END) AS drop_reason, flag FROM f"""


@query
def sentences_relations(spark, sf):
    """Relations by the built-in predictor."""
    return X.extract_relations(table(spark, sf, "sentences"))


@query
def sentences_content_words(spark, sf):
    w = table(spark, sf, "sentences").select(F.explode(T.content_words(F.coalesce("clean", F.lit("")))).alias("word"))
    return w.groupBy("word").agg(F.count("*").alias("n"))


SQL["sentences_content_words"] = f"""
SELECT word, count(*) AS n FROM (SELECT unnest(regexp_extract_all(lower(coalesce(clean, '')), '[a-z][a-z''-]+')) AS word FROM sentences)
WHERE word NOT IN ({', '.join(f"'{w}'" for w in T.STOPWORDS)}) GROUP BY word"""


# --- spans and relations ----------------------------------------------------


@query
def spans_distinct(spark, sf):
    return M.collect_spans(table(spark, sf, "relations"))


@query
def spans_tidy(spark, sf):
    r = table(spark, sf, "relations").select("row_id", F.coalesce("cause", F.lit("")).alias("c"), F.coalesce("effect", F.lit("")).alias("e"))
    return r.select("row_id", T.tidy_span(F.col("c")).alias("cause"), T.tidy_span(F.col("e")).alias("effect"), T.is_vague(F.col("c")).alias("cause_vague"), T.is_vague(F.col("e")).alias("effect_vague"))


@query
def relations_skipped(spark, sf):
    """How many relations have an empty span or one that points to text elsewhere."""
    r = table(spark, sf, "relations").select(F.coalesce("cause", F.lit("")).alias("c"), F.coalesce("effect", F.lit("")).alias("e"))
    return r.groupBy(X.skip_reason(F.col("c"), F.col("e")).alias("skip_reason")).agg(F.count("*").alias("n_relations"))


@query
def relations_verbatim(spark, sf):
    """Relations whose two spans both stand in their sentence, by page."""
    r = table(spark, sf, "relations")
    both = F.lower("sentence").contains(F.lower("cause")) & F.lower("sentence").contains(F.lower("effect"))
    return r.groupBy("page").agg(F.count("*").alias("n_relations"), F.sum(F.when(both, 1).otherwise(0)).alias("n_verbatim"))


_Q = "\"''“”‘’`"


def _sql_tidy(x: str) -> str:
    t = rf"regexp_replace({x}, '\[(CLS|SEP|PAD|UNK|MASK)\]', ' ', 'g')"
    for p, by in ((r"\s+##", ""), ("##", ""), (r"\s+''\s*", "''"), (r"\s+([,.;:!?%)\]}])", r"\1"), (r"([(\[{])\s+", r"\1"), (r"\s+", " ")):
        t = f"regexp_replace({t}, '{p}', '{by}', 'g')"
    left, right = rf"' ' || chr(9) || '{_Q},.;:!?)]}}'", rf"' ' || chr(9) || '{_Q},.;:!?([{{'"
    t = f"rtrim(ltrim({t}, {left}), {right})"
    flat = f"trim(regexp_replace(translate(s, '()', '  '), '\\s+', ' ', 'g'), {left} || {right})"
    return f"(SELECT CASE WHEN len(s) - len(replace(s, '(', '')) = len(s) - len(replace(s, ')', '')) THEN s ELSE {flat} END FROM (SELECT {t} AS s))"


def _sql_vague(x: str) -> str:
    w = rf"list_filter(string_split_regex(lower(regexp_replace(trim({x}), '(?i)^(?:the|a|an)\s+', '')), '\s+'), lambda w: w <> '')"
    return f"coalesce(len({w}) BETWEEN 1 AND {T.MOST_POINTER_WORDS} AND {w}[1] IN ({', '.join(f"'{p}'" for p in T.POINTERS)}), false)"


SQL["spans_distinct"] = """
SELECT span, min(row_id * 2 + side) AS ord FROM (SELECT row_id, 0 AS side, trim(coalesce(cause, '')) AS span FROM relations
UNION ALL SELECT row_id, 1, trim(coalesce(effect, '')) FROM relations) WHERE span <> '' GROUP BY span"""
SQL["spans_tidy"] = f"""
SELECT row_id, {_sql_tidy('c')} AS cause, {_sql_tidy('e')} AS effect, {_sql_vague('c')} AS cause_vague, {_sql_vague('e')} AS effect_vague
FROM (SELECT row_id, coalesce(cause, '') AS c, coalesce(effect, '') AS e FROM relations)"""
SQL["relations_skipped"] = f"""
SELECT CASE WHEN trim(c) = '' OR trim(e) = '' THEN 'empty_span' WHEN {_sql_vague('c')} OR {_sql_vague('e')} THEN 'pointer_span' ELSE '' END AS skip_reason, count(*) AS n_relations
FROM (SELECT coalesce(cause, '') AS c, coalesce(effect, '') AS e FROM relations) GROUP BY ALL"""
SQL["relations_verbatim"] = """
SELECT page, count(*) AS n_relations, sum(CASE WHEN contains(lower(sentence), lower(cause)) AND contains(lower(sentence), lower(effect)) THEN 1 ELSE 0 END)::BIGINT AS n_verbatim FROM relations GROUP BY page"""


# --- groups -----------------------------------------------------------------


@query
def group_keywords(spark, sf):
    return L.keywords(table(spark, sf, "span_groups"))


@query
def group_labels(spark, sf):
    return L.label_groups(table(spark, sf, "span_groups"))


_KEYWORDS = f"""
WITH g AS (SELECT *, CASE WHEN "group" = -1 THEN 's:' || coalesce(span, '') ELSE 'g:' || "group" END AS key FROM span_groups),
w AS (SELECT key, ord, u.word, u.pos FROM (SELECT key, ord, regexp_extract_all(lower(coalesce(span, '')), '[a-z][a-z''-]+') AS ws FROM g),
   LATERAL (SELECT unnest(ws) AS word, generate_subscripts(ws, 1) AS pos) u WHERE u.word NOT IN ({', '.join(f"'{w}'" for w in T.STOPWORDS)})),
tf AS (SELECT key, word, count(*) AS n, min(ord * 1000 + pos) AS first FROM w GROUP BY key, word),
sz AS (SELECT key, sum(n) AS n_words FROM tf GROUP BY key), sp AS (SELECT word, count(*) AS k FROM tf GROUP BY word),
sc AS (SELECT tf.key, tf.word, tf.first, tf.n / sz.n_words * ln(1 + (SELECT count(DISTINCT key) FROM g) / sp.k) AS score FROM tf JOIN sz USING (key) JOIN sp USING (word)),
kw AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY round(score, 12) DESC, first) AS rank FROM sc QUALIFY rank <= 5)
"""
SQL["group_keywords"] = _KEYWORDS + "SELECT key, CAST(rank AS INTEGER) AS rank, word, round(score, 3) AS score FROM kw"
SQL["group_labels"] = (
    _KEYWORDS
    + """, f AS (SELECT key, count(*) AS size, arg_min(coalesce(span, ''), ord) AS span, arg_min(coalesce(central, ''), ord) AS central FROM g GROUP BY key),
ln AS (SELECT key, string_agg(word, ' ' ORDER BY rank) AS line FROM kw GROUP BY key)
SELECT f.key, f.central, f.size, CASE WHEN f.size = 1 THEN f.span ELSE f.central || ' | ' || coalesce(ln.line, '') END AS name FROM f LEFT JOIN ln USING (key)"""
)


# --- the causal map ---------------------------------------------------------


def _names(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    """Relations without their sentences, which no table of a map needs and every join would carry, and the names of their spans."""
    relations = table(spark, sf, "relations").drop("sentence", "page")
    names = M.concept_names(M.collect_spans(relations), table(spark, sf, "concepts"))
    return relations, Scratch(spark, "map").cut(names, "names")


def _map(spark: SparkSession, sf: str) -> M.CausalMap:
    return M.causal_map(*_names(spark, sf))


@query
def causal_map_edges(spark, sf):
    return M.number_edges(M.build_edges(M.place(*_names(spark, sf)))).drop("first_row")


@query
def causal_map_nodes(spark, sf):
    return _map(spark, sf).nodes


@query
def causal_map_evidence(spark, sf):
    return M.place(*_names(spark, sf)).select("row_id", "source", "target", "rel_id")


@query
def causal_map_papers(spark, sf):
    return M.papers_of(table(spark, sf, "relations"))


@query
def causal_map_summary(spark, sf):
    return _map(spark, sf).edges.groupBy("direction", "self_loop", "drop_reason").agg(F.count("*").alias("n_edges"), F.sum("n_relations").alias("n_relations"))


@query
def causal_map_neighbours(spark, sf):
    """Nodes within two steps of those found by a search, over the shown edges."""
    m = _map(spark, sf)
    return M.neighbourhood(m.edges.where("drop_reason = ''"), M.search_nodes(m.nodes, "sleep opt"), 2)


@query
def map_edge_rows(spark, sf):
    """Numbered edges with labels and joined lists, as a file holds them."""
    m = _map(spark, sf)
    return M.edge_rows(M.number_edges(m.edges), m.nodes, m.evidence)


@query
def map_node_rows(spark, sf):
    relations, names = _names(spark, sf)
    m = M.causal_map(relations, names)
    return M.node_rows(m.nodes, names, M.collect_spans(relations)).withColumn("short", M.short_label(F.col("label")))


@query
def map_edge_sentences(spark, sf):
    """The evidence of the shown edges by sentence."""
    m = _map(spark, sf)
    return M.edge_sentences(m.evidence).join(m.edges.where("drop_reason = ''").select("source", "target"), ["source", "target"], "left_semi")


@query
def map_role_filter(spark, sf):
    """Edges between nodes that are both causes and effects, where loops and edges of a single paper are left out first."""
    return M.passing_edges(_map(spark, sf).edges, min_papers=2, self_loops=False, roles=["cause and effect"]).select("source", "target")


@query
def map_near_two(spark, sf):
    """Nodes near the nodes of either of two searches, and of both."""
    m = _map(spark, sf)
    shown, nodes = m.edges.where("drop_reason = ''"), Scratch(spark, "near").cut(m.nodes, "nodes")
    starts = [M.search_nodes(nodes, "sleep opt"), M.search_nodes(nodes, "meal")]
    either = M.neighbourhood(shown, starts[0].unionByName(starts[1]), 1).withColumn("found", F.lit("either"))
    return either.unionByName(M.near_all(shown, starts, 1).withColumn("found", F.lit("both")))


def _groups(spark: SparkSession, sf: str) -> DataFrame:
    return L.group_key(table(spark, sf, "span_groups").where("trim(span) <> ''"))


@query
def map_group_nodes(spark, sf):
    """Nodes when groups are named by their labels."""
    g = _groups(spark, sf)
    names = M.names_of_groups(g.join(L.label_groups(table(spark, sf, "span_groups").where("trim(span) <> ''")).select("key", "name"), "key"))
    return names.groupBy("node_id").agg(F.min("label").alias("label"), F.count("*").alias("n_members"))


@query
def map_concept_nodes(spark, sf):
    """Nodes when a group is named by the concept whose label one of its spans is: groups of one concept are one node."""
    g = _groups(spark, sf)
    found = M.concept_names(g.select("span").distinct(), table(spark, sf, "concepts")).where("node_id like 'c:%'")
    best = g.join(found, "span").groupBy(F.col("key").alias("query")).agg(F.min(F.struct(F.substring("node_id", 3, 1000).alias("id"), F.col("label").alias("leaf"))).alias("m"))
    matches = best.select("query", F.lit(1).alias("rank"), "m.id", "m.leaf")
    names = M.names_of_matched_groups(g.select("span", "key", F.coalesce("central", F.lit("")).alias("central")), matches)
    return names.groupBy("node_id").agg(F.min("label").alias("label"), F.count("*").alias("n_members"))


_PLACED = f"""
WITH RECURSIVE sp AS (SELECT DISTINCT span FROM (SELECT trim(coalesce(cause, '')) AS span FROM relations UNION ALL SELECT trim(coalesce(effect, '')) FROM relations) WHERE span <> ''),
lab AS (SELECT lower(l) AS query, min(id) AS id, arg_min(leaf, id) AS leaf FROM (SELECT id, leaf, unnest(list_concat([leaf], coalesce(alt, []))) AS l FROM concepts) GROUP BY lower(l)),
nm AS (SELECT q.span, coalesce('c:' || lab.id, 's:' || q.span) AS node_id, coalesce(lab.leaf, q.span) AS label FROM (SELECT span, lower({_sql_tidy('span')}) AS query FROM sp) q LEFT JOIN lab USING (query)),
pl AS (SELECT r.*, a.node_id AS source, b.node_id AS target FROM relations r JOIN nm a ON a.span = trim(r.cause) JOIN nm b ON b.span = trim(r.effect)),
e0 AS (SELECT source, target, count(*) AS n_relations, count(DISTINCT coalesce(sent_id, rel_id)) AS n_sentences, count(DISTINCT doc_id) AS n_papers, min(row_id) AS first_row FROM pl GROUP BY source, target),
ed AS (SELECT x.source, x.target, x.n_papers, x.n_sentences, x.n_relations, x.first_row,
   CASE WHEN y.source IS NULL OR x.source = x.target THEN 'one-way' WHEN greatest(x.n_papers, y.n_papers) / (x.n_papers + y.n_papers) < 0.67 THEN 'contested' WHEN x.n_papers > y.n_papers THEN 'dominant' ELSE 'minority' END AS direction,
   y.source IS NOT NULL AND x.source <> x.target AS reciprocal, x.source = x.target AS self_loop, CASE WHEN x.n_sentences < 2 THEN 'below_min_sentences' ELSE '' END AS drop_reason
   FROM e0 x LEFT JOIN e0 y ON y.source = x.target AND y.target = x.source),
cn AS (SELECT node_id, sum(c)::BIGINT AS as_cause, sum(e)::BIGINT AS as_effect FROM (SELECT source AS node_id, n_sentences AS c, 0 AS e FROM ed WHERE drop_reason = '' UNION ALL SELECT target, 0, n_sentences FROM ed WHERE drop_reason = '') GROUP BY node_id),
dn AS (SELECT node_id, count(DISTINCT doc_id) AS n_papers FROM (SELECT pl.source AS node_id, doc_id FROM pl JOIN ed USING (source, target) WHERE drop_reason = '' UNION ALL SELECT pl.target, doc_id FROM pl JOIN ed USING (source, target) WHERE drop_reason = '') GROUP BY node_id),
nd AS (SELECT n.node_id, n.label, n.n_members, coalesce(as_cause, 0) AS as_cause, coalesce(as_effect, 0) AS as_effect, coalesce(as_cause, 0) + coalesce(as_effect, 0) AS n_sentences, coalesce(n_papers, 0) AS n_papers,
   CASE WHEN cn.node_id IS NULL THEN '' WHEN as_effect = 0 THEN 'cause only' WHEN as_cause = 0 THEN 'effect only' ELSE 'cause and effect' END AS role, cn.node_id IS NOT NULL AS shown
   FROM (SELECT node_id, min(label) AS label, count(*) AS n_members FROM nm GROUP BY node_id) n LEFT JOIN cn USING (node_id) LEFT JOIN dn USING (node_id)),
bo AS (SELECT source AS a, target AS b FROM ed WHERE drop_reason = '' UNION SELECT target, source FROM ed WHERE drop_reason = ''),
st AS (SELECT node_id FROM nd WHERE regexp_matches(lower(label), '(^|[^a-z0-9])sleep opt')),
h1 AS (SELECT node_id FROM st UNION SELECT b FROM bo JOIN st ON a = node_id), h2 AS (SELECT node_id FROM h1 UNION SELECT b FROM bo JOIN h1 ON a = node_id)
"""
_NUMBERED = ", nu AS (SELECT *, 'e' || lpad(CAST(rk AS VARCHAR), greatest(5, length(CAST(rk AS VARCHAR)))::INT, '0') AS edge_id FROM (SELECT *, row_number() OVER (ORDER BY first_row) AS rk FROM ed))"
SQL["map_edge_rows"] = (
    _PLACED
    + _NUMBERED
    + """, dl AS (SELECT source, target, string_agg(doc_id, ' | ' ORDER BY place) AS doc_ids FROM (SELECT source, target, doc_id, min(row_id) AS place FROM pl GROUP BY ALL) GROUP BY ALL),
rl AS (SELECT source, target, string_agg(rel_id, ' | ' ORDER BY row_id) AS rel_ids FROM pl GROUP BY ALL)
SELECT edge_id, source, a.label AS source_label, target, b.label AS target_label, nu.n_papers, nu.n_sentences, n_relations, direction, reciprocal, self_loop, drop_reason, doc_ids, rel_ids
FROM nu JOIN dl USING (source, target) JOIN rl USING (source, target) JOIN nd a ON a.node_id = source JOIN nd b ON b.node_id = target"""
)
SQL["map_node_rows"] = (
    _PLACED
    + """, so AS (SELECT span, min(ord) AS ord FROM (SELECT trim(coalesce(cause, '')) AS span, row_id * 2 AS ord FROM relations UNION ALL SELECT trim(coalesce(effect, '')), row_id * 2 + 1 FROM relations) GROUP BY span),
mb AS (SELECT node_id, string_agg(span, ' | ' ORDER BY ord) AS members FROM nm JOIN so USING (span) GROUP BY node_id), hd AS (SELECT node_id, split_part(label, ' | ', 1) AS h FROM nd)
SELECT nd.*, members, CASE WHEN length(h) > 40 THEN h[:39] || '…' ELSE h END AS short FROM nd JOIN mb USING (node_id) JOIN hd USING (node_id)"""
)
SQL["map_edge_sentences"] = (
    _PLACED
    + """, pp AS (SELECT source, target, coalesce(sent_id, rel_id) AS sent_id, doc_id, count(*) AS n, min(row_id) AS place, trim(cause) || ' → ' || trim(effect) AS pair FROM pl GROUP BY ALL)
SELECT source, target, sent_id, doc_id, sum(n)::BIGINT AS n_relations, string_agg(pair, '; ' ORDER BY place) AS pairs FROM pp JOIN (SELECT source, target FROM ed WHERE drop_reason = '') USING (source, target) GROUP BY ALL"""
)
SQL["map_role_filter"] = (
    _PLACED
    + """, pe AS (SELECT source, target, n_sentences FROM ed WHERE drop_reason = '' AND n_papers >= 2 AND NOT self_loop),
both_roles AS (SELECT source AS node_id FROM pe INTERSECT SELECT target FROM pe)
SELECT source, target FROM pe WHERE source IN (FROM both_roles) AND target IN (FROM both_roles)"""
)
SQL["map_near_two"] = (
    _PLACED
    + """, sm AS (SELECT node_id FROM nd WHERE regexp_matches(lower(label), '(^|[^a-z0-9])meal')), m1 AS (SELECT node_id FROM sm UNION SELECT b FROM bo JOIN sm ON a = node_id)
SELECT node_id, 'either' AS found FROM (SELECT node_id FROM h1 UNION SELECT node_id FROM m1) UNION ALL SELECT node_id, 'both' FROM (SELECT node_id FROM h1 INTERSECT SELECT node_id FROM m1)"""
)
SQL["map_group_nodes"] = (
    SQL["group_labels"].replace("FROM span_groups", "FROM span_groups WHERE trim(span) <> ''").replace("SELECT f.key, f.central, f.size,", ", lb AS (SELECT f.key,").rstrip()
    + ") SELECT 'g:' || g.key AS node_id, min(lb.name) AS label, count(*) AS n_members FROM g JOIN lb USING (key) GROUP BY g.key"
)
SQL["map_concept_nodes"] = f"""
WITH g AS (SELECT *, CASE WHEN "group" = -1 THEN 's:' || span ELSE 'g:' || "group" END AS key FROM span_groups WHERE trim(span) <> ''),
lab AS (SELECT lower(l) AS query, min(id) AS id, arg_min(leaf, id) AS leaf FROM (SELECT id, leaf, unnest(list_concat([leaf], coalesce(alt, []))) AS l FROM concepts) GROUP BY lower(l)),
b AS (SELECT key, min(id) AS id, arg_min(leaf, id) AS leaf FROM (SELECT key, lower({_sql_tidy('span')}) AS query FROM g) JOIN lab USING (query) GROUP BY key)
SELECT coalesce('c:' || b.id, 'g:' || key) AS node_id, min(coalesce(b.leaf, central, '')) AS label, count(*) AS n_members FROM g LEFT JOIN b USING (key) GROUP BY 1"""
SQL["causal_map_edges"] = _PLACED + "SELECT source, target, n_papers, n_sentences, n_relations, direction, reciprocal, self_loop, drop_reason, 'e' || lpad(CAST(row_number() OVER (ORDER BY first_row) AS VARCHAR), greatest(5, length(CAST(row_number() OVER (ORDER BY first_row) AS VARCHAR))::INT), '0') AS edge_id FROM ed"
SQL["causal_map_nodes"] = _PLACED + "SELECT * FROM nd"
SQL["causal_map_evidence"] = _PLACED + "SELECT row_id, source, target, rel_id FROM pl"
SQL["causal_map_summary"] = _PLACED + "SELECT direction, self_loop, drop_reason, count(*) AS n_edges, sum(n_relations)::BIGINT AS n_relations FROM ed GROUP BY ALL"
SQL["causal_map_neighbours"] = _PLACED + "SELECT node_id FROM h2"
SQL["causal_map_papers"] = """
SELECT doc_id, coalesce(arg_min(doi, row_id) FILTER (WHERE doi <> ''), '') AS doi, coalesce(arg_min(title, row_id) FILTER (WHERE title <> ''), '') AS title FROM relations GROUP BY doc_id"""


# --- papers -----------------------------------------------------------------


@query
def papers_dois(spark, sf):
    """DOIs of the papers, cleaned, with a safe file name and the publisher's address where its prefix has one."""
    d = table(spark, sf, "doi_rows").select("doc_id", "file", T.clean_doi(F.trim(F.coalesce("doi", F.lit("")))).alias("doi")).distinct()
    return D.publisher_urls(d).withColumn("safe", D.safe_name(F.col("doi")))


@query
def papers_summary(spark, sf):
    """Papers by source and status, with totals."""
    return table(spark, sf, "doi_rows").rollup("source", "status").agg(F.count("*").alias("n_rows"), F.count_distinct("doc_id").alias("n_papers"))


@query
def document_references(spark, sf):
    """DOIs cited in document texts and by whom, the paper's own left out; the texts of the tables name none, so some are added to them."""
    own = table(spark, sf, "doi_rows").where("doi <> ''").groupBy("file").agg(F.min(T.clean_doi(F.trim("doi"))).alias("doi"))
    docs = table(spark, sf, "documents").join(own, "file", "left")
    k = F.col("doc_id")
    added = F.concat(F.lit(" See doi:10.90000/Ref."), k % 50, F.lit(", https://doi.org/10.90000/ref."), k % 7, F.lit("/full and (10.90001/x("), k % 3, F.lit(")). Fig: "), F.coalesce("doi", F.lit("none")), F.lit(".g001"))
    r = D.references(docs.select("doc_id", "doi", F.concat(F.coalesce("text", F.lit("")), added).alias("text")))
    return r.withColumn("cited_by", F.array_join("cited_by", " | "))


def _papers(spark: SparkSession, sf: str) -> DataFrame:
    """Papers with a DOI that is told by their one source; a paper whose file is named by its DOI has it in its doc_id, too."""
    d = table(spark, sf, "doi_rows").where("doi <> ''").groupBy("file").agg(F.min(F.struct("doc_id", T.clean_doi(F.trim("doi")).alias("doi"), "source", F.col("page").cast("int").alias("page"))).alias("x")).select("file", "x.*")
    return d.where("source <> ''").withColumn("doc_id", F.when(F.col("source") == "file_name", D.safe_name(F.col("doi"))).otherwise(F.col("doc_id")))


@query
def doi_source_priority(spark, sf):
    """The DOI of each paper and where it comes from; all but the metadata's are printed on the paper's page, too."""
    d = _papers(spark, sf)
    shown = F.when(F.col("source").isin("file_name", "text"), F.concat(F.lit("Printed as DOI: "), F.upper("doi"), F.lit("."))).otherwise("none here")
    pages = d.select("doc_id", "page", shown.alias("markdown"))
    log = d.where("source = 'download_log'").select(F.concat(F.lit("old/folder/"), "file").alias("file"), F.upper("doi").alias("doi"), F.lit(0).alias("line"))
    meta = F.when(F.col("source") == "metadata", F.concat(F.lit("Journal, doi:"), "doi"))
    return D.paper_dois(pages, d.select("doc_id", "file", meta.alias("subject"), F.lit(None).cast("string").alias("keywords")), log).drop("note")


@query
def paper_titles(spark, sf):
    """Titles by the largest font; a paper whose DOI is in its metadata has its title there, too, and none in large letters."""
    d = table(spark, sf, "doi_rows").groupBy("doc_id").agg(F.min(F.struct("source", F.coalesce("title", F.lit("")).alias("title"))).alias("x")).select("doc_id", "x.*")
    large = d.where("source <> 'metadata'").select("doc_id", F.posexplode(F.split("title", " ")).alias("ord", "text")).withColumn("font_size", F.lit(17.96))
    small = d.where("source <> 'metadata'").select("doc_id", F.lit(0).alias("ord"), F.lit("Four words at least").alias("text"), F.lit(10.0).alias("font_size"))
    return D.paper_titles(large.unionByName(small).withColumn("page", F.lit(1)), d.select("doc_id", "title"))


def _answers(spark: SparkSession, sf: str) -> DataFrame:
    """What the services might say of each paper: made up from its DOI, its page and its source."""
    d = _papers(spark, sf).select("doi", "page", "source").dropDuplicates(["doi"])
    x, n = D.safe_name(F.col("doi")), F.col("page").cast("string")
    say = lambda *parts: F.concat(*(F.lit(p) if isinstance(p, str) else p for p in parts))
    work = say('{"best_oa_location":{"license":"', F.when(F.col("page") == 1, "cc-by").otherwise("cc-by-nc"), '","pdf_url":"https://best.org/', x, '.pdf","is_oa":true},"ids":{"pmcid":"https://x.org/PMC', n, '"},"locations":[{"pdf_url":null,"landing_page_url":"https://land.org/', x, '","is_oa":true},{"pdf_url":"https://best.org/', x, '.pdf","landing_page_url":"https://no.org/','","is_oa":false}]}')
    listing = say("<Key>PMC", n, ".2/PMC", n, ".2.pdf</Key><Key>PMC", n, ".10/PMC", n, ".10.pdf</Key><Key>PMC", n, ".10/sup.pdf</Key>")
    epmc = say('{"resultList":{"result":[{"doi":"10.1/other","fullTextUrlList":{"fullTextUrl":[{"documentStyle":"pdf","availability":"Free","url":"https://other.org"}]}},{"doi":"', F.upper("doi"), '","fullTextUrlList":{"fullTextUrl":[{"documentStyle":"html","availability":"Free","url":"https://h.org"},{"documentStyle":"pdf","availability":"Free","url":"https://epmc.org/', x, '"}]}}]}}')
    crossref = say('{"message":{"link":[{"URL":"https://api.wiley.com/', x, '","content-type":"application/pdf"},{"URL":"https://pub.org/', x, '","content-type":"unspecified"},{"URL":"https://pub.org/x.xml","content-type":"text/xml"}],"relation":{"has-preprint":[{"id":"10.31219/osf.io/ab', n, '"}]}}}')
    return d.where("source <> 'text'").select("doi", work.alias("work"), listing.alias("listing"), epmc.alias("europe_pmc"), say('{"oa_locations":[{"url_for_pdf":null},{"url_for_pdf":"https://best.org/', x, '.pdf"}]}').alias("unpaywall"), say('{"openAccessPdf":{"url":"https://s2.org/', x, '"}}').alias("semantic_scholar"), crossref.alias("crossref"))


@query
def download_candidates(spark, sf):
    """All addresses of each paper by source, each once."""
    from claimloom.operators import download as N

    return N.candidate_urls(_answers(spark, sf))


@query
def licence_filter(spark, sf):
    """The plan of a run that takes one licence and finds the papers of the download log in its folder."""
    from claimloom.operators import download as N

    d = _papers(spark, sf)
    wanted = D.doi_list(d.select(F.upper("doi").alias("doi"), F.xxhash64("file").alias("ord")))
    there = d.where("source = 'download_log'").select(F.concat(D.safe_name(F.col("doi")), F.lit(".pdf")).alias("file"))
    return N.plan(wanted, there, _answers(spark, sf).select("doi", "work"), ["cc-by"]).select("doi", "status", "licence", "file")


@query
def download_log_upsert(spark, sf):
    """The log of a first run with the rows of a second, which asked for the papers told by their metadata again."""
    d = _papers(spark, sf).groupBy("doi").agg(F.min("source").alias("source"))
    rows = global_rank(d, "doi", "line")
    old = rows.where("source <> 'text'").select("doi", F.lit("not_found").alias("status"), "line")
    new = rows.where("source in ('metadata', 'text')").select("doi", F.lit("downloaded").alias("status"), "line")
    return D.upsert_log(old, new)


SQL["papers_dois"] = r"""
WITH d AS (SELECT doc_id, file, rtrim(trim(coalesce(doi, '')), '.,;:/') AS d FROM doi_rows),
c AS (SELECT DISTINCT doc_id, file, lower(regexp_replace(CASE WHEN len(d) - len(replace(d, ')', '')) > len(d) - len(replace(d, '(', '')) THEN rtrim(d, ')') ELSE d END, '(?i)/(?:full|abstract|pdf|epdf|fulltext|html)$', '')) AS doi FROM d),
p AS (SELECT *, CASE WHEN split_part(doi, '/', 1) IN ('10.1007', '10.1057', '10.1186', '10.3758') THEN 'Springer' WHEN split_part(doi, '/', 1) = '10.3389' THEN 'Frontiers' END AS publisher FROM c)
SELECT doc_id, file, doi, publisher, CASE publisher WHEN 'Springer' THEN 'https://link.springer.com/content/pdf/' || doi || '.pdf' WHEN 'Frontiers' THEN 'https://www.frontiersin.org/articles/' || doi || '/pdf' END AS url,
regexp_replace(doi, '[^a-z0-9_-]', '_', 'g') AS safe FROM p"""
_CLEAN = "lower(regexp_replace(CASE WHEN len(d) - len(replace(d, ')', '')) > len(d) - len(replace(d, '(', '')) THEN rtrim(d, ')') ELSE d END, '(?i)/(?:full|abstract|pdf|epdf|fulltext|html)$', ''))"
SQL["document_references"] = rf"""
WITH own AS (SELECT file, min((SELECT {_CLEAN} FROM (SELECT rtrim(trim(doi), '.,;:/') AS d))) AS doi FROM doi_rows WHERE doi <> '' GROUP BY file),
t AS (SELECT doc_id, coalesce(own.doi, '') AS own, coalesce(text, '') || ' See doi:10.90000/Ref.' || doc_id % 50 || ', https://doi.org/10.90000/ref.' || doc_id % 7 || '/full and (10.90001/x(' || doc_id % 3 || ')). Fig: ' || coalesce(own.doi, 'none') || '.g001' AS text FROM documents LEFT JOIN own USING (file)),
f AS (SELECT doc_id, own, rtrim(unnest(regexp_extract_all(text, '(?i)10\.\d{{4,9}}/[-._;()/:a-zA-Z0-9]+')), '.,;:/') AS d FROM t),
c AS (SELECT DISTINCT doc_id, {_CLEAN} AS doi, own FROM f)
SELECT doi, count(*) AS n_seeds, string_agg(doc_id, ' | ' ORDER BY doc_id) AS cited_by FROM c WHERE own = '' OR NOT starts_with(doi, own) GROUP BY doi"""
_SAFE = "regexp_replace(doi, '[^a-z0-9_-]', '_', 'g')"
_PAPERS = rf"""
WITH p0 AS (SELECT file, doc_id, (SELECT {_CLEAN} FROM (SELECT rtrim(trim(doi), '.,;:/') AS d)) AS doi, source, page FROM doi_rows WHERE doi <> ''),
p1 AS (SELECT file, min(struct_pack(doc_id := doc_id, doi := doi, source := source, page := page)) AS x FROM p0 GROUP BY file),
p2 AS (SELECT file, x.doc_id, x.doi, x.source, x.page FROM p1 WHERE x.source <> ''),
p AS (SELECT * REPLACE (CASE WHEN source = 'file_name' THEN {_SAFE} ELSE doc_id END AS doc_id) FROM p2)
"""
SQL["doi_source_priority"] = _PAPERS + """SELECT doc_id, file, doi, source, CASE WHEN source IN ('file_name', 'text') AND page BETWEEN 1 AND 2 THEN page ELSE 0 END AS page, 'found' AS status FROM p
  WHERE source IN ('metadata', 'download_log') OR page BETWEEN 1 AND 2
  UNION ALL SELECT doc_id, file, '', '', 0, 'not_found' FROM p WHERE NOT (source IN ('metadata', 'download_log') OR page BETWEEN 1 AND 2)"""
SQL["paper_titles"] = r"""
WITH d AS (SELECT doc_id, min(struct_pack(source := source, title := coalesce(title, ''))) AS x FROM doi_rows GROUP BY doc_id),
t AS (SELECT doc_id, x.source, regexp_replace(trim(regexp_replace(x.title, '\s+', ' ', 'g')), '([\p{L}\p{N}_])- ([\p{L}\p{N}_])', '-', 'g') AS title FROM d)
SELECT doc_id, CASE WHEN len(string_split(title, ' ')) >= 4 THEN title WHEN source <> 'metadata' THEN 'Four words at least' ELSE '' END AS title FROM t"""
_ANSWERED = _PAPERS + f", w AS (SELECT DISTINCT ON (doi) doi, page, {_SAFE} AS x FROM p WHERE source <> 'text')"
SQL["download_candidates"] = (
    _ANSWERED
    + """, c AS (SELECT doi, 'openalex' AS source, 0 AS rank, 'https://best.org/' || x || '.pdf' AS url FROM w UNION ALL SELECT doi, 'openalex', 1, 'https://land.org/' || x FROM w
  UNION ALL SELECT doi, 'publisher', 1000, CASE split_part(doi, '/', 1) WHEN '10.3389' THEN 'https://www.frontiersin.org/articles/' || doi || '/pdf' ELSE 'https://link.springer.com/content/pdf/' || doi || '.pdf' END FROM w WHERE split_part(doi, '/', 1) IN ('10.1007', '10.1057', '10.1186', '10.3758', '10.3389')
  UNION ALL SELECT doi, 'pmc', 2000, 'https://pmc-oa-opendata.s3.amazonaws.com/PMC' || page || '.10/PMC' || page || '.10.pdf' FROM w UNION ALL SELECT doi, 'europe_pmc', 3000, 'https://epmc.org/' || x FROM w
  UNION ALL SELECT doi, 'semantic_scholar', 5000, 'https://s2.org/' || x FROM w UNION ALL SELECT doi, 'crossref', 6000, 'https://pub.org/' || x FROM w
  UNION ALL SELECT doi, 'preprint', 7000, 'https://osf.io/ab' || page || '/download' FROM w UNION ALL SELECT doi, 'landing_page', 8000, 'https://doi.org/' || doi FROM w)
SELECT doi, source, CAST(rank AS INTEGER) AS rank, url FROM c"""
)
SQL["licence_filter"] = (
    _ANSWERED
    + f""", o AS (SELECT doi, bool_or(source = 'download_log') AS there FROM p GROUP BY doi),
s AS (SELECT o.doi, {_SAFE.replace('doi', 'o.doi')} || '.pdf' AS file, there, CASE WHEN w.doi IS NULL THEN 'unknown' WHEN page = 1 THEN 'cc-by' ELSE 'cc-by-nc' END AS lic FROM o LEFT JOIN w USING (doi))
SELECT doi, CASE WHEN there THEN 'already_there' WHEN lic <> 'cc-by' THEN 'skipped_licence' ELSE 'to_fetch' END AS status, CASE WHEN there THEN '' ELSE lic END AS licence, CASE WHEN NOT there AND lic <> 'cc-by' THEN '' ELSE file END AS file FROM s"""
)
SQL["download_log_upsert"] = (
    _PAPERS
    + """, n AS (SELECT doi, min(source) AS source FROM p GROUP BY doi),
l AS (SELECT doi, source, row_number() OVER (ORDER BY doi) AS line FROM n),
e AS (SELECT max(line) + 1 AS e FROM l WHERE source <> 'text')
SELECT doi, CASE WHEN source IN ('metadata', 'text') THEN 'downloaded' ELSE 'not_found' END AS status, CASE WHEN source = 'text' THEN line + coalesce(e, 0) ELSE line END AS line FROM l, e"""
)
SQL["papers_summary"] = "SELECT source, status, count(*) AS n_rows, count(DISTINCT doc_id) AS n_papers FROM doi_rows GROUP BY ROLLUP (source, status)"


# --- concepts ---------------------------------------------------------------


@query
def concept_texts(spark, sf):
    return table(spark, sf, "concepts").select("id", *(T.strategy_text(s).alias(s) for s in T.STRATEGIES))


SQL["concept_texts"] = """
WITH c AS (SELECT id, lower(leaf) AS leaf, lower(path) AS path, array_to_string(list_transform(parents, lambda x: lower(x)), ', ') AS par, coalesce(len(parents), 0) = 0 AS alone,
  CASE WHEN len(alt) > 0 THEN array_to_string(list_transform(alt, lambda x: lower(x)), '; ') END AS al, CASE WHEN coalesce(note, '') <> '' THEN rtrim(lower(note), '.') END AS nt FROM concepts)
SELECT id, leaf, path, leaf || ': ' || path AS anchor, CASE WHEN alone THEN leaf ELSE leaf || ' is related to ' || par END AS context,
CASE WHEN alone THEN leaf ELSE leaf || ' (' || par || ')' END AS bracket, concat_ws('. ', leaf, al, nt, path) AS enriched FROM c"""


# --- vectors ----------------------------------------------------------------

#: The test vectors are spread widely, so that few pairs come nearer than this.
THRESHOLD = 0.45


def _vectors(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "embeddings").select("vec_id", "embedding", "label")


@query
def vector_pairs(spark, sf):
    return V.similar_pairs(_vectors(spark, sf), THRESHOLD).select("a", "b")


@query
def vector_groups_single(spark, sf):
    return V.pairwise_grouping(_vectors(spark, sf), THRESHOLD, "single")


@query
def vector_groups_average(spark, sf):
    return V.pairwise_grouping(_vectors(spark, sf), THRESHOLD, "average")


@query
def vector_groups_complete(spark, sf):
    return V.pairwise_grouping(_vectors(spark, sf), THRESHOLD, "complete")


@query
def vector_groups_density(spark, sf):
    return V.density_grouping(_vectors(spark, sf))


@query
def vector_medoids(spark, sf):
    v = _vectors(spark, sf)
    return V.medoids(v.select("vec_id", "embedding"), v.select("vec_id", F.col("label").cast("long").alias("group_id")))


@query
def vector_nearest(spark, sf):
    """The ten nearest vectors of every vector whose id is divisible by 100, against all."""
    v = _vectors(spark, sf)
    return V.nearest(v.where("vec_id % 100 = 0"), v, 10).select("vec_id", "rank", "neighbour")


_DOT = "list_inner_product(CAST(x.embedding AS DOUBLE[]), CAST(y.embedding AS DOUBLE[]))"
_PAIRS = f"pr AS (SELECT x.vec_id AS a, y.vec_id AS b FROM embeddings x JOIN embeddings y ON x.vec_id < y.vec_id WHERE {_DOT} >= {THRESHOLD})"
SQL["vector_pairs"] = f"WITH {_PAIRS} SELECT a, b FROM pr"
SQL["vector_groups_single"] = f"WITH RECURSIVE {_PAIRS}, e AS (SELECT a, b FROM pr UNION SELECT b, a FROM pr), r AS (SELECT vec_id AS v, vec_id AS u FROM embeddings UNION SELECT r.v, e.b FROM r JOIN e ON r.u = e.a) SELECT v AS vec_id, min(u) AS group_id FROM r GROUP BY v"
SQL["vector_medoids"] = f"WITH s AS (SELECT x.label AS g, x.vec_id, sum({_DOT}) AS score FROM embeddings x JOIN embeddings y USING (label) GROUP BY x.label, x.vec_id) SELECT CAST(g AS BIGINT) AS group_id, count(*) AS size, min_by(vec_id, (-round(score, 6), vec_id)) AS central_id FROM s GROUP BY g".replace("USING (label)", "ON x.label = y.label")
SQL["vector_nearest"] = f"SELECT x.vec_id, CAST(row_number() OVER (PARTITION BY x.vec_id ORDER BY round({_DOT}, 9) DESC, y.vec_id) AS INTEGER) AS rank, y.vec_id AS neighbour FROM embeddings x JOIN embeddings y ON x.vec_id <> y.vec_id WHERE x.vec_id % 100 = 0 QUALIFY rank <= 10"


# --- standardisation: vectors in place of texts -----------------------------


def _entry_vectors(spark: SparkSession, sf: str) -> DataFrame:
    """Every vector whose id is divisible by 100 stands for an entry; entries of one label for one concept."""
    e = _vectors(spark, sf).where("vec_id % 100 = 0")
    return e.select(F.col("vec_id").alias("ord"), F.col("label").cast("string").alias("id"), F.lit("").alias("leaf"), F.lit("").alias("path"), "embedding")


@query
def vector_top_matches(spark, sf):
    """The three best concepts of every vector."""
    q = _vectors(spark, sf).select(F.col("vec_id").alias("query"), "embedding")
    return S.match_vectors(q, _entry_vectors(spark, sf), 3).select("query", "rank", "id", "score")


@query
def span_concepts(spark, sf):
    """The best concept of every span by the built-in encoder, where it is near enough."""
    spans = M.collect_spans(table(spark, sf, "relations"))
    entries = table(spark, sf, "concepts").withColumn("ord", F.expr("cast(row_number() over (order by id) as long)"))
    return S.standardize_spans(spans, S.embed(entries.withColumn("_t", T.strategy_text("leaf")), "_t"), top=1, threshold=0.5).select(F.col("query").alias("span"), "id", "score")


def _group_matches(spark: SparkSession, sf: str, rule: str) -> DataFrame:
    v = _vectors(spark, sf).select(F.col("vec_id") % 97, "vec_id", "embedding").toDF("key", "ord", "embedding").withColumn("is_central", F.col("ord") >= 97)
    entries = _entry_vectors(spark, sf).withColumn("id", F.col("ord").cast("string"))
    return S.match_vectors(S.group_vectors(v, rule), entries, 2).select(F.col("query").alias("key"), "rank", "id", "score")


@query
def group_match_mean(spark, sf):
    return _group_matches(spark, sf, "mean_sim")


@query
def group_match_centroid(spark, sf):
    return _group_matches(spark, sf, "centroid")


@query
def group_match_medoid(spark, sf):
    return _group_matches(spark, sf, "medoid")


@query
def group_match_summary(spark, sf):
    q = _vectors(spark, sf).select((F.col("vec_id") % 97).alias("query"))
    m = _group_matches(spark, sf, "mean_sim").withColumnRenamed("key", "query").where("score >= 0.05")
    return S.match_summary(m, q)


SQL["vector_top_matches"] = f"""
WITH s AS (SELECT x.vec_id AS query, CAST(y.label AS VARCHAR) AS id, y.vec_id AS ord, {_DOT} AS score FROM embeddings x JOIN embeddings y ON y.vec_id % 100 = 0),
b AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY query, id ORDER BY round(score, 12) DESC, ord) = 1)
SELECT query, CAST(row_number() OVER (PARTITION BY query ORDER BY round(score, 12) DESC, ord) AS INTEGER) AS rank, id, round(score, 4) + 0.0::DOUBLE AS score FROM b QUALIFY rank <= 3"""
_GROUPS = f"""
WITH s AS (SELECT x.vec_id % 97 AS key, y.vec_id AS ord, avg({_DOT}) AS mean, max(CASE WHEN x.vec_id BETWEEN 97 AND 193 THEN {_DOT} END) AS central FROM embeddings x JOIN embeddings y ON y.vec_id % 100 = 0 GROUP BY ALL),
n AS (SELECT x.vec_id % 97 AS key, sqrt(avg({_DOT})) AS norm FROM embeddings x JOIN embeddings y ON x.vec_id % 97 = y.vec_id % 97 GROUP BY ALL),
r AS (SELECT key, ord, {{score}} AS score FROM s JOIN n USING (key)),
m AS (SELECT key, CAST(row_number() OVER (PARTITION BY key ORDER BY round(score, 12) DESC, ord) AS INTEGER) AS rank, CAST(ord AS VARCHAR) AS id, round(score, 4) + 0.0::DOUBLE AS score FROM r QUALIFY rank <= 2)
"""
for _name, _score in (("mean", "mean"), ("centroid", "mean / norm"), ("medoid", "central")):
    SQL[f"group_match_{_name}"] = _GROUPS.format(score=_score) + "SELECT * FROM m"
SQL["group_match_summary"] = (
    _GROUPS.format(score="mean")
    + """, b AS (SELECT q.key, max(m.score) AS score FROM (SELECT DISTINCT vec_id % 97 AS key FROM embeddings) q LEFT JOIN m ON m.key = q.key AND m.rank = 1 AND m.score >= 0.05 GROUP BY q.key)
SELECT count(*) AS n_queries, count(*) FILTER (WHERE score IS NULL) AS n_unmatched, round(median(score), 4) AS median, min(score) AS least, max(score) AS most FROM b"""
)
