"""Relations and the names of their spans to a causal map: nodes, edges, evidence, papers.

Every edge stays, shown or hidden with its reason; lists of relation ids are a
table of their own (edge_id, rel_id), so an edge of any size is never one row.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from claimloom.functions import text as T
from claimloom.operators.ranks import global_rank
from claimloom.scratch import Scratch

MIN_SHARE = 0.67
#: A span is hot with at least 1/HOT_SHARE of all ends (and HOT_LEAST of them): there are HOT_SHARE hot spans at most.
HOT_SHARE, HOT_LEAST = 400, 2000


@dataclass(frozen=True)
class CausalMap:
    nodes: DataFrame
    edges: DataFrame
    evidence: DataFrame
    papers: DataFrame
    settings: dict = field(default_factory=dict)


def check_settings(min_papers: int, min_sentences: int, min_share: float) -> None:
    if min_papers < 1 or min_sentences < 1:
        raise ValueError(f"an edge needs one paper and one sentence at least; {min_papers} and {min_sentences} are no limits")
    if not 0.5 < min_share <= 1:
        raise ValueError(f"the share of a dominant direction lies in (0.5, 1], not at {min_share}")


def collect_spans(relations: DataFrame) -> DataFrame:
    """Distinct stripped spans ``(span, ord)`` with the place of their first occurrence: cause before effect, by row_id."""
    sides = relations.select(F.col("row_id"), F.posexplode(F.array(F.trim(F.coalesce("cause", F.lit(""))), F.trim(F.coalesce("effect", F.lit(""))))).alias("side", "span"))
    return sides.where("span <> ''").groupBy("span").agg(F.min(F.col("row_id") * 2 + F.col("side")).alias("ord"))


def concept_names(spans: DataFrame, concepts: DataFrame) -> DataFrame:
    """``(span, node_id, label)``: the concept whose label a span is, or the span itself.

    Spans are compared tidied and in lower case with leaf and alternative
    labels; of several concepts the least id wins.
    """
    labels = concepts.select("id", "leaf", F.explode(F.concat(F.array("leaf"), F.coalesce("alt", F.array().cast("array<string>")))).alias("l"))
    best = labels.select(F.lower("l").alias("query"), "id", "leaf").groupBy("query").agg(F.min(F.struct("id", "leaf")).alias("c"))
    j = spans.withColumn("query", F.lower(T.tidy_span(F.col("span")))).join(best, "query", "left")
    return j.select("span", F.coalesce(F.concat(F.lit("c:"), F.col("c.id")), F.concat(F.lit("s:"), F.col("span"))).alias("node_id"), F.coalesce(F.col("c.leaf"), F.col("span")).alias("label"))


def names_of_groups(labelled: DataFrame) -> DataFrame:
    """``(span, node_id, label)`` of labelled groups ``(span, key, name)``: one node a group."""
    return labelled.select(F.trim("span").alias("span"), F.concat(F.lit("g:"), F.col("key")).alias("node_id"), F.col("name").alias("label"))


def names_of_matched_groups(members: DataFrame, matches: DataFrame) -> DataFrame:
    """``(span, node_id, label)`` of groups ``(span, key, central)`` and their ``matches`` ``(query, rank, id, leaf)``.

    Groups with the same best concept share its node; one without a concept is its own node, under its central span.
    """
    best = matches.where("rank = 1").select(F.col("query").alias("key"), "id", "leaf")
    own = F.concat(F.lit("g:"), F.col("key"))
    return members.join(best, "key", "left").select(F.trim("span").alias("span"), F.coalesce(F.concat(F.lit("c:"), F.col("id")), own).alias("node_id"), F.coalesce("leaf", "central").alias("label"))


def names_of_matched_spans(spans: DataFrame, matches: DataFrame) -> DataFrame:
    """``(span, node_id, label)`` of spans and their matches: the best concept, or the span as its own node."""
    best = matches.where("rank = 1").select(F.col("query").alias("span"), "id", "leaf")
    return spans.select("span").distinct().join(best, "span", "left").select("span", F.coalesce(F.concat(F.lit("c:"), F.col("id")), F.concat(F.lit("s:"), F.col("span"))).alias("node_id"), F.coalesce("leaf", "span").alias("label"))


def missing_spans(relations: DataFrame, names: DataFrame) -> DataFrame:
    """Spans of relations that have no name; a map needs this to be empty."""
    return collect_spans(relations).join(names, "span", "left_anti")


def place(relations: DataFrame, names: DataFrame) -> DataFrame:
    """Relations with both ends named, written once: ``(row_id, rel_id, sent_id, doc_id, page, cause, effect, sentence, source, target)``.

    Relations with an empty span have no node and are left out; a span without a name is an error that names
    some of them.  A span in two groups goes by the greatest node id.  Rows of hot spans, of which there can only be
    few, meet their nodes by a broadcast, so no task gets all rows of one span.
    """
    scratch = Scratch(relations.sparkSession, "placed")
    r = relations.select("row_id", "rel_id", "sent_id", "doc_id", *[c for c in ("page", "sentence") if c in relations.columns], F.trim(F.coalesce("cause", F.lit(""))).alias("cause"), F.trim(F.coalesce("effect", F.lit(""))).alias("effect")).where("cause <> '' and effect <> ''")
    uses = r.select(F.explode(F.array("cause", "effect")).alias("span")).groupBy("span").agg(F.count("*").alias("n"))
    node = names.groupBy("span").agg(F.max("node_id").alias("node"))
    uses = scratch.cut(uses.join(node, "span", "left"), "uses", n=F.coalesce(F.sum("n"), F.lit(0)), lost=F.count_if(F.col("node").isNull()))
    total, lost = scratch.seen["n"], scratch.seen["lost"]
    if lost:
        some = [r["span"] for r in uses.where("node is null").orderBy("span").limit(3).collect()]
        raise ValueError(f"{lost} spans have no name, among them {some}")
    least = max(HOT_LEAST, -(-total // HOT_SHARE))
    hot = F.broadcast(uses.where(F.col("n") >= least).select("span", "node"))
    cold = uses.where(F.col("n") < least).select("span", "node")

    def named(rows: DataFrame, span: str, by: str) -> DataFrame:
        flagged = rows.join(hot.select(F.col("span").alias(span), F.col("node").alias("_hot")), span, "left")
        of_hot = flagged.where("_hot is not null").withColumnRenamed("_hot", by)
        return of_hot.unionByName(flagged.where("_hot is null").drop("_hot").join(cold.select(F.col("span").alias(span), F.col("node").alias(by)), span))

    return scratch.cut(named(named(r, "cause", "source"), "effect", "target"), "placed")


def build_edges(placed: DataFrame, min_papers: int = 1, min_sentences: int = 2, min_share: float = MIN_SHARE) -> DataFrame:
    """One row per (source, target) of :func:`place`: counts, direction of two-way pairs, reason if hidden.

    Directions compare paper counts before any edge is hidden.
    """
    check_settings(min_papers, min_sentences, min_share)
    r, scratch = placed, Scratch(placed.sparkSession, "edges")
    sent = F.coalesce("sent_id", "rel_id")
    # first by sentence and paper, so that no distinct set of a large edge sits in one task
    by = r.groupBy("source", "target", sent.alias("_s"), "doc_id").agg(F.count("*").alias("n"), F.min("row_id").alias("first"))
    by = scratch.cut(by, "by")
    n_sent = by.groupBy("source", "target", "_s").agg(F.sum("n").alias("n"), F.min("first").alias("first")).groupBy("source", "target").agg(F.sum("n").alias("n_relations"), F.count("_s").alias("n_sentences"), F.min("first").alias("first_row"))
    n_doc = by.groupBy("source", "target", "doc_id").agg(F.lit(1).alias("one")).groupBy("source", "target").agg(F.count("doc_id").alias("n_papers"))
    e = scratch.cut(n_sent.join(n_doc, ["source", "target"]), "edges")
    scratch.drop(by)
    back = e.select(F.col("target").alias("source"), F.col("source").alias("target"), F.col("n_papers").alias("_back"))
    e = e.join(back, ["source", "target"], "left").withColumn("self_loop", F.col("source") == F.col("target"))
    two = F.col("_back").isNotNull() & ~F.col("self_loop")
    share = F.greatest("n_papers", "_back") / (F.col("n_papers") + F.col("_back"))
    direction = F.when(~two, "one-way").when(share < min_share, "contested").when(F.col("n_papers") > F.col("_back"), "dominant").otherwise("minority")
    reason = F.when(F.col("n_papers") < min_papers, "below_min_papers").when(F.col("n_sentences") < min_sentences, "below_min_sentences").otherwise("")
    return e.select("source", "target", "n_papers", "n_sentences", "n_relations", "first_row", direction.alias("direction"), two.alias("reciprocal"), "self_loop", reason.alias("drop_reason"))


def number_edges(edges: DataFrame) -> DataFrame:
    """Adds ``edge_id`` in first-seen order."""
    return global_rank(edges, "first_row", "_n").withColumn("edge_id", F.format_string("e%05d", "_n")).drop("_n")


def edge_sentences(placed: DataFrame) -> DataFrame:
    """``(source, target, sent_id, doc_id, n_relations, pairs)``: the evidence of each edge by sentence, with its pairs in order."""
    sent = F.coalesce("sent_id", "rel_id").alias("sent_id")
    pairs = F.array_sort(F.collect_list(F.struct("row_id", F.concat_ws(" → ", "cause", "effect").alias("pair"))))
    return placed.groupBy("source", "target", sent, "doc_id").agg(F.count("*").alias("n_relations"), F.array_join(F.array_distinct(F.transform(pairs, lambda x: x["pair"])), "; ").alias("pairs"))


def role_of(as_cause, as_effect):
    return F.when((as_cause == 0) & (as_effect == 0), "").when(as_effect == 0, "cause only").when(as_cause == 0, "effect only").otherwise("cause and effect")


def node_roles(edges: DataFrame) -> DataFrame:
    """``(node_id, as_cause, as_effect, role)`` of the nodes that these edges touch; a loop counts on both sides."""
    ends = edges.select(F.explode(F.array(F.struct(F.col("source").alias("node_id"), F.col("n_sentences").alias("c"), F.lit(0).cast("long").alias("e")), F.struct(F.col("target").alias("node_id"), F.lit(0).cast("long").alias("c"), F.col("n_sentences").alias("e")))).alias("x")).select("x.*")
    counts = ends.groupBy("node_id").agg(F.sum("c").alias("as_cause"), F.sum("e").alias("as_effect"))
    return counts.withColumn("role", role_of(F.col("as_cause"), F.col("as_effect")))


def passing_edges(edges: DataFrame, evidence: DataFrame | None = None, min_papers: int = 1, min_sentences: int = 1, self_loops: bool = True, reciprocal_only: bool = False, paper: str | None = None, roles: list[str] | None = None) -> DataFrame:
    """Shown edges that pass the filters of a reader.

    ``paper`` keeps the edges that paper speaks for (``evidence`` is needed).  ``roles`` come last: they are those
    of the edges left by the other filters, and an edge that touches a node of another role goes.
    """
    e = edges.where("drop_reason = ''").where((F.col("n_papers") >= min_papers) & (F.col("n_sentences") >= min_sentences))
    e = e if self_loops else e.where("not self_loop")
    e = e.where("reciprocal") if reciprocal_only else e
    if paper is not None:
        e = e.join(evidence.where(F.col("doc_id") == paper).select("source", "target").distinct(), ["source", "target"], "left_semi")
    if roles is None:
        return e
    fine = node_roles(e).where(F.col("role").isin(roles)).select("node_id")
    return e.join(fine.withColumnRenamed("node_id", "source"), "source", "left_semi").join(fine.withColumnRenamed("node_id", "target"), "target", "left_semi").select(*e.columns)


def count_nodes(names: DataFrame, edges: DataFrame, evidence: DataFrame) -> DataFrame:
    """Nodes with their counts and role in the shown edges."""
    shown = edges.where("drop_reason = ''").select("source", "target", "n_sentences")
    counts = node_roles(shown).drop("role")
    docs = evidence.join(shown.select("source", "target"), ["source", "target"], "left_semi").select(F.explode(F.array("source", "target")).alias("node_id"), "doc_id").distinct().groupBy("node_id").agg(F.count("doc_id").alias("n_papers"))
    nodes = names.groupBy("node_id").agg(F.min("label").alias("label"), F.count("*").alias("n_members"))
    j = nodes.join(counts, "node_id", "left").join(docs, "node_id", "left").fillna(0, ["as_cause", "as_effect", "n_papers"])
    n = F.col("as_cause") + F.col("as_effect")
    role = role_of(F.col("as_cause"), F.col("as_effect"))
    return j.select("node_id", "label", "n_members", "as_cause", "as_effect", n.alias("n_sentences"), "n_papers", role.alias("role"), (n > 0).alias("shown"))


def papers_of(relations: DataFrame) -> DataFrame:
    """Each paper's first DOI and title that aren't empty."""
    doi, title = F.when(F.col("doi") != "", F.col("doi")), F.when(F.col("title") != "", F.col("title"))
    first = lambda c: F.coalesce(F.min(F.when(c.isNotNull(), F.struct("row_id", c.alias("v"))))["v"], F.lit(""))
    return relations.groupBy("doc_id").agg(first(doi).alias("doi"), first(title).alias("title"))


def causal_map(relations: DataFrame, names: DataFrame, min_papers: int = 1, min_sentences: int = 2, min_share: float = MIN_SHARE) -> CausalMap:
    check_settings(min_papers, min_sentences, min_share)
    placed = place(relations, names)
    edges = build_edges(placed, min_papers, min_sentences, min_share)
    return CausalMap(count_nodes(names, edges, placed), edges, placed, papers_of(relations), {"min_papers": min_papers, "min_sentences": min_sentences, "min_share": min_share})


def edge_rows(edges: DataFrame, nodes: DataFrame, evidence: DataFrame) -> DataFrame:
    """Numbered edges as rows of a file: with the labels of both ends, and papers and relations as joined lists.

    An edge of very many relations makes a long row; as a table, they are the evidence.
    """
    label = nodes.select("node_id", "label")
    doc = evidence.groupBy("source", "target", "doc_id").agg(F.min("row_id").alias("at")).groupBy("source", "target").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", "doc_id"))), lambda x: x["doc_id"]), " | ").alias("doc_ids"))
    rel = evidence.groupBy("source", "target").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("row_id", "rel_id"))), lambda x: x["rel_id"]), " | ").alias("rel_ids"))
    e = edges.join(doc, ["source", "target"], "left").join(rel, ["source", "target"], "left")
    e = e.join(label.toDF("source", "source_label"), "source", "left").join(label.toDF("target", "target_label"), "target", "left")
    return e.select("edge_id", "source", "source_label", "target", "target_label", "n_papers", "n_sentences", "n_relations", "direction", "reciprocal", "self_loop", "drop_reason", "doc_ids", "rel_ids")


def node_rows(nodes: DataFrame, names: DataFrame, spans: DataFrame) -> DataFrame:
    """Nodes as rows of a file, with their member spans as a joined list, in the order of ``spans`` ``(span, ord)``."""
    m = names.join(spans.select("span", "ord"), "span", "left").groupBy("node_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(F.coalesce("ord", F.lit(1 << 62)).alias("ord"), "span"))), lambda x: x["span"]), " | ").alias("members"))
    return nodes.join(m, "node_id", "left")


def short_label(label, most: int = 40):
    """The part of a label before its keywords, cut to ``most`` characters."""
    head = F.split_part(label, F.lit(" | "), F.lit(1))
    return F.when(F.length(head) > most, F.concat(F.substring(head, 1, most - 1), F.lit("…"))).otherwise(head)


def source_label(papers: DataFrame) -> DataFrame:
    """Papers with ``source``: the DOI, or the title, or the file's name."""
    return papers.withColumn("source", F.coalesce(F.nullif("doi", F.lit("")), F.nullif("title", F.lit("")), "doc_id"))


def neighbourhood(edges: DataFrame, start: DataFrame, hops: int) -> DataFrame:
    """Nodes within ``hops`` undirected steps of the ``start`` nodes over the given edges."""
    both = edges.select("source", "target").unionByName(edges.select(F.col("target").alias("source"), F.col("source").alias("target"))).distinct()
    seen = start.select("node_id").distinct()
    for _ in range(hops):
        seen = seen.unionByName(both.join(seen, both.source == seen.node_id, "left_semi").select(F.col("target").alias("node_id"))).distinct()
    return seen


def near_all(edges: DataFrame, starts: list[DataFrame], hops: int) -> DataFrame:
    """Nodes within ``hops`` steps of every one of several sets of start nodes."""
    found = [neighbourhood(edges, s, hops) for s in starts]
    out = found[0]
    for f in found[1:]:
        out = out.join(f, "node_id", "left_semi")
    return out


def search_nodes(nodes: DataFrame, text: str) -> DataFrame:
    """Nodes whose label has a word that starts with ``text``, case ignored."""
    import re

    return nodes.where(F.lower("label").rlike("(^|[^a-z0-9])" + re.escape(text.lower())))
