"""Folders of papers: page caches, file checks, thesauri."""

from __future__ import annotations

import glob
import os
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from claimloom.operators.dois import doi_list, is_pdf
from claimloom.operators.ranks import global_rank
from claimloom.scratch import Scratch


def page_caches(spark: SparkSession, folder: str) -> DataFrame:
    """``(doc_id, file, page, markdown)`` of ``*.pages.json`` files, which may stand in for their PDFs.

    A cache that isn't valid gives no rows here, and :func:`all_pages` reads its PDF again.
    """
    raw = spark.read.text(folder, wholetext=True, pathGlobFilter="*.pages.json").withColumn("path", F.input_file_name())
    name = F.regexp_replace(F.element_at(F.split(F.url_decode("path"), "/"), -1), r"\.pages\.json$", "")
    got = raw.select(F.regexp_replace(name, r"(?i)\.pdf$", "").alias("doc_id"), name.alias("file"), F.explode(F.from_json("value", "map<string,string>")).alias("p", "markdown"))
    return got.select("doc_id", "file", F.expr("try_cast(p as int)").alias("page"), "markdown").where("page is not null")


def list_papers(spark: SparkSession, folder: str) -> DataFrame:
    """``(file, status)`` of a folder's visible files, by name: ``pdf``, ``unreadable_pdf`` or ``not_pdf``; page caches are left out."""
    f = spark.read.format("binaryFile").option("recursiveFileLookup", "false").load(folder)
    name = F.element_at(F.split("path", "/"), -1)
    f = f.select(name.alias("file"), F.substring("content", 1, 1024).alias("content")).where(~F.col("file").startswith(".") & ~F.col("file").endswith(".pages.json"))
    named = F.lower("file").endswith(".pdf")
    return f.select("file", F.when(~named, "not_pdf").when(is_pdf(F.col("content")), "pdf").otherwise("unreadable_pdf").alias("status")).orderBy("file")


def file_problems(papers: DataFrame) -> DataFrame:
    """Rows of the drop log for files that hold no paper: other files first, then PDFs that can't be read."""
    bad = papers.where("status <> 'pdf'").select(F.regexp_replace("file", r"\.[^.]*$", "").alias("doc_id"), F.lit(0).alias("page"), F.lit("").alias("section"), F.col("status").alias("drop_reason"), F.col("file").alias("text"))
    return bad.orderBy(F.col("drop_reason") != "not_pdf", "text")


def source_paths(source: str) -> str:
    """The path to read for a source: a PDF, a PDF whose page cache alone is there, or a folder with either; anything else is an error."""
    if os.path.isdir(source):
        if any(n.lower().endswith(".pdf") or n.endswith(".pages.json") for n in os.listdir(source) if not n.startswith(".")):
            return source
        raise ValueError(f"the folder {source} has neither PDFs nor page caches")
    if os.path.isfile(source) and source.lower().endswith(".pdf"):
        return source
    if os.path.isfile(source + ".pages.json"):
        return source + ".pages.json"
    raise ValueError(f"{source} is neither a PDF nor a folder")


def read_pages(spark: SparkSession, folder: str, reader: Callable[[bytes], dict[int, str]], but: DataFrame | None = None) -> DataFrame:
    """``(doc_id, page, markdown, note)`` of PDFs through an injected reader, all but those of ``but`` ``(doc_id)``.

    A file that fails, or whose pages are all blank, is one row with page 0 and a note.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for doc, content in zip(b["doc_id"], b["content"], strict=True):
                try:
                    pages = reader(bytes(content))
                    if not any(t.strip() for t in pages.values()):
                        raise ValueError("no text layer")
                    rows += [(doc, p, t, "") for p, t in sorted(pages.items())]
                except Exception as e:
                    rows.append((doc, 0, "", str(e)))
            yield pd.DataFrame(rows, columns=["doc_id", "page", "markdown", "note"])

    name = F.element_at(F.split("path", "/"), -1)
    pdfs = spark.read.format("binaryFile").option("pathGlobFilter", "*.[pP][dD][fF]").load(folder).select(F.regexp_replace(name, r"\.[^.]*$", "").alias("doc_id"), "content")
    if but is not None:
        pdfs = pdfs.join(but.select("doc_id").distinct(), "doc_id", "left_anti")
    return pdfs.mapInPandas(run, "doc_id string, page int, markdown string, note string")


def all_pages(spark: SparkSession, folder: str, reader: Callable[[bytes], dict[int, str]], table: str | None = None) -> DataFrame:
    """``(doc_id, page, markdown, note)`` of a folder: valid page caches first, then what ``table`` keeps, then PDFs.

    What had to be read is added to ``table`` (a Parquet folder), so that a PDF is read once.
    """
    known = page_caches(spark, folder).select("doc_id", "page", "markdown", F.lit("").alias("note")) if glob.glob(f"{glob.escape(folder)}/*.pages.json") else spark.createDataFrame([], PAGES)
    if table and os.path.isdir(table):
        kept = spark.read.schema(PAGES).parquet(table)
        known = known.unionByName(kept.join(known.select("doc_id").distinct(), "doc_id", "left_anti"))
    if not any(n.lower().endswith(".pdf") for n in os.listdir(folder)):
        return known
    known = Scratch(spark, "pages").cut(known, "known")
    new = Scratch(spark, "pages").cut(read_pages(spark, folder, reader, known), "new")
    if table:
        new.where("page > 0").write.mode("append").parquet(table)
    return known.unionByName(new)


PAGES = "doc_id string, page int, markdown string, note string"


def read_text(spark: SparkSession, path: str) -> DataFrame:
    """``(value)``: a text file as one row, unpacked if it is gzipped."""
    return spark.read.text(path, wholetext=True)


def read_log(spark: SparkSession, path: str) -> DataFrame:
    """A download log with ``line``, its rows' place in the file."""
    rows = spark.read.option("header", True).option("multiLine", True).csv(path)
    return rows.withColumn("line", F.monotonically_increasing_id()).fillna("")


def read_dois(spark: SparkSession, dois: DataFrame | list[str] | str) -> DataFrame:
    """``(doi, ord)``: DOIs of rows with a column ``doi``, of a list, or of a CSV file with that column."""
    if isinstance(dois, str):
        dois = read_log(spark, dois)
    elif isinstance(dois, list):
        dois = spark.createDataFrame([(d,) for d in dois], "doi string")
    return doi_list(dois.select("doi").withColumn("ord", F.monotonically_increasing_id()))


SKOS_SCHEMA = (
    "`_rdf:about` string, `rdf:type` array<struct<_VALUE:string,`_rdf:resource`:string>>, `skos:prefLabel` array<struct<_VALUE:string,`_xml:lang`:string>>, `skos:altLabel` array<struct<_VALUE:string,`_xml:lang`:string>>, "
    "`skos:scopeNote` array<struct<_VALUE:string,`_xml:lang`:string>>, `skos:definition` array<struct<_VALUE:string,`_xml:lang`:string>>, `skos:broader` array<struct<_VALUE:string,`_rdf:resource`:string>>, "
    "`skos:narrower` array<struct<_VALUE:string,`_rdf:resource`:string>>, `skos:topConceptOf` array<struct<_VALUE:string,`_rdf:resource`:string>>"
)


def skos_concepts(spark: SparkSession, path: str) -> DataFrame:
    """``(uri, label, alt, note, broader, is_leaf, is_top)`` of the concepts with an English label in an RDF file."""
    x = spark.read.format("xml").option("rowTag", "rdf:Description").schema(SKOS_SCHEMA).load(path)

    def english(c: str):
        return F.transform(F.filter(F.coalesce(F.col(f"`skos:{c}`"), F.array()), lambda v: v["_xml:lang"] == "en"), lambda v: v["_VALUE"])

    concept = F.exists(F.col("`rdf:type`"), lambda v: v["_rdf:resource"].endswith("skos/core#Concept"))
    label = F.get(english("prefLabel"), 0)
    broader = F.transform(F.coalesce(F.col("`skos:broader`"), F.array()), lambda v: v["_rdf:resource"])
    note = F.coalesce(F.get(english("scopeNote"), 0), F.get(english("definition"), 0), F.lit(""))
    empty = lambda c: F.coalesce(F.size(F.col(f"`skos:{c}`")), F.lit(0)) <= 0
    return x.where(concept & label.isNotNull()).select(F.col("`_rdf:about`").alias("uri"), label.alias("label"), english("altLabel").alias("alt"), note.alias("note"), broader.alias("broader"), empty("narrower").alias("is_leaf"), (~empty("topConceptOf")).alias("is_top"))


def taxonomy_entries(concepts: DataFrame, leaves_only: bool = True, most_levels: int = 40) -> DataFrame:
    """One entry per path from a root to a concept: ``(id, leaf, path, parents, alt, note)``, parents nearest first.

    A path ends at a top concept, or where every broader concept is unknown or
    already on the path; so cycles end.  Equal paths give one entry, the least id's.
    """
    c = concepts.select("uri", "label", "broader", "is_top")
    edges = c.select(F.col("uri").alias("child"), F.explode("broader").alias("parent")).join(c.select(F.col("uri").alias("parent"), F.col("label").alias("p_label"), F.col("is_top").alias("p_top")), "parent").distinct()
    front = c.select(F.col("uri").alias("id"), F.array("uri").alias("seen"), F.array("label").alias("labels"), F.col("uri").alias("at"), F.col("is_top").alias("top"))
    done = None
    for _ in range(most_levels):
        ends = front.where("top")
        j = front.where("not top").join(edges, F.col("at") == F.col("child"), "left").withColumn("open", F.col("parent").isNotNull() & ~F.array_contains("seen", F.col("parent")))
        stuck = j.groupBy("id", "seen", "labels").agg(F.max("open").alias("any_open")).where("not any_open").select("id", "labels")
        part = ends.select("id", "labels").unionByName(stuck)
        done = part if done is None else done.unionByName(part)
        front = j.where("open").select("id", F.concat("seen", F.array("parent")).alias("seen"), F.concat("labels", F.array("p_label")).alias("labels"), F.col("parent").alias("at"), F.col("p_top").alias("top"))
        if front.isEmpty():
            break
    e = done.join(concepts.select(F.col("uri").alias("id"), "alt", "note", "is_leaf"), "id")
    e = e.where("is_leaf") if leaves_only else e
    e = e.select("id", F.col("labels")[0].alias("leaf"), F.array_join(F.reverse("labels"), " > ").alias("path"), F.slice("labels", 2, F.size("labels")).alias("parents"), "alt", "note")
    return e.groupBy("path").agg(F.min(F.struct("id", "leaf", "parents", "alt", "note")).alias("e")).select("e.id", "e.leaf", "path", "e.parents", "e.alt", "e.note")


#: Thesauri by name: a function from the session to the concepts of :func:`skos_concepts`.
THESAURI: dict[str, Callable[[SparkSession], DataFrame]] = {}


def load_taxonomy(spark: SparkSession, name: str, leaves_only: bool = True) -> DataFrame:
    """Entries ``(ord, id, leaf, path, parents, alt, note)`` of a registered thesaurus, or of an RDF file, gzipped or not.

    They are worked out once a session: the table they are cut to is used again.
    """
    key = (spark.sparkContext.applicationId, name, leaves_only)
    if key not in _loaded:
        if name not in THESAURI and not os.path.isfile(name):
            raise ValueError(f"{name!r} is neither a thesaurus ({sorted(THESAURI)}) nor a file")
        concepts = THESAURI[name](spark) if name in THESAURI else skos_concepts(spark, name)
        cut = Scratch(spark, "thesaurus").cut(taxonomy_entries(concepts, leaves_only), "entries")
        _loaded[key] = global_rank(cut, "path", "ord", first=0)
    return _loaded[key]


_loaded: dict[tuple[str, str, bool], DataFrame] = {}
