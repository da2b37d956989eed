"""DOIs of papers and of what they cite."""

from __future__ import annotations

import html
import re
from urllib.parse import urljoin

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from claimloom.functions import text as T

SOURCES = ("download_log", "file_name", "metadata", "text")
# DOI prefixes of publishers that serve a PDF under a plain address.
PUBLISHERS = (("10.1007", "Springer"), ("10.1057", "Springer"), ("10.1186", "Springer"), ("10.3758", "Springer"), ("10.3389", "Frontiers"))
TEMPLATES = {"Springer": ("https://link.springer.com/content/pdf/", ".pdf"), "Frontiers": ("https://www.frontiersin.org/articles/", "/pdf")}


def safe_name(doi: Column) -> Column:
    return F.regexp_replace(F.lower(doi), "[^a-z0-9_-]", "_")


def doc_id(path: Column) -> Column:
    """File name without folder and ending."""
    return F.regexp_replace(F.element_at(F.split(path, "/"), -1), r"\.[^.]*$", "")


def page_of_doi(doi: Column, pages: Column) -> Column:
    """Number of the first of ``pages`` (array of structs page, markdown, in order) that shows the DOI; 0 if none does."""
    shown = F.filter(pages, lambda p: F.contains(F.lower(p["markdown"]), doi))
    return F.when(doi == "", 0).otherwise(F.coalesce(F.get(shown, 0)["page"], F.lit(0)))


def paper_dois(pages: DataFrame, files: DataFrame, log: DataFrame | None = None, first_pages: int = 2) -> DataFrame:
    """``(doc_id, file, doi, source, page, status, note)`` of every file of ``(doc_id, file, subject, keywords)``.

    Sources in their order: the download log; a DOI of the first pages (repaired) whose safe name is the file's;
    subject and keywords; the first DOI as printed on the first pages.  ``page`` is the first page that shows
    the DOI, whatever its source.  NULL texts have no DOI; a file listed twice comes out once.
    """
    near = pages.where(F.col("page").between(1, first_pages)).select("doc_id", "page", F.coalesce("markdown", F.lit("")).alias("markdown")).distinct()
    first = near.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("page", "markdown"))).alias("_pages"))  # first_pages pages at most
    f = files.select("doc_id", "file", "subject", "keywords").dropDuplicates(["file"]).join(first, "doc_id", "left")
    known = log_dois(log).withColumnRenamed("doi", "_log") if log is not None else None
    f = f.join(known, "file", "left") if known is not None else f.withColumn("_log", F.lit(None).cast("string"))
    pages_of = F.coalesce("_pages", F.array().cast("array<struct<page:int,markdown:string>>"))
    text = F.array_join(F.transform(pages_of, lambda p: p["markdown"]), "\n")
    named = F.get(F.filter(T.text_dois(text), lambda d: safe_name(d) == F.lower("doc_id")), 0)
    meta = T.clean_doi(F.regexp_extract(F.concat_ws(" ", "subject", "keywords"), T.DOI, 0))
    printed = F.get(F.filter(F.transform(pages_of, lambda p: T.clean_doi(F.regexp_extract(p["markdown"], T.DOI, 0))), lambda d: d != ""), 0)
    parts = [F.nullif(x, F.lit("")) for x in (F.col("_log"), named, meta, printed)]
    f = f.withColumn("doi", F.coalesce(*parts, F.lit(""))).withColumn("source", F.coalesce(*(F.when(x.isNotNull(), F.lit(n)) for x, n in zip(parts, SOURCES, strict=True)), F.lit("")))
    found = F.col("doi") != ""
    note = F.when(found, "").otherwise(F.lit(f"neither log, file name nor metadata has a DOI, nor have pages 1 to {first_pages}"))
    return f.select("doc_id", "file", "doi", "source", page_of_doi(F.col("doi"), pages_of).alias("page"), F.when(found, "found").otherwise("not_found").alias("status"), note.alias("note"))


# A title has so many words, and is no name of a file.
TITLE_WORDS = 4
FILE_NAME = r"(?i)\.(docx?|pdf|tex|indd|rtf)\b|Microsoft Word"


def clean_title(text: Column) -> Column:
    """A title on one line; a word broken at a line end keeps its hyphen."""
    return F.regexp_replace(F.trim(F.regexp_replace(text, r"(?U)\s+", " ")), r"(?U)(\w)- (\w)", "$1-$2")


def _is_title(text: Column) -> Column:
    return F.size(T.words(text)) >= TITLE_WORDS


def paper_titles(items: DataFrame, metadata: DataFrame) -> DataFrame:
    """``(doc_id, title)``: the text in the largest font of page 1 that has enough words, else the metadata's title, else ''.

    ``items`` are ``(doc_id, page, ord, text, font_size)``, ``metadata`` ``(doc_id, title)``.
    """
    first = items.where("page = 1 and trim(text) <> ''").withColumn("_size", F.round("font_size", 1))
    line = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ord", "text"))), lambda x: x["text"]), " ")
    fonts = first.groupBy("doc_id", "_size").agg(clean_title(line).alias("_title")).where(_is_title(F.col("_title")))
    largest = fonts.groupBy("doc_id").agg(F.max_by("_title", "_size").alias("_font"))
    given = clean_title(F.coalesce("title", F.lit("")))
    named = metadata.select("doc_id", F.when(_is_title(given) & ~given.rlike(FILE_NAME), given).alias("_meta"))
    return named.join(largest, "doc_id", "full").select("doc_id", F.coalesce("_font", "_meta", F.lit("")).alias("title"))


def references(papers: DataFrame) -> DataFrame:
    """``(doi, n_seeds, cited_by)`` of ``(doc_id, doi, text)``: DOIs cited in the texts and by which papers; most cited first.

    A paper's own DOI and its parts (figures, tables) don't count.  ``cited_by`` names the papers in their order.
    """
    own = F.coalesce("doi", F.lit(""))
    cited = papers.select("doc_id", own.alias("own"), F.explode(T.text_dois(F.coalesce("text", F.lit("")))).alias("doi"))
    cited = cited.where((F.col("own") == "") | ~F.col("doi").startswith(F.col("own"))).select("doi", "doc_id").distinct()
    return cited.groupBy("doi").agg(F.count("*").alias("n_seeds"), F.array_sort(F.collect_list("doc_id")).alias("cited_by")).orderBy(F.desc("n_seeds"), "doi")


def publisher_urls(rows: DataFrame) -> DataFrame:
    """Adds ``publisher`` and ``url`` to rows with a DOI whose prefix has a direct address; others get NULL."""
    prefix = F.substring_index(F.lower("doi"), "/", 1)
    name = F.coalesce(*(F.when(prefix == p, F.lit(n)) for p, n in PUBLISHERS))
    url = F.coalesce(*(F.when(name == n, F.concat(F.lit(a), F.lower("doi"), F.lit(b))) for n, (a, b) in TEMPLATES.items()))
    return rows.withColumn("publisher", name).withColumn("url", url)


def upsert_log(old: DataFrame, new: DataFrame) -> DataFrame:
    """Log rows ``(doi, ..., line)`` with those of ``new`` in place of older ones for the same DOI.

    A DOI keeps the place of its first row; new DOIs follow in their order.  Of several rows of one DOI the last counts.
    """
    columns = [c for c in new.columns if c != "line"]
    last = old.agg(F.max("line")).first()[0]
    end = F.lit(0 if last is None else last + 1)
    both = old.select(*columns, F.col("line").cast("long").alias("line")).unionByName(new.select(*columns, (F.col("line") + end).cast("long").alias("line")))
    kept = both.groupBy("doi").agg(F.min("line").alias("_first"), F.max_by(F.struct(*[c for c in columns if c != "doi"]), "line").alias("_row"))
    return kept.select("doi", *(F.col(f"_row.{c}").alias(c) for c in columns if c != "doi"), F.col("_first").alias("line"))


def doi_list(rows: DataFrame, doi: str = "doi") -> DataFrame:
    """``(doi, ord)``: DOIs of rows ``(doi, ord)`` in lower case, each once, in the order they are first named."""
    d = rows.select(F.lower(F.trim(F.col(doi))).alias("doi"), "ord").where("doi <> ''")
    return d.groupBy("doi").agg(F.min("ord").alias("ord"))


# --- addresses of open copies: each finder reads one service's answer ---------------------------

# Addresses of the services, content types and hosts.
SERVICES = {
    "openalex": "https://api.openalex.org/works/doi:{doi}",
    "europe_pmc": "https://www.ebi.ac.uk/europepmc/webservices/rest/search?query=DOI:%22{doi}%22&resultType=core&format=json",
    "unpaywall": "https://api.unpaywall.org/v2/{doi}?email={email}",
    "semantic_scholar": "https://api.semanticscholar.org/graph/v1/paper/DOI:{doi}?fields=openAccessPdf",
    "crossref": "https://api.crossref.org/works/{doi}",
}
PMC_FILES = "https://pmc-oa-opendata.s3.amazonaws.com/"
OSF_FILE = ("https://osf.io/", "/download")
RESOLVER = "https://doi.org/"
PDF_TYPES = ("application/pdf", "unspecified")
KEY_HOSTS = ("api.elsevier.com", "api.wiley.com")
FINDERS = ("openalex", "publisher", "pmc", "europe_pmc", "unpaywall", "semantic_scholar", "crossref", "preprint", "landing_page")


def _urls(urls: Column) -> Column:
    """Addresses that aren't empty, each once, in order."""
    return F.coalesce(F.array_distinct(F.filter(urls, lambda u: F.coalesce(u, F.lit("")) != "")), F.array().cast("array<string>"))


def licence(work: Column) -> Column:
    """Licence of an open-access work given as JSON; unknown where there is no record, none where it names none."""
    got = F.get_json_object(work, "$.best_oa_location.license")
    return F.when(F.coalesce(work, F.lit("")).isin("", "{}"), "unknown").otherwise(F.coalesce(F.nullif(got, F.lit("")), F.lit("none")))


def openalex_urls(work: Column) -> Column:
    """All PDF addresses of a work's locations, the best first, then the landing pages of the open ones."""
    kind = "struct<pdf_url:string,landing_page_url:string,is_oa:boolean>"
    w = F.from_json(work, f"best_oa_location {kind}, locations array<{kind}>")
    every = F.filter(F.concat(F.array(w["best_oa_location"]), F.coalesce(w["locations"], F.array().cast(f"array<{kind}>"))), lambda x: x.isNotNull())
    pages = F.transform(F.filter(every, lambda x: F.coalesce(x["is_oa"], F.lit(False))), lambda x: x["landing_page_url"])
    return _urls(F.concat(F.transform(every, lambda x: x["pdf_url"]), pages))


def pmcid(work: Column, europe_pmc: Column, doi: Column) -> Column:
    """Identifier in the open archive: the work's own, else that of the search result with this very DOI; '' if there is none."""
    own = F.regexp_extract(F.coalesce(F.get_json_object(work, "$.ids.pmcid"), F.lit("")), r"(PMC\d+)/?$", 1)
    same = F.filter(_results(europe_pmc), lambda r: (F.lower(r["doi"]) == F.lower(doi)) & (F.coalesce(r["pmcid"], F.lit("")) != ""))
    return F.coalesce(F.nullif(own, F.lit("")), F.get(same, 0)["pmcid"], F.lit(""))


def _results(body: Column) -> Column:
    link = "struct<documentStyle:string,availability:string,url:string>"
    found = F.from_json(body, f"resultList struct<result:array<struct<doi:string,pmcid:string,fullTextUrlList:struct<fullTextUrl:array<{link}>>>>>")
    return found["resultList"]["result"]


def pmc_urls(listing: Column, identifier: Column) -> Column:
    """Address of the newest version among the files of an article; supplements have other names."""
    files = F.regexp_extract_all(listing, F.lit(r"<Key>(PMC\d+\.\d+/PMC\d+\.\d+)\.pdf</Key>"), F.lit(1))
    own = F.filter(files, lambda k: (F.substring_index(k, "/", 1) == F.substring_index(k, "/", -1)) & (F.substring_index(k, ".", 1) == identifier))
    newest = F.get(F.reverse(F.array_sort(F.transform(own, lambda k: F.struct(F.substring_index(k, ".", -1).cast("int").alias("version"), k.alias("key"))))), 0)["key"]
    return _urls(F.array(F.concat(F.lit(PMC_FILES), newest, F.lit(".pdf"))))


def europe_pmc_urls(body: Column, doi: Column) -> Column:
    """Free PDF addresses of the result with this DOI, or of the first result where none has it."""
    same = F.get(F.filter(_results(body), lambda r: F.lower(r["doi"]) == F.lower(doi)), 0)
    links = F.coalesce(same, F.get(_results(body), 0))["fullTextUrlList"]["fullTextUrl"]
    return _urls(F.transform(F.filter(links, lambda x: (x["documentStyle"] == "pdf") & (x["availability"] == "Free")), lambda x: x["url"]))


def unpaywall_urls(body: Column) -> Column:
    return _urls(F.transform(F.from_json(body, "oa_locations array<struct<url_for_pdf:string>>")["oa_locations"], lambda x: x["url_for_pdf"]))


def semantic_scholar_urls(body: Column) -> Column:
    return _urls(F.array(F.get_json_object(body, "$.openAccessPdf.url")))


def crossref_urls(body: Column) -> Column:
    """Links that may be a PDF, but for those of services that want a key."""
    links = F.from_json(body, "message struct<link:array<struct<URL:string,`content-type`:string>>>")["message"]["link"]
    fine = F.filter(links, lambda x: x["content-type"].isin(*PDF_TYPES) & ~x["URL"].rlike("|".join(h.replace(".", "[.]") for h in KEY_HOSTS)))
    return _urls(F.transform(fine, lambda x: x["URL"]))


def preprint_urls(body: Column) -> Column:
    """Addresses of the preprints that a record names on the one server with plain addresses."""
    named = F.from_json(body, "message struct<relation:struct<`has-preprint`:array<struct<id:string>>>>")["message"]["relation"]["has-preprint"]
    ids = F.filter(F.transform(named, lambda x: F.regexp_extract(x["id"], r"(?i)osf\.io/([a-z0-9]+)", 1)), lambda i: i != "")
    return _urls(F.transform(ids, lambda i: F.concat(F.lit(OSF_FILE[0]), i, F.lit(OSF_FILE[1]))))


def quoted(doi: Column) -> Column:
    """A DOI within an address: everything but letters, digits, ``_.-~`` and the slash is encoded."""
    return F.replace(F.replace(F.replace(F.url_encode(doi), F.lit("%2F"), F.lit("/")), F.lit("+"), F.lit("%20")), F.lit("*"), F.lit("%2A"))


def landing_page_urls(doi: Column) -> Column:
    return _urls(F.array(F.concat(F.lit(RESOLVER), quoted(doi))))


#: How much of a page is read for its meta tags.
HEAD_BYTES = 500_000


def page_link(page: str, address: str) -> str:
    """Absolute address that a page's ``citation_pdf_url`` meta tag names, in whatever order its attributes stand; '' if there is none."""
    for tag in re.findall(r"<meta\s[^>]*>", page[:HEAD_BYTES], re.IGNORECASE):
        fields = {k.lower(): v for k, _, v in re.findall(r"""([\w-]+)\s*=\s*(["'])(.*?)\2""", tag, re.DOTALL)}
        if fields.get("name", "").lower() == "citation_pdf_url" and fields.get("content"):
            return urljoin(address, html.unescape(fields["content"]))
    return ""


@F.pandas_udf(StringType())
def _page_links(page: pd.Series, address: pd.Series) -> pd.Series:
    return pd.Series([page_link(p or "", a or "") for p, a in zip(page, address, strict=True)], dtype="object")


def page_pdf_link(page: Column, address: Column) -> Column:
    """:func:`page_link` of a column; pages that don't name such a tag at all stay in the JVM."""
    return F.when(F.contains(F.lower(page), F.lit("citation_pdf_url")), _page_links(page, address)).otherwise("")


def site(address: Column) -> Column:
    """Scheme and host of an address."""
    return F.concat_ws("://", F.parse_url(address, F.lit("PROTOCOL")), F.parse_url(address, F.lit("HOST")))


def is_pdf(body: Column) -> Column:
    """Whether a file starts like a PDF within its first 1024 bytes."""
    return F.position(F.lit(b"%PDF-"), F.substring(body, 1, 1024)) > 0


def log_dois(log: DataFrame) -> DataFrame:
    """``(file, doi)`` of a download log ``(file, doi, line)``: base names, the last row of a file wins."""
    r = log.where("coalesce(file, '') <> '' and coalesce(doi, '') <> ''").select(F.element_at(F.split("file", "/"), -1).alias("file"), F.lower(F.trim("doi")).alias("doi"), "line")
    return r.groupBy("file").agg(F.max_by("doi", "line").alias("doi"))
