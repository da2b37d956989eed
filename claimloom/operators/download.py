"""Open copies of papers, fetched through an injected transport; what is to be fetched is decided in the plan."""

from __future__ import annotations

import os
import time
import urllib.robotparser
from collections.abc import Callable, Iterator
from typing import NamedTuple
from urllib.parse import urlsplit

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from claimloom.operators import dois as D

#: Seconds between two requests of a task to one site.
WAIT = 1.0
REPORT = ("doi", "status", "source", "licence", "file", "note")


class Answer(NamedTuple):
    """What a transport gives for an address: the body, the address it came from in the end, and why there is none."""

    body: bytes
    address: str
    note: str = ""


#: An address to its answer.  It has to be picklable; a network transport is the user's own.
Transport = Callable[[str], Answer]


def check_sources(sources: list[str] | str | None) -> list[str]:
    """Names of finders in the order given; a single name is a list of one, names may be repeated."""
    chosen = list(D.FINDERS) if sources is None else [sources] if isinstance(sources, str) else list(sources)
    if not chosen or set(chosen) - set(D.FINDERS):
        raise ValueError(f"no such sources: {sorted(set(chosen) - set(D.FINDERS))}; there are {D.FINDERS}")
    return chosen


def plan(wanted: DataFrame, there: DataFrame, works: DataFrame, licences: list[str] | None = None) -> DataFrame:
    """``(doi, ord, status, licence, file, work)``: what becomes of each wanted ``(doi, ord)``.

    A DOI whose file is among ``there`` ``(file)`` is not asked for again; then a licence outside ``licences``
    keeps a DOI out, before anything is fetched.  ``works`` are ``(doi, work)`` as JSON; an unknown DOI has none.
    """
    d = wanted.withColumn("file", F.concat(D.safe_name(F.col("doi")), F.lit(".pdf")))
    d = d.join(there.select("file", F.lit(True).alias("_there")).distinct(), "file", "left").join(works, "doi", "left")
    known = D.licence(F.col("work"))
    left_out = F.lit(False) if licences is None else ~known.isin(*licences)
    status = F.when(F.col("_there"), "already_there").when(left_out, "skipped_licence").otherwise("to_fetch")
    return d.select("doi", "ord", status.alias("status"), F.when(F.col("_there"), "").otherwise(known).alias("licence"), F.when(status == "skipped_licence", "").otherwise(F.col("file")).alias("file"), "work")


def candidate_urls(answers: DataFrame, sources: list[str] | str | None = None) -> DataFrame:
    """``(doi, source, rank, url)``: addresses to try for each DOI, source by source, each address once.

    ``answers`` are ``(doi, work, listing, europe_pmc, unpaywall, semantic_scholar, crossref)``: what the services said.
    """
    chosen = check_sources(sources)
    doi = F.col("doi")
    of = {
        "openalex": D.openalex_urls(F.col("work")),
        "publisher": F.array("_direct"),
        "pmc": D.pmc_urls(F.col("listing"), D.pmcid(F.col("work"), F.col("europe_pmc"), doi)),
        "europe_pmc": D.europe_pmc_urls(F.col("europe_pmc"), doi),
        "unpaywall": D.unpaywall_urls(F.col("unpaywall")),
        "semantic_scholar": D.semantic_scholar_urls(F.col("semantic_scholar")),
        "crossref": D.crossref_urls(F.col("crossref")),
        "preprint": D.preprint_urls(F.col("crossref")),
        "landing_page": D.landing_page_urls(doi),
    }
    a = D.publisher_urls(answers).withColumnRenamed("url", "_direct")
    lists = F.array(*(F.struct(F.lit(k).alias("k"), F.lit(s).alias("source"), of[s].alias("urls")) for k, s in enumerate(chosen)))
    rows = a.select("doi", F.explode(lists).alias("x")).select("doi", "x.k", "x.source", F.posexplode("x.urls").alias("pos", "url")).where("url is not null")
    first = rows.groupBy("doi", "url").agg(F.min(F.struct("k", "pos", "source")).alias("m"))
    return first.select("doi", "m.source", (F.col("m.k") * 1000 + F.col("m.pos")).alias("rank"), "url")


class Visits:
    """Addresses asked for by one task: each site's robots file once, and a pause between two requests to one site."""

    def __init__(self, transport: Transport, respect_robots: bool, wait: float):
        self.transport, self.respect, self.wait = transport, respect_robots, wait
        self.rules: dict[str, urllib.robotparser.RobotFileParser] = {}
        self.last: dict[str, float] = {}

    def ask(self, address: str) -> Answer:
        parts = urlsplit(address)
        site = f"{parts.scheme}://{parts.netloc}"
        pause = self.last.get(site, 0.0) + self.wait - time.monotonic()
        if site in self.last and pause > 0:
            time.sleep(pause)
        self.last[site] = time.monotonic()
        return self.transport(address)

    def get(self, address: str) -> Answer:
        parts = urlsplit(address)
        site = f"{parts.scheme}://{parts.netloc}"
        if self.respect:
            if site not in self.rules:
                rules = self.rules[site] = urllib.robotparser.RobotFileParser()
                rules.parse(self.ask(site + "/robots.txt").body.decode("utf-8", "replace").splitlines())
            if not self.rules[site].can_fetch("*", address):
                return Answer(b"", address, "robots.txt forbids it")
        return self.ask(address)


def fetch(candidates: DataFrame, transport: Transport, folder: str, respect_robots: bool = True, wait: float = WAIT) -> DataFrame:
    """``(doi, status, source, file, note)``: each DOI's addresses tried in turn, until one gives a PDF.

    A page is followed to the PDF it names, once.  Files are written into ``folder``, which all executors share,
    under a name of their own first, so a task that runs again leaves no half file.  A DOI's failure is its note.
    The DOIs of a task are visited one after the other, so that a site is asked no faster than ``wait`` allows.
    """
    listed = candidates.groupBy("doi").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "source", "url"))), lambda x: F.struct(x["source"].alias("source"), x["url"].alias("url"))).alias("urls"))

    def one(visits: Visits, doi: str, urls: list) -> tuple[str, str, str, str, str]:
        notes = []
        for source, url in urls:
            got = visits.get(url)
            note = got.note
            if not note and b"%PDF-" not in got.body[:1024]:
                link = D.page_link(got.body[: D.HEAD_BYTES].decode("utf-8", "replace"), got.address)
                if link and link != url:
                    got = visits.get(link)
                    note = got.note
                if not note and b"%PDF-" not in got.body[:1024]:
                    note = "not a PDF"
            if not note:
                name = safe_file(doi)
                part = os.path.join(folder, f".{name}.{os.getpid()}")
                with open(part, "wb") as f:
                    f.write(got.body)
                os.replace(part, os.path.join(folder, name))
                return doi, "downloaded", source, name, ""
            notes.append(f"{source}: {urlsplit(url).netloc} {note}")
        return doi, "not_found", "", "", "; ".join(notes) or "no address"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        visits = Visits(transport, respect_robots, wait)
        for b in batches:
            rows = []
            for doi, urls in zip(b["doi"], b["urls"], strict=True):
                try:
                    rows.append(one(visits, doi, [(u["source"], u["url"]) for u in urls]))
                except (OSError, ValueError) as e:
                    rows.append((doi, "error", "", "", f"{type(e).__name__}: {e}"[:200]))
            yield pd.DataFrame(rows, columns=["doi", "status", "source", "file", "note"])

    return listed.mapInPandas(run, "doi string, status string, source string, file string, note string")


def safe_file(doi: str) -> str:
    return "".join(c if c.isascii() and (c.isalnum() or c in "_-") else "_" for c in doi.lower()) + ".pdf"


def report(planned: DataFrame, fetched: DataFrame) -> DataFrame:
    """One row for each planned DOI, in the log's columns, with ``line`` for the order."""
    j = planned.join(fetched.select("doi", F.col("status").alias("_s"), F.col("source").alias("_src"), F.col("file").alias("_f"), F.col("note").alias("_n")), "doi", "left")
    tried = F.col("status") == "to_fetch"
    return j.select(
        "doi",
        F.when(tried, F.coalesce("_s", F.lit("not_found"))).otherwise(F.col("status")).alias("status"),
        F.coalesce("_src", F.lit("")).alias("source"),
        "licence",
        F.when(tried, F.coalesce("_f", F.lit(""))).otherwise(F.col("file")).alias("file"),
        F.when(tried, F.coalesce("_n", F.lit("no address"))).otherwise(F.lit("")).alias("note"),
        F.col("ord").alias("line"),
    )


def rates(rows: DataFrame, by: list[str], good: str = "downloaded") -> DataFrame:
    """Share of rows with status ``good`` by each of several columns, and over all: ``(level, value, n, n_good, rate)``."""
    sets = rows.select("status", F.explode(F.array(F.struct(F.lit("all").alias("level"), F.lit("").alias("value")), *(F.struct(F.lit(c).alias("level"), F.coalesce(F.col(c), F.lit("")).alias("value")) for c in by))).alias("x"))
    n_good = F.count_if(F.col("status") == good)
    return sets.groupBy("x.level", "x.value").agg(F.count("*").alias("n"), n_good.alias("n_good"), F.round(n_good / F.count("*"), 4).alias("rate"))


def is_right_pdf(doi, title, text):
    """Whether a file's text belongs to a paper: its DOI (letters and digits alone), or at least 0.8 of its title's words."""
    plain = lambda c: F.regexp_replace(F.lower(c), "[^a-z0-9]", "")
    words = F.filter(F.split(F.lower(title), "[^a-z0-9]+"), lambda w: w != "")
    held = F.filter(words, lambda w: F.array_contains(F.split(F.lower(text), "[^a-z0-9]+"), w))
    return F.when(F.contains(plain(text), plain(doi)), "doi").when((F.size(words) > 0) & (F.size(held) >= 0.8 * F.size(words)), "title").otherwise("")
