import json

import pytest
from pyspark.sql import functions as F

from claimloom.operators import dois as D
from claimloom.operators import download as N
from claimloom.operators import extract as X
from claimloom.sources import files as S
from claimloom.streaming.pages import harvest_stream


def test_folder(spark, tmp_path):
    (tmp_path / "a.pdf.pages.json").write_text(json.dumps({"1": "One.", "2": "Two."}))
    (tmp_path / "bad.pdf.pages.json").write_text("{")
    (tmp_path / "good.pdf").write_bytes(b"%PDF-1.4 x")
    (tmp_path / "page.pdf").write_bytes(b"<html>")
    (tmp_path / "notes.txt").write_text("x")
    assert sorted((r["doc_id"], r["page"], r["markdown"]) for r in S.page_caches(spark, str(tmp_path)).collect()) == [("a", 1, "One."), ("a", 2, "Two.")]
    assert {r["file"]: r["status"] for r in S.list_papers(spark, str(tmp_path)).collect()} == {"good.pdf": "pdf", "page.pdf": "unreadable_pdf", "notes.txt": "not_pdf"}

    def reader(content):
        if not content.startswith(b"%PDF"):
            raise ValueError("broken")
        return {1: "text"}

    got = {r["doc_id"]: (r["page"], r["note"]) for r in S.read_pages(spark, str(tmp_path), reader).collect()}
    assert got == {"good": (1, ""), "page": (0, "broken")}


RDF = """<rdf:RDF xmlns:rdf="r" xmlns:skos="s">{}</rdf:RDF>"""
ONE = '<rdf:Description rdf:about="{u}"><rdf:type rdf:resource="http://x/skos/core#Concept"/><skos:prefLabel xml:lang="{lang}">{label}</skos:prefLabel>{more}</rdf:Description>'


def test_thesaurus(spark, tmp_path):
    broader = lambda u: f'<skos:broader rdf:resource="{u}"/>'
    items = [
        ("top", "en", "TOP", '<skos:topConceptOf rdf:resource="x"/><skos:narrower rdf:resource="a"/>'),
        ("a", "en", "A &amp; B", broader("top") + '<skos:narrower rdf:resource="leaf"/>'),
        ("b", "en", "B", broader("top") + '<skos:narrower rdf:resource="leaf"/>'),
        ("leaf", "en", "LEAF", broader("a") + broader("b") + '<skos:altLabel xml:lang="en">LF</skos:altLabel>'),
        ("c1", "en", "C1", broader("c2")),
        ("c2", "en", "C2", broader("c1") + '<skos:narrower rdf:resource="c1"/>'),
        ("de", "de", "NUR", ""),
    ]
    (tmp_path / "t.rdf").write_text(RDF.format("".join(ONE.format(u=u, lang=lang, label=label, more=more) for u, lang, label, more in items)))
    c = S.skos_concepts(spark, str(tmp_path / "t.rdf"))
    assert c.count() == 6
    paths = {r["path"]: r for r in S.taxonomy_entries(c).collect()}
    assert set(paths) == {"TOP > A & B > LEAF", "TOP > B > LEAF", "C2 > C1"}
    import gzip

    (tmp_path / "t.rdf.gz").write_bytes(gzip.compress((tmp_path / "t.rdf").read_bytes()))
    assert S.read_text(spark, str(tmp_path / "t.rdf.gz")).first()[0].startswith("<rdf:RDF")
    e = S.load_taxonomy(spark, str(tmp_path / "t.rdf.gz"))
    assert e is S.load_taxonomy(spark, str(tmp_path / "t.rdf.gz")) and sorted(r["ord"] for r in e.collect()) == [0, 1, 2]
    S.THESAURI["own"] = lambda s: c
    assert S.load_taxonomy(spark, "own", leaves_only=False).count() == 7
    with pytest.raises(ValueError):
        S.load_taxonomy(spark, "unknown")
    assert paths["TOP > A & B > LEAF"]["parents"] == ["A & B", "TOP"] and paths["TOP > B > LEAF"]["alt"] == ["LF"]


def test_dois(spark):
    pages = [("10_1234_a", 1, "see 10.9999/z"), ("10_1234_a", 2, "and 10.1234/A"), ("x", 1, "10.1/q"), ("m", 1, "10.5555/other"), ("t", 1, None), ("t", 2, "doi 10.77777/T-x."), ("t", 3, "10.1234/late"), ("n", 3, "10.1234/late")]
    pages = spark.createDataFrame(pages, "doc_id string, page int, markdown string").withColumn("source", F.lit("clash"))
    files = spark.createDataFrame([(d, f"{d}.pdf", "doi:10.5555/M." if d == "m" else None, None) for d in ("10_1234_a", "x", "m", "t", "n", "n")], "doc_id string, file string, subject string, keywords string")
    log = spark.createDataFrame([("old/x.pdf", "10.7777/early", 0), ("x.pdf", " 10.7777/LOG ", 1), ("", "10.7777/none", 2)], "file string, doi string, line long")
    got = {r["doc_id"]: (r["doi"], r["source"], r["page"], r["status"]) for r in D.paper_dois(pages, files, log).collect()}
    assert got == {"10_1234_a": ("10.1234/a", "file_name", 2, "found"), "x": ("10.7777/log", "download_log", 0, "found"), "m": ("10.5555/m", "metadata", 0, "found"), "t": ("10.77777/t-x", "text", 2, "found"), "n": ("", "", 0, "not_found")}
    assert D.paper_dois(pages.where("false"), files.where("false")).count() == 0
    seeds = spark.createDataFrame([("a", "10.1111/own", "10.1111/own.fig1, then 10.2222/r."), ("b", None, "10.2222/R and 10.3333/s")], "doc_id string, doi string, text string")
    assert [(r["doi"], r["n_seeds"], r["cited_by"]) for r in D.references(seeds).collect()] == [("10.2222/r", 2, ["a", "b"]), ("10.3333/s", 1, ["b"])]
    old = spark.createDataFrame([("d1", "x", 0), ("d2", "y", 1)], "doi string, status string, line long")
    new = spark.createDataFrame([("d3", "q", 0), ("d1", "z", 1), ("d3", "w", 2)], "doi string, status string, line long")
    assert [(r["doi"], r["status"]) for r in D.upsert_log(old, new).orderBy("line").collect()] == [("d1", "z"), ("d2", "y"), ("d3", "w")]
    assert D.upsert_log(old.where("false"), new).count() == 2


def test_titles(spark):
    items = [("a", 1, 0, "A very long", 18.02), ("a", 1, 1, "and broken- up title", 18.0), ("a", 1, 2, "Journal", 30.0), ("a", 2, 3, "Not on the first page", 40.0), ("b", 1, 0, "short", 20.0)]
    meta = spark.createDataFrame([("a", "x"), ("b", "The title of this one"), ("c", "final version of it.docx"), ("d", None)], "doc_id string, title string")
    got = {r["doc_id"]: r["title"] for r in D.paper_titles(spark.createDataFrame(items, "doc_id string, page int, ord int, text string, font_size double"), meta).collect()}
    assert got == {"a": "A very long and broken-up title", "b": "The title of this one", "c": "", "d": ""}


def one(spark, expr, *values):
    df = spark.createDataFrame([values], [f"c{i}" for i in range(len(values))] and ", ".join(f"c{i} string" for i in range(len(values))))
    return df.select(expr(*(F.col(f"c{i}") for i in range(len(values)))).alias("x")).first()["x"]


def test_finders(spark):
    work = '{"best_oa_location":{"license":"cc-by","pdf_url":"u0"},"locations":[{"pdf_url":"u1","landing_page_url":"l1","is_oa":true},{"pdf_url":"u0","landing_page_url":"l2","is_oa":false}]}'
    assert one(spark, D.openalex_urls, work) == ["u0", "u1", "l1"] and one(spark, D.openalex_urls, "{}") == [] == one(spark, D.openalex_urls, None)
    assert [one(spark, D.licence, w) for w in (work, "{}", '{"id":1}', None)] == ["cc-by", "unknown", "none", "unknown"]
    keys = "".join(f"<Key>PMC77.{v}/PMC77.{v}.pdf</Key>" for v in (2, 11, 9)) + "<Key>PMC77.12/more.pdf</Key><Key>PMC778.20/PMC778.20.pdf</Key>"
    assert one(spark, D.pmc_urls, keys, "PMC77") == [D.PMC_FILES + "PMC77.11/PMC77.11.pdf"] and one(spark, D.pmc_urls, "<x>", "PMC77") == []
    found = '{"resultList":{"result":[{"doi":"10.1/A","pmcid":"PMC5","fullTextUrlList":{"fullTextUrl":[{"documentStyle":"pdf","availability":"Free","url":"f1"},{"documentStyle":"pdf","availability":"Subscription","url":"f2"}]}}]}}'
    assert one(spark, D.europe_pmc_urls, found, "10.1/a") == ["f1"] == one(spark, D.europe_pmc_urls, found, "10.1/else")
    assert one(spark, D.pmcid, "{}", found, "10.1/a") == "PMC5" and one(spark, D.pmcid, "{}", found, "10.1/else") == ""
    assert one(spark, D.pmcid, '{"ids":{"pmcid":"https://x/PMC9/"}}', found, "10.1/a") == "PMC9"
    assert one(spark, D.unpaywall_urls, '{"oa_locations":[{"url_for_pdf":null},{"url_for_pdf":"p"}]}') == ["p"]
    assert one(spark, D.semantic_scholar_urls, '{"openAccessPdf":{"url":"s"}}') == ["s"] and one(spark, D.semantic_scholar_urls, "{}") == []
    record = '{"message":{"link":[{"URL":"https://api.elsevier.com/x","content-type":"application/pdf"},{"URL":"c","content-type":"unspecified"},{"URL":"h","content-type":"text/html"}],"relation":{"has-preprint":[{"id":"10.31234/OSF.io/ab1"},{"id":"10.1/x"}]}}}'
    assert one(spark, D.crossref_urls, record) == ["c"] and one(spark, D.preprint_urls, record) == ["https://osf.io/ab1/download"]
    assert one(spark, D.landing_page_urls, "10.1/a(b) c") == ["https://doi.org/10.1/a%28b%29%20c"]
    assert D.page_link("<META content='/x.pdf?a=1&amp;b=2' name=\"citation_pdf_url\">", "https://a.org/p/q") == "https://a.org/x.pdf?a=1&b=2"
    assert one(spark, D.page_pdf_link, "<meta name='citation_title' content='t'>", "https://a.org") == "" == one(spark, D.page_pdf_link, None, None)
    assert one(spark, D.page_pdf_link, '<meta name="citation_pdf_url" content="https://b.org/z">', "https://a.org") == "https://b.org/z"
    assert one(spark, D.site, "https://a.org/x?y=1") == "https://a.org"


def test_download(spark, tmp_path):
    wanted = S.read_dois(spark, [" 10.1/A", "10.1/b", "10.1/a", "10.1/c", "10.1/d", "", "10.1/e"])
    assert [r["doi"] for r in wanted.orderBy("ord").collect()] == ["10.1/a", "10.1/b", "10.1/c", "10.1/d", "10.1/e"]
    there = spark.createDataFrame([("10_1_a.pdf",)], "file string")
    works = spark.createDataFrame([("10.1/b", '{"best_oa_location":{"license":"cc-by-nc"}}')] + [(f"10.1/{x}", '{"best_oa_location":{"license":"cc-by"}}') for x in "cde"], "doi string, work string")
    p = N.plan(wanted, there, works, ["cc-by"])
    assert {r["doi"]: r["status"] for r in p.collect()} == {"10.1/a": "already_there", "10.1/b": "skipped_licence", "10.1/c": "to_fetch", "10.1/d": "to_fetch", "10.1/e": "to_fetch"}

    def transport(url):
        if url.endswith("robots.txt"):
            return N.Answer(b"User-agent: *\nDisallow: /closed", url)
        if url == "https://e.org/boom":
            raise OSError("gone")
        body = {"https://a.org/page": b"<meta name='citation_pdf_url' content='/real'>", "https://a.org/real": b"%PDF-1.5 x"}.get(url, b"")
        return N.Answer(body, url, "" if body else "HTTP 404")

    rows = [("10.1/c", "openalex", 0, "https://a.org/none"), ("10.1/c", "crossref", 1, "https://a.org/page"), ("10.1/d", "openalex", 0, "https://a.org/closed/x"), ("10.1/e", "openalex", 0, "https://e.org/boom")]
    urls = spark.createDataFrame(rows, "doi string, source string, rank int, url string")
    folder = str(tmp_path)
    got = {r["doi"]: r for r in N.report(p, N.fetch(urls, transport, folder, wait=0.0)).collect()}
    assert (got["10.1/c"]["status"], got["10.1/c"]["source"], got["10.1/c"]["file"]) == ("downloaded", "crossref", "10_1_c.pdf") and (tmp_path / "10_1_c.pdf").read_bytes() == b"%PDF-1.5 x"
    assert got["10.1/d"]["note"] == "openalex: a.org robots.txt forbids it" and got["10.1/e"]["status"] == "error" and got["10.1/a"]["licence"] == ""
    assert [f.name for f in tmp_path.iterdir()] == ["10_1_c.pdf"]
    for wrong in ([], ["nowhere"]):
        with pytest.raises(ValueError):
            N.check_sources(wrong)
    assert N.check_sources("crossref") == ["crossref"] and N.check_sources(["pmc", "pmc"]) == ["pmc", "pmc"]
    r = {(x["level"], x["value"]): (x["n"], x["n_good"], x["rate"]) for x in N.rates(spark.createDataFrame([("downloaded", "pmc"), ("not_found", ""), ("downloaded", "pmc")], "status string, source string"), ["source"]).collect()}
    assert r == {("all", ""): (3, 2, 0.6667), ("source", "pmc"): (2, 2, 1.0), ("source", ""): (1, 0, 0.0)}
    assert one(spark, N.is_right_pdf, "10.1/a-b", "Some title", "text 10.1 / A-B here") == "doi" and one(spark, N.is_right_pdf, "10.1/z", "The quiet river", "a quiet river, the") == "title"


def test_pages_are_read_once(spark, tmp_path):
    (tmp_path / "a.pdf").write_bytes(b"%PDF one")
    (tmp_path / "b.pdf").write_bytes(b"%PDF two")
    (tmp_path / "b.pdf.pages.json").write_text('{"1": "cached"}')
    (tmp_path / "c.pdf").write_bytes(b"%PDF three")
    (tmp_path / "c.pdf.pages.json").write_text("{")
    seen = tmp_path.parent / "seen"
    seen.mkdir()

    def reader(content):
        (seen / content.decode().split()[1]).touch(exist_ok=False)  # a second reading fails
        return {1: content.decode()}

    for _ in range(2):
        got = {r["doc_id"]: r["markdown"] for r in S.all_pages(spark, str(tmp_path), reader, str(tmp_path.parent / "pages")).collect()}
        assert got == {"a": "%PDF one", "b": "cached", "c": "%PDF three"}
    assert sorted(p.name for p in seen.iterdir()) == ["one", "three"]
    assert S.source_paths(str(tmp_path)) == str(tmp_path) and S.source_paths(str(tmp_path / "a.pdf")).endswith("a.pdf")
    for wrong in (str(tmp_path / "none.pdf"), str(seen)):
        with pytest.raises(ValueError):
            S.source_paths(wrong)
    assert [r["drop_reason"] for r in S.file_problems(spark.createDataFrame([("x.pdf", "unreadable_pdf"), ("n.txt", "not_pdf"), ("p.pdf", "pdf")], "file string, status string")).collect()] == ["not_pdf", "unreadable_pdf"]


def test_extract(spark):
    s = spark.createDataFrame([("d", 1, "s1", "Overall, stress reduces sleep, this and trust.", "10.1/x", None), ("d", 1, "s2", None, None, None)], "doc_id string, page int, sent_id string, clean string, doi string, title string")
    got = sorted((r["rel_id"], r["cause"], r["effect"], r["title"]) for r in X.extract_relations(s).collect())
    assert got == [("s1r00", "stress", "sleep", ""), ("s1r02", "stress", "trust", "")]
    with pytest.raises(ValueError):
        X.check_settings(2, "neural", "span_only", 1)


def test_stream(spark, tmp_path):
    spark.createDataFrame([("d", 1, "Support helps the children learn.")], "doc_id string, page int, markdown string").write.parquet(str(tmp_path / "in"))
    harvest_stream(spark, str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "check")).awaitTermination()
    assert spark.read.parquet(str(tmp_path / "out")).first()["text"] == "Support helps the children learn."
