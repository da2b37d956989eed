import random
import re

import pytest
from pyspark.sql import functions as F

from claimloom.operators import harvest as H


def lines(spark, texts, kept=None):
    rows = [("d", 1, i, "", t, True if kept is None else kept[i], "", "") for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, "doc_id string, page int, line_no long, section string, text string, kept boolean, drop_reason string, flag string")


def test_running_heads_and_junk(spark):
    texts = ["Head line", "## Methods", "Body text here.", "Head line", "", "12", "Head line", "| a | b |", "# References", "Smith", "CHAPTER", "Text again."]
    got = {r["line_no"]: r for r in H.drop_junk_lines(H.drop_running_heads(lines(spark, texts))).collect()}
    assert [got[i]["drop_reason"] for i in range(12)] == ["running_head", "heading", "", "running_head", "blank", "page_number", "running_head", "table_row", "reference_section", "reference_section", "chapter_marker", ""]
    assert got[2]["section"] == "Methods" and got[11]["kept"]


def fold(texts, kept):
    """Paragraphs one line at a time."""
    paras, block = [], None
    for t, k in zip(texts, kept):
        if not k:
            block = None
        elif block is None:
            paras.append(t.strip())
            block = True
        elif paras[-1].endswith("-") and t.strip()[:1].islower():
            paras[-1] = paras[-1][:-1] + t.strip()
        else:
            paras[-1] += " " + t.strip()
    out = []
    for p in paras:
        p = re.sub(r"(\w)- ([a-z])", r"\1\2", re.sub(r"\s+", " ", p).strip())
        if out and not re.search(r"""[.!?]["')\]]?$""", out[-1]) and p[:1].islower():
            out[-1] += " " + p
        else:
            out.append(p)
    return out


def test_paragraphs_against_fold(spark):
    rng = random.Random(5)
    for _ in range(3):
        texts = [rng.choice(["the word is cut-", "ting here", "A line.", "ends - so", "lower start", "x"]) for _ in range(60)]
        kept = [rng.random() < 0.8 for _ in texts]
        got = [r["text"] for r in H.join_paragraphs(lines(spark, texts, kept)).where("kept").orderBy("para").collect()]
        assert got == fold(texts, kept)


def test_sentences():
    assert H.sentences_of("See e.g. Smith et al. found it. It rose (p = .05). J. Doe agreed.") == ["See e.g. Smith et al. found it.", "It rose (p = .05).", "J. Doe agreed."]
    assert H.sentences_of("") == []
    # an ordinary word ends its sentence even before lower case; initials, numbers before lower case and ellipses don't
    assert H.sentences_of("It fell. and rose.") == ["It fell.", "and rose."]
    assert H.sentences_of("About 5. to 6. Then it stopped ... and went on.") == ["About 5. to 6.", "Then it stopped ... and went on."]
    assert H.sentences_of('He said "why?" and left! "So." Done') == ['He said "why?"', "and left!", '"So."', "Done"]
    assert H.sentences_of("The non-univ. staff of A. Beck et al. agreed.") == ["The non-univ. staff of A. Beck et al. agreed."]


def test_document_numbers(spark):
    pages = spark.createDataFrame([(d, 1, f"The people of {d} said so.\nThey were right about it.") for d in ("b", "a", "c")], "doc_id string, page int, markdown string")
    got = {r["sent_id"]: r["doc_id"] for r in H.kept_sentences(H.prefix_ids(H.harvest(pages))).collect()}
    assert got == {f"d{k:03d}p0000s{j:03d}": d for k, d in enumerate("abc") for j in (0, 1)}


def test_pipeline(spark):
    pages = spark.createDataFrame([("d", 1, "# Title\nThis finding helps chil-\ndren learn (Ryan & Deci, 2017).\n\nToo short.\n"), ("d", 2, ""), ("d", 3, None)], "doc_id string, page int, markdown string")
    rows = H.harvest(pages)
    assert {r["text"]: r["drop_reason"] for r in rows.collect()} == {"This finding helps children learn.": "", "Too short.": "too_short", "# Title": "heading", "": "empty_page"}
    assert [(r["sent_id"], r["clean"], r["raw"]) for r in H.kept_sentences(rows).collect()] == [("p0000s000", "This finding helps children learn.", "This finding helps children learn (Ryan & Deci, 2017).")]
    assert sorted(r["drop_reason"] for r in H.drop_log(rows).collect()) == ["empty_page", "empty_page", "heading", "too_short"]
    assert [r["drop_reason"] for r in H.harvest_summary(rows).collect()] == ["blank", "empty_page", "heading", "too_short"]
    assert H.raw_lines(pages).where("drop_reason = 'empty_page'").count() == 2


def test_settings():
    with pytest.raises(ValueError):
        H.harvest(None, steps=["nonsense"])
    assert H.page_set("3,7,9-12") == [3, 7, 9, 10, 11, 12] and H.page_set(4) == [4]


def test_custom_step(spark):
    pages = spark.createDataFrame([("d", 1, "a b\nc")], "doc_id string, page int, markdown string")
    out = H.harvest(pages, steps=["fix_unicode", lambda df: df.withColumn("text", F.upper("text"))])
    assert sorted(r["text"] for r in out.collect()) == ["A B", "C"]
