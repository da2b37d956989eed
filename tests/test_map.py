import csv
import json

import pytest
from pyspark.sql import functions as F

from claimloom.operators import causal_map as M
from claimloom.operators.labels import label_groups
from claimloom.sources.sinks import draw_map, save_map, write_csv, write_csv_folder

REL = "row_id long, rel_id string, sent_id string, doc_id string, cause string, effect string, sentence string, doi string, title string"


def relations(spark):
    rows = [
        (1, "r1", "s1", "d1", "job insecurity", "stress", "", "10.1/a", "T"),
        (2, "r2", "s2", "d2", " job insecurity ", "stress", "", "", ""),
        (3, "r3", "s2", "d2", "job insecurity", "strain", "", None, None),
        (4, "r4", "s3", "d3", "stress", "job insecurity", "", "", ""),
        (5, "r5", "s4", "d3", "stress", "strain", "", "", ""),
        (6, "r6", "s5", "d3", "", "stress", "", "", ""),
        (7, "r7", "s5", "d3", None, "stress", "", "", ""),
    ]
    return spark.createDataFrame(rows, REL)


def names(spark):
    return spark.createDataFrame([("job insecurity", "g:1", "insecurity"), ("stress", "g:2", "stress"), ("strain", "g:2", "stress")], "span string, node_id string, label string")


def test_edges(spark):
    e = {(r["source"], r["target"]): r for r in M.number_edges(M.build_edges(M.place(relations(spark), names(spark)))).collect()}
    a = e["g:1", "g:2"]
    assert (a["n_relations"], a["n_sentences"], a["n_papers"], a["edge_id"], a["direction"], a["drop_reason"]) == (3, 2, 2, "e00001", "contested", "")
    assert e["g:2", "g:1"]["direction"] == "contested" and e["g:2", "g:1"]["drop_reason"] == "below_min_sentences"
    assert e["g:2", "g:2"]["self_loop"] and not e["g:2", "g:2"]["reciprocal"]


def test_nodes_papers_and_sinks(spark, tmp_path):
    m = M.causal_map(relations(spark), names(spark))
    n = {r["node_id"]: r for r in m.nodes.collect()}
    assert n["g:1"]["role"] == "cause only" and n["g:2"]["n_members"] == 2 and n["g:2"]["n_papers"] == 2
    p = {r["doc_id"]: (r["doi"], r["title"]) for r in m.papers.collect()}
    assert p == {"d1": ("10.1/a", "T"), "d2": ("", ""), "d3": ("", "")}
    paths = save_map(m, names(spark), M.collect_spans(relations(spark)), str(tmp_path))
    shown = list(csv.DictReader(open(paths[1])))
    assert [(r["source_label"], r["target_label"], r["doc_ids"], r["rel_ids"]) for r in shown] == [("insecurity", "stress", "d1 | d2", "r1 | r2 | r3")]
    assert len(list(csv.reader(open(paths[2])))) == 3
    assert {r["node_id"]: r["members"] for r in csv.DictReader(open(paths[0]))} == {"g:1": "job insecurity", "g:2": "stress | strain"}
    xml = open(paths[3]).read()
    assert xml.count("<edge ") == 3 and 'attr.name="n_papers" attr.type="long"' in xml and ">r1 | r2 | r3<" in xml and 'attr.name="shown" attr.type="boolean"' in xml
    draw_map(m, f"{tmp_path}/m.html", title="a </script>")
    page = open(f"{tmp_path}/m.html").read()
    data = json.loads(page.split("const d=")[1].split(";\nconst $")[0].replace("<\\/", "</"))
    assert page.count("</script>") == 1 and [e["pairs"] for e in sorted(data["evidence"], key=lambda e: e["sent_id"])] == ["job insecurity → stress", "job insecurity → stress; job insecurity → strain"]
    assert {p["source"] for p in data["papers"]} == {"10.1/a", "d2", "d3"}
    assert len(list(csv.reader(open(write_csv(m.papers, str(tmp_path), ("doc_id", "doi"), "papers.csv"))))) == 4
    assert spark.read.option("header", True).csv(write_csv_folder(m.papers, f"{tmp_path}/many", ("doc_id",))).count() == 3


def test_passing_edges(spark):
    rows = [("a", "b", 2, 3, "", False, True), ("b", "a", 1, 3, "", False, True), ("b", "c", 2, 2, "", False, False), ("c", "c", 2, 2, "", True, False), ("c", "d", 2, 2, "below_min_papers", False, False)]
    e = spark.createDataFrame(rows, "source string, target string, n_papers long, n_sentences long, drop_reason string, self_loop boolean, reciprocal boolean")
    ev = spark.createDataFrame([("a", "b", "p1"), ("b", "c", "p2"), ("c", "d", "p1")], "source string, target string, doc_id string")

    def left(**settings):
        return sorted((r["source"], r["target"]) for r in M.passing_edges(e, ev, **settings).collect())

    assert left() == [("a", "b"), ("b", "a"), ("b", "c"), ("c", "c")]
    assert left(min_papers=2, self_loops=False) == [("a", "b"), ("b", "c")]
    assert left(reciprocal_only=True) == [("a", "b"), ("b", "a")] and left(paper="p1") == [("a", "b")]
    # roles are those of the edges left: a only causes, c only is caused, b does both
    assert left(min_papers=2, self_loops=False, roles=["cause only", "cause and effect"]) == [("a", "b")]
    assert left(roles=["cause and effect"]) == [("a", "b"), ("b", "a"), ("b", "c"), ("c", "c")]


def test_names_of_three_shapes(spark):
    members = spark.createDataFrame([("stress", "g:1", "stress"), ("strain", "g:1", "stress"), ("tension", "g:2", "tension"), ("odd span", "s:odd span", "odd span")], "span string, key string, central string")
    matches = spark.createDataFrame([("g:1", 1, "c7", "STRESS"), ("g:1", 2, "c8", "X"), ("g:2", 1, "c7", "STRESS")], "query string, rank int, id string, leaf string")
    got = {r["span"]: (r["node_id"], r["label"]) for r in M.names_of_matched_groups(members, matches).collect()}
    assert got == {"stress": ("c:c7", "STRESS"), "strain": ("c:c7", "STRESS"), "tension": ("c:c7", "STRESS"), "odd span": ("g:s:odd span", "odd span")}
    got = {r["span"]: (r["node_id"], r["label"]) for r in M.names_of_matched_spans(members, matches.withColumn("query", F.lit("stress")).limit(1)).collect()}
    assert got["stress"] == ("c:c7", "STRESS") and got["odd span"] == ("s:odd span", "odd span")
    labelled = members.withColumn("name", F.lit("n"))
    assert {r["node_id"] for r in M.names_of_groups(labelled).collect()} == {"g:g:1", "g:g:2", "g:s:odd span"}


def test_hot_spans_and_labels(spark, monkeypatch):
    monkeypatch.setattr(M, "HOT_LEAST", 10)
    rows = [(i, f"r{i}", f"s{i}", "d", "hot" if i % 3 else f"c{i}", "e", "", "", "") for i in range(60)]
    r = spark.createDataFrame(rows, REL)
    placed = M.place(r, M.collect_spans(r).select("span", F.concat(F.lit("s:"), "span").alias("node_id"), F.col("span").alias("label")))
    assert {(x["row_id"], x["source"], x["target"]) for x in placed.collect()} == {(i, f"s:{'hot' if i % 3 else f'c{i}'}", "s:e") for i in range(60)}
    long = spark.createDataFrame([("a | b",), ("x" * 50,)], "t string").select(M.short_label(F.col("t"))).collect()
    assert long[0][0] == "a" and len(long[1][0]) == 40


def test_missing_and_settings(spark):
    few = names(spark).where("span <> 'strain'")
    assert [r["span"] for r in M.missing_spans(relations(spark), few).collect()] == ["strain"]
    with pytest.raises(ValueError, match="strain"):
        M.causal_map(relations(spark), few)
    with pytest.raises(ValueError):
        M.check_settings(0, 1, 0.67)
    with pytest.raises(ValueError):
        M.check_settings(1, 1, 0.5)


def test_neighbourhood(spark):
    e = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "d")], "source string, target string")
    s = spark.createDataFrame([("a",)], "node_id string")
    assert sorted(r["node_id"] for r in M.neighbourhood(e, s, 2).collect()) == ["a", "b", "c"]
    d = spark.createDataFrame([("d",)], "node_id string")
    assert sorted(r["node_id"] for r in M.near_all(e, [s, d], 2).collect()) == ["b", "c"]


def test_empty(spark):
    none = relations(spark).where("false")
    assert M.build_edges(M.place(none, names(spark))).count() == 0 and M.collect_spans(none).count() == 0


def test_labels(spark):
    g = spark.createDataFrame([("social support", 0, 1, "social support"), ("support of peers", 1, 1, "social support"), ("odd", 2, -1, "odd"), (None, 3, -1, "")], "span string, ord long, `group` int, central string")
    got = {r["key"]: r["name"] for r in label_groups(g).collect()}
    assert got["g:1"].startswith("social support | support") and got["s:odd"] == "odd"
    assert label_groups(g.withColumn("extra", F.lit(1)), "medoid").count() == 3
