"""Matches between spans, groups and thesaurus entries."""

import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from claimloom.operators import standardize as S


def _encoder():
    """A function of its own, which workers need not import."""
    axes = {"wet": [1, 0, 0], "dry": [0, 1, 0], "windy": [0, 0, 1], "damp": [0.9, 0.1, 0], "gale": [0, 0.1, 0.9]}

    def encode(texts):
        return np.array([axes.get(t, [1e-9, 1e-9, 1e-9]) for t in texts], "float32")

    return encode


encoder = _encoder()


@pytest.fixture(scope="module")
def entries(spark):
    rows = [(0, "c1", "WET", "WEATHER > WET", "wet"), (1, "c2", "DRY", "DRY", "dry"), (2, "c1", "WET", "WET", "damp"), (3, "c3", "WINDY", "WINDY", "windy")]
    return S.embed(spark.createDataFrame(rows, "ord long, id string, leaf string, path string, t string"), "t", encoder).drop("t")


@pytest.mark.parametrize("block", [1, 3, 1000])
def test_spans(spark, entries, monkeypatch, block):
    monkeypatch.setattr(S, "ENTRY_BLOCK", block)
    spans = spark.createDataFrame([("Damp .",), ("gale",), ("gale",), ("nothing",)], "span string")
    got = [tuple(r) for r in S.standardize_spans(spans, entries, encoder, top=2, threshold=0.5).orderBy("query", "rank").collect()]
    # the best of a concept's entries counts
    assert [(q, k, i, p) for q, k, i, _, p, _ in got if q != "nothing"] == [("Damp .", 1, "c1", "WET"), ("gale", 1, "c3", "WINDY")]
    assert S.standardize_spans(spans.where("false"), entries, encoder).count() == 0
    assert S.standardize_spans(spans, entries.where("false"), encoder).count() == 0


def test_groups(spark, entries):
    rows = [("g:1", 0, "wet", "dry"), ("g:1", 1, "dry", "dry"), ("g:1", 2, "dry", "dry"), ("s:gale", 3, "gale", "gale")]
    g = spark.createDataFrame(rows, "key string, ord long, span string, central string").withColumn("id", F.lit("clash"))
    for rule, score in (("mean_sim", 0.6667), ("centroid", 0.8944), ("medoid", 1.0)):
        got = {r["query"]: (r["id"], r["score"]) for r in S.standardize_groups(g, entries, encoder, rule, top=1).collect()}
        assert got["g:1"] == ("c2", pytest.approx(score, abs=2e-4)) and got["s:gale"][0] == "c3"
    with pytest.raises(ValueError):
        S.group_vectors(g, "other")


def test_summary(spark, entries):
    spans = spark.createDataFrame([("wet",), ("gale",), ("lost",)], "span string")
    m = S.standardize_spans(spans, entries, encoder, top=1, threshold=0.9)
    r = S.match_summary(m, spans.withColumnRenamed("span", "query")).first()
    assert (r["n_queries"], r["most"]) == (3, 1.0)


def test_vectors_are_kept(spark, tmp_path):
    calls = tmp_path / "calls"
    calls.mkdir()

    def counted(texts):
        (calls / os.urandom(8).hex()).touch()
        return S.hashed_ngrams(texts)

    e = spark.createDataFrame([(0, "c1", "WET", "A > WET", ["A"], ["DAMP"], "Note.")], "ord long, id string, leaf string, path string, parents array<string>, alt array<string>, note string")
    for _ in range(2):
        assert S.taxonomy_vectors(spark, e, "own", "leaf", counted, cache=f"file://{tmp_path}/cache").count() == 1
    assert len(list(calls.iterdir())) == 1
    more = e.unionByName(e.withColumn("ord", F.lit(1).cast("long")))
    assert S.taxonomy_vectors(spark, more, "own", "leaf", counted, cache=f"file://{tmp_path}/cache").count() == 2
