"""Predictions to relations."""

import pytest

from claimloom.operators import extract as X

SCORED = {"causal": True, "causes": [("rain", 0.9), ("snow", 0.5)], "effects": [("floods", 0.85)]}


@pytest.mark.parametrize(
    "change, threshold, mode, decision, pairs",
    [
        ({}, 0.8, "neural", "span_only", [("rain", "floods")]),
        ({}, 0.4, "neural", "span_only", [("rain", "floods"), ("snow", "floods")]),
        ({}, 0.95, "neural", "span_only", []),
        ({}, 0.95, "auto", "span_only", [("rain", "floods"), ("snow", "floods")]),
        ({"effects": [("floods", 0.85), ("mud", 0.2)]}, 0.8, "auto", "span_only", [("rain", "floods")]),
        ({"causal": False}, 0.8, "neural", "span_only", [("rain", "floods")]),
        ({"causal": False}, 0.8, "neural", "cls+span", []),
        ({"causal": False}, 0.8, "neural", "cls_only", []),
        ({"effects": []}, 0.8, "neural", "cls_only", []),
        ({"relations": [{"cause": "a", "effect": "b"}]}, 1.0, "neural", "span_only", [("a", "b")]),
    ],
)
def test_pairs(change, threshold, mode, decision, pairs):
    assert X.pairs_of(SCORED | change, threshold, mode, decision) == pairs


def test_skipped_pairs_keep_their_numbers(spark):
    def predict(texts):
        return [{"causal": True, "relations": [{"cause": "this", "effect": "b"}, {"cause": "", "effect": "b"}, {"cause": "heavy rain", "effect": "b [SEP]"}]} for _ in texts]

    s = X.plain_sentences(spark, ["one", "two"])
    got = [(r["rel_id"], r["cause"], r["effect"]) for r in X.extract_relations(s, predict).orderBy("rel_id").collect()]
    assert got == [("s0000r02", "heavy rain", "b"), ("s0001r02", "heavy rain", "b")]
    reasons = [r["skip_reason"] for r in X.found_pairs(s, predict).orderBy("rel_id").collect()]
    assert reasons == ["pointer_span", "empty_span", ""] * 2
    assert X.extract_relations(s.drop("doi", "title", "page"), predict, avoid_ambiguous=False).count() == 4


@pytest.mark.parametrize("wrong", [{"threshold": 2}, {"mode": "x"}, {"decision": "x"}, {"batch_size": 0}])
def test_settings(wrong):
    with pytest.raises(ValueError):
        X.check_settings(**({"threshold": 0.8, "mode": "neural", "decision": "span_only", "batch_size": 1} | wrong))
