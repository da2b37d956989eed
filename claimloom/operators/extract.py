"""Sentences to relations through a predictor, which any callable can be."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from claimloom.functions import text as T

Predict = Callable[[list[str]], list[dict]]
MODES = ("neural", "auto")
DECISIONS = ("span_only", "cls+span", "cls_only")
# Verbs the built-in predictor reads as causal.
_VERBS = re.compile(r"\b(?:increases?|reduces?|lowers?|raises?|promotes?|limits?|triggers?|drives?|dampens?|shapes?|worsens?|improves?|weakens?|strengthens?|buffers?|undermines?|predicts?|explains?|leads? to|causes?|results? in)\b", re.IGNORECASE)
_LEADS = re.compile(r"^(?:we (?:found|find) that|overall|for [a-z]+|in an? [a-z -]+|taken together)\s*,?\s*", re.IGNORECASE)


def pattern_predict(sentences: list[str]) -> list[dict]:
    """Deterministic stand-in for a model: what stands before a causal verb acts on each item listed after it.

    A prediction holds ``causal``, the verdict on the sentence, and scored candidate spans ``causes`` and ``effects``.
    """
    out = []
    for s in sentences:
        s = (s or "").strip().rstrip(".")
        m = _VERBS.search(s)
        if not m:
            out.append({"causal": False, "causes": [], "effects": []})
            continue
        cause = _LEADS.sub("", s[: m.start()]).strip(" ,")
        effects = [e.strip() for e in re.split(r",\s+(?:and\s+)?|\s+and\s+", s[m.end() :].strip()) if e.strip()]
        out.append({"causal": bool(cause and effects), "causes": [(cause, 1.0)] if cause else [], "effects": [(e, 1.0) for e in effects]})
    return out


def pairs_of(prediction: dict, threshold: float, mode: str, decision: str) -> list[tuple[str, str]]:
    """(cause, effect) pairs of one prediction.

    ``decision`` says what makes a sentence causal: both kinds of spans, the verdict, or both.  A pair counts
    if the lower of its two scores reaches ``threshold``; in mode ``auto`` a side with a single span leaves
    nothing to choose, so all pairs count.  Ready-made ``relations`` are taken as they are.
    """
    verdict = bool(prediction.get("causal"))
    if "relations" in prediction:
        return [(r["cause"], r["effect"]) for r in prediction["relations"]] if verdict else []
    causes, effects = prediction.get("causes") or [], prediction.get("effects") or []
    both = bool(causes and effects)
    if not {"span_only": both, "cls+span": both and verdict, "cls_only": verdict}[decision]:
        return []
    free = mode == "auto" and min(len(causes), len(effects)) == 1
    return [(c, e) for c, p in causes for e, q in effects if free or min(p, q) >= threshold]


def check_settings(threshold: float, mode: str, decision: str, batch_size: int) -> None:
    if not 0 <= threshold <= 1:
        raise ValueError(f"a threshold lies in 0..1, not at {threshold}")
    if mode not in MODES:
        raise ValueError(f"{mode!r} is no mode; there are {MODES}")
    if decision not in DECISIONS:
        raise ValueError(f"{decision!r} is no decision; there are {DECISIONS}")
    if batch_size < 1:
        raise ValueError(f"a batch holds one sentence at least, not {batch_size}")


def skip_reason(cause, effect):
    """Why a pair of spans is no relation: an empty span, or one that points to text elsewhere; '' if it is one."""
    empty = (F.trim(F.coalesce(cause, F.lit(""))) == "") | (F.trim(F.coalesce(effect, F.lit(""))) == "")
    return F.when(empty, "empty_span").when(T.is_vague(cause) | T.is_vague(effect), "pointer_span").otherwise("")


def plain_sentences(spark: SparkSession, texts: list[str]) -> DataFrame:
    """Plain texts as sentence rows of one made-up document."""
    return spark.createDataFrame([("input", 0, f"s{k:04d}", t, "", "") for k, t in enumerate(texts)], "doc_id string, page int, sent_id string, clean string, doi string, title string")


def found_pairs(sentences: DataFrame, predict: Predict = pattern_predict, batch_size: int = 64, threshold: float = 0.8, mode: str = "neural", decision: str = "span_only") -> DataFrame:
    """All pairs a predictor finds in ``(doc_id, page, sent_id, clean, doi, title)``, those to skip with their ``skip_reason``.

    ``rel_id`` counts within the sentence, skipped pairs included.  NULL sentences have no pairs; columns that
    are missing in the input are empty.
    """
    check_settings(threshold, mode, decision, batch_size)
    kinds = {"doc_id": "string", "page": "int", "sent_id": "string", "clean": "string", "doi": "string", "title": "string"}
    known = sentences.select(*(F.col(c).cast(k).alias(c) if c in sentences.columns else F.lit(None).cast(k).alias(c) for c, k in kinds.items()))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            texts, got = [x or "" for x in b["clean"]], []
            for i in range(0, len(texts), batch_size):
                got += predict(texts[i : i + batch_size])
            yield b.assign(found=[[(k, c, e) for k, (c, e) in enumerate(pairs_of(p, threshold, mode, decision))] for p in got])

    schema = ", ".join(f"{c} {k}" for c, k in kinds.items()) + ", found array<struct<k:int,cause:string,effect:string>>"
    r = known.mapInPandas(run, schema).select(*kinds, F.explode("found").alias("f"))
    r = r.select(F.format_string("%sr%02d", F.col("sent_id"), F.col("f.k")).alias("rel_id"), "sent_id", "doc_id", F.coalesce("page", F.lit(0)).alias("page"), T.tidy_span(F.col("f.cause")).alias("cause"), T.tidy_span(F.col("f.effect")).alias("effect"), F.col("clean").alias("sentence"), F.coalesce("doi", F.lit("")).alias("doi"), F.coalesce("title", F.lit("")).alias("title"))
    return r.withColumn("skip_reason", skip_reason(F.col("cause"), F.col("effect")))


def extract_relations(sentences: DataFrame, predict: Predict = pattern_predict, batch_size: int = 64, avoid_ambiguous: bool = True, threshold: float = 0.8, mode: str = "neural", decision: str = "span_only") -> DataFrame:
    """Relations of sentences: :func:`found_pairs` without those to skip; pointer spans stay unless ``avoid_ambiguous``."""
    pairs = found_pairs(sentences, predict, batch_size, threshold, mode, decision)
    return pairs.where(~F.col("skip_reason").isin("empty_span", *(["pointer_span"] if avoid_ambiguous else []))).drop("skip_reason")


def pair_scored_spans(spans: DataFrame, threshold: float = 0.8) -> DataFrame:
    """Cause and effect pairs of scored candidate spans ``(sent_id, side, span, score)`` whose two scores reach the threshold."""
    c = spans.where("side = 'cause'").select("sent_id", F.col("span").alias("cause"), F.col("score").alias("s1"))
    e = spans.where("side = 'effect'").select("sent_id", F.col("span").alias("effect"), F.col("score").alias("s2"))
    return c.join(e, "sent_id").where(F.least("s1", "s2") >= threshold).select("sent_id", "cause", "effect")
