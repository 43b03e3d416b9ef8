"""Retrieval evaluation: encode, search, score; with a result cache and a configuration."""

from __future__ import annotations

import dataclasses
import json
import os
import time
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.functions.trees import tree_to_graph
from tessera.operators.encoders import Encoder, encode_column
from tessera.operators.folds import first_by, hash_sample
from tessera.operators.joins import first_match
from tessera.operators.retrieval import macro, metrics, top_k

# The cutoffs that the measures are computed and shown for, and the sizes of quick runs.
CUTOFFS = (5, 10, 15, 20, 30, 100, 200, 500, 1000)
SHOWN = (10, 100, 1000)
QUICK_TEXT, QUICK_FORMULA, SEED = 50_000, 100_000, 42
QUERY_BATCH = 32


@dataclass(frozen=True)
class Config:
    """Two levels of settings, ``model`` and ``training``, as a YAML file holds them."""

    model: dict[str, Any] = field(default_factory=dict)
    training: dict[str, Any] = field(default_factory=dict)

    @staticmethod
    def load(path: str, **overrides: Any) -> Config:
        import yaml

        with open(path) as source:
            raw = yaml.safe_load(source) or {}
        found = Config(dict(raw.get("model") or {}), dict(raw.get("training") or {}))
        return found.override(**overrides)

    def override(self, **values: Any) -> Config:
        """Training settings replaced by those that aren't None."""
        return dataclasses.replace(self, training=self.training | {k: v for k, v in values.items() if v is not None})


@dataclass(frozen=True)
class ResultCache:
    """Metrics of an evaluation in a JSON file, valid while everything that they depend on is the same."""

    path: str

    def read(self, key: dict[str, Any]) -> dict[str, float] | None:
        try:
            with open(self.path) as source:
                found = json.load(source)
            return found["metrics"] if found["key"] == json.loads(json.dumps(key)) else None
        except (OSError, ValueError, KeyError, TypeError):
            return None

    def write(self, key: dict[str, Any], values: dict[str, float]) -> None:
        os.makedirs(os.path.dirname(os.path.abspath(self.path)), exist_ok=True)
        with open(self.path, "w") as out:
            json.dump({"timestamp": time.strftime("%Y-%m-%dT%H:%M:%S"), "key": key, "metrics": values}, out, indent=1)


def search_and_score(topics: DataFrame, corpus: DataFrame, qrels: DataFrame, k: int, level: int, cutoffs: tuple[int, ...] = CUTOFFS, prime: bool = False) -> DataFrame:
    """Per-topic measures of encoded ``topics`` against an encoded ``corpus``."""
    run = top_k(topics, corpus, k, digits=None).select("topic_id", "doc_id", F.col("score").cast("float").cast("double").alias("score"))
    return metrics(run, qrels, list(cutoffs), level, prime)


def evaluate_text(topics: DataFrame, posts: DataFrame, qrels: DataFrame, encoder: Encoder, k: int = 1000, quick: bool = False, level: int = 1, prime: bool = False, batch_size: int | None = 64) -> DataFrame:
    """topic_id and measures for topics (topic_id, query) over posts (post_id, text)."""
    if quick:
        posts = hash_sample(posts, "post_id", QUICK_TEXT, SEED)
    corpus = encode_column(posts, encoder, "text", ["post_id"], batch_size=batch_size).withColumnRenamed("post_id", "doc_id")
    return search_and_score(encode_column(topics, encoder, "query", ["topic_id"], batch_size=QUERY_BATCH), corpus, qrels, k, level, prime=prime)


def formula_corpus(index: DataFrame, order: list[str], quick: bool = False) -> DataFrame:
    """old_visual_id and its first non-empty tree."""
    rows = first_by(index, ["old_visual_id"], "opt", order)
    return hash_sample(rows, "old_visual_id", QUICK_FORMULA, SEED) if quick else rows


def resolved(topics: DataFrame, index: DataFrame, order: list[str]) -> DataFrame:
    """topic_id, graph, status: topics (topic_id, query) resolved to trees by equal LaTeX.

    ``status`` is "resolved", "unreadable" (there is a tree, but none that gives a graph) or "unmatched" (no row of the
    index has that LaTeX and a tree).
    """
    found = first_match(topics.withColumnRenamed("query", "latex"), index, "latex", "opt", order).select("topic_id", tree_to_graph()(F.col("opt")).alias("graph"), F.lit(True).alias("found"))
    whole = topics.select("topic_id").join(found, "topic_id", "left")
    status = F.when(F.col("graph").isNotNull(), "resolved").when(F.col("found"), "unreadable").otherwise("unmatched")
    return whole.select("topic_id", "graph", status.alias("status"))


def evaluate_formula(topics: DataFrame, index: DataFrame, qrels: DataFrame, encoder: Encoder, order: list[str], k: int = 1000, quick: bool = False, level: int = 2, prime: bool = False, batch_size: int | None = 512) -> DataFrame:
    """The same for formulas: topics are resolved to trees; those that can't be (``resolved``) aren't scored."""

    def encoded(rows: DataFrame, key: str) -> DataFrame:
        return encode_column(rows.where(F.col("graph").isNotNull()), encoder, "graph", [key], batch_size=batch_size)

    queries = encoded(resolved(topics, index, order), "topic_id")
    trees = formula_corpus(index, order, quick).select("old_visual_id", tree_to_graph()(F.col("opt")).alias("graph"))
    corpus = encoded(trees, "old_visual_id").withColumnRenamed("old_visual_id", "doc_id")
    return search_and_score(queries, corpus, qrels, k, level, prime=prime)


def summary(per_topic: DataFrame) -> DataFrame:
    """The macro means at the shown cutoffs, to four decimals."""
    means = macro(per_topic)
    return means.select(*[F.round(c, 4).alias(c) for c in means.columns if int(c.rpartition("_")[2]) in SHOWN])


def cached_summary(cache: ResultCache, key: dict[str, Any], per_topic, force: bool = False) -> dict[str, float]:
    """Macro means from the cache if ``key`` is the same, else computed (``per_topic()``) and kept."""
    if not force and (found := cache.read(key)) is not None:
        return found
    values = macro(per_topic()).first().asDict()
    cache.write(key, values)
    return values
