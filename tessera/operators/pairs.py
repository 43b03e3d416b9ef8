"""Training pairs from graded judgments."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.functions.text import strip, wrap_math
from tessera.functions.trees import tree_to_graph
from tessera.operators.folds import first_by
from tessera.operators.joins import first_match, judged_only


def text_pairs(topics: DataFrame, qrels: DataFrame, posts: DataFrame, least: float = 1.0) -> DataFrame:
    """topic_id, doc_id, query, positive: topics with the texts of documents judged ``least`` or better."""
    wanted = qrels.where(F.col("grade") >= least).join(topics, "topic_id")
    texts = judged_only(posts, "post_id", wanted, "doc_id").where(F.length("text") > 0)
    return wanted.join(texts, F.col("doc_id") == F.col("post_id")).select("topic_id", "doc_id", "query", F.col("text").alias("positive"))


def formula_pairs(topics: DataFrame, qrels: DataFrame, index: DataFrame, order: list[str], least: float = 2.0) -> DataFrame:
    """The same with formulas, wrapped as mathematics on the positive side."""
    wanted = qrels.where(F.col("grade") >= least).join(topics, "topic_id")
    latex = first_by(judged_only(index, "old_visual_id", wanted, "doc_id"), ["old_visual_id"], "latex", order)
    return wanted.join(latex, F.col("doc_id") == F.col("old_visual_id")).select("topic_id", "doc_id", "query", wrap_math(F.col("latex")).alias("positive"))


def graph_pairs(topics: DataFrame, qrels: DataFrame, index: DataFrame, order: list[str], least: float = 2.0, **tree) -> DataFrame:
    """topic_id, doc_id, query_graph, pos_graph: topics resolved by equal LaTeX, positives by id."""
    graph = tree_to_graph(**tree)
    keyed = index.withColumn("latex", strip(F.col("latex")))
    queries = first_match(topics.select("topic_id", strip(F.col("query")).alias("latex")), keyed, "latex", "opt", order)
    queries = queries.select("topic_id", graph(F.col("opt")).alias("query_graph")).where(F.col("query_graph").isNotNull())
    wanted = qrels.where(F.col("grade") >= least)
    trees = first_by(judged_only(index, "old_visual_id", wanted, "doc_id"), ["old_visual_id"], "opt", order)
    positives = trees.select("old_visual_id", graph(F.col("opt")).alias("pos_graph")).where(F.col("pos_graph").isNotNull())
    found = wanted.join(queries, "topic_id").join(positives, F.col("doc_id") == F.col("old_visual_id"))
    return found.select("topic_id", "doc_id", "query_graph", "pos_graph")
