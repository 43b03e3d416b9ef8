"""Exact inner-product search and retrieval metrics."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.session import materialize


def _ranked(scores: DataFrame) -> DataFrame:
    """``rank`` by score, then id, descending."""
    order = Window.partitionBy("topic_id").orderBy(F.col("score").desc(), F.col("doc_id").desc())
    return scores.withColumn("rank", F.row_number().over(order))


def blocked(rows: DataFrame, vector: str, size: int) -> DataFrame:
    """``rows`` written with block and q: each task's rows in blocks of about ``size`` bytes of vectors, q from 0 in each."""
    kept = rows.where(F.col(vector).isNotNull())
    spec = T.StructType([T.StructField("block", T.LongType()), T.StructField("q", T.IntegerType()), *kept.schema.fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        block, place, volume = TaskContext.get().partitionId() << 32, 0, 0
        for batch in batches:
            blocks, places = [], []
            for n in batch[vector].value_lengths().to_pylist():
                if volume and volume + 8 * n > size:
                    block, place, volume = block + 1, 0, 0
                blocks.append(block)
                places.append(place)
                place, volume = place + 1, volume + 8 * n
            yield pa.RecordBatch.from_arrays([pa.array(blocks, pa.int64()), pa.array(places, pa.int32()), *batch.columns], names=["block", "q", *batch.schema.names])

    return materialize(kept.mapInArrow(run, spec), "search-queries")


def passes(held: DataFrame, vector: str, most_bytes: int, most_rows: int) -> list[list[int]]:
    """The blocks of ``blocked`` that go together: at most so many bytes of vectors and rows, or one block."""
    sizes = held.groupBy("block").agg(F.sum(8 * F.size(vector)).alias("bytes"), F.count(F.lit(1)).alias("rows")).orderBy("block").collect()  # a row a block
    out: list[list[int]] = []
    volume, rows = most_bytes, 0
    for row in sizes:
        if volume + row["bytes"] > most_bytes or rows + row["rows"] > most_rows:
            out.append([])
            volume = rows = 0
        out[-1].append(row["block"])
        volume, rows = volume + row["bytes"], rows + row["rows"]
    return out


class Running:
    """The ``k`` best (score, id) of each of ``n`` queries among the rows shown so far, ties by id, descending.

    Rows below a query's k-th best score are turned away at once; the others wait until there are
    as many as are kept, then one sort merges them, so memory stays within about 2 n k rows.
    """

    def __init__(self, n: int, k: int, ids: pa.DataType) -> None:
        self.n, self.k, self.ids = n, k, ids
        self.edge = np.full(n, -np.inf)
        self.kept: list[pa.Table] = []
        self.waiting = 0

    def add(self, scores: np.ndarray, ids: pa.Array) -> None:
        """A score for each row and query, and the rows' ids."""
        row, query = np.nonzero(scores >= self.edge)
        if not len(row):
            return
        self.kept.append(pa.table([pa.array(query.astype(np.int32)), pa.array(scores[row, query]), ids.take(pa.array(row))], names=["query", "score", "id"]))
        self.waiting += len(row)
        if self.waiting > max(self.n * self.k, 1 << 16):
            self.merge()

    def merge(self) -> pa.Table:
        """What is kept, by query and rank."""
        empty = pa.table([pa.array([], pa.int32()), pa.array([], pa.float64()), pa.array([], self.ids)], names=["query", "score", "id"])
        whole = pa.concat_tables(self.kept or [empty]).sort_by([("query", "ascending"), ("score", "descending"), ("id", "descending")]).combine_chunks()
        query = whole["query"].to_numpy()
        rank = np.arange(len(query)) - np.searchsorted(query, query)
        last = np.flatnonzero(rank == self.k - 1)
        self.edge[query[last]] = whole["score"].to_numpy()[last]
        self.kept, self.waiting = [whole.filter(pa.array(rank < self.k))], 0
        return self.kept[0]


FAN = 64  # tasks whose results meet first


def merged(found: DataFrame, keys: list[str], order: list[Column], k: int) -> DataFrame:
    """``rank`` up to ``k`` within ``keys`` of each task's best rows (column ``task``).

    The results of ``FAN`` tasks are cut to ``k`` before those meet, so no key brings the rows of
    all tasks into one place; Spark also cuts each task's before either shuffle.
    """
    near = Window.partitionBy(*keys, F.floor(F.col("task") / FAN)).orderBy(*order)
    found = found.withColumn("rank", F.row_number().over(near)).where(F.col("rank") <= k)
    whole = Window.partitionBy(*keys).orderBy(*order)
    return found.withColumn("rank", F.row_number().over(whole)).where(F.col("rank") <= k).drop("task")


def top_k(queries: DataFrame, corpus: DataFrame, k: int = 1000, digits: int | None = 6, block_bytes: int = 32 << 20, state_rows: int = 4 << 20) -> DataFrame:
    """topic_id, doc_id, score, rank: the ``k`` best documents of each query by inner product.

    Tasks write ``queries`` (topic_id, embedding) in blocks of at most a quarter of ``block_bytes``;
    the corpus (doc_id, embedding) is passed over once for as many blocks together as fit ``block_bytes``
    and have at most ``state_rows`` / k queries, which is all that the driver holds and broadcasts at a
    time.  If that takes more than one pass, each one's results are written and its broadcast is
    dropped before the next.  A task multiplies slices of its rows by the queries' matrix and keeps
    each query's best ``k`` so far (``Running``), so tasks x k rows a query leave Python, and those
    meet in a tree (``merged``).  Scores are rounded before ranking, if at all.  Null ids and vectors
    take no part, nor does a vector whose length isn't the queries'.
    """
    if k < 1:
        raise ValueError("k must be positive")
    spec = f"task int, block long, q int, doc_id {corpus.schema['doc_id'].dataType.simpleString()}, score double"
    held = blocked(queries.select("topic_id", F.col("embedding").cast("array<double>").alias("embedding")), "embedding", max(1, block_bytes // 4))
    rows = corpus.select("doc_id", "embedding").where(F.col("doc_id").isNotNull() & F.col("embedding").isNotNull())

    def search(blocks: list[int]) -> tuple[DataFrame, Broadcast]:
        mine = held.where(F.col("block").isin(blocks))
        found = sorted(mine.select("block", "q", "embedding").collect())
        sizes = sorted({len(r[2]) for r in found})
        parts = [(np.array([r[:2] for r in found if len(r[2]) == n], np.int64), np.array([r[2] for r in found if len(r[2]) == n], np.float64).T) for n in sizes]
        shared = corpus.sparkSession.sparkContext.broadcast(dict(zip(sizes, parts, strict=True)))

        def local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            from pyspark import TaskContext

            best: dict[int, Running] = {}
            for batch in batches:
                lengths = np.asarray(batch["embedding"].value_lengths())
                for n, (_, matrix) in shared.value.items():
                    fit = batch if (lengths == n).all() else batch.filter(pa.array(lengths == n))
                    if not fit.num_rows:
                        continue
                    vectors = np.asarray(fit["embedding"].flatten(), np.float64).reshape(fit.num_rows, n)
                    running = best.setdefault(n, Running(matrix.shape[1], k, fit.schema.field("doc_id").type))
                    step = max(1, (1 << 21) // matrix.shape[1])
                    for at in range(0, len(vectors), step):
                        scores = vectors[at : at + step] @ matrix
                        running.add(scores if digits is None else np.round(scores, digits), fit["doc_id"].slice(at, step))
            task = TaskContext.get().partitionId()
            for n, running in best.items():
                names, whole = shared.value[n][0], running.merge()
                for part in whole.to_batches(max_chunksize=1 << 16):
                    at = part["query"].to_numpy()
                    columns = [pa.array(np.full(len(at), task, np.int32)), pa.array(names[at, 0]), pa.array(names[at, 1].astype(np.int32)), part["id"], part["score"]]
                    yield pa.RecordBatch.from_arrays(columns, names=["task", "block", "q", "doc_id", "score"])

        best = merged(rows.mapInArrow(local, spec), ["block", "q"], [F.col("score").desc(), F.col("doc_id").desc()], k)
        named = best.join(F.broadcast(mine.select("block", "q", "topic_id")), ["block", "q"])
        return named.select("topic_id", "doc_id", "score", "rank"), shared

    groups = passes(held, "embedding", block_bytes, max(1, state_rows // k)) or [[]]
    if len(groups) == 1:
        return search(groups[0])[0]
    parts = []
    for blocks in groups:
        found, shared = search(blocks)
        parts.append(materialize(found, "search-results"))
        shared.destroy()
    return reduce(DataFrame.unionByName, parts)


def judged_run(run: DataFrame, qrels: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The run with integer grades (0 if unjudged), and the judgments of the topics in the run.

    A topic without a run isn't scored; one without judgments neither.
    """
    topics = run.select("topic_id").distinct()
    used = qrels.join(topics, "topic_id", "left_semi").withColumn("grade", F.col("grade").cast("int"))
    judged = run.join(used.select("topic_id").distinct(), "topic_id", "left_semi")
    return judged.join(used, ["topic_id", "doc_id"], "left").withColumn("grade", F.coalesce("grade", F.lit(0))), used


def metrics(run: DataFrame, qrels: DataFrame, cutoffs: list[int], level: int = 1, prime: bool = False) -> DataFrame:
    """topic_id, ndcg_K and map_K for each cutoff.

    The gain is the grade, discounted by log2(rank + 1); average precision counts grades of at
    least ``level``.  ``prime`` ranks judged documents only.
    """
    if prime:
        run = run.join(qrels.select("topic_id", "doc_id").distinct(), ["topic_id", "doc_id"], "left_semi")
    judged, used = judged_run(run.select("topic_id", "doc_id", "score"), qrels)
    ranked = _ranked(judged).withColumn("rel", (F.col("grade") >= level).cast("int"))
    upto = Window.partitionBy("topic_id").orderBy("rank")
    ranked = ranked.withColumn("precision", F.sum("rel").over(upto) / F.col("rank"))
    gain = F.greatest(F.col("grade"), F.lit(0)) / F.log2(F.col("rank") + 1)
    got = ranked.groupBy("topic_id").agg(
        *[F.sum(F.when(F.col("rank") <= c, gain).otherwise(0.0)).alias(f"dcg_{c}") for c in cutoffs],
        *[F.sum(F.when(F.col("rank") <= c, F.col("rel") * F.col("precision")).otherwise(0.0)).alias(f"ap_{c}") for c in cutoffs],
    )
    best = used.withColumn("rank", F.row_number().over(Window.partitionBy("topic_id").orderBy(F.col("grade").desc(), "doc_id")))
    ideal = best.groupBy("topic_id").agg(
        F.sum((F.col("grade") >= level).cast("int")).alias("n_rel"),
        *[F.sum(F.when(F.col("rank") <= c, gain).otherwise(0.0)).alias(f"ideal_{c}") for c in cutoffs],
    )
    both = got.join(ideal, "topic_id")
    ratio = lambda a, b: F.when(F.col(b) > 0, F.col(a) / F.col(b)).otherwise(0.0)
    return both.select("topic_id", *[ratio(f"dcg_{c}", f"ideal_{c}").alias(f"ndcg_{c}") for c in cutoffs], *[ratio(f"ap_{c}", "n_rel").alias(f"map_{c}") for c in cutoffs])


def macro(per_topic: DataFrame) -> DataFrame:
    """The unweighted mean of every measure; nulls if there are no topics."""
    return per_topic.agg(*[F.avg(c).alias(c) for c in per_topic.columns if c != "topic_id"])
