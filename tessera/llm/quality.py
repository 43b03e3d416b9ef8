"""Quality classifier: random Fourier features, ridge regression, isotonic calibration.

A text becomes a vector of statistics (lengths, character classes, repetition, word shapes), which
is standardised by the mean and deviation over all documents.  ``cos(W x + b)`` with Gaussian W
approximates a Gaussian kernel; each partition of the labelled documents sums its part of the
normal equations, the parts are added row by row in a shuffle, and the system of a fixed size is
solved on the driver.  Raw scores are calibrated by isotonic regression over a fixed grid of
scores, then blended with a thousandth of the raw score so that order is kept within a plateau.

Labels, languages, sources and ids never enter a vector.  Labels of held-out documents
(crc32 of the id modulo 4 equal to 2) are never read.

Defined results: a null text counts as empty and is scored like any other; of several labels of
one id their mean counts; null labels and null ids carry no label; without any label every score
is 0.5; repeated rows give repeated results; other columns are ignored; an empty table gives no
rows.
"""

from __future__ import annotations

import math
import operator
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import crc_bucket, map_batches, materialize, releasing, small_batches, text_or_empty

#: Character classes by byte: control and space, digits, upper case, lower case, sentence marks, other ASCII marks, rest.
_CLASS = np.full(256, 6, np.int64)
_CLASS[:33] = 0
_CLASS[33:128] = 5
_CLASS[48:58], _CLASS[65:91], _CLASS[97:123] = 1, 2, 3
_CLASS[[ord(c) for c in ".,;:'\"()?-"]] = 4
N_STATS = 20


def statistics(text: str) -> np.ndarray:
    """The vector of a text; shares are 0 for an empty text."""
    raw = np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8)
    classes = np.bincount(_CLASS[raw], minlength=7) / max(1, len(raw))
    words = text.split()
    n = len(words)
    counts = Counter(words)
    lines = text.split("\n")
    distinct_lines = len(set(lines))
    repeats = sum(map(operator.eq, words, words[1:]))
    second = sum(map(operator.eq, words, words[2:]))
    top = max(counts.values(), default=0)
    marked = sum(1 for w in words if not w[-1].isalnum() and w[-1] not in ".,")
    shapes = Counter(map(len, words))
    mean = sum(k * v for k, v in shapes.items()) / max(1, n)
    spread = math.sqrt(sum(v * (k - mean) ** 2 for k, v in shapes.items()) / max(1, n))
    once = sum(1 for v in counts.values() if v == 1)
    return np.array([
        math.log1p(len(text)), math.log1p(n), *classes[1:], mean, spread, repeats / max(1, n), second / max(1, n),
        top / max(1, n), math.log1p(len(counts)) / max(1.0, math.log1p(n)), once / max(1, len(counts)), marked / max(1, n),
        1 - distinct_lines / len(lines), math.log1p(len(lines)), sum(map(str.isupper, words)) / max(1, n), shapes[1] / max(1, n),
    ])


def vectors(docs: DataFrame) -> DataFrame:
    """doc_id, stats (array of N_STATS doubles)."""

    def run(batch):
        return {"doc_id": batch["doc_id"], "stats": [statistics(t) for t in batch["text"].to_pylist()]}

    return map_batches(docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text")), run, "doc_id long, stats array<double>")


@dataclass(frozen=True)
class Model:
    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    shift: np.ndarray
    coefficients: np.ndarray
    grid: np.ndarray
    calibrated: np.ndarray

    def features(self, stats: np.ndarray) -> np.ndarray:
        z = np.clip((stats - self.mean) / self.scale, -6, 6)
        wide = np.cos(z @ self.weights + self.shift) * math.sqrt(2 / self.weights.shape[1])
        return np.hstack([wide, np.ones((len(z), 1))])

    def raw(self, stats: np.ndarray) -> np.ndarray:
        return self.features(stats) @ self.coefficients

    def score(self, stats: np.ndarray) -> np.ndarray:
        raw = np.clip(self.raw(stats), self.grid[0], self.grid[-1])
        blend = (raw - self.grid[0]) / (self.grid[-1] - self.grid[0])
        return np.clip(0.999 * np.interp(raw, self.grid, self.calibrated) + 0.001 * blend, 0.0, 1.0)


def isotonic(values: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """The non-decreasing sequence nearest to ``values`` in weighted squares (pool adjacent violators)."""
    pools: list[list[float]] = []
    for v, w in zip(values.tolist(), weights.tolist(), strict=True):
        pools.append([v, w, 1])
        while len(pools) > 1 and pools[-2][0] >= pools[-1][0]:
            v2, w2, n2 = pools.pop()
            v1, w1, n1 = pools[-1]
            pools[-1] = [(v1 * w1 + v2 * w2) / (w1 + w2), w1 + w2, n1 + n2]
    return np.concatenate([np.full(n, v) for v, _, n in pools]) if pools else np.zeros(0)


def _stack(column: pa.Array) -> np.ndarray:
    return np.asarray(column.flatten()).reshape(len(column), -1)


def labelled(rows: DataFrame, labels: DataFrame, column: str = "quality", fold: Column | None = None) -> DataFrame:
    """``rows`` with ``y``: the mean label of the ids that may be learnt from."""
    use = (crc_bucket("doc_id", 4) != 2) if fold is None else fold
    known = labels.where(F.col("doc_id").isNotNull() & F.col(column).isNotNull()).groupBy(F.col("doc_id").cast("long").alias("doc_id"))
    return rows.where(use).join(known.agg(F.avg(F.col(column).cast("double")).alias("y")), "doc_id")


def fit(stats: DataFrame, labels: DataFrame, column: str = "quality", width: int = 256, bandwidth: float = 2.0, ridge: float = 1e-2, seed: int = 7, cells: int = 1000) -> Model | None:
    """``stats`` is what ``vectors`` gives, over all documents; None if no label can be learnt from."""
    at = [F.get("stats", F.lit(i)) for i in range(N_STATS)]
    moments = stats.agg(*[F.avg(c) for c in at], *[F.stddev_pop(c) for c in at]).first()
    if moments[0] is None:
        return None
    mean, scale = np.array(moments[:N_STATS]), np.array(moments[N_STATS:])
    rng = np.random.default_rng(seed)
    weights = rng.standard_normal((N_STATS, width)) / (bandwidth * math.sqrt(N_STATS))
    blank = Model(mean, np.where(scale > 1e-9, scale, 1.0), weights, rng.uniform(0, 2 * math.pi, width), np.zeros(width + 1), np.array([-0.5, 1.5]), np.zeros(2))
    train = materialize(labelled(stats, labels, column).select("stats", "y"), "quality-train")
    n = width + 1

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((n + 1, n))
        for batch in batches:
            if batch.num_rows:
                z = blank.features(_stack(batch["stats"]))
                total[:n] += z.T @ z
                total[n] += np.asarray(batch["y"]) @ z
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(n + 1)), pa.array([r.tobytes() for r in total])], names=["i", "part"])

    def add(key: tuple, table: pa.Table) -> pa.Table:
        summed = sum(np.frombuffer(p, np.float64) for p in table["part"].to_pylist())
        return pa.table({"i": pa.array([key[0].as_py()], pa.int64()), "part": pa.array([summed.tobytes()])})

    parts = train.mapInArrow(partial, "i long, part binary").groupBy("i").applyInArrow(add, "i long, part binary").collect()  # n + 1 rows
    if not parts:
        return None
    rows = [np.frombuffer(r["part"], np.float64) for r in sorted(parts, key=lambda r: r["i"])]
    gram, target = np.array(rows[:n]), rows[n]
    count = gram[-1, -1]
    if not count:
        return None
    penalty = ridge * count * np.r_[np.full(width, 1 / width), 0.0]
    fitted = Model(blank.mean, blank.scale, weights, blank.shift, np.linalg.solve(gram + np.diag(penalty), target), blank.grid, blank.calibrated)

    def cell(batch):
        raw = np.clip(fitted.raw(_stack(batch["stats"])), -0.5, 1.5)
        return {"cell": np.floor((raw + 0.5) / 2 * cells).astype(np.int64), "y": batch["y"]}

    binned = map_batches(train, cell, "cell long, y double").groupBy("cell").agg(F.sum("y").alias("s"), F.count(F.lit(1)).alias("n")).collect()  # cells + 1 rows at most
    binned = sorted((r["cell"], r["s"], r["n"]) for r in binned)
    where = np.array([(c + 0.5) / cells * 2 - 0.5 for c, _, _ in binned])
    weight = np.array([float(m) for _, _, m in binned])
    level = isotonic(np.array([s for _, s, _ in binned]) / weight, weight)
    grid = np.r_[-0.5, where, 1.5]
    return Model(blank.mean, blank.scale, weights, blank.shift, fitted.coefficients, grid, np.r_[level[0], level, level[-1]])


def scored(stats: DataFrame, model: Model | None) -> DataFrame:
    """doc_id, score."""

    def run(batch):
        return {"doc_id": batch["doc_id"], "score": model.score(_stack(batch["stats"])) if model else np.full(batch.num_rows, 0.5)}

    return map_batches(stats, run, "doc_id long, score double")


def classify(docs: DataFrame, labels: DataFrame, threshold: float = 0.7) -> DataFrame:
    """doc_id, held_out, score, predicted."""
    stats = materialize(vectors(docs), "quality-stats")
    found = scored(stats, fit(stats, labels))
    return found.select("doc_id", (crc_bucket("doc_id", 4) == 2).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def keep_good(docs: DataFrame, labels: DataFrame, threshold: float = 0.7) -> DataFrame:
    """The rows of ``docs`` whose score reaches ``threshold``, unchanged.  Without any label there is no
    classifier that could reject a row, and all stay."""
    model = fit(materialize(vectors(docs), "quality-stats"), labels)
    if model is None:
        return docs
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                stats = np.array([statistics(t or "") for t in batch.column(at).to_pylist()])
                yield batch.filter(pa.array(model.score(stats) >= threshold))

    small_batches(docs.sparkSession)
    return docs.mapInArrow(releasing(run), docs.schema)
