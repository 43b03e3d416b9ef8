"""The symmetric contrastive loss over batches of pairs."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BLOCK = 512  # queries whose similarities to all positives of their batch are held at a time


@dataclass
class LogSums:
    """Logarithms of sums of exponentials, as a maximum and a sum scaled by it; parts merge in any order."""

    top: np.ndarray
    scaled: np.ndarray

    @staticmethod
    def of(values: np.ndarray, axis: int) -> LogSums:
        top = values.max(axis)
        return LogSums(top, np.exp(values - np.expand_dims(top, axis)).sum(axis))

    def merged(self, other: LogSums) -> LogSums:
        top = np.maximum(self.top, other.top)
        return LogSums(top, self.scaled * np.exp(self.top - top) + other.scaled * np.exp(other.top - top))

    @property
    def value(self) -> np.ndarray:
        return self.top + np.log(self.scaled)


def batch_loss(q: np.ndarray, p: np.ndarray, temperature: float, block: int = BLOCK) -> float:
    """The mean of the cross-entropies of rows and columns of the similarities, which are computed once, by blocks."""
    columns, rows, own = None, [], []
    for at in range(0, len(q), block):
        s = q[at : at + block] @ p.T / temperature
        part = LogSums.of(s, 0)
        columns = part if columns is None else columns.merged(part)
        rows.append(LogSums.of(s, 1).value)
        own.append(np.diagonal(s, at))
    diagonal = np.concatenate(own)
    return float(((np.concatenate(rows) - diagonal).mean() + (columns.value - diagonal).mean()) / 2)


def info_nce(pairs: DataFrame, temperature: float = 0.07) -> DataFrame:
    """batch_id, n_pairs, loss for rows (batch_id, position, q, p).

    Each query is compared with every positive of its batch.  One shuffle brings a batch, whose size is fixed,
    together; one matrix product gives its similarities, ``BLOCK`` rows at a time, and row and column sums are
    merged over the blocks.  Pairs that lack a side are left out.
    """

    def loss(batch: pa.Table) -> pa.Table:
        sides = [np.asarray(batch[c].combine_chunks().flatten(), np.float64).reshape(batch.num_rows, -1) for c in ("q", "p")]
        return pa.table({"batch_id": batch["batch_id"].slice(0, 1), "n_pairs": pa.array([batch.num_rows], pa.int64()), "loss": pa.array([batch_loss(*sides, temperature)])})

    rows = pairs.select("batch_id", *[F.col(c).cast("array<double>").alias(c) for c in ("q", "p")]).where(F.col("q").isNotNull() & F.col("p").isNotNull())
    kind = pairs.schema["batch_id"].dataType.simpleString()
    return rows.groupBy("batch_id").applyInArrow(loss, f"batch_id {kind}, n_pairs long, loss double")


def mean_loss(losses: DataFrame) -> DataFrame:
    """The mean over batches, not over pairs."""
    return losses.agg(F.avg("loss").alias("loss"), F.count(F.lit(1)).alias("n_batches"))
