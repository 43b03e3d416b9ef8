"""Training-side control: schedules, early stopping, each worker's share of an epoch, a cached-gradient
step over micro-batches and the optimiser.  A model is anything that gives its forward pass and the
product of a gradient with its Jacobian; no neural framework is assumed."""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence
from dataclasses import dataclass, field
from typing import Any

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.operators.folds import numbered, seeded


def linear_warmup(step: int, peak: float, warmup: int = 100) -> float:
    """The rate grows linearly to ``peak`` over ``warmup`` steps and stays."""
    return peak * min(1.0, (step + 1) / max(1, warmup))


def one_cycle(step: int, total: int, peak: float, warmup_ratio: float = 0.05, start_div: float = 25.0, end_div: float = 1e4) -> float:
    """One cosine cycle: up from peak / start_div, down to that / end_div."""
    low, rise = peak / start_div, max(1.0, warmup_ratio * total - 1)
    if step <= rise:
        return peak - (peak - low) * (1 + math.cos(math.pi * step / rise)) / 2
    done = min(1.0, (step - rise) / max(1.0, total - 1 - rise))
    last = low / end_div
    return last + (peak - last) * (1 + math.cos(math.pi * done)) / 2


def clamp_temperature(log_temperature: float, low: float = 1e-4, high: float = 1.0) -> float:
    return min(high, max(low, math.exp(log_temperature)))


@dataclass
class EarlyStopping:
    """Whether to stop after ``patience`` epochs without a better validation loss."""

    patience: int = 5
    best: float = math.inf
    waited: int = 0

    def update(self, loss: float) -> tuple[bool, bool]:
        """(is this the best so far, stop now)."""
        if loss < self.best:
            self.best, self.waited = loss, 0
            return True, False
        self.waited += 1
        return False, self.waited >= self.patience


def epoch_shares(rows: DataFrame, key: str, epoch: int, world: int, seed: int = 42) -> DataFrame:
    """``rank`` and ``step`` of each row in an epoch: disjoint shares of equal size, dealt in turn in an
    order that changes with the epoch; rows beyond the last full turn are left out."""
    found = numbered(rows, [seeded(key, seed + epoch), F.col(key)], "__n")
    found = found.where(F.col("__n") < rows.count() // world * world)
    return found.withColumn("rank", (F.col("__n") % world).cast("int")).withColumn("step", F.floor(F.col("__n") / world).cast("long")).drop("__n")


def contrastive(q: np.ndarray, p: np.ndarray, temperature: float) -> tuple[float, np.ndarray, np.ndarray]:
    """The symmetric contrastive loss of a batch of unit vectors and its gradients."""
    scores = q @ p.T / temperature
    target = np.eye(len(q))

    def side(s: np.ndarray) -> tuple[float, np.ndarray]:
        e = np.exp(s - s.max(1, keepdims=True))
        share = e / e.sum(1, keepdims=True)
        return float(-np.log(np.diag(share)).mean()), (share - target) / len(s)

    (rows, by_row), (columns, by_column) = side(scores), side(scores.T)
    gradient = (by_row + by_column.T) / (2 * temperature)
    return (rows + columns) / 2, gradient @ p, gradient.T @ q


Forward = Callable[[Sequence[Any]], np.ndarray]
Backward = Callable[[Sequence[Any], np.ndarray], dict[str, np.ndarray]]


def cached_gradient_step(forward: Forward, backward: Backward, queries: Sequence[Any], positives: Sequence[Any], micro: int, temperature: float = 0.07) -> tuple[float, dict[str, np.ndarray]]:
    """Loss and gradients of a whole batch in the memory of a micro-batch.

    All embeddings are computed first, a micro-batch at a time; the loss of the full batch gives each
    one's gradient; then every micro-batch goes backward with its own part of that.
    """
    parts = [(side, at) for side in (0, 1) for at in range(0, len(queries), micro)]
    sides = queries, positives
    q, p = (np.concatenate([forward(sides[s][at : at + micro]) for s, at in parts if s == side]) for side in (0, 1))
    loss, *by_side = contrastive(q, p, temperature)
    total: dict[str, np.ndarray] = {}
    for side, at in parts:
        for name, g in backward(sides[side][at : at + micro], by_side[side][at : at + micro]).items():
            total[name] = total[name] + g if name in total else g
    return loss, total


def clipped(gradients: dict[str, np.ndarray], most: float = 1.0) -> dict[str, np.ndarray]:
    """Gradients scaled to a common length of at most ``most``."""
    length = math.sqrt(sum(float((g * g).sum()) for g in gradients.values()))
    scale = min(1.0, most / (length + 1e-6))
    return {n: g * scale for n, g in gradients.items()}


@dataclass
class AdamW:
    """Adam with decoupled weight decay, in place on named arrays."""

    betas: tuple[float, float] = (0.9, 0.999)
    eps: float = 1e-8
    decay: float = 0.01
    step: int = 0
    moments: dict[str, tuple[np.ndarray, np.ndarray]] = field(default_factory=dict)

    def update(self, weights: dict[str, np.ndarray], gradients: dict[str, np.ndarray], rate: float) -> None:
        self.step += 1
        for name, g in gradients.items():
            m, v = self.moments.get(name, (np.zeros_like(g), np.zeros_like(g)))
            m, v = self.betas[0] * m + (1 - self.betas[0]) * g, self.betas[1] * v + (1 - self.betas[1]) * g * g
            self.moments[name] = m, v
            even = m / (1 - self.betas[0] ** self.step), v / (1 - self.betas[1] ** self.step)
            weights[name] -= rate * (even[0] / (np.sqrt(even[1]) + self.eps) + self.decay * weights[name])
