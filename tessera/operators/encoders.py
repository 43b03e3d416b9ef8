"""Encoders over columns: a protocol, a hashed-token stand-in for a text model, and a graph-attention model.

No neural framework is assumed.  Any object with ``encode`` and ``dimension`` serves as an encoder;
it is pickled once per job and runs on Arrow batches.
"""

from __future__ import annotations

import dataclasses
import hashlib
import io
import itertools
import json
from collections import defaultdict
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field
from typing import Any, Protocol

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


class Encoder(Protocol):
    dimension: int

    def encode(self, values: Sequence[Any]) -> list[np.ndarray | None]:
        """One unit vector per value, None where a value can't be encoded."""


def unit(v: np.ndarray, eps: float = 1e-12) -> np.ndarray:
    """L2 normalisation along the last axis; zero vectors stay zero."""
    return v / np.maximum(np.linalg.norm(v, axis=-1, keepdims=True), eps)


@dataclass
class HashedTokenEncoder:
    """Deterministic stand-in for a text model: the masked mean of hashed token vectors, normalised.

    A token's vector has a sign in each of eight places, which the eight 16-bit numbers of its md5 give:
    the lowest bit is the sign, the rest modulo the dimension the place.  At most ``max_length`` tokens
    count, as in a truncating tokeniser, or all if it is None.
    """

    dimension: int = 256
    max_length: int | None = 256

    def vectors(self, tokens: Sequence[str]) -> np.ndarray:
        raw = b"".join(hashlib.md5(t.encode("utf-8", "surrogatepass"), usedforsecurity=False).digest() for t in tokens)
        numbers = np.frombuffer(raw, ">u2").reshape(-1, 8).astype(np.int64)
        found = np.zeros((len(tokens), self.dimension), np.int8)
        np.add.at(found, (np.arange(len(tokens))[:, None], (numbers >> 1) % self.dimension), np.where(numbers & 1, 1, -1).astype(np.int8))
        return found

    def encode(self, values: Sequence[str | None], most: int = 1 << 16) -> list[np.ndarray | None]:
        out: list[np.ndarray | None] = []
        held: list[list[str]] = []
        size = 0
        for text in values:
            held.append((text or "").lower().split(None, self.max_length or -1)[: self.max_length])
            size += len(held[-1])
            if size >= most:
                out += self._means(held, most)
                held, size = [], 0
        return out + self._means(held, most)

    def _means(self, texts: list[list[str]], most: int) -> list[np.ndarray]:
        """Each distinct token is hashed once; sums run over ``most`` tokens at a time."""
        places: defaultdict[str, int] = defaultdict(itertools.count().__next__)
        ids = np.fromiter((places[t] for tokens in texts for t in tokens), np.int64)
        vectors = self.vectors(list(places)) if places else np.zeros((1, self.dimension), np.int8)
        sizes = np.fromiter(map(len, texts), np.int64, len(texts))
        of = np.repeat(np.arange(len(texts)), sizes)
        total = np.zeros((len(texts), self.dimension), np.int64)
        for at in range(0, len(ids), most):
            rows = of[at : at + most]
            begins = np.flatnonzero(np.r_[True, rows[1:] != rows[:-1]])
            total[rows[begins]] += np.add.reduceat(vectors[ids[at : at + most]], begins, axis=0, dtype=np.int64)
        return list(unit(total / np.maximum(sizes, 1)[:, None]).astype(np.float32))


@dataclass
class TagCountEncoder:
    """Deterministic stand-in for a graph model: how often each id of the vocabulary occurs, normalised."""

    dimension: int = 81

    def encode(self, values: Sequence[Any]) -> list[np.ndarray | None]:
        return [None if g is None else unit(np.bincount(g["x"], minlength=self.dimension).astype(np.float64)).astype(np.float32) for g in values]


@dataclass
class GraphAttentionEncoder:
    """Graph attention in numpy: embedded node ids, attention layers with residuals and a layer norm
    per graph, mean and max pooling, a two-layer head, unit length.

    Weights are drawn from ``seed`` unless given; the forward pass is that of an evaluated model, so
    there is no dropout.
    """

    vocabulary: int = 81
    embedding: int = 64
    hidden: int = 128
    heads: int = 4
    layers: int = 4
    dimension: int = 256
    seed: int = 0
    weights: dict[str, np.ndarray] = field(default_factory=dict)

    def __post_init__(self) -> None:
        if self.weights:
            return
        rng = np.random.default_rng(self.seed)

        def draw(*shape: int) -> np.ndarray:
            limit = np.sqrt(6 / (shape[0] + shape[-1]))
            return rng.uniform(-limit, limit, shape)

        wide, w = self.heads * self.hidden, self.weights
        w["embed"] = draw(self.vocabulary, self.embedding)
        size = self.embedding
        for i in range(self.layers):
            w[f"{i}.project"], w[f"{i}.residual"] = draw(size, wide), draw(size, wide)
            w[f"{i}.source"], w[f"{i}.target"] = draw(self.heads, self.hidden), draw(self.heads, self.hidden)
            w[f"{i}.bias"], w[f"{i}.scale"], w[f"{i}.shift"] = np.zeros(wide), np.ones(wide), np.zeros(wide)
            size = wide
        w["head1"], w["bias1"] = draw(2 * wide, wide), np.zeros(wide)
        w["head2"], w["bias2"] = draw(wide, self.dimension), np.zeros(self.dimension)

    def _attend(self, i: int, x: np.ndarray, src: np.ndarray, dst: np.ndarray) -> np.ndarray:
        w, n = self.weights, len(x)
        h = (x @ w[f"{i}.project"]).reshape(n, self.heads, self.hidden)
        src, dst = np.r_[src, np.arange(n)], np.r_[dst, np.arange(n)]  # self loops
        score = (h * w[f"{i}.source"]).sum(-1)[src] + (h * w[f"{i}.target"]).sum(-1)[dst]
        score = np.where(score > 0, score, 0.2 * score)
        top = np.full((n, self.heads), -np.inf)
        np.maximum.at(top, dst, score)
        weight = np.exp(score - top[dst])
        total = np.zeros((n, self.heads))
        np.add.at(total, dst, weight)
        out = np.zeros_like(h)
        np.add.at(out, dst, (weight / total[dst])[..., None] * h[src])
        return out.reshape(n, -1) + w[f"{i}.bias"]

    def forward(self, graph: dict) -> np.ndarray:
        w = self.weights
        x = w["embed"][np.asarray(graph["x"], np.int64)]
        src, dst = (np.asarray(graph[k], np.int64) for k in ("src", "dst"))
        for i in range(self.layers):
            y = self._attend(i, x, src, dst) + x @ w[f"{i}.residual"]
            y = (y - y.mean()) / np.sqrt(y.var() + 1e-5)  # over the whole graph
            x = y * w[f"{i}.scale"] + w[f"{i}.shift"]
        pooled = np.concatenate([x.mean(0), x.max(0)]) @ w["head1"] + w["bias1"]
        gelu = 0.5 * pooled * (1 + np.tanh(np.sqrt(2 / np.pi) * (pooled + 0.044715 * pooled**3)))
        return unit(gelu @ w["head2"] + w["bias2"]).astype(np.float32)

    def encode(self, values: Sequence[dict | None]) -> list[np.ndarray | None]:
        return [None if g is None else self.forward(g) for g in values]


ENCODERS = {"hashed": HashedTokenEncoder, "graph": GraphAttentionEncoder}


def save(encoder: Encoder, path: str, **extra: Any) -> None:
    """A checkpoint: one file with the encoder's settings, its weights and ``extra`` (epoch, loss and so on)."""
    kind = next(n for n, c in ENCODERS.items() if type(encoder) is c)
    settings = {f.name: getattr(encoder, f.name) for f in dataclasses.fields(encoder) if f.name != "weights"}
    with open(path, "wb") as out:
        np.savez(out, __settings__=np.array(json.dumps({"kind": kind, "settings": settings, "extra": extra})), **getattr(encoder, "weights", {}))


def load(path: str) -> tuple[Encoder, dict[str, Any]]:
    """The encoder of a checkpoint and what was kept with it; it reaches the executors as a broadcast of ``encode_column``."""
    with open(path, "rb") as source, np.load(io.BytesIO(source.read())) as found:
        known = json.loads(str(found["__settings__"]))
        weights = {n: found[n] for n in found.files if n != "__settings__"}
    settings = known["settings"] | ({"weights": weights} if weights else {})
    return ENCODERS[known["kind"]](**settings), known["extra"]


def encode_batch(encoder: Encoder, values: Sequence[Any]) -> tuple[np.ndarray, np.ndarray]:
    """The vectors of the values that can be encoded, and which those are."""
    found = encoder.encode(values)
    mask = np.array([v is not None for v in found], bool)
    return np.array([v for v in found if v is not None], np.float32).reshape(-1, encoder.dimension), mask


def encode_column(rows: DataFrame, encoder: Encoder, column: str, keep: list[str], alias: str = "embedding", batch_size: int | None = None) -> DataFrame:
    """``keep`` and the nullable embedding (array<float>) of ``column``; at most ``batch_size`` values go to the encoder at once."""
    chosen = rows.select(*keep, F.col(column).alias("_value"))
    kept = rows.select(*keep).schema
    spec = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept) + f", `{alias}` array<float>"
    shared = rows.sparkSession.sparkContext.broadcast(encoder)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, batch_size or max(1, whole.num_rows)):
                batch = whole.slice(at, batch_size)
                vectors = shared.value.encode(batch["_value"].to_pylist())
                encoded = pa.array([None if v is None else v.tolist() for v in vectors], pa.list_(pa.float32()))
                yield pa.RecordBatch.from_arrays([*batch.columns[:-1], encoded], names=[*batch.schema.names[:-1], alias])

    return chosen.mapInArrow(run, spec)
