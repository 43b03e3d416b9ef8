"""Hard-negative mining by bit-sliced integer products.

Components are integers x = floor(256 * component).  A row is the sum of its bit-planes (two's
complement, so the top one counts negatively).  Against an anchor a, the planes above bit r give the
exact product with the rest still missing; the rest of a component lies between 0 and 2^r - 1, so the
score lies in

    [known - (2^r - 1) * N(a), known + (2^r - 1) * P(a)]

with P and N the sums of the anchor's positive and negated negative components.  A tile of anchors and
rows takes the planes one by one, most significant first: each plane is one product of the anchors
with a matrix of bits, every plane halves the intervals, and a pair goes as soon as its interval can't
meet what the anchor still needs.  Rows that no anchor of the tile needs leave the tile; once few pairs
are left, the remaining planes are taken pair by pair.  Products run in the narrowest type in which
all sums are exact, so scores are exact integers.

Two searches share this:

1. *Positives*: each anchor's first k other rows of its label.  What it needs is at least the k-th best
   score so far, or the k-th largest lower end in the tile.
2. *Negatives*: for each positive's score p, the first k rows of other labels with
   low * p <= 100 * score <= 100 * p.  Equal scores of one anchor share a window.  What a window needs
   lies in it and is at least the k-th best score that the window has so far.

Anchors are written in blocks and broadcast, at most ``block_bytes`` at a time; a task holds k rows for
each anchor (or window) and hands on no more than that, and the tasks' results meet in a tree.  No pair
of rows ever becomes a row of a table.

Defined results: rows with a null label, a null vector, or a null or non-finite component take no
part; a null id is never an anchor, and its row comes after all others of an equal score.  A row never
counts as a positive or negative of an anchor of the same id.  Anchors that share an id are told apart by their
label and vector; those that share them too are one anchor.  Repeated rows are candidates of their own.
An anchor without positives, and a positive without negatives, give no row.  Rows are compared with
anchors of their own vector length only; empty vectors score 0.  An empty table gives no rows, and
columns of other names are ignored.  Products beyond 55 bits raise ArithmeticError.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import materialize, releasing, small_batches
from tessera.operators.retrieval import blocked, merged, passes

TILE = 128  # anchors that share a matrix of bits
FEW = 0.02  # share of pairs from which on planes are taken pair by pair
LAST = 2**63 - 1  # stands for a null id, so that it comes last


def integers(rows: DataFrame, scale: int = 256) -> DataFrame:
    """vec_id, label, x of the rows that take part: x = floor(scale * component)."""
    whole = F.transform("embedding", lambda c: c.cast("double"))
    finite = F.forall(whole, lambda c: F.coalesce(~F.isnan(c) & (F.abs(c) < float("inf")), F.lit(False)))
    rows = rows.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("long").alias("label"), "embedding")
    rows = rows.where(F.col("label").isNotNull() & F.col("embedding").isNotNull() & finite)
    return rows.select("vec_id", "label", F.transform(whole, lambda c: F.floor(c * scale).cast("long")).alias("x"))


def exact_type(a: np.ndarray, x: np.ndarray) -> type:
    """The narrowest type in which no sum of products of their components, or part of it, is rounded."""
    most = lambda v: max(1, -int(v.min(initial=0)), int(v.max(initial=0)) + 1)
    bound = 4 * most(a) * most(x) * max(1, a.shape[1])
    if bound < 1 << 24:
        return np.float32
    if bound < 1 << 53:
        return np.float64
    if bound < 1 << 55:  # a hundredfold score still fits a long
        return np.int64
    raise ArithmeticError("products of these vectors don't fit 55 bits")


class Rows:
    """A batch's vectors of one length, with the bit-planes of their components."""

    def __init__(self, x: np.ndarray) -> None:
        self.x = x
        self.bits = max(int(x.max(initial=0)).bit_length(), int(~x.min(initial=0)).bit_length()) + 1  # with the sign

    def plane(self, bit: int, at: np.ndarray, kind: type) -> np.ndarray:
        return ((self.x[at] >> bit) & 1).astype(kind)

    def weight(self, bit: int) -> int:
        return -(1 << bit) if bit == self.bits - 1 else 1 << bit


def survivors(anchors: np.ndarray, rows: Rows, at: np.ndarray, needed: Callable[[np.ndarray, np.ndarray, np.ndarray], np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Anchor, row and exact score of the pairs of a tile that ``needed`` keeps to the end.

    ``at`` are the tile's rows.  ``needed(anchor, low, high)`` gets intervals, as a matrix with the anchors' numbers as a
    column or pair by pair, and says which may still be needed.
    """
    kind = exact_type(anchors, rows.x)
    a = anchors.astype(kind)
    above, below = np.maximum(anchors, 0).sum(1), np.maximum(-anchors, 0).sum(1)
    every = np.arange(len(a))[:, None]
    known = np.zeros((len(a), len(at)), kind)
    pairs: tuple[np.ndarray, np.ndarray] | None = None
    for bit in range(rows.bits - 1, -1, -1):
        rest = (1 << bit) - 1
        weight = kind(rows.weight(bit))
        if pairs is None:
            known += weight * (a @ rows.plane(bit, at, kind).T)
            alive = needed(every, known - kind(rest) * below.astype(kind)[:, None], known + kind(rest) * above.astype(kind)[:, None])
            if bit and np.count_nonzero(alive) < FEW * alive.size:
                pairs = np.nonzero(alive)
                known = known[pairs]
            elif bit:
                stay = alive.any(axis=0)
                if np.count_nonzero(stay) < 0.75 * len(stay):
                    at, known, alive = at[stay], known[:, stay], alive[:, stay]
        else:
            i, j = pairs
            for k in range(0, len(i), 1 << 16):
                part = slice(k, k + (1 << 16))
                known[part] += weight * np.einsum("pd,pd->p", a[i[part]], rows.plane(bit, at[j[part]], kind))
            alive = needed(i, known - kind(rest) * below.astype(kind)[i], known + kind(rest) * above.astype(kind)[i])
            pairs, known = (i[alive], j[alive]), known[alive]
    if pairs is None:
        pairs = np.nonzero(alive)
        known = known[pairs]
    return pairs[0], at[pairs[1]], known.astype(np.int64)


class Best:
    """The k best (score, id) of each of n windows so far: by score, descending, then id."""

    def __init__(self, n: int, k: int) -> None:
        self.k = k
        self.window, self.score, self.id = (np.zeros(0, np.int64) for _ in range(3))
        self.edge = np.full(n, -(1 << 62))  # a score below it isn't among the k best

    def add(self, window: np.ndarray, score: np.ndarray, ids: np.ndarray) -> None:
        if not len(window):
            return
        touched = np.zeros(len(self.edge), bool)
        touched[window] = True
        old = touched[self.window]
        w, s, d = (np.concatenate([mine[old], new]) for mine, new in ((self.window, window), (self.score, score), (self.id, ids)))
        order = np.lexsort((d, -s, w))
        w, s, d = w[order], s[order], d[order]
        rank = np.arange(len(w)) - np.searchsorted(w, w)
        last = rank == self.k - 1
        self.edge[w[last]] = s[last]
        keep = rank < self.k
        self.window, self.score, self.id = (np.concatenate([mine[~old], new[keep]]) for mine, new in ((self.window, w), (self.score, s), (self.id, d)))


def first_positives(anchors: dict, best: Best, rows: Rows, ids: np.ndarray, labels: np.ndarray) -> None:
    """Show a batch's rows to the anchors of their labels (window = anchor)."""
    sure = best.k - 1 + int(np.unique(ids, return_counts=True)[1].max())  # so many besides those of the anchor's own id
    for label in np.unique(labels):
        mine, at = np.flatnonzero(anchors["label"] == label), np.flatnonzero(labels == label)
        for tile in (mine[n : n + TILE] for n in range(0, len(mine), TILE)):
            edge = best.edge[tile]

            def needed(i: np.ndarray, low: np.ndarray, high: np.ndarray, edge: np.ndarray = edge) -> np.ndarray:
                if low.ndim == 2 and low.shape[1] > sure:
                    np.maximum(edge, -np.partition(-low, sure, axis=1)[:, sure].astype(np.int64), out=edge)
                return high >= edge[i].astype(high.dtype)

            i, j, score = survivors(anchors["x"][tile], rows, at, needed)
            other = ids[j] != anchors["id"][tile[i]]
            best.add(tile[i[other]], score[other], ids[j[other]])


def windowed_negatives(anchors: dict, best: Best, rows: Rows, ids: np.ndarray, labels: np.ndarray) -> None:
    """Show a batch's rows to the windows of the anchors of other labels."""
    for label in np.unique(anchors["label"]):
        mine, at = np.flatnonzero(anchors["label"] == label), np.flatnonzero(labels != label)
        for tile in (mine[n : n + TILE] for n in range(0, len(mine) if len(at) else 0, TILE)):
            windows = anchors["windows"][tile]  # numbers of windows, -1 where an anchor has fewer
            least = np.where(windows < 0, 1 << 62, np.maximum(anchors["low"][windows], best.edge[windows]))
            most = np.where(windows < 0, -(1 << 62), anchors["high"][windows])

            def needed(i: np.ndarray, low: np.ndarray, high: np.ndarray, least: np.ndarray = least, most: np.ndarray = most) -> np.ndarray:
                alive = np.zeros(low.shape, bool)
                for w in range(least.shape[1]):
                    alive |= (high >= least[i, w].astype(high.dtype)) & (low <= most[i, w].astype(low.dtype))
                return alive

            i, j, score = survivors(anchors["x"][tile], rows, at, needed)
            other = ids[j] != anchors["id"][tile[i]]
            for w in range(windows.shape[1]):
                fit = other & (score >= least[i, w]) & (score <= most[i, w])
                best.add(windows[i[fit], w], score[fit], ids[j[fit]])


def _search(rows: DataFrame, shared: Broadcast, show: Callable, windows: str, k: int) -> DataFrame:
    """task, block, q, w, score, id: each task's k best rows for each window of the broadcast anchors."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        best: dict[int, Best] = {}
        for batch in batches:
            lengths = np.asarray(batch["x"].value_lengths())
            for n, anchors in shared.value.items():
                fit = batch.filter(pa.array(lengths == n))
                if fit.num_rows:
                    x = np.asarray(fit["x"].flatten(), np.int64).reshape(fit.num_rows, n)
                    ids = np.asarray(fit["vec_id"].fill_null(LAST))
                    show(anchors, best.setdefault(n, Best(len(anchors[windows]) + 1, k)), Rows(x), ids, np.asarray(fit["label"]))
        task = TaskContext.get().partitionId()
        for n, found in best.items():
            of = shared.value[n][windows][found.window]
            ids = pa.array(found.id, mask=found.id == LAST)
            columns = [pa.array(np.full(len(of), task, np.int32)), pa.array(of[:, 0]), pa.array(of[:, 1]), pa.array(of[:, 2]), pa.array(found.score), ids]
            yield pa.RecordBatch.from_arrays(columns, names=["task", "block", "q", "w", "score", "id"])

    return rows.mapInArrow(releasing(run), "task int, block long, q long, w long, score long, id long")


def _anchors(rows: list[tuple], low: int) -> dict[int, dict]:
    """By vector length, from (block, q, id, label, x, scores): the anchors' arrays and their windows, one for each different score."""
    out = {}
    for n in {len(r[4]) for r in rows}:
        mine = [r for r in rows if len(r[4]) == n]
        scores = [list(dict.fromkeys(r[5])) for r in mine]
        width, total = max([1, *map(len, scores)]), sum(map(len, scores))
        windows = np.full((len(mine), width), -1, np.int64)
        at = 0
        for i, s in enumerate(scores):
            windows[i, : len(s)] = np.arange(at, at + len(s))
            at += len(s)
        p = np.array([v for s in scores for v in s] + [0], np.int64)  # the last one stands for none
        out[n] = {
            "id": np.array([r[2] for r in mine], np.int64), "label": np.array([r[3] for r in mine], np.int64),
            "x": np.array([r[4] for r in mine], np.int64).reshape(len(mine), n),
            "names": np.array([(r[0], r[1], 0) for r in mine], np.int64), "windows": windows,
            "low": -(-low * p // 100), "high": p,
            "window_names": np.array([(r[0], r[1], v) for r, s in zip(mine, scores, strict=True) for v in s], np.int64).reshape(total, 3),
        }
    return out


def mine(embeddings: DataFrame, is_anchor: Column, positives: int = 5, negatives: int = 5, low: int = 80, scale: int = 256, block_bytes: int = 16 << 20, state_rows: int = 1 << 20) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score of the rows that ``is_anchor`` names
    (over vec_id, label), with negatives from ``low`` hundredths of the positive's score up to it."""
    spark = embeddings.sparkSession
    small_batches(spark, 4096)
    rows = integers(embeddings, scale)
    anchors = rows.where(F.coalesce(is_anchor, F.lit(False)) & F.col("vec_id").isNotNull()).distinct()
    held = blocked(anchors, "x", max(1, block_bytes // 4))
    parts = []
    for blocks in passes(held, "x", block_bytes, max(1, state_rows // (positives * negatives))):
        mine = held.where(F.col("block").isin(blocks))
        named = mine.select("block", F.col("q").cast("long").alias("q"), "vec_id", "label", "x")
        known = sorted(tuple(r) for r in named.collect())  # bounded by block_bytes and state_rows
        first = spark.sparkContext.broadcast(_anchors([(*r, []) for r in known], low))
        order = [F.col("score").desc(), F.col("id").asc_nulls_last()]
        found = merged(_search(rows, first, first_positives, "names", positives).drop("w"), ["block", "q"], order, positives)
        chosen = materialize(found.select("block", "q", F.col("rank").alias("place"), F.col("id").alias("positive_id"), F.col("score").alias("positive_score")), "positives")
        first.destroy()
        scores: dict[tuple[int, int], list[int]] = {}
        for r in chosen.select("block", "q", "positive_score", "place").orderBy("block", "q", "place").collect():  # k a held anchor at most
            scores.setdefault((r[0], r[1]), []).append(r[2])
        second = spark.sparkContext.broadcast(_anchors([(*r, scores.get(r[:2], [])) for r in known], low))
        found = merged(_search(rows, second, windowed_negatives, "window_names", negatives), ["block", "q", "w"], order, negatives)
        whole = chosen.join(found, (chosen["block"] == found["block"]) & (chosen["q"] == found["q"]) & (chosen["positive_score"] == found["w"])).select(
            chosen["block"], chosen["q"], "positive_id", "rank", F.col("id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score")
        )
        whole = whole.join(F.broadcast(named.select("block", "q", F.col("vec_id").alias("anchor_id"))), ["block", "q"])
        parts.append(materialize(whole.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"), "hard-negatives"))
        second.destroy()
    if not parts:
        return spark.createDataFrame([], "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long")
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out
