"""Language-model scoring by context-tree weighting of binary-decomposed bytes.

A text becomes its words (lower-cased, split at ASCII white space) joined by spaces and closed by
an end byte.  Each byte is eight binary decisions; every decision has a context tree over the
``DEPTH`` bytes before.  A node holds the Krichevsky-Trofimov estimate of its counts, and its
weighted probability is half its own estimate plus half the product of its children's, so all
depths are mixed.  The trained weights give the probability of each further bit along its context
path; a context that was never seen hands over to the deepest one that was.

At scale the counts are those of distinct strings of ``DEPTH`` + 1 bytes.  Each task sends what it
counted, packed by owner of the last two context bytes; pairs of bytes that make up 1/``HEAVY`` of
the corpus or more (``HEAVY`` at most, by a count over all texts) are dealt by the third byte as
well, so the commonest pair is no owner's alone.  The owners sum and keep the model as a table in
the shared folder, with the sums for the nodes above (65,280 rows at most, and as many for heavy
pairs), which is all the driver sees.  For scoring, each chunk of texts asks the owners for the
distinct strings it holds and gets back their code lengths, to 1/1024 bit; nothing that grows with
the corpus is broadcast.

The same exchange counts words, for a unigram base score.  Words are told apart by a 64-bit hash.

Defined results: a null text counts as empty: its end alone is scored; learning takes the rows of
``train``; without any, each bit costs one bit and the base is a uniform guess; repeated rows give
repeated results; other columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import crc_bucket, materialize, packed, packed_sorted, releasing, small_batches, table_of, text_or_empty, unpacked, unpacked_sorted

DEPTH = 7
TOP = 2  # owners hold whole subtrees below the last TOP context bytes, or one more if those are heavy
HEAVY = 256
END = b"\n"
SLICE = 1 << 18
UNITS = 1024  # of a bit
LN2 = math.log(2)


def _log_gamma(z: np.ndarray) -> np.ndarray:
    product = z * (z + 1) * (z + 2) * (z + 3) * (z + 4) * (z + 5) * (z + 6) * (z + 7)
    y = z + 8
    return (y - 0.5) * np.log(y) - y + 0.5 * math.log(2 * math.pi) + 1 / (12 * y) - 1 / (360 * y**3) + 1 / (1260 * y**5) - np.log(product)


_SMALL = 4096
_HALF = _log_gamma(np.arange(_SMALL) + 0.5) - 0.5 * math.log(math.pi)
_FULL = _log_gamma(np.arange(1, _SMALL + 1, dtype=np.float64))


def log_kt(zeros: np.ndarray, ones: np.ndarray) -> np.ndarray:
    """Natural logarithm of the Krichevsky-Trofimov probability of a sequence with these counts."""
    total = zeros + ones
    value = _HALF[np.minimum(zeros, _SMALL - 1)] + _HALF[np.minimum(ones, _SMALL - 1)] - _FULL[np.minimum(total, _SMALL - 1)]
    large = np.flatnonzero(total >= _SMALL)
    if len(large):
        z, o, t = (x[large].astype(np.float64) for x in (zeros, ones, total))
        value[large] = _log_gamma(z + 0.5) + _log_gamma(o + 0.5) - math.log(math.pi) - _log_gamma(t + 1)
    return value


@dataclass
class Tree:
    """One decision's nodes, depth by depth; ``parent[d]`` maps depth d + 1 to depth d."""

    zeros: dict[int, np.ndarray]
    ones: dict[int, np.ndarray]
    odds: dict[int, np.ndarray]  # log of own estimate over product of children
    weighted: np.ndarray  # log probability at depth TOP
    below: np.ndarray  # that of the children of the nodes at depth TOP, summed
    parent: dict[int, np.ndarray]
    prefix: np.ndarray  # decision (8 bits) and last TOP bytes of the nodes at depth TOP
    order: np.ndarray  # of the strings
    node: np.ndarray  # at depth DEPTH, of the strings in that order


def grow(keys: np.ndarray, counts: np.ndarray, level: int) -> Tree:
    """The trees of the decisions on bit ``level`` (0: the highest) of the next byte.

    ``keys``: context bytes from the last to the farthest, then the next byte, as one number.
    """
    own = keys & np.uint64(0xFF)
    context = keys >> np.uint64(8)
    decision = (own >> np.uint64(8 - level)) | np.uint64(1 << level)
    node_key = decision << np.uint64(56) | context
    order = np.argsort(node_key, kind="stable")
    node_key = node_key[order]
    bit = ((own[order] >> np.uint64(7 - level)) & np.uint64(1)).astype(bool)
    n = counts[order]
    new = np.r_[True, node_key[1:] != node_key[:-1]]
    begins = np.flatnonzero(new)
    node = np.cumsum(new) - 1
    at = node_key[begins]
    zeros = {DEPTH: np.add.reduceat(np.where(bit, 0, n), begins)}
    ones = {DEPTH: np.add.reduceat(np.where(bit, n, 0), begins)}
    weighted = log_kt(zeros[DEPTH], ones[DEPTH])
    odds, parent = {}, {}
    for depth in range(DEPTH - 1, TOP - 1, -1):
        shortened = at >> np.uint64(8)
        new = np.r_[True, shortened[1:] != shortened[:-1]]
        begins = np.flatnonzero(new)
        parent[depth] = np.cumsum(new) - 1
        at = shortened[begins]
        zeros[depth] = np.add.reduceat(zeros[depth + 1], begins)
        ones[depth] = np.add.reduceat(ones[depth + 1], begins)
        children = np.add.reduceat(weighted, begins)
        kt = log_kt(zeros[depth], ones[depth])
        odds[depth] = kt - children
        weighted = np.logaddexp(kt, children) - LN2
    return Tree(zeros, ones, odds, weighted, children, parent, at, order, node)


@dataclass
class Upper:
    """Counts and odds of the nodes above depth TOP, by depth and node number, and of heavy pairs' nodes."""

    zeros: list[np.ndarray]
    ones: list[np.ndarray]
    odds: list[np.ndarray]
    tokens: int
    distinct: int
    heavy: np.ndarray  # whether each pair of bytes is heavy
    shared: tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]  # decision and pair, ascending; zeros, ones, odds

    @staticmethod
    def of(index: np.ndarray, zeros: np.ndarray, ones: np.ndarray, weighted: np.ndarray, tokens: int, distinct: int, heavy: np.ndarray | None = None) -> Upper:
        """``index``: decision * 256 + last byte, with ``weighted`` the sum over the children; or,
        with HEAVY_NODE added, decision * 65536 + a heavy pair."""
        heavy = np.zeros(65536, bool) if heavy is None else heavy
        pairs = index >= HEAVY_NODE
        order = np.argsort(index[pairs], kind="stable")
        key, z2, o2, w2 = (x[pairs][order] for x in (index - HEAVY_NODE, zeros, ones, weighted))
        kt = log_kt(z2, o2)
        z, o, w = (np.zeros(65536, t) for t in (np.int64, np.int64, np.float64))
        z[index[~pairs]], o[index[~pairs]], w[index[~pairs]] = zeros[~pairs], ones[~pairs], weighted[~pairs]
        for into, value in ((z, z2), (o, o2), (w, np.logaddexp(kt, w2) - LN2)):
            np.add.at(into, key >> 8, value)
        shared = key, z2, o2, kt - w2
        kt = log_kt(z, o)
        odds = kt - w
        low = np.logaddexp(kt, w) - LN2
        z0, o0 = z.reshape(256, 256).sum(1), o.reshape(256, 256).sum(1)
        return Upper([z0, z], [o0, o], [log_kt(z0, o0) - low.reshape(256, 256).sum(1), odds], tokens, distinct, heavy, shared)

    def complete(self, tree: Tree) -> None:
        """Gives the nodes of heavy pairs, of which an owner knows a part, what all owners know."""
        mine = np.flatnonzero(self.heavy[(tree.prefix & np.uint64(0xFFFF)).astype(np.int64)])
        key, *known = self.shared
        want = tree.prefix[mine].astype(np.int64)
        at = np.searchsorted(key, want)
        hit = np.append(key, -1)[at] == want
        for into, values in zip((tree.zeros[TOP], tree.ones[TOP], tree.odds[TOP]), known, strict=True):
            into[mine] = np.where(hit, np.append(values, 0)[at], 0)


HEAVY_NODE = 1 << 24


def _node(zeros: np.ndarray, ones: np.ndarray, odds: np.ndarray | None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Own probability of a one, weight of stopping here (1 at the deepest), and whether it was seen."""
    total = zeros + ones
    stop = np.ones(len(total)) if odds is None else 1 / (1 + np.exp(-np.clip(odds, -700, 700)))
    return (ones + 0.5) / (total + 1.0), stop, total > 0


def _mix(below: np.ndarray, seen: np.ndarray, node: tuple[np.ndarray, np.ndarray, np.ndarray], at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The probability of a one at nodes ``at``: their own where nothing deeper was seen, else mixed."""
    own, stop, known = (x[at] for x in node)
    return np.where(seen, own * stop + below * (1 - stop), own), known


def code_lengths(keys: np.ndarray, counts: np.ndarray, upper: Upper) -> np.ndarray:
    """Bits of the last byte of each string; ``keys`` are distinct, ascending and hold every counted string of their subtrees."""
    bits = np.zeros(len(keys))
    if not len(keys):
        return bits
    above = [_node(*x) for x in zip(upper.zeros, upper.ones, upper.odds, strict=True)]
    for level in range(8):
        tree = grow(keys, counts, level)
        upper.complete(tree)
        # One value a node is enough down from the deepest nodes: a node's path is the same for its strings.
        at = np.arange(len(tree.zeros[DEPTH]))
        p, seen = _mix(np.zeros(len(at)), np.zeros(len(at), bool), _node(tree.zeros[DEPTH], tree.ones[DEPTH], None), at)
        for depth in range(DEPTH - 1, TOP - 1, -1):
            at = tree.parent[depth][at]
            p, seen = _mix(p, seen, _node(tree.zeros[depth], tree.ones[depth], tree.odds[depth]), at)
        number = (tree.prefix >> np.uint64(8 * TOP - 8)).astype(np.int64)[at]  # decision * 256 + last byte
        for depth in range(TOP - 1, -1, -1):
            p, seen = _mix(p, seen, above[depth], number if depth else number >> 8)
        bit = ((keys[tree.order] >> np.uint64(7 - level)) & np.uint64(1)).astype(bool)
        p = p[tree.node]
        bits[tree.order] -= np.log2(np.where(bit, p, 1 - p))
    return bits


def owner_of(keys: np.ndarray, owners: int, heavy: np.ndarray) -> np.ndarray:
    dealt = keys >> np.uint64(48)
    more = np.flatnonzero(heavy[dealt.astype(np.int64)])
    dealt[more] = keys[more] >> np.uint64(40) | np.uint64(1 << 24)
    return (dealt * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(33)) % np.uint64(owners)


#: A-Z to lower case, white space to spaces; line feeds are then free to end texts.
_LOWER = bytes(32 if i == 32 or 9 <= i <= 13 else i + 32 if 65 <= i <= 90 else i for i in range(256))
_WORD_BASE = 0x9E3779B97F4A7C15  # odd, so it has an inverse modulo 2**64
_powers: dict[int, np.ndarray] = {}


def _power(base: int, n: int) -> np.ndarray:
    table = _powers.get(base, np.ones(1, np.uint64))
    while len(table) < n:
        table = np.concatenate([table, table * np.uint64(pow(base, len(table), 2**64))])
    if len(table) <= 1 << 22:
        _powers[base] = table
    return table[:n]


class Strings:
    """Byte sequences of some texts: words joined by single spaces and closed by END.

    Texts stand DEPTH ENDs apart, so the bytes before a text's first are ENDs.
    """

    def __init__(self, texts: list[str]) -> None:
        gap = END * DEPTH
        coded = [t.encode("utf-8", "surrogatepass").translate(_LOWER) for t in texts]
        raw = np.frombuffer(gap + gap.join(coded) + gap + bytes(8), np.uint8)
        sizes = np.array([len(c) for c in coded], np.int64)
        starts = DEPTH + np.r_[0, np.cumsum(sizes + DEPTH)[:-1]]
        for _ in range(2):  # spaces after spaces or an end, then spaces before an end
            space = raw == 32
            drop = space.copy()
            if _ == 0:
                drop[1:] &= space[:-1] | (raw[:-1] == END[0])
            else:
                drop[:-1] &= raw[1:] == END[0]
            if drop.any():
                before = np.r_[0, np.cumsum(~drop)]
                ends = before[starts + sizes]
                starts = before[starts]
                sizes = ends - starts
                raw = raw[~drop]
        self.buffer = np.ascontiguousarray(raw)
        self.starts, self.sizes = starts, sizes + 1  # with END
        self.n = int(starts[-1] + sizes[-1] + 1) if len(texts) else 0

    def slices(self) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(text number, key) of each byte, slice by slice."""
        for a in range(DEPTH, self.n, SLICE):
            b = min(self.n, a + SLICE)
            text = np.searchsorted(self.starts, np.array([a, b - 1]), side="right") - 1
            span = np.arange(max(text[0], 0), text[1] + 1)
            low = np.maximum(self.starts[span], a)
            high = np.minimum(self.starts[span] + self.sizes[span], b)
            n = np.maximum(high - low, 0)
            at = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(low - a, n)
            loaded = np.ndarray((b - a,), "<u8", self.buffer, a - DEPTH, (1,)).copy()[at]
            yield np.repeat(span, n), loaded << np.uint64(8) | loaded >> np.uint64(56)

    def words(self) -> tuple[np.ndarray, np.ndarray]:
        """(text number, 64-bit hash) of each word: polynomial prefix sums modulo 2**64, mixed."""
        part = self.buffer[: self.n]
        gap = (part == 32) | (part == END[0])
        first = np.flatnonzero(~gap[1:] & gap[:-1]) + 1
        last = np.flatnonzero(gap[1:] & ~gap[:-1]) + 1
        sums = np.zeros(len(part) + 1, np.uint64)
        np.cumsum((part.astype(np.uint64) + np.uint64(1)) * _power(_WORD_BASE, len(part)), out=sums[1:])
        value = (sums[last] - sums[first]) * _power(pow(_WORD_BASE, -1, 2**64), len(part))[first]
        value ^= value >> np.uint64(32)
        value *= np.uint64(0xD6E8FEB86659FD93)
        value ^= value >> np.uint64(29)
        return np.searchsorted(self.starts, first, side="right") - 1, value


def _summed(keys: list[np.ndarray] = (), counts: list[np.ndarray] = ()) -> tuple[np.ndarray, np.ndarray]:
    if not keys:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    k, c = np.concatenate(keys), np.concatenate(counts)
    order = np.argsort(k, kind="stable")
    k = k[order]
    begins = np.flatnonzero(np.r_[True, k[1:] != k[:-1]]) if len(k) else np.zeros(0, np.int64)
    return k[begins], np.add.reduceat(c[order], begins) if len(k) else c


def _distinct(parts: list[np.ndarray]) -> np.ndarray:
    """Distinct values of sorted parts, ascending; a stable sort merges the parts."""
    k = np.sort(np.concatenate(parts), kind="stable")
    return k[np.r_[True, k[1:] != k[:-1]]] if len(k) else k


def _groups(texts: list[str], size: int = 1 << 20) -> Iterator[list[str]]:
    held, volume = [], 0
    for t in texts:
        held.append(t)
        volume += len(t)
        if volume >= size:
            yield held
            held, volume = [], 0
    if held:
        yield held


END_WORD = np.zeros(1, np.uint64)  # stands for the end among the words' hashes


def _by_owner(keys: np.ndarray, owner: np.ndarray) -> dict[int, np.ndarray]:
    order = np.argsort(owner, kind="stable")
    cuts = np.flatnonzero(np.diff(owner[order].astype(np.int64))) + 1
    return {int(owner[part[0]]): part for part in np.split(order, cuts) if len(part)}


COUNTS = "owner int, keys binary, counts binary, words binary, word_counts binary"
MODEL = "owner int, keys binary, counts binary, words binary, word_counts binary, upper binary, zeros binary, ones binary, weighted binary, tokens long, distinct_words long"
ASKED = "owner int, chunk int, keys binary, words binary"
TOLD = "chunk int, owner int, bits binary, more binary, word_counts binary"
SCORES = "doc_id long, n_tokens long, n_known long, base_score double, score double, bits_per_byte double"


def _count(owners: int, heavy: np.ndarray, most: int = 3_000_000):
    def sent(keys: np.ndarray, counts: np.ndarray, words: np.ndarray, word_counts: np.ndarray) -> pa.RecordBatch:
        mine, theirs = _by_owner(keys, owner_of(keys, owners, heavy)), _by_owner(words, words % np.uint64(owners))
        none = np.zeros(0, np.int64)
        rows = []
        for o in sorted({*mine, *theirs}):
            i, j = mine.get(o, none), theirs.get(o, none)
            rows.append((o, packed_sorted(keys[i]), packed(counts[i]), packed_sorted(words[j]), packed(word_counts[j])))
        return table_of(COUNTS, rows).to_batches()[0]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: tuple[list, list] = ([], [])
        size = base = 0

        def summed() -> list[tuple[np.ndarray, np.ndarray]]:
            return [_summed(*map(list, zip(*parts, strict=True))) for parts in held]

        for batch in batches:
            for group in _groups(batch["text"].to_pylist()):
                strings = Strings(group)
                for _, k in strings.slices():
                    held[0].append(np.unique(k, return_counts=True))
                    size += len(held[0][-1][0])
                held[1].append(np.unique(strings.words()[1], return_counts=True))
                held[1].append((END_WORD, np.array([len(group)])))
                if size > base + most:
                    now = summed()
                    held, size = ([now[0]], [now[1]]), 0
                    base = len(now[0][0])
                    if base > most:
                        yield sent(*now[0], *now[1])
                        held, base = ([], []), 0
        if held[0]:
            now = summed()
            yield sent(*now[0], *now[1])

    return run


def _learn(heavy: np.ndarray):
    def run(key: tuple, table: pa.Table) -> pa.Table:
        """An owner's part of the model."""
        lists = {c: table[c].to_pylist() for c in ("keys", "counts", "words", "word_counts")}
        keys, counts = _summed([unpacked_sorted(b) for b in lists["keys"]], [unpacked(b, np.int64) for b in lists["counts"]])
        words, word_counts = _summed([unpacked_sorted(b) for b in lists["words"]], [unpacked(b, np.int64) for b in lists["word_counts"]])
        z, o, w = (np.zeros(65536, t) for t in (np.int64, np.int64, np.float64))
        shared: list[tuple[np.ndarray, ...]] = []
        if len(keys):
            for level in range(8):
                tree = grow(keys, counts, level)
                partly = heavy[(tree.prefix & np.uint64(0xFFFF)).astype(np.int64)]
                at = (tree.prefix[~partly] >> np.uint64(8 * TOP - 8)).astype(np.int64)
                z += np.bincount(at, tree.zeros[TOP][~partly], 65536).astype(np.int64)
                o += np.bincount(at, tree.ones[TOP][~partly], 65536).astype(np.int64)
                w += np.bincount(at, tree.weighted[~partly], 65536)
                shared.append((tree.prefix[partly].astype(np.int64) + HEAVY_NODE, *(x[partly] for x in (tree.zeros[TOP], tree.ones[TOP], tree.below))))
        used = np.flatnonzero(z + o)
        upper, z, o, w = (np.concatenate(x) for x in zip((used, z[used], o[used], w[used]), *shared, strict=True))
        row = (key[0].as_py(), packed_sorted(keys), packed(counts), packed_sorted(words), packed(word_counts), packed(upper), packed(z), packed(o), packed(w), int(word_counts.sum()), len(words))
        return table_of(MODEL, [row])

    return run


def heavy_pairs(texts: DataFrame) -> tuple[int, np.ndarray]:
    """Bytes of all texts, and whether each pair of neighbouring bytes (the last first) is 1/HEAVY of them or more."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = np.zeros(65536, np.int64)
        for batch in batches:
            for group in _groups(batch["text"].to_pylist()):
                raw = np.frombuffer("\n".join(group).encode("utf-8", "surrogatepass").translate(_LOWER), np.uint8)
                found += np.bincount(raw[:-1] | raw[1:].astype(np.uint16) << 8, minlength=65536)
                found[0] += len(raw) < 2  # a single byte counts too
        used = np.flatnonzero(found)
        yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(found[used])], names=["pair", "n"])

    counted = texts.mapInArrow(releasing(run), "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n")).collect()  # 65,536 rows at most
    volume, heavy = sum(r["n"] for r in counted), np.zeros(65536, bool)
    heavy[[r["pair"] for r in counted if r["n"] * HEAVY >= volume]] = True
    return volume, heavy


def train(docs: DataFrame, owners: int, heavy: np.ndarray) -> tuple[DataFrame, Upper]:
    """The model: its table, by owner, and the nodes above the owners' subtrees."""
    texts = docs.select(text_or_empty().alias("text"))
    counted = texts.mapInArrow(releasing(_count(owners, heavy)), COUNTS).repartition(owners, "owner")
    model = materialize(counted.groupBy("owner").applyInArrow(releasing(_learn(heavy)), MODEL), "ctw-model")

    def unfold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for u, z, o, w in zip(*(batch[c].to_pylist() for c in ("upper", "zeros", "ones", "weighted")), strict=True):
                arrays = [unpacked(u, np.int64), unpacked(z, np.int64), unpacked(o, np.int64), unpacked(w, np.float64)]
                yield pa.RecordBatch.from_arrays([pa.array(a) for a in arrays], names=["i", "z", "o", "w"])

    upper = model.select("upper", "zeros", "ones", "weighted").mapInArrow(unfold, "i long, z long, o long, w double")
    rows = upper.groupBy("i").agg(F.sum("z"), F.sum("o"), F.sum("w")).collect()  # 65,280 rows at most, twice
    i, z, o, w = (np.array([r[k] for r in rows]) for k in range(4)) if rows else (np.zeros(0, np.int64),) * 4
    tokens, distinct = model.agg(F.coalesce(F.sum("tokens"), F.lit(0)), F.coalesce(F.sum("distinct_words"), F.lit(0))).first()
    return model, Upper.of(i, z, o, w, tokens, distinct, heavy)


class Chunk:
    """What a chunk of rows asks for, in an order that only the rows determine.

    With ``keep``, each slice's distinct keys and where they occur are kept for scoring.
    """

    def __init__(self, table: pa.Table, owners: int, heavy: np.ndarray, keep: bool = False) -> None:
        rows = sorted(zip(table["doc_id"].to_pylist(), table["text"].to_pylist(), strict=True), key=lambda r: (r[0] is None, r[0] or 0, r[1]))
        self.ids, self.texts = [r[0] for r in rows], [r[1] for r in rows]
        self.sizes = np.zeros(len(rows), np.int64)
        self.slices: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        self.tokens: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        found, words, at = [np.zeros(0, np.uint64)], [END_WORD], 0
        for group in _groups(self.texts):
            strings = Strings(group)
            self.sizes[at : at + len(group)] = strings.sizes
            for of, parts, into in ((strings.slices(), found, self.slices), ([strings.words()], words, self.tokens)):
                for text, k in of:
                    order = np.argsort(k) if keep else None
                    k = k[order] if keep else np.sort(k)
                    new = np.r_[True, k[1:] != k[:-1]] if len(k) else np.zeros(0, bool)
                    parts.append(k[new])
                    if keep and len(k):
                        into.append((k[new], (np.cumsum(new) - 1).astype(np.int32), (text[order] + at).astype(np.int32)))
            at += len(group)
            if not keep and len(found) > 64:
                found, words = [_distinct(found)], [_distinct(words)]
        self.keys, self.words = _distinct(found), _distinct(words)
        self.by_owner = _by_owner(self.keys, owner_of(self.keys, owners, heavy))
        self.words_by_owner = _by_owner(self.words, self.words % np.uint64(owners))


def _added(into: np.ndarray, text: np.ndarray, value: np.ndarray) -> None:
    low = int(text.min())
    summed = np.bincount(text - low, value)
    into[low : low + len(summed)] += summed


def _ask(owners: int, heavy: np.ndarray):
    def run(key: tuple, table: pa.Table) -> pa.Table:
        chunk, none, rows = Chunk(table, owners, heavy), np.zeros(0, np.int64), []
        for o in sorted({*chunk.by_owner, *chunk.words_by_owner}):
            i, j = chunk.by_owner.get(o, none), chunk.words_by_owner.get(o, none)
            rows.append((o, key[0].as_py(), packed_sorted(chunk.keys[i]), packed(chunk.words[j])))
        return table_of(ASKED, rows)

    return run


def _tell(upper: Upper):
    def run(key: tuple, asked: pa.Table, model: pa.Table) -> pa.Table:
        if not len(asked):
            return table_of(TOLD, [])
        keys, counts = _summed([unpacked_sorted(b) for b in model["keys"].to_pylist()], [unpacked(b, np.int64) for b in model["counts"].to_pylist()])
        words, word_counts = _summed([unpacked_sorted(b) for b in model["words"].to_pylist()], [unpacked(b, np.int64) for b in model["word_counts"].to_pylist()])
        lists = [unpacked_sorted(b) for b in asked["keys"].to_pylist()]
        every = _distinct([keys, *lists])
        known = np.zeros(len(every), np.int64)
        known[np.searchsorted(every, keys)] = counts
        bits = np.rint(code_lengths(every, known, upper) * UNITS).astype(np.uint32)
        rows = []
        for chunk, mine, w in zip(asked["chunk"].to_pylist(), lists, asked["words"].to_pylist(), strict=True):
            w = unpacked(w, np.uint64)
            at = np.searchsorted(words, w)
            found = np.zeros(len(w), np.int64)
            if len(words):
                hit = words[np.minimum(at, len(words) - 1)] == w
                found[hit] = word_counts[at[hit]]
            told = bits[np.searchsorted(every, mine)]  # 64 bits or more are rare: their upper half packs well by itself
            rows.append((chunk, key[0].as_py(), packed(told.astype(np.uint16)), packed((told >> 16).astype(np.uint16)), packed(found)))
        return table_of(TOLD, rows)

    return run


def _score(owners: int, heavy: np.ndarray, tokens: int, distinct: int):
    total = math.log10(tokens + 0.1 * (distinct + 1))

    def run(key: tuple, table: pa.Table, told: pa.Table) -> pa.Table:
        if not len(table):
            return table_of(SCORES, [])
        chunk = Chunk(table, owners, heavy, keep=True)
        bits, counts = np.zeros(len(chunk.keys), np.int64), np.zeros(len(chunk.words), np.int64)
        for o, b, m, c in zip(*(told[x].to_pylist() for x in ("owner", "bits", "more", "word_counts")), strict=True):
            if o in chunk.by_owner:
                bits[chunk.by_owner[o]] = unpacked(b, np.uint16).astype(np.int64) + (unpacked(m, np.uint16).astype(np.int64) << 16)
            if o in chunk.words_by_owner:
                counts[chunk.words_by_owner[o]] = unpacked(c, np.int64)
        lengths, tokens_of, known, base = (np.zeros(len(chunk.ids)) for _ in range(4))
        for keys, run_of, text in chunk.slices:
            _added(lengths, text, bits[np.searchsorted(chunk.keys, keys)][run_of])
        logs, seen = np.log10(counts + 0.1) - total, counts > 0
        for words, run_of, text in chunk.tokens:
            at = np.searchsorted(chunk.words, words)
            _added(base, text, logs[at][run_of])
            _added(known, text, seen[at][run_of])
            _added(tokens_of, text, np.ones(len(text)))
        end = int(np.searchsorted(chunk.words, END_WORD[0]))
        base, known, tokens_of, lengths = base + logs[end], known + seen[end], tokens_of + 1, lengths / UNITS
        rows = list(
            zip(
                chunk.ids, tokens_of.astype(np.int64).tolist(), known.astype(np.int64).tolist(), base.tolist(),
                (-lengths * math.log10(2)).tolist(), (lengths / np.maximum(chunk.sizes, 1)).tolist(), strict=True,
            )
        )
        return table_of(SCORES, rows)

    return run


def score(docs: DataFrame, train_on: Column, chunk_bytes: int = 8 << 20) -> DataFrame:
    """doc_id, n_tokens, n_known, base_score, score, bits_per_byte, train_tokens for each row of ``docs``.

    ``train_on`` says which rows to learn from.
    """
    small_batches(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text"))
    volume, heavy = heavy_pairs(rows.select("text"))
    chunks = max(1, -(-volume // chunk_bytes))
    owners = min(chunks, 65536)
    model, upper = train(rows.where(train_on), owners, heavy)
    chunked = rows.select(F.pmod(F.xxhash64("doc_id", "text"), F.lit(chunks)).cast("int").alias("chunk"), "doc_id", "text").repartition(chunks, "chunk")
    of = chunked.groupBy("chunk")
    asked = of.applyInArrow(releasing(_ask(owners, heavy)), ASKED)
    told = asked.groupBy("owner").cogroup(model.groupBy("owner")).applyInArrow(releasing(_tell(upper)), TOLD)
    found = of.cogroup(told.groupBy("chunk")).applyInArrow(releasing(_score(owners, heavy, upper.tokens, upper.distinct)), SCORES)
    return found.withColumn("train_tokens", F.lit(upper.tokens).cast("long"))


def split(column: str = "doc_id") -> Column:
    """Held-out rows: crc32 of the id modulo 10 is 0."""
    return crc_bucket(column, 10) == 0
