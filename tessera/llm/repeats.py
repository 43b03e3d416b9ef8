"""Removal of repeated byte strings by the common-prefix interval tree of a suffix array.

A byte is removed from a document if a string of ``least`` bytes that covers it also starts in a
document with a smaller doc_id.  Strings are judged on the input and never cross documents.

Core (``maximal_repeats``): suffixes are sorted, the common prefixes of neighbours computed, and
one stack scan over them enumerates the intervals of the common-prefix tree.  An interval whose
members are preceded by different bytes is a maximal repeat; it is output with all its occurrences.

At scale the corpus is cut into chunks of about ``chunk_bytes`` and the same core runs on what can
repeat:

1. Of every window of ``least`` bytes the ``ANCHOR``-byte string with the smallest hash is an
   anchor; equal windows have equal anchors.  Each chunk sends its distinct anchor hashes, packed
   by owner, and the owner of a hash range answers with one bit each: seen in several documents.
2. For anchors that are, the chunk sends the bytes within reach of a window (each distinct one
   once) with their occurrences.  The owner sorts the suffixes that start there, scans the
   interval tree and answers with the covered bytes of each occurrence.
3. The chunk removes what is covered.

The texts move in one shuffle, which the three steps share.  Copies of a text with a thousandth of
all rows or more are combined before they move, other copies within their chunk; only the copy
with the smallest doc_id takes part, the others are repeats as a whole.  Nothing is collected.

Defined results: a null text counts as empty; a null doc_id counts as larger than all others; rows
with equal doc_ids never remove from each other; a text shorter than ``least`` bytes stays whole;
other columns are ignored, or kept by ``strip_repeats``; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import lookup, materialize, packed, releasing, small_batches, table_of, text_or_empty, unpacked

ANCHOR = 24
LONGEST = 128  # lengths round an anchor are kept in a byte
LAST = 2**63 - 1
_MIX = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93)]


def lcp_intervals(lcp: np.ndarray, least: int) -> Iterator[tuple[int, int, int]]:
    """(first, last, length) of each interval of the common-prefix tree with length >= ``least``.

    ``lcp[i]`` is the common prefix of the suffixes i - 1 and i in sorted order; children come
    before their parents.
    """
    stack: list[tuple[int, int]] = []  # (first, length), lengths increasing
    for i, now in enumerate([*lcp[1:].tolist(), 0], start=1):
        first = i - 1
        while stack and stack[-1][1] > now:
            first, length = stack.pop()
            yield first, i - 1, length
        if now >= least and (not stack or stack[-1][1] < now):
            stack.append((first, now))


def maximal_groups(lcp: np.ndarray, before: np.ndarray, least: int) -> Iterator[tuple[int, int, int]]:
    """The intervals whose suffixes are preceded by different bytes (``before``; -1 for none)."""
    if len(before) < 2:
        return
    changes = np.r_[0, np.cumsum((before[1:] != before[:-1]) | (before[1:] < 0))]
    for first, last, length in lcp_intervals(lcp, least):
        if changes[last] > changes[first]:
            yield first, last, length


def maximal_repeats(texts: list[bytes], least: int) -> list[tuple[int, list[tuple[int, int]]]]:
    """(length, [(text, position)]) of every maximal repeat of at least ``least`` bytes, in memory."""
    starts = sorted(((t, p) for t, text in enumerate(texts) for p in range(len(text) - least + 1)), key=lambda s: texts[s[0]][s[1] :])
    lcp = np.zeros(len(starts), np.int64)
    for i in range(1, len(starts)):
        (a, p), (b, q) = starts[i - 1], starts[i]
        x, y = texts[a][p:], texts[b][q:]
        n = next((k for k, (c, d) in enumerate(zip(x, y, strict=False)) if c != d), min(len(x), len(y)))
        lcp[i] = n
    before = np.array([texts[t][p - 1] if p else -1 for t, p in starts], np.int64)
    return [(length, starts[a : b + 1]) for a, b, length in maximal_groups(lcp, before, least)]


def _words(buffer: np.ndarray, n: int) -> np.ndarray:
    """The 8 bytes from each of the first ``n`` positions; 7 more bytes must follow."""
    return np.ndarray((n,), "<u8", buffer, 0, (1,)).copy()


def _anchor_hash(w0: np.ndarray, w1: np.ndarray, w2: np.ndarray) -> np.ndarray:
    h = w0 * _MIX[0] + w1 * _MIX[1] + w2 * _MIX[2]
    h ^= h >> np.uint64(32)
    h *= _MIX[3]
    h ^= h >> np.uint64(29)
    return h


def _sliding(values: np.ndarray, width: int, pick: np.ufunc) -> np.ndarray:
    span = 1
    while 2 * span <= width:
        values = pick(values[:-span], values[span:])
        span *= 2
    return pick(values[: len(values) - (width - span)], values[width - span :]) if span < width else values


class Chunk:
    """The distinct texts of a chunk in one buffer, in an order that only the rows determine."""

    def __init__(self, table: pa.Table) -> None:
        rows: dict[bytes, int] = {}
        for doc_id, text in zip(table["doc_id"].to_pylist(), table["text"].to_pylist(), strict=True):
            doc_id = LAST if doc_id is None else doc_id
            rows[text] = min(doc_id, rows.get(text, LAST))
        order = sorted(rows.items(), key=lambda r: (r[1], r[0]))
        self.docs = np.array([d for _, d in order], np.int64)
        self.ends = np.cumsum([len(t) for t, _ in order], dtype=np.int64)
        self.starts = np.r_[0, self.ends[:-1]].astype(np.int64)
        self.n = int(self.ends[-1]) if order else 0
        self.bytes = np.frombuffer(b"".join([*(t for t, _ in order), bytes(128)]), np.uint8)

    def anchors(self, least: int, block: int = 1 << 17) -> tuple[np.ndarray, np.ndarray]:
        """(position, hash) of every anchor."""
        reach = least - ANCHOR  # a window holds reach + 1 possible anchors
        whole = np.ones(self.n + 128, bool)
        for a, e in zip(self.starts.tolist(), self.ends.tolist(), strict=True):
            whole[max(a, e - least + 1) : e] = False
        whole[self.n :] = False
        found, hashes = [], []
        for i0 in range(0, self.n, block):
            i1, low = min(self.n, i0 + block), max(0, i0 - reach)
            size = min(i1 + reach, self.n) - low
            part = self.bytes[low:]
            w = _words(part, size + 16)
            h = _anchor_hash(w[:size], w[8 : size + 8], w[16 : size + 16])
            least_of = _sliding(np.r_[h, np.zeros(max(0, i1 - low + reach - size), np.uint64)], reach + 1, np.minimum)[: i1 - low]
            least_of[~whole[low:i1]] = 0
            highest = _sliding(np.r_[np.zeros(reach - (i0 - low), np.uint64), least_of], reach + 1, np.maximum)
            here = h[i0 - low : i1 - low]
            at = np.flatnonzero((highest == here) & (here > 0))
            found.append((at + i0).astype(np.int32 if self.n < 2**31 else np.int64))
            hashes.append(here[at])
        return (np.concatenate(found), np.concatenate(hashes)) if found else (np.zeros(0, np.int64), np.zeros(0, np.uint64))

    def owner(self, position: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.ends, position, side="right")


class Anchors:
    """A chunk's anchors, grouped by hash and dealt to owners."""

    def __init__(self, chunk: Chunk, least: int, owners: int) -> None:
        position, hashes = chunk.anchors(least)
        order = np.argsort(hashes, kind="stable")
        self.position, hashes = position[order], hashes[order]
        del position, order
        self.text = chunk.owner(self.position).astype(np.int32)
        new = np.r_[True, hashes[1:] != hashes[:-1]] if len(hashes) else np.zeros(0, bool)
        begins = np.flatnonzero(new)
        self.group = np.cumsum(new, dtype=np.int32) - np.int32(1)
        change = np.r_[False, self.text[1:] != self.text[:-1]][: len(hashes)] & ~new
        several = np.logical_or.reduceat(change, begins) if len(begins) else np.zeros(0, bool)
        distinct = hashes[begins]
        del hashes, new, change
        self.code = ((distinct >> np.uint64(32)) % np.uint64(owners)) << np.uint64(32) | (distinct & np.uint64(0xFFFFFFFF))
        self.order = np.argsort(self.code, kind="stable")
        self.several = several

    def by_owner(self) -> Iterator[tuple[int, np.ndarray]]:
        """(owner, indexes of its distinct hashes in the order in which they are sent)."""
        owner = (self.code[self.order] >> np.uint64(32)).astype(np.int64)
        cuts = np.flatnonzero(np.diff(owner)) + 1
        for part in np.split(self.order, cuts) if len(owner) else ():
            yield int(self.code[part[0]] >> np.uint64(32)), part


TAGS = "owner int, chunk int, n int, tags binary, several binary"
SEEN = "chunk int, owner int, n int, seen binary"
SNIPPETS = "owner int, chunk int, reach binary, content binary, which binary, position binary, doc binary"
COVERED = "chunk int, position binary, first binary, last binary"


def _send_tags(least: int, owners: int):
    def run(key: tuple, table: pa.Table) -> pa.Table:
        found = Anchors(Chunk(table), least, owners)
        at = key[0].as_py()
        return table_of(TAGS, [(o, at, len(i), found.code[i].astype("<u4").tobytes(), np.packbits(found.several[i]).tobytes()) for o, i in found.by_owner()])

    return run


def _answer_tags(key: tuple, table: pa.Table) -> pa.Table:
    """One bit for each hash: whether several documents hold it."""
    sizes = table["n"].to_pylist()
    tags = np.concatenate([np.frombuffer(b, "<u4") for b in table["tags"].to_pylist()])
    several = np.concatenate([np.unpackbits(np.frombuffer(b, np.uint8), count=n) for b, n in zip(table["several"].to_pylist(), sizes, strict=True)])
    order = np.argsort(tags, kind="stable")
    new = np.r_[True, tags[order][1:] != tags[order][:-1]]
    begins = np.flatnonzero(new)
    seen = (np.diff(np.r_[begins, len(tags)]) > 1) | np.maximum.reduceat(several[order], begins).astype(bool)
    bits = np.zeros(len(tags), bool)
    bits[order] = np.repeat(seen, np.diff(np.r_[begins, len(tags)]))
    cut = np.split(bits, np.cumsum(sizes)[:-1])
    return table_of(SEEN, [(c, key[0].as_py(), n, np.packbits(b).tobytes()) for c, n, b in zip(table["chunk"].to_pylist(), sizes, cut, strict=True)])


def _send_snippets(least: int, owners: int):
    reach = least - ANCHOR
    wide = least + reach  # bytes within reach of a window around an anchor

    def run(key: tuple, table: pa.Table, answers: pa.Table) -> pa.Table:
        if not len(table) or not len(answers):
            return table_of(SNIPPETS, [])
        chunk = Chunk(table)
        found = Anchors(chunk, least, owners)
        answer = {o: np.unpackbits(np.frombuffer(b, np.uint8), count=n).astype(bool) for o, n, b in zip(*(answers[c].to_pylist() for c in ("owner", "n", "seen")), strict=True)}
        seen = np.zeros(len(found.code), bool)
        for o, i in found.by_owner():
            seen[i] = answer[o]
        use = seen[found.group]
        position, text = found.position[use], found.text[use]
        owner = (found.code[found.group[use]] >> np.uint64(32)).astype(np.int64)
        padded = np.concatenate([np.zeros(reach, np.uint8), chunk.bytes])
        rows = []
        for o in np.unique(owner).tolist():
            mine = np.flatnonzero(owner == o)
            p, t = position[mine].astype(np.int64), text[mine]
            left = np.minimum(p - chunk.starts[t], reach).astype(np.uint8)
            right = np.minimum(chunk.ends[t] - p, least).astype(np.uint8)
            content = np.lib.stride_tricks.sliding_window_view(padded, wide)[p].copy()
            column = np.arange(wide)
            content[(column < reach - left[:, None].astype(np.int64)) | (column >= reach + right[:, None].astype(np.int64))] = 0
            full = np.ascontiguousarray(np.hstack([left[:, None], right[:, None], content]))
            _, first, which = np.unique(full.view(f"V{wide + 2}").ravel(), return_index=True, return_inverse=True)
            sent = full[first]
            order = np.argsort(p, kind="stable")
            rows.append((o, key[0].as_py(), packed(sent[:, :2]), packed(sent[:, 2:]), packed(which[order].astype("<u4")), packed(np.diff(p[order], prepend=0).astype("<u4")), packed(chunk.docs[t[order]])))
        return table_of(SNIPPETS, rows)

    return run


def _coverage(content: np.ndarray, left: np.ndarray, right: np.ndarray, doc: np.ndarray, group: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(content, first, last): bytes of distinct contents that a content of a smaller document in
    the same group shares in strings of ``least`` bytes or more; ``first`` and ``last`` are columns."""
    reach, wide = least - ANCHOR, content.shape[1]
    none = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    if not len(content):
        return none
    flat = np.concatenate([content.ravel(), np.zeros(16 * 8, np.uint8)])
    first = reach - left.astype(np.int64)
    stop = reach + right.astype(np.int64)
    count = np.maximum(stop - least - first + 1, 0)
    which = np.repeat(np.arange(len(content)), count)
    start = np.arange(len(which)) - np.repeat(np.cumsum(count) - count, count) + first[which]
    at = which * wide + start
    words = _words(flat, len(flat) - 8)

    def word(k: int, of: np.ndarray) -> np.ndarray:
        return words[at[of] + 8 * k]

    every = np.arange(len(at))
    mixed = np.zeros(len(at), np.uint64)
    full, rest = divmod(least, 8)
    for k in range(full + bool(rest)):
        w = word(k, every)
        if k == full:
            w &= np.uint64((1 << (8 * rest)) - 1)
        mixed = (mixed ^ w) * _MIX[k % 4]
        mixed ^= mixed >> np.uint64(31)
    mixed ^= group[which].astype(np.uint64) * _MIX[0]
    before = np.where(start > first[which], flat[at - 1].astype(np.int64), -1)
    # Only strings that occur more than once, after different bytes, start a maximal repeat.
    order = np.argsort(mixed, kind="stable")
    new = np.r_[True, mixed[order][1:] != mixed[order][:-1]]
    begins = np.flatnonzero(new)
    sizes = np.diff(np.r_[begins, len(order)])
    low, high = np.minimum.reduceat(before[order], begins), np.maximum.reduceat(before[order], begins)
    use = order[np.repeat((sizes > 1) & ((low != high) | (low < 0)), sizes)]
    if not len(use):
        return none
    # Enhanced suffix array of these starts.
    depth = -(-wide // 8)
    room = (stop[which] - start)[use]
    keys = []
    for k in range(depth):
        w = word(k, use)
        over = np.clip(8 * (k + 1) - room, 0, 8)  # bytes of other contents
        w = np.where(over >= 8, 0, w & (np.uint64(0xFFFFFFFFFFFFFFFF) >> (8 * np.minimum(over, 7)).astype(np.uint64)))
        keys.append(w.byteswap())
    array = np.lexsort((*keys[::-1], group[which][use]))
    use, room = use[array], room[array]
    lcp = np.zeros(len(use), np.int64)
    open_ = group[which][use][1:] == group[which][use][:-1]
    for k in range(depth):
        x = keys[k][array]
        d = x[1:] ^ x[:-1]
        same = 8 - (np.frexp(d.astype(np.float64))[1] + 7) // 8  # leading equal bytes
        same = np.where(d == 0, 8, np.clip(same, 0, 7))
        exact = (d >> np.uint64(56) == 0) & (same == 0)  # rounding may carry into the next byte
        same = np.where(exact, 1, same)
        lcp[1:] += np.where(open_, same, 0)
        open_ &= d == 0
    lcp[1:] = np.minimum(lcp[1:], np.minimum(room[1:], room[:-1]))
    docs = doc[which][use]
    best = np.zeros(len(use), np.int64)
    for a, b, length in maximal_groups(lcp, before[use], least):
        part = docs[a : b + 1]
        smallest = part.min()
        if part.max() > smallest:
            here = best[a : b + 1]
            here[(part > smallest) & (here < length)] = length
    hit = best > 0
    return which[use][hit], start[use][hit], (start[use] + best)[hit]


def _covered(full: np.ndarray, which: np.ndarray, doc: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(occurrence, first, last): what of each occurrence is covered.

    ``full`` holds contents, their reach to the left and right in front; ``which`` and ``doc`` are the
    occurrences' contents and documents.  All contents around an anchor must be there.
    """
    reach = least - ANCHOR
    _, first, inverse = np.unique(full.view(f"V{full.shape[1]}").ravel(), return_index=True, return_inverse=True)
    full, which = full[first], inverse[which]
    least_doc = np.full(len(full), LAST, np.int64)
    np.minimum.at(least_doc, which, doc)
    left, right, content = full[:, 0], full[:, 1], full[:, 2:]
    # An occurrence in a larger document than its content's least is a repeat as a whole.
    copy = (doc > least_doc[which]) & (left[which].astype(np.int64) + right[which] >= least)
    out_at = [np.flatnonzero(copy)]
    out_first = [(reach - left[which].astype(np.int64))[copy]]
    out_last = [(reach + right[which].astype(np.int64))[copy]]
    # The rest shares strings with other contents around the same anchor.
    _, group, counts = np.unique(_anchors_of(full, reach), return_inverse=True, return_counts=True)
    mixed = np.flatnonzero(counts[group] > 1)
    hit, a, b = _coverage(content[mixed], left[mixed], right[mixed], least_doc[mixed], group[mixed], least)
    hit = mixed[hit]
    # Each occurrence of a content in its least document gets all of the content's parts.
    own = np.flatnonzero(~copy)
    own = own[np.argsort(which[own], kind="stable")]
    begin, end = np.searchsorted(which[own], hit, side="left"), np.searchsorted(which[own], hit, side="right")
    n = end - begin
    part = np.repeat(np.arange(len(hit)), n)
    occurrence = own[np.arange(len(part)) - np.repeat(np.cumsum(n) - n, n) + begin[part]] if len(part) else np.zeros(0, np.int64)
    return np.concatenate([*out_at, occurrence]), np.concatenate([*out_first, a[part]]), np.concatenate([*out_last, b[part]])


def _anchors_of(full: np.ndarray, reach: int) -> np.ndarray:
    anchor = np.ascontiguousarray(full[:, 2 + reach : 2 + reach + ANCHOR]).view("<u8")
    return _anchor_hash(anchor[:, 0].copy(), anchor[:, 1].copy(), anchor[:, 2].copy())


def _answer_snippets(least: int, part_bytes: int = 4 << 20):
    """The contents are compared by parts of about ``part_bytes``; one anchor's are in one part."""
    reach = least - ANCHOR
    wide = least + reach

    def run(key: tuple, table: pa.Table) -> pa.Table:
        fulls, which, positions, docs, sizes, base = [], [], [], [], [], 0
        for r, c, w, p, d in zip(*(table[c] for c in ("reach", "content", "which", "position", "doc")), strict=True):
            fulls.append(np.hstack([unpacked(r.as_py(), np.uint8).reshape(-1, 2), unpacked(c.as_py(), np.uint8).reshape(-1, wide)]))
            which.append(unpacked(w.as_py(), "<u4").astype(np.int64) + base)
            positions.append(np.cumsum(unpacked(p.as_py(), "<u4"), dtype=np.int64).astype("<u4"))
            docs.append(unpacked(d.as_py(), np.int64))
            sizes.append(len(which[-1]))
            base += len(fulls[-1])
        parts = -(-base * (wide + 2) // part_bytes) or 1
        dealt = [_anchors_of(f, reach) >> np.uint64(7) for f in fulls]
        part_of = np.concatenate([(h % np.uint64(parts)).astype(np.int32) for h in dealt])
        del dealt
        which, position, doc = np.concatenate(which), np.concatenate(positions), np.concatenate(docs)
        of_occurrence = part_of[which]
        begins = np.cumsum([0, *map(len, fulls)])
        found = []
        for k in range(parts):
            mine, own = np.flatnonzero(of_occurrence == k), np.flatnonzero(part_of == k)
            if len(mine):
                full = np.concatenate([f[part_of[a : a + len(f)] == k] for f, a in zip(fulls, begins.tolist(), strict=False)])
                at, first, last = _covered(full, np.searchsorted(own, which[mine]), doc[mine], least)
                found.append((mine[at], first.astype(np.uint8), last.astype(np.uint8)))
        at, first, last = (np.concatenate(x) for x in zip(*found, strict=True)) if found else (np.zeros(0, np.int64),) * 3
        ends = np.cumsum(sizes)
        order = np.argsort(at, kind="stable")
        at, first, last = at[order], first[order], last[order]
        cuts = np.searchsorted(at, ends)
        rows = []
        for c, i, j in zip(table["chunk"].to_pylist(), [0, *cuts[:-1].tolist()], cuts.tolist(), strict=True):
            if j > i:
                rows.append((c, packed(position[at[i:j]]), packed(first[i:j]), packed(last[i:j])))
        return table_of(COVERED, rows)

    return run


RESULT = "text_sha256 string, first_doc long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary"


def _remove(least: int, keep_texts: bool):
    reach = least - ANCHOR

    def run(key: tuple, table: pa.Table, covered: pa.Table) -> pa.Table:
        if not len(table):
            return table_of(RESULT, [])
        chunk = Chunk(table)
        # Parts of fewer than 2 * LONGEST anchors reach a byte, at most LONGEST of each: 16 bits hold them.
        depth = np.zeros(chunk.n + 1, np.int16)
        for p, a, b in zip(*(covered[c].to_pylist() for c in ("position", "first", "last")), strict=True):
            at = unpacked(p, "<u4").astype(np.int64) - reach
            np.add.at(depth, at + unpacked(a, np.uint8), 1)
            np.add.at(depth, at + unpacked(b, np.uint8), -1)
        gone = np.cumsum(depth, dtype=depth.dtype, out=depth)[:-1] > 0
        del depth
        rows = []
        for doc, a, e in zip(chunk.docs.tolist(), chunk.starts.tolist(), chunk.ends.tolist(), strict=True):
            cut, text = gone[a:e], chunk.bytes[a:e].tobytes()
            digest = hashlib.sha256(text).hexdigest()
            removed = int(cut.sum())
            spans, kept_digest, kept = 0, digest, text
            if removed:
                spans = int(cut[0]) + int((cut[1:] & ~cut[:-1]).sum())
                raw = chunk.bytes[a:e]
                kept_digest = hashlib.sha256(raw[~cut].tobytes()).hexdigest()
                if keep_texts:
                    kept = raw[~_whole_characters(raw, cut)].tobytes()
            rows.append((digest, None if doc == LAST else doc, len(text), removed, spans, kept_digest, kept if keep_texts else None))
        return table_of(RESULT, rows)

    return run


def _whole_characters(raw: np.ndarray, cut: np.ndarray) -> np.ndarray:
    """``cut`` without the characters of which it holds a part only."""
    begins = np.flatnonzero((raw & 0xC0) != 0x80)
    if not len(begins) or begins[0]:
        begins = np.r_[0, begins]
    whole = np.logical_and.reduceat(cut, begins)
    return np.repeat(whole, np.diff(np.r_[begins, len(raw)]))


def removals(docs: DataFrame, least: int = 50, chunk_bytes: int = 12 << 20, keep_texts: bool = False) -> tuple[DataFrame, DataFrame, int]:
    """(one row per distinct text, counts of rows per text hash, number of rows)."""
    if not ANCHOR <= least <= LONGEST:
        raise ValueError(f"least must be from {ANCHOR} to {LONGEST} bytes")
    small_batches(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text")).withColumn("_key", F.xxhash64("text"))
    counts = rows.groupBy("_key").agg(F.count(F.lit(1)).alias("n"), F.sum(F.octet_length("text")).alias("b"))
    total, volume = counts.agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.sum("b"), F.lit(0))).first()
    hot = [r[0] for r in counts.where(F.col("n") >= max(total // 1000, 2)).select("_key").collect()]  # 1000 keys at most
    chunks = max(1, -(-volume // chunk_bytes))
    owners = min(chunks, 65536)
    is_hot = F.col("_key").isin(hot) if hot else F.lit(False)
    combined = rows.where(is_hot).groupBy("_key", "text").agg(F.min("doc_id").alias("doc_id")).select("doc_id", "text", "_key")
    chunked = rows.where(~is_hot).unionByName(combined).select(F.pmod("_key", F.lit(chunks)).cast("int").alias("chunk"), "doc_id", F.col("text").cast("binary").alias("text"))
    chunked = chunked.repartition(chunks, "chunk")
    of = chunked.groupBy("chunk")
    seen = of.applyInArrow(releasing(_send_tags(least, owners)), TAGS).repartition(owners, "owner").groupBy("owner").applyInArrow(releasing(_answer_tags), SEEN)
    snippets = of.cogroup(seen.groupBy("chunk")).applyInArrow(releasing(_send_snippets(least, owners)), SNIPPETS)
    covered = snippets.repartition(owners, "owner").groupBy("owner").applyInArrow(releasing(_answer_snippets(least)), COVERED)
    return of.cogroup(covered.groupBy("chunk")).applyInArrow(releasing(_remove(least, keep_texts)), RESULT), counts, total


def removed_bytes(docs: DataFrame, least: int = 50, chunk_bytes: int = 12 << 20) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256: a row for each row of ``docs``."""
    found, _, total = removals(docs, least, chunk_bytes)
    members = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.sha2(text_or_empty(), 256).alias("text_sha256"))
    sizes = members.groupBy("text_sha256").agg(F.count(F.lit(1)).alias("n"))
    table = found.drop("kept").join(sizes, "text_sha256")
    joined = lookup(members, table, ["text_sha256"], "n", total)
    copy = ~F.col("doc_id").eqNullSafe(F.col("first_doc")) & (F.col("n_bytes") >= least)
    return joined.select(
        "doc_id", "n_bytes",
        F.when(copy, F.col("n_bytes")).otherwise(F.col("n_removed")).alias("n_removed"),
        F.when(copy, F.lit(1).cast("long")).otherwise(F.col("n_spans")).alias("n_spans"),
        F.when(copy, F.sha2(F.lit(""), 256)).otherwise(F.col("kept_sha256")).alias("kept_sha256"),
    )


def strip_repeats(docs: DataFrame, least: int = 50, chunk_bytes: int = 12 << 20) -> DataFrame:
    """The rows of ``docs`` with repeats cut from their texts and ``n_chars``, if there, counted anew.

    A character of which only a part is covered stays.  Null texts stay null.
    """
    found, _, total = removals(docs, least, chunk_bytes, keep_texts=True)
    found = materialize(found.select("text_sha256", "first_doc", "n_bytes", "kept"), "repeats-kept")
    rest = [c for c in docs.columns if c != "text"]
    row = F.struct(F.struct(*[F.col(f"`{c}`") for c in rest]).alias("rest"), F.col("text").isNotNull().alias("given"))
    members = docs.select(row.alias("row"), F.sha2(text_or_empty(), 256).alias("text_sha256"))
    sizes = members.groupBy("text_sha256").agg(F.count(F.lit(1)).alias("n"))
    short = F.col("n_bytes") < least  # such texts stay whole; longer ones have no bound that a broadcast of hot ones could rely on
    table = found.withColumn("kept", F.when(short, F.col("kept"))).join(sizes, "text_sha256")
    joined = lookup(members, table, ["text_sha256"], "n", total)
    first = F.col("row.rest.doc_id").cast("long").eqNullSafe(F.col("first_doc")) & ~short
    texts = joined.where(first).drop("kept").join(found.select("text_sha256", "kept"), "text_sha256")
    rest_ = joined.where(~first).withColumn("kept", F.coalesce("kept", F.lit(b"")))
    whole = texts.unionByName(rest_).select("row", F.col("kept").cast("string").alias("text"))
    text = F.when(F.col("row.given"), F.col("text"))
    count = F.length(text).cast(docs.schema["n_chars"].dataType) if "n_chars" in rest else None
    return whole.select(*[text.alias(c) if c == "text" else count.alias(c) if c == "n_chars" else F.col(f"row.rest.`{c}`").alias(c) for c in docs.columns])
