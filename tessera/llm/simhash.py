"""SimHash near-duplicates found by deletion-variant signatures.

A fingerprint has 64 bits; bit i is set if it is set in over half of the XXH64 values (seed 42) of
the text's word shingles, repeats included.  Words are maximal runs without ASCII white space in
the text with A-Z lower-cased.  To find all fingerprints within ``distance`` bits, the 64 bits are
cut into ``distance // 2 + 1`` segments: of two such fingerprints, one segment differs by one bit
at most.  Each segment is indexed once per bit with that bit deleted, so the two meet on an equal
signature, where the whole distance is verified.

Equal fingerprints are one entry of the index.  Entries that share a signature meet as a sorted
group of 64-bit numbers in one task, which emits a spanning forest of the verified links (fewer
links than members), never all pairs; a large group is cut further by exact blocks of the other
bits, at least one of which two linked fingerprints share.  The forests of all signatures connect
exactly what the links connect.

Defined results: a null text counts as empty; a text without words has fingerprint 0 and links
like any other; one of fewer words than a shingle has a single shingle; null doc_ids are never
the least of a component that has another; repeated rows give repeated results; other columns
are ignored; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.common import components, in_order, lookup, map_batches, materialize, releasing, shrink, text_or_empty

BITS = 64


def shingle_hashes(text: str, words: int, seed: int = 42) -> Iterator[np.ndarray]:
    """The XXH64 values of a text's shingles in their order, repeats included, in blocks."""
    from xxhash import xxh64_intdigest as digest

    tokens = text.encode("utf-8", "surrogatepass").lower().split()
    if not tokens:
        return
    joined = b" ".join(tokens)
    if len(tokens) <= words:
        yield np.array([digest(joined, seed)], np.uint64)
        return
    sizes = np.fromiter(map(len, tokens), np.int64, len(tokens))
    ends = np.cumsum(sizes + 1) - 1
    starts = ends - sizes
    first, last = starts[: len(tokens) - words + 1], ends[words - 1 :]
    for at in range(0, len(first), 1 << 15):
        spans = zip(first[at : at + (1 << 15)].tolist(), last[at : at + (1 << 15)].tolist(), strict=True)
        yield np.array([digest(joined[a:b], seed) for a, b in spans], np.uint64)


def majority(blocks: Iterable[np.ndarray]) -> int:
    """The bits that are set in over half of the values; 0 of none."""
    ones, n = np.zeros(BITS, np.int64), 0
    for hashes in blocks:
        ones += np.unpackbits(hashes.astype(">u8").view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
        n += len(hashes)
    return int.from_bytes(np.packbits(2 * ones > n).tobytes(), "big")


def fingerprint(text: str, words: int, seed: int = 42) -> int:
    """Unsigned fingerprint of a text; counts are kept block by block, so memory stays bounded."""
    return majority(shingle_hashes(text, words, seed))


def fingerprints(docs: DataFrame, words: int) -> DataFrame:
    """doc_id, fingerprint (the 64 bits as a signed long)."""

    def run(batch):
        found = np.array([fingerprint(t, words) for t in batch["text"].to_pylist()], np.uint64)
        return {"doc_id": batch["doc_id"], "fingerprint": found.view(np.int64)}

    return map_batches(docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text")), run, "doc_id long, fingerprint long")


def segments(distance: int) -> list[tuple[int, int]]:
    """(shift, width) of each of the distance // 2 + 1 segments."""
    n = distance // 2 + 1
    cuts = [BITS * i // n for i in range(n + 1)]
    return [(a, b - a) for a, b in zip(cuts, cuts[1:], strict=False)]


def signatures(prints: DataFrame, distance: int) -> DataFrame:
    """signature, segment, fingerprint: one row per deleted bit."""
    cuts = segments(distance)

    def run(batch):
        fp = np.asarray(batch["fingerprint"]).view(np.uint64)
        sigs = []
        for shift, width in cuts:
            part = (fp >> np.uint64(shift)) & np.uint64((1 << width) - 1)
            for bit in range(width):
                sigs.append(part & ~np.uint64(1 << bit))
        at = [(s, shift + bit) for s, (shift, width) in enumerate(cuts) for bit in range(width)]
        # 57 bits for the rest of a segment are enough from two segments on; one segment needs all 64
        where = np.repeat(np.array([64 * s + b for s, b in at], np.int32), len(fp))
        return {"place": where, "signature": np.concatenate(sigs).view(np.int64), "fingerprint": np.tile(fp, len(at)).view(np.int64)}

    return map_batches(prints.select("fingerprint"), run, "place int, signature long, fingerprint long")


def forest(group: np.ndarray, distance: int, free: list[tuple[int, int]], most: int = 2048) -> list[tuple[np.ndarray, np.ndarray]]:
    """Links that connect what the verified links among ``group`` (distinct, unsigned) connect.

    ``free`` are (shift, width) blocks of bits by which a group of over ``most`` members is cut:
    two members within ``distance`` agree in one of distance + 1 blocks at least.
    """
    if len(group) > most and len(free) > distance:
        found = []
        for shift, width in free:
            block = (group >> np.uint64(shift)) & np.uint64((1 << width) - 1)
            order = np.argsort(block, kind="stable")
            cuts = np.flatnonzero(np.diff(block[order])) + 1
            for part in np.split(group[order], cuts):
                if len(part) > 1:
                    found += forest(part, distance, [])
        return found
    found, rest = [], group
    while len(rest) > 1:
        frontier, rest = [rest[0]], rest[1:]
        while frontier and len(rest):
            x = frontier.pop()
            near = np.bitwise_count(rest ^ x) <= distance
            if near.any():
                hits = rest[near]
                found.append((np.full(len(hits), x, np.uint64), hits))
                frontier.extend(hits)
                rest = rest[~near]
    return found


def free_blocks(place: int, distance: int) -> list[tuple[int, int]]:
    """distance + 1 blocks over the bits outside the segment of ``place``."""
    shift, width = segments(distance)[place // 64]
    outside = [b for b in range(BITS) if not shift <= b < shift + width]
    blocks = []
    for part in np.array_split(outside, distance + 1):
        runs = np.split(part, np.flatnonzero(np.diff(part) > 1) + 1)
        # a block that spans the segment keeps its longer run: a part of a block agrees where the block does
        run = max(runs, key=len)
        blocks.append((int(run[0]), len(run)))
    return blocks


def links(signed: DataFrame, distance: int, small: int = 12) -> DataFrame:
    """a, b: a forest of verified links per signature."""

    def closed(place: np.ndarray, sig: np.ndarray, fp: np.ndarray) -> pa.RecordBatch:
        """All groups are whole here, and rows are sorted by place, signature and fingerprint."""
        new = np.r_[True, (place[1:] != place[:-1]) | (sig[1:] != sig[:-1])]
        begins = np.flatnonzero(new)
        sizes = np.diff(np.r_[begins, len(fp)])
        left, right = [], []
        size_of = np.repeat(sizes, sizes)
        for gap in range(1, small):
            same = np.flatnonzero((size_of[gap:] <= small) & (size_of[gap:] > gap))
            same = same[(place[same] == place[same + gap]) & (sig[same] == sig[same + gap])]
            same = same[np.bitwise_count(fp[same] ^ fp[same + gap]) <= distance]
            left.append(fp[same])
            right.append(fp[same + gap])
        for i in np.flatnonzero(sizes > small):
            at = begins[i]
            for a, b in forest(fp[at : at + sizes[i]], distance, free_blocks(int(place[at]), distance)):
                left.append(a)
                right.append(b)
        pair = np.unique(np.stack([np.concatenate(left), np.concatenate(right)]), axis=1) if left else np.zeros((2, 0), np.uint64)
        return pa.RecordBatch.from_arrays([pa.array(x.astype(np.uint64).view(np.int64)) for x in pair], names=["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, ...]] = []
        for batch in batches:
            now = tuple(np.asarray(batch[c]) for c in ("place", "signature", "fingerprint"))
            if not len(now[0]):
                continue
            change = np.flatnonzero((now[0][1:] != now[0][:-1]) | (now[1][1:] != now[1][:-1])) + 1
            if held and (now[0][0], now[1][0]) != (held[-1][0][-1], held[-1][1][-1]):
                change = np.r_[0, change]
            if not len(change):
                held.append(now)
                continue
            cut = change[-1]
            held.append(tuple(x[:cut] for x in now))
            p, s, f = (np.concatenate(x) for x in zip(*held, strict=True))
            yield closed(p, s, f.view(np.uint64))
            held = [tuple(x[cut:] for x in now)]
        if held:
            p, s, f = (np.concatenate(x) for x in zip(*held, strict=True))
            yield closed(p, s, f.view(np.uint64))

    dealt = signed.repartition("place", "signature").sortWithinPartitions("place", "signature", "fingerprint")
    return dealt.mapInArrow(releasing(lambda batches: shrink(run(batches))), "a long, b long")


def rooted(entries: DataFrame, distance: int) -> DataFrame:
    """``entries`` with ``root``, the least fingerprint (signed) that links connect with the row's own."""
    linked = links(signatures(entries.select("fingerprint").distinct(), distance), distance)
    joined = components(linked, "simhash-components").withColumnRenamed("node", "fingerprint")
    return entries.join(joined, "fingerprint", "left").withColumn("root", F.coalesce("root", "fingerprint"))


def near_groups(docs: DataFrame, words: int, distance: int) -> DataFrame:
    """doc_id, fingerprint (signed long), component_id: a row for each row of ``docs``."""
    prints = materialize(fingerprints(docs, words), "simhash-prints")
    entries = materialize(prints.groupBy("fingerprint").agg(F.min("doc_id").alias("least"), F.count(F.lit(1)).alias("n")), "simhash-entries")
    found = rooted(entries, distance)
    ids = found.groupBy("root").agg(F.min("least").alias("component_id"))
    table = materialize(found.join(ids, "root").select("fingerprint", "component_id", "n"), "simhash-table")
    total = table.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    return lookup(prints, table, ["fingerprint"], "n", total).drop("n")


BANDS, ROWS, COUNTS = 24, 5, 256
_XOR, _MUL = (np.random.default_rng(42).integers(0, 2**64, BANDS * ROWS, np.uint64) | np.uint64(k) for k in (0, 1))


def distinct(blocks: Iterable[np.ndarray]) -> np.ndarray:
    parts = [np.unique(x) for x in blocks]
    return np.unique(np.concatenate(parts)) if len(parts) > 1 else parts[0] if parts else np.zeros(0, np.uint64)


def shingle_set(text: str, words: int, seed: int = 42) -> np.ndarray:
    """The distinct XXH64 values of a text's shingles, ascending."""
    return distinct(shingle_hashes(text, words, seed))


def band_keys(shingles: np.ndarray) -> np.ndarray:
    """BANDS longs, each of ROWS min-hashes of the set: sets of similarity s share one with 1 - (1 - s**ROWS)**BANDS."""
    least = np.full(BANDS * ROWS, 2**64 - 1, np.uint64)
    for at in range(0, len(shingles), 2048):
        np.minimum(least, ((shingles[at : at + 2048, None] ^ _XOR) * _MUL).min(axis=0), out=least)
    keys = np.arange(1, BANDS + 1, dtype=np.uint64)
    for value in least.reshape(BANDS, ROWS).T:
        keys = (keys ^ value) * np.uint64(0x9E3779B97F4A7C15)
        keys ^= keys >> np.uint64(29)
    return keys.view(np.int64)


def jaccard(a: np.ndarray, b: np.ndarray) -> float:
    """Of two ascending arrays without repeats; 1 for two empty ones."""
    both = np.concatenate([a, b])
    both.sort(kind="stable")  # two ascending runs are merged
    shared = int((both[1:] == both[:-1]).sum())
    return shared / (len(both) - shared) if len(both) else 1.0


def candidates(banded: DataFrame, least: float, rest: bool) -> DataFrame:
    """a, b: pairs of sets (``sid``, of ``n`` shingles) that share a key, a < b.

    Without ``rest`` each group's least sid with every other; with it every two of different ``root``.
    Pairs are left out only where sizes, or with ``rest`` the counts of shingles by COUNTS parts of
    their values (``counts``), prove a similarity below ``least``.
    """
    columns = ["key", "sid", "n", "root", *["counts"] * rest]

    def fits(m: np.ndarray, n: np.ndarray) -> np.ndarray:
        return np.minimum(m, n) >= (least - 1e-9) * np.maximum(m, n)

    def could(i: int, j: slice, n: np.ndarray, counts: np.ndarray) -> np.ndarray:
        shared = np.minimum(counts[i], counts[j]).sum(axis=1, dtype=np.int64)  # at most so many
        return shared >= (least - 1e-9) * (n[i] + n[j] - shared)

    def stars(key: np.ndarray, sid: np.ndarray, n: np.ndarray, root: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        begins = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
        first = np.repeat(begins, np.diff(np.r_[begins, len(key)]))
        i = np.flatnonzero((first != np.arange(len(key))) & fits(n, n[first]))
        yield sid[first[i]], sid[i]

    def others(key: np.ndarray, sid: np.ndarray, n: np.ndarray, root: np.ndarray, counts: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        begins = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
        ends = np.r_[begins[1:], len(key)]
        mixed = (root[begins] != root[ends - 1]) & (ends - begins > 2)  # sorted by root; the stars have groups of two
        for at, end in zip(begins[mixed].tolist(), ends[mixed].tolist(), strict=True):
            runs = np.r_[at + np.flatnonzero(np.diff(root[at:end])) + 1, end]
            for i in range(at, int(runs[-2])):
                j = int(runs[np.searchsorted(runs, i, "right")])
                hit = sid[j:end][could(i, slice(j, end), n, counts)]
                if len(hit):
                    yield np.full(len(hit), sid[i]), hit

    def closed(parts: list[tuple[np.ndarray, ...]]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for pair in [*(others if rest else stars)(*(np.concatenate(x) for x in zip(*parts, strict=True))), None]:
            if pair is not None:
                held.append(np.sort(np.stack(pair), axis=0))
                size += held[-1].shape[1]
            if held and (pair is None or size > 1 << 18):
                found = np.unique(np.concatenate(held, axis=1), axis=1)
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in found], names=["a", "b"])
                held, size = [], 0

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, ...]] = []
        for batch in batches:
            now = tuple(np.asarray(batch[c]) for c in columns[:4])
            if rest:
                now += (np.frombuffer(b"".join(batch["counts"].to_pylist()), "<u4").reshape(-1, COUNTS),)
            if not len(now[0]):
                continue
            cut = int(np.searchsorted(now[0], now[0][-1]))  # the last key may go on
            if cut or (held and held[-1][0][-1] != now[0][-1]):
                held.append(tuple(x[:cut] for x in now))
                yield from closed(held)
                held = []
            held.append(tuple(x[cut:] for x in now))
        if held:
            yield from closed(held)

    dealt = banded.select(*columns).repartition("key").sortWithinPartitions("key", *["root"] * rest, "sid")
    return dealt.mapInArrow(releasing(run), "a long, b long").distinct()


def near_dedup(docs: DataFrame, words: int = 5, least: float = 0.8, distance: int = 4) -> DataFrame:
    """The rows of ``docs`` without near copies: of each group the row with the smallest doc_id stays.

    Texts are linked if the Jaccard similarity of their sets of shingles is at least ``least``.  Equal
    sets are one entry.  Two indexes say what to compare: the components that fingerprints within
    ``distance`` bits form, by deletion-variant signatures as in ``near_groups``, which lose no such
    pair; and bands of min-hashes, for texts as similar whose fingerprints differ in more bits.  In
    each group of either, entries are compared by the sets themselves: first the least one with the
    others, then all that this leaves in different components.  No pair is set aside for a link that
    isn't verified.  Of rows equal in doc_id and text the largest by its other columns stays.
    """
    key = F.xxhash64(text_or_empty())

    def run(batch):
        from xxhash import xxh64_intdigest as digest

        sets, prints = [], []
        for text in batch["text"].to_pylist():
            blocks = list(shingle_hashes(text, words))
            prints.append(majority(blocks))
            sets.append(distinct(blocks))
        sids = np.array([digest(s.tobytes(), 7) for s in sets], np.uint64).view(np.int64)
        prints = np.array(prints, np.uint64).view(np.int64)
        return {"doc_id": batch["doc_id"], "tid": batch["tid"], "fingerprint": prints, "sid": sids, "n": [len(s) for s in sets], "keys": [band_keys(s) for s in sets]}

    def shingled(batch):
        from xxhash import xxh64_intdigest as digest

        sets = [shingle_set(t, words) for t in batch["text"].to_pylist()]
        counts = [np.bincount((s >> np.uint64(20)).astype(np.int64) % COUNTS, minlength=COUNTS).astype("<u4").tobytes() for s in sets]
        sets = [s.tobytes() for s in sets]
        return {"sid": np.array([digest(s, 7) for s in sets], np.uint64).view(np.int64), "shingles": sets, "counts": counts}

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                pairs = zip(batch["set_a"], batch["set_b"], strict=True)
                near = [jaccard(*(np.frombuffer(x.as_buffer(), np.uint64) for x in p)) >= least for p in pairs]
                yield batch.select(["a", "b"]).filter(pa.array(near, pa.bool_()))

    def sets_of(used: DataFrame) -> DataFrame:
        tids = used.join(entries, "sid").select(F.col("first.tid").alias("tid")).distinct()
        sets = map_batches(rows.join(tids, "tid").select("text"), shingled, "sid long, shingles binary, counts binary")
        return materialize(sets.dropDuplicates(["sid"]), "near-sets")

    def verified(pairs: DataFrame, sets: DataFrame) -> DataFrame:
        sets = sets.select("sid", "shingles")
        both = pairs.join(sets.toDF("a", "set_a"), "a").join(sets.toDF("b", "set_b"), "b").select("a", "b", "set_a", "set_b")
        return materialize(both.mapInArrow(releasing(verify), "a long, b long"), "near-links")

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), key.alias("tid"), text_or_empty().alias("text"))
    prints = map_batches(rows, run, "doc_id long, tid long, fingerprint long, sid long, n int, keys array<long>")
    first = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "tid", "fingerprint")  # nulls last
    entries = materialize(prints.groupBy("sid").agg(F.min(first).alias("first"), F.first("n").alias("n"), F.first("keys").alias("keys")), "near-entries")
    found = rooted(entries.select("sid", "n", F.col("first.fingerprint").alias("fingerprint")), distance)
    alike = materialize(found.select("sid", "n", F.xxhash64("root", F.lit("simhash")).alias("key")), "near-prints")
    banded = entries.select("sid", "n", F.explode("keys").alias("key")).unionByName(alike)
    tested = materialize(candidates(banded.withColumn("root", F.col("sid")), least, False), "near-pairs")
    sets = sets_of(tested.select(F.explode(F.array("a", "b")).alias("sid")).distinct())
    joined = components(verified(tested, sets), "near-components")
    roots = joined.withColumnRenamed("node", "sid")
    banded = banded.join(roots, "sid", "left").withColumn("root", F.coalesce("root", "sid"))
    mixed = banded.groupBy("key").agg(F.min("root").alias("low"), F.max("root").alias("high"), F.count(F.lit(1)).alias("size"))
    banded = materialize(banded.join(mixed.where("low <> high AND size > 2").select("key"), "key"), "near-mixed")  # stars have groups of two
    sets = sets_of(banded.select("sid").distinct())
    left = candidates(banded.join(sets.select("sid", "counts"), "sid"), least, True).join(tested, ["a", "b"], "left_anti")
    more = verified(left, sets)
    if not more.isEmpty():
        roots = components(more.unionByName(joined.select(F.col("node").alias("a"), F.col("root").alias("b"))), "near-components").withColumnRenamed("node", "sid")
    placed = entries.join(roots, "sid", "left").withColumn("root", F.coalesce("root", "sid"))
    stay = placed.groupBy("root").agg(F.min("first").alias("s")).select(F.col("s.doc_id").alias("id"), F.col("s.tid").alias("tid"))
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")
    order = in_order(docs, docs.columns)
    whole = docs.select(row, F.col("doc_id").cast("long").alias("doc_id"), key.alias("key"), *([] if order is None else [order.alias("rank")]))
    kept = whole.join(stay, F.col("doc_id").eqNullSafe(F.col("id")) & (F.col("key") == F.col("tid")), "left_semi")
    last = F.max("row") if order is None else F.max_by("row", "rank")
    once = kept.groupBy("doc_id", "key").agg(last.alias("row"))  # of rows equal in doc_id and text
    return once.select(*[F.col(f"row.`{c}`").alias(c) for c in docs.columns])
