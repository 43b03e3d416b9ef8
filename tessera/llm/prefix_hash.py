"""Document fingerprints from prefix polynomial hashes.

``PrefixHash`` holds modular prefix arrays of a text under two prime moduli: any span's value
follows from two entries, so spans are compared in constant time and the longest common extension
of two positions is found by binary search.

A fingerprint is the whole text's value under both moduli, its length, the values of its prefixes
at lengths that grow by a fourth root of two, and the ``size`` least mixed values of all spans of
``span`` code points (a span ends at every code point; before the text stands a run of sentinels,
so short texts have as many spans as code points).  The likeness of two fingerprints is the larger
of two shares: the Dice coefficient of the span sets as their least values estimate it, and the
common prefix, of the mean length.  A binary search over the prefix values finds between which two
lengths the prefix ends; with the texts at hand, a binary search over the prefix arrays of that
stretch finds its exact end (``common_prefix``).  The likeness is 1 for equal texts, about 3/4 if
the last quarter differs, about 0 for unrelated texts.  Two texts of which one is empty have
likeness 0, two empty ones 1.

Texts are read in blocks of ``block`` code points, so memory doesn't grow with a text's length
beyond the text itself.

``edited_pairs`` meets every document with the next one by doc_id.  Spark deals the ids and hashes
of the texts into ranges; the least of each is a boundary, ``RANGES`` at most, which is all that is
collected.  Each row goes to one range, and the first row of a range also goes to the one before,
so every pair meets in one pass over one shuffle of the texts.

Defined results: a null text counts as empty; a null doc_id counts as the least long; of equal
doc_ids the text with the lesser 64-bit hash comes first; the only document is its own next one;
other columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import arrow_schema, releasing, small_batches, text_or_empty

#: (modulus, base, inverse of the base): primes below 2**31, so products stay in 64 bits.
MODULI = [(p, b, pow(b, -1, p)) for p, b in ((2147483647, 1103515247), (2147483629, 1566083943))]
SPAN, SIZE, BLOCK = 16, 64, 1 << 19
#: Lengths of the prefixes in a fingerprint.
PREFIXES = np.unique((16 * 2 ** (np.arange(108) / 4)).astype(np.int64))
_tables: dict[tuple[int, int], np.ndarray] = {}


def powers(base: int, modulus: int, n: int) -> np.ndarray:
    """base**0 .. base**(n-1); grown by doubling and kept."""
    table = _tables.get((base, modulus))
    if table is None:
        table = np.ones(1, np.uint64)
    while len(table) < n:
        step = np.uint64(pow(base, len(table), modulus))
        table = np.concatenate([table, table * step % np.uint64(modulus)])
    if n <= 4 * BLOCK:
        _tables[base, modulus] = table
    return table[:n]


def code_points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint64)


class PrefixHash:
    """Prefix arrays of a sequence of numbers below 2**32."""

    def __init__(self, codes: np.ndarray | str) -> None:
        codes = code_points(codes) if isinstance(codes, str) else codes
        self.n = len(codes)
        self.sums = []
        for p, base, _ in MODULI:
            terms = (codes + np.uint64(1)) * powers(base, p, self.n) % np.uint64(p)
            sums = np.zeros(self.n + 1, np.uint64)
            np.cumsum(terms, out=sums[1:])
            self.sums.append(sums % np.uint64(p))

    def span(self, start: np.ndarray | int, end: np.ndarray | int) -> np.ndarray:
        """The values of spans [start, end), independent of their place: 62 bits."""
        value = np.uint64(0)
        start, end = np.asarray(start), np.asarray(end)
        for sums, (p, _, inverse) in zip(self.sums, MODULI, strict=True):
            back = powers(inverse, p, self.n + 1)[start]
            value = value << np.uint64(31) | (sums[end] + np.uint64(p) - sums[start]) * back % np.uint64(p)
        return value

    def equal(self, a: int, b: int, length: int, other: PrefixHash | None = None) -> bool:
        return bool(self.span(a, a + length) == (other or self).span(b, b + length))

    def common_extension(self, a: int, b: int, other: PrefixHash | None = None) -> int:
        """Length of the longest common prefix of the texts that start at ``a`` here and ``b`` there."""
        other = other or self
        low, high = 0, min(self.n - a, other.n - b)
        same = self.alike(other) if a == b == 0 else lambda n: self.equal(a, b, n, other)
        while low < high:
            mid = (low + high + 1) // 2
            low, high = (mid, high) if same(mid) else (low, mid - 1)
        return low

    def alike(self, other: PrefixHash):
        """Whether prefixes of a length are equal: spans from the start need no shift."""
        (a, b), (c, d) = self.sums, other.sums
        return lambda n: a[n] == c[n] and b[n] == d[n]


def _mixed(values: np.ndarray) -> np.ndarray:
    x = values * np.uint64(0x9E3779B97F4A7C15)
    x ^= x >> np.uint64(32)
    return x * np.uint64(0xD6E8FEB86659FD93) >> np.uint64(24)


def _least(values: np.ndarray, size: int) -> np.ndarray:
    for some in (2 * size, 16 * size):
        if len(values) > 2 * some:
            found = np.unique(np.partition(values, some)[:some])
            if len(found) >= size:
                return found[:size]
    return np.unique(values)[:size]


def sketch(text: str, span: int = SPAN, size: int = SIZE, block: int = BLOCK) -> tuple[tuple[int, ...], int, np.ndarray, np.ndarray]:
    """(value of the whole text under each modulus, length, least span values, prefix values)."""
    whole, least, prefixes = [0] * len(MODULI), np.zeros(0, np.uint64), [np.zeros(0, np.uint64)]
    before = np.full(span - 1, 0x110000, np.uint64)
    for at in range(0, len(text), block):
        codes = code_points(text[at : at + block])
        hashed = PrefixHash(np.concatenate([before, codes]))
        cuts = np.append(PREFIXES[(PREFIXES > at) & (PREFIXES <= at + len(codes))] - at, len(codes)) + span - 1
        joined = np.uint64(0)
        for i, (p, base, inverse) in enumerate(MODULI):
            shift = np.uint64(pow(inverse, span - 1, p) * pow(base, at, p) % p)
            sums = hashed.sums[i]
            values = ((sums[cuts] + np.uint64(p) - sums[span - 1]) % np.uint64(p) * shift + np.uint64(whole[i])) % np.uint64(p)
            whole[i] = int(values[-1])
            joined = joined << np.uint64(31) | values[:-1]
        prefixes.append(joined)
        ends = np.arange(span, hashed.n + 1)
        least = np.unique(np.concatenate([least, _least(_mixed(hashed.span(ends - span, ends)), size)]))[:size]
        before = np.concatenate([before, codes[-(span - 1) :]])[-(span - 1) :]
    return tuple(whole), len(text), least, np.concatenate(prefixes)


def as_string(s: tuple) -> str:
    whole, n, least, prefixes = s
    return "".join(f"{w:08x}" for w in whole) + f"-{n:x}-" + prefixes.astype(">u8").tobytes().hex() + "-" + least.astype(">u8").tobytes().hex()


def agreeing(a: np.ndarray, b: np.ndarray) -> int:
    """How many of the sampled prefixes of two texts agree, by binary search."""
    low, high = 0, min(len(a), len(b))
    while low < high:
        mid = (low + high + 1) // 2
        low, high = (mid, high) if a[mid - 1] == b[mid - 1] else (low, mid - 1)
    return low


def common_prefix(text: str, other: str, a: tuple, b: tuple, block: int = BLOCK) -> int:
    """Length of the longest common prefix of two texts, given their sketches."""
    known = agreeing(a[3], b[3])
    at = int(PREFIXES[known - 1]) if known else 0
    end = min(len(text), len(other), int(PREFIXES[known]) if known < len(PREFIXES) else len(text))
    while at < end:
        stop = min(end, at + block)
        if stop - at <= 64:  # arrays cost more than they save
            at += next((i for i, (x, y) in enumerate(zip(text[at:stop], other[at:stop], strict=True)) if x != y), stop - at)
            break
        n = PrefixHash(text[at:stop]).common_extension(0, 0, PrefixHash(other[at:stop]))
        at += n
        if at < stop:
            break
    return at


def likeness(a: tuple, b: tuple, size: int = SIZE, prefix: int | None = None) -> float:
    """The Dice coefficient of the span sets, estimated from the ``size`` least values of their
    union, or the share of the common prefix if that is larger; ``prefix`` is its exact length, if known."""
    if a[:2] == b[:2]:
        return 1.0
    if not a[1] or not b[1]:
        return 0.0
    if prefix is None:
        known = agreeing(a[3], b[3])
        prefix = int(PREFIXES[known - 1]) if known else 0
    both = np.sort(np.concatenate([a[2], b[2]]))  # each has no value twice
    new = np.append(True, both[1:] != both[:-1])
    least = both[new][:size]
    jaccard = int((both[~new] <= least[-1]).sum()) / len(least)
    return max(2 * jaccard / (1 + jaccard), 2 * prefix / (a[1] + b[1]))


def fingerprint(text: str, span: int = SPAN, size: int = SIZE) -> str:
    return as_string(sketch(text, span, size))


RANGES = 1 << 16


def with_next(docs: DataFrame, range_bytes: int = 16 << 20) -> DataFrame:
    """part, ahead, doc_id, text, sorted within partitions: the rows of a range and then, marked
    ``ahead``, what follows its last row."""
    spark = docs.sparkSession
    small_batches(spark)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text"))
    rows = rows.select(F.coalesce("doc_id", F.lit(-(2**63))).alias("d"), F.xxhash64("text").alias("h"), "doc_id", "text")
    least = F.struct("d", "h")
    volume, first = rows.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0)), F.min(least)).first()
    if first is None:
        return spark.createDataFrame([], "part int, ahead boolean, doc_id long, text string")
    parts = min(max(1, -(-volume // range_bytes)), RANGES)
    dealt = rows.select("d", "h").repartitionByRange(parts, "d", "h").groupBy(F.spark_partition_id().alias("p")).agg(F.min(least).alias("b"))
    bounds = sorted({tuple(r["b"]) for r in dealt.collect()} - {tuple(first)}) if parts > 1 else []  # RANGES at most
    last = len(bounds)
    part, begins = F.lit(0), F.lit(False)
    if bounds:
        wide = max(1, round(len(bounds) ** 0.5))

        def listed(some: list[tuple[int, int]]) -> Column:
            d, h = (F.split(F.lit(",".join(str(b[i]) for b in some)), ",").cast("array<long>") for i in (0, 1))
            return F.arrays_zip(d.alias("d"), h.alias("h"))

        before = lambda b: (b["d"] < F.col("d")) | ((b["d"] == F.col("d")) & (b["h"] <= F.col("h")))
        every = listed(bounds)
        group = F.greatest(F.size(F.filter(listed(bounds[::wide]), before)) - 1, F.lit(0))
        part = group * wide + F.size(F.filter(F.slice(every, group * wide + 1, F.lit(wide)), before))
        bound = F.get(every, part - 1)
        begins = F.coalesce((bound["d"] == F.col("d")) & (bound["h"] == F.col("h")), F.lit(False))
    rows = rows.withColumn("part", part.cast("int"))
    copies = F.array_compact(
        F.array(
            F.struct(F.col("part"), F.lit(False).alias("ahead")),
            F.when(begins, F.struct((F.col("part") - 1).alias("part"), F.lit(True).alias("ahead"))),
            F.when((F.col("d") == first[0]) & (F.col("h") == first[1]), F.struct(F.lit(last).alias("part"), F.lit(True).alias("ahead"))),
        )
    )
    dealt = rows.select(F.explode(copies).alias("at"), "d", "h", "doc_id", "text").select("at.part", "at.ahead", "d", "h", "doc_id", "text")
    whole = dealt.repartition(max(parts, 1), "part").sortWithinPartitions("part", "ahead", "d", "h", "doc_id", "text")
    return whole.select("part", "ahead", "doc_id", "text")


COLUMNS = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def edited_pairs(docs: DataFrame, span: int = SPAN, size: int = SIZE, range_bytes: int = 16 << 20) -> DataFrame:
    """Every document against its edited text (its last quarter replaced by the start of the next
    document) and against the next document."""
    schema = arrow_schema(COLUMNS)

    def pair(doc_id: int | None, text: str, own: tuple, after: str, next_own: tuple) -> tuple:
        quarter = len(text) // 4
        edited = text[: len(text) - quarter] + after[:quarter]
        changed = sketch(edited, span, size)
        kept, ahead = common_prefix(text, edited, own, changed), common_prefix(text, after, own, next_own)
        digest = hashlib.sha256(edited.encode("utf-8", "surrogatepass")).hexdigest()
        return doc_id, len(text), digest, as_string(own), as_string(changed), likeness(own, changed, size, kept), likeness(own, next_own, size, ahead)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, waiting, rows = None, None, []
        for batch in batches:
            for part, ahead, doc_id, text in zip(*(batch[c].to_pylist() for c in ("part", "ahead", "doc_id", "text")), strict=True):
                if part != at:
                    at, waiting = part, None
                if ahead and waiting is None:
                    continue
                own = sketch(text, span, size)
                if waiting is not None:
                    rows.append(pair(*waiting, text, own))
                waiting = None if ahead else (doc_id, text, own)
                if len(rows) >= 500:
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)
                    rows = []
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)

    return with_next(docs, range_bytes).mapInArrow(releasing(run), COLUMNS)
