"""Token ids in files of patched frame-of-reference blocks.

Documents are dealt into ranges of ascending doc_id and sorted there (of equal ids by the text's hash,
equal rows by their place in the input, so rows of one id spread too).  Each task encodes its range
in order and writes one file, a shard: Parquet rows that hold a segment of about ``SEGMENT`` ids each,
whole documents only.  Spark's writer commits a task's file or nothing, so a lost executor costs its
tasks.  A segment has

* ``shard``, ``segment``, ``first`` (ids of the shard before it) and ``n`` (its ids),
* ``doc_ids`` and ``doc_sizes`` (ids of each document, in order),
* ``payload``: blocks of ``BLOCK`` ids, and for each block in ``minimum``, ``width`` and ``starts`` its
  least id, the bits of a packed value and the byte where it starts (``starts`` ends with the end).

A block stores ids less its minimum.  The width is that of the value at ``percentile`` in the block.
Values are packed in ``LANES`` lanes of 64-bit little-endian words: value r * LANES + l is in bits
r * width and on of lane l, word w of all lanes follows word w - 1 of all.  Values that need more bits are exceptions:
after the packed words come their places (unsigned 16-bit) and what exceeds the width (unsigned
32-bit).  The last block of a segment is padded with its minimum.

``documents`` reads the files back, whole; ``span`` reads any span of ids of the corpus, by skipping
the segments and blocks that it doesn't touch.

Defined results: a null text counts as empty, giving the end id alone; null doc_ids come first; repeated
ids and rows stay documents of their own; other columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.llm.common import arrow_schema, releasing, small_batches, text_or_empty
from tessera.llm.packing import FLUSH, token_ids

BLOCK, LANES = 1024, 16
SEGMENT = 1 << 18
SEGMENTS = "shard int, segment int, first long, n long, doc_ids array<long>, doc_sizes array<long>, minimum array<long>, width array<int>, starts array<long>, payload binary"
DOCUMENTS = "doc_id long, start long, n_tokens long, ids_crc32 long, ids binary"


def _bits(values: np.ndarray) -> np.ndarray:
    return np.frexp(values.astype(np.float64))[1]


def _lanes(low: np.ndarray, width: int) -> np.ndarray:
    """Values (blocks, BLOCK) of ``width`` bits as words (blocks, width, LANES)."""
    rows = BLOCK // LANES
    values, words = low.reshape(len(low), rows, LANES), np.zeros((len(low), width * rows // 64, LANES), np.uint64)
    for r in range(rows):
        word, shift = divmod(r * width, 64)
        words[:, word] |= values[:, r] << np.uint64(shift)
        if shift + width > 64:
            words[:, word + 1] |= values[:, r] >> np.uint64(64 - shift)
    return words


def _values(words: np.ndarray, width: int) -> np.ndarray:
    rows = BLOCK // LANES
    out = np.empty((len(words), rows, LANES), np.uint64)
    mask = np.uint64((1 << width) - 1)
    for r in range(rows):
        word, shift = divmod(r * width, 64)
        value = words[:, word] >> np.uint64(shift)
        if shift + width > 64:
            value = value | words[:, word + 1] << np.uint64(64 - shift)
        out[:, r] = value & mask
    return out.reshape(len(words), BLOCK)


def pack(ids: np.ndarray, percentile: float = 0.9) -> tuple[np.ndarray, np.ndarray, np.ndarray, bytes]:
    """Minimum, width and start of each block, and the payload, of unsigned 32-bit ids."""
    count = -(-len(ids) // BLOCK)
    if not count:
        return np.zeros(0, np.int64), np.zeros(0, np.int32), np.zeros(1, np.int64), b""
    tail = len(ids) - (count - 1) * BLOCK
    blocks = np.zeros(count * BLOCK, np.uint64)
    blocks[: len(ids)] = ids
    blocks[len(ids) :] = ids[-tail:].min()
    blocks = blocks.reshape(count, BLOCK)
    minimum = blocks.min(1)
    delta = blocks - minimum[:, None]
    at = lambda n: min(n, max(1, int(np.ceil(percentile * n)))) - 1
    pivot = np.partition(delta, at(BLOCK), axis=1)[:, at(BLOCK)]
    pivot[-1] = np.partition(delta[-1, :tail], at(tail))[at(tail)]
    width = _bits(pivot)
    high = delta >> width.astype(np.uint64)[:, None]
    low = delta - (high << width.astype(np.uint64)[:, None])
    packed: list[bytes] = [b""] * count
    for w in np.unique(width[width > 0]).tolist():
        for i, words in zip(mine := np.flatnonzero(width == w), _lanes(low[mine], w), strict=True):
            packed[i] = words.tobytes()
    of, place = np.nonzero(high)
    cuts = np.searchsorted(of, np.arange(count + 1)).tolist()
    places, rest = place.astype("<u2"), high[of, place].astype("<u4")
    parts = [packed[i] + places[a:b].tobytes() + rest[a:b].tobytes() for i, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False))]
    return minimum.astype(np.int64), width.astype(np.int32), np.cumsum([0, *map(len, parts)]), b"".join(parts)


def unpack(minimum: np.ndarray, width: np.ndarray, starts: np.ndarray, payload: bytes, n: int) -> np.ndarray:
    """The first ``n`` ids of the blocks; ``starts`` counts from the payload's first byte."""
    out = np.zeros((len(width), BLOCK), np.uint64)
    view, packed = memoryview(payload), BLOCK // 8 * width.astype(np.int64)
    for w in np.unique(width[width > 0]).tolist():
        mine = np.flatnonzero(width == w)
        words = np.frombuffer(b"".join([view[starts[i] : starts[i] + packed[i]] for i in mine]), "<u8").reshape(len(mine), -1, LANES)
        out[mine] = _values(words, w)
    for i in np.flatnonzero(np.diff(starts) > packed):
        a, b = int(starts[i] + packed[i]), int(starts[i + 1])
        k = (b - a) // 6
        places, rest = np.frombuffer(view[a : a + 2 * k], "<u2"), np.frombuffer(view[a + 2 * k : b], "<u4")
        out[i, places] |= rest.astype(np.uint64) << np.uint64(width[i])
    out += minimum.astype(np.uint64)[:, None]
    return out.ravel()[:n].astype("<u4")


def write(docs: DataFrame, tokenizer_path: str, path: str, end_id: int = 2, percentile: float = 0.9, memo: int = 250_000) -> None:
    """Write the documents' ids, each document's with ``end_id`` after them, to the folder ``path``."""
    schema = arrow_schema(SEGMENTS)

    def encoded(doc_ids: pa.Array, texts: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray]:
        ids, at = token_ids(texts, tokenizer_path, memo)
        last = at[1:] + np.arange(len(texts))
        whole = np.full(len(ids) + len(texts), end_id, "<u4")
        is_id = np.ones(len(whole), bool)
        is_id[last] = False
        whole[is_id] = ids
        return doc_ids, np.diff(np.append(-1, last)), whole

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        shard, segment, first = TaskContext.get().partitionId(), 0, 0
        held: list[pa.RecordBatch] = []
        rest: list[tuple[pa.Array, np.ndarray, np.ndarray]] = []  # encoded, not yet written

        def segments(parts: list, last: bool) -> Iterator[tuple[pa.Array, np.ndarray, np.ndarray]]:
            """Whole documents that reach ``SEGMENT`` ids together; what is left over goes back to ``rest``."""
            doc_ids = pa.concat_arrays([p[0] for p in parts])
            sizes, ids = (np.concatenate([p[i] for p in parts]) for i in (1, 2))
            ends = np.cumsum(sizes)
            a = before = 0
            while a < len(sizes):
                b = int(np.searchsorted(ends, before + SEGMENT)) + 1
                if b > len(sizes) and not last:
                    break
                b = min(b, len(sizes))
                yield doc_ids[a:b], sizes[a:b], ids[before : ends[b - 1]]
                a, before = b, int(ends[b - 1])
            rest[:] = [(doc_ids[a:], sizes[a:], ids[before:])] if a < len(sizes) else []

        def flushed(last: bool) -> Iterator[pa.RecordBatch]:
            nonlocal segment, first, held
            if held:
                whole = pa.Table.from_batches(held).combine_chunks().to_batches()[0]
                rest.append(encoded(whole["doc_id"], whole["text"]))
                held = []
            for doc_ids, sizes, ids in segments(list(rest), last) if rest else ():
                minimum, width, starts, payload = pack(ids, percentile)
                row = [shard, segment, first, len(ids), doc_ids.to_pylist(), sizes.tolist(), minimum.tolist(), width.tolist(), starts.tolist(), payload]
                yield pa.RecordBatch.from_arrays([pa.array([v], f.type) for v, f in zip(row, schema, strict=True)], schema=schema)
                segment, first = segment + 1, first + len(ids)

        size = 0
        for batch in batches:
            if batch.num_rows:
                held.append(batch)
                size += batch["text"].nbytes
                if size >= FLUSH:
                    yield from flushed(False)
                    size = 0
        yield from flushed(True)

    small_batches(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text"))
    order = ["doc_id", "__hash", "__place"]
    rows = rows.withColumn("__hash", F.xxhash64("text")).withColumn("__place", F.monotonically_increasing_id())
    dealt = rows.repartitionByRange(*order).sortWithinPartitions(*order).select("doc_id", "text")
    dealt.mapInArrow(releasing(run), SEGMENTS).write.option("compression", "zstd").parquet(path)


def segments(spark: SparkSession, path: str) -> DataFrame:
    """The segments with ``start``, the ids of the whole corpus before each."""
    found = spark.read.schema(SEGMENTS).parquet(path)
    sizes = found.groupBy("shard").agg(F.sum("n").alias("size"))  # a row a file
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select("shard", F.coalesce(F.sum("size").over(before), F.lit(0)).alias("offset"))
    return found.join(F.broadcast(offsets), "shard").withColumn("start", F.col("offset") + F.col("first")).drop("offset")


def documents(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start (ids of all documents before), n_tokens, ids_crc32, ids (binary, little-endian unsigned 32-bit), read from the files."""
    schema = arrow_schema(DOCUMENTS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                row = {name: batch[name][i] for name in batch.schema.names}
                arrays = (np.asarray(row[c].values, np.int64) for c in ("minimum", "width", "starts"))
                data = unpack(*arrays, row["payload"].as_py(), row["n"].as_py()).tobytes()
                sizes = np.asarray(row["doc_sizes"].values, np.int64)
                ends = np.cumsum(sizes)
                cuts, view = np.append(0, 4 * ends), memoryview(data)
                crc = [zlib.crc32(view[a:b]) for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True)]
                ids = pa.Array.from_buffers(pa.binary(), len(sizes), [None, pa.py_buffer(cuts.astype(np.int32)), pa.py_buffer(data)])
                columns = [row["doc_ids"].values, pa.array(row["start"].as_py() + ends - sizes), pa.array(sizes), pa.array(crc, pa.int64()), ids]
                yield pa.RecordBatch.from_arrays(columns, schema=schema)

    rows = segments(spark, path).select("start", "n", "doc_ids", "doc_sizes", "minimum", "width", "starts", "payload")
    return rows.mapInArrow(releasing(run), DOCUMENTS)


def span(spark: SparkSession, path: str, start: int, stop: int) -> np.ndarray:
    """Ids ``start`` to ``stop`` of the corpus; only blocks that hold some of them are unpacked."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                a, b = max(0, start - row["start"]), min(row["n"], stop - row["start"])
                first, end = a // BLOCK, -(-b // BLOCK)
                starts = np.array(row["starts"][first : end + 1], np.int64)
                ids = unpack(np.array(row["minimum"][first:end]), np.array(row["width"][first:end]), starts - starts[0], row["payload"][starts[0] : starts[-1]], min(end * BLOCK, row["n"]) - first * BLOCK)
                yield pa.RecordBatch.from_arrays([pa.array([row["start"] + a]), pa.array([ids[a - first * BLOCK : b - first * BLOCK].tobytes()])], names=["at", "ids"])

    rows = segments(spark, path).where((F.col("start") < stop) & (F.col("start") + F.col("n") > start)).select("start", "n", "minimum", "width", "starts", "payload")
    found = sorted((r["at"], r["ids"]) for r in rows.mapInArrow(run, "at long, ids binary").collect())  # the span that was asked for
    return np.frombuffer(b"".join(ids for _, ids in found), "<u4")
