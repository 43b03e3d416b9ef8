"""Shared helpers of the training-data operators."""

from __future__ import annotations

import ctypes
import inspect
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.session import materialize, shared_dir  # noqa: F401  (for the operators)


def arrow_schema(spec: str) -> pa.Schema:
    """``"doc_id long, text string"`` as an Arrow schema."""
    kinds = {
        "long": pa.int64(), "int": pa.int32(), "double": pa.float64(), "float": pa.float32(), "boolean": pa.bool_(),
        "string": pa.string(), "binary": pa.binary(), "array<int>": pa.list_(pa.int32()), "array<long>": pa.list_(pa.int64()),
        "array<double>": pa.list_(pa.float64()),
    }
    return pa.schema([(name, kinds[kind]) for name, kind in (x.split() for x in spec.split(","))])


def table_of(spec: str, rows: list[tuple]) -> pa.Table:
    schema = arrow_schema(spec)
    columns = zip(*rows, strict=True) if rows else [[] for _ in schema]
    return pa.Table.from_arrays([pa.array(list(c), f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)


def packed(values: np.ndarray) -> bytes:
    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(values).tobytes())


def unpacked(data: bytes, kind: str | type) -> np.ndarray:
    return np.frombuffer(zstandard.ZstdDecompressor().decompress(data), kind)


def packed_sorted(values: np.ndarray) -> bytes:
    """For ascending unsigned 64-bit values."""
    return packed(np.diff(values, prepend=np.uint64(0)))


def unpacked_sorted(data: bytes) -> np.ndarray:
    return np.cumsum(unpacked(data, np.uint64), dtype=np.uint64)


def orderable(kind: T.DataType) -> bool:
    """Whether Spark can order values of a type: not if there is a map or a variant in it."""
    if isinstance(kind, T.StructType):
        return all(orderable(f.dataType) for f in kind)
    if isinstance(kind, T.ArrayType):
        return orderable(kind.elementType)
    return not isinstance(kind, T.MapType | T.VariantType)


def in_order(docs: DataFrame, columns: list[str]) -> Column | None:
    """What rows are ordered by if their own columns can't be: those that have an order, then the others as text; None if all can be."""
    hard = [c for c in columns if not orderable(docs.schema[c].dataType)]
    if not hard:
        return None
    easy = [F.col(f"`{c}`") for c in columns if c not in hard]
    return F.struct(*easy, F.to_json(F.struct(*[F.col(f"`{c}`") for c in hard])))


def small_batches(spark: SparkSession, rows: int = 1024) -> None:
    """Rows that hold whole texts go to Python in batches of at most ``rows``, so a batch stays small."""
    conf = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if int(spark.conf.get(conf)) not in range(1, rows + 1):
        spark.conf.set(conf, str(rows))


def release() -> None:
    """Give free memory back: workers are reused, and several may wait in one executor."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


def releasing(fn: Callable) -> Callable:
    """``fn`` (of batches, of a key and its rows, or of a key and two sides' rows), giving memory back when it ends."""

    def over_batches(batches):
        return _drained(fn(batches))

    def of_group(key, rows):
        try:
            return fn(key, rows)
        finally:
            release()

    def of_cogroup(key, left, right):
        try:
            return fn(key, left, right)
        finally:
            release()

    return {1: over_batches, 2: of_group, 3: of_cogroup}[len(inspect.signature(fn).parameters)]


def _drained(parts: Iterator) -> Iterator:
    try:
        yield from parts
    finally:
        release()


def map_batches(df: DataFrame, fn: Callable[[pa.RecordBatch], dict | None], spec: str) -> DataFrame:
    """Apply ``fn`` (batch -> dict of columns, or None) to every Arrow batch of ``df``."""
    schema = arrow_schema(spec)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows and (out := fn(batch)) is not None:
                yield pa.RecordBatch.from_arrays([pa.array(out[f.name], f.type) for f in schema], schema=schema)

    small_batches(df.sparkSession)
    return df.mapInArrow(releasing(run), spec)


def crc_bucket(col: Column | str, n: int) -> Column:
    """crc32 of the id's decimal text modulo ``n``; a null id counts as empty text."""
    text = (F.col(col) if isinstance(col, str) else col).cast("string")
    return F.pmod(F.crc32(F.coalesce(text, F.lit("")).cast("binary")), F.lit(n))


def text_or_empty(col: str = "text") -> Column:
    return F.coalesce(F.col(col), F.lit(""))


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    small_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def lookup(rows: DataFrame, table: DataFrame, keys: list[str], count: str, total: int, parts: int = 1000) -> DataFrame:
    """Inner join of ``rows`` to ``table`` (one row per key, ``count`` rows of ``rows`` each).

    A key with at least 1/``parts`` of all ``total`` rows is hot; there are at most ``parts`` such
    keys, so they are broadcast within that bound.  All other keys meet in a shuffle join in which
    no key holds more than 1/``parts`` of the rows.
    """
    least = max(total // parts, 2)
    hot = F.broadcast(table.where(F.col(count) >= least))
    cold = table.where(F.col(count) < least)
    return rows.join(hot, keys).unionByName(rows.join(F.broadcast(hot.select(*keys)), keys, "left_anti").join(cold, keys))


def shrink(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A task's edges (a, b) as a forest that connects the same nodes."""
    forest = Forest()
    for batch in batches:
        forest.add(batch[0].to_pylist(), batch[1].to_pylist())
        if len(forest.parent) > 1_000_000:  # bounded memory: hand on what is there and start afresh
            yield forest.edges()
            forest = Forest()
    yield forest.edges()


def components(edges: DataFrame, name: str = "components") -> DataFrame:
    """node, root: the least node of each connected component of the edges (a, b), longs in any order.

    Edges should come through ``shrink``.  Large-star and small-star steps alternate until nothing
    changes; every round is written to the shared folder.  The centre of a large star is a hot key of
    ``lookup``: its minimum is broadcast, so its edges stay where they are.
    """

    def moved(e: DataFrame, least: DataFrame, total: int) -> DataFrame:
        """The far ends of the edges ``e`` with the least node next to their near ends."""
        return lookup(e, least, ["a"], "n", total).select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b")

    def larger(e: DataFrame, total: int) -> DataFrame:
        """Each node's larger neighbours move to the least of its neighbourhood."""
        both = e.unionAll(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"), F.count(F.lit(1)).alias("n"))
        return moved(both.where("b > a"), least, 2 * total).distinct()

    def smaller(e: DataFrame, total: int) -> DataFrame:
        """Each node and its smaller neighbours move to the least of them (edges run from large to small)."""
        least = e.groupBy("a").agg(F.min("b").alias("m"), F.count(F.lit(1)).alias("n"))
        return moved(e, least, total).unionAll(least.select("a", F.col("m").alias("b"))).distinct()

    oriented = edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    now = materialize(oriented.distinct(), name)
    total = now.count()
    while True:
        half = materialize(larger(now, total), name)
        after = materialize(smaller(half, half.count()), name)
        size = after.count()
        if size == total and after.exceptAll(now).isEmpty():
            return after.select(F.col("a").alias("node"), F.col("b").alias("root"))
        now, total = after, size


class Forest:
    """Union-find over longs; every root is the least member of its set."""

    def __init__(self) -> None:
        self.parent: dict[int, int] = {}

    def root(self, x: int) -> int:
        parent = self.parent
        while (up := parent.setdefault(x, x)) != x:
            parent[x] = parent[up]
            x = up
        return x

    def add(self, left: list[int], right: list[int]) -> None:
        for a, b in zip(left, right, strict=True):
            a, b = self.root(a), self.root(b)
            if a != b:
                self.parent[max(a, b)] = min(a, b)

    def edges(self) -> pa.RecordBatch:
        pairs = [(x, r) for x in list(self.parent) if (r := self.root(x)) != x]
        return pa.RecordBatch.from_arrays([pa.array([p[i] for p in pairs], pa.int64()) for i in (0, 1)], names=["a", "b"])
