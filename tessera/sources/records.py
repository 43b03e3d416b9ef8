"""Quoted delimited files read in ranges: one large file is many tasks, though its records may hold line breaks.

A line break ends a record only where the number of quotes before it is even, and Spark's text source
splits files at lines.  So one pass counts each split's quotes; their running parity over a file's splits
says whether a split starts inside quotes.  The second pass joins lines to records within each split.
What is left are records that cross from one split to another, at most one at each border: their
pieces, and they alone, meet in a shuffle.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

WHOLE, HEAD, REST, HEADER = range(4)  # a record, the start of one that goes on in the next split, what goes on, a HEAD that is the file's header
PIECES = "record string, path string, block long, kind int"


def _lines(spark: SparkSession, path: str | list[str]) -> DataFrame:
    return spark.read.text(path, lineSep="\n").select("value", F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("block"))


def _starts_inside(lines: DataFrame, quote: str) -> dict[str, tuple[np.ndarray, np.ndarray]]:
    """For each file: the places of its splits and whether they start inside quotes.  The driver gets a row a split."""
    quotes = F.length("value") - F.length(F.replace("value", F.lit(quote), F.lit("")))
    splits = lines.groupBy("path", "block").agg((F.sum(quotes) % 2).alias("odd"))
    before = Window.partitionBy("path").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    found = splits.select("path", "block", (F.coalesce(F.sum("odd").over(before), F.lit(0)) % 2).alias("inside")).orderBy("path", "block").toArrow()
    paths = found["path"].combine_chunks().dictionary_encode()
    which = np.asarray(paths.indices)
    blocks, inside = np.asarray(found["block"]), np.asarray(found["inside"]) == 1
    return {name: (blocks[which == i], inside[which == i]) for i, name in enumerate(paths.dictionary.to_pylist())}


class Split:
    """A split of a file while its lines come in: ``inside`` quotes or not, and the lines ``held`` of the open record."""

    def __init__(self, path: str, block: int, inside: bool, header: bool, quote: str) -> None:
        self.path, self.block, self.inside, self.quote = path, block, inside, quote
        self.rest = inside  # the open record began in an earlier split
        self.header = header and block == 0  # the next record is the header
        self.held: list[str] = []

    def _rows(self, records: pa.Array, kind: int) -> pa.RecordBatch:
        n = len(records)
        return pa.RecordBatch.from_arrays([records.cast(pa.string()), pa.array([self.path] * n, pa.string()), pa.array([self.block] * n, pa.int64()), pa.array([kind] * n, pa.int32())], names=["record", "path", "block", "kind"])

    def add(self, lines: pa.Array) -> Iterator[pa.RecordBatch]:
        """The records that end in the next lines."""
        after = (np.cumsum(np.asarray(pc.count_substring(lines, self.quote)) & 1) + self.inside) & 1
        at = 0
        if self.inside:
            ends = np.flatnonzero(after == 0)
            at = int(ends[0]) + 1 if len(ends) else len(lines)
            self.held += lines.slice(0, at).to_pylist()
            if len(ends):
                yield from self.close()
        starts = np.flatnonzero(np.append(0, after[:-1])[at:] == 0) + at if at < len(lines) else np.zeros(0, np.int64)
        self.inside = bool(after[-1])
        if self.inside and len(starts):
            self.held = lines.slice(int(starts[-1])).to_pylist()
        stops = np.append(starts[1:], len(lines)) if not self.inside else starts[1:]
        starts = starts[: len(stops)]
        if self.header and len(starts):
            starts, stops, self.header = starts[1:], stops[1:], False
        short = stops - starts == 1
        if short.any():
            yield self._rows(lines.take(pa.array(starts[short])), WHOLE)
        if not short.all():
            yield self._rows(pa.array(["\n".join(lines.slice(i, j - i).to_pylist()) for i, j in zip(starts[~short].tolist(), stops[~short].tolist(), strict=True)]), WHOLE)

    def close(self, at_end: bool = False) -> Iterator[pa.RecordBatch]:
        """The open record: complete, or at the split's end a piece."""
        kind = REST if self.rest else HEADER if self.header and at_end else HEAD if at_end else WHOLE
        if self.held and not (kind == WHOLE and self.header):
            yield self._rows(pa.array(["\n".join(self.held)]), kind)
        self.held, self.rest, self.header = [], False, self.header and self.rest


def records(spark: SparkSession, path: str | list[str], quote: str = '"', header: bool = True) -> DataFrame:
    """record, path: the records of quoted files, each as its text, without headers and empty lines.

    A quote stands only in quoted fields, where it is doubled, as writers of such files do it.
    """
    lines = _lines(spark, path)
    starts = _starts_inside(lines, quote)
    if not starts:
        return spark.createDataFrame([], "record string, path string")
    shared = spark.sparkContext.broadcast(starts)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        split: Split | None = None
        for batch in batches:
            if not batch.num_rows:
                continue
            paths, blocks = batch["path"].dictionary_encode(), np.asarray(batch["block"])
            which = np.asarray(paths.indices)
            cuts = [0, *(np.flatnonzero((np.diff(which) != 0) | (np.diff(blocks) != 0)) + 1).tolist(), batch.num_rows]
            for a, b in zip(cuts, cuts[1:], strict=False):
                name, block = paths.dictionary[int(which[a])].as_py(), int(blocks[a])
                if split is None or (split.path, split.block) != (name, block):
                    if split is not None:
                        yield from split.close(at_end=True)
                    known, inside = shared.value[name]
                    place = int(np.searchsorted(known, block))
                    if place == len(known) or known[place] != block:
                        raise RuntimeError("the files' splits changed between two passes")
                    split = Split(name, block, bool(inside[place]), header, quote)
                yield from split.add(batch["value"].slice(a, b - a))
        if split is not None:
            yield from split.close(at_end=True)

    found = lines.mapInArrow(run, PIECES)
    whole = found.where(F.col("kind") == WHOLE).select("record", "path")
    if any(inside.any() for _, inside in starts.values()):
        before = Window.partitionBy("path").orderBy("block", F.col("kind").desc()).rowsBetween(Window.unboundedPreceding, 0)  # a split's rest comes before its head
        numbered = found.where(F.col("kind") != WHOLE).withColumn("n", F.sum((F.col("kind") != REST).cast("long")).over(before))
        parts = numbered.groupBy("path", "n").agg(F.array_sort(F.collect_list(F.struct("block", "record"))).alias("parts"), F.max("kind").alias("last"))
        joined = parts.where(F.col("last") != HEADER).select(F.array_join(F.transform("parts", lambda p: p["record"]), "\n").alias("record"), "path")
        whole = whole.unionByName(joined)
    return whole.where(F.length(F.regexp_replace("record", "[\r\n]", "")) > 0)
