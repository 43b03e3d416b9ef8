"""Sequence packing by power-of-two decomposition.

A document's ids (with an end id) are cut into pieces whose lengths are powers of two: as many
of the longest length as fit, then the binary digits of the rest, longest first.  Every piece is
a sequence of its own, so no sequence crosses documents and none needs padding.  Sequences of
equal length share a bucket (``bucket``, the length's exponent): each task fills its buckets side
by side, hands them on bucket by bucket, and counts within each, so a sequence id names bucket,
task and place in the bucket.  ``batched`` draws batches of one shape and a fixed number of ids
from the buckets.  No order or shuffle of all rows is needed and a rerun task gives the same ids.

Ids come from the ``tokenizers`` library.  Texts are cut where its byte-level splitting must cut
too (``boundaries``), the cut pieces of some megabytes of text are dictionary-encoded, and each
distinct piece goes through the library once: pieces that are one run of letters, digits or marks
in the byte alphabet and many to a call, all others as they are.  Two generations of pieces that
were met are kept, ``memo`` each, so memory is bounded.

Defined results: a null text counts as empty, giving the end id alone; null or repeated doc_ids
stay separate documents; other columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import functools
import json
import string
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import arrow_schema, releasing, small_batches, text_or_empty

PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, bucket int, ids binary"
FLUSH = 8 << 20  # bytes of text that are encoded together
GROUP = 2000  # pieces in one call of the library

# Kinds of bytes: what a character that ends or starts with the byte is for certain.
_OTHER, _LETTER, _DIGIT, _MARK, _QUOTE, _SPACE, _BREAK = range(7)
_STARTS = np.zeros(256, np.uint8)
_STARTS[[*string.ascii_letters.encode()]] = _LETTER
_STARTS[[*string.digits.encode()]] = _DIGIT
_STARTS[[*string.punctuation.encode()]] = _MARK
_STARTS[ord("'")] = _QUOTE
_STARTS[ord(" ")] = _SPACE
_STARTS[[*b"\t\n\r"]] = _BREAK
_LATIN = [c for c in range(0x80, 0xC0) if c not in (0x97, 0xB7)]  # after 0xC3: the letters from U+00C0 on


@functools.lru_cache(maxsize=1)
def _cuts() -> np.ndarray:
    """Whether the splitting cuts before a byte, by the kind that ends before it and its own."""
    table = np.zeros((7, 7), bool)
    word = [_LETTER, _DIGIT]
    table[[_LETTER, _DIGIT, _MARK, _QUOTE], _SPACE] = True  # white space after anything else starts a match
    table[[_LETTER, _DIGIT, _MARK, _QUOTE], _BREAK] = True
    for kind in (_MARK, _QUOTE):
        table[word, kind] = True
    table[_LETTER, _DIGIT] = table[_DIGIT, _LETTER] = True
    table[_MARK, word] = True  # a quote may start a contraction, so none is cut after it
    return table.ravel()


def boundaries(data: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Positions where pieces start: texts' ``starts`` and every certain boundary of the splitting."""
    kind = _STARTS[data]
    ends = kind.copy()
    latin = np.flatnonzero(data == 0xC3) + 1
    if len(latin):
        latin = latin[latin < len(data)]
        ends[latin[np.isin(data[latin], _LATIN)]] = _LETTER
    cut = np.zeros(len(data), bool)
    cut[1:] = _cuts()[ends[:-1] * np.uint8(7) + kind[1:]]
    # A line break is a match by itself if it is the only white space before a word; of more, the last one is.
    solid = (ends >= _LETTER) & (ends <= _QUOTE)
    cut[2:] |= solid[:-2] & (kind[1:-1] == _BREAK) & ((kind[2:] == _LETTER) | (kind[2:] == _DIGIT))
    cut[starts[starts < len(data)]] = True
    return np.flatnonzero(cut)


def is_run(piece: str) -> bool:
    """Whether the piece is certainly one match: an optional space, then letters, digits or marks only."""
    run = piece[1:] if piece[0] == " " else piece
    if run.isalpha():
        return run.isascii() or max(run) < "Ԁ"
    return run.isascii() and (run.isdigit() or (run.isprintable() and run != "" and not any(map(_not_mark.__contains__, run))))


_not_mark = frozenset(string.ascii_letters + string.digits + " ")


class Encoder:
    """The library's byte-level BPE of a file, and the pieces that this process met."""

    def __init__(self, path: str) -> None:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer, models, pre_tokenizers

        with open(path, encoding="utf-8") as source:
            spec = json.load(source)
        before, model = spec["pre_tokenizer"] or {}, spec["model"]
        if spec["normalizer"] or before.get("type") != "ByteLevel" or before.get("add_prefix_space") or model["type"] != "BPE":
            raise ValueError(f"not a plain byte-level BPE: {path}")
        self.whole = Tokenizer.from_file(path)
        self.whole.encode_special_tokens = True  # their strings in a text are ordinary text
        merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        self.runs = Tokenizer(models.BPE(vocab=model["vocab"], merges=merges, cache_capacity=0))
        self.runs.pre_tokenizer = pre_tokenizers.WhitespaceSplit()
        self.sizes = np.zeros(max(model["vocab"].values()) + 1, np.int64)  # bytes of each id
        self.sizes[list(model["vocab"].values())] = [len(t) for t in model["vocab"]]
        shown = [*range(33, 127), *range(161, 173), *range(174, 256)]  # bytes that the byte alphabet shows as themselves
        rest = [b for b in range(256) if b not in shown]
        self.alphabet = {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(rest)}
        self.alphabet[ord("\n")] = " "  # runs hold none: it separates them
        self.young: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}

    def _runs(self, pieces: list[str]) -> list[bytes]:
        groups = [pieces[i : i + GROUP] for i in range(0, len(pieces), GROUP)]
        coded = ["\n".join(g).encode() for g in groups]
        out = []
        for raw, found in zip(coded, self.runs.encode_batch_fast([c.decode("latin-1").translate(self.alphabet) for c in coded], add_special_tokens=False), strict=True):
            ids = np.array(found.ids, "<u4")
            data = np.frombuffer(raw, np.uint8)
            stops = np.append(np.flatnonzero(data == 10), len(data))
            stops -= np.arange(len(stops))  # separators have no ids
            reached = np.cumsum(self.sizes[ids])
            after = np.searchsorted(reached, stops) + 1
            if not (reached[after - 1] == stops).all():
                raise ValueError("a piece isn't whole in the library's ids")
            cuts, whole = [0, *(4 * after).tolist()], ids.tobytes()
            out += [whole[a:b] for a, b in zip(cuts, cuts[1:], strict=False)]
        return out

    def ids(self, pieces: list[str], memo: int) -> list[bytes]:
        """Ids of distinct pieces as little-endian unsigned 32-bit integers."""
        if len(self.young) > memo:
            self.young, self.old = {}, self.young
        young, old = self.young, self.old
        found = list(map(young.get, pieces))
        runs, others = [], []
        for i, ids in enumerate(found):
            if ids is None:
                piece = pieces[i]
                ids = old.get(piece)
                if ids is None:
                    (runs if is_run(piece) else others).append(i)
                else:
                    found[i] = young[piece] = ids
        if others:
            for i, e in zip(others, self.whole.encode_batch_fast([pieces[i] for i in others], add_special_tokens=False), strict=True):
                found[i] = np.array(e.ids, "<u4").tobytes()
        if runs:
            for i, ids in zip(runs, self._runs([pieces[i] for i in runs]), strict=True):
                found[i] = ids
        young.update((pieces[i], found[i]) for i in (*runs, *others))
        return found


@functools.lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    return Encoder(path)


def token_ids(texts: pa.Array, path: str, memo: int = 250_000) -> tuple[np.ndarray, np.ndarray]:
    """The ids of all texts (no nulls), one after another, and the place of each text's first id."""
    if not pa.types.is_string(texts.type):  # a session may hand over large or view types
        texts = texts.cast(pa.string())
    offsets = np.frombuffer(texts.buffers()[1], np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    if not len(texts) or offsets[-1] == offsets[0]:
        return np.zeros(0, "<u4"), np.zeros(len(texts) + 1, np.int64)
    data = np.frombuffer(texts.buffers()[2], np.uint8)[offsets[0] : offsets[-1]]
    offsets -= offsets[0]
    starts = boundaries(data, offsets[:-1])
    cuts = np.append(starts, len(data)).astype(np.int32)
    pieces = pa.StringArray.from_buffers(len(starts), pa.py_buffer(cuts), pa.py_buffer(data)).dictionary_encode()
    found = encoder(path).ids(pieces.dictionary.to_pylist(), memo)
    which = np.asarray(pieces.indices)
    sizes = np.fromiter(map(len, found), np.int64, len(found)) // 4
    first = np.cumsum(sizes) - sizes
    n = sizes[which]
    ends = np.cumsum(n)
    ids = np.frombuffer(b"".join(found), "<u4")[np.arange(ends[-1]) + np.repeat(first[which] - (ends - n), n)]
    return ids, np.append(0, ends)[np.searchsorted(starts, offsets)]


def binary_lengths(n: int, longest: int) -> list[int]:
    """Lengths of the pieces of ``n`` ids; ``longest`` is a power of two."""
    rest = n % longest
    return [longest] * (n // longest) + [1 << k for k in range(longest.bit_length() - 1, -1, -1) if rest >> k & 1]


def pack(docs: DataFrame, tokenizer_path: str, longest: int = 1024, end_id: int = 0, memo: int = 250_000) -> DataFrame:
    """One row per piece, with its bucket and its ids (binary, little-endian unsigned 32-bit)."""
    schema = arrow_schema(PIECES)
    if longest < 1 or longest & (longest - 1):
        raise ValueError("longest must be a power of two")

    def packed(doc_ids: pa.Array, texts: pa.Array, task: int, filled: np.ndarray) -> pa.RecordBatch:
        ids, at = token_ids(texts, tokenizer_path, memo)
        last = at[1:] + np.arange(len(texts))  # where each document's end id goes
        whole = np.empty(len(ids) + len(texts), "<u4")
        is_end = np.zeros(len(whole), bool)
        is_end[last] = True
        whole[is_end], whole[~is_end] = end_id, ids
        totals = np.diff(np.append(-1, last))
        lengths = [binary_lengths(n, longest) for n in totals.tolist()]
        count = np.fromiter(map(len, lengths), np.int64, len(lengths))
        length = np.concatenate(lengths).astype(np.int64)
        ends = np.cumsum(length)
        data = whole.tobytes()
        view, cuts = memoryview(data), np.append(0, 4 * ends)
        crc = [zlib.crc32(view[a:b]) for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True)]
        of = np.repeat(np.arange(len(texts)), count)
        bucket = np.frexp(length.astype(np.float64))[1] - 1
        order = np.argsort(bucket, kind="stable")
        sizes = np.bincount(bucket, minlength=len(filled))
        place = np.empty(len(length), np.int64)
        place[order] = np.arange(len(length)) - np.repeat(np.cumsum(sizes) - sizes, sizes) + np.repeat(filled, sizes)
        filled += sizes
        sequence = bucket.astype(np.int64) << 58 | task << 33 | place
        binary = pa.Array.from_buffers(pa.binary(), len(length), [None, pa.py_buffer(cuts.astype(np.int32)), pa.py_buffer(data)])
        start = ends - length - (last - totals + 1)[of]
        columns = [doc_ids.take(pa.array(of)), start, length, crc, totals[of], sequence, np.zeros(len(length), np.int64), bucket.astype(np.int32), binary]
        batch = pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)
        return batch.take(pa.array(order))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        task = TaskContext.get().partitionId()
        filled = np.zeros(longest.bit_length(), np.int64)  # sequences in each of the task's buckets
        held: list[pa.RecordBatch] = []
        size = 0

        def flushed() -> pa.RecordBatch:
            whole = pa.Table.from_batches(held).combine_chunks().to_batches()[0]
            return packed(whole["doc_id"], whole["text"], task, filled)

        for batch in batches:
            if batch.num_rows:
                held.append(batch)
                size += batch["text"].nbytes
                if size >= FLUSH:
                    yield flushed()
                    held, size = [], 0
        if held:
            yield flushed()

    small_batches(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text")).mapInArrow(releasing(run), PIECES)


def batched(packed: DataFrame, tokens: int = 1 << 16) -> DataFrame:
    """``packed`` with ``batch_id``: sequences of one bucket and task, ``tokens`` ids a batch (one
    sequence if that is longer; the last batch of a task's bucket may be smaller)."""
    width = F.greatest(F.lit(tokens).cast("long"), F.col("length"))
    place = F.col("sequence_id").bitwiseAND(F.lit((1 << 33) - 1))
    batch = F.floor(place * F.col("length") / width).cast("long")
    return packed.withColumn("batch_id", (F.col("sequence_id") - place).bitwiseOR(batch))
