"""Byte-level BPE with the tiktoken library and a local rank file.

``encode`` gives the ids of every text, ``decode`` the bytes of the ids.  Each match of the
splitting pattern is encoded separately and no special token is recognised.  A text longer
than ``block`` characters is cut at safe boundaries first: a single space between two ASCII
letters or digits always starts a match of the pattern, so the pieces' ids concatenate to the
ids of the whole text and one call never holds an unbounded text.

Defined results: a null text counts as empty (no ids, no bytes); ids, null ids and repeated
rows are passed through one for one; other columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import base64
import functools
import re

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import map_batches, text_or_empty

SAFE = re.compile(r"(?<=[A-Za-z0-9]) (?=[A-Za-z0-9])")


@functools.lru_cache(maxsize=4)
def encoding(ranks_path: str, pattern: str):
    import tiktoken

    with open(ranks_path, "rb") as lines:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
    return tiktoken.Encoding("local_ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


def safe_pieces(text: str, block: int) -> list[str]:
    """Cut at the first safe boundary after every ``block`` characters."""
    pieces, start = [], 0
    while len(text) - start > block:
        cut = SAFE.search(text, start + block)
        if cut is None:
            break
        pieces.append(text[start : cut.start()])
        start = cut.start()
    pieces.append(text[start:])
    return pieces


def encode_text(text: str, ranks_path: str, pattern: str, block: int = 1 << 16) -> bytes:
    """Ids as little-endian unsigned 32-bit integers."""
    enc = encoding(ranks_path, pattern)
    return b"".join(np.asarray(enc.encode_ordinary(piece), "<u4").tobytes() for piece in safe_pieces(text, block))


def encode(docs: DataFrame, ranks_path: str, pattern: str, block: int = 1 << 16) -> DataFrame:
    """doc_id, ids (binary: little-endian unsigned 32-bit)."""

    def run(batch):
        return {"doc_id": batch["doc_id"], "ids": [encode_text(t, ranks_path, pattern, block) for t in batch["text"].to_pylist()]}

    return map_batches(docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text")), run, "doc_id long, ids binary")


def decode(encoded: DataFrame, ranks_path: str, pattern: str) -> DataFrame:
    """doc_id, ids, data: the raw bytes of the ids, which need not be whole UTF-8."""

    def run(batch):
        enc = encoding(ranks_path, pattern)
        data = [enc.decode_bytes(np.frombuffer(ids, "<u4").tolist()) for ids in batch["ids"].to_pylist()]
        return {"doc_id": batch["doc_id"], "ids": batch["ids"], "data": data}

    return map_batches(encoded.select("doc_id", "ids"), run, "doc_id long, ids binary, data binary")
