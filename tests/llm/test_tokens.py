import base64
import hashlib
import itertools
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from helpers import docs, odd_docs
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tessera.llm import byte_bpe, packing, token_files

RANKS, JSON, PATTERN = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.PATTERN
TEXT = st.lists(st.sampled_from(["a", "word", " ", "'", "''", "don't", "(x)", "_", "\xa0", "\u3000", "\x85", "\r\n", "×", "Ä", "я", "ß's", "١", "\x00", "ﬁ", "n\u0303", "  ", "\n", " \n ", "'s", "12", "é", "漢", "😀", "!", ".", "\t", " ", "\x1c", "Foo,", "<|endoftext|>"]), max_size=30).map("".join)


@pytest.fixture(scope="module")
def plain():
    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(RANKS, "rb"))}
    return tiktoken.Encoding("plain", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


@settings(max_examples=300, deadline=None)
@given(TEXT)
def test_pieces_encode_as_the_whole(text):
    enc = byte_bpe.encoding(RANKS, PATTERN)
    assert "".join(byte_bpe.safe_pieces(text, 3)) == text
    assert byte_bpe.encode_text(text, RANKS, PATTERN, block=3) == np.asarray(enc.encode_ordinary(text), "<u4").tobytes()
    assert enc.decode_bytes(enc.encode_ordinary(text)) == text.encode()


def test_token_ids_of_all_short_strings():
    """Every string of up to five of the characters that splitting depends on."""
    texts = ["".join(t) for n in range(6) for t in itertools.product("a1'! \né", repeat=n)]
    enc = packing.encoder(JSON)
    whole = [e.ids for e in enc.whole.encode_batch_fast(texts, add_special_tokens=False)]
    ids, at = packing.token_ids(pa.array(texts), JSON)
    assert [ids[a:b].tolist() for a, b in zip(at[:-1], at[1:], strict=True)] == whole


@settings(max_examples=1500, deadline=None)
@given(TEXT)
def test_token_ids_equal_the_library(text):
    texts = ["", text, "a", text[::-1]]
    whole = [packing.encoder(JSON).whole.encode(t, add_special_tokens=False).ids for t in texts]
    ids, at = packing.token_ids(pa.array(["before", *texts]).slice(1), JSON, memo=3)
    assert [ids[a:b].tolist() for a, b in zip(at[:-1], at[1:], strict=True)] == whole


def test_encode_decode(spark, plain):
    source = odd_docs(spark)
    found = byte_bpe.decode(byte_bpe.encode(source, RANKS, PATTERN), RANKS, PATTERN).collect()
    want = sorted((repr(r["doc_id"]), np.asarray(plain.encode_ordinary(r["text"] or ""), "<u4").tobytes(), (r["text"] or "").encode()) for r in source.collect())
    assert sorted((repr(r["doc_id"]), bytes(r["ids"]), bytes(r["data"])) for r in found) == want
    assert byte_bpe.encode(source.limit(0), RANKS, PATTERN).count() == 0


def test_binary_lengths():
    assert packing.binary_lengths(1, 8) == [1]
    assert packing.binary_lengths(22, 8) == [8, 8, 4, 2]
    for n in range(1, 300):
        assert sum(packing.binary_lengths(n, 16)) == n


def test_pack(spark):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(JSON)
    tok.encode_special_tokens = True
    source = odd_docs(spark)
    found = packing.pack(source, JSON, longest=64).collect()
    want = sorted(([*tok.encode(r["text"] or "", add_special_tokens=False).ids, 0] for r in source.select("text").collect()), key=str)
    assert len({r["sequence_id"] for r in found}) == len(found)
    for r in found:
        assert r["length"] == 1 << r["bucket"] <= 64 and r["offset"] == 0 and zlib.crc32(r["ids"]) == r["ids_crc32"] and r["sequence_id"] >> 58 == r["bucket"]
    # repeated rows give equal pieces, so equal multisets of (id, start, ids) are enough to put the texts together again
    pieces = Counter((r["doc_id"], r["doc_tokens"], r["start"], bytes(r["ids"])) for r in found)
    whole = Counter()
    for r in source.select("doc_id", "text").collect():
        ids, start = [*tok.encode(r["text"] or "", add_special_tokens=False).ids, 0], 0
        for n in packing.binary_lengths(len(ids), 64):
            whole[r["doc_id"], len(ids), start, np.asarray(ids[start : start + n], "<u4").tobytes()] += 1
            start += n
    assert pieces == whole and sum(r["length"] for r in found) == sum(map(len, want))
    assert packing.pack(docs(spark, []), JSON).count() == 0


def test_buckets_and_batches(spark):
    source = docs(spark, [(i, "some words of a text " * (i % 37)) for i in range(300)]).repartition(3)
    found = packing.batched(packing.pack(source, JSON, longest=64), 256).collect()
    places, shapes, sizes = defaultdict(list), defaultdict(set), Counter()
    for r in found:
        places[r["sequence_id"] >> 33].append(r["sequence_id"] & (1 << 33) - 1)
        shapes[r["batch_id"]].add((r["length"], r["sequence_id"] >> 33))
        sizes[r["batch_id"]] += r["length"]
    assert all(sorted(p) == list(range(len(p))) for p in places.values())  # each task's buckets are gapless
    assert all(len(s) == 1 for s in shapes.values()) and max(sizes.values()) == 256
    assert sum(n < 256 for n in sizes.values()) <= len(places)


def test_digest_of_an_empty_text(spark):
    row = byte_bpe.encode(docs(spark, [(1, None)]), RANKS, PATTERN).first()
    assert bytes(row["ids"]) == b"" and hashlib.sha256(b"").hexdigest().startswith("e3b0c442")


def test_large_arrow_texts_have_the_same_ids():
    texts = ["ab c", "", "Über 漢字 12", "a\nb"] * 3
    for kind in (pa.string(), pa.large_string(), pa.string_view()):
        ids, at = packing.token_ids(pa.array(texts, kind)[2:], JSON)
        plain, places = packing.token_ids(pa.array(texts[2:]), JSON)
        assert ids.tolist() == plain.tolist() and at.tolist() == places.tolist()


def test_packing_with_large_arrow_types(spark):
    conf = "spark.sql.execution.arrow.useLargeVarTypes"
    want = sorted(packing.pack(odd_docs(spark), JSON).select("doc_id", "start", "ids_crc32").collect(), key=repr)
    spark.conf.set(conf, "true")
    try:
        assert sorted(packing.pack(odd_docs(spark), JSON).select("doc_id", "start", "ids_crc32").collect(), key=repr) == want
    finally:
        spark.conf.unset(conf)


# Token files


@settings(max_examples=60, deadline=None)
@given(st.integers(0, 2**32 - 1), st.integers(0, 32), st.integers(0, 3000), st.integers(0, 40), st.floats(0, 1), st.integers(0, 2**32 - 1))
def test_blocks_round_trip(base, bits, n, outliers, percentile, seed):
    rng = np.random.default_rng(seed)
    ids = (base + rng.integers(0, 1 << bits, n)) % (1 << 32)
    if n:
        ids[rng.integers(0, n, outliers)] = rng.integers(0, 1 << 32, outliers)
    minimum, width, starts, payload = token_files.pack(ids.astype("<u4"), percentile)
    assert len(width) == len(minimum) == len(starts) - 1 == -(-n // token_files.BLOCK) and starts[-1] == len(payload)
    assert token_files.unpack(minimum, width, starts, payload, n).tolist() == ids.tolist()
    for k in range(len(width)):  # any block by itself
        part = token_files.unpack(minimum[k : k + 1], width[k : k + 1], starts[k : k + 2] - starts[k], payload[starts[k] : starts[k + 1]], token_files.BLOCK)
        assert part.tolist()[: n - k * token_files.BLOCK] == ids[k * token_files.BLOCK : (k + 1) * token_files.BLOCK].tolist()


def test_width_is_the_percentile_of_the_block():
    ids = np.full(token_files.BLOCK, 7000, "<u4")
    ids[:100] += np.arange(100, dtype="<u4") % 8  # three bits
    ids[:5] = 2**32 - 1
    minimum, width, starts, payload = token_files.pack(ids, 0.99)
    assert minimum.tolist() == [7000] and width.tolist() == [3] and len(payload) == 3 * token_files.BLOCK // 8 + 5 * 6
    assert token_files.pack(ids, 0.9)[1].tolist() == [0] and token_files.pack(ids, 1.0)[1].tolist() == [32]


def brute_files(rows, plain):
    """In order: doc_id, start, n_tokens, crc32 and the ids."""
    out, start = [], 0
    for d, text in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0)):
        ids = [*plain.encode_ordinary(text or ""), 2]
        out.append((d, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()), ids))
        start += len(ids)
    return out


@pytest.mark.parametrize("segment", [10, 1 << 18])
def test_token_files_equal_the_library(spark, plain, tmp_path, segment, monkeypatch):
    rows = [(i * 7 % 500 - 100, None if i == 30 else f"Text {i} " * (i % 40) + "\n漢字 don't") for i in range(500)]
    rows += [(1000, "word " * 60_000), (2000, ""), (None, "no id")]
    assert len({d for d, _ in rows}) == len(rows)
    monkeypatch.setattr(token_files, "SEGMENT", segment)
    path = str(tmp_path / "ids")
    token_files.write(docs(spark, rows).repartition(6), JSON, path)
    want = brute_files(rows, plain)
    got = sorted(token_files.documents(spark, path).collect(), key=lambda r: r["start"])
    assert [tuple(r)[:4] for r in got] == [w[:4] for w in want]
    assert [np.frombuffer(r["ids"], "<u4").tolist() for r in got] == [w[4] for w in want]
    whole = [i for w in want for i in w[4]]
    for a, b in ((0, 5), (2000, 9000), (len(whole) - 70_000, len(whole) - 3), (17, 17)):
        assert token_files.span(spark, path, a, b).tolist() == whole[a:b]
    if segment == 10:
        assert token_files.segments(spark, path).count() > 100


def test_token_files_of_odd_tables_and_one_common_id(spark, tmp_path):
    odd = odd_docs(spark).withColumn("shard", F.lit("x")).withColumn("payload", F.lit(1))
    token_files.write(odd, JSON, str(tmp_path / "odd"))
    got = sorted(token_files.documents(spark, str(tmp_path / "odd")).collect(), key=lambda r: r["start"])
    want = Counter((r["doc_id"], zlib.crc32(np.array([*packing.encoder(JSON).whole.encode(r["text"] or "", add_special_tokens=False).ids, 2], "<u4").tobytes())) for r in odd.collect())
    assert Counter((r["doc_id"], r["ids_crc32"]) for r in got) == want
    assert [r["doc_id"] for r in got] == sorted([r["doc_id"] for r in got], key=lambda d: (d is not None, d or 0))
    assert [r["start"] for r in got] == list(itertools.accumulate([0, *(r["n_tokens"] for r in got)]))[:-1]
    token_files.write(odd.limit(0), JSON, str(tmp_path / "none"))
    assert token_files.documents(spark, str(tmp_path / "none")).count() == 0 == len(token_files.span(spark, str(tmp_path / "none"), 0, 9))
    same = spark.range(4000, numPartitions=8).select(F.when(F.col("id") % 3 == 0, F.col("id")).otherwise(5).alias("doc_id"), F.lit("the same text").alias("text"))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        token_files.write(same, JSON, str(tmp_path / "same"))
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    sizes = [r["n"] for r in token_files.segments(spark, str(tmp_path / "same")).groupBy("shard").agg(F.sum("n").alias("n")).collect()]
    assert sum(sizes) == 4 * 4000 and max(sizes) < 0.6 * 16_000  # repeated rows of one id don't meet in one task
