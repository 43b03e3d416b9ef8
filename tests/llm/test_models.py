import hashlib
import math
import os
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from helpers import LONG, docs, odd_docs
from pyspark.sql import functions as F

from tessera.llm import ctw, prefix_hash, quality


def brute_ctw(train, texts, depth=ctw.DEPTH):
    """Bits of each text under the tree that the training texts grow, node by node."""
    seq = lambda t: b" ".join(t.lower().encode().split()) + b"\n"
    counts = defaultdict(lambda: [0, 0])

    def decisions(t):
        s = b"\n" * depth + seq(t)
        for i in range(depth, len(s)):
            node = 1
            for k in range(7, -1, -1):
                bit = s[i] >> k & 1
                yield node, s[i - depth : i][::-1], bit
                node = 2 * node + bit

    children = defaultdict(set)
    for t in train:
        for node, context, bit in decisions(t):
            for d in range(depth + 1):
                counts[node, context[:d]][bit] += 1
                if d:
                    children[node, context[: d - 1]].add((node, context[:d]))

    def kt(c):
        a, b = c
        return math.lgamma(a + 0.5) + math.lgamma(b + 0.5) - math.log(math.pi) - math.lgamma(a + b + 1)

    weighted, odds = {}, {}

    def weigh(key):
        own = kt(counts[key])
        if len(key[1]) == depth:
            return own
        below = sum(map(weigh, children[key]))
        odds[key] = own - below
        return float(np.logaddexp(own, below)) - math.log(2)

    for node in {n for n, c in counts if not c}:
        weigh((node, b""))
    out = []
    for t in texts:
        bits = 0.0
        for node, context, bit in decisions(t):
            p = None
            for d in range(depth, -1, -1):
                key = node, context[:d]
                c = counts.get(key, [0, 0])
                own = (c[bit] + 0.5) / (sum(c) + 1)
                if p is None:
                    p = own if sum(c) or d == 0 else None
                else:
                    w = 1 / (1 + math.exp(-max(-700, min(700, odds[key]))))
                    p = w * own + (1 - w) * p
            bits -= math.log2(p)
        out.append(bits)
    return out


@pytest.mark.parametrize("chunk_bytes,heavy", [(100, 256), (1 << 20, 4), (50, 10**9)])
def test_ctw_equals_the_tree(spark, monkeypatch, chunk_bytes, heavy):
    monkeypatch.setattr(ctw, "HEAVY", heavy)  # from few heavy pairs to all
    rng = np.random.default_rng(0)
    words = ["The", "cat", "sat", "on", "mat", "dög", "ran"]
    rows = [(i, "  ".join(rng.choice(words, rng.integers(0, 12)))) for i in range(30)] + [(30, None), (31, "unseen zebra\ttext")]
    train = F.col("doc_id") % 4 != 0
    found = {r["doc_id"]: r for r in ctw.score(docs(spark, rows), train, chunk_bytes).collect()}
    texts = [t or "" for _, t in rows]
    learnt = [t for (i, _), t in zip(rows, texts, strict=True) if i % 4]
    for (i, _), bits in zip(rows, brute_ctw(learnt, texts), strict=True):
        assert found[i]["score"] == pytest.approx(-bits * math.log10(2), rel=2e-3, abs=2e-3)
    counted = Counter(w for t in learnt for w in [*t.lower().encode().split(), None])
    total, distinct = sum(counted.values()), len(counted)
    for (i, _), t in zip(rows, texts, strict=True):
        tokens = [*t.lower().encode().split(), None]
        assert (found[i]["n_tokens"], found[i]["n_known"], found[i]["train_tokens"]) == (len(tokens), sum(w in counted for w in tokens), total)
        assert found[i]["base_score"] == pytest.approx(sum(math.log10((counted[w] + 0.1) / (total + 0.1 * (distinct + 1))) for w in tokens))


def test_ctw_is_a_distribution():
    """Over all 256 next bytes of a context the probabilities sum to 1."""
    strings = ctw.Strings(["abracadabra abraham", "cadabra"])
    keys, counts = np.unique(np.concatenate([k for _, k in strings.slices()]), return_counts=True)
    for context in (int(keys[3] >> np.uint64(8)), int(keys[-1] >> np.uint64(8)), 0x7A7A7A7A7A7A7A):
        every = np.unique(np.concatenate([keys, np.arange(256, dtype=np.uint64) | np.uint64(context << 8)]))
        known = np.zeros(len(every), np.int64)
        known[np.searchsorted(every, keys)] = counts
        z, o, w = (np.zeros(65536, t) for t in (np.int64, np.int64, float))
        for level in range(8):
            tree = ctw.grow(keys, counts, level)
            at = (tree.prefix >> np.uint64(8)).astype(np.int64)
            np.add.at(z, at, tree.zeros[ctw.TOP]), np.add.at(o, at, tree.ones[ctw.TOP]), np.add.at(w, at, tree.weighted)
        used = np.flatnonzero(z + o)
        bits = ctw.code_lengths(every, known, ctw.Upper.of(used, z[used], o[used], w[used], 0, 0))
        assert (2.0 ** -bits[(every >> np.uint64(8)) == np.uint64(context)]).sum() == pytest.approx(1)


def test_ctw_of_odd_rows(spark):
    source = odd_docs(spark)
    found = ctw.score(source, ~ctw.split()).collect()
    assert len(found) == source.count() and all(r["score"] < 0 and r["n_tokens"] >= 1 for r in found)
    assert ctw.score(source.limit(0), F.lit(True)).count() == 0
    untrained = ctw.score(docs(spark, [(1, "ab")]), F.lit(False)).first()
    assert untrained["score"] == pytest.approx(-24 * math.log10(2)) and untrained["train_tokens"] == 0


def test_long_text_across_slices():
    text = LONG * 200
    strings = ctw.Strings(["  x ", text, ""])
    joined = [" ".join(t.lower().split()).encode() + b"\n" for t in ("  x ", text, "")]
    got = [b"", b"", b""]
    for of, k in strings.slices():
        for i in range(3):
            got[i] += (k[of == i] & np.uint64(0xFF)).astype(np.uint8).tobytes()
    assert got == joined
    of, hashes = strings.words()
    assert np.bincount(of, minlength=3).tolist() == [1, len(text.split()), 0] and len(np.unique(hashes)) == len(set((text + " x").lower().split()))


def spans_of(text):
    """All spans of the text behind its sentinels."""
    padded = [None] * (prefix_hash.SPAN - 1) + list(text)
    return {tuple(padded[i : i + prefix_hash.SPAN]) for i in range(len(text))}


def brute_likeness(a, b):
    """(share of the common prefix, Dice coefficient of the spans)."""
    if a == b:
        return 1.0, 1.0
    if not a or not b:
        return 0.0, 0.0
    prefix = len(os.path.commonprefix([a, b]))
    x, y = spans_of(a), spans_of(b)
    return 2 * prefix / (len(a) + len(b)), 2 * len(x & y) / (len(x) + len(y))


def brute_prefix(rows):
    from xxhash import xxh64_intdigest

    rows = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, (xxh64_intdigest((r[1] or "").encode(), 42) + 2**63) % 2**64))
    out = []
    for k, (i, t) in enumerate(rows):
        t, after = t or "", rows[(k + 1) % len(rows)][1] or ""
        q = len(t) // 4
        edited = t[: len(t) - q] + after[:q]
        out.append((i, len(t), prefix_hash.fingerprint(t), prefix_hash.fingerprint(edited), hashlib.sha256(edited.encode()).hexdigest(), brute_likeness(t, edited), brute_likeness(t, after)))
    return sorted(out, key=repr)


@pytest.mark.parametrize("range_bytes", [200, 1 << 20])
def test_edited_pairs(spark, range_bytes):
    rng = np.random.default_rng(2)
    words = ["alpha", "beta", "gamma", "delta", "omega", "é😀"]
    more = [(100 + i, " ".join(rng.choice(words, rng.integers(1, 400)))) for i in range(20)] + [(None, f"null {i}") for i in range(5)]
    source = odd_docs(spark).select("doc_id", "text", "chunk", "fingerprint").unionByName(docs(spark, more).selectExpr("doc_id", "text", "1 AS chunk", "'z' AS fingerprint"))
    found = prefix_hash.edited_pairs(source, range_bytes=range_bytes).collect()
    names = ("doc_id", "n_chars", "fingerprint", "edited_fingerprint", "edited_sha256", "near_edited", "near_next")
    got = sorted((tuple(r[c] for c in names) for r in found), key=repr)
    want = brute_prefix([(r["doc_id"], r["text"]) for r in source.select("doc_id", "text").collect()])
    assert [r[:5] for r in got] == [r[:5] for r in want]
    for mine, brute in zip(got, want, strict=True):
        for value, (prefix, dice) in zip(mine[5:], brute[5:], strict=True):
            # never below the exact prefix share, and otherwise what a sample of 64 spans estimates
            assert prefix - 1e-12 <= value <= 1 and abs(value - max(prefix, dice)) < 0.25
    assert prefix_hash.edited_pairs(source.limit(0)).count() == 0
    alone = prefix_hash.edited_pairs(docs(spark, [(1, "abcd efgh")])).first()
    assert alone["near_next"] == 1.0 and alone["near_edited"] < 1


def test_exact_common_prefix():
    rng = np.random.default_rng(0)
    for n in (0, 1, 15, 16, 17, 500, 5000):
        a = "".join(rng.choice(list("abé"), n))
        for k in {0, 1, n // 3, max(n - 1, 0), n}:
            b = a[:k] + "Z" + a[k + 1 :]
            for x, y in ((a, b), (a, a[:k]), (a, a)):
                assert prefix_hash.common_prefix(x, y, prefix_hash.sketch(x), prefix_hash.sketch(y), block=100) == len(os.path.commonprefix([x, y]))


def test_prefix_hash_spans_and_extensions():
    text = "abcabcabd" + "é😀" * 5
    h = prefix_hash.PrefixHash(text)
    for a in range(len(text)):
        for b in range(len(text)):
            n = next((k for k in range(len(text) - max(a, b)) if text[a + k] != text[b + k]), len(text) - max(a, b))
            assert h.common_extension(a, b) == n
            assert h.equal(a, b, n)
    whole = prefix_hash.sketch(LONG, block=1 << 20)
    for block in (7, 100):
        part = prefix_hash.sketch(LONG, block=block)
        assert part[:2] == whole[:2] and (part[2] == whole[2]).all() and (part[3] == whole[3]).all()


def test_isotonic():
    v = np.array([0.1, 0.5, 0.3, 0.9, 0.2])
    assert quality.isotonic(v, np.ones(5)).tolist() == pytest.approx([0.1, 0.4, 0.4, 0.55, 0.55])
    assert quality.isotonic(np.zeros(0), np.zeros(0)).tolist() == []


def corpus(spark, n=400):
    rng = np.random.default_rng(3)
    rows, labels = [], []
    for i in range(n):
        good = bool(i % 3)
        words = [f"{a}{b}" for a, b in zip(rng.choice(["ab", "cd", "ef"], 60), rng.choice(["x", "yy", "z"], 60), strict=True)]
        rows.append((i, " ".join(words) + "." if good else " ".join(w.upper() + "!!" for w in words[:6]) * 10))
        labels.append((i, int(good)))
    return docs(spark, rows), spark.createDataFrame(labels, "doc_id long, quality int")


def brute_quality(rows, labels, width=256, bandwidth=2.0, ridge=1e-2, seed=7, cells=1000):
    """The classifier in dense form: all features in one matrix, ridge as least squares, isotonic by minima of maxima."""
    stats = np.array([quality.statistics(t or "") for _, t in rows])
    mean, scale = stats.mean(0), stats.std(0)
    rng = np.random.default_rng(seed)
    w = rng.standard_normal((stats.shape[1], width)) / (bandwidth * math.sqrt(stats.shape[1]))
    z = np.clip((stats - mean) / np.where(scale > 1e-9, scale, 1), -6, 6)
    x = np.hstack([np.cos(z @ w + rng.uniform(0, 2 * math.pi, width)) * math.sqrt(2 / width), np.ones((len(z), 1))])
    use = np.array([i in labels and zlib.crc32(str(i).encode()) % 4 != 2 for i, _ in rows])
    y = np.array([labels.get(i, 0) for i, _ in rows], float)[use]
    penalty = np.sqrt(ridge * use.sum() / width) * np.eye(width + 1)[:width]
    beta = np.linalg.lstsq(np.vstack([x[use], penalty]), np.r_[y, np.zeros(width)], rcond=None)[0]
    raw = np.clip(x @ beta, -0.5, 1.5)
    cell = np.floor((raw[use] + 0.5) / 2 * cells)
    at = np.unique(cell)
    level, weight = np.array([y[cell == c].mean() for c in at]), np.array([(cell == c).sum() for c in at])
    mean_of = lambda i, j: np.average(level[i : j + 1], weights=weight[i : j + 1])
    fitted = np.array([max(min(mean_of(i, j) for j in range(k, len(at))) for i in range(k + 1)) for k in range(len(at))])
    grid = np.r_[-0.5, (at + 0.5) / cells * 2 - 0.5, 1.5]
    return np.clip(0.999 * np.interp(raw, grid, np.r_[fitted[0], fitted, fitted[-1]]) + 0.001 * (raw + 0.5) / 2, 0, 1)


def test_quality_equals_the_dense_form(spark):
    rng = np.random.default_rng(11)
    rows, known = [], {}
    for i in range(150):
        p = rng.random()
        rows.append((i, " ".join(rng.choice(["word", "other", "SHOUT!!", "x", "longer-word", "12"], rng.integers(1, 40), p=[p / 2, p / 2, (1 - p) / 2, (1 - p) / 4, (1 - p) / 8, (1 - p) / 8]))))
        known[i] = int(rng.random() < p)
    found = {r["doc_id"]: r["score"] for r in quality.classify(docs(spark, rows), spark.createDataFrame(list(known.items()), "doc_id long, quality int")).collect()}
    want = brute_quality(rows, known)
    assert np.abs(np.array([found[i] for i, _ in rows]) - want).max() < 1e-6


def test_quality_on_held_out_rows(spark):
    source, labels = corpus(spark)
    known = dict(labels.collect())
    held = [r for r in quality.classify(source, labels).collect() if r["held_out"]]
    assert all(zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2 for r in held) and len(held) > 50
    assert np.mean([r["predicted"] == known[r["doc_id"]] for r in held]) > 0.98
    assert {known[r["doc_id"]] for r in quality.keep_good(source, labels).collect()} == {1}


def test_held_out_labels_are_never_read(spark):
    source, labels = corpus(spark, 200)
    flipped = labels.withColumn("quality", F.when(F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(4)) == 2, 1 - F.col("quality")).otherwise(F.col("quality")))
    a, b = ({r["doc_id"]: r["score"] for r in quality.classify(source, x).collect()} for x in (labels, flipped))
    assert all(abs(a[i] - b[i]) < 1e-9 for i in a)


def test_quality_of_odd_rows(spark):
    source, labels = odd_docs(spark), spark.createDataFrame([(1, 1), (1, 0), (2, None), (None, 1), (8, 1), (9, 0), (10, 0), (4, 1)], "doc_id long, quality int")
    assert quality.classify(source, labels).count() == source.count()
    assert {r["score"] for r in quality.classify(source, labels.limit(0)).collect()} == {0.5}
    assert quality.keep_good(source, labels.limit(0)).count() == source.count()
    assert quality.classify(source.limit(0), labels).count() == 0 == quality.keep_good(source.limit(0), labels).count()
    assert quality.statistics("").shape == (quality.N_STATS,) and np.isfinite(quality.statistics("")).all()
