import math
from fractions import Fraction

import numpy as np
import pytest
from helpers import table
from pyspark.sql import functions as F

from tessera.llm import hard_negatives, whitening

EMBEDDED = "vec_id long, embedding array<double>, label long"
MINED = "anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"


def brute_negatives(rows, is_anchor, k=5, low=80):
    """By all products."""
    last = lambda d: math.inf if d is None else d
    rows = [(d, [math.floor(256 * c) for c in v], n) for d, v, n in rows if n is not None and v is not None and all(c is not None and math.isfinite(c) for c in v)]
    anchors = {(d, tuple(v), n) for d, v, n in rows if d is not None and is_anchor(d)}
    out = []
    for a, v, label in anchors:
        scored = sorted([(sum(x * y for x, y in zip(v, w, strict=True)), d, n == label) for d, w, n in rows if d != a and len(w) == len(v)], key=lambda r: (-r[0], last(r[1])))
        for p, positive, _ in [r for r in scored if r[2]][:k]:
            fit = [(s, d) for s, d, same in scored if not same and low * p <= 100 * s <= 100 * p][:k]
            out += [(a, positive, i + 1, d, p, s) for i, (s, d) in enumerate(fit)]
    return sorted(out, key=repr)


def mined(spark, rows, **more):
    return table(hard_negatives.mine(spark.createDataFrame(rows, EMBEDDED).repartition(3), F.col("vec_id") % 4 == 0, **more).select(*MINED))


@pytest.mark.parametrize("scale,dimension", [(0.5, 16), (300.0, 3), (5e4, 2)])
@pytest.mark.parametrize("block", [16 << 20, 8 * 16 * 4])
def test_negatives_equal_brute_force(spark, scale, dimension, block):
    rng = np.random.default_rng(dimension)
    centres = rng.normal(0, scale, (3, dimension))
    rows = [(i, (centres[i % 3] + rng.normal(0, scale / 3, dimension)).tolist(), int(rng.integers(0, 3))) for i in range(160)]
    want = brute_negatives(rows, lambda d: d % 4 == 0)
    assert len(want) > 100 and mined(spark, rows, block_bytes=block) == want


def test_negatives_of_a_very_common_vector_and_odd_rows(spark):
    rng = np.random.default_rng(5)
    same = rng.normal(0, 0.3, 8).tolist()
    rows = [(i, same if i % 3 else rng.normal(0, 0.3, 8).tolist(), i % 2) for i in range(200)]
    rows += [(201, None, 1), (202, same, None), (203, [*same[:7], math.nan], 1), (204, [*same[:7], None], 1), (205, [*same[:7], math.inf], 0), (None, same, 1), (None, same, 0)]
    rows += [(4, same, 0), (4, same, 0), (8, same, 1), (208, [], 1), (209, [], 0), (210, same[:2], 1), (212, same[:2], 1), (213, same[:2], 0), (216, [0.0] * 8, 7)]
    assert mined(spark, rows) == brute_negatives(rows, lambda d: d % 4 == 0)
    assert mined(spark, rows, positives=2, negatives=3, low=50, state_rows=30) != []


def test_negatives_of_empty_tables_and_clashing_columns(spark):
    assert mined(spark, []) == [] and mined(spark, [(1, [0.5], 1)]) == []
    rows = [(i, [0.5 + i / 100, 0.25], i % 2) for i in range(20)]
    clash = spark.createDataFrame([(*r, 1, 2, "z", 3, 4.0) for r in rows], EMBEDDED + ", block int, q int, x string, rank int, score double")
    assert table(hard_negatives.mine(clash, F.col("vec_id") % 4 == 0).select(*MINED)) == brute_negatives(rows, lambda d: d % 4 == 0) != []
    with pytest.raises(Exception, match="55 bits"):
        hard_negatives.mine(spark.createDataFrame([(i, [1e12], 1) for i in range(8)], EMBEDDED), F.col("vec_id") % 4 == 0).collect()


def test_survivors_are_the_pairs_in_need():
    rng = np.random.default_rng(0)
    a, x = rng.integers(-300, 300, (20, 12)), rng.integers(-700, 700, (500, 12))
    whole = a @ x.T
    seen = []

    def needed(i, low, high):
        seen.append(low.size)
        return (high >= 700_000) | (low <= -900_000)

    i, j, score = hard_negatives.survivors(a, hard_negatives.Rows(x), np.arange(500), needed)
    assert sorted(zip(i, j, score, strict=True)) == [(p, q, whole[p, q]) for p, q in np.argwhere((whole >= 700_000) | (whole <= -900_000))]
    assert len(seen) == 11 and seen[-1] < seen[0] / 10  # a plane each, fewer pairs each time


# Whitening


def exact_covariance(x):
    """n, S and the covariance of integer vectors by exact fractions."""
    n, sums = len(x), [sum(v[i] for v in x) for i in range(len(x[0]))]
    d = range(len(sums))
    return n, sums, np.array([[float(Fraction(sum(v[i] * v[j] for v in x) * n - sums[i] * sums[j], n * n)) for j in d] for i in d])


@pytest.mark.parametrize("offset", [0, 10**12])
def test_covariance_is_exact_to_the_last_place(offset):
    """Far from zero, plain sums of products would lose every digit."""
    rng = np.random.default_rng(1)
    x = rng.integers(-1000, 1000, (3000, 6)) + offset
    n, sums, want = exact_covariance(x.tolist())
    mean, total = whitening.Mean(n, tuple(sums)), whitening.Sum.zero(6)
    for at in range(0, n, 700):
        total.add_rows(*mean.centred(x[at : at + 700]))
    got = (total.high + total.low) / n
    assert np.abs(got - want).max() <= 2.0**-51 * np.abs(want).max()


def test_slices_and_their_products_are_exact():
    rng = np.random.default_rng(2)
    high = rng.normal(0, 1, (whitening.ROWS, 3)) * [1, 1e-3, 1e5]
    parts = whitening.slices(high, high * 1e-17)
    assert np.abs(high - sum(parts)).max() <= 2.0**-52 * np.abs(high).max()
    for a in parts:
        for b in parts:
            exact = [[sum(Fraction(p) * Fraction(q) for p, q in zip(a[:, i].tolist(), b[:, j].tolist(), strict=True)) for j in range(3)] for i in range(3)]
            assert [[Fraction(v) for v in row] for row in (a.T @ b).tolist()] == exact


def test_parts_of_many_tasks_merge(spark):
    df = spark.range(300).select(F.array(F.col("id").cast("double")).alias("high"), F.array(F.lit(2.0**-60)).alias("low")).repartition(100)
    total = whitening.merged_sum(df, 100)
    assert total.high.tolist() == [[300 * 299 / 2]] and total.low.tolist() == [[300 * 2.0**-60]]


def brute_whitened(rows, components=4):
    kept = [(d, [math.floor(256 * c) for c in v]) for d, v in rows if v and all(c is not None and math.isfinite(c) for c in v)]
    fit = sorted({tuple(x) for _, x in kept})
    n, sums, v = exact_covariance(fit)
    values, vectors = np.linalg.eigh(v)
    out = []
    for d, x in kept:
        deviation = sum((n * a - s) ** 2 for a, s in zip(x, sums, strict=True))
        centred = np.array([float(Fraction(a) - Fraction(s, n)) for a, s in zip(x, sums, strict=True)])
        out += [(d, c + 1, n, deviation, float(centred @ vectors[:, -1 - c]) / math.sqrt(values[-1 - c]), values[-1 - c] / np.trace(v)) for c in range(min(components, len(sums)))]
    return out


def check_whitened(df, want):
    key = lambda r: (r[0] is None, r[0] or 0, r[1], r[3], abs(r[4]))
    got, want = sorted((tuple(r) for r in df.select("vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error").collect()), key=key), sorted(want, key=key)
    assert [r[:4] for r in got] == [r[:4] for r in want]
    for c in {r[1] for r in got}:
        a, b = (np.array([r[4] for r in rows if r[1] == c]) for rows in (got, want))
        sign = np.sign(a @ b)
        assert np.allclose(a, sign * b, rtol=1e-9, atol=1e-9)
    assert np.allclose([r[5] for r in got], [r[5] for r in want], rtol=1e-12)
    assert {r[6] for r in got} == {got[0][6]} and 0 <= got[0][6] < 1e-9


def test_whitening_equals_brute_force(spark):
    rng = np.random.default_rng(4)
    rows = [(i, (rng.normal(0, 1, 7) * [5, 4, 3, 2, 1, 1, 1] + 2).tolist()) for i in range(300)]
    rows += [(i % 50, rows[7][1]) for i in range(200)]  # a very common vector counts once
    rows += [(901, None), (902, [math.nan] * 7), (903, [1.0] * 6 + [None]), (904, [math.inf] * 7), (905, []), (None, rows[3][1]), (None, [0.0] * 7)]
    df = spark.createDataFrame([(*r, 1, 2, "z", 3.0) for r in rows], "vec_id long, embedding array<double>, x int, n int, high string, component double").repartition(5)
    check_whitened(whitening.whiten(df), brute_whitened(rows))


def test_whitening_of_few_dimensions_and_odd_tables(spark):
    schema = "vec_id long, embedding array<float>"
    rows = [(1, [0.5, 1.0]), (2, [1.5, -1.0]), (3, [0.25, 4.0]), (3, [0.25, 4.0])]
    check_whitened(whitening.whiten(spark.createDataFrame(rows, schema)), brute_whitened(rows))
    for none in ([], [(1, None)], [(1, [])], [(1, [0.5, 2.0])], [(1, [0.5]), (2, [0.5])]):
        assert whitening.whiten(spark.createDataFrame(none, schema)).count() == 0
    flat = [(1, [0.5, 1.0]), (2, [1.5, 1.0])]  # one direction alone has any variance
    assert table(whitening.whiten(spark.createDataFrame(flat, schema)).select("vec_id", "component")) == [(1, 1), (2, 1)]
    with pytest.raises(Exception, match="different lengths"):
        whitening.whiten(spark.createDataFrame([(1, [0.5]), (2, [0.5, 1.0])], schema).coalesce(1))


def test_deviations_beyond_a_long():
    mean = whitening.Mean(10**6, (10**9, 5))
    assert whitening.deviations(np.array([[3, 4], [2**45, 1]]), mean) == [(3 * 10**6 - 10**9) ** 2 + (4 * 10**6 - 5) ** 2, None]
