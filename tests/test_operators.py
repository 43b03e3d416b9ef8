import math
import os

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tessera.operators import folds, joins, loss, pairs, retrieval
from tessera.operators.encoders import GraphAttentionEncoder, HashedTokenEncoder, encode_batch, encode_column, load, save
from tessera.plans.training import AdamW, EarlyStopping, cached_gradient_step, clamp_temperature, clipped, contrastive, epoch_shares, linear_warmup, one_cycle


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def test_folds(spark):
    df = spark.createDataFrame([("a", None, 0), ("a", "", 1), ("a", "x", 2), ("a", "y", 3), ("", "z", 4), ("b", "", 5)], "k string, v string, o int")
    for n in (1, 16):
        part = df.repartition(n)
        assert rows(folds.first_by(part, ["k"], "v", ["o"])) == [("a", "x")]
        assert rows(folds.last_by(part.where("k <> ''"), ["k"], "v", ["o"])) == [("a", "y"), ("b", "")]


@pytest.mark.parametrize("n", [0, 1, 9, 25])
def test_split_sample_batches(spark, n):
    df = spark.range(n).withColumnRenamed("id", "k")
    val = folds.exact_split(df, "k").where("split = 'val'").count()
    assert val == (max(1, n // 10) if n else 0)
    assert folds.hash_sample(df, "k", 5).count() == min(5, n)
    for parts in (1, 7):
        b = folds.batches(df.repartition(parts), "k", 4).collect()
        assert len(b) == n // 4 * 4 and all(sum(r["batch_id"] == i for r in b) == 4 for i in range(n // 4))
    numbered = folds.numbered(df, [F.col("k").desc()], "i").collect()
    assert sorted(r["i"] for r in numbered) == list(range(n)) and all(r["i"] == n - 1 - r["k"] for r in numbered)


def test_parallel_join(spark):
    a = spark.createDataFrame([(1, "x"), (2, "y")], "id int, a string")
    b = spark.createDataFrame([(1, "p"), (3, "q")], "id int, b string")
    with pytest.raises(joins.MisalignedError):
        joins.parallel_join({"a": a, "b": b}, ["id"])
    assert rows(joins.parallel_join({"a": a, "b": b}, ["id"], strict=False)) == [(1, "x", "p")]
    assert rows(joins.parallel_join({"a": a, "b": b}, ["id"], optional=("b",))) == [(1, "x", "p"), (2, "y", None)]
    with pytest.raises(joins.MisalignedError):
        joins.parallel_join({"a": a.union(a), "b": a.select("id")}, ["id"])


def test_judged_only_of_nothing_is_nothing(spark):
    df = spark.range(3).withColumnRenamed("id", "k")
    assert joins.judged_only(df, "k", spark.createDataFrame([], "d long"), "d").count() == 0


def test_issue_null(spark):
    df = spark.createDataFrame([("x ", ""), ("x", "bad"), (" ", None), (None, "")], "formula string, issue string")
    assert [r[0] for r in df.select(joins.issue_null("formula", "issue")).collect()] == ["x", None, None, None]


def brute_top(q, c, k):
    out = []
    for t, v in q:
        scored = sorted(((round(float(np.dot(v, w)), 6), d) for d, w in c), reverse=True)[:k]
        out += [(t, d, s, i + 1) for i, (s, d) in enumerate(scored)]
    return sorted(out)


@pytest.mark.parametrize("k,block", [(3, 1 << 20), (100, 1 << 20), (2, 8 * 4)])
def test_top_k(spark, k, block):
    rng = np.random.default_rng(0)
    q = [(f"t{i}", rng.integers(-2, 3, 4).astype(float).tolist()) for i in range(5)]
    c = [(f"d{i:02}", rng.integers(-2, 3, 4).astype(float).tolist()) for i in range(30)]
    found = retrieval.top_k(spark.createDataFrame(q, "topic_id string, embedding array<float>"), spark.createDataFrame(c, "doc_id string, embedding array<float>").repartition(3), k, block_bytes=block)
    assert rows(found) == brute_top(q, c, k)


def test_top_k_of_odd_rows(spark):
    q = spark.createDataFrame([("t", [1.0, 2.0]), ("u", [1.0]), ("v", None)], "topic_id string, embedding array<double>")
    c = spark.createDataFrame([("a", [1.0, 1.0]), ("b", [3.0]), (None, [9.0, 9.0]), ("c", None), ("d", [math.nan, 1.0]), ("e", [])], "doc_id string, embedding array<double>")
    assert rows(retrieval.top_k(q, c, 3)) == [("t", "a", 3.0, 1), ("u", "b", 3.0, 1)]  # unequal lengths never meet, no number no rank


@pytest.mark.parametrize("tasks", [1, 130])
def test_merged_in_a_tree(spark, tasks):
    df = spark.range(2000).select((F.col("id") % tasks).cast("int").alias("task"), (F.col("id") % 2).alias("q"), F.col("id").alias("doc_id"), (F.col("id") * 7919 % 101).alias("score"))
    got = retrieval.merged(df, ["q"], [F.col("score").desc(), F.col("doc_id").desc()], 5)
    want = [(q, d, d * 7919 % 101, n + 1) for q in (0, 1) for n, d in enumerate(sorted(range(q, 2000, 2), key=lambda d: (-(d * 7919 % 101), -d))[:5])]
    assert rows(got.select("q", "doc_id", "score", "rank")) == sorted(want)


@pytest.mark.parametrize("k", [1, 7, 500])
def test_running_keeps_no_more_than_k_rows_a_query(k):
    rng = np.random.default_rng(3)
    scores, ids = rng.integers(0, 50, (3000, 40)).astype(float), [f"d{i}" for i in rng.permutation(3000)]
    best = retrieval.Running(40, k, pa.string())
    for at in range(0, 3000, 100):
        best.add(scores[at : at + 100], pa.array(ids[at : at + 100]))
        assert best.waiting <= max(40 * k, 1 << 16)
    got = best.merge().to_pydict()
    want = [(q, s, d) for q in range(40) for s, d in sorted(zip(scores[:, q], ids, strict=True), reverse=True)[:k]]
    assert list(zip(got["query"], got["score"], got["id"], strict=True)) == want


def test_top_k_without_queries_or_corpus(spark):
    none = spark.createDataFrame([], "topic_id string, embedding array<float>")
    corpus = spark.createDataFrame([("d", [1.0])], "doc_id string, embedding array<float>")
    assert retrieval.top_k(none, corpus, 5).count() == 0
    assert retrieval.top_k(none.union(spark.createDataFrame([("t", [1.0])], none.schema)), corpus.limit(0), 5).count() == 0


def test_metrics_by_hand(spark):
    run = spark.createDataFrame([("t", "a", 3.0), ("t", "b", 2.0), ("t", "c", 1.0), ("u", "a", 1.0), ("w", "a", 1.0)], "topic_id string, doc_id string, score double")
    qrels = spark.createDataFrame([("t", "b", 2.0), ("t", "c", 1.9), ("t", "z", 3.0), ("u", "q", 0.0), ("v", "a", 3.0)], "topic_id string, doc_id string, grade double")
    got = {r["topic_id"]: r for r in retrieval.metrics(run, qrels, [2, 10], level=1).collect()}
    assert set(got) == {"t", "u"}  # w isn't judged, v wasn't run
    ideal = 3 + 2 / math.log2(3) + 1 / 2
    assert got["t"]["ndcg_10"] == pytest.approx((2 / math.log2(3) + 1 / 2) / ideal)
    assert got["t"]["ndcg_2"] == pytest.approx((2 / math.log2(3)) / (3 + 2 / math.log2(3)))
    assert got["t"]["map_10"] == pytest.approx((1 / 2 + 2 / 3) / 3)
    assert got["u"]["ndcg_10"] == got["u"]["map_10"] == 0
    prime = {r["topic_id"]: r for r in retrieval.metrics(run, qrels, [10], prime=True).collect()}
    assert prime["t"]["map_10"] == pytest.approx((1 + 1) / 3)
    assert retrieval.macro(retrieval.metrics(run.limit(0), qrels, [10])).first()["ndcg_10"] is None


def test_info_nce(spark):
    rng = np.random.default_rng(1)
    q, p = rng.standard_normal((2, 5, 3))
    df = spark.createDataFrame([(0, i, q[i].tolist(), p[i].tolist()) for i in range(5)], "batch_id int, position int, q array<double>, p array<double>")
    s = q @ p.T / 0.07
    ce = lambda m: float(np.mean(np.log(np.exp(m - m.max(1, keepdims=True)).sum(1)) + m.max(1) - np.diag(m)))
    assert loss.info_nce(df).first()["loss"] == pytest.approx((ce(s) + ce(s.T)) / 2)


@pytest.mark.parametrize("block", [1, 2, 3, 100])
def test_loss_merges_over_blocks(block):
    rng = np.random.default_rng(2)
    q, p = rng.standard_normal((2, 9, 4)) * 30  # exponentials of these overflow without a maximum
    s = q @ p.T / 0.05
    entropy = lambda m: np.mean([np.logaddexp.reduce(row) - row[i] for i, row in enumerate(m)])
    assert loss.batch_loss(q, p, 0.05, block) == pytest.approx((entropy(s) + entropy(s.T)) / 2)


def test_loss_takes_one_shuffle_and_odd_pairs(spark):
    df = spark.createDataFrame([(0, 0, [1.0, 0.0], [1.0, 0.0]), (0, 1, None, [1.0, 0.0]), (0, 2, [0.0, 1.0], None), (None, 0, [1.0, 0.0], [0.0, 1.0])], "batch_id int, position int, q array<float>, p array<float>")
    found = loss.info_nce(df)
    assert rows(found.na.fill(-1, ["batch_id"])) == [(-1, 1, 0.0), (0, 1, 0.0)]
    assert found._jdf.queryExecution().executedPlan().toString().count("Exchange") == 1
    assert loss.info_nce(df.limit(0)).count() == 0


@pytest.mark.parametrize("few", [1, 7, 1 << 16])
@pytest.mark.parametrize("k", [0, 1, 50, 299, 300, 301])
def test_samples_of_any_size(spark, monkeypatch, few, k):
    monkeypatch.setattr(folds, "FEW", few)
    df = spark.range(300).select(F.when(F.col("id") > 1, F.col("id") % 150).alias("k"), "id").repartition(3)  # two rows a key, two without one
    got = [r["k"] for r in folds.hash_sample(df, "k", k).collect()]
    want = sorted([None, None, *[i % 150 for i in range(2, 300)]], key=lambda v: "" if v is None else __import__("hashlib").md5(f"42:{v}".encode()).hexdigest())[:k]
    assert sorted(got, key=str) == sorted(want, key=str)


@pytest.mark.parametrize("pages", [0, 1, 64])
def test_judged_rows_by_a_filter_of_ids(spark, pages):
    df = spark.range(20_000).select(F.col("id").alias("k"), F.lit("text").alias("text"))
    ids = spark.createDataFrame([(7 * i,) for i in range(300)] + [(7,), (None,), (10**9,)], "d long")
    assert sorted(r["k"] for r in joins.judged_only(df, "k", ids, "d", pages).collect()) == [7 * i for i in range(300)]
    assert joins.judged_only(df, "k", ids.limit(0), "d", pages).count() == 0
    if pages == 64:
        near = joins.maybe_among(df, "k", joins.bloom_pages(ids, "d", pages), pages)
        assert 300 <= near.count() < 400


def test_ids_and_counts_of_judgments(spark):
    a = spark.createDataFrame([("t", "1", 2.0), ("t", None, 1.0), ("u", "1", None)], "topic_id string, doc_id string, grade double")
    b = spark.createDataFrame([("t", "2", 0.0)], a.schema)
    assert rows(joins.judged_ids([a, b])) == [("1",), ("2",)] and joins.judged_ids([a.limit(0)]).count() == 0
    assert rows(joins.judgment_counts(a.union(b), "grade", 1.0)) == [(4, 2, 2)]


def test_many_ids_bring_the_filter(spark):
    df, ids = spark.range(1000).select(F.col("id").alias("k")), spark.range(0, 3000, 3).select(F.col("id").alias("d"))
    conf = "spark.sql.autoBroadcastJoinThreshold"
    plan = lambda: joins.judged_only(df, "k", ids, "d")._jdf.queryExecution().toString()
    assert "bitmap_construct_agg" not in plan()
    spark.conf.set(conf, "1k")
    try:
        assert "bitmap_construct_agg" in plan()
        assert joins.judged_only(df, "k", ids, "d").count() == 334
    finally:
        spark.conf.unset(conf)


def test_first_match_moves_no_text_of_the_rows(spark):
    queries = spark.createDataFrame([(1, "x", 0), (2, "y", 0), (3, "", 0), (4, None, 0), (5, "x", 0)], "q int, text string, __x int")
    index = spark.createDataFrame([("x", "", 0), ("x", "b", 2), ("x", "a", 1), ("y", None, 3), ("", "c", 4), (None, "d", 5)], "text string, v string, o int")
    found = joins.first_match(queries, index, "text", "v", ["o"])
    assert rows(found.select("q", "text", "v")) == [(1, "x", "a"), (5, "x", "a")] and found.columns == ["q", "text", "__x", "v"]


def test_misaligned_keys(spark):
    frame = lambda *ids: spark.createDataFrame([(i,) for i in ids], "id int")
    bad = lambda **f: {r["id"] for r in joins.misaligned(f, ["id"]).collect()}
    assert bad(a=frame(1, 2), b=frame(2, 1), c=frame(1, 2)) == set()
    assert bad(a=frame(1, 2, 2), b=frame(1, 2), c=frame(1, 2, 3)) == {2, 3}
    assert bad(a=frame(1, 1)) == {1} and bad(a=frame(1), b=frame(2)) == {1, 2}


def test_pairs(spark):
    topics = spark.createDataFrame([("t", "x")], "topic_id string, query string")
    qrels = spark.createDataFrame([("t", "1", 1.0), ("t", "2", 0.0), ("t", "3", 2.0), ("s", "1", 3.0)], "topic_id string, doc_id string, grade double")
    posts = spark.createDataFrame([("1", "one"), ("2", "two"), ("3", "")], "post_id string, text string")
    assert rows(pairs.text_pairs(topics, qrels, posts)) == [("t", "1", "x", "one")]
    index = spark.createDataFrame(
        [("3", None, None, 0), ("3", "y", "<math><ci/></math>", 1), ("9", " x ", "<math><cn/></math>", 2)], "old_visual_id string, latex string, opt string, id int"
    )
    assert rows(pairs.formula_pairs(topics, qrels, index, ["id"])) == [("t", "3", "x", "[MATH]y[/MATH]")]
    graphs = pairs.graph_pairs(topics, qrels, index, ["id"]).collect()
    assert len(graphs) == 1 and graphs[0]["query_graph"]["x"] == [5, 4] and graphs[0]["pos_graph"]["x"] == [5, 1]


def test_encoders(spark):
    df = spark.createDataFrame([(1, "a b"), (2, ""), (3, None), (4, "a b")], "id int, text string")
    out = {r["id"]: r["embedding"] for r in encode_column(df, HashedTokenEncoder(32), "text", ["id"]).collect()}
    assert out[1] == out[4] and out[2] == out[3] == [0.0] * 32
    assert np.linalg.norm(out[1]) == pytest.approx(1, abs=1e-6)
    gat = GraphAttentionEncoder(hidden=8, heads=2, layers=2, embedding=8, dimension=16)
    g = {"x": [5, 1, 2], "src": [0, 1, 0, 2], "dst": [1, 0, 2, 0]}
    h = {"x": [5, 2, 1], "src": [0, 2, 0, 1], "dst": [2, 0, 1, 0]}  # the same graph with nodes renamed
    a, b, none = gat.encode([g, h, None])
    assert none is None and np.allclose(a, b, atol=1e-5) and np.linalg.norm(a) == pytest.approx(1, abs=1e-6)


def dense_attention(encoder, graph):
    """The graph encoder's forward pass by adjacency matrices, head by head."""
    w, n = encoder.weights, len(graph["x"])
    adjacent = np.eye(n, dtype=bool)
    adjacent[graph["dst"], graph["src"]] = True
    x = w["embed"][graph["x"]]
    for i in range(encoder.layers):
        heads = []
        for k in range(encoder.heads):
            h = x @ w[f"{i}.project"][:, k * encoder.hidden : (k + 1) * encoder.hidden]
            score = (h @ w[f"{i}.target"][k])[:, None] + (h @ w[f"{i}.source"][k])[None, :]
            score = np.where(adjacent, np.where(score > 0, score, 0.2 * score), -np.inf)
            share = np.exp(score - score.max(1, keepdims=True))
            heads.append(share / share.sum(1, keepdims=True) @ h)
        y = np.hstack(heads) + w[f"{i}.bias"] + x @ w[f"{i}.residual"]
        x = (y - y.mean()) / np.sqrt(y.var() + 1e-5) * w[f"{i}.scale"] + w[f"{i}.shift"]
    z = np.r_[x.mean(0), x.max(0)] @ w["head1"] + w["bias1"]
    z = 0.5 * z * (1 + np.tanh(np.sqrt(2 / np.pi) * (z + 0.044715 * z**3))) @ w["head2"] + w["bias2"]
    return z / np.linalg.norm(z)


def test_graph_attention_equals_its_dense_form(spark):
    from plain_trees import parse_tree

    from tessera.functions.trees import VOCABULARY
    from tessera.plans import catalogue, file_queries

    path = "/root/testdata/sf0.001"
    if not os.path.isdir(path):
        pytest.skip("the driver's tables aren't here")
    gat = GraphAttentionEncoder(embedding=16, hidden=16, heads=2, layers=2, dimension=32)
    ids = {tag: i + 1 for i, tag in enumerate(VOCABULARY)}
    graphs = {r["id"]: parse_tree(r["opt"], ids) for r in file_queries.formulas(spark, path).collect()}
    found = {r["id"]: [int(c) for c in r["components"].split(",")] for r in catalogue.QUERIES["graph_attention_encode"](spark, path).collect()}
    assert set(found) == {i for i, g in graphs.items() if g}
    for i, components in found.items():
        assert np.abs(np.array(components) - 10000 * dense_attention(gat, graphs[i])).max() < 1


def test_checkpoints(tmp_path):
    gat = GraphAttentionEncoder(hidden=4, heads=1, layers=1, embedding=4, dimension=8, seed=3)
    graph = {"x": [5, 1], "src": [0, 1], "dst": [1, 0]}
    for encoder, value in ((gat, graph), (HashedTokenEncoder(16, None), "a b")):
        save(encoder, str(tmp_path / "best"), epoch=4, loss=0.5)
        again, extra = load(str(tmp_path / "best"))
        assert extra == {"epoch": 4, "loss": 0.5} and np.array_equal(again.encode([value])[0], encoder.encode([value])[0])
    vectors, mask = encode_batch(gat, [graph, None, graph])
    assert vectors.shape == (2, 8) and mask.tolist() == [True, False, True]
    assert encode_batch(gat, [])[0].shape == (0, 8)


@pytest.mark.parametrize("micro", [1, 3, 8])
def test_cached_gradients_equal_the_whole_batch(micro):
    rng = np.random.default_rng(0)
    q, p, w = rng.normal(size=(8, 5)), rng.normal(size=(8, 5)), rng.normal(size=(5, 4))
    unit = lambda y: y / np.linalg.norm(y, axis=1, keepdims=True)

    def backward(x, g):
        y = x @ w
        n = np.linalg.norm(y, axis=1, keepdims=True)
        u = y / n
        return {"w": x.T @ ((g - u * (g * u).sum(1, keepdims=True)) / n)}

    loss, gradients = cached_gradient_step(lambda x: unit(x @ w), backward, q, p, micro, 0.5)
    for i, j in ((0, 0), (4, 3), (2, 1)):
        values = []
        for step in (1e-5, -1e-5):
            v = w.copy()
            v[i, j] += step
            values.append(contrastive(unit(q @ v), unit(p @ v), 0.5)[0])
        assert gradients["w"][i, j] == pytest.approx((values[0] - values[1]) / 2e-5, abs=1e-6)
    assert math.sqrt((clipped({"w": gradients["w"] * 1000})["w"] ** 2).sum()) == pytest.approx(1, abs=1e-3)
    weights, optimiser = {"w": w.copy()}, AdamW()
    for _ in range(50):
        weights_before = weights["w"].copy()
        w = weights["w"]
        value, g = cached_gradient_step(lambda x: unit(x @ w), backward, q, p, micro, 0.5)
        optimiser.update(weights, clipped(g), 0.05)
    assert value < loss and not np.array_equal(weights_before, weights["w"])


def test_epoch_shares(spark):
    df = spark.range(23).withColumnRenamed("id", "k")
    shares = [{(r["rank"], r["step"]): r["k"] for r in epoch_shares(df, "k", e, 4).collect()} for e in (0, 0, 1)]
    assert set(shares[0]) == {(r, s) for r in range(4) for s in range(5)} and len(set(shares[0].values())) == 20
    assert shares[0] == shares[1] != shares[2]


def test_split_takes_no_share_of_the_table_into_one_task(spark):
    """Only rows with the border's hash digits are ordered, and no plan takes a share of the rows in order."""
    df = spark.range(20000).withColumnRenamed("id", "k")
    found = folds.exact_split(df, "k")
    assert "TakeOrdered" not in found._jdf.queryExecution().toString() and "GlobalLimit" not in found._jdf.queryExecution().toString()
    assert found.where("split = 'val'").count() == 2000 and found.count() == 20000


def test_training_control():
    assert linear_warmup(0, 1.0) == 0.01 and linear_warmup(500, 1.0) == 1.0
    rates = [one_cycle(s, 100, 1.0) for s in range(100)]
    assert max(rates) == pytest.approx(1.0, abs=0.01) and rates[0] == pytest.approx(1 / 25) and rates[-1] < 1e-4
    assert clamp_temperature(5) == 1.0 and clamp_temperature(-50) == 1e-4
    stop = EarlyStopping(2)
    assert [stop.update(x) for x in (3, 2, 2.5, 2)] == [(True, False), (True, False), (False, False), (False, True)]


def test_hashed_text_encode_takes_whole_texts(spark, tmp_path):
    from tessera.plans import catalogue

    start = " ".join(f"w{i}" for i in range(300))
    spark.createDataFrame([(1, start + " one"), (2, start + " other"), (3, None)], "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    found = {r["doc_id"]: [int(c) for c in r["components"].split(",")] for r in catalogue.QUERIES["hashed_text_encode"](spark, str(tmp_path)).collect()}
    assert len(found[1]) == 64 and found[1] != found[2] and found[3] == [0] * 64
