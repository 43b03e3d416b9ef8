import csv
import json
from contextlib import contextmanager

import numpy as np
import pytest

from tessera.__main__ import main
from tessera.operators.joins import MisalignedError
from tessera.plans.evaluate import Config, ResultCache, cached_summary, evaluate_formula, evaluate_text, summary
from tessera.plans import index_build
from tessera.plans.index_build import build_index, manifest, read_index, unstage, vacuum
from tessera.operators.encoders import GraphAttentionEncoder, HashedTokenEncoder
from tessera.sources.files import MissingInputError, Splits, formula_files, formula_topics, posts, posts_jsonl, posts_xml, qrel_precedence, qrels, text_topics
from tessera.sources.records import records
from tessera.streaming.incremental import last_write_wins

HEADER = ["id", "post_id", "thread_id", "type", "comment_id", "old_visual_id", "visual_id", "issue", "formula"]


def formula(i, text, issue="", visual=None):
    return [str(i), "7", "1", "answer", "", visual or f"v{i}", f"w{i}", issue, text]


def write_tsv(path, lines):
    path.parent.mkdir(parents=True, exist_ok=True)
    with open(path, "w", newline="") as out:
        csv.writer(out, delimiter="\t").writerows([HEADER, *lines])


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def test_formula_files(spark, tmp_path):
    odd = ['a "b"\tc', "d\ne", "f\\g", ""]
    write_tsv(tmp_path / "2.tsv", [formula(i, t) for i, t in enumerate(odd)])
    write_tsv(tmp_path / "10.tsv", [formula(9, "z")])
    found = formula_files(spark, f"{tmp_path}/*.tsv").select("shard", "id", "formula")
    assert rows(found) == sorted([(2, str(i), t) for i, t in enumerate(odd)] + [(10, "9", "z")], key=str)
    with pytest.raises(MissingInputError):
        formula_files(spark, f"{tmp_path}/none*")


@contextmanager
def small_splits(spark, size):
    """Files are read in ranges of ``size`` bytes, several to a task and larger ones first."""
    conf = {"spark.sql.files.maxPartitionBytes": str(size), "spark.sql.files.openCostInBytes": "0"}
    for key, value in conf.items():
        spark.conf.set(key, value)
    try:
        yield
    finally:
        for key in conf:
            spark.conf.unset(key)


@pytest.mark.parametrize("size", [1 << 20, 700, 90, 23])
def test_ranges_of_a_file_equal_the_reader(spark, tmp_path, size):
    rng = np.random.default_rng(size)
    parts = ["a", "é", '"', "\t", "\n", "\n\n", " ", "\\", "$x$", ","]
    texts = ["".join(rng.choice(parts, rng.integers(0, 12))) for _ in range(120)]
    texts[60] = "long\n" * 60  # crosses many of the ranges
    write_tsv(tmp_path / "3.tsv", [formula(i, t) for i, t in enumerate(texts[:100])])
    write_tsv(tmp_path / "4.tsv", [formula(i, t) for i, t in enumerate(texts[100:], 100)])
    (tmp_path / "5.tsv").write_text("\t".join(HEADER) + "\n")
    (tmp_path / "6.tsv").write_text("")
    with small_splits(spark, size):
        found = formula_files(spark, [f"{tmp_path}/{n}.tsv" for n in (3, 4, 5, 6)])
        if size < 1 << 20:
            assert found.rdd.getNumPartitions() >= 8
        assert rows(found.select("shard", "id", "formula")) == sorted([(3 if i < 100 else 4, str(i), t) for i, t in enumerate(texts)], key=str)


def test_a_header_that_crosses_ranges_is_no_record(spark, tmp_path):
    (tmp_path / "1.tsv").write_text('"i\n\nd"\t"' + "x" * 50 + '\ny"\n1\t"a\nb"\n\n2\tc')
    for size in (1 << 20, 40, 7, 3):
        with small_splits(spark, size):
            assert rows(records(spark, f"{tmp_path}/1.tsv").select("record")) == [('1\t"a\nb"',), ("2\tc",)]
            whole = records(spark, f"{tmp_path}/1.tsv", header=False).select("record")
            assert rows(whole) == sorted([('"i\n\nd"\t"' + "x" * 50 + '\ny"',), ('1\t"a\nb"',), ("2\tc",)])


@pytest.mark.parametrize("size", [1 << 20, 40])
def test_the_last_line_of_a_folder_wins(spark, tmp_path, size):
    folder = tmp_path / "year"
    folder.mkdir()
    for name, lines in (("a", 3), ("b", 40), ("c", 9)):  # Spark reads the largest file first
        (folder / name).write_text("".join(f"t{i % 2}\t0\td{i % 3}\t{ord(name) * 100 + i}\n" for i in range(lines)))
    want = {(f"t{i % 2}", f"d{i % 3}"): 9900.0 + i for i in range(9)}
    with small_splits(spark, size):
        assert {(r[0], r[1]): r[2] for r in qrels(spark, [str(folder)]).collect()} == want
        late = tmp_path / "0"
        late.write_text("t0\t0\td0\t1\n")
        assert {(r[0], r[1]): r[2] for r in qrels(spark, [str(folder), str(late)]).collect()} == want | {("t0", "d0"): 1.0}
        (folder / "a").write_text("<Topics>" + "".join(f'<Topic number="A.{i % 3}"><Latex>a{i}</Latex></Topic>\n' for i in range(20)) + "</Topics>")
        (folder / "b").write_text('<Topics><Topic number="A.1"><Latex>b</Latex></Topic></Topics>')
        (folder / "c").write_text("<Topics></Topics>")
        assert rows(formula_topics(spark, [str(folder)])) == [("A.0", "a18"), ("A.1", "b"), ("A.2", "a17")]


def test_index_build_and_increment(spark, tmp_path):
    for family in ("latex", "opt", "slt"):
        write_tsv(tmp_path / family / "1.tsv", [formula(1, " x "), formula(2, "", issue="bad"), formula(3, "y", issue="bad")])
    paths = [f"{tmp_path}/{f}/*.tsv" for f in ("latex", "opt", "slt")]
    out = str(tmp_path / "index")
    assert rows(build_index(spark, *paths, out)) == [(1, 3, "written")]
    kept = read_index(spark, out).select("id", "latex", "opt", "slt")
    assert rows(kept) == [(1, "x", "x", "x"), (2, "", None, None), (3, "y", None, None)]
    for family in ("latex", "opt", "slt"):
        write_tsv(tmp_path / family / "2.tsv", [formula(4, "n")])
        write_tsv(tmp_path / family / "1.tsv", [formula(1, "changed")])
    assert rows(build_index(spark, *paths, out)) == [(1, 3, "skipped"), (2, 1, "written")]
    assert rows(build_index(spark, *paths, out, force=True)) == [(1, 1, "written"), (2, 1, "written")]
    write_tsv(tmp_path / "opt" / "3.tsv", [formula(5, "n")])
    with pytest.raises(MisalignedError):
        build_index(spark, *paths, out)


def families(tmp_path, shard, ids):
    for f in index_build.FAMILIES:
        write_tsv(tmp_path / f / f"{shard}.tsv", [formula(i, f"x{i}") for i in ids])
    return [f"{tmp_path}/{f}/*.tsv" for f in index_build.FAMILIES]


@pytest.mark.parametrize("stop", ["write", "count", "publish"])
def test_a_build_that_dies_leaves_the_old_index(spark, tmp_path, monkeypatch, stop):
    out = str(tmp_path / "index")
    build_index(spark, *families(tmp_path, 1, [1, 2]), out)
    before, paths = rows(read_index(spark, out)), families(tmp_path, 2, [3])
    families(tmp_path, 1, [1, 2, 7])

    def dies(*_, **__):
        raise KeyboardInterrupt

    name = {"write": "exists", "count": "shard_sizes", "publish": "publish"}[stop]  # the first thing after the rows were written, and so on
    with monkeypatch.context() as patched:
        patched.setattr(index_build, name, dies)
        with pytest.raises(KeyboardInterrupt):
            build_index(spark, *paths, out, force=True)
    assert rows(read_index(spark, out)) == before and list(manifest(spark, out)) == [1]
    assert rows(build_index(spark, *paths, out)) == [(1, 2, "skipped"), (2, 1, "written")]
    vacuum(spark, out)
    assert len(list((tmp_path / "index").glob("build=*/shard=*"))) == 2 and len(list((tmp_path / "index").glob("manifest-*"))) == 1
    assert sorted(r["id"] for r in read_index(spark, out).collect()) == [1, 2, 3]


def test_of_two_builds_at_a_time_one_fails(spark, tmp_path, monkeypatch):
    out, paths = str(tmp_path / "index"), families(tmp_path, 1, [1])
    sizes = index_build.shard_sizes

    def slow(index):
        monkeypatch.setattr(index_build, "shard_sizes", sizes)
        build_index(spark, *paths, out)
        return sizes(index)

    monkeypatch.setattr(index_build, "shard_sizes", slow)
    with pytest.raises(RuntimeError, match="another build"):
        build_index(spark, *paths, out)
    assert read_index(spark, out).count() == 1


def test_building_from_staged_families_needs_no_shuffle(spark, tmp_path, monkeypatch):
    out, paths = str(tmp_path / "index"), families(tmp_path, 1, range(40))
    build_index(spark, *paths, out, staged="staged_test", buckets=3)
    plans = []
    joined = index_build.parallel_join

    def shown(frames, keys, strict):
        from tessera.operators.joins import misaligned

        index = joined(frames, keys, strict)
        plans.extend(d._jdf.queryExecution().executedPlan().toString() for d in (index, misaligned(frames, keys)))
        return index

    conf = "spark.sql.autoBroadcastJoinThreshold"
    try:
        spark.conf.set(conf, "-1")  # tables of any size
        monkeypatch.setattr(index_build, "parallel_join", shown)
        families(tmp_path, 2, range(100, 130))
        assert rows(build_index(spark, *paths, out, force=True, staged="staged_test", buckets=3)) == [(1, 40, "written"), (2, 30, "written")]
        assert len(plans) == 2 and not any("Exchange" in p for p in plans) and "SortMergeJoin" in plans[0]
        write_tsv(tmp_path / "opt" / "3.tsv", [formula(5, "n")])
        with pytest.raises(MisalignedError):
            build_index(spark, *paths, out, staged="staged_test", buckets=3)
    finally:
        spark.conf.unset(conf)
        unstage(spark, "staged_test")
    assert sorted(r["id"] for r in read_index(spark, out).collect()) == [*range(40), *range(100, 130)]


POSTS = """<posts>
<row Id="1" PostTypeId="1" Body="&lt;p&gt;q&lt;/p&gt;" />
<row Id="2" PostTypeId="2" Body="&lt;p&gt;a &amp;lt; &lt;span class=&quot;math-container&quot;&gt;$x$&lt;/span&gt;&lt;/p&gt;" />
<row Id="3" PostTypeId="2" Body="" />
<row PostTypeId="2" Body="b" />
</posts>"""


def test_posts(spark, tmp_path):
    xml, lines = tmp_path / "posts.xml", tmp_path / "posts.jsonl"
    with pytest.raises(MissingInputError):
        posts(spark, str(xml), str(lines))
    records = [{"post_id": 5, "post_type": "answer", "title": "t", "text": "$y$", "formulas": ["z", ""]}, {"post_type": "question"}, {"post_id": "6", "post_type": "answer"}]
    lines.write_text("\n".join([json.dumps(r) for r in records] + ["{bad"]))
    assert rows(posts(spark, str(xml), str(lines))) == [("5", "t [MATH]y[/MATH] [MATH]z[/MATH]")]
    assert posts_jsonl(spark, str(lines), "other").count() == 0
    xml.write_text(POSTS)
    assert rows(posts(spark, str(xml), str(lines))) == [("", "b"), ("2", "a < [MATH]x[/MATH]")]
    assert rows(posts_xml(spark, str(xml), "question")) == [("1", "q")]
    assert posts_xml(spark, str(xml), None).count() == posts_xml(spark, str(xml), "unknown").count() == 3


def test_topics(spark, tmp_path):
    a, b = tmp_path / "a.xml", tmp_path / "b.xml"
    a.write_text('<Topics><Topic number="A.1"><Title>T</Title><Question>&lt;p&gt;is $x$?&lt;/p&gt;</Question></Topic><Topic number="A.2"><Title> </Title></Topic><Topic><Title>n</Title></Topic></Topics>')
    b.write_text('<Topics><Topic number="A.1"><Title>new</Title></Topic><Topic number="B.1"><Latex> x </Latex></Topic><Topic number="B.2"><Latex> </Latex></Topic></Topics>')
    assert rows(text_topics(spark, [str(a)])) == [("A.1", "T is [MATH]x[/MATH]?")]
    assert rows(text_topics(spark, [str(a), str(b)])) == [("A.1", "new")]
    assert rows(formula_topics(spark, [str(b)])) == [("B.1", "x")]


def test_qrels(spark, tmp_path):
    a, b = tmp_path / "a", tmp_path / "b.tsv"
    a.write_text("t\t0\td\t1.5\nt\t0\te\n\nt\t0\tf\tbad\nt\t0\td\t2\n")
    b.write_text("t\t0\td\t3\t\n")
    assert rows(qrels(spark, [str(a)])) == [("t", "d", 2.0)]
    assert rows(qrels(spark, [str(a), str(b)])) == [("t", "d", 3.0)]
    with pytest.raises(Exception, match="CAST_INVALID_INPUT"):
        qrels(spark, [str(a)], on_bad_grade="error").collect()
    assert qrel_precedence(["y2/q_all", "y1/q_all", "y1/q_official"]) == ["y1/q_official", "y1/q_all", "y2/q_all"]
    with pytest.raises(ValueError, match="split"):
        Splits({"train": []}, {}).of("topics", "dev")


def test_evaluation(spark, tmp_path):
    topics = spark.createDataFrame([("t", "red apple"), ("u", "blue sky")], "topic_id string, query string")
    texts = spark.createDataFrame([("1", "red apple"), ("2", "blue sky"), ("3", "x y z")], "post_id string, text string")
    judged = spark.createDataFrame([("t", "1", 2.0), ("u", "3", 1.0)], "topic_id string, doc_id string, grade double")
    found = evaluate_text(topics, texts, judged, HashedTokenEncoder(64), k=3, quick=True)
    got = {r["topic_id"]: r for r in found.collect()}
    assert got["t"]["ndcg_10"] == 1.0 and got["u"]["map_10"] < 1.0
    assert set(summary(found).columns) == {f"{m}_{c}" for m in ("ndcg", "map") for c in (10, 100, 1000)}
    cache = ResultCache(str(tmp_path / "c" / "cache.json"))
    key = {"checkpoint_mtime": 1.0, "top_k": 3}
    first = cached_summary(cache, key, lambda: found)
    assert cached_summary(cache, key, lambda: None) == first
    with pytest.raises(AttributeError):
        cached_summary(cache, {**key, "top_k": 4}, lambda: None)
    index = spark.createDataFrame([("v1", "x", "<math><ci/></math>", 0), ("v2", "y", "<math><cn/><ci/></math>", 1), ("v3", "z", None, 2)], "old_visual_id string, latex string, opt string, id int")
    formulas = spark.createDataFrame([("t", "x"), ("u", "none")], "topic_id string, query string")
    graded = spark.createDataFrame([("t", "v1", 3.0), ("u", "v1", 3.0)], "topic_id string, doc_id string, grade double")
    gat = GraphAttentionEncoder(hidden=4, heads=1, layers=1, embedding=4, dimension=8)
    per = evaluate_formula(formulas, index, graded, gat, ["id"], k=5).collect()
    assert [(r["topic_id"], r["ndcg_10"]) for r in per] == [("t", 1.0)]


def test_config(tmp_path):
    path = tmp_path / "c.yaml"
    path.write_text("model:\n  max_length: 256\ntraining:\n  batch_size: 256\n  epochs: 20\n")
    found = Config.load(str(path), batch_size=8, mini_batch_size=None)
    assert found.training == {"batch_size": 8, "epochs": 20} and found.model == {"max_length": 256}


def test_streamed_last_write_wins(spark, tmp_path):
    source, state = tmp_path / "in", tmp_path / "state"
    for batch in ([("a", 1, 0), ("b", 1, 1)], [("a", 2, 2)], [("b", 0, 0), ("c", 3, 3)]):
        spark.createDataFrame(batch, "k string, v int, o int").coalesce(1).write.mode("append").parquet(str(source))
        stream = spark.readStream.schema("k string, v int, o int").parquet(str(source))
        last_write_wins(stream, ["k"], "v", ["o"], str(state), str(tmp_path / "cp")).trigger(availableNow=True).start().awaitTermination()
    assert rows(spark.read.parquet(f"{state}/version=1")) == [("a", 2, 2), ("b", 1, 1)]
    assert rows(spark.read.parquet(f"{state}/version=2")) == [("a", 2, 2), ("b", 1, 1), ("c", 3, 3)]
    assert not (state / "version=0").exists()


def test_commands(spark, tmp_path, capsys):
    for family in ("latex", "opt", "slt"):
        write_tsv(tmp_path / family / "1.tsv", [formula(1, "x" if family == "latex" else "<math><ci/></math>"), formula(2, "y" if family == "latex" else "<math><cn/><ci/></math>")])
    out = str(tmp_path / "index")
    given = [x for f in ("latex", "opt", "slt") for x in (f"--{f}", f"{tmp_path}/{f}/*.tsv")]
    assert main(["index", *given, "--out", out], spark) == {"written": 1, "skipped": 0, "rows": 2}
    assert main(["index", *given, "--out", out], spark) == {"written": 0, "skipped": 1, "rows": 2}
    topics, judged, lines = tmp_path / "t.xml", tmp_path / "q.tsv", tmp_path / "p.jsonl"
    topics.write_text('<Topics><Topic number="t"><Title>red apple</Title><Latex>x</Latex></Topic></Topics>')
    judged.write_text("t\t0\tv1\t3\nt\t0\t5\t1\n")
    lines.write_text(json.dumps({"post_id": "5", "post_type": "answer", "text": "red apple"}) + "\n" + json.dumps({"post_id": "6", "post_type": "answer", "text": "sky"}))
    common = ["--topics", str(topics), "--qrels", str(judged)]
    text = main(["eval-text", *common, "--posts-jsonl", str(lines), "--cache", str(tmp_path / "r.json")], spark)
    assert main(["eval-text", *common, "--posts-jsonl", str(lines), "--cache", str(tmp_path / "r.json")], spark) == text
    assert main(["eval-formula", *common, "--index", out], spark)["map_10"] == 1.0
    assert "map_10\t1.0000" in capsys.readouterr().out
    splits = tmp_path / "splits.json"
    splits.write_text(json.dumps({"topics": {"dev": [str(topics)]}, "qrels": {"dev": [str(judged)]}}))
    assert main(["eval-text", "--splits", str(splits), "--split", "dev", "--posts-jsonl", str(lines)], spark) == text
    with pytest.raises(ValueError, match="split must be"):
        main(["eval-text", "--splits", str(splits), "--split", "test", "--posts-jsonl", str(lines)], spark)
    with pytest.raises(ValueError, match="are needed"):
        main(["eval-text", "--posts-jsonl", str(lines)], spark)
    topics.write_text('<Topics><Topic number="t"><Latex>x</Latex></Topic><Topic number="u"><Latex>none</Latex></Topic></Topics>')
    main(["eval-formula", *common, "--index", out], spark)
    assert "1 topics unmatched, for example u" in capsys.readouterr().err
