import numpy as np
from pyspark.sql import functions as F

import corpus_pipeline
from tessera.llm.queries import ORACLE_SQL, QUERIES


def test_names():
    assert sorted(int(n[2:].split("_")[0]) for n in QUERIES) == list(range(1, 14)) and set(ORACLE_SQL) <= set(QUERIES)
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality", "exact dedup", "near dedup", "repeats", "packing"]


def test_pipeline(spark, tmp_path):
    rng = np.random.default_rng(5)
    words = [a + b + c for a in ("ka", "lo", "mi", "ru") for b in ("ta", "ne", "so") for c in ("", "n", "s", "ri")]
    passage = " ".join(f"passage{i}" for i in range(60))
    rows, labels = [], []
    for i in range(240):
        good = i % 6 != 0
        text = " ".join(rng.choice(words, 120)) + "." if good else "BUY!! NOW!! " * 40
        if i in (50, 70):
            text += " " + passage
        rows.append((i, text + (f" {i}" if not good else "")))
        labels.append((i, int(good), 0))
    base = rows[1][1]
    rows += [(300, base), (301, base), (302, base.replace(" ", " extra ", 1)), (303, base)]
    source = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    source.write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    docs, seen = source, {}
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, str(tmp_path))
        out.write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        seen[name] = docs.collect()
        if name != "packing":
            assert docs.columns == source.columns
    ids = {k: sorted(r["doc_id"] for r in v) for k, v in seen.items()}
    clean = {i for i in range(240) if i % 6}
    assert set(ids["quality"]) == clean | {300, 301, 302, 303}
    assert set(ids["exact dedup"]) == clean - {1} | {302, 303}
    assert set(ids["near dedup"]) == clean - {1} | {302}
    texts = {r["doc_id"]: r["text"] for r in seen["repeats"]}
    assert passage in texts[50] and "passage30" not in texts[70] and set(texts) == set(ids["near dedup"])
    assert all(r["n_chars"] == len(r["text"]) for r in seen["repeats"])
    assert {r["doc_id"] for r in seen["packing"]} == set(texts)
    assert corpus_pipeline.run(spark, str(tmp_path)).agg(F.sum("length")).first()[0] == sum(r["length"] for r in seen["packing"])
