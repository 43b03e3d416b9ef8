"""Commands: ``python -m tessera index | eval-text | eval-formula``."""

from __future__ import annotations

import argparse
import dataclasses
import json
import os
import sys
from collections.abc import Sequence
from typing import Any

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from tessera.operators.encoders import GraphAttentionEncoder, HashedTokenEncoder, load
from tessera.operators.retrieval import macro
from tessera.plans.evaluate import SHOWN, Config, ResultCache, cached_summary, evaluate_formula, evaluate_text, resolved
from tessera.plans.index_build import build_index, manifest, read_index
from tessera.sources.files import Splits, formula_topics, posts, qrel_precedence, qrels, text_topics


def _parser() -> argparse.ArgumentParser:
    parser = argparse.ArgumentParser(prog="tessera", description=__doc__)
    commands = parser.add_subparsers(dest="command", required=True)
    index = commands.add_parser("index", help="join formula files into the index, shard by shard")
    for family in ("latex", "opt", "slt"):
        index.add_argument(f"--{family}", required=True, help="path or glob of the family's .tsv files")
    index.add_argument("--out", required=True)
    index.add_argument("--force", action="store_true", help="write shards that are there already")
    for name in ("eval-text", "eval-formula"):
        command = commands.add_parser(name, help="encode, search and score")
        command.add_argument("--topics", nargs="+", default=[], help="files, later ones win")
        command.add_argument("--qrels", nargs="+", default=[], help="files, later ones win")
        command.add_argument("--splits", help='JSON file of named splits: {"topics": {"dev": [...]}, "qrels": {"dev": [...]}}')
        command.add_argument("--split", help="the split to take topics and judgments from, in place of --topics and --qrels")
        command.add_argument("--top-k", type=int, default=1000)
        command.add_argument("--quick-run", action="store_true", help="a sample of the corpus; not for reporting")
        command.add_argument("--prime", action="store_true", help="rank judged documents only")
        command.add_argument("--cache", help="JSON file that keeps the results")
        command.add_argument("--force", action="store_true", help="don't read the cache")
        command.add_argument("--checkpoint", help="file with the encoder; without it, the stand-in")
        command.add_argument("--batch-size", type=int, default=64 if name == "eval-text" else 512)
        command.add_argument("--config", help="YAML file; its model settings are those of the stand-in")
        if name == "eval-text":
            command.add_argument("--posts-xml", default="")
            command.add_argument("--posts-jsonl", default="")
        else:
            command.add_argument("--index", required=True)
    return parser


def main(arguments: Sequence[str] | None = None, spark: SparkSession | None = None) -> dict[str, Any]:
    """Run a command and return what it prints."""
    given = _parser().parse_args(arguments)
    if spark is None:
        spark = SparkSession.builder.appName("tessera").getOrCreate()
    if given.command == "index":
        rows = build_index(spark, given.latex, given.opt, given.slt, given.out, given.force).orderBy("shard").collect()
        found: dict[str, Any] = {s: sum(r["status"] == s for r in rows) for s in ("written", "skipped")} | {"rows": sum(r["n_rows"] for r in rows)}
        print(json.dumps(found))
        return found
    if given.split:
        with open(given.splits or "") as source:
            splits = Splits(**json.load(source))
        given.topics, given.qrels = splits.of("topics", given.split), qrel_precedence(splits.of("qrels", given.split))
    if not given.topics or not given.qrels:
        raise ValueError("--topics and --qrels, or --splits and --split, are needed")
    key = {k: v for k, v in vars(given).items() if k not in ("cache", "force", "batch_size")}
    if given.checkpoint:
        key["checkpoint_mtime"] = os.path.getmtime(given.checkpoint)
    stand_in = HashedTokenEncoder if given.command == "eval-text" else GraphAttentionEncoder
    settings = Config.load(given.config).model if given.config else {}
    encoder = load(given.checkpoint)[0] if given.checkpoint else stand_in(**{k: v for k, v in settings.items() if k in {f.name for f in dataclasses.fields(stand_in)}})
    judged = qrels(spark, given.qrels, "skip" if given.command == "eval-text" else "error")

    def scored():
        if given.command == "eval-text":
            corpus = posts(spark, given.posts_xml, given.posts_jsonl)
            return evaluate_text(text_topics(spark, given.topics), corpus, judged, encoder, given.top_k, given.quick_run, prime=given.prime, batch_size=given.batch_size)
        index = read_index(spark, given.index) if manifest(spark, given.index) else spark.read.parquet(given.index)
        order = ["shard", "id"] if "shard" in index.columns else ["id"]
        topics = formula_topics(spark, given.topics)
        missing = resolved(topics, index, order).where("status <> 'resolved'").groupBy("status").agg(F.count(F.lit(1)).alias("n"), F.min("topic_id").alias("first"))
        for row in missing.orderBy("status").collect():  # a row a status
            print(f"{row['n']} topics {row['status']}, for example {row['first']}", file=sys.stderr)
        return evaluate_formula(topics, index, judged, encoder, order, given.top_k, given.quick_run, prime=given.prime, batch_size=given.batch_size)

    values = cached_summary(ResultCache(given.cache), key, scored, given.force) if given.cache else macro(scored()).first().asDict()
    for name, value in values.items():
        if int(name.rpartition("_")[2]) in SHOWN and value is not None:
            print(f"{name}\t{value:.4f}")
    return values


if __name__ == "__main__":
    main()
