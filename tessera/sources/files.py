"""Readers: tab-separated formula files, posts, topics, judgments, and the split's file lists."""

from __future__ import annotations

import re
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera import schemas
from tessera.functions.text import formula_list, html_to_text, join_parts, latex_dollars, strip
from tessera.operators.folds import last_by
from tessera.sources.records import records

# The type codes of posts.
POST_TYPES = {"question": "1", "answer": "2"}


class MissingInputError(FileNotFoundError):
    """A path that a reader needs isn't there."""


def exists(spark: SparkSession, path: str) -> bool:
    """Whether ``path`` (globs allowed) is there, on any file system that Spark reads; "" never is."""
    if not path:
        return False
    jvm = spark._jvm
    found = jvm.org.apache.hadoop.fs.Path(path)
    matches = found.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(found)
    return matches is not None and len(matches) > 0


def remove(spark: SparkSession, path: str) -> None:
    """Remove the file or folder ``path``, if it is there."""
    found = spark._jvm.org.apache.hadoop.fs.Path(path)
    found.getFileSystem(spark._jsc.hadoopConfiguration()).delete(found, True)


def listed(spark: SparkSession, path: str) -> list[str]:
    """The files that ``path`` names: itself, those a glob matches, or those in a folder."""
    found = spark._jvm.org.apache.hadoop.fs.Path(path)
    system = found.getFileSystem(spark._jsc.hadoopConfiguration())
    out = []
    for status in system.globStatus(found) or []:
        inner = system.listStatus(status.getPath()) if status.isDirectory() else [status]
        out += [s.getPath().toString() for s in inner if s.isFile()]
    return sorted(out)


def shard_of(path: str) -> int | None:
    """The number in a formula file's name."""
    found = re.search(r"(\d+)\.tsv$", path)
    return int(found[1]) if found else None


def need(spark: SparkSession, *paths: str) -> list[str]:
    for path in paths:
        if not exists(spark, path):
            raise MissingInputError(path)
    return list(paths)


def formula_schema() -> T.StructType:
    return T.StructType([*schemas.FORMULA_FILE.fields, T.StructField("shard", T.IntegerType())])


def formula_files(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """The columns of the formula files at ``path`` and ``shard``, the number in each file's name.

    Quotes are doubled, and may hold tabs and line breaks.  Empty fields are empty texts.  A large file is
    read in ranges (``records``).
    """
    need(spark, *([path] if isinstance(path, str) else path))
    options = {"sep": "\t", "quote": '"', "escape": '"', "maxCharsPerColumn": "-1"}
    fields = F.from_csv(F.regexp_replace("record", r"\r\z", ""), schemas.FORMULA_FILE.simpleString().removeprefix("struct<").removesuffix(">").replace(":", " "), options)
    rows = records(spark, path).select(fields.alias("f"), F.regexp_extract("path", r"(\d+)\.tsv$", 1).try_cast("int").alias("shard"))
    return rows.select(*[F.coalesce(F.col(f"f.{c}"), F.lit("")).alias(c) for c in schemas.FORMULA_FILE.names], "shard")


def posts_xml(spark: SparkSession, path: str, post_type: str | None = "answer", mode: str = "FAILFAST") -> DataFrame:
    """post_id, text of the posts of a type (any, for None or an unknown type) with some text."""
    need(spark, path)
    schema = T.StructType([T.StructField(n, T.StringType()) for n in ("_Id", "_PostTypeId", "_Body")])
    rows = spark.read.format("xml").options(rowTag="row", mode=mode, ignoreSurroundingSpaces=False).schema(schema).load(path)
    if code := POST_TYPES.get(post_type or ""):
        rows = rows.where(F.col("_PostTypeId") == code)
    texts = rows.select(F.coalesce("_Id", F.lit("")).alias("post_id"), html_to_text(F.coalesce("_Body", F.lit(""))).alias("text"))
    return texts.where(F.length("text") > 0)


def posts_jsonl(spark: SparkSession, path: str, post_type: str | None = "answer") -> DataFrame:
    """The same from JSON lines; invalid lines are skipped, formulas are appended to the text."""
    need(spark, path)
    rows = spark.read.schema(schemas.POST_LINES).option("mode", "DROPMALFORMED").json(path)
    if post_type:
        rows = rows.where(F.col("post_type") == post_type)
    text = latex_dollars(join_parts(F.col("title"), F.col("text"), formula_list(F.coalesce("formulas", F.array().cast("array<string>")))))
    return rows.select(F.coalesce("post_id", F.lit("")).alias("post_id"), text.alias("text")).where(F.length("text") > 0)


def posts(spark: SparkSession, xml_path: str, jsonl_path: str, post_type: str | None = "answer") -> DataFrame:
    """XML if it is there, else JSON lines, else MissingInputError."""
    if exists(spark, xml_path):
        return posts_xml(spark, xml_path, post_type)
    if exists(spark, jsonl_path):
        return posts_jsonl(spark, jsonl_path, post_type)
    raise MissingInputError(f"{xml_path} or {jsonl_path}")


#: Columns of ``in_order``: lines and elements by file, split and place in the split.
ORDER = ("file_ord", "file", "block", "place")


def in_order(parts: list[DataFrame]) -> DataFrame:
    """Rows of several reads, in that order, with the columns of ``ORDER``; files of one read go by their paths.

    A split is read by one task from its start to its end, so an increasing number is a place in it; Spark
    packs splits into tasks by size, so that number alone is no order of a folder's or a large file's lines.
    """
    where = lambda i: [F.lit(i).alias("file_ord"), F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("place")]
    return reduce(DataFrame.unionByName, [p.select("*", *where(i)) for i, p in enumerate(parts)])


def _topic_files(spark: SparkSession, paths: list[str], fields: list[str], tag: str) -> DataFrame:
    schema = T.StructType([T.StructField(n, T.StringType()) for n in ("_number", *fields)])
    reader = spark.read.format("xml").options(rowTag=tag, mode="FAILFAST").schema(schema)
    return in_order([reader.load(p) for p in need(spark, *paths)]).where(F.length(F.coalesce("_number", F.lit(""))) > 0)


def text_topics(spark: SparkSession, paths: list[str], tag: str = "Topic") -> DataFrame:
    """topic_id, query: title and question as text; of a repeated number the last one counts."""
    rows = _topic_files(spark, paths, ["Title", "Question"], tag)
    whole = strip(F.concat_ws(" ", html_to_text(F.coalesce("Title", F.lit(""))), html_to_text(F.coalesce("Question", F.lit("")))))
    texts = rows.select(F.col("_number").alias("topic_id"), latex_dollars(whole).alias("query"), *ORDER).where(F.length("query") > 0)
    return last_by(texts, ["topic_id"], "query", list(ORDER))


def formula_topics(spark: SparkSession, paths: list[str], tag: str = "Topic") -> DataFrame:
    """topic_id, query: the stripped formula; topics without one are skipped."""
    rows = _topic_files(spark, paths, ["Latex"], tag)
    texts = rows.select(F.col("_number").alias("topic_id"), strip(F.coalesce("Latex", F.lit(""))).alias("query"), *ORDER).where(F.length("query") > 0)
    return last_by(texts, ["topic_id"], "query", list(ORDER))


def parse_qrels(lines: DataFrame, on_bad_grade: str = "skip", order: tuple[str, ...] = ORDER) -> DataFrame:
    """topic_id, doc_id, grade from ``value`` and the columns of ``order``.

    Lines of fewer than four fields are skipped; a grade that isn't a number is skipped or, with
    ``on_bad_grade="error"``, fails the job.  Of a repeated judgment the last one counts.
    """
    fields = F.split(strip(F.col("value")), "\t")
    rows = lines.select(fields.alias("f"), *order).where(F.size("f") >= 4)
    number = F.regexp_replace(strip(F.col("f")[3]), "_", "")
    grade = number.try_cast("double") if on_bad_grade == "skip" else number.cast("double")
    rows = rows.select(F.col("f")[0].alias("topic_id"), F.col("f")[2].alias("doc_id"), grade.alias("grade"), *order)
    if on_bad_grade == "skip":
        rows = rows.where(F.col("grade").isNotNull())
    return last_by(rows, ["topic_id", "doc_id"], "grade", list(order))


def qrels(spark: SparkSession, paths: list[str], on_bad_grade: str = "skip") -> DataFrame:
    """Judgments of the files in order; later files and lines win, also those of a folder or a glob."""
    return parse_qrels(in_order([spark.read.text(p) for p in need(spark, *paths)]), on_bad_grade)


def qrel_precedence(paths: list[str]) -> list[str]:
    """Files in the order in which later ones win: by folder (year), then official before all others."""
    return sorted(paths, key=lambda p: (p.rpartition("/")[0], "official" not in p.rpartition("/")[2], p))


@dataclass(frozen=True)
class Splits:
    """Files of each split; any other split raises."""

    topics: dict[str, list[str]] = field(default_factory=dict)
    qrels: dict[str, list[str]] = field(default_factory=dict)

    def of(self, kind: str, split: str) -> list[str]:
        known = getattr(self, kind)
        if split not in known:
            raise ValueError(f"split must be one of {sorted(known)}, not {split!r}")
        return known[split]
