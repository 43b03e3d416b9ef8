"""The formula index: three parallel file families joined on shard and id, written by shard and published by a manifest.

A build writes its shards under a folder of its own, ``out/build=<id>/shard=<n>``, and then publishes a
manifest, one line a shard with its build and row count, by renaming a finished file to
``out/manifest-<version>``.  Readers take the newest manifest, so a build that dies half-way, at any place,
leaves the old index as it was, and of two builds at a time one fails.  What no manifest needs any more is
removed by ``vacuum``.

With ``staged``, the families are first written as tables bucketed and sorted by shard and id, new
shards only.  Checks and joins of such tables need no shuffle, so building again costs a merge.
"""

from __future__ import annotations

import json
import re
import uuid
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions.text import strip
from tessera.operators.joins import issue_null, parallel_join
from tessera.sources.files import exists, formula_files, formula_schema, listed, need, remove, shard_of

FAMILIES = ("latex", "opt", "slt")


def family(rows: DataFrame, name: str) -> DataFrame:
    """What the index takes of a family's files.  LaTeX ignores the issue flag; the trees are null under it."""
    key = ["shard", F.col("id").cast("long").alias("id")]
    if name == "latex":
        return rows.select(*key, F.col("post_id").cast("long").alias("post_id"), "type", "old_visual_id", "visual_id", strip(F.col("formula")).alias("latex"))
    return rows.select(*key, issue_null("formula", "issue").alias(name))


def assemble(latex: DataFrame, opt: DataFrame, slt: DataFrame, strict: bool = True, optional: tuple[str, ...] = ()) -> DataFrame:
    """The index columns and ``shard`` from the families' files."""
    return parallel_join({n: family(rows, n) for n, rows in zip(FAMILIES, (latex, opt, slt), strict=True)}, ["shard", "id"], strict, optional)


def missing_shards(available: DataFrame, written: DataFrame) -> DataFrame:
    """Rows of shards that aren't written yet."""
    return available.join(written.select("shard").distinct(), "shard", "left_anti")


def shard_sizes(index: DataFrame) -> DataFrame:
    """shard, n_rows."""
    return index.groupBy("shard").agg(F.count(F.lit(1)).alias("n_rows"))


# The manifest


@dataclass(frozen=True)
class Shard:
    """A published shard."""

    shard: int
    n_rows: int
    build: str


def _file_system(spark: SparkSession, path: str):
    found = spark._jvm.org.apache.hadoop.fs.Path(path)
    return found, found.getFileSystem(spark._jsc.hadoopConfiguration())


def _versions(spark: SparkSession, out: str) -> dict[int, str]:
    return {int(m[1]): p for p in listed(spark, f"{out}/manifest-*") if (m := re.search(r"/manifest-(\d+)$", p))}


def manifest(spark: SparkSession, out: str) -> dict[int, Shard]:
    """The published shards by number; none if nothing was published."""
    versions = _versions(spark, out)
    lines = [r["value"] for r in spark.read.text(versions[max(versions)]).collect()] if versions else []  # a line a shard
    return {s.shard: s for s in (Shard(**json.loads(line)) for line in lines)}


def publish(spark: SparkSession, out: str, shards: dict[int, Shard], after: int) -> None:
    """Make ``shards`` the index; fails if another manifest was published since version ``after``."""
    draft, system = _file_system(spark, f"{out}/_draft-{uuid.uuid4().hex}")
    stream = system.create(draft, False)
    try:
        stream.write(bytearray("".join(json.dumps(vars(s)) + "\n" for _, s in sorted(shards.items())).encode()))
    finally:
        stream.close()
    target, _ = _file_system(spark, f"{out}/manifest-{after + 1:08d}")
    if system.exists(target) or not system.rename(draft, target):
        system.delete(draft, False)
        raise RuntimeError(f"another build published {target}")


def read_index(spark: SparkSession, out: str) -> DataFrame:
    """The published index with ``shard``."""
    paths = [f"{out}/build={s.build}/shard={s.shard}" for s in manifest(spark, out).values()]
    if not paths:
        raise FileNotFoundError(f"no index was published at {out}")
    return spark.read.option("basePath", out).parquet(*paths).drop("build")


def vacuum(spark: SparkSession, out: str) -> None:
    """Remove older manifests and builds' shards that the newest one doesn't name.  Not while others read or build."""
    versions, named = _versions(spark, out), {f"build={s.build}/shard={s.shard}" for s in manifest(spark, out).values()}
    for version, path in versions.items():
        if version != max(versions):
            remove(spark, path)
    path, system = _file_system(spark, f"{out}/build=*/shard=*")
    for status in system.globStatus(path) or []:
        found = status.getPath()
        if f"{found.getParent().getName()}/{found.getName()}" not in named:
            system.delete(found, True)
    path, system = _file_system(spark, f"{out}/_draft-*")
    for status in system.globStatus(path) or []:
        system.delete(status.getPath(), False)


# The build


def _stage(spark: SparkSession, table: str, name: str, files: dict[int, list[str]], buckets: int) -> DataFrame:
    """The family's bucketed table, with the shards that it lacked."""
    known = {r[0] for r in spark.table(table).select("shard").distinct().collect()} if spark.catalog.tableExists(table) else set()  # a row a shard
    new = [f for shard, some in files.items() if shard not in known for f in some]
    if new or not spark.catalog.tableExists(table):
        rows = formula_files(spark, new) if new else spark.createDataFrame([], formula_schema())
        family(rows, name).write.mode("append").format("parquet").bucketBy(buckets, "shard", "id").sortBy("shard", "id").saveAsTable(table)
    return spark.table(table).where(F.col("shard").isin(list(files)))


def unstage(spark: SparkSession, staged: str) -> None:
    """Drop the bucketed tables."""
    for name in FAMILIES:
        spark.sql(f"DROP TABLE IF EXISTS {staged}_{name}")


def build_index(spark: SparkSession, latex_path: str, opt_path: str, slt_path: str, out: str, force: bool = False, strict: bool = True, staged: str | None = None, buckets: int = 64) -> DataFrame:
    """Write and publish the missing shards (all of them with ``force``) and return shard, n_rows, status.

    Shards are files, so those that are published already aren't read again, nor are the files of new ones
    counted: a count by shard reads no column, only footers.  ``staged`` names the bucketed tables, if they are to be used;
    files that changed under a staged number need ``unstage`` first.
    """
    version = max(_versions(spark, out), default=0)
    old = manifest(spark, out)
    done = set() if force else set(old)
    found: dict[str, dict[int, list[str]]] = {}
    for name, path in zip(FAMILIES, (latex_path, opt_path, slt_path), strict=True):
        found[name] = {}
        for file in listed(spark, need(spark, path)[0]):
            if file.endswith(".tsv") and (shard := shard_of(file)) is not None and shard not in done:
                found[name].setdefault(shard, []).append(file)
    new: dict[int, Shard] = {}
    if any(found.values()):
        if staged is None:
            files = {n: [f for some in found[n].values() for f in some] for n in FAMILIES}
            rows = [formula_files(spark, files[n]) if files[n] else spark.createDataFrame([], formula_schema()) for n in FAMILIES]
            index = assemble(*rows, strict=strict)
        else:
            index = parallel_join({n: _stage(spark, f"{staged}_{n}", n, found[n], buckets) for n in FAMILIES}, ["shard", "id"], strict)
        build = uuid.uuid4().hex
        index.write.option("compression", "snappy").partitionBy("shard").parquet(f"{out}/build={build}")
        if exists(spark, f"{out}/build={build}/shard=*"):
            sizes = shard_sizes(spark.read.parquet(f"{out}/build={build}")).collect()  # a row a shard
            new = {r["shard"]: Shard(r["shard"], r["n_rows"], build) for r in sizes}
            publish(spark, out, old | new, version)
    status = [(s.shard, s.n_rows, "written" if s.shard in new else "skipped") for s in (old | new).values()]
    return spark.createDataFrame(status, "shard int, n_rows long, status string")
