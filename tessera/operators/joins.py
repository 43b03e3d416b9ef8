"""Joins of parallel representations and lookups."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


class MisalignedError(ValueError):
    """Parallel inputs don't hold the same keys."""


def alignment(frames: dict[str, DataFrame], keys: list[str]) -> DataFrame:
    """Keys that aren't in every frame exactly once: keys, and each frame's count."""
    parts = [f.select(*keys, *[F.lit(int(n == name)).alias(f"n_{n}") for n in frames]) for name, f in frames.items()]
    whole = reduce(DataFrame.unionByName, parts).groupBy(*keys).agg(*[F.sum(f"n_{n}").alias(f"n_{n}") for n in frames])
    return whole.where(reduce(lambda a, b: a | b, [F.col(f"n_{n}") != 1 for n in frames]))


def misaligned(frames: dict[str, DataFrame], keys: list[str]) -> DataFrame:
    """Keys that aren't exactly once in the first frame and in each other: keys, perhaps several times.

    Each frame is counted by key and the counts are joined pair by pair, so frames that are bucketed by the
    keys meet without a shuffle.
    """
    first, *rest = [f.groupBy(*keys).agg(F.count(F.lit(1)).alias(f"n_{i}")) for i, f in enumerate(frames.values())]
    if not rest:
        return first.where("n_0 <> 1").select(*keys)
    once = lambda n: F.coalesce(F.col(n), F.lit(0)) == 1
    return reduce(DataFrame.unionByName, [first.join(r, keys, "full").where(~(once("n_0") & once(f"n_{i}"))).select(*keys) for i, r in enumerate(rest, 1)])


def parallel_join(frames: dict[str, DataFrame], keys: list[str], strict: bool = True, optional: tuple[str, ...] = ()) -> DataFrame:
    """Inner join of all frames on ``keys`` (left join for ``optional`` ones).

    ``strict`` raises if any key is missing somewhere or repeated; otherwise such keys are dropped.
    """
    needed = {n: f for n, f in frames.items() if n not in optional}
    if strict and (bad := misaligned(needed, keys).limit(5).collect()):
        raise MisalignedError(f"keys not in every input exactly once, for example {[tuple(r[k] for k in keys) for r in bad]}")
    first, *rest = [f for n, f in frames.items() if n in needed]
    joined = reduce(lambda a, b: a.join(b, keys), rest, first)
    return reduce(lambda a, n: a.join(frames[n], keys, "left"), optional, joined)


def issue_null(formula: str, issue: str) -> F.Column:
    """Null where the issue flag isn't blank or the formula is blank, else the stripped formula."""
    from tessera.functions.text import strip

    blank = F.length(strip(F.coalesce(F.col(issue), F.lit("")))) == 0
    return F.when(blank, F.nullif(strip(F.coalesce(F.col(formula), F.lit(""))), F.lit("")))


PAGE = 1 << 15  # bits of a page of a filter


def bloom_pages(ids: DataFrame, id_column: str, pages: int) -> DataFrame:
    """A Bloom filter as pages of bits: an id sets three bits of one page, so ``pages`` x 4 KB whatever the ids."""
    h = F.xxhash64(F.col(id_column).cast("string"))
    bits = ids.select(F.pmod(h, F.lit(pages)).alias("page"), F.explode(_bits(h)).alias("bit"))
    return bits.groupBy("page").agg(F.bitmap_construct_agg("bit").alias("bits"))


def _bits(h: F.Column) -> F.Column:
    other = F.xxhash64(h)
    return F.array(*[F.shiftrightunsigned(other, 15 * i).bitwiseAND(F.lit(PAGE - 1)) for i in range(3)])


def maybe_among(rows: DataFrame, key: str, pages: DataFrame, count: int) -> DataFrame:
    """Rows whose key may be among the filter's ids: all that are, and few others.  The pages are broadcast."""
    h = F.xxhash64(F.col(key).cast("string"))
    byte = lambda b: F.conv(F.hex(F.substring(F.col("__bits"), (F.shiftright(b, 3) + 1).cast("int"), F.lit(1))), 16, 10).cast("long")
    found = rows.withColumn("__page", F.pmod(h, F.lit(count))).join(F.broadcast(pages.select(F.col("page").alias("__page"), F.col("bits").alias("__bits"))), "__page")
    # The shift of 1 by b mod 8 as a power, so that it needs no column of shifts.
    return found.where(F.forall(_bits(h), lambda b: byte(b).bitwiseAND(F.pow(F.lit(2), b.bitwiseAND(F.lit(7))).cast("long")) != 0)).drop("__page", "__bits")


def _bytes(size: str) -> int:
    """A size as settings give it, such as 10485760b, 10MB or -1."""
    number, unit = re.fullmatch(r"(-?\d+)\s*([kmgt]?)b?", size.strip().lower()).groups()
    return int(number) << 10 * " kmgt".index(unit or " ")


def judged_only(rows: DataFrame, key: str, ids: DataFrame, id_column: str, pages: int | None = None) -> DataFrame:
    """Rows whose key is among the ids.  No ids give no rows.

    A Bloom filter of at most 4,096 pages (16 MB) goes before the join where the ids are too many for Spark to
    broadcast them, so of the rows, whose texts are long, only hits and a few others are shuffled.  The
    ids are counted for that, unless ``pages`` says how many (0 for none).
    """
    wanted = ids.select(F.col(id_column).alias("_id")).where(F.col("_id").isNotNull()).distinct()
    if pages is None:
        count = wanted.agg(F.approx_count_distinct("_id")).first()[0]
        pages = 0 if 64 * count <= _bytes(rows.sparkSession.conf.get("spark.sql.autoBroadcastJoinThreshold")) else min(4096, 1 << (10 * count // PAGE).bit_length())
    if pages:
        rows = maybe_among(rows, key, bloom_pages(wanted, "_id", pages), pages)
    return rows.join(wanted, F.col(key) == F.col("_id"), "left_semi")


def judged_ids(judgments: list[DataFrame], column: str = "doc_id") -> DataFrame:
    """The ids that any of several sets of judgments names, once each; null is none."""
    return reduce(DataFrame.unionAll, [j.select(column) for j in judgments]).where(F.col(column).isNotNull()).distinct()


def judgment_counts(judgments: DataFrame, grade: str, least: float, column: str = "doc_id") -> DataFrame:
    """n_rows, n_positive (judged ``least`` or better) and n_ids."""
    return judgments.agg(F.count(F.lit(1)).alias("n_rows"), F.count_if(F.col(grade) >= least).alias("n_positive"), F.countDistinct(column).alias("n_ids"))


def first_match(queries: DataFrame, rows: DataFrame, on: str, value: str, order: list[str]) -> DataFrame:
    """Each query row with the first non-empty ``value`` among the rows with an equal, non-empty ``on``; queries
    without one are dropped.

    Texts meet by their SHA-256, so ``rows`` move without their texts, each distinct text once a task, and the
    queries' texts move once; Spark splits a hash that many queries share.
    """
    from tessera.operators.folds import first_by

    digest = F.when(F.length(F.col(on)) > 0, F.unhex(F.sha2(F.col(on).cast("binary"), 256)))
    keyed = queries.withColumn("__on", digest).where(F.col("__on").isNotNull())
    wanted = rows.select(digest.alias("__on"), value, *order).join(keyed.select("__on").distinct(), "__on", "left_semi")
    return keyed.join(first_by(wanted, ["__on"], value, order), "__on").drop("__on")
