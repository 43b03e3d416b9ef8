"""Keyed folds, samples, splits and batches with explicit order, so results don't depend on partitions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.session import materialize


def first_by(rows: DataFrame, keys: list[str], value: str, order: list[str], alias: str | None = None) -> DataFrame:
    """The first non-empty ``value`` of each non-empty key; partial aggregation before the shuffle."""
    present = rows.where(F.length(F.coalesce(F.col(value).cast("string"), F.lit(""))) > 0)
    for key in keys:
        present = present.where(F.length(F.coalesce(F.col(key).cast("string"), F.lit(""))) > 0)
    return present.groupBy(*keys).agg(F.min_by(value, F.struct(*order)).alias(alias or value))


def last_by(rows: DataFrame, keys: list[str], value: str, order: list[str], alias: str | None = None) -> DataFrame:
    """The last ``value`` of each key: later writes win."""
    return rows.groupBy(*keys).agg(F.max_by(value, F.struct(*order)).alias(alias or value))


def seeded(key: Column | str, seed: int) -> Column:
    """A pseudo-random order: md5 of ``seed:key``."""
    col = F.col(key) if isinstance(key, str) else key
    return F.md5(F.concat(F.lit(f"{seed}:"), col.cast("string")))


FEW = 1 << 16  # rows that are put in order in one place, if a count has shown that there are no more


def hash_sample(rows: DataFrame, key: str, k: int, seed: int = 42) -> DataFrame:
    """A uniform sample of ``k`` rows without replacement (all rows if fewer): the first in the order of a hash.

    Rows are counted by the hash's first four digits, 65,536 counts at most.  All rows below the border, the
    digits among which the k-th lies, are in; if more than ``FEW`` rows have these, they are counted by four more,
    and so on.  Only those at the border are put in order, so no task or driver sees ``k`` rows.
    """
    if k < 1:
        return rows.limit(0)
    whole = F.coalesce(seeded(key, seed), F.lit(""))
    below, wanted, near = [], k, rows
    for width in range(4, 33, 4):
        digits = F.substring(whole, 1, width)
        counts = sorted((r[0], r[1]) for r in near.groupBy(digits).count().collect())
        if sum(n for _, n in counts) <= wanted:
            return reduce(DataFrame.unionByName, below, near)
        for border, at_border in counts:
            if at_border >= wanted:
                break
            wanted -= at_border
        below.append(near.where(digits < border))
        near = near.where(digits == border)
        if at_border <= FEW:
            chosen = near.orderBy(seeded(key, seed), key).limit(wanted)
            break
    else:  # rows of equal hashes
        chosen = numbered(near, [seeded(key, seed), F.col(key)], "__n").where(F.col("__n") < wanted).drop("__n")
    return reduce(DataFrame.unionByName, below, chosen)


def shuffled(rows: DataFrame, key: str, seed: int = 42) -> DataFrame:
    """Rows in a seeded order."""
    return rows.orderBy(seeded(key, seed), key)


def numbered(rows: DataFrame, order: list[Column], name: str) -> DataFrame:
    """A gapless number from 0 in a global order, without bringing the rows into one partition.

    Rows are range-partitioned, sorted, numbered within partitions and written once; the counts of
    the partitions, one row each, give the offsets, so both come from the same partitioning.
    """
    local = rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("__part", F.spark_partition_id())
    local = local.withColumn("__place", F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1)))
    local = materialize(local, "numbered")
    spans = local.groupBy("__part").agg((F.max("__place") + 1).alias("__size"))
    before = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = spans.select("__part", F.coalesce(F.sum("__size").over(before), F.lit(0)).alias("__offset"))
    return local.join(F.broadcast(offsets), "__part").withColumn(name, F.col("__offset") + F.col("__place")).drop("__part", "__place", "__offset")


def exact_split(rows: DataFrame, key: str, share: int = 10, seed: int = 42) -> DataFrame:
    """``split``: 'val' for exactly max(1, n // share) rows in seeded order, else 'train'.

    The seeded order is a hash, so rows are counted by its first four digits (65,536 counts at most);
    only the rows with the digits among which the border lies are put in order.
    """
    digits = F.substring(seeded(key, seed), 1, 4)
    counts = sorted((r[0] or "", r[1]) for r in rows.groupBy(digits).count().collect())
    total = sum(n for _, n in counts)
    wanted, border, before = (max(1, total // share) if total else 0), "", 0
    for prefix, n in counts:
        border = prefix
        if before + n >= wanted:
            break
        before += n
    at = F.coalesce(digits, F.lit(""))
    near = numbered(rows.where(at == border), [seeded(key, seed), F.col(key)], "__n").withColumn("split", F.when(F.col("__n") < wanted - before, "val").otherwise("train")).drop("__n")
    return rows.where(at != border).withColumn("split", F.when(at < border, "val").otherwise("train")).unionByName(near)


def batches(rows: DataFrame, key: str, size: int, seed: int | None = 42, drop_last: bool = True) -> DataFrame:
    """``batch_id`` and ``position`` of each row in seeded (or key) order; an incomplete last batch goes."""
    order = [F.col(key)] if seed is None else [seeded(key, seed), F.col(key)]
    found = numbered(rows, order, "_n")
    if drop_last:
        found = found.where(F.col("_n") < (rows.count() // size) * size)
    return found.withColumn("batch_id", F.floor(F.col("_n") / size).cast("long")).withColumn("position", (F.col("_n") % size).cast("int")).drop("_n")
