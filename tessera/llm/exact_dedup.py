"""Exact deduplication by an extendible-hash index on shared files, in DataFrame operations only.

A text's key is its 64-bit hash.  The directory starts with one bucket; a bucket with more than
``capacity`` distinct keys is split by one more leading bit of the key, and the directory doubles
whenever the split bucket was as deep as the directory itself.  The capacity grows with the corpus,
so a directory has about 2**14 buckets at most; a histogram over 2**``max_depth`` key prefixes is
all that reaches the driver.  A bucket whose keys agree in all those bits isn't split further: it
overflows, and holds its keys in one chain after another.

Each owner task holds whole buckets, which are ranges of keys.  It groups its rows by key and text,
so equal keys are told apart by their bytes, and numbers the different texts of one key as a chain.
The index is written to the shared folder.  A row finds its entry through the directory: by bucket,
key and, within the chain, the text's SHA-256.

A key that holds a thousandth of all rows or more (a thousand such keys at most) is combined
before it moves, so a text that fills a third of the table costs one row a task.

Defined results: a null text counts as empty; of equal texts the row with the largest doc_id
stays, a null doc_id being the least; of rows equal in doc_id and text one stays; other columns
never matter, whatever their names, and are kept by ``deduplicate`` (of tied rows, the largest by
its other columns); an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.common import in_order, lookup, materialize, text_or_empty


def extendible_directory(histogram: dict[int, int], capacity: int, max_depth: int) -> tuple[int, list[int]]:
    """Global depth and the bucket of each of its 2**depth addresses.

    ``histogram`` counts distinct keys by their leading ``max_depth`` bits.
    """
    sums = [0]
    for prefix in range(1 << max_depth):
        sums.append(sums[-1] + histogram.get(prefix, 0))

    def held(bucket: tuple[int, int]) -> int:
        first, depth = bucket
        width = 1 << (max_depth - depth)
        return sums[(first + 1) * width] - sums[first * width]

    depth, directory = 0, [(0, 0)]  # a bucket is (its leading bits, their number)
    full = [b for b in directory if held(b) > capacity]
    while full:
        first, local = full.pop()
        if local == max_depth:
            continue
        if local == depth:
            directory = [b for b in directory for _ in range(2)]
            depth += 1
        span = 1 << (depth - local - 1)
        at = first << (depth - local)
        for half in (0, 1):
            bucket = (2 * first + half, local + 1)
            directory[at + half * span : at + (half + 1) * span] = [bucket] * span
            if held(bucket) > capacity:
                full.append(bucket)
    numbers = {b: i for i, b in enumerate(dict.fromkeys(directory))}
    return depth, [numbers[b] for b in directory]


def address(key: Column, depth: int) -> Column:
    return F.shiftrightunsigned(key, 64 - depth).cast("int") if depth else F.lit(0)


def bucket_of(key: Column, depth: int, directory: list[int]) -> Column:
    table = F.split(F.lit(",".join(map(str, directory))), ",").cast("array<int>")  # folded to a literal
    return F.element_at(table, address(key, depth) + 1)


#: About so many buckets at most; a row's bucket is looked up in a literal of a few times that length.
BUCKETS = 1 << 14


class Directory:
    """The directory for the texts of ``rows`` (text, carry), and which keys are hot."""

    def __init__(self, rows: DataFrame, capacity: int, max_depth: int, key: Column | None) -> None:
        self.key = F.xxhash64("text") if key is None else key
        counts = materialize(rows.groupBy(self.key.alias("key")).agg(F.count(F.lit(1)).alias("n")), "exact-keys")
        self.total, distinct = counts.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count(F.lit(1))).first()
        histogram = {r[0]: r[1] for r in counts.groupBy(address(F.col("key"), max_depth).alias("p")).count().collect()}  # 2**max_depth rows at most
        self.depth, self.directory = extendible_directory(histogram, max(capacity, distinct // BUCKETS), max_depth)
        least = max(self.total // 1000, 2)
        self.hot = [r[0] for r in counts.where(F.col("n") >= least).select("key").collect()]  # 1000 keys at most

    def placed(self, rows: DataFrame) -> DataFrame:
        """``rows`` with bucket and key."""
        keyed = rows.withColumn("key", self.key)
        return keyed.withColumn("bucket", bucket_of(F.col("key"), self.depth, self.directory))


def build_index(rows: DataFrame, directory: Directory, top: Column | None = None) -> DataFrame:
    """One row per distinct text of ``rows`` (text, carry): bucket, key, text, top (the largest
    ``carry``, or another aggregate) and group_size."""
    top = F.max("carry") if top is None else top
    placed = directory.placed(rows)
    is_hot = F.col("key").isin(directory.hot) if directory.hot else F.lit(False)

    def chained(part: DataFrame) -> DataFrame:
        return part.groupBy("bucket", "key", "text").agg(top.alias("top"), F.count(F.lit(1)).alias("group_size"))

    owners = placed.where(~is_hot).repartition(F.col("bucket"))
    return chained(owners).unionByName(chained(placed.where(is_hot)))


def exact_groups(docs: DataFrame, capacity: int = 4096, max_depth: int = 16, key: Column | None = None) -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256, bucket, slot: a row for each row of ``docs``.

    ``key`` may replace the hash of the column ``text``.
    """
    rows = docs.select(text_or_empty().alias("text"), F.col("doc_id").cast("long").alias("carry"))
    directory = Directory(rows, capacity, max_depth, key)
    found = build_index(rows, directory)
    entries = found.select("bucket", "key", F.sha2("text", 256).alias("text_sha256"), F.col("top").alias("keep_id"), "group_size")
    chain = Window.partitionBy("bucket", "key").orderBy(F.col("keep_id").desc(), "text_sha256")
    index = materialize(entries.withColumn("slot", F.row_number().over(chain)), "exact-index")

    members = directory.placed(rows).select(F.col("carry").alias("doc_id"), "bucket", "key", F.sha2("text", 256).alias("text_sha256"))
    members = lookup(members, index, ["bucket", "key", "text_sha256"], "group_size", directory.total)
    members = materialize(members.withColumn("part", F.spark_partition_id()), "exact-members")
    # Of rows equal in doc_id and text one stays: the first of each part, then the first of those, so no task gets them all.
    stays = members.where(F.col("doc_id").eqNullSafe(F.col("keep_id")))
    same = ["bucket", "key", "text_sha256", "doc_id"]
    turn = F.row_number().over(Window.partitionBy(*same, "part").orderBy(F.lit(0)))
    numbered = materialize(stays.withColumn("turn", turn), "exact-stays")
    firsts = numbered.where("turn = 1").withColumn("kept", F.row_number().over(Window.partitionBy(*same).orderBy("part")) == 1).drop("turn")
    rest = numbered.where("turn > 1").drop("turn").unionByName(members.where(~F.col("doc_id").eqNullSafe(F.col("keep_id"))))
    whole = firsts.unionByName(rest.withColumn("kept", F.lit(False)))
    return whole.select("doc_id", "keep_id", "group_size", "kept", "text_sha256", "bucket", "slot")


def deduplicate(docs: DataFrame, capacity: int = 4096, max_depth: int = 16) -> DataFrame:
    """The rows that stay, with the columns of ``docs``; the texts are those of the index itself."""
    rest = [c for c in docs.columns if c not in ("doc_id", "text")]
    others = F.struct(*[F.col(f"`{c}`") for c in rest] or [F.lit(0)])
    given = F.col("text").isNotNull().alias("given")
    order = in_order(docs, rest)  # of rows equal in doc_id and text the largest by its other columns stays
    rank = [] if order is None else [F.struct("doc_id", given, order).alias("rank")]
    rows = docs.select(text_or_empty().alias("text"), F.struct("doc_id", given, others.alias("others")).alias("carry"), *rank)
    top = F.max_by("carry", "rank") if rank else None
    index = materialize(build_index(rows, Directory(rows, capacity, max_depth, None), top), "exact-index")
    text = F.when(F.col("top.given"), F.col("text")).alias("text")
    return index.select(*[text if c == "text" else F.col("top.doc_id") if c == "doc_id" else F.col(f"top.others.`{c}`").alias(c) for c in docs.columns])
