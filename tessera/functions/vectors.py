"""Functions on array columns of numbers; sums are in double."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def dot(a: Column | str, b: Column | str) -> Column:
    products = F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(products, F.lit(0.0), lambda s, x: s + x)


def norm(v: Column | str) -> Column:
    return F.sqrt(dot(v, v))


def l2_normalize(v: Column | str, eps: float = 1e-12) -> Column:
    """A zero vector stays zero."""
    length = F.greatest(norm(v), F.lit(eps))
    return F.transform(v, lambda x: x.cast("double") / length)


def mean_pool(rows: DataFrame, keys: list[str], vector: str, mask: str | None = None) -> DataFrame:
    """Mean of the vectors of each key over the rows whose ``mask`` isn't 0: keys, pooled."""
    weight = F.lit(1.0) if mask is None else F.col(mask).cast("double")
    parts = rows.select(*keys, weight.alias("_w"), F.posexplode(vector).alias("_dim", "_x"))
    dims = parts.groupBy(*keys, "_dim").agg(
        (F.sum(F.col("_x").cast("double") * F.col("_w")) / F.greatest(F.sum("_w"), F.lit(1e-9))).alias("_m"),
    )
    return _gather(dims, keys, {"pooled": "_m"})


def mean_max_pool(rows: DataFrame, keys: list[str], vector: str) -> DataFrame:
    """Mean and maximum over each key, concatenated: keys, pooled."""
    parts = rows.select(*keys, F.posexplode(vector).alias("_dim", "_x"))
    dims = parts.groupBy(*keys, "_dim").agg(F.avg(F.col("_x").cast("double")).alias("_m"), F.max(F.col("_x").cast("double")).alias("_h"))
    both = _gather(dims, keys, {"_mean": "_m", "_max": "_h"})
    return both.select(*keys, F.concat("_mean", "_max").alias("pooled"))


def _gather(dims: DataFrame, keys: list[str], columns: dict[str, str]) -> DataFrame:
    """One array per key in order of ``_dim``; its length is the vectors' dimension."""
    sorted_ = F.array_sort(F.collect_list(F.struct("_dim", *columns.values())))
    return dims.groupBy(*keys).agg(sorted_.alias("_all")).select(*keys, *[F.col(f"_all.{f}").alias(n) for n, f in columns.items()])
