"""The corpus pipeline: documents of good quality, without copies, near copies and repeats, packed.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; ``run`` writes each result as
Parquet in the shared folder and gives it, read back, to the next stage.  All stages but the last
return the columns of ``documents``.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tessera.llm import exact_dedup, packing, quality, repeats, simhash
from tessera.llm.common import materialize, read
from tessera.session import ensure_importable


def good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 3: documents whose calibrated quality reaches 0.7 stay."""
    return quality.keep_good(docs, read(spark, sf_dir, "labels"), threshold=0.7)


def without_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 7: of equal texts the document with the largest doc_id stays."""
    return exact_dedup.deduplicate(docs)


def without_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 9: of each group of near copies the document with the smallest doc_id stays."""
    return simhash.near_dedup(docs, words=5, least=0.8)


def without_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 10: strings of 50 bytes that also start in a smaller doc_id are cut out."""
    return repeats.strip_repeats(docs, least=50)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 8: sequences of at most 1024 ids."""
    import public_tokenizers

    return packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json"), longest=1024).drop("ids")


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality", good),
    ("exact dedup", without_copies),
    ("near dedup", without_near_copies),
    ("repeats", without_repeats),
    ("packing", packed),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(ensure_importable(spark), sf_dir, "documents")
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), "pipeline-" + name.replace(" ", "-"))
    return docs


#: No stage but the second can be expressed in SQL; tests hold each against a brute-force version.
ORACLE_SQL = None
