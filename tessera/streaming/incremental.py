"""An extension beyond the workload: last-write-wins state kept by a stream."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter

from tessera.sources.files import exists, remove


def last_write_wins(stream: DataFrame, keys: list[str], value: str, order: list[str], state: str, checkpoint: str) -> DataStreamWriter:
    """Each micro-batch is merged into versions of a Parquet table below ``state``.

    A replayed batch writes its version again from the one before, so results are exact.  Only the
    last batch can be replayed, so the two newest versions stay and the one before them is removed.
    """

    def merge(batch: DataFrame, version: int) -> None:
        spark = batch.sparkSession
        rows = batch.select(*keys, value, *order)
        before = f"{state}/version={version - 1}"
        if version and exists(spark, before):
            rows = rows.unionByName(spark.read.parquet(before))
        latest = rows.groupBy(*keys).agg(F.max_by(F.struct(value, *order), F.struct(*order)).alias("row")).select(*keys, "row.*")
        latest.write.mode("overwrite").parquet(f"{state}/version={version}")
        remove(spark, f"{state}/version={version - 2}")

    return stream.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint)

