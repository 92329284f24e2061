"""Incremental loads: new rows of a folder pass through a transform in micro-batches, each written once."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery


def load_new(spark: SparkSession, source: str, schema: str, transform: Callable[[DataFrame], DataFrame], target: str, checkpoint: str, *, keys: list[str] | None = None, files_per_batch: int = 64) -> StreamingQuery:
    """Every Parquet file that appears in `source` goes through `transform` into `target`, until none is left.

    A batch is a folder of its number that is overwritten if the batch is repeated, so a restart writes nothing twice. With keys, rows that
    earlier batches hold by these keys are left out.
    """
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(source)

    def write(batch: DataFrame, number: int) -> None:
        out = transform(batch)
        if keys:
            out = out.dropDuplicates(keys)
            if number:
                old = spark.read.parquet(*[f"{target}/batch={k}" for k in range(number)]).select(*keys)
                out = out.join(old, keys, "left_anti")
        out.write.mode("overwrite").parquet(f"{target}/batch={number}")

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
