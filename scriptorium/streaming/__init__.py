"""Translation that goes on where it stopped: a stream over a landing folder, with a checkpoint for what is done."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

SEGMENTS = "doc_id long, id string, text string"


def land(spark: SparkSession, source: str, sink: str, checkpoint: str, step: Callable[[DataFrame], DataFrame], schema: str = SEGMENTS) -> None:
    """Run step over all JSON files of source that earlier calls have not seen, and add its rows to the Parquet table at sink."""
    arrived = spark.readStream.schema(schema).json(source)

    def write(rows: DataFrame, batch: int) -> None:
        step(rows).write.mode("overwrite").parquet(f"{sink}/batch={batch}")  # the same batch again replaces its own rows

    arrived.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
