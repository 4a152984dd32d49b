"""Restartable ingest: each run takes what is new, and a repeated run adds nothing."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession


def ingest(
    spark: SparkSession, source: str, schema, target: str, checkpoint: str, key: str, transform: Callable[[DataFrame], DataFrame]
) -> None:
    """Transform the Parquet files that came to ``source`` since the last run and append them to ``target``,
    leaving out keys that are there. The stream's checkpoint remembers the files; a batch that is run again
    after a failure finds its own keys and drops them."""

    def append(batch: DataFrame, _: int) -> None:
        new = transform(batch).dropDuplicates([key])
        session = batch.sparkSession
        try:
            done = session.read.parquet(target).select(key)
        except Exception as e:  # the first batch: nothing is there yet
            if "PATH_NOT_FOUND" not in str(e) and "UNABLE_TO_INFER_SCHEMA" not in str(e):
                raise
            done = None
        if done is not None:
            new = new.join(done, key, "left_anti")
        new.write.mode("append").parquet(target)

    stream = spark.readStream.schema(schema).parquet(source)
    query = stream.writeStream.foreachBatch(append).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
