"""New pages as a stream: each micro-batch is harvested and appended."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from claimloom.operators.harvest import harvest

SCHEMA = "doc_id string, page int, markdown string"


def harvest_stream(spark: SparkSession, source: str, target: str, checkpoint: str, **settings) -> StreamingQuery:
    """Parquet files of whole documents ``(doc_id, page, markdown)`` arriving in ``source`` to sentences in ``target``.

    A file holds whole documents, so a batch needs no state; a batch that is
    run again after a failure replaces what it had written.
    """

    def batch(pages: DataFrame, number: int) -> None:
        harvest(pages, **settings).write.mode("overwrite").parquet(f"{target}/batch={number}")

    return spark.readStream.schema(SCHEMA).parquet(source).writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
