"""Job status kept up to date from a stream of status events."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.reporting import latest_status

EVENTS = "job_id long, ts timestamp, status string, result string, error string"


def follow_status(spark: SparkSession, source: str, target: str, checkpoint: str, files_at_once: int = 1000) -> None:
    """Take in all event files of ``source`` that have not been seen yet; ``target`` gets the jobs that changed, batch by batch.

    The state is a row for each job, keyed and kept in the checkpoint, so events may come in any
    order and however late, and a run goes on where the last one ended. A batch that is tried again
    replaces its own rows.
    """
    events = spark.readStream.schema(EVENTS).option("maxFilesPerTrigger", files_at_once).parquet(source)

    def write(changed: DataFrame, batch: int) -> None:
        changed.write.mode("overwrite").parquet(f"{target}/batch={batch}")

    stream = latest_status(events).writeStream.outputMode("update").option("checkpointLocation", checkpoint)
    stream.foreachBatch(write).trigger(availableNow=True).start().awaitTermination()


def read_status(spark: SparkSession, target: str) -> DataFrame:
    """The newest row of every job that :func:`follow_status` has written, as :func:`latest_status` gives it."""
    rows = spark.read.parquet(target)
    columns = [c for c in rows.columns if c != "batch"]
    return rows.groupBy("job_id").agg(F.max_by(F.struct(*columns), "batch").alias("row")).select("row.*")
