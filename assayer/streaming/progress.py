"""Completion counts over a growing folder of results."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def completion(results: DataFrame, totals: DataFrame, job: str = "job") -> DataFrame:
    """Finished records per job against its total, capped at the total; for batch and streaming frames."""
    done = results.groupBy(job).agg(F.count(F.lit(1)).alias("n_done"))
    return done.join(totals.select(job, "n_total"), job).select(
        job,
        F.least("n_done", "n_total").alias("n_done"),
        "n_total",
        (F.least("n_done", "n_total") * 100.0 / F.col("n_total")).alias("percent"),
    )


def follow(
    spark: SparkSession, folder: str, schema, totals: DataFrame, checkpoint: str, name: str, job: str = "job",
    files_per_trigger: int = 100,
) -> StreamingQuery:
    """Count the records in a results folder as files arrive; the counts are the table ``name``.

    State is one row per job.  The trigger takes what is there and stops; run it on a
    schedule, or swap the trigger for a continuous one.
    """
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(folder)
    return (
        completion(stream, totals, job)
        .writeStream.outputMode("complete")
        .format("memory")
        .queryName(name)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
