"""The event log as a stream: job states as they change, and counts by window.

Windows with a watermark are an extension; the job states are those of the batch query.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from claimstone.operators.jobs import SQL as JOB_SQL
from claimstone.operators.jobs import public_states, latest
from claimstone.session import shared_dir
from claimstone.sources.tables import table


def event_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events table as a stream, be it a file or a folder of files; a stream takes a single file by a pattern only."""
    schema = table(spark, sf_dir, "events").schema
    return spark.readStream.schema(schema).parquet(f"{sf_dir.rstrip('/')}/events.parque[t]")


def follow_jobs(events: DataFrame, root: str) -> None:
    """Keep the last event of each job in ``root/state-N``, N the number of micro-batches; runs until what is there is read.

    A batch's own last rows are one partial aggregate; they join the state, which has a row
    for each job, and the new state is written beside the old one.  A batch that runs again
    after a failure reads the same old state, so its result is the same.
    """
    spark = events.sparkSession
    columns = ["user_id", "ts", "event_id", "event_type"]

    def merge(batch: DataFrame, number: int) -> None:
        rows = batch.select(*columns)
        if number:
            rows = rows.unionByName(spark.read.parquet(f"{root}/state-{number - 1}").select(*columns))
        latest(rows, "user_id", ["ts", "event_id"]).write.mode("overwrite").parquet(f"{root}/state-{number}")

    events.writeStream.foreachBatch(merge).option("checkpointLocation", f"{root}/checkpoint").trigger(availableNow=True).start().awaitTermination()


def window_counts(events: DataFrame, *, late: str = "1 hour", size: str = "6 hours") -> DataFrame:
    """Events and their value by type and window; events later than ``late`` behind the newest don't count."""
    # The table's times have no zone; a stream's event time needs one.
    timed = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)
    return timed.groupBy(F.window("ts", size).alias("w"), "event_type").agg(F.count("*").alias("events"), F.round(F.sum("value"), 2).alias("value"))


# --- Queries --------------------------------------------------------------------------


def streamed_job_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The states that the stream leaves, as published."""
    root = shared_dir(spark, "stream")
    follow_jobs(event_stream(spark, sf_dir).repartition("user_id"), root)
    last = max((int(r.n) for r in spark.read.parquet(f"{root}/state-*").select(F.regexp_extract(F.input_file_name(), r"state-(\d+)/", 1).alias("n")).distinct().collect()), default=0)
    return public_states(spark.read.parquet(f"{root}/state-{last}"))


def streamed_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The windows that the stream leaves, the open ones included."""
    root = shared_dir(spark, "stream")

    def keep(batch: DataFrame, number: int) -> None:
        batch.withColumn("batch", F.lit(number)).write.mode("overwrite").parquet(f"{root}/out/batch={number}")

    counts = window_counts(event_stream(spark, sf_dir))
    counts.writeStream.outputMode("update").foreachBatch(keep).option("checkpointLocation", f"{root}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    rows = spark.read.option("recursiveFileLookup", "true").parquet(f"{root}/out")
    last = rows.groupBy("w", "event_type").agg(F.max_by(F.struct("events", "value"), "batch").alias("l"))
    return last.select(F.date_format("w.start", "yyyy-MM-dd HH:mm").alias("start"), "event_type", "l.events", "l.value")


SQL = {
    "streamed_job_status": JOB_SQL["job_status"],
    "streamed_windows": "SELECT strftime(time_bucket(INTERVAL 6 HOUR, ts, TIMESTAMP '1970-01-01'), '%Y-%m-%d %H:%M') AS start, event_type, count(*) AS events, round(sum(value), 2) AS value FROM events GROUP BY ALL",
}
QUERIES = {"streamed_job_status": streamed_job_status, "streamed_windows": streamed_windows}
