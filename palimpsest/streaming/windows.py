"""Streams: hourly spending, retention, and arrival of files, by Structured Streaming."""

from __future__ import annotations

import hashlib
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from palimpsest.plans.runtime import shared_dir


def hourly_spend(events: DataFrame, delay: str = "1 hour") -> DataFrame:
    """Cents per key and hour of a stream of events; a window closes when its watermark has passed."""
    cents = F.round(F.col("value") * 100).cast("long")
    return events.withWatermark("ts", delay).groupBy(F.window("ts", "1 hour"), "user_id").agg(F.sum(cents).alias("cents")).select(F.col("user_id").alias("key_id"), F.date_format(F.col("window.start"), "yyyyMMddHH").alias("bucket"), "cents")


def requests_per_minute(events: DataFrame, limit: int, delay: str = "1 minute") -> DataFrame:
    """Minutes in which a key made more requests than allowed."""
    counted = events.withWatermark("ts", delay).groupBy(F.window("ts", "1 minute"), "user_id").agg(F.count("*").alias("requests"))
    return counted.filter(F.col("requests") > limit).select("user_id", F.col("window.start").alias("minute"), "requests")


def latest_per_job(results: DataFrame, ttl: str = "30 days") -> DataFrame:
    """Deliveries of a job without its repeats; what is remembered of a job is dropped after ``ttl`` of event time."""
    return results.withWatermark("received_at", ttl).dropDuplicatesWithinWatermark(["job_id"])


def arriving_files(spark: SparkSession, folder: str) -> DataFrame:
    """New documents of a folder as they arrive, without their content."""
    files = spark.readStream.format("binaryFile").schema("path string, modificationTime timestamp, length long, content binary").load(folder)
    return files.select("path", "modificationTime", "length")


def once(stream: DataFrame, path: str, mode: str = "append") -> StreamingQuery:
    """Run a stream over everything there is and stop, writing to ``path``; its checkpoint lies in the shared folder."""
    spark = stream.sparkSession
    mark = hashlib.sha256(path.encode()).hexdigest()[:24]  # the same for every run that goes on with this output
    return stream.writeStream.outputMode(mode).format("parquet").option("path", path).option("checkpointLocation", f"{shared_dir(spark)}/streams/{mark}").trigger(availableNow=True).start()


def run_append(stream: DataFrame, name: str) -> DataFrame:
    """What a stream gives over everything there is, appended to files in the shared folder and read back."""
    path = f"{shared_dir(stream.sparkSession)}/streams/{name}_{uuid.uuid4().hex}"  # a run of its own, not one that goes on
    once(stream, path).awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(path)


def run_complete(stream: DataFrame, name: str) -> DataFrame:
    """The state of an aggregating stream after everything there is. Each batch writes the whole state to files of its own in the shared folder, from the tasks that hold it; the last one is read back."""
    spark = stream.sparkSession
    path = f"{shared_dir(spark)}/streams/{name}_{uuid.uuid4().hex}"
    last: list[int] = []

    def write(batch: DataFrame, n: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/state/{n}")
        last.append(n)

    stream.writeStream.outputMode("complete").foreachBatch(write).option("checkpointLocation", f"{path}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{path}/state/{last[-1]}") if last else spark.createDataFrame([], stream.schema)
