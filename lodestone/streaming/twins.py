"""Streaming twins of the batch operators; the same expressions serve both."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodestone.operators.storage import shared_dir


def windowed(events: DataFrame, width: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """Counts by tumbling window and type; on a stream, with a watermark."""
    source = events.withColumn("ts", F.col("ts").cast("timestamp"))
    source = source.withWatermark("ts", late) if events.isStreaming else source
    return source.groupBy(F.window("ts", width).alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n")).select(F.col("w.start").cast("timestamp_ntz").alias("start"), "event_type", "n")


def drained(stream: DataFrame, transform, mode: str = "complete", where: str | None = None) -> DataFrame:
    """Run a stream over all that is there (availableNow) and return its result.

    Every micro-batch is written to the shared folder, under its number so that
    a batch which runs again replaces itself; the checkpoint beside it says
    where to go on.  In complete mode the last batch is the result.
    """
    spark = stream.sparkSession
    path = where or f"{shared_dir(spark)}/drain-{uuid.uuid4().hex}"
    shaped = transform(stream)

    def put(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/out/batch={number}")

    run = shaped.writeStream.foreachBatch(put).outputMode(mode).option("checkpointLocation", f"{path}/checkpoint").trigger(availableNow=True).start()
    run.awaitTermination()
    out = spark.read.schema(T.StructType([*shaped.schema.fields, T.StructField("batch", T.IntegerType())])).parquet(f"{path}/out")
    if mode != "complete":
        return out.drop("batch")
    last = out.agg(F.max("batch").alias("batch"))
    return out.join(F.broadcast(last), "batch", "left_semi").drop("batch")


def drained_file(df: DataFrame, transform, mode: str = "complete") -> DataFrame:
    """A stored table read as a stream and drained."""
    files = df.inputFiles()
    spark = df.sparkSession
    root = files[0].rsplit("/", 1)[0]
    names = "{" + ",".join(f.rsplit("/", 1)[1] for f in files) + "}" if len(files) > 1 else files[0].rsplit("/", 1)[1]
    return drained(spark.readStream.schema(df.schema).option("pathGlobFilter", names).parquet(root), transform, mode)


def change_feed(spark: SparkSession, path: str, schema) -> DataFrame:
    """Rows appended to a folder, as a stream."""
    return spark.readStream.schema(schema).parquet(path)


def hourly_counts(events: DataFrame) -> DataFrame:
    """The batch form of the tumbling counts."""
    return windowed(events)


def merge_into(latest: DataFrame, changes: DataFrame, key: list[str], clock: list[str]) -> DataFrame:
    """For foreachBatch: the newest row of each key after a batch of changes."""
    from lodestone.operators.datasets import last_writer

    return last_writer(latest.unionByName(changes), key, clock)
