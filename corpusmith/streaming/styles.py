"""Style counts over a stream of programs, and counts by window over a stream of events."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusmith.functions.code import udfs


def style_windows(stream: DataFrame, ts: str = "ts", code: str = "code", lang: str = "lang", window: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """window_start, style, programs that have it and its places, of a stream (or a table) of programs."""
    rows = stream.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, late).select(F.window(ts, window).alias("w"), udfs.style_counts(F.col(code), F.col(lang)).alias("c"))
    each = rows.select("w", F.explode("c").alias("style", "n")).where("n > 0")
    return each.groupBy("w", "style").agg(F.count("*").alias("programs"), F.sum("n").alias("places")).select(F.col("w.start").alias("window_start"), "style", "programs", "places")


def event_windows(stream: DataFrame, window: str = "1 hour", late: str = "2 hours") -> DataFrame:
    return stream.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late).groupBy(F.window("ts", window).alias("w"), "event_type").agg(F.count("*").alias("n")).select(F.col("w.start").alias("window_start"), "event_type", "n")


def drained(df: DataFrame, folder: str) -> DataFrame:
    """Run a streaming aggregate over what its source holds now, and return its last state. State and output lie in `folder`, which
    driver and executors must share."""
    spark = df.sparkSession
    out, state = f"{folder}/stream-{uuid.uuid4().hex}", f"{folder}/state-{uuid.uuid4().hex}"
    query = df.writeStream.outputMode("complete").trigger(availableNow=True).option("checkpointLocation", state).foreachBatch(lambda batch, _: batch.write.mode("overwrite").parquet(out)).start()
    query.awaitTermination()
    return spark.read.schema(df.schema).parquet(out)


def stream_of(spark: SparkSession, path: str) -> DataFrame:
    """A file stream of a Parquet table (a folder or one file), with the schema that the table has now."""
    # as a pattern, since a stream takes a plain path for a folder
    return spark.readStream.schema(spark.read.parquet(path).schema).parquet(f"{path[:-1]}[{path[-1]}]")
