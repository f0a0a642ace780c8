"""The style-label audit over a stream: counts by window and style, kept as state until the watermark has passed, and sent on whenever they change.

The sink keeps a folder for each batch, written anew when a batch is repeated, so a restart in mid-stream neither loses nor counts twice; the current answer is
the last row of each key. `compacted` folds batches into one, so the folder doesn't grow with the stream.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from corpusmith.operators import metrics

KEYS = ("window_start", "style")
CELLS = ("n11", "n10", "n01", "n00")


def label_windows(rows: DataFrame, style: str, present: Column, label: Column, ts: str = "ts", window: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """window_start, style and the 2 x 2 counts of presence and label, of a stream or a table.

    Of a stream, rows later than `late` behind the latest seen are left out, and a window's state goes when it is that old. Rows without a time or a style are left
    out; a null presence or label counts as none."""
    present, label = F.coalesce(present, F.lit(False)), F.coalesce(label, F.lit(False))
    timed = rows.select(F.col(ts).cast("timestamp").alias("at"), F.col(style).alias("style"), present.alias("present"), label.alias("label")).withWatermark("at", late)
    p, y = F.col("present"), F.col("label")
    counted = timed.where("at IS NOT NULL AND style IS NOT NULL").groupBy(F.window("at", window).alias("w"), "style").agg(F.count_if(p & y).alias("n11"), F.count_if(p & ~y).alias("n10"), F.count_if(~p & y).alias("n01"), F.count_if(~p & ~y).alias("n00"))
    return counted.select(F.col("w.start").alias("window_start"), "style", *CELLS)


def start(counted: DataFrame, folder: str, once: bool = True) -> StreamingQuery:
    """Run the stream in update mode into folder, which driver and executors share: all that its source holds now (once), or for ever."""

    def keep(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{folder}/updates/batch={number}")

    writer = counted.writeStream.outputMode("update").option("checkpointLocation", f"{folder}/state").foreachBatch(keep)
    return (writer.trigger(availableNow=True) if once else writer).start()


def current(spark: SparkSession, folder: str, schema: str) -> DataFrame:
    """The last counts of each window and style."""
    updates = spark.read.schema(f"{schema}, batch bigint").parquet(f"{folder}/updates")
    last = updates.groupBy(*KEYS).agg(F.max_by(F.struct(*CELLS), "batch").alias("c"))
    return last.select(*KEYS, *[F.col(f"c.{c}") for c in CELLS])


def compacted(spark: SparkSession, folder: str, schema: str) -> int:
    """Fold all batches but the last into one: the folder holds a row for each key and what the last batch changed. The number of batches folded."""
    fs_path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    root = fs_path(f"{folder}/updates")
    fs = root.getFileSystem(conf)
    names = sorted(int(f.getPath().getName().split("=")[1]) for f in fs.listStatus(root) if f.getPath().getName().startswith("batch="))
    old = names[:-1]
    if len(old) < 2:
        return 0
    rows = spark.read.schema(f"{schema}, batch bigint").parquet(f"{folder}/updates").where(F.col("batch") <= old[-1])
    kept = rows.groupBy(*KEYS).agg(F.max_by(F.struct(*CELLS), "batch").alias("c")).select(*KEYS, *[F.col(f"c.{c}") for c in CELLS])
    kept.write.mode("overwrite").parquet(f"{folder}/folding")
    # The folded rows join the last of the old batches, whose own rows say the same; only then do the others go, so no key is missing at any time.
    for f in fs.listStatus(fs_path(f"{folder}/folding")):
        if f.getPath().getName().startswith("part-"):
            fs.rename(f.getPath(), fs_path(f"{folder}/updates/batch={old[-1]}/{f.getPath().getName()}"))
    for k in old[:-1]:
        fs.delete(fs_path(f"{folder}/updates/batch={k}"), True)
    return len(old)


def association(counted: DataFrame) -> DataFrame:
    """Per style over all windows: the counts, the lift of the label and chi-square."""
    total = counted.groupBy("style").agg(*[F.sum(c).cast("double").alias(c) for c in CELLS])
    return metrics.association(total)


SCHEMA = "window_start timestamp, style string, n11 bigint, n10 bigint, n01 bigint, n00 bigint"
