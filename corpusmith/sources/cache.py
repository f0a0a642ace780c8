"""Features that are worked out once: tables addressed by what they were made from.

A table's name is a fingerprint of the files that its features come from (names, sizes, times of change), of the parameters, of the key and of the number of buckets; a changed
input or parameter is another table, and nothing stale is ever read. Tables are bucketed and sorted by their key, so cached features, splits, labels and
golds with one number of buckets join by it without a shuffle. A table counts once its _SUCCESS file is there; a build that broke off is done again, into a
folder of its own that is renamed when it is whole, so of two sessions that build the same table one wins and neither reads half of it.
"""

from __future__ import annotations

import hashlib
import json
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

BUCKETS = 64


def fingerprint(spark: SparkSession, inputs: list[str], parameters: dict) -> str:
    """Of the files below the inputs, whatever store they are in, and of the parameters (as JSON). Contents aren't read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(inputs).select("path", "length", F.unix_micros("modificationTime").alias("at"))
    each = files.select(F.sha2(F.concat_ws("\0", "path", F.col("length").cast("string"), F.col("at").cast("string")), 256).alias("h"))
    # Combined before the shuffle, in any order: counts and sums of the hash's parts, not a list of files.
    part = lambda i: F.sum(F.conv(F.substring("h", 1 + 12 * i, 12), 16, 10).cast("decimal(38,0)")).cast("string")
    said = each.agg(F.count("*").alias("n"), *[part(i).alias(f"p{i}") for i in range(5)]).first()
    return hashlib.sha256(json.dumps([list(said), parameters], sort_keys=True, default=str).encode()).hexdigest()[:32]


class FeatureCache:
    """Cached tables below a folder that driver and executors share."""

    def __init__(self, spark: SparkSession, folder: str, buckets: int = BUCKETS):
        self.spark, self.folder, self.buckets = spark, folder.rstrip("/"), buckets
        self.hits, self.misses = 0, 0

    def _path(self, path: str):
        place = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        return place, place.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def _whole(self, path: str) -> bool:
        place, fs = self._path(f"{path}/_SUCCESS")
        return fs.exists(place)

    def get(self, name: str, inputs: list[str], key: str, build: Callable[[], DataFrame], **parameters) -> DataFrame:
        """The features `name` of these input files, with these parameters; built if they aren't there. key: the column to bucket and sort by."""
        mark = fingerprint(self.spark, inputs, {"name": name, "key": key, "buckets": self.buckets, **parameters})
        path, table = f"{self.folder}/{name}-{mark}", f"cached_{name}_{mark}"
        if self._whole(path):
            self.hits += 1
        else:
            self.misses += 1
            self._build(build(), key, path)
        schema = self.spark.read.parquet(path).schema
        columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema.fields)
        # The catalog of a session may know the table from elsewhere, or not yet; files are what counts.
        self.spark.sql(f"DROP TABLE IF EXISTS {table}")
        self.spark.sql(f"CREATE TABLE {table} ({columns}) USING parquet CLUSTERED BY (`{key}`) SORTED BY (`{key}`) INTO {self.buckets} BUCKETS LOCATION '{path}'")
        return self.spark.table(table)

    def _build(self, df: DataFrame, key: str, path: str) -> None:
        own = f"{path}.{uuid.uuid4().hex}"
        table = f"building_{uuid.uuid4().hex}"
        # One task a bucket, so that a bucket is one file in order.
        df.repartition(self.buckets, key).sortWithinPartitions(key).write.format("parquet").bucketBy(self.buckets, key).sortBy(key).option("path", own).saveAsTable(table)
        self.spark.sql(f"DROP TABLE {table}")  # an outside table's files stay
        (there, fs), (made, _) = self._path(path), self._path(own)
        if fs.exists(there) and not self._whole(path):
            fs.delete(there, True)  # what a session left that broke off
        if fs.exists(there) or not fs.rename(made, there):
            fs.delete(made, True)
            if not self._whole(path):
                raise OSError(f"{path} could not be put in place")
