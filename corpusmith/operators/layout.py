"""Where rows lie."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def spread(df: DataFrame) -> DataFrame:
    """df over all cores, for work that takes much longer than moving its rows. A table of few files, or of one row group, is one task
    otherwise; one with enough partitions already stays as it is, without a shuffle."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < 2 * cores else df


#: Fixed value: bytes of input, by Spark's estimate, to a task whose groups should fit in memory.
TASK = 4 << 20


def tasks(df: DataFrame, each: int = TASK) -> int:
    """How many tasks to deal df's rows to, so that what a task aggregates stays as small when the input grows. each: bytes of input to a task."""
    size = int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    return max(df.sparkSession.sparkContext.defaultParallelism, size // each + 1)


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share (spark.checkpoint.dir); where none is set, a temporary one on a local master, else an error."""
    sc = spark.sparkContext
    named = sc.getConf().get("spark.checkpoint.dir")
    if named:
        return named.rstrip("/")
    if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
        raise ValueError("spark.checkpoint.dir is not set: on a cluster, written tables need a folder that driver and executors share")
    return f"file://{tempfile.mkdtemp(prefix='corpusmith-')}"


def written(df: DataFrame, name: str) -> DataFrame:
    """df written as Parquet in the shared folder and read back: what a plan reads twice, or must not decide twice. The folder goes when the
    application ends."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/corpusmith/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(place)
    return spark.read.schema(df.schema).parquet(path)


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Names like these that no column of df has, in any case of letters."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out
