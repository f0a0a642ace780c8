"""Helpers that the operators of this subpackage share."""

from __future__ import annotations

import contextlib
import tempfile
import uuid
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows in an Arrow batch handed to a Python worker. Texts may be megabytes long, so few rows.
ARROW_ROWS = 256


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def small_batches(spark: SparkSession) -> None:
    """Bound what one Arrow batch of texts holds, in rows and in bytes."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(ARROW_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(16 << 20))


@contextlib.contextmanager
def settings(spark: SparkSession, **values: str) -> Iterator[None]:
    """The session with these settings (names with __ for .) while a job inside runs; as it was afterwards."""
    names = {k.replace("__", "."): v for k, v in values.items()}
    before = {k: spark.conf.get(k, None) for k in names}
    for k, v in names.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def arrow_batches(spark: SparkSession) -> contextlib.AbstractContextManager[None]:
    """Bound what one Arrow batch of texts holds, in rows and in bytes, for a job that runs inside."""
    return settings(spark, spark__sql__execution__arrow__maxRecordsPerBatch=str(ARROW_ROWS), spark__sql__execution__arrow__maxBytesPerBatch=str(16 << 20))


def text_or_empty(name: str = "text") -> Column:
    return F.coalesce(F.col(name).cast("string"), F.lit(""))


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share (spark.checkpoint.dir); where none is set, a temporary one on a local master, else an error."""
    sc = spark.sparkContext
    named = sc.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if sc.getCheckpointDir() is None:
        if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir is not set: on a cluster, intermediate tables need a folder that driver and executors share")
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="corpusmith-"))
    return sc.getCheckpointDir().rstrip("/")


def staged(df: DataFrame, name: str, codec: str = "snappy") -> DataFrame:
    """Write df as Parquet in the shared folder and read it back: cuts lineage, survives a lost executor.

    The folder goes when the application ends."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/corpusmith/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", codec).parquet(path)
    jvm = spark.sparkContext._jvm
    place = jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(place)
    return spark.read.schema(df.schema).parquet(path)


def in_order(docs: DataFrame, nulls_last: bool = False) -> tuple[DataFrame, DataFrame]:
    """docs with _doc, a long in the order of doc_id; and _doc with text (null: empty), once for each _doc.

    Where ids are unique they are _doc themselves. Else the distinct (id, text) are numbered: null ids first (or last), then by id, then by a
    hash of the text; so rows that repeat an id and its text have one number, and rows with equal ids and different texts have several."""
    text = F.col("text").cast("string")
    ids = docs.agg(F.count("*").alias("n"), F.countDistinct("doc_id").alias("d")).first()
    if ids.n == ids.d and dict(docs.dtypes)["doc_id"] in ("bigint", "int", "smallint", "tinyint"):
        rows = docs.withColumn("_doc", F.col("doc_id").cast("long"))
        return rows, rows.select("_doc", text_or_empty().alias("text"))
    keyed = docs.withColumn("_key", F.struct("doc_id", F.xxhash64(text).alias("a"), F.xxhash64(F.lit(1), text).alias("b")))
    first = F.col("_key.doc_id")
    order = [first.asc_nulls_last() if nulls_last else first.asc_nulls_first(), F.col("_key.a"), F.col("_key.b")]
    names = keyed.select("_key").distinct().repartitionByRange(*order).sortWithinPartitions(*order).select("_key", F.monotonically_increasing_id().alias("_doc"))
    rows = _numbered(keyed, staged(names, "order"))
    return rows, rows.select("_doc", text_or_empty().alias("text")).dropDuplicates(["_doc"])


def _numbered(keyed: DataFrame, names: DataFrame) -> DataFrame:
    named = names.select(F.col("_key").alias("_name"), "_doc")
    same = F.col("_key.a").eqNullSafe(F.col("_name.a")) & F.col("_key.b").eqNullSafe(F.col("_name.b")) & F.col("_key.doc_id").eqNullSafe(F.col("_name.doc_id"))
    return keyed.join(named, same).drop("_key", "_name")


def slim(docs: DataFrame) -> DataFrame:
    """doc_id and text, and all other columns in one, `_row`: no name of theirs meets one of a plan's own."""
    others = [F.col(f"`{c}`") for c in docs.columns if c not in ("doc_id", "text")]
    return docs.select("doc_id", "text", F.struct(*others or [F.lit(0).alias("none")]).alias("_row"))


def restored(df: DataFrame, docs: DataFrame, **changed: Column) -> DataFrame:
    """The columns of docs from rows that slim() made, some of them changed."""
    own = lambda c: F.col(c) if c in ("doc_id", "text") else F.col("_row").getField(c)
    return df.select(*[changed.get(c, own(c)).alias(c) for c in docs.columns])


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions", "200"))
