"""Results of many runs put together: logs whose fields are not known beforehand, summaries at all levels from one scan, and the grid of what could have run."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def read_runs(spark: SparkSession, path: str, name: str = "res.jsonl") -> DataFrame:
    """run (the folder) and log, a VARIANT, of each line of the files of this name below path: no schema is needed, and no line is lost to one."""
    rows = spark.read.option("singleVariantColumn", "log").option("recursiveFileLookup", "true").option("pathGlobFilter", name).json(path)
    return rows.select(F.element_at(F.split("_metadata.file_path", "/"), -2).alias("run"), "log")


def fields_of(runs: DataFrame, log: str = "log") -> str:
    """The schema that fits all logs, found by aggregation."""
    return runs.agg(F.schema_of_variant_agg(F.col(log)).alias("s")).first().s


def metrics_of(runs: DataFrame, by: tuple[str, ...] = ("run",), log: str = "log") -> DataFrame:
    """One row for each field of each log: by, metric, value (double) and mistyped, in one pass over logs with any fields.

    A field that a log lacks gives no row. A JSON null gives a row with a null value; a value that is no number (a text that says none, a boolean, a list,
    an object) has a null value and mistyped is true. A log that is no object has no fields."""
    spark = runs.sparkSession
    view = "corpusmith_runs"
    runs.select(*by, F.col(log).alias("log")).createOrReplaceTempView(view)
    names = ", ".join(f"r.`{c}`" for c in by)
    each = spark.sql(f"SELECT {names}, e.key AS metric, e.value AS v FROM {view} r, LATERAL variant_explode(CASE WHEN startswith(schema_of_variant(r.log), 'OBJECT') THEN r.log END) AS e")
    kind = F.expr("schema_of_variant(v)")
    number = F.when(kind != "BOOLEAN", F.expr("try_variant_get(v, '$', 'double')"))
    return each.select(*by, "metric", number.alias("value"), (number.isNull() & (kind != "VOID")).alias("mistyped"))


def moments(df: DataFrame, value: str, by: tuple[str, ...]) -> DataFrame:
    """Per group n, s1 and s2, the sums of the value's powers, with low and high: they merge by adding. Nulls are left out."""
    v = F.col(value).cast("double")
    return df.groupBy(*by).agg(F.count(v).alias("n"), F.coalesce(F.sum(v), F.lit(0.0)).alias("s1"), F.coalesce(F.sum(v * v), F.lit(0.0)).alias("s2"), F.min(v).alias("low"), F.max(v).alias("high"))


def levels(kept: DataFrame, levels: list[tuple[str, ...]]) -> DataFrame:
    """Mean and sample deviation at each level (a level names the columns that it keeps; the others are null), from moments alone, in one pass.

    level is the number of columns kept; a null of the data is told from a column left out by it. sd is null for fewer than two values."""
    columns = list(dict.fromkeys(c for one in levels for c in one))
    sets = [[F.col(c) for c in one] for one in levels]
    kept_columns = sum((1 - F.grouping(c) for c in columns[1:]), 1 - F.grouping(columns[0])) if columns else F.lit(0)
    sums = kept.groupingSets(sets, *columns).agg(kept_columns.cast("int").alias("level"), F.sum("n").alias("n"), F.sum("s1").alias("s1"), F.sum("s2").alias("s2"), F.min("low").alias("low"), F.max("high").alias("high"))
    variance = F.greatest(F.lit(0.0), F.col("s2") - F.col("s1") * F.col("s1") / F.col("n")) / (F.col("n") - 1)
    return sums.select(*columns, "level", "n", F.when(F.col("n") > 0, F.col("s1") / F.col("n")).alias("mean"), F.when(F.col("n") > 1, F.sqrt(variance)).alias("sd"), "low", "high")


def grid(axes: dict[str, DataFrame], done: DataFrame, where: Column | None = None) -> DataFrame:
    """All combinations of the distinct values of the axes (tables of one column each) that satisfy where, with n_done: how many rows of done have them.

    Axes are counted after their values are made distinct, and the large ones are not sent to all executors: Spark's own threshold decides."""
    tables = [df.select(F.col(df.columns[0]).alias(name)).distinct().where(F.col(name).isNotNull()) for name, df in axes.items()]
    cells = reduce(lambda a, b: a.crossJoin(b), tables)
    cells = cells if where is None else cells.where(where)
    counts = done.groupBy(*axes).agg(F.count("*").alias("n_done"))
    return cells.join(counts, list(axes), "left").withColumn("n_done", F.coalesce("n_done", F.lit(0).cast("long")))
